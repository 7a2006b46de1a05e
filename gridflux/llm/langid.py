"""Language identification by a byte convolutional network.

Filters of several widths run over the bytes of fixed-length windows; each filter's largest response over the window,
rectified, feeds a softmax over the learned languages. It is trained in numpy by Adam on windows of a bounded sample of
labelled rows. A text is predicted from all its windows, each weighted by the bytes that it holds.

Edge cases: `und` with score 0 for null texts and texts without a letter; where nothing can be learned (no labelled row)
every text is `und`; labels that are null are not learned; repeated rows and extra columns change nothing; an empty
table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridflux.llm.common import bounded_sample, crc_mod, only, table, with_computed

WINDOW = 256
WIDTHS = (2, 3, 4)
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")


def windows_of(data: bytes, size: int = WINDOW) -> np.ndarray:
    n = max(1, -(-len(data) // size))
    out = np.zeros(n * size, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, size)


class ByteCNN:
    """weights: per width an array (width, 256, filters) and a bias; then a dense layer."""

    def __init__(self, labels: list[str], filters: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.p = {f"e{w}": rng.normal(0, 0.3 / w, (w, 256, filters)).astype(np.float32) for w in WIDTHS}
        self.p |= {f"c{w}": np.zeros(filters, np.float32) for w in WIDTHS}
        self.p |= {"d": rng.normal(0, 0.2, (len(WIDTHS) * filters, len(labels))).astype(np.float32), "b": np.zeros(len(labels), np.float32)}

    def _pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        pooled, where = [], []
        for w in WIDTHS:
            n = x.shape[1] - w + 1
            s = self.p[f"e{w}"][0][x[:, :n]]
            for j in range(1, w):
                s = s + self.p[f"e{w}"][j][x[:, j : j + n]]
            at = s.argmax(axis=1)
            where.append(at)
            pooled.append(np.take_along_axis(s, at[:, None, :], 1)[:, 0] + self.p[f"c{w}"])
        return np.concatenate(pooled, axis=1), where

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, least_steps: int = 400, batch: int = 128, rate: float = 0.01, seed: int = 11) -> ByteCNN:
        """Adam over `epochs` passes, and as many more as `least_steps` steps take: few rows are met more often."""
        epochs = max(epochs, -(-least_steps // -(-len(x) // batch)))
        rng = np.random.default_rng(seed)
        m, v, t = {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}, 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                pick = order[at : at + batch]
                xb, yb = x[pick], y[pick]
                z, where = self._pooled(xb)
                a = np.maximum(z, 0)
                q = _softmax(a @ self.p["d"] + self.p["b"])
                q[np.arange(len(pick)), yb] -= 1
                q /= len(pick)
                g = {"d": a.T @ q, "b": q.sum(0)}
                dz = (q @ self.p["d"].T) * (z > 0)
                rows = np.arange(len(pick))[:, None]
                for k, w in enumerate(WIDTHS):
                    f = self.p[f"c{w}"].size
                    part = dz[:, k * f : (k + 1) * f]
                    g[f"c{w}"], e = part.sum(0), np.zeros_like(self.p[f"e{w}"])
                    for j in range(w):
                        np.add.at(e[j], (xb[rows, where[k] + j], np.arange(f)[None, :]), part)
                    g[f"e{w}"] = e
                t += 1
                step = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
                for k, d in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.999 * v[k] + 0.001 * d * d
                    self.p[k] -= (step * m[k] / (np.sqrt(v[k]) + 1e-7)).astype(np.float32)
        return self

    def compiled(self) -> dict[str, np.ndarray]:
        """Responses of byte pairs: a filter of width 4 is then the sum of two look-ups in place of four."""
        t = {}
        for w in WIDTHS:
            e = self.p[f"e{w}"]
            for j in range(0, w - 1, 2):
                t[f"{w}:{j}"] = np.ascontiguousarray((e[j][:, None, :] + e[j + 1][None, :, :]).reshape(65536, -1))
            if w % 2:
                t[f"{w}:{w - 1}"] = np.ascontiguousarray(e[w - 1])
        return t

    def probabilities(self, x: np.ndarray, tables: dict[str, np.ndarray], block: int = 64) -> np.ndarray:
        out = np.empty((len(x), len(self.labels)), np.float32)
        for at in range(0, len(x), block):
            b = np.ascontiguousarray(x[at : at + block].T)  # places first: the largest response is then taken over long rows
            pairs = (b[:-1].astype(np.intp) << 8) | b[1:]
            pooled = []
            for w in WIDTHS:
                n, s = len(b) - w + 1, None
                for j in range(0, w, 2):
                    look = pairs if j + 1 < w else b
                    part = np.take(tables[f"{w}:{j}"], look[j : j + n], axis=0)
                    s = part if s is None else np.add(s, part, out=s)
                pooled.append(s.max(axis=0) + self.p[f"c{w}"])
            out[at : at + block] = _softmax(np.maximum(np.concatenate(pooled, axis=1), 0) @ self.p["d"] + self.p["b"])
        return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(docs: DataFrame, per_label: int = 1200, filters: int = 16, seed: int = 5) -> ByteCNN | None:
    """Fit on about per_label windows of each label of docs (doc_id, text, lang): the bound of the sample."""
    spot = F.pmod(F.xxhash64(F.lit("spot"), "doc_id"), F.greatest(F.char_length("text") - WINDOW, F.lit(1))).cast("int") + 1
    rows = bounded_sample(docs.where("text is not null and lang is not null"), "lang", "doc_id", per_label)
    got = sorted((r["lang"], r["part"]) for r in rows.select("lang", F.col("text").substr(spot, F.lit(WINDOW)).alias("part")).collect() if _LETTER.search(r["part"]))
    labels = sorted({g[0] for g in got})
    if not labels:
        return None
    rng = np.random.default_rng(seed)
    x, y = [], []
    for lang, part in got:
        data = part.encode()[:WINDOW]
        for short in (False, True):  # short texts are met in training too
            cut = data[: int(rng.integers(12, WINDOW))] if short else data
            x.append(windows_of(cut)[0])
            y.append(labels.index(lang))
    return ByteCNN(labels, filters).fit(np.array(x), np.array(y))


def identify(docs: DataFrame, model: ByteCNN | None) -> DataFrame:
    """docs plus lang_pred and score, from every window of the whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def compute():
        import pyarrow as pa

        net = sent.value
        tables = net.compiled() if net else None

        def step(texts):
            lang, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            held, sizes, size = [], [], 0

            def flush():
                if not held:
                    return
                p, lo = net.probabilities(np.concatenate(held), tables), 0
                for row, n, length in sizes:
                    weight = np.full(n, WINDOW, np.float64)
                    weight[-1] = length - (n - 1) * WINDOW
                    q = weight @ p[lo : lo + n] / weight.sum()
                    lo += n
                    lang[row], score[row] = net.labels[int(q.argmax())], min(1.0, float(q.max()))
                held.clear()
                sizes.clear()

            for row, t in enumerate(texts):
                text = t.as_py()
                if net is None or text is None or not _LETTER.search(text):
                    continue
                data = text.encode()
                held.append(windows_of(data))
                sizes.append((row, len(held[-1]), len(data)))
                size += len(held[-1])
                if size >= 8192:
                    flush()
                    size = 0
            flush()
            return [pa.array(lang, pa.string()), pa.array(score, pa.float64())]

        return step

    return with_computed(docs, "text", compute, "lang_pred string, score double")


def learned(docs: DataFrame, held_out: int = 2, of: int = 4, **options) -> ByteCNN | None:
    """Train on the rows whose crc32(doc_id) mod `of` is not `held_out`."""
    return train(only(docs, "doc_id", "text", "lang").where(crc_mod(F.col("doc_id"), of) != held_out), **options)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(only(docs, "doc_id", "text"), learned(docs))
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
