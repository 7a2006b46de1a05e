"""Toxicity by a factorization machine over hashed terms.

Terms are the lower-cased words of a text and the prefixes of its longer words, hashed into 2**20 places; a text is the
set of its places. The machine scores w0 + sum of w_i + sum over pairs of <v_i, v_j>, so that two terms together can weigh more
than their sum. It is trained by AdaGrad in numpy on a bounded sample of labelled rows; places are counted on the executors, and
at most `features` of them that tell the classes apart beyond chance are the model's size.

Edge cases: null and empty texts have no terms and get the score of the intercept; where rows of only one class, or none, are
labelled, the score is that class's (0 without any); rows without doc_id count as not held out but are never learned
from; repeated rows are scored alike; an empty table gives no rows; extra columns are kept.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridflux.llm.common import bounded_sample, crc_mod, only, stored, table, with_computed

PLACES = 1 << 20
PREFIXES = (4, 5, 6)
_WORD = re.compile(r"[^\W\d_]+")


def terms(word: str) -> list[int]:
    """Places of a word and of its prefixes."""
    found = [word, *(f"{word[:n]}-" for n in PREFIXES if len(word) > n)]
    return [zlib.crc32(t.encode()) % PLACES for t in found]


class Terms:
    """Places of the words of a text, with a bounded memory of words; `keep` maps places to model rows."""

    def __init__(self, keep: dict[int, int] | None = None, most: int = 200_000):
        self.keep, self.most, self.known = keep, most, {}

    def __call__(self, text: str | None) -> np.ndarray:
        found: set[int] = set()
        known, keep = self.known, self.keep
        for w in set(_WORD.findall((text or "").lower())):
            t = known.get(w)
            if t is None:
                if len(known) >= self.most:
                    known.clear()
                t = terms(w)
                known[w] = t = tuple(t if keep is None else (keep[x] for x in t if x in keep))
            if t:
                found.update(t)
        return np.fromiter(found, np.int64, len(found))


class FactorizationMachine:
    def __init__(self, size: int, rank: int = 4, seed: int = 3):
        self.w0, self.w = 0.0, np.zeros(size)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (size, rank))

    def raw(self, idx: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Scores of texts whose sorted places stand in idx from each of starts on; none may be empty."""
        vs = self.v[idx]
        s = np.add.reduceat(vs, starts)
        q = np.add.reduceat(vs * vs, starts)
        return self.w0 + np.add.reduceat(self.w[idx], starts) + 0.5 * (s * s - q).sum(1)

    def one(self, idx: np.ndarray) -> float:
        z = self.w0 if not len(idx) else float(self.raw(idx, np.array([0]))[0])
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    def fit(self, rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, epochs: int = 30, batch: int = 128, rate: float = 0.2, l2: float = 2e-5, seed: int = 9) -> FactorizationMachine:
        rng = np.random.default_rng(seed)
        g0, gw, gv = 1e-6, np.full_like(self.w, 1e-6), np.full_like(self.v, 1e-6)
        prior = float((y * weight).sum() / weight.sum())
        self.w0 = float(np.log(prior / (1 - prior)))
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                pick = [i for i in order[at : at + batch] if len(rows[i])]
                if not pick:
                    continue
                idx, sizes = np.concatenate([rows[i] for i in pick]), np.array([len(rows[i]) for i in pick])
                starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                d = (1 / (1 + np.exp(-np.clip(self.raw(idx, starts), -40, 40))) - y[pick]) * weight[pick] / len(pick)
                per, s = np.repeat(d, sizes), np.repeat(np.add.reduceat(self.v[idx], starts), sizes, axis=0)
                used, back = np.unique(idx, return_inverse=True)
                dw = np.bincount(back, per, len(used)) + l2 * self.w[used]
                dv = np.zeros((len(used), self.v.shape[1]))
                np.add.at(dv, back, per[:, None] * (s - self.v[idx]))
                dv += l2 * self.v[used]
                gw[used] += dw * dw
                gv[used] += dv * dv
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                self.v[used] -= 0.3 * rate * dv / np.sqrt(gv[used])
                g0 += d.sum() ** 2
                self.w0 -= 0.3 * rate * d.sum() / np.sqrt(g0)
        return self


def telling(places: DataFrame, n1: int, n0: int, most: int, least: int = 3, least_score: float = 10.0) -> np.ndarray:
    """The model's places, from (y, place) of the sample: those in `least` rows or more whose chi-square (one degree) is `least_score` or more, the best `most` of them.

    A term that is spread evenly over the classes whatever stands beside it is left out, so a pair counts where at least a trace of it shows in each term alone.
    """
    got = places.groupBy("place").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")).withColumn("both", F.col("pos") + F.col("neg")).where(F.col("both") >= least)
    gap = (F.col("pos") * (n0 - F.col("neg")) - F.col("neg") * (n1 - F.col("pos"))).cast("double")
    score = gap * gap * float(n1 + n0) / F.greatest(F.col("both") * (n1 + n0 - F.col("both")) * (float(n1) * float(n0)), F.lit(1e-9))
    best = got.withColumn("score", score).where(F.col("score") >= least_score).orderBy(F.desc("score"), "place").limit(most)
    return np.array(sorted(r["place"] for r in best.collect()), np.int64)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 4000, features: int = 4096, rare: float = 3.0):
    """(machine, places) from a sample of about per_class rows of each class; (prior, None) where there is no second class.

    Rows of the rarer class weigh `rare` times their share. The driver gets the places of the sampled rows that the model keeps,
    at most `features` a row, whatever the length of the texts.
    """
    marks = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("y is not null and doc_id is not null")
    n = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    if len(n) < 2:
        return float(next(iter(n), 0)), None
    sample = stored(bounded_sample(marks, "y", "doc_id", per_class), "sample")
    # the sample's expected size is 2 * per_class rows of two numbers, whatever the corpus
    texts = stored(docs.join(F.broadcast(sample), "doc_id").select("doc_id", "y", "text"), "texts")
    size = {r["y"]: r["count"] for r in texts.groupBy("y").count().collect()}
    if len(size) < 2:
        return float(next(iter(size), 0)), None

    def places(keep: dict[int, int] | None) -> DataFrame:
        def compute():
            import pyarrow as pa

            read = Terms(keep)
            return lambda column: [pa.array([np.sort(read(t.as_py())).tolist() for t in column], pa.list_(pa.int64()))]

        return with_computed(texts, "text", compute, "places array<bigint>").select("doc_id", "y", "places")

    kept = telling(places(None).select("y", F.explode("places").alias("place")), size.get(1, 0), size.get(0, 0), features)
    got = places({int(p): i for i, p in enumerate(kept)}).toArrow().sort_by("doc_id")
    y, rows = np.array(got["y"].to_pylist(), float), [np.array(r, np.int64) for r in got["places"].to_pylist()]
    share = {k: n[k] / size[k] for k in n}
    weight = np.array([share[int(t)] * (rare if n[int(t)] == min(n.values()) else 1.0) for t in y])
    return FactorizationMachine(len(kept)).fit(rows, y, weight / weight.mean()), kept


def score(docs: DataFrame, model) -> DataFrame:
    """docs plus score and predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def compute():
        import pyarrow as pa

        machine, places = sent.value
        if places is None:
            return lambda column: [pa.array([machine] * len(column), pa.float64())]
        read = Terms({int(p): i for i, p in enumerate(places)})
        return lambda column: [pa.array([machine.one(np.sort(read(t.as_py()))) for t in column], pa.float64())]

    return with_computed(docs, "text", compute, "score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = only(table(spark, sf_dir, "documents"), "doc_id", "text"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(crc_mod(F.col("doc_id"), 5) != 0))
    return score(docs, model).select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
