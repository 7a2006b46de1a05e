"""Sequence packing by non-negative least squares over a length histogram.

Documents become token ids plus an end id and are cut every `window` ids; each cut gives one piece. Piece lengths are
binned by `unit`. On the driver, where the histogram has window/unit bins whatever the corpus size, all combinations of
up to `depth` bins that fill a window exactly are enumerated, non-negative least squares gives each its repeat count
against the histogram, counts are rounded, and what is left is packed greedily, largest first. The plan is a table of
a few hundred rows (bin, rank range, first sequence, slot); pieces find their place by their rank within their bin.

Edge cases: null and empty texts are documents of the end id alone; rows without doc_id and repeated rows are packed as
any other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridflux.llm.common import only, small_batches, stored, table

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def _encoder(json_path: str):
    """Text to ids of the byte-level BPE in json_path; a faster library reads the same ranks, the file's own one stands in where that fails."""
    import json

    import tiktoken
    from tokenizers import Tokenizer

    spec = json.load(open(json_path, encoding="utf-8"))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(plain))}
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    ranks = {bytes(chars[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in special}
    from public_tokenizers import PATTERN

    fast, slow = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special), Tokenizer.from_file(json_path)

    def encode(text: str) -> np.ndarray:
        if text and not any(s in text for s in special):
            try:
                return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), dtype="<u4")
            except BaseException as e:  # a regex engine's limits surface as panics
                if isinstance(e, (KeyboardInterrupt, SystemExit)):
                    raise
        return np.array(slow.encode(text, add_special_tokens=False).ids, dtype="<u4")

    return encode


def token_pieces(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece of at most `window` ids, with a checksum of its ids."""
    small_batches(docs.sparkSession)

    def pieces(batches):
        import zlib

        import pyarrow as pa

        encode, kinds = _encoder(tokenizer), [pa.int64()] * 5
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for at in range(0, len(ids), window):
                    part = ids[at : at + window]
                    rows.append((doc_id, at, len(part), zlib.crc32(part.tobytes()), len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(pieces, PIECES)


def fillings(units: int, depth: int) -> list[tuple[int, ...]]:
    """Every multiset of at most `depth` bins, largest first, that sums to `units`."""
    found = []

    def extend(rest: int, most: int, parts: tuple[int, ...]) -> None:
        if not rest:
            found.append(parts)
        elif len(parts) < depth:
            for b in range(min(rest, most), 0, -1):
                if b * (depth - len(parts)) < rest:
                    break
                extend(rest - b, b, (*parts, b))

    extend(units, units, ())
    return found


def nnls(a: np.ndarray, b: np.ndarray, most_steps: int = 600) -> np.ndarray:
    """min |ax - b| over x >= 0 by active sets: enter the steepest column, solve, step back to the bound if one turns negative."""
    g, r = a.T @ a, a.T @ b
    x, inside = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tol = 1e-9 * max(1.0, float(np.abs(r).max(initial=0)))
    for _ in range(most_steps):
        slope = r - g @ x
        slope[inside] = -np.inf
        if inside.all() or slope.max(initial=-np.inf) <= tol:
            break
        inside[int(slope.argmax())] = True
        while True:
            on = np.flatnonzero(inside)
            s = np.zeros_like(x)
            s[on] = np.linalg.lstsq(g[np.ix_(on, on)], r[on], rcond=None)[0]
            if not on.size or s[on].min() > 0:
                break
            low = on[s[on] <= 0]
            step = (x[low] / np.maximum(x[low] - s[low], 1e-300)).min()
            x += step * (s - x)
            inside[on[x[on] <= 1e-12 * (1 + np.abs(b).max(initial=0))]] = False
            x[~inside] = 0
        x = s
    return x


def plan(histogram: dict[int, int], units: int, depth: int) -> list[tuple[tuple[int, ...], int]]:
    """(bins of a sequence, repeats): rounded least-squares fillings first, then greedy ones for the residual."""
    left = {b: n for b, n in histogram.items() if n > 0}
    counts = np.array([float(left.get(b, 0)) for b in range(1, units + 1)])
    used: list[tuple[tuple[int, ...], int]] = []

    def take(parts: tuple[int, ...], reps: int) -> None:
        reps = min([reps, *(left.get(b, 0) // parts.count(b) for b in set(parts))])
        if reps > 0:
            used.append((parts, reps))
            for b in parts:
                left[b] -= reps

    combos = [p for p in fillings(units, depth) if all(left.get(b) for b in p)]
    if combos:
        a = np.zeros((units, len(combos)))
        for j, p in enumerate(combos):
            for b in p:
                a[b - 1, j] += 1
        x = nnls(a, counts)
        for j in np.argsort(-x, kind="stable"):
            if x[j] > 0:
                take(combos[j], int(round(x[j])))
    while left := {b: n for b, n in left.items() if n > 0}:
        parts, rest, have = [], units, dict(left)
        while rest and (fit := max((b for b, n in have.items() if n > 0 and b <= rest), default=0)):
            parts.append(fit)
            have[fit] -= 1
            rest -= fit
        take(tuple(parts), 1 << 62)
    return used


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, unit: int = 16, depth: int = 3, end_id: int = 1) -> DataFrame:
    """A row per piece with its sequence_id and its offset there, gapless from 0."""
    spark = docs.sparkSession
    units = -(-window // unit)
    pieces = stored(token_pieces(only(docs, "doc_id", "text"), tokenizer, window, end_id), "pieces")
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = pieces.withColumn("bin", F.ceil(F.col("length") / unit).cast("int")).withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    cells = pieces.groupBy("bin", "salt").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["bin"]: r["n"] for r in cells.groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    slots, filled, first = [], dict.fromkeys(histogram, 0), 0
    for parts, reps in plan(histogram, units, depth):
        for slot, b in enumerate(parts):
            slots.append((b, filled[b], filled[b] + reps, first, slot))
            filled[b] += reps
        first += reps
    places = spark.createDataFrame(slots, "s_bin int, lo bigint, hi bigint, first bigint, slot int")
    before = cells.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("bin").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    order = Window.partitionBy("bin", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("nth", F.row_number().over(order)).join(before, ["bin", "salt"]).withColumn("rank", F.col("before") + F.col("nth") - 1)
    # the plan's rows are bounded by window/unit and depth, not by the corpus
    placed = ranked.join(F.broadcast(places), (F.col("bin") == F.col("s_bin")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    placed = placed.withColumn("sequence_id", F.col("first") + F.col("rank") - F.col("lo"))
    here = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(here), F.lit(0)).cast("bigint").alias("offset"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())
