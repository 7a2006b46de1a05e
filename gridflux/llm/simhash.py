"""Near duplicates by SimHash and pigeonring filtering.

A fingerprint has 64 bits, cut into m = budget + 1 segments placed on a ring. If two fingerprints differ in at most
`budget` bits, some segment starts a chain whose first l segments together differ in at most l * budget / m bits, for
every l. The first link of that chain must match exactly, so it is the join key; the cumulative differences of the
further links prune candidates, and the full Hamming distance decides.

Distinct fingerprints stand for all their rows. A bucket (segment, value) that holds more than `dense` distinct
fingerprints is not joined with itself; its members meet through keys instead: each emits itself and itself with any
`budget // 2` bits turned over. Two fingerprints within the budget share such a key, all that share one are
within the budget of each other, and a key's members are linked to the least of them, so links grow with the members
and no link is lost.

Edge cases: null, empty and blank texts have fingerprint zero and link like any other; repeated rows share a class;
rows without doc_id get their class but name none (a class of such rows alone has a null id); an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridflux.llm.common import UPPER, forget, only, stored, table

BITS = 64


def fingerprint_words(words: list[bytes], width: int, chunk: int = 1 << 15) -> int:
    """SimHash of the word shingles: a bit is set if over half the shingles' XXH64 have it."""
    from xxhash import xxh64_intdigest

    if not words:
        return 0
    if len(words) < width:
        return xxh64_intdigest(b" ".join(words), 42)
    joined, n = b" ".join(words), len(words) - width + 1
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    counts = np.zeros(BITS, np.int64)
    lo, hi = starts[:n].tolist(), ends[width - 1 :].tolist()
    for at in range(0, n, chunk):
        h = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(lo[at : at + chunk], hi[at : at + chunk])], dtype=">u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and the signed 64-bit fingerprint `fp` of every row's whole text."""

    def run(batches):
        import pyarrow as pa

        fold = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
        for b in batches:
            fps = [fingerprint_words((t.as_py() or "").encode().translate(fold).split(), width) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


def segments(budget: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of the budget + 1 segments."""
    m = budget + 1
    cuts = [BITS * k // m for k in range(m + 1)]
    return [(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:])]


def _segment(fp: Column, lo: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << width) - 1))


def links(fps: DataFrame, budget: int = 2, dense: int = 64) -> DataFrame:
    """Links (a, b), a < b, between distinct fingerprints: all of them in sparse buckets, a spanning star per key in dense ones."""
    if budget % 2:
        raise ValueError("the budget must be even: keys of dense buckets spend half of it on either side")
    parts, m = segments(budget), budget + 1
    keys = F.array(*(F.struct(F.lit(k).alias("seg"), _segment(F.col("fp"), *p).alias("val")) for k, p in enumerate(parts)))
    buckets = fps.select("fp", F.explode(keys).alias("key")).select("fp", "key.seg", "key.val")
    sizes = stored(buckets.groupBy("seg", "val").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    few, many = sizes.where(F.col("n") <= dense).drop("n"), sizes.where(F.col("n") > dense).drop("n")

    sparse = buckets.join(few, ["seg", "val"])
    a, b = sparse.withColumnRenamed("fp", "a"), sparse.withColumnRenamed("fp", "b")
    x = F.col("a").bitwiseXOR(F.col("b"))

    def chain(k: int) -> Column:
        spent, ok = F.lit(0), F.lit(True)
        for step in range(1, m):
            spent = spent + F.bit_count(_segment(x, *parts[(k + step) % m]))
            ok = ok & (spent <= (step + 1) * budget // m)
        return ok

    ring = chain(0)
    for k in range(1, m):
        ring = F.when(F.col("seg") == k, chain(k)).otherwise(ring)
    near = a.join(b, ["seg", "val"]).where((F.col("a") < F.col("b")) & ring & (F.bit_count(x) <= budget)).select("a", "b")

    crowded = buckets.join(many, ["seg", "val"]).select("fp").distinct()
    masks = [0]
    for _ in range(budget // 2):
        masks = sorted({q ^ (1 << i) for q in masks for i in range(BITS)} | set(masks))
    signed = [q - (1 << BITS) if q >> (BITS - 1) else q for q in masks]
    balls = crowded.select("fp", F.explode(F.array(*map(F.lit, signed))).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("center"))
    shared = balls.groupBy("center").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    stars = shared.select("a", F.explode("fps").alias("b")).where("a < b")
    return near.union(stars).distinct()


def components(edges: DataFrame, most_rounds: int = 60, share: int = 50_000) -> DataFrame:
    """(node, root): root is the least node reachable. Alternates large-star and small-star until the edges stand still.

    The rounds never add edges but for one a node, so their tables are written by a task per `share` of the edges counted.
    """
    at = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    seen, tasks = None, max(1, -(-at.count() // share))
    for _ in range(most_rounds):
        both = at.union(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stored(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct().coalesce(tasks), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        old, at = at, stored(small.where("u <> v").distinct().coalesce(tasks), "small")
        forget(old, large)
        now = tuple(at.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen or not now[0]:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return at.select(F.col("u").alias("node"), F.col("v").alias("root")).union(at.select("v", "v").distinct())


def near_duplicates(docs: DataFrame, width: int = 3, budget: int = 2, dense: int = 64) -> DataFrame:
    """doc_id, fp and component_id (least doc_id of the class) of every row."""
    fps = stored(fingerprints(only(docs, "doc_id", "text"), width), "fps")
    nodes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = components(links(nodes.select("fp"), budget, dense))
    linked = stored(nodes.join(roots, nodes["fp"] == roots["node"]).select("fp", "first", "root"), "linked")
    firsts = linked.groupBy("root").agg(F.min("first").alias("class_first"))
    moved = stored(linked.join(firsts, "root").select("fp", "class_first"), "moved")
    named = stored(nodes.join(moved, "fp", "left").select("fp", F.coalesce("class_first", "first").alias("component_id")), "classes")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
