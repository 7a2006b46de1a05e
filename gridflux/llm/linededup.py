"""Line deduplication against levelled sorted runs of line hashes.

A line's key is a 128-bit hash of its normalised text. A batch of documents, in order of doc_id, brings its distinct
keys with the least doc_id that holds each. They are anti-joined with the stored runs, so that only unseen keys remain,
and these become a new run: a Parquet table bucketed and sorted by key, so that later merges read it in order and never
shuffle it again. When `fanout` runs stand on a level they are compacted into one run of the next. Over all runs each
key stands once, with the first document that holds it; a line of another document with that key goes.

Only DataFrame functions are used. Edge cases: a null or empty text is one empty line; keys shorter than `least` code
points never count; repeated lines of one document alone stay; rows that share a doc_id are judged as the one document they name;
rows without doc_id count as one document after all others; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridflux.llm.common import UPPER, forget, lower_az, only, scratch, stored, table

BLANKS = " \t\n\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(core: Column, least: int) -> Column:
    """The 128-bit key of a lower-cased and stripped line, null if it is too short."""
    return F.when(F.char_length(core) >= least, F.struct(F.xxhash64(core).alias("h1"), F.xxhash64(F.lit("line"), core).alias("h2")))


class Runs:
    """Levelled runs (h1, h2, first) in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = 3):
        self.spark, self.fanout, self.levels = spark, fanout, []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.paths: dict[str, str] = {}

    def _write(self, rows: DataFrame) -> str:
        name, path = f"line_run_{uuid.uuid4().hex}", scratch(self.spark, "run")
        # bucket files line up with the hash partitions, so each task writes one sorted file
        spread = rows.repartition(self.buckets, "h1", "h2")
        spread.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(name)
        self.paths[name] = path
        return name

    def names(self) -> list[str]:
        return [n for level in self.levels for n in level]

    def add(self, keys: DataFrame) -> None:
        """Merge-anti-join the batch's (h1, h2, id) with every run, then add what is new as a run of level 0."""
        new = keys.groupBy("h1", "h2").agg(F.min("id").alias("first"))
        for n in self.names():
            new = new.join(self.spark.table(n).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(self._write(new))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            merged = self.spark.table(self.levels[level][0])
            for n in self.levels[level][1:]:
                merged = merged.union(self.spark.table(n))
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._write(merged))
            self.levels[level] = []
            level += 1

    def owners(self) -> DataFrame:
        """Every key with the first document that holds it."""
        return self.spark.read.schema("h1 bigint, h2 bigint, first bigint").parquet(*(self.paths[n] for n in self.names()))

    def close(self) -> None:
        for n in self.paths:
            self.spark.sql(f"DROP TABLE IF EXISTS {n}")


def lost_lines(docs: DataFrame, least: int = 10, batches: int = 4, fanout: int = 3) -> DataFrame:
    """(id, row, lost): the positions that the row with that id and text hash loses; rows that lose none are absent."""
    spark = docs.sparkSession
    # lambdas are interpreted and share nothing: a line is stripped once, before the lambda that uses it three times
    cores = F.transform(_lines(lower_az(F.col("text"))), lambda x: F.btrim(x, F.lit(BLANKS)))
    lines = F.transform(cores, lambda x: _key(x, least))
    keys = docs.select("id", "row", F.posexplode(lines).alias("pos", "k")).where("k is not null")
    keys = stored(keys.select("id", "row", "pos", "k.h1", "k.h2"), "keys")
    cuts = keys.approxQuantile("id", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    edges, runs = sorted({int(c) for c in cuts}), Runs(spark, fanout)
    try:
        for lo, hi in zip([None, *edges], [*edges, None]):
            part = keys if lo is None else keys.where(F.col("id") > lo)
            runs.add(part if hi is None else part.where(F.col("id") <= hi))
        lost = keys.join(runs.owners(), ["h1", "h2"]).where("first < id").select("id", "row", "pos")
        return stored(lost.groupBy("id", "row").agg(F.collect_set("pos").alias("lost")), "lost")
    finally:
        runs.close()
        forget(keys)


def dedup_lines(docs: DataFrame, least: int = 10, batches: int = 4, fanout: int = 3) -> DataFrame:
    """docs with `text` rid of repeated lines, plus n_lines and n_dropped. Other columns stay as they are."""
    rank = F.coalesce(docs["doc_id"].cast("bigint"), F.lit((1 << 63) - 1))
    row = F.xxhash64(docs["text"])
    lost = lost_lines(docs.select(rank.alias("id"), row.alias("row"), "text"), least, batches, fanout)
    lost = lost.select(F.col("id").alias("__id"), F.col("row").alias("__row"), F.col("lost").alias("__lost"))
    both = docs.join(lost, (rank == lost["__id"]) & (row == lost["__row"]), "left").drop("__id", "__row")
    lines = _lines(F.col("text"))

    def left(own: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col("__lost"))
        return F.array_join(F.transform(stay, lambda p: F.get(own, p)), "\n")

    both = both.withColumn("n_lines", F.size(lines).cast("bigint")).withColumn("n_dropped", F.coalesce(F.size("__lost"), F.lit(0)).cast("bigint"))
    # the lines are a lambda's argument, or they would be split anew for each line; a generated column is not computed again by a filter on it
    text = F.when(F.col("__lost").isNull(), F.array(F.coalesce("text", F.lit("")))).otherwise(F.transform(F.array(lines), left))
    return both.withColumn("text", F.explode(text)).drop("__lost")


def op9_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(only(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


BLANK_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP9_SQL = f"""
WITH l AS (SELECT doc_id, pos, line, lower_key AS k FROM (
        SELECT doc_id, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line,
               translate(trim(unnest(ls), {BLANK_SQL}), '{UPPER}', '{UPPER.lower()}') AS lower_key
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
     f AS (SELECT k, min(doc_id) AS first FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
     m AS (SELECT l.doc_id, l.pos, l.line, coalesce(l.doc_id > f.first, false) AS lost FROM l LEFT JOIN f ON l.k = f.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
