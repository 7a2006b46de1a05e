"""Loop runtime: cut lineage through the shared folder, keep iteration metrics."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; an own folder only where it is unset (local runs)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="gridflux-loop-")
    return _OWN[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: a bounded plan each round that survives lost executors."""
    spark, path, schema = df.sparkSession, scratch(df.sparkSession, "loop"), df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


class History:
    """(iteration, value) pairs of a loop, as a table on request."""

    def __init__(self):
        self.values: list[tuple[int, float]] = []

    def add(self, value: float) -> None:
        self.values.append((len(self.values), float(value)))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.values, "iteration int, value double")
