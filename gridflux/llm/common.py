"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN: dict[str, str] = {}

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a local session takes an own one, and a cluster is refused."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="gridflux-")
    return _OWN[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage is cut, a lost executor loses nothing."""
    spark, path, schema = df.sparkSession, scratch(df.sparkSession, name), df.schema
    df.write.parquet(path)
    back = spark.read.schema(schema).parquet(path)
    back._stored_at = path
    return back


def forget(*frames: DataFrame) -> None:
    """Delete what `stored` wrote for these frames; nothing that is still to be computed may read them."""
    for df in frames:
        if path := getattr(df, "_stored_at", None):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def sized(df: DataFrame, most_rows: int) -> DataFrame:
    """df marked for broadcast if it is counted to hold at most most_rows rows, else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Texts travel to Python by so many rows at a time, unless the session says otherwise: with Spark's 10,000 a whole partition stands in the executor and in Python, and back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(rows))


def only(df: DataFrame, *names: str) -> DataFrame:
    """The columns an operator works with; extra ones, whatever their names, stay outside."""
    return df.select(*(df[f"`{n}`"] for n in names))


def lower_az(text: Column) -> Column:
    """A-Z lower-cased and nothing else. Pure ASCII takes the byte-wise lower()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def crc_mod(ident: Column, m: int) -> Column:
    """crc32 of an id's decimal text, modulo m; -1 for null."""
    return F.coalesce(F.pmod(F.crc32(ident.cast("string")), F.lit(m)), F.lit(-1))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_sample(df: DataFrame, key: str, ident: str, per_key: int, most_rows: int = 300_000) -> DataFrame:
    """About per_key rows of each value of `key`, fewer where so many values would bring more than most_rows; picked by a hash of `ident`.

    Every value has its share, however many there are. The pick depends on the rows alone, not on partitions.
    """
    known = stored(df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("__n")), "classes")
    kinds = known.count()
    if not kinds:
        return df.limit(0)
    per_key = max(1, min(per_key, most_rows // kinds))
    share = F.pmod(F.xxhash64(F.lit("sample"), F.col(ident).cast("string")), F.lit(1 << 20)) / float(1 << 20)
    return df.join(sized(known, 100_000), F.col(key) == F.col("__key")).where(share * F.col("__n") < per_key).drop("__key", "__n")


def with_computed(df: DataFrame, column: str, compute, added: str) -> DataFrame:
    """df plus the columns `added` (a schema string), where compute(values of `column`) gives their Arrow arrays batch by batch.

    `compute` is made anew in each task by calling it without arguments. Columns travel by position, so that their names
    may hold anything; columns that bear an added name are replaced.
    """
    small_batches(df.sparkSession)
    new = T._parse_datatype_string(added)
    df = df.drop(*new.names)
    names = df.columns
    at = names.index(column)
    plain = df.toDF(*(f"c{i}" for i in range(len(names))))
    schema = T.StructType([*plain.schema.fields, *new.fields])

    def run(batches):
        import pyarrow as pa

        step = compute()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, *step(b.column(at))], schema.names)

    return plain.mapInArrow(run, schema).toDF(*names, *new.names)
