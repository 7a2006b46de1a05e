"""Registration of queries: a Spark plan, the SQL that checks it, and the columns both must return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, doubles: str = "", digits: int = 6, ints: str = "", other: str = "", sql: str | None = None):
    """Register a plan. Doubles are rounded and integers widened on both sides, so that results compare by value."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(spark, lambda t: table(spark, sf_dir, t))
            return out.select(*other.split(), *(F.col(c).cast("bigint").alias(c) for c in ints.split()), *((F.round(F.col(c).cast("double"), digits) + 0.0).alias(c) for c in doubles.split()))

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql:
            cols = [*other.split(), *(f"CAST({c} AS BIGINT) AS {c}" for c in ints.split()), *(f"round(CAST({c} AS DOUBLE), {digits}) + 0.0 AS {c}" for c in doubles.split())]
            SQL[name] = f"SELECT {', '.join(cols)} FROM ({sql}) checked"
        return run

    return register


def hourly(t) -> DataFrame:
    """Events per hour as a signal (i, x); one row per hour of the table's span, zero where there are none."""
    h = t("events").groupBy(F.date_trunc("hour", "ts").alias("hr")).agg(F.count(F.lit(1)).cast("double").alias("x"))
    ends = h.agg(F.min("hr").alias("lo"), F.max("hr").alias("hi"))
    slots = ends.select("lo", F.explode(F.expr("sequence(lo, hi, interval 1 hour)")).alias("hr"))
    return slots.join(h, "hr", "left").select(F.expr("timestampdiff(HOUR, lo, hr)").cast("bigint").alias("i"), F.coalesce("x", F.lit(0.0)).alias("x"))


HOURLY = """hr_n AS (SELECT date_trunc('hour', ts) AS hr, CAST(count(*) AS DOUBLE) AS x FROM events GROUP BY 1),
 hr_all AS (SELECT lo, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS hr FROM (SELECT min(hr)::TIMESTAMP AS lo, max(hr)::TIMESTAMP AS hi FROM hr_n)),
 h AS (SELECT date_diff('hour', lo, hr_all.hr) AS i, coalesce(x, 0.0) AS x FROM hr_all LEFT JOIN hr_n ON hr_all.hr = hr_n.hr::TIMESTAMP)"""


def daily(t) -> DataFrame:
    """Order value per day, in millions, as points (t, y)."""
    d = t("orders").groupBy(F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01")).cast("double").alias("t"))
    return d.agg((F.sum("o_totalprice") / 1e6).alias("y"))


DAILY = "d AS (SELECT CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS t, sum(o_totalprice) / 1e6 AS y FROM orders GROUP BY 1)"


def by_type(t) -> DataFrame:
    """Daily mean value per event type: a keyed signal (key, i, x)."""
    d = t("events").groupBy(F.col("event_type").alias("key"), F.datediff(F.to_date("ts"), F.lit("2024-01-01")).cast("bigint").alias("day")).agg(F.avg("value").alias("x"))
    return d.select("key", (F.row_number().over(Window.partitionBy("key").orderBy("day")) - 1).cast("bigint").alias("i"), "x")


BY_TYPE = "s AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY day) - 1 AS i, x FROM (SELECT event_type AS key, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day, avg(value) AS x FROM events GROUP BY 1, 2))"
