"""Queries of filters over streams: the daily signal of each event type comes in several files, a file a micro-batch, out of order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridflux.operators.runtime import scratch
from gridflux.plans.base import BY_TYPE, by_type, query
from gridflux.streaming import filters

#: Files that the signal is dealt over.
PIECES = 3


def _streamed(spark, t, kernel: filters.Kernel) -> DataFrame:
    """The signal dealt over files by a hash of its sample number, filtered as a stream, and read back."""
    path = scratch(spark, "stream")
    signal = by_type(t)
    signal.repartition(PIECES, F.xxhash64("i")).write.parquet(f"{path}/signal")
    stream = spark.readStream.schema(signal.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/signal")
    return filters.drained(filters.filtered(stream, kernel), path)


@query("stream_fir", doubles="y", ints="i", other="key", digits=6, sql=f"WITH {BY_TYPE} SELECT key, i, 0.5 * x + 0.3 * coalesce(lag(x) OVER w, 0) + 0.2 * coalesce(lag(x, 2) OVER w, 0) AS y FROM s WINDOW w AS (PARTITION BY key ORDER BY i)")
def _fir(spark, t):
    return _streamed(spark, t, filters.fir([0.5, 0.3, 0.2]))


@query("stream_iir", doubles="y", ints="i", other="key", digits=6, sql=f"WITH {BY_TYPE} SELECT p.key, p.i, sum(0.3 * pow(0.7, p.i - q.i) * q.x) AS y FROM s p JOIN s q ON p.key = q.key AND q.i <= p.i GROUP BY 1, 2")
def _iir(spark, t):
    return _streamed(spark, t, filters.iir([0.3], [1.0, -0.7]))


@query("stream_biquads", doubles="y", ints="i", other="key", digits=6, sql=f"WITH {BY_TYPE} SELECT p.key, p.i, sum((pow(0.5, p.i - q.i + 1) - pow(0.25, p.i - q.i + 1)) * 4 * q.x) AS y FROM s p JOIN s q ON p.key = q.key AND q.i <= p.i GROUP BY 1, 2")
def _biquads(spark, t):
    """Two sections with one pole each, at 1/2 and 1/4."""
    return _streamed(spark, t, filters.biquads([[1, 0, 0, 1, -0.5, 0], [1, 0, 0, 1, -0.25, 0]]))


@query("stream_resample", doubles="y", ints="i", other="key", digits=6, sql=f"WITH {BY_TYPE} SELECT key, 2 * i + e AS i, CASE e WHEN 0 THEN (x + coalesce(lag(x) OVER w, 0)) / 2 ELSE x END AS y FROM s CROSS JOIN (SELECT unnest([0, 1]) AS e) b WINDOW w AS (PARTITION BY key, e ORDER BY i)")
def _resample(spark, t):
    """Twice the rate by linear interpolation, half a sample late."""
    return _streamed(spark, t, filters.resampler(2, 1, [0.5, 1.0, 0.5]))
