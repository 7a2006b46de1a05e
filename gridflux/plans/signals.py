"""Array, signal, wavelet and tabulated-data queries."""

from __future__ import annotations


from pyspark.sql import functions as F

from gridflux.functions import ieee
from gridflux.operators import arrays, signal
from gridflux.plans.base import BY_TYPE, DAILY, HOURLY, by_type, daily, hourly, query


@query("array_cumsum", doubles="total", ints="event_id", digits=4, sql="SELECT event_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total FROM events")
def array_cumsum(spark, t):
    e = t("events").withColumn("i", F.struct("ts", "event_id"))
    return arrays.cumsum(e, "value", "i", ("user_id",), "total")


@query("array_cumsum_global", doubles="total", ints="o_orderkey", digits=2, sql="SELECT o_orderkey, sum(round(o_totalprice)) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS total FROM orders")
def array_cumsum_global(spark, t):
    """One series over all rows: blocks with offsets, no single task."""
    return arrays.cumsum(t("orders").withColumn("x", F.round("o_totalprice")), "x", "o_orderkey", name="total")


@query("array_diff", doubles="d", ints="event_id", digits=6, sql="SELECT event_id, d FROM (SELECT event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events) WHERE d IS NOT NULL")
def array_diff(spark, t):
    return arrays.diff(t("events").withColumn("i", F.struct("ts", "event_id")), "value", "i", ("user_id",), "d")


@query("array_gradient", doubles="t g", digits=6, sql=f"WITH {DAILY} SELECT t, (coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y)) / (coalesce(lead(t) OVER w, t) - coalesce(lag(t) OVER w, t)) AS g FROM d WINDOW w AS (ORDER BY t)")
def array_gradient(spark, t):
    return arrays.gradient(daily(t), "y", "t", "t", name="g")


@query("array_unique_counts", doubles="value", ints="n first_index", sql="SELECT l_discount AS value, count(*) AS n, min(l_orderkey) AS first_index FROM lineitem GROUP BY 1")
def array_unique_counts(spark, t):
    return arrays.unique(t("lineitem"), "l_discount", "l_orderkey")


_A, _B = "SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 45", "SELECT l_partkey AS k FROM lineitem WHERE l_discount > 0.07"


def _sets(t):
    li = t("lineitem")
    return li.where("l_quantity > 45").select(F.col("l_partkey").alias("k")), li.where("l_discount > 0.07").select(F.col("l_partkey").alias("k"))


@query("set_union", ints="k", sql=f"({_A}) UNION ({_B})")
def set_union(spark, t):
    return arrays.union1d(*_sets(t))


@query("set_intersect", ints="k", sql=f"({_A}) INTERSECT ({_B})")
def set_intersect(spark, t):
    return arrays.intersect1d(*_sets(t))


@query("set_diff", ints="k", sql=f"({_A}) EXCEPT ({_B})")
def set_diff(spark, t):
    return arrays.setdiff1d(*_sets(t))


@query("array_in1d", ints="p_partkey", other="is_in", sql=f"SELECT p_partkey, p_partkey IN ({_A}) AS is_in FROM part")
def array_in1d(spark, t):
    return arrays.in1d(t("part"), "p_partkey", _sets(t)[0], "k")


EDGES = [1.0, 5.0, 10.0, 20.0, 50.0, 100.0, 300.0]


@query("array_searchsorted", ints="slot n", sql=f"SELECT len(list_filter({EDGES}, lambda e: e < value)) AS slot, count(*) AS n FROM events GROUP BY 1")
def array_searchsorted(spark, t):
    return arrays.searchsorted(t("events"), "value", EDGES).groupBy("slot").agg(F.count(F.lit(1)).alias("n"))


@query("array_bincount", ints="bin", doubles="n", sql="SELECT bin, coalesce(sum(p_retailprice), 0) AS n FROM (SELECT unnest(range((SELECT max(p_size) + 1 FROM part))) AS bin) r LEFT JOIN part ON p_size = bin GROUP BY 1", digits=3)
def array_bincount(spark, t):
    return arrays.bincount(t("part"), "p_size", "p_retailprice")


@query("array_argmax", ints="pos", doubles="value", other="event_type", sql="SELECT event_type, arg_max(event_id, (value, -event_id)) AS pos, max(value) AS value FROM events GROUP BY 1")
def array_argmax(spark, t):
    return arrays.argmax(t("events"), "value", "event_id", "event_type")


@query("array_argsort", ints="rank pos", other="event_type", sql="SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS rank, event_id AS pos FROM events")
def array_argsort(spark, t):
    return arrays.argsort(t("events"), "value", "event_id", "event_type")


@query("array_interp", doubles="interpolated", ints="event_id", digits=6, sql=f"""
WITH {DAILY}, k AS (SELECT t, y, lead(t) OVER (ORDER BY t) AS t1, lead(y) OVER (ORDER BY t) AS y1 FROM d), q AS (SELECT event_id, value * 5 AS q FROM events)
SELECT event_id, CASE WHEN k.t IS NULL THEN (SELECT arg_min(y, t) FROM d) WHEN t1 IS NULL THEN y ELSE y + (q - k.t) / (t1 - k.t) * (y1 - y) END AS interpolated FROM q ASOF LEFT JOIN k ON q.q >= k.t""")  # fmt: skip
def array_interp(spark, t):
    return arrays.interp(t("events").withColumn("q", F.col("value") * 5), "q", daily(t), "t", "y")


@query("array_ufuncs", ints="event_id", doubles="a b c d e f", digits=6, sql="""
SELECT event_id, ln(value) AS a, sqrt(value) AS b, value - 7 * floor(value / 7) AS c, exp(-value / 100) AS d, atan2(value, 3) AS e,
 CASE WHEN value = 0 THEN 1 ELSE sin(pi() * value) / (pi() * value) END AS f FROM events""")  # fmt: skip
def array_ufuncs(spark, t):
    v = F.col("value")
    return t("events").select("event_id", ieee.unary("log", v).alias("a"), ieee.unary("sqrt", v).alias("b"), ieee.binary("remainder", v, F.lit(7.0)).alias("c"), ieee.unary("exp", -v / 100).alias("d"), ieee.binary("arctan2", v, F.lit(3.0)).alias("e"), ieee.unary("sinc", v).alias("f"))


@query("array_reduce_axis", ints="count_nonzero", doubles="sum mean std ptp", other="key", digits=6, sql=f"WITH {BY_TYPE} SELECT key, sum(x) AS sum, avg(x) AS mean, stddev_pop(x) AS std, max(x) - min(x) AS ptp, count(*) FILTER (x <> 0) AS count_nonzero FROM s GROUP BY 1")
def array_reduce_axis(spark, t):
    rows = by_type(t).withColumnRenamed("x", "v")
    out = None
    for how in ("sum", "mean", "std", "ptp", "count_nonzero"):
        part = arrays.reduce_axis(rows, how, "key")
        out = part if out is None else out.join(part, "key")
    return out


@query("quad_trapezoid_data", doubles="integral", digits=4, sql=f"WITH {DAILY} SELECT sum((y + y0) * (t - t0) / 2) AS integral FROM (SELECT t, y, lag(t) OVER (ORDER BY t) AS t0, lag(y) OVER (ORDER BY t) AS y0 FROM d)")
def quad_trapezoid_data(spark, t):
    return arrays.trapezoid_data(daily(t), "y", "t")


@query("quad_simpson_data", doubles="integral", digits=4, sql=f"""
WITH {DAILY}, p AS (SELECT row_number() OVER (ORDER BY t) - 1 AS n, t, y, lead(t) OVER w AS t1, lead(t, 2) OVER w AS t2, lead(y) OVER w AS y1, lead(y, 2) OVER w AS y2 FROM d WINDOW w AS (ORDER BY t)), h AS (SELECT *, t1 - t AS h0, t2 - t1 AS h1 FROM p WHERE n % 2 = 0)
SELECT sum(CASE WHEN t2 IS NOT NULL THEN (h0 + h1) / 6 * ((2 - h1 / h0) * y + (h0 + h1) * (h0 + h1) / (h0 * h1) * y1 + (2 - h0 / h1) * y2) WHEN t1 IS NOT NULL THEN h0 * (y + y1) / 2 ELSE 0 END) AS integral FROM h""")  # fmt: skip
def quad_simpson_data(spark, t):
    return arrays.simpson_data(daily(t), "y", "t")


@query("quad_cumtrapz", doubles="t cumulative", digits=4, sql=f"WITH {DAILY} SELECT t, sum(a) OVER (ORDER BY t) AS cumulative FROM (SELECT t, coalesce((y + lag(y) OVER (ORDER BY t)) * (t - lag(t) OVER (ORDER BY t)) / 2, 0) AS a FROM d)")
def quad_cumtrapz(spark, t):
    return arrays.cumulative_trapezoid(daily(t), "y", "t")


_DFT = "SELECT k.i AS k, sum(h.x * cos(-2 * pi() * ((k.i * h.i) % n) / n)) AS re, sum(h.x * sin(-2 * pi() * ((k.i * h.i) % n) / n)) AS im FROM h, h k, (SELECT count(*) AS n FROM h) GROUP BY 1"


@query("sig_dft", ints="k", doubles="re im", digits=5, sql=f"WITH {HOURLY} {_DFT}")
def sig_dft(spark, t):
    return signal.dft(hourly(t))


@query("sig_fft_kernel", ints="k", doubles="re im", digits=5, sql=f"WITH {HOURLY} {_DFT}")
def sig_fft_kernel(spark, t):
    from gridflux.operators import batch

    return batch.fft(hourly(t).withColumn("series", F.lit("h")), "series")


@query("sig_goertzel", doubles="re im", other="key", digits=6, sql=f"WITH {BY_TYPE} SELECT key, sum(x * cos(2 * pi() * 3 * i / n)) AS re, -sum(x * sin(2 * pi() * 3 * i / n)) AS im FROM s JOIN (SELECT key, count(*) AS n FROM s GROUP BY 1) USING (key) GROUP BY key")
def sig_goertzel(spark, t):
    return signal.goertzel(by_type(t), 3, "key")


@query("sig_dct", ints="k", doubles="value", other="key", digits=6, sql=f"WITH {BY_TYPE}, n AS (SELECT key, count(*) AS n FROM s GROUP BY 1) SELECT a.key, b.i AS k, sum(2 * a.x * cos(pi() * b.i * (2 * a.i + 1) / (2 * n))) AS value FROM s a JOIN s b ON a.key = b.key JOIN n ON a.key = n.key GROUP BY 1, 2")
def sig_dct(spark, t):
    return signal.dct(by_type(t), "key")


@query("sig_dst", ints="k", doubles="value", other="key", digits=6, sql=f"WITH {BY_TYPE}, n AS (SELECT key, count(*) AS n FROM s GROUP BY 1) SELECT a.key, b.i AS k, sum(2 * a.x * sin(pi() * (b.i + 1) * (a.i + 1) / (n + 1))) AS value FROM s a JOIN s b ON a.key = b.key JOIN n ON a.key = n.key GROUP BY 1, 2")
def sig_dst(spark, t):
    return signal.dst(by_type(t), "key")


@query("sig_hartley", ints="k", doubles="value", other="key", digits=6, sql=f"WITH {BY_TYPE}, n AS (SELECT key, count(*) AS n FROM s GROUP BY 1) SELECT a.key, b.i AS k, sum(a.x * (cos(2 * pi() * b.i * a.i / n) + sin(2 * pi() * b.i * a.i / n))) AS value FROM s a JOIN s b ON a.key = b.key JOIN n ON a.key = n.key GROUP BY 1, 2")
def sig_hartley(spark, t):
    return signal.hartley(by_type(t), "key")


@query("sig_periodogram", ints="k", doubles="freq power", digits=6, sql=f"""
WITH {HOURLY}, n AS (SELECT count(*) AS n, avg(x) AS m FROM h), w AS (SELECT i, 0.5 - 0.5 * cos(2 * pi() * i / (n - 1)) AS w, (x - m) * (0.5 - 0.5 * cos(2 * pi() * i / (n - 1))) AS x FROM h, n),
 f AS (SELECT k.i AS k, sum(w.x * cos(2 * pi() * ((k.i * w.i) % n) / n)) AS re, sum(w.x * sin(2 * pi() * ((k.i * w.i) % n) / n)) AS im FROM w, h k, n WHERE k.i <= n // 2 GROUP BY 1)
SELECT k, k / n::DOUBLE AS freq, (re * re + im * im) / (SELECT sum(w * w) FROM w) * CASE WHEN k = 0 OR (n % 2 = 0 AND k = n // 2) THEN 1 ELSE 2 END AS power FROM f, n""")  # fmt: skip
def sig_periodogram(spark, t):
    return signal.periodogram(hourly(t))


TAPS = [0.2, 0.3, 0.4, 0.1]


@query("sig_fir", ints="i", doubles="y", other="key", digits=6, sql=f"WITH {BY_TYPE} SELECT key, i, 0.2 * x + 0.3 * coalesce(lag(x) OVER w, 0) + 0.4 * coalesce(lag(x, 2) OVER w, 0) + 0.1 * coalesce(lag(x, 3) OVER w, 0) AS y FROM s WINDOW w AS (PARTITION BY key ORDER BY i)")
def sig_fir(spark, t):
    return signal.fir(by_type(t), TAPS, "key")


@query("sig_convolve", ints="i", doubles="y", other="key", digits=6, sql=f"WITH {BY_TYPE}, t AS (SELECT unnest([0, 1, 2, 3]) AS k, unnest([0.2, 0.3, 0.4, 0.1]) AS w) SELECT key, i + k AS i, sum(x * w) AS y FROM s, t GROUP BY 1, 2")
def sig_convolve(spark, t):
    return signal.convolve(by_type(t), TAPS, "key")


@query("sig_autocorr", ints="lag", doubles="value", digits=8, sql=f"""
WITH {HOURLY}, c AS (SELECT i, x - avg(x) OVER () AS c FROM h), k AS (SELECT unnest(range(0, 25)) AS lag)
SELECT lag, sum(a.c * b.c) / (SELECT sum(c * c) FROM c) AS value FROM k, c a, c b WHERE b.i = a.i + lag GROUP BY 1""")  # fmt: skip
def sig_autocorr(spark, t):
    return signal.autocorrelation(hourly(t), 24)


@query("sig_moving_avg", ints="i", doubles="y", digits=6, sql=f"WITH {HOURLY} SELECT i, sum(x) OVER (ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS y FROM h")
def sig_moving_avg(spark, t):
    return signal.moving_average(hourly(t), 5)


@query("diff_savgol", ints="i", doubles="y", other="key", digits=6, sql=f"""
WITH {BY_TYPE}, e AS (SELECT *, first_value(x) OVER p AS f, last_value(x) OVER p AS l FROM s WINDOW p AS (PARTITION BY key ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT key, i, (-3 * coalesce(lag(x, 2) OVER w, f) + 12 * coalesce(lag(x) OVER w, f) + 17 * x + 12 * coalesce(lead(x) OVER w, l) - 3 * coalesce(lead(x, 2) OVER w, l)) / 35 AS y FROM e WINDOW w AS (PARTITION BY key ORDER BY i)""")  # fmt: skip
def diff_savgol(spark, t):
    return signal.savitzky_golay(by_type(t), 5, 2, "key")


@query("sig_window_hann", ints="i", doubles="v", digits=9, sql="SELECT i, 0.5 - 0.5 * cos(2 * pi() * i / 63) AS v FROM range(64) r(i)")
def sig_window_hann(spark, t):
    return arrays.window(spark, "hanning", 64)


@query("sig_window_blackman", ints="i", doubles="v", digits=9, sql="SELECT i, 0.42 - 0.5 * cos(2 * pi() * i / 63) + 0.08 * cos(4 * pi() * i / 63) AS v FROM range(64) r(i)")
def sig_window_blackman(spark, t):
    return arrays.window(spark, "blackman", 64)


_HAAR = f"""WITH {HOURLY}, n_h AS (SELECT count(*) AS n FROM h), g AS MATERIALIZED (SELECT i, x FROM h
 UNION ALL SELECT unnest(range(n, (n + 15) // 16 * 16)), (SELECT arg_max(x, i) FROM h) FROM n_h)"""


def padded(h, multiple: int = 16):
    """The whole signal, its last sample repeated up to a multiple of `multiple`, and that length."""
    n = h.count()
    size = -(-n // multiple) * multiple
    last = h.where(F.col("i") == n - 1).select(F.explode(F.sequence(F.lit(n).cast("bigint"), F.lit(size - 1).cast("bigint"))).alias("i"), "x") if size > n else None
    return (h if last is None else h.unionByName(last)), size


@query("wav_haar_dwt", ints="i", doubles="a d", digits=6, sql=f"{_HAAR} SELECT p.i // 2 AS i, (p.x + q.x) / sqrt(2) AS a, (p.x - q.x) / sqrt(2) AS d FROM g p JOIN g q ON q.i = p.i + 1 WHERE p.i % 2 = 0")
def wav_haar_dwt(spark, t):
    g, n = padded(hourly(t))
    return signal.dwt(g, "haar", n)


@query("wav_roundtrip_db4", ints="i", doubles="x", digits=6, sql=f"{_HAAR} SELECT i, x FROM g")
def wav_roundtrip_db4(spark, t):
    g, n = padded(hourly(t))
    return signal.idwt(signal.dwt(g, "db4", n), "db4", n)


@query("wav_energy", ints="band", doubles="energy", digits=4, sql=_HAAR.replace("WITH", "WITH RECURSIVE", 1) + """, r(level, i, a, d) AS (SELECT 0, i, x, 0.0::DOUBLE FROM g UNION ALL
 SELECT level + 1, i // 2, (x0 + x1) / sqrt(2), (x0 - x1) / sqrt(2) FROM (SELECT level, i, a AS x0, lead(a) OVER (PARTITION BY level ORDER BY i) AS x1 FROM r WHERE level < 4) WHERE i % 2 = 0)
SELECT level AS band, sum(d * d) AS energy FROM r WHERE level > 0 GROUP BY 1 UNION ALL SELECT 0, sum(a * a) FROM r WHERE level = 4""")  # fmt: skip
def wav_energy(spark, t):
    g, n = padded(hourly(t))
    return signal.wavelet_energy(signal.wavedec(g, "haar", n, level=4))


@query("wav_soft_threshold", ints="i", doubles="v", digits=6, sql=f"{_HAAR} SELECT p.i // 2 AS i, sign(p.x - q.x) * greatest(abs((p.x - q.x) / sqrt(2)) - 2, 0) AS v FROM g p JOIN g q ON q.i = p.i + 1 WHERE p.i % 2 = 0")
def wav_soft_threshold(spark, t):
    g, n = padded(hourly(t))
    return signal.dwt(g, "haar", n).select("i", signal.soft_threshold("d", 2.0).alias("v"))


@query("sig_welch", ints="k", doubles="freq power", digits=6, sql=f"""
WITH {HOURLY}, f AS (SELECT frame, h.i - frame * 32 AS i, x FROM h, (SELECT unnest(range(0, 1 + ((SELECT count(*) FROM h) - 64) // 32)) AS frame) WHERE h.i >= frame * 32 AND h.i < frame * 32 + 64),
 w AS (SELECT frame, i, (x - avg(x) OVER (PARTITION BY frame)) * (0.5 - 0.5 * cos(2 * pi() * i / 63)) AS x FROM f),
 s AS (SELECT frame, k, sum(x * cos(2 * pi() * ((k * i) % 64) / 64)) AS re, sum(x * sin(2 * pi() * ((k * i) % 64) / 64)) AS im FROM w, range(33) r(k) GROUP BY 1, 2)
SELECT k, k / 64.0 AS freq, avg((re * re + im * im) * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END) / (SELECT sum(power(0.5 - 0.5 * cos(2 * pi() * j / 63), 2)) FROM range(64) q(j)) AS power FROM s GROUP BY 1""")  # fmt: skip
def sig_welch(spark, t):
    h = hourly(t)
    return signal.welch(h, 64, n=h.count())


