"""Statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridflux.operators import stats
from gridflux.plans.base import query

X4 = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("stats_describe", doubles="mean std variance min q1 median q3 max skewness kurtosis", digits=6, ints="n", other="l_returnflag", sql="""
SELECT l_returnflag, count(*) AS n, avg(x) AS mean, stddev_samp(x) AS std, var_samp(x) AS variance, min(x) AS min, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3, max(x) AS max,
 skewness(x) AS skewness, kurtosis(x) AS kurtosis FROM (SELECT l_returnflag, l_extendedprice / 1000 AS x FROM lineitem) GROUP BY 1""")  # fmt: skip
def stats_describe(spark, t):
    """Prices in thousands."""
    return stats.describe(t("lineitem").select("l_returnflag", (F.col("l_extendedprice") / 1000).alias("x")), "x", "l_returnflag")


@query("stats_welford", doubles="mean variance", digits=5, ints="n", other="o_orderpriority", sql="SELECT o_orderpriority, count(*) AS n, avg(o_totalprice / 1000) AS mean, var_samp(o_totalprice / 1000) AS variance FROM orders GROUP BY 1")
def stats_welford(spark, t):
    return stats.welford_mean_var(t("orders").select("o_orderpriority", (F.col("o_totalprice") / 1000).alias("x")), "x", "o_orderpriority")


def _pairs(f: str) -> str:
    return " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, {f}({a}, {b}) AS v FROM lineitem" for i, a in enumerate(X4) for j, b in enumerate(X4))


@query("stats_cov", doubles="v", digits=4, ints="i j", sql=_pairs("covar_samp"))
def stats_cov(spark, t):
    return stats.covariance_matrix(t("lineitem"), X4)


@query("stats_corr", doubles="v", digits=8, ints="i j", sql=_pairs("corr"))
def stats_corr(spark, t):
    return stats.correlation_matrix(t("lineitem"), X4)


@query("stats_linreg", doubles="c_0 c_1 r2", digits=6, ints="n", other="l_returnflag", sql="SELECT l_returnflag, regr_intercept(l_extendedprice, l_quantity) AS c_0, regr_slope(l_extendedprice, l_quantity) AS c_1, regr_r2(l_extendedprice, l_quantity) AS r2, count(*) AS n FROM lineitem GROUP BY 1")
def stats_linreg(spark, t):
    return stats.linear_regression(t("lineitem"), "l_extendedprice", ["l_quantity"], "l_returnflag")


@query("stats_ridge", doubles="b", digits=6, sql="SELECT sum(l_quantity * l_extendedprice) / (sum(l_quantity * l_quantity) + 10) AS b FROM lineitem")
def stats_ridge(spark, t):
    return stats.linear_regression(t("lineitem"), "l_extendedprice", ["l_quantity"], intercept=False, ridge=10.0).select(F.col("c_0").alias("b"))


@query("poly_fit2", doubles="p_0 p_1 p_2", digits=4, sql="""
WITH m AS (SELECT avg(l_quantity) AS mid, stddev_pop(l_quantity) AS dev FROM lineitem),
 s AS (SELECT count(*)::DOUBLE AS s0, sum(u) AS s1, sum(u*u) AS s2, sum(u*u*u) AS s3, sum(u*u*u*u) AS s4, sum(y) AS y0, sum(u*y) AS y1, sum(u*u*y) AS y2 FROM (SELECT (l_quantity - mid) / dev AS u, l_extendedprice AS y FROM lineitem, m)),
 d AS (SELECT *, s0*(s2*s4-s3*s3) - s1*(s1*s4-s2*s3) + s2*(s1*s3-s2*s2) AS det FROM s),
 c AS (SELECT (y0*(s2*s4-s3*s3) - s1*(y1*s4-s3*y2) + s2*(y1*s3-s2*y2))/det AS a0, (s0*(y1*s4-y2*s3) - y0*(s1*s4-s2*s3) + s2*(s1*y2-y1*s2))/det AS a1, (s0*(s2*y2-s3*y1) - s1*(s1*y2-y1*s2) + y0*(s1*s3-s2*s2))/det AS a2 FROM d)
SELECT a2/(dev*dev) AS p_0, a1/dev - 2*a2*mid/(dev*dev) AS p_1, a0 - a1*mid/dev + a2*mid*mid/(dev*dev) AS p_2 FROM c, m""")  # fmt: skip
def poly_fit2(spark, t):
    return stats.polyfit(t("lineitem"), "l_quantity", "l_extendedprice", 2)


@query("fit_power", doubles="a b", digits=6, sql="SELECT exp(regr_intercept(ln(l_extendedprice), ln(l_quantity))) AS a, regr_slope(ln(l_extendedprice), ln(l_quantity)) AS b FROM lineitem")
def fit_power(spark, t):
    return stats.transformed_fit(t("lineitem"), "l_quantity", "l_extendedprice", "power")


@query("fit_exponential", doubles="a b", digits=6, sql="SELECT exp(regr_intercept(ln(l_extendedprice), l_quantity)) AS a, regr_slope(ln(l_extendedprice), l_quantity) AS b FROM lineitem")
def fit_exponential(spark, t):
    return stats.transformed_fit(t("lineitem"), "l_quantity", "l_extendedprice", "exponential")


@query("fit_logarithmic", doubles="a b", digits=5, sql="SELECT regr_intercept(l_extendedprice, ln(l_quantity)) AS a, regr_slope(l_extendedprice, ln(l_quantity)) AS b FROM lineitem")
def fit_logarithmic(spark, t):
    return stats.transformed_fit(t("lineitem"), "l_quantity", "l_extendedprice", "logarithmic")


@query("stats_ttest_welch", doubles="statistic dof", digits=6, sql="""
WITH s AS (SELECT avg(value) FILTER (event_type = 'click') AS ma, var_samp(value) FILTER (event_type = 'click') AS va, count(*) FILTER (event_type = 'click') AS na, avg(value) FILTER (event_type = 'purchase') AS mb, var_samp(value) FILTER (event_type = 'purchase') AS vb, count(*) FILTER (event_type = 'purchase') AS nb FROM events)
SELECT (ma - mb) / sqrt(va/na + vb/nb) AS statistic, (va/na + vb/nb)*(va/na + vb/nb) / (va*va/(na*na*(na-1)) + vb*vb/(nb*nb*(nb-1))) AS dof FROM s""")  # fmt: skip
def stats_ttest_welch(spark, t):
    return stats.t_test(t("events"), "value", "event_type", "click", "purchase")


@query("stats_ttest_pooled", doubles="statistic dof", digits=6, sql="""
WITH s AS (SELECT avg(value) FILTER (event_type = 'click') AS ma, var_samp(value) FILTER (event_type = 'click') AS va, count(*) FILTER (event_type = 'click') AS na, avg(value) FILTER (event_type = 'purchase') AS mb, var_samp(value) FILTER (event_type = 'purchase') AS vb, count(*) FILTER (event_type = 'purchase') AS nb FROM events)
SELECT (ma - mb) / sqrt(((na-1)*va + (nb-1)*vb) / (na+nb-2) * (1.0/na + 1.0/nb)) AS statistic, na + nb - 2 AS dof FROM s""")  # fmt: skip
def stats_ttest_pooled(spark, t):
    return stats.t_test(t("events"), "value", "event_type", "click", "purchase", equal_var=True)


@query("stats_ttest_one", doubles="statistic dof", digits=6, other="event_type", sql="SELECT event_type, (avg(value) - 50) / (stddev_samp(value) / sqrt(count(*))) AS statistic, count(*) - 1 AS dof FROM events GROUP BY 1")
def stats_ttest_one(spark, t):
    return stats.t_test_one(t("events"), "value", 50.0, "event_type")


@query("stats_anova", doubles="statistic", ints="dof_between dof_within", digits=6, sql="""
WITH g AS (SELECT event_type, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM events GROUP BY 1), s AS (SELECT sum(n) AS n, count(*) AS k, sum(n*m)/sum(n) AS grand, sum(n*v) AS within FROM g)
SELECT (SELECT sum(g.n * (g.m - s.grand) * (g.m - s.grand)) FROM g, s) / (k - 1) / (within / (n - k)) AS statistic, k - 1 AS dof_between, n - k AS dof_within FROM s""")  # fmt: skip
def stats_anova(spark, t):
    return stats.anova_one_way(t("events"), "value", "event_type")


@query("stats_chi2", doubles="statistic", ints="dof", digits=6, sql="WITH o AS (SELECT count(*)::DOUBLE AS o FROM events GROUP BY event_type), e AS (SELECT avg(o) AS e, count(*) AS k FROM o) SELECT sum((o-e)*(o-e)/e) AS statistic, max(k) - 1 AS dof FROM o, e")
def stats_chi2(spark, t):
    return stats.chi_square_test(t("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("o")), "o")


@query("stats_ks2", doubles="statistic", digits=9, sql="""
WITH v AS (SELECT value AS x, count(*) FILTER (event_type = 'click') AS na, count(*) FILTER (event_type = 'purchase') AS nb FROM events WHERE event_type IN ('click', 'purchase') GROUP BY 1),
 c AS (SELECT sum(na) OVER (ORDER BY x) AS ca, sum(nb) OVER (ORDER BY x) AS cb, sum(na) OVER () AS ta, sum(nb) OVER () AS tb FROM v)
SELECT max(abs(ca::DOUBLE/ta - cb::DOUBLE/tb)) AS statistic FROM c""")  # fmt: skip
def stats_ks2(spark, t):
    return stats.ks_two_sample(t("events"), "value", "event_type", "click", "purchase")


@query("stats_ks_exponential", doubles="statistic", digits=9, sql="""
WITH m AS (SELECT avg(value) AS m FROM events), v AS (SELECT value AS x, count(*) AS k FROM events GROUP BY 1), c AS (SELECT x, k, sum(k) OVER (ORDER BY x) AS c, sum(k) OVER () AS n FROM v)
SELECT max(greatest(c::DOUBLE/n - (1 - exp(-x/50)), (1 - exp(-x/50)) - (c - k)::DOUBLE/n)) AS statistic FROM c""")  # fmt: skip
def stats_ks_exponential(spark, t):
    return stats.ks_one_sample(t("events"), "value", lambda x: 1 - F.exp(-x / 50))


HIST = """
WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
 b AS (SELECT CASE WHEN o_totalprice = hi THEN {n} - 1 ELSE least(floor((o_totalprice - lo) / (hi - lo) * {n}), {n} - 1) END AS bin, lo, hi FROM orders, e),
 c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin),
 g AS (SELECT r.bin, lo + r.bin * ((hi - lo) / {n}) AS lo, lo + (r.bin + 1) * ((hi - lo) / {n}) AS hi, coalesce(c.n, 0) AS n FROM e, range({n}) r(bin) LEFT JOIN c ON c.bin = r.bin)
"""


@query("stats_hist", doubles="lo hi", ints="bin n", digits=4, sql=HIST.format(n=20) + "SELECT * FROM g")
def stats_hist(spark, t):
    return stats.histogram(t("orders"), "o_totalprice", 20)


@query("stats_hist_density", doubles="density", ints="bin", digits=12, sql=HIST.format(n=30) + "SELECT bin, n / ((SELECT sum(n) FROM g) * (hi - lo)) AS density FROM g")
def stats_hist_density(spark, t):
    return stats.histogram_density(t("orders"), "o_totalprice", 30)


@query("stats_mode_est", doubles="mode", digits=4, sql=HIST.format(n=50) + "SELECT (lo + hi) / 2 AS mode FROM g ORDER BY n DESC, bin LIMIT 1")
def stats_mode_est(spark, t):
    return stats.mode_estimate(t("orders"), "o_totalprice", 50)


POINTS = [10.0, 50.0, 100.0, 200.0, 400.0]


@query("stats_kde", doubles="point density", digits=9, sql=f"SELECT p.point, avg(exp(-(p.point - value)*(p.point - value)/(2*25.0)) / sqrt(2*pi())) / 5.0 AS density FROM events, (SELECT unnest({POINTS}) AS point) p GROUP BY 1")
def stats_kde(spark, t):
    return stats.kernel_density(t("events"), "value", POINTS, 5.0)


@query("stats_kde_epanechnikov", doubles="point density", digits=9, sql=f"SELECT p.point, avg(CASE WHEN abs((p.point - value)/8.0) <= 1 THEN 0.75*(1 - (p.point - value)*(p.point - value)/64.0) ELSE 0 END) / 8.0 AS density FROM events, (SELECT unnest({POINTS}) AS point) p GROUP BY 1")
def stats_kde_epanechnikov(spark, t):
    return stats.kernel_density(t("events"), "value", POINTS, 8.0, "epanechnikov")


@query("stats_jackknife", doubles="estimate bias std_error", digits=6, sql="SELECT avg(s_acctbal) AS estimate, 0.0 AS bias, sqrt(var_pop(s_acctbal) / (count(*) - 1)) AS std_error FROM supplier")
def stats_jackknife(spark, t):
    return stats.jackknife_mean(t("supplier"), "s_acctbal")


@query("stats_confidence", doubles="mean lower upper", digits=5, other="c_mktsegment", sql="SELECT c_mktsegment, avg(c_acctbal) AS mean, avg(c_acctbal) - 1.959963984540054*stddev_samp(c_acctbal)/sqrt(count(*)) AS lower, avg(c_acctbal) + 1.959963984540054*stddev_samp(c_acctbal)/sqrt(count(*)) AS upper FROM customer GROUP BY 1")
def stats_confidence(spark, t):
    return stats.confidence_interval(t("customer"), "c_acctbal", 1.959963984540054, "c_mktsegment")


@query("stats_quantiles", doubles="q10 q50 q90", digits=5, other="event_type", sql="SELECT event_type, quantile_cont(value, 0.1) AS q10, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.9) AS q90 FROM events GROUP BY 1")
def stats_quantiles(spark, t):
    return t("events").groupBy("event_type").agg(*(stats.quantile("value", q / 100).alias(f"q{q}") for q in (10, 50, 90)))


@query("stats_bootstrap", doubles="mean", ints="resample")
def stats_bootstrap(spark, t):
    return stats.bootstrap(t("events"), "value", "event_id", 20)


@query("stats_permutation", doubles="observed p_value")
def stats_permutation(spark, t):
    return stats.permutation_test(t("events"), "value", "event_type", "click", "purchase", "event_id", 20)


@query("stats_logistic", doubles="value", digits=4, ints="term")
def stats_logistic(spark, t):
    rows = t("labels").join(t("documents").select("doc_id", (F.col("n_chars") / 1000.0).alias("x")), "doc_id").select("x", F.col("quality").alias("y"))
    beta, _, _ = stats.logistic_regression(rows, "y", ["x"])
    return spark.createDataFrame(list(enumerate(beta)), "term int, value double")


@query("stats_embedding_cov", doubles="v", digits=6, ints="i j", sql="""
WITH e AS (SELECT embedding::DOUBLE[] AS x FROM embeddings), k AS (SELECT a.r AS i, b.r AS j FROM range(64) a(r), range(64) b(r) WHERE a.r <= b.r)
SELECT i, j, covar_samp(x[i + 1], x[j + 1]) AS v FROM e, k GROUP BY 1, 2""")  # fmt: skip
def stats_embedding_cov(spark, t):
    return stats.vector_moments(t("embeddings"), "embedding", 64)


@query("mcmc_rhat_classic", doubles="rhat", digits=6, sql="""
WITH v AS (SELECT user_id % 4 AS chain, row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) AS draw, value FROM events), n AS (SELECT min(c) AS n FROM (SELECT count(*) AS c FROM v GROUP BY chain)),
 c AS (SELECT chain, avg(value) AS m, var_samp(value) AS s, max(n) AS n FROM v, n WHERE draw <= n GROUP BY chain)
SELECT sqrt(((max(n) - 1.0) / max(n) * avg(s) + var_samp(m)) / avg(s)) AS rhat FROM c""")  # fmt: skip
def mcmc_rhat_classic(spark, t):
    from gridflux.operators import mcmc

    return mcmc.gelman_rubin(mcmc.as_chains(t("events"), F.col("user_id") % 4, ["ts", "event_id"], "value"))
