"""Quality rules: robust multivariate outliers per language and source.

Each text gives counts, and these a transformed vector (log mean word length; square roots of symbols per word, of the
share of repeated lines and of the share of words in repeated windows). For every language and source, every language and
all rows a minimum-covariance-determinant estimate is found from two deterministic starts (medians with scaled absolute
deviations; mean with covariance) by concentration steps, until no determinant moves by a hundredth or `most_steps` are done: the share `kept_share` of rows with the
smallest Mahalanobis distances gives the next mean and covariance. The start with the smaller determinant counts, and one
reweighting follows. A group of n rows is judged by its estimate drawn to its language's by n / (n + prior), and that to the
one of all rows, at every size alike; rows whose distance exceeds the chi-square quantile 1 - `tail` are rejected. A floor is
added to each variance, for statistics that are zero in most texts have none.

Only DataFrame functions are used. Rows are never gathered by group: groups are summed and sketched, and what is joined back is
one row per group. Edge cases: a null text has no words and fails the base rules; null languages and
sources form groups of their own; repeated rows count as often as they stand; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridflux.llm.common import forget, only, stored, table

BLANK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = r"[^#*$%&|<>]+"
FLOORS = (0.05, 0.10, 0.15, 0.15)
DIMS = len(FLOORS)


def counts(docs: DataFrame, few: int = 32) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words in place of text."""
    text = F.coalesce("text", F.lit(""))
    core = F.btrim(text, F.lit(BLANKS))
    rows = docs.withColumn("w", F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, BLANK)))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    rows = rows.withColumn("l", lines).withColumn("n", F.size("w"))
    windows = F.slice(F.transform("w", lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2))), F.lit(1), F.greatest(F.col("n") - 2, F.lit(0)))
    rows = rows.withColumn("h", windows)
    twice = F.size(F.array_distinct("h")) < F.size("h")
    rows = rows.withColumn("s", F.when(twice, F.sort_array("h")))
    rows = rows.withColumn("d", F.array_distinct(F.filter("s", lambda x, i: x == F.get("s", i - 1))))
    # the places of windows that occur again: looked up where few differ, else found by sorting (window, place)
    looked = F.filter(F.transform("h", lambda x, i: F.when(F.array_contains("d", x), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("p", F.when(F.size("d") > few, F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    paired = F.sort_array(F.transform(F.filter("p", lambda x, i: (x["x"] == F.get("p", i - 1)["x"]) | (x["x"] == F.get("p", i + 1)["x"])), lambda x: x["i"]))
    places = F.when(F.col("d").isNull(), F.array().cast("array<int>")).when(F.size("d") > few, paired).otherwise(looked)
    covered = F.aggregate(places, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("sum")), lambda a, i: F.struct(i.alias("last"), (a["sum"] + F.least(F.lit(3), i - a["last"])).alias("sum")), lambda a: a["sum"])
    return rows.select(
        *(c for c in docs.columns if c != "text"),
        F.col("n").cast("bigint").alias("n_words"),
        F.char_length(F.regexp_replace(text, BLANK, "")).cast("bigint").alias("word_chars"),
        F.char_length(F.regexp_replace(text, SYMBOLS, "")).cast("bigint").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("bigint").alias("n_dup_lines"),
        covered.cast("bigint").alias("n_repeat_words"),
        F.size("l").cast("bigint").alias("n_lines"),
    )


def vector() -> list[Column]:
    n = F.col("n_words").cast("double")
    return [F.log(F.col("word_chars") / n), F.sqrt(F.col("n_symbols") / n), F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))), F.sqrt(F.col("n_repeat_words") / n)]


def chi2_cdf(x: float, dof: int) -> float:
    """Of an even number of degrees of freedom, as a Poisson tail."""
    half, term, total = x / 2, 1.0, 0.0
    for k in range(dof // 2):
        total += term
        term *= half / (k + 1)
    return 1 - math.exp(-half) * total


def chi2_quantile(p: float, dof: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, dof) < p else (lo, mid)
    return (lo + hi) / 2


PAIRS = [(i, j) for i in range(DIMS) for j in range(i + 1)]
SHAPE = [*(f"m{i}" for i in range(DIMS)), *(f"c{i}_{j}" for i, j in PAIRS)]


def few_keys(rows: DataFrame, most: int = 100_000) -> bool:
    """Whether rows have at most `most` different k, so that one row a k may be broadcast; counted, once per run."""
    return rows.select("k").distinct().limit(most + 1).count() <= most


def _joined(rows: DataFrame, groups: DataFrame, few: bool, salts: int = 32) -> DataFrame:
    """rows with what groups hold of their k. Groups are broadcast if they are few; else rows of one k are dealt over `salts` tasks."""
    if few:
        return rows.join(F.broadcast(groups), "k")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*(f"v{i}" for i in range(DIMS))), F.lit(salts)).cast("int"))
    return salted.join(groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["k", "salt"]).drop("salt")


def _distance(rows: DataFrame, groups: DataFrame, few: bool) -> DataFrame:
    """d2 by forward substitution against the Cholesky factor in groups (k, m*, c*_*)."""
    out = _joined(rows, groups.select("k", *SHAPE), few)
    for i in range(DIMS):
        rest = F.col(f"v{i}") - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"c{i}_{j}") * F.col(f"y{j}")
        out = out.withColumn(f"y{i}", rest / F.col(f"c{i}_{i}"))
    d2 = sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, DIMS)), F.col("y0") * F.col("y0"))
    return out.select(*rows.columns, d2.alias("d2"))


def _moments(rows: DataFrame, scale: float) -> DataFrame:
    """Count, mean and scale * covariance + floors, per k."""
    got = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), *(F.avg(f"v{i}").alias(f"m{i}") for i in range(DIMS)), *(F.covar_pop(f"v{i}", f"v{j}").alias(f"a{i}_{j}") for i, j in PAIRS))
    return got.select("k", "n", *(f"m{i}" for i in range(DIMS)), *((F.col(f"a{i}_{j}") * scale + (FLOORS[i] ** 2 if i == j else 0.0)).alias(f"a{i}_{j}") for i, j in PAIRS))


def _factored(moments: DataFrame) -> DataFrame:
    """The Cholesky factor of the covariance a*_*, and the logarithm of its determinant."""
    for i, j in PAIRS:
        rest = F.col(f"a{i}_{j}")
        for q in range(j):
            rest = rest - F.col(f"c{i}_{q}") * F.col(f"c{j}_{q}")
        # a diagonal term is at least its floor but for rounding
        moments = moments.withColumn(f"c{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-6))) if i == j else rest / F.col(f"c{j}_{j}"))
    return moments.withColumn("logdet", sum((2 * F.log(f"c{i}_{i}") for i in range(DIMS)), F.lit(0.0)))


def _nearest(rows: DataFrame, share: float, few: bool) -> DataFrame:
    """The share of each group's rows with the smallest d2, up to the quantile that sketches of accuracy 1e-4 give."""
    edge = rows.groupBy("k").agg(F.percentile_approx("d2", share).alias("edge"))
    return _joined(rows, edge, few).where("d2 <= edge").drop("edge")


def levels(lang: Column, source: Column) -> Column:
    """The keys of the estimates a row counts in: its language and source, its language, all."""
    lang, source = F.coalesce(lang, F.lit("\x01")), F.coalesce(source, F.lit("\x01"))
    return F.array(F.concat(F.lit("2"), lang, F.lit("\x00"), source), F.concat(F.lit("1"), lang), F.lit("0"))


def mcd(rows: DataFrame, kept_share: float, most_steps: int) -> DataFrame:
    """Count, mean and covariance of every k of rows (k, v*): the start that ends at the smaller determinant, reweighted."""
    own, few = [f"v{i}" for i in range(DIMS)], few_keys(rows)
    mids = stored(rows.groupBy("k").agg(*(F.percentile_approx(v, 0.5).alias(f"m{i}") for i, v in enumerate(own))), "medians")
    off = _joined(rows, mids, few).groupBy("k").agg(*(F.percentile_approx(F.abs(F.col(v) - F.col(f"m{i}")), 0.5).alias(f"s{i}") for i, v in enumerate(own)))
    spread = [((F.col(f"s{i}") * 1.4826) ** 2 + FLOORS[i] ** 2 if i == j else F.lit(0.0)).alias(f"a{i}_{j}") for i, j in PAIRS]
    robust = mids.join(off, "k").select("k", F.lit(0).cast("bigint").alias("n"), *(f"m{i}" for i in range(DIMS)), *spread)
    starts = robust.withColumn("k", F.concat(F.lit("a"), "k")).union(_moments(rows, 1.0).withColumn("k", F.concat(F.lit("b"), "k")))
    both = stored(rows.select(F.explode(F.array(F.concat(F.lit("a"), "k"), F.concat(F.lit("b"), "k"))).alias("k"), *own), "both")
    shrunk = kept_share / chi2_cdf(chi2_quantile(kept_share, DIMS), DIMS + 2)
    groups = stored(_factored(starts), "mcd")
    for _ in range(most_steps):
        old, groups = groups, stored(_factored(_moments(_nearest(_distance(both, groups, few), kept_share, few), shrunk)), "mcd")
        moved = groups.select("k", "logdet").join(old.select("k", F.col("logdet").alias("was")), "k").where(F.abs(F.col("logdet") - F.col("was")) > 1e-2)
        settled = moved.isEmpty()
        forget(old)
        if settled:
            break
    best = groups.withColumn("key", F.substring("k", 2, 1 << 30)).groupBy("key").agg(F.min_by(F.struct(*SHAPE), F.struct("logdet", "k")).alias("b"))
    best = stored(best.select(F.col("key").alias("k"), "b.*"), "best")
    inner = chi2_quantile(0.975, DIMS)
    done = stored(_moments(_distance(rows, best, few).where(F.col("d2") <= inner), 0.975 / chi2_cdf(inner, DIMS + 2)), "reweighted")
    forget(both, groups, mids)
    return done


def shrunk_to_parents(found: DataFrame, keys: DataFrame, prior: float) -> DataFrame:
    """Per key of a language and source the factor of its estimate, drawn to the language's and that to the one of all rows, by n / (n + prior)."""
    cols = [*(f"m{i}" for i in range(DIMS)), *(f"a{i}_{j}" for i, j in PAIRS)]
    got = keys
    for depth in range(3):  # keys are as many as there are groups, and each finds one row
        part = found.where(F.substring("k", 1, 1) == str(2 - depth)).select(F.col("k").alias("at"), F.col("n").alias(f"n_{depth}"), *(F.col(c).alias(f"{c}_{depth}") for c in cols))
        got = got.join(part, got["keys"][depth] == part["at"], "left").drop("at")
    mix = []
    for c in cols:
        value = F.col(f"{c}_2")
        for depth in (1, 0):
            w = F.coalesce(F.col(f"n_{depth}"), F.lit(0)) / (F.coalesce(F.col(f"n_{depth}"), F.lit(0)) + prior)
            value = w * F.coalesce(F.col(f"{c}_{depth}"), F.lit(0.0)) + (1 - w) * value
        mix.append(value.alias(c))
    return stored(_factored(got.select(F.col("keys")[0].alias("k"), *mix)), "shrunk")


def judged(docs: DataFrame, least_words: int = 50, kept_share: float = 0.75, most_steps: int = 6, prior: float = 50.0, tail: float = 1e-6) -> DataFrame:
    """docs' columns but text, the counts, base_failed, d2 (null where base_failed) and kept."""
    seen = counts(docs).withColumn("base_failed", (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    seen = stored(seen, "counts")
    names = seen.columns
    good = seen.where(~F.col("base_failed")).select(*names, levels(F.col("lang"), F.col("source")).alias("keys"), *(v.alias(f"v{i}") for i, v in enumerate(vector())))
    fit = good.select(F.explode("keys").alias("k"), *(f"v{i}" for i in range(DIMS)))
    groups = shrunk_to_parents(mcd(fit, kept_share, most_steps), good.select("keys").distinct(), prior)
    rows = good.withColumn("k", F.col("keys")[0])
    far = _distance(rows, groups, few_keys(groups)).select(*names, "d2")
    failed = seen.where("base_failed").select(*names, F.lit(None).cast("double").alias("d2"))
    cut = chi2_quantile(1 - tail, DIMS)
    return far.union(failed).withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("d2") <= cut, F.lit(True)))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = judged(only(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", "source"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
