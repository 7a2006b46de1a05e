"""Chain diagnostics over (chain, draw, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_chains(df: DataFrame, chain: Column, order: list[str], value: str) -> DataFrame:
    """Rows of each chain numbered in order and cut to the shortest chain's length."""
    rows = df.select(chain.alias("chain"), *order, F.col(value).alias("value"))
    rows = rows.withColumn("draw", F.row_number().over(Window.partitionBy("chain").orderBy(*order)) - 1)
    n = rows.groupBy("chain").count().agg(F.min("count").alias("n"))
    return rows.crossJoin(F.broadcast(n)).where("draw < n").select("chain", "draw", "value")


def gelman_rubin(chains: DataFrame, *params: str) -> DataFrame:
    """Classic potential scale reduction."""
    c = chains.groupBy(*params, "chain").agg(F.avg("value").alias("m"), F.var_samp("value").alias("s"), F.count(F.lit(1)).alias("n"))
    n = F.max("n")
    return c.groupBy(*params).agg(F.sqrt(((n - 1) / n * F.avg("s") + F.var_samp("m")) / F.avg("s")).alias("rhat"))


def split(chains: DataFrame, *params: str) -> DataFrame:
    """Each chain's first and last halves as chains of their own; a middle draw of an odd length is left out."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*params, "chain"))
    rows = chains.withColumn("__n", n).withColumn("__h", F.floor(F.col("__n") / 2))
    late = F.col("draw") >= F.col("__n") - F.col("__h")
    rows = rows.where((F.col("draw") < F.col("__h")) | late)
    return rows.select(*params, (F.col("chain") * 2 + late.cast("int")).alias("chain"), F.when(late, F.col("draw") - (F.col("__n") - F.col("__h"))).otherwise(F.col("draw")).alias("draw"), "value")


def rank_normalised(chains: DataFrame, *params: str) -> DataFrame:
    """Scores (rank - 3/8) / (N + 1/4), ties averaged; ranks come from counts of distinct values in order."""
    from gridflux.operators.stats import running_sums

    ties = chains.groupBy(*params, "value").agg(F.count(F.lit(1)).alias("k"))
    run = running_sums(ties, ["value"], {"c": "k"}, *params).withColumn("rank", F.col("c") - (F.col("k") - 1) / 2.0).select(*params, "value", "rank")
    total = ties.groupBy(*params).agg(F.sum("k").alias("__total"))
    both = chains.join(run, [*params, "value"])
    both = both.join(total, list(params)) if params else both.crossJoin(F.broadcast(total))
    return both.withColumn("value", _normal_quantile((F.col("rank") - 0.375) / (F.col("__total") + 0.25))).drop("rank", "__total")


def _normal_quantile(p: Column) -> Column:
    """Vectorised on Arrow batches: Python's normal distribution is exact, and the batch holds distinct ranks."""
    import pandas as pd

    @F.pandas_udf("double")
    def quantile(v: pd.Series) -> pd.Series:
        from statistics import NormalDist

        inv = NormalDist().inv_cdf
        return v.map(inv)

    return quantile(p)


def split_rhat(chains: DataFrame, *params: str) -> DataFrame:
    """The larger of the rank-normalised and the folded rank-normalised reduction over split chains."""
    halves = split(chains, *params)
    mid = halves.groupBy(*params).agg(F.percentile("value", F.lit(0.5)).alias("__mid"))
    folded = (halves.join(mid, list(params)) if params else halves.crossJoin(F.broadcast(mid))).withColumn("value", F.abs(F.col("value") - F.col("__mid"))).drop("__mid")
    a = gelman_rubin(rank_normalised(halves, *params), *params).withColumnRenamed("rhat", "a")
    b = gelman_rubin(rank_normalised(folded, *params), *params).withColumnRenamed("rhat", "b")
    both = a.join(b, list(params)) if params else a.crossJoin(b)
    return both.select(*params, F.greatest("a", "b").alias("rhat"))


def acceptance_rate(chains: DataFrame, *params: str) -> DataFrame:
    """Share of draws that differ from the one before."""
    w = Window.partitionBy(*params, "chain").orderBy("draw")
    moved = (F.col("value") != F.lag("value").over(w)).cast("double")
    return chains.withColumn("__m", moved).groupBy(*params).agg(F.avg("__m").alias("rate"))
