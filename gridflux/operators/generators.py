"""Random generators whose n-th number is an expression of n, so that any partition can make its own part, and sampling from them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridflux.operators.stats import uniform_hash


def lcg(n: Column, seed: int = 1, a: int = 1103515245, c: int = 12345, m: int = 2**31, bits: int = 40) -> Column:
    """State after n steps of x <- (a x + c) mod m, for n below 2 ** bits and m up to 2 ** 31: steps of sizes 1, 2, 4... are composed by the bits of n."""
    if m > 2**31:
        raise ValueError("products of states must fit in 64 bits: m is at most 2 ** 31")
    n, x = n.cast("bigint"), F.lit(seed % m).cast("bigint")
    a, c = a % m, c % m
    for j in range(bits):
        bit = F.shiftright(n, j).bitwiseAND(F.lit(1).cast("bigint"))
        # a step of size zero has factor 1 and no addend; plain arithmetic keeps the tree a chain
        x = F.pmod(x * (1 + bit * (a - 1)) + bit * c, F.lit(m).cast("bigint"))
        a, c = a * a % m, (a * c + c) % m
    return x


def park_miller(n: Column, seed: int = 1, bits: int = 40) -> Column:
    return lcg(n, seed or 1, 16807, 0, 2**31 - 1, bits)


def _streams(streams: DataFrame, stream: str, seed: str, n: int, make: Callable[[int], np.ndarray]) -> DataFrame:
    """(stream, k, u): n numbers of each stream's own generator, a stream at a time."""
    kind = dict(streams.dtypes)[stream]

    def run(batches):
        for pdf in batches:
            for s, x in zip(pdf[stream], pdf[seed]):
                yield pd.DataFrame({stream: [s] * n, "k": np.arange(n), "u": make(int(x))})

    return streams.select(*dict.fromkeys([stream, seed])).mapInPandas(run, f"`{stream}` {kind}, k bigint, u double")


def xorshift(streams: DataFrame, stream: str, seed: str, n: int) -> DataFrame:
    """64-bit xorshift with the shifts 13, 7 and 17; a seed of zero stands for 88172645463325252."""

    def make(x: int) -> np.ndarray:
        word, out = 2**64 - 1, np.empty(n)
        x = x & word or 88172645463325252
        for k in range(n):
            x ^= x << 13 & word
            x ^= x >> 7
            x ^= x << 17 & word
            out[k] = x / 2**64
        return out

    return _streams(streams, stream, seed, n, make)


def mersenne_twister(streams: DataFrame, stream: str, seed: str, n: int) -> DataFrame:
    """32-bit outputs of MT19937 over 2 ** 32, by numpy's generator with its integer seeding."""
    return _streams(streams, stream, seed, n, lambda x: np.random.RandomState(x)._bit_generator.random_raw(n) / 2.0**32)


def middle_square(streams: DataFrame, stream: str, seed: str, n: int, digits: int = 4) -> DataFrame:
    """Middle digits of squares; it soon falls into short cycles and serves to show that."""
    step = lambda s: F.pmod(F.floor(s * s / F.lit(10 ** (digits // 2))), F.lit(10**digits)).cast("double")
    states = F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.array(F.col(seed).cast("double")), lambda acc, k: F.concat(acc, F.array(step(F.element_at(acc, -1)))))
    return streams.select(stream, F.posexplode(F.slice(states, 2, n)).alias("k", "x")).select(stream, "k", (F.col("x") / 10**digits).alias("u"))


def latin_hypercube(spark: SparkSession, n: int, dim: int = 1, seed: int = 0) -> DataFrame:
    """(id, x0, x1, ...): one point per stratum in every dimension. Strata are dealt by a keyed bijection of 0..n-1 (a Feistel network walked until it falls inside), so nothing is sorted."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = F.lit((1 << half) - 1).cast("bigint")

    def turn(x: Column, key: int) -> Column:
        hi, lo = F.shiftright(x, half), x.bitwiseAND(mask)
        for r in range(4):
            hi, lo = lo, hi.bitwiseXOR(F.xxhash64(F.lit(seed), F.lit(key), F.lit(r), lo).bitwiseAND(mask))
        return F.shiftleft(hi, half).bitwiseOR(lo)

    def deal(x: Column, key: int) -> Column:
        # up to four numbers of the network's range stand for one of 0..n-1; a walk of 192 fails to with chance below 1e-23
        return F.aggregate(F.sequence(F.lit(0), F.lit(191)), F.struct(x.alias("x"), F.lit(False).alias("in")), lambda s, _: F.when(s["in"], s).otherwise(F.struct(turn(s["x"], key).alias("x"), (turn(s["x"], key) < n).alias("in"))))["x"]

    return spark.range(n).select("id", *(((deal(F.col("id"), k) + uniform_hash(F.lit(seed), F.lit(k + 1000), F.col("id"))) / n).alias(f"x{k}") for k in range(dim)))


def alias_table(weights: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """(threshold, other) per outcome: each cell holds its own outcome below the threshold and one other above."""
    p = np.asarray(weights, float)
    p = p / p.sum() * len(p)
    keep, other = np.ones(len(p)), np.arange(len(p))
    low, high = [i for i in range(len(p)) if p[i] < 1], [i for i in range(len(p)) if p[i] >= 1]
    while low and high:
        i, j = low.pop(), high[-1]
        keep[i], other[i] = p[i], j
        p[j] -= 1 - p[i]
        if p[j] < 1:
            low.append(high.pop())
    return keep, other


def sample_discrete(ids: DataFrame, ident: str, weights: list[float], seed: int = 0) -> DataFrame:
    """ids with an outcome drawn by the alias table, whose size is that of the weights."""
    keep, other = (F.array(*map(F.lit, x.tolist())) for x in alias_table(weights))
    u = uniform_hash(F.lit(seed), F.col(ident)) * len(weights)
    cell = F.least(F.floor(u).cast("int"), F.lit(len(weights) - 1))
    return ids.withColumn("__c", cell).withColumn("outcome", F.when(u - F.col("__c") < F.get(keep, F.col("__c")), F.col("__c")).otherwise(F.get(other, F.col("__c")).cast("int"))).drop("__c")
