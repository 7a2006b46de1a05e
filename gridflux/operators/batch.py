"""Batch runner: sequential kernels, one problem per row or group, in parallel across problems.

A problem's data is bounded by what one problem is (a signal, a matrix, an equation), never by how many there are. Rows
reach Python in Arrow batches; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def solve_rows(problems: DataFrame, kernel: Callable[..., dict], inputs: list[str], result: str, keep: list[str] | None = None) -> DataFrame:
    """kernel(*row values) -> dict of result columns, for every row; kept columns pass through. A kernel that raises gives a null row with its message where `result` has a `message` column."""
    keep = keep if keep is not None else [c for c in problems.columns if c not in inputs]
    fields = [x.strip().split()[0] for x in _split(result)]
    kept = ", ".join(f"`{c}` {t}" for c, t in problems.select(*keep).dtypes)

    def run(batches):
        for pdf in batches:
            rows = []
            for values in zip(*(pdf[c] for c in inputs)):
                try:
                    got = kernel(*(np.asarray(v, float) if isinstance(v, (list, np.ndarray)) else v for v in values))
                except (ArithmeticError, ValueError, np.linalg.LinAlgError) as e:
                    if "message" not in fields:
                        raise
                    got = {"message": f"{type(e).__name__}: {e}"}
                rows.append([got.get(f).tolist() if isinstance(got.get(f), np.ndarray) else got.get(f) for f in fields])
            out = pd.DataFrame(rows, columns=fields, dtype=object)
            yield pd.concat([pdf[keep].reset_index(drop=True), out], axis=1)

    return problems.select(*dict.fromkeys([*keep, *inputs])).mapInPandas(run, f"{kept}, {result}" if kept else result)


def _split(schema: str) -> list[str]:
    out, depth, at = [], 0, 0
    for k, c in enumerate(schema):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(schema[at:k])
            at = k + 1
    return [*out, schema[at:]]


def map_series(df: DataFrame, key: str, kernel: Callable[[np.ndarray], pd.DataFrame], result: str, order: str = "i", value: str = "x") -> DataFrame:
    """kernel(values in order) -> frame, per series; `result` names its columns after the key."""
    kind = dict(df.dtypes)[key]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = kernel(pdf.sort_values(order)[value].to_numpy(float))
        out.insert(0, key, pdf[key].iloc[0])
        return out

    return df.select(key, order, value).groupBy(key).applyInPandas(run, f"`{key}` {kind}, {result}")


def fft(df: DataFrame, key: str, inverse: bool = False) -> DataFrame:
    from gridflux.kernels.fourier import fft as kernel

    def run(x):
        z = kernel(x.astype(complex), inverse)
        return pd.DataFrame({"k": np.arange(len(z)), "re": z.real, "im": z.imag})

    return map_series(df, key, run, "k bigint, re double, im double")


def matrices(rows: DataFrame, key: str, i: str = "i", j: str = "j", v: str = "v") -> DataFrame:
    """(key, n_rows, n_cols, a): long-form matrices as one dense row-major array per key; duplicates sum."""
    cells = rows.groupBy(key, i, j).agg(F.sum(v).alias(v))
    packed = cells.groupBy(key).agg((F.max(i) + 1).cast("int").alias("n_rows"), (F.max(j) + 1).cast("int").alias("n_cols"), F.collect_list(F.struct(F.col(i).alias("i"), F.col(j).alias("j"), F.col(v).alias("v"))).alias("c"))

    @F.pandas_udf("array<double>")
    def dense(n: pd.Series, m: pd.Series, c: pd.Series) -> pd.Series:
        out = []
        for p, q, cell in zip(n, m, c):
            a = np.zeros((p, q))
            for e in cell:
                a[e["i"], e["j"]] = e["v"]
            out.append(a.ravel())
        return pd.Series(out)

    return packed.select(key, "n_rows", "n_cols", dense("n_rows", "n_cols", "c").alias("a"))


def matrix_kernel(packed: DataFrame, kernel: Callable[[np.ndarray], dict], result: str) -> DataFrame:
    """kernel(matrix) -> dict, for every packed matrix."""
    return solve_rows(packed, lambda n, m, a: kernel(np.asarray(a).reshape(int(n), int(m))), ["n_rows", "n_cols", "a"], result)


def solve_columns(problems: DataFrame, kernel: Callable[..., dict], inputs: list[str], result: str, keep: list[str] | None = None) -> DataFrame:
    """kernel(*columns as float arrays) -> dict of result columns, for whole Arrow batches: element-wise solvers meet all rows of a batch at once."""
    keep = keep if keep is not None else [c for c in problems.columns if c not in inputs]
    fields = [x.strip().split()[0] for x in _split(result)]
    kept = ", ".join(f"`{c}` {t}" for c, t in problems.select(*keep).dtypes)

    def run(batches):
        for pdf in batches:
            got = kernel(*(pdf[c].to_numpy(float) for c in inputs)) if len(pdf) else {f: [] for f in fields}
            yield pd.concat([pdf[keep].reset_index(drop=True), pd.DataFrame({f: got[f] for f in fields})], axis=1)

    return problems.select(*dict.fromkeys([*keep, *inputs])).mapInPandas(run, f"{kept}, {result}" if kept else result)
