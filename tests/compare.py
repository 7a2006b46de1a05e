"""Compares a query with its SQL on DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connected(sf_dir: str):
    d = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        d.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}{'/*' if f.is_dir() else ''}')")
    return d


def _key(row: tuple) -> tuple:
    return tuple("" if v is None else f"{v:.3g}" if isinstance(v, float) else str(v) for v in row)


def same(left, right) -> bool:
    if isinstance(left, float) and isinstance(right, float):
        return (math.isnan(left) and math.isnan(right)) or math.isclose(left, right, rel_tol=1e-6, abs_tol=1e-9)
    return left == right


def check(df, sql: str, sf_dir: str) -> None:
    cols = sorted(df.columns)
    ours = sorted((tuple(r) for r in df.select(*cols).collect()), key=_key)
    found = connected(sf_dir).execute(sql)
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    theirs = sorted((tuple(r[names.index(c)] for c in cols) for r in found.fetchall()), key=_key)
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs):
        assert all(map(same, a, b)), (a, b)
