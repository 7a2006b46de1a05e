"""Filters over keyed streams (key, i, x): each key's memory lives in the state store, so a restart goes on where it stopped.

Samples may come in any order. A sample waits in its key's state until all before it (from 0) have come; one whose number has been
passed, or that repeats a waiting one, is dropped, so a source that replays rows does no harm. Null values count as zero; rows
without key or number are left out. State grows only with the samples that wait.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridflux.kernels import filters

#: (piece, memory or None) -> (output, memory); memory is anything that JSON holds.
Kernel = Callable[[np.ndarray, object], tuple[np.ndarray, object]]


def iir(b, a=(1.0,)) -> Kernel:
    b, a = filters.normalised(b, a)

    def step(x, memory):
        y, memory = filters.lfilter(b, a, x, memory)
        return y, memory.tolist()

    return step


def fir(taps) -> Kernel:
    return iir(taps)


def biquads(sos) -> Kernel:
    def step(x, memory):
        y, memory = filters.sosfilt(sos, x, memory)
        return y, memory.tolist()

    return step


def resampler(up: int, down: int, taps=None) -> Kernel:
    return lambda x, memory: filters.resample_piece(x, up, down, memory, taps)


def filtered(signal: DataFrame, kernel: Kernel, key: str = "key", i: str = "i", x: str = "x") -> DataFrame:
    """(key, i, y) of a stream of samples; output samples are numbered from 0 by key."""
    kind = dict(signal.dtypes)[key]

    def run(name: tuple, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        due, written, memory, waiting = json.loads(state.get[0]) if state.exists else (0, 0, None, [])
        held = {int(n): v for n, v in waiting}
        for piece in pieces:
            for n, v in zip(piece["i"], piece["x"]):
                if n >= due:
                    held.setdefault(int(n), float(v))
        ready = []
        while due in held:
            ready.append(held.pop(due))
            due += 1
        y, memory = kernel(np.array(ready), memory) if ready else (np.empty(0), memory)
        state.update((json.dumps((due, written + len(y), memory, sorted(held.items()))),))
        yield pd.DataFrame({key: [name[0]] * len(y), "i": np.arange(written, written + len(y)), "y": y})

    rows = signal.where(F.col(key).isNotNull() & F.col(i).isNotNull())
    rows = rows.select(F.col(key), F.col(i).cast("bigint").alias("i"), F.coalesce(F.col(x).cast("double"), F.lit(0.0)).alias("x"))
    return rows.groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, i bigint, y double", "memory string", "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, path: str, seconds: int = 600) -> DataFrame:
    """Run a stream over all that its source holds now, into Parquet under `path`, and read the result; a second call with the same path goes on."""
    run = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/rows")
    if not run.awaitTermination(seconds):
        run.stop()
        raise TimeoutError(f"the stream did not end in {seconds} s")
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")
