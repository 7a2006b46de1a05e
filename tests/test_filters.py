"""Filters in pieces against the whole, designs against their response, streams with gaps, repeats and restarts."""

import numpy as np
import pytest

from gridflux.kernels import filters
from gridflux.streaming import filters as streaming

X = np.random.default_rng(1).normal(size=200)
CUTS = [0, 1, 1, 7, 60, 200]


def response(b, a, w):
    z = np.exp(-1j * np.asarray(w))
    return np.abs(np.polyval(np.asarray(b)[::-1], z) / np.polyval(np.asarray(a)[::-1], z))


def test_filters_follow_their_recurrence():
    b, a = [2.0, 1.0, -1.0], [2.0, -0.6, 0.1]
    y, _ = filters.lfilter(b, a, X)
    for n in range(2, 200):
        assert 2 * y[n] == pytest.approx(0.6 * y[n - 1] - 0.1 * y[n - 2] + 2 * X[n] + X[n - 1] - X[n - 2])
    assert np.allclose(filters.lfilter([1, 2, 3], [1], X)[0], np.convolve(X, [1, 2, 3])[:200])
    assert np.allclose(filters.lfilter([3.0], [1.0], X)[0], 3 * X) and not len(filters.lfilter(b, a, [])[0])


@pytest.mark.parametrize("b, a", [([1, 2, 3, 4], [1]), ([0.2], [1, -0.5, 0.3]), ([1, 0.5], [1, 0, 0, -0.2]), ([2.0], [1.0])])
def test_pieces_equal_the_whole(b, a):
    whole, end = filters.lfilter(b, a, X)
    memory, out = None, []
    for lo, hi in zip(CUTS, CUTS[1:]):
        y, memory = filters.lfilter(b, a, X[lo:hi], memory)
        out.append(y)
    assert np.allclose(np.concatenate(out), whole) and np.allclose(memory, end)


def test_sections_equal_their_product_and_bad_input_is_refused():
    sos = filters.butterworth_sos(5, 0.3)
    b, a = np.ones(1), np.ones(1)
    for s in sos:
        b, a = np.convolve(b, s[:3]), np.convolve(a, s[3:])
    assert np.allclose(filters.sosfilt(sos, X)[0], filters.lfilter(b, a, X)[0])
    assert np.allclose(response(b, a, [0.0, 0.3 * np.pi]), [1.0, np.sqrt(0.5)]) and response(b, a, [0.9 * np.pi])[0] < 1e-5
    for bad in (lambda: filters.lfilter([1], [0, 1], X), lambda: filters.lfilter([1, 2], [1], X, [0, 0]), lambda: filters.firwin(8, 0.3, low=False), lambda: filters.butterworth_sos(2, 1.5)):
        with pytest.raises(ValueError):
            bad()


def test_windowed_sinc_passes_one_side():
    low, high = filters.firwin(51, 0.4), filters.firwin(51, 0.4, low=False)
    assert np.allclose(response(low, [1], [0.0, 0.9 * np.pi]), [1, 0], atol=3e-3) and np.allclose(response(high, [1], [0.0, 0.9 * np.pi]), [0, 1], atol=3e-3)


@pytest.mark.parametrize("up, down", [(3, 2), (2, 3), (4, 2), (1, 1), (5, 7)])
def test_resampling_keeps_slow_waves_and_pieces(up, down):
    t = np.arange(200)
    wave = np.sin(2 * np.pi * t / 50)
    y = filters.resample_poly(wave, up, down)
    assert len(y) == -(-200 * up // down)
    middle = slice(len(y) // 4, 3 * len(y) // 4)
    assert np.abs(y - np.sin(2 * np.pi * np.arange(len(y)) * down / up / 50))[middle].max() < 5e-3
    whole, _ = filters.resample_piece(wave, up, down)
    memory, out = None, []
    for lo, hi in zip(CUTS, CUTS[1:]):
        piece, memory = filters.resample_piece(wave[lo:hi], up, down, memory)
        out.append(piece)
    assert np.allclose(np.concatenate(out), whole)


def test_streams_wait_for_gaps_drop_repeats_and_go_on_after_a_restart(spark, tmp_path):
    schema, source = "key string, i bigint, x double", str(tmp_path / "in")

    def add(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        got = streaming.drained(streaming.filtered(stream, streaming.iir([1.0], [1.0, -0.5])), str(tmp_path / "out"))
        return sorted(map(tuple, got.collect()))

    add(("a", 0, 4.0), ("a", 2, 0.0), ("b", 1, 1.0), (None, 0, 1.0), ("a", -1, 9.0), ("a", None, 9.0))
    assert run() == [("a", 0, 4.0)]
    add(("a", 1, None), ("a", 0, 100.0), ("a", 2, 100.0), ("c", 0, 1.0))
    assert run() == [("a", 0, 4.0), ("a", 1, 2.0), ("a", 2, 1.0), ("c", 0, 1.0)]
    add(("b", 0, 2.0), ("b", 0, 7.0))
    assert run()[3:] == [("b", 0, 2.0), ("b", 1, 2.0), ("c", 0, 1.0)]
