"""Causal filters whose memory is a short array, so that a signal may come in pieces; filter design and rational resampling.

A filter's memory is its last inputs and its last outputs (direct form I): two runs over pieces equal one over the whole.
"""

from __future__ import annotations

import math

import numpy as np


def normalised(b, a=(1.0,)) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients with a[0] = 1."""
    b, a = np.atleast_1d(np.asarray(b, float)), np.atleast_1d(np.asarray(a, float))
    if not len(b) or not len(a) or a[0] == 0 or not (np.isfinite(a).all() and np.isfinite(b).all()):
        raise ValueError("coefficients must be finite, and the first of the denominator not zero")
    return b / a[0], a / a[0]


def at_rest(b, a=(1.0,)) -> np.ndarray:
    """The memory before the first sample."""
    return np.zeros(len(np.atleast_1d(b)) + len(np.atleast_1d(a)) - 2)


def lfilter(b, a, x, memory=None) -> tuple[np.ndarray, np.ndarray]:
    """(output, memory after it) of sum a[k] y[n - k] = sum b[k] x[n - k]."""
    b, a = normalised(b, a)
    x = np.asarray(x, float)
    memory = at_rest(b, a) if memory is None else np.asarray(memory, float)
    if len(memory) != len(b) + len(a) - 2:
        raise ValueError("the memory does not fit the filter")
    own, past = np.concatenate([memory[: len(b) - 1], x]), memory[len(b) - 1 :]
    driven = np.convolve(own, b)[len(b) - 1 : len(own)] if len(x) else np.empty(0)
    if len(a) > 1:
        y, back = np.concatenate([past, driven]), a[:0:-1]
        for n in range(len(past), len(y)):
            y[n] -= back @ y[n - len(back) : n]
    else:
        y = driven
    return y[len(past) :], np.concatenate([own[len(x) :], y[len(y) - len(past) :]])


def sosfilt(sos, x, memory=None) -> tuple[np.ndarray, np.ndarray]:
    """(output, memory) of second-order sections b0 b1 b2 a0 a1 a2 in a row."""
    sos = np.asarray(sos, float).reshape(-1, 6)
    memory = np.zeros((len(sos), 4)) if memory is None else np.asarray(memory, float).reshape(-1, 4)
    after = []
    for section, m in zip(sos, memory):
        x, kept = lfilter(section[:3], section[3:], x, m)
        after.append(kept)
    return np.asarray(x, float), np.array(after)


def firwin(taps: int, cutoff: float, fs: float = 2.0, low: bool = True) -> np.ndarray:
    """Low-pass (or high-pass, of odd length) taps: a sinc under a Hamming window, with gain 1 at its pass end."""
    if not 0 < cutoff < fs / 2 or taps < 1 or (not low and taps % 2 == 0):
        raise ValueError("the cutoff must lie inside the band, and a high-pass needs an odd length")
    k = np.arange(taps) - (taps - 1) / 2
    width = 2 * cutoff / fs
    h = width * np.sinc(width * k) * (np.hamming(taps) if taps > 1 else 1.0)
    h /= h.sum()
    return h if low else (k == 0) - h


def butterworth_sos(order: int, cutoff: float, fs: float = 2.0) -> np.ndarray:
    """Low-pass sections: analogue poles on a half circle, moved by the bilinear map with the cutoff held."""
    if order < 1 or not 0 < cutoff < fs / 2:
        raise ValueError("the order must be positive and the cutoff inside the band")
    w = math.tan(math.pi * cutoff / fs)
    sections = []
    for k in range(order // 2):
        damping = 2 * math.sin(math.pi * (2 * k + 1) / (2 * order))
        scale = 1 + damping * w + w * w
        sections.append([w * w / scale, 2 * w * w / scale, w * w / scale, 1.0, 2 * (w * w - 1) / scale, (1 - damping * w + w * w) / scale])
    if order % 2:
        sections.append([w / (1 + w), w / (1 + w), 0.0, 1.0, (w - 1) / (1 + w), 0.0])
    return np.array(sections)


def _resampling_taps(up: int, down: int) -> np.ndarray:
    most = max(up, down)
    return up * firwin(20 * most + 1, 1 / most) if most > 1 else np.ones(1)


def resample_poly(x, up: int, down: int, taps=None) -> np.ndarray:
    """ceil(n up / down) samples at up / down times the rate, in phase with x."""
    g = math.gcd(up, down)
    up, down = up // g, down // g
    h = _resampling_taps(up, down) if taps is None else np.asarray(taps, float)
    x = np.asarray(x, float)
    n = -(-len(x) * up // down)
    at = np.arange(n) * down + (len(h) - 1) // 2
    return _polyphase(x, h, up, at, 0)


def _polyphase(x: np.ndarray, h: np.ndarray, up: int, at: np.ndarray, first: int) -> np.ndarray:
    """Samples number `at` of h over x with up - 1 zeros after each value; x starts at sample `first` of its signal."""
    out = np.zeros(len(at))
    for k in range(-(-len(h) // up)):
        tap = at % up + k * up
        source = at // up - k - first
        ok = (tap < len(h)) & (source >= 0) & (source < len(x))
        out[ok] += h[tap[ok]] * x[source[ok]]
    return out


def resample_piece(x, up: int, down: int, memory=None, taps=None) -> tuple[np.ndarray, tuple[int, int, list[float]]]:
    """(output, memory) of causal resampling of the next piece; memory is (samples read, samples written, last inputs)."""
    g = math.gcd(up, down)
    up, down = up // g, down // g
    h = _resampling_taps(up, down) if taps is None else np.asarray(taps, float)
    read, written, past = memory or (0, 0, [])
    whole = np.concatenate([past, np.asarray(x, float)])
    total = read + len(whole) - len(past)
    upto = -(-total * up // down)
    y = _polyphase(whole, h, up, np.arange(written, upto) * down, total - len(whole))
    return y, (total, upto, whole[max(0, len(whole) - -(-len(h) // up)) :].tolist())
