"""Signals (keys..., i, x) of uniform sampling: transforms, filters and wavelets as joins, windows and expressions.

Direct transforms cost n*n terms per series and are exact references; long series go through the FFT kernels of
`gridflux.operators.batch`. A filter with few taps is a window of shifted values: it needs one sort by key, no join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(keys: tuple[str, ...]):
    return Window.partitionBy(*keys).orderBy("i")


def _pack(df: DataFrame, keys: tuple[str, ...], x: str = "x") -> DataFrame:
    """One row per series with its values as an array in order."""
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", F.col(x).cast("double").alias("x")))).alias("__s"))
    return rows.select(*keys, F.transform("__s", lambda s: s["x"]).alias("xs"))


def dft(df: DataFrame, *keys: str, inverse: bool = False) -> DataFrame:
    """(keys, k, re, im) by definition."""
    n, sign = F.size("xs"), 1.0 if inverse else -1.0
    rows = _pack(df, keys).select(*keys, "xs", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    angle = lambda i: sign * 2 * math.pi * F.pmod(F.col("k").cast("bigint") * i, n) / n
    total = lambda f: F.aggregate(F.transform("xs", lambda x, i: x * f(angle(i))), F.lit(0.0), lambda a, b: a + b)
    scale = F.lit(1.0) / n if inverse else F.lit(1.0)
    return rows.select(*keys, F.col("k").cast("bigint").alias("k"), (total(F.cos) * scale).alias("re"), (total(F.sin) * scale).alias("im"))


def idft(spectrum: DataFrame, *keys: str) -> DataFrame:
    """Real part of the inverse transform of (k, re, im)."""
    rows = spectrum.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "re", "im"))).alias("s"))
    n = F.size("s")
    rows = rows.select(*keys, "s", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    angle = lambda z: 2 * math.pi * F.pmod(F.col("i").cast("bigint") * z["k"], n) / n
    x = F.aggregate(F.transform("s", lambda z: z["re"] * F.cos(angle(z)) - z["im"] * F.sin(angle(z))), F.lit(0.0), lambda a, b: a + b) / n
    return rows.select(*keys, F.col("i").cast("bigint").alias("i"), x.alias("x"))


def _cosine(df: DataFrame, keys: tuple[str, ...], term, name: str = "k") -> DataFrame:
    n = F.size("xs")
    rows = _pack(df, keys).select(*keys, "xs", F.explode(F.sequence(F.lit(0), n - 1)).alias(name))
    return rows.select(*keys, F.col(name).cast("bigint").alias(name), F.aggregate(F.transform("xs", lambda x, i: x * term(F.col(name), i, n)), F.lit(0.0), lambda a, b: a + b).alias("value"))


def dct(df: DataFrame, *keys: str, kind: int = 2) -> DataFrame:
    terms = {
        1: lambda k, i, n: F.when((i == 0) | (i == n - 1), 1.0).otherwise(2.0) * F.cos(math.pi * k * i / (n - 1)),
        2: lambda k, i, n: 2 * F.cos(math.pi * k * (2 * i + 1) / (2 * n)),
        3: lambda k, i, n: F.when(i == 0, 1.0).otherwise(2.0) * F.cos(math.pi * (2 * k + 1) * i / (2 * n)),
        4: lambda k, i, n: 2 * F.cos(math.pi * (2 * k + 1) * (2 * i + 1) / (4 * n)),
    }
    return _cosine(df, keys, terms[kind])


def dst(df: DataFrame, *keys: str, kind: int = 1) -> DataFrame:
    terms = {1: lambda k, i, n: 2 * F.sin(math.pi * (k + 1) * (i + 1) / (n + 1)), 2: lambda k, i, n: 2 * F.sin(math.pi * (k + 1) * (2 * i + 1) / (2 * n))}
    return _cosine(df, keys, terms[kind])


def hartley(df: DataFrame, *keys: str) -> DataFrame:
    return _cosine(df, keys, lambda k, i, n: F.cos(2 * math.pi * k * i / n) + F.sin(2 * math.pi * k * i / n))


def goertzel(df: DataFrame, k: int, *keys: str) -> DataFrame:
    """One spectral bin per series, as plain sums: re, im."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    rows = df.withColumn("__a", 2 * math.pi * k * F.col("i") / n)
    return rows.groupBy(*keys).agg(F.sum(F.col("x") * F.cos("__a")).alias("re"), (-F.sum(F.col("x") * F.sin("__a"))).alias("im"))


def fftfreq(n: int, d: float = 1.0) -> Column:
    k = F.col("k")
    return F.when(k < (n + 1) // 2, k).otherwise(k - n) / (n * d)


def fir(df: DataFrame, taps: list[float], *keys: str, name: str = "y") -> DataFrame:
    """y[i] = sum_k taps[k] x[i-k], zero before the start."""
    w = _w(keys)
    terms = [t * F.coalesce(F.lag("x", k).over(w), F.lit(0.0)) for k, t in enumerate(taps)]
    return df.withColumn(name, sum(terms[1:], terms[0]))


def convolve(df: DataFrame, taps: list[float], *keys: str, mode: str = "full") -> DataFrame:
    """(keys, i, y): each sample is spread over len(taps) places and summed; `same` has the signal's length from (m-1)//2 on."""
    m = len(taps)
    spread = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(t)).alias("t")) for k, t in enumerate(taps)))
    rows = df.select(*keys, "i", "x", F.explode(spread).alias("t")).groupBy(*keys, (F.col("i") + F.col("t.k")).alias("i")).agg(F.sum(F.col("x") * F.col("t.t")).alias("y"))
    if mode == "full":
        return rows
    n = F.max("i").over(Window.partitionBy(*keys)) - (m - 1) + 1
    lo = (m - 1) // 2 if mode == "same" else m - 1
    rows = rows.withColumn("__n", n)
    length = F.col("__n") if mode == "same" else F.col("__n") - m + 1
    return rows.where((F.col("i") >= lo) & (F.col("i") < lo + length)).withColumn("i", F.col("i") - lo).drop("__n")


def correlate(df: DataFrame, taps: list[float], *keys: str, mode: str = "full") -> DataFrame:
    return convolve(df, list(reversed(taps)), *keys, mode=mode)


def autocorrelation(df: DataFrame, max_lag: int, *keys: str, normalize: bool = True) -> DataFrame:
    """(keys, lag, value) of the series less its mean; lags come from one window, and only sums are shuffled."""
    part = Window.partitionBy(*keys)
    rows = df.withColumn("__c", F.col("x") - F.avg("x").over(part))
    w = _w(keys)
    rows = rows.select(*keys, "__c", *(F.lead("__c", k).over(w).alias(f"__p{k}") for k in range(1, max_lag + 1)))
    sums = rows.groupBy(*keys).agg(F.sum(F.col("__c") * F.col("__c")).alias("s0"), *(F.coalesce(F.sum(F.col("__c") * F.col(f"__p{k}")), F.lit(0.0)).alias(f"s{k}") for k in range(1, max_lag + 1)))
    base = F.when(F.col("s0") == 0, 1.0).otherwise(F.col("s0")) if normalize else F.lit(1.0)
    cells = F.array(*(F.struct(F.lit(k).alias("lag"), (F.col(f"s{k}") / base).alias("value")) for k in range(max_lag + 1)))
    return sums.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.lag", "c.value")


def moving_average(df: DataFrame, size: int, *keys: str, mode: str = "same") -> DataFrame:
    """Centred sums over the full width: the signal counts as zero outside. `valid` keeps places whose window lies inside."""
    before, after = size // 2, size - 1 - size // 2
    w = _w(keys).rowsBetween(-before, after)
    out = df.withColumn("y", F.sum("x").over(w) / size)
    if mode != "valid":
        return out
    part = Window.partitionBy(*keys)
    return out.withColumn("__n", F.count(F.lit(1)).over(part)).where((F.col("i") >= before) & (F.col("i") < F.col("__n") - after)).withColumn("i", F.col("i") - before).drop("__n")


def savgol_weights(window: int, order: int, derivative: int = 0, dx: float = 1.0) -> list[float]:
    """Weights of the centred least-squares polynomial's derivative at the centre."""
    import numpy as np

    t = np.arange(window) - window // 2
    a = np.vander(t.astype(float), order + 1, increasing=True)
    return (np.linalg.pinv(a)[derivative] * math.factorial(derivative) / dx**derivative).tolist()


def savitzky_golay(df: DataFrame, window: int, order: int, *keys: str, derivative: int = 0, dx: float = 1.0) -> DataFrame:
    """Interior by weights on shifted values; the ends repeat the edge sample."""
    w, half = _w(keys), window // 2
    part = _w(keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first("x").over(part), F.last("x").over(part)
    terms = []
    for j, c in enumerate(savgol_weights(window, order, derivative, dx)):
        k = j - half
        v = F.col("x") if k == 0 else F.coalesce(F.lead("x", k).over(w), last) if k > 0 else F.coalesce(F.lag("x", -k).over(w), first)
        terms.append(c * v)
    return df.withColumn("y", sum(terms[1:], terms[0]))


def periodogram(df: DataFrame, *keys: str, dt: float = 1.0, window: str = "hann", detrend: bool = True) -> DataFrame:
    """One-sided power spectral density (keys, k, freq, power), doubled but at zero and, for even n, at Nyquist."""
    from gridflux.functions.windows import window_value

    part = Window.partitionBy(*keys)
    rows = df.withColumn("__n", F.count(F.lit(1)).over(part))
    if detrend:
        rows = rows.withColumn("x", F.col("x") - F.avg("x").over(part))
    if window in ("hann", "hanning"):
        wv = F.when(F.col("__n") > 1, 0.5 - 0.5 * F.cos(2 * math.pi * F.col("i") / (F.col("__n") - 1))).otherwise(1.0)
    elif window in ("boxcar", "rect", "none"):
        wv = F.lit(1.0)
    else:
        n = df.groupBy(*keys).count().agg(F.max("count")).first()[0]
        wv = window_value(window, F.col("i"), n)
    rows = rows.withColumn("__w", wv).withColumn("x", F.col("x") * F.col("__w"))
    power = rows.groupBy(*keys).agg(F.sum(F.col("__w") * F.col("__w")).alias("sw"), F.max("__n").alias("n"))
    spec = dft(rows.select(*keys, "i", "x"), *keys)
    both = spec.join(power, list(keys)) if keys else spec.crossJoin(F.broadcast(power))
    twice = F.when((F.col("k") == 0) | ((F.col("n") % 2 == 0) & (F.col("k") == F.col("n") / 2)), 1.0).otherwise(2.0)
    return both.where(F.col("k") <= F.floor(F.col("n") / 2)).select(*keys, "k", (F.col("k") / (F.col("n") * dt)).alias("freq"), ((F.col("re") * F.col("re") + F.col("im") * F.col("im")) * dt / F.col("sw") * twice).alias("power"))


def frames(df: DataFrame, segment: int, hop: int, *keys: str, n: int) -> DataFrame:
    """(keys, frame, i, x): sliding frames of a series of n samples; each sample goes to the frames that hold it, and no more."""
    last = (n - segment) // hop
    lo = F.greatest(F.ceil((F.col("i") - segment + 1) / hop), F.lit(0))
    hi = F.least(F.floor(F.col("i") / hop), F.lit(last))
    return df.where(lo <= hi).select(*keys, F.explode(F.sequence(lo, hi)).alias("frame"), "i", "x").withColumn("i", F.col("i") - F.col("frame") * hop)


def welch(df: DataFrame, segment: int, *keys: str, n: int, overlap: float = 0.5, dt: float = 1.0, window: str = "hann") -> DataFrame:
    parts = frames(df, segment, max(1, int(segment * (1 - overlap))), *keys, n=n)
    return periodogram(parts, *keys, "frame", dt=dt, window=window).groupBy(*keys, "k", "freq").agg(F.avg("power").alias("power"))


def spectrogram(df: DataFrame, segment: int, *keys: str, n: int, overlap: float = 0.5, dt: float = 1.0, window: str = "hann") -> DataFrame:
    return periodogram(frames(df, segment, max(1, int(segment * (1 - overlap))), *keys, n=n), *keys, "frame", dt=dt, window=window)


# ---- wavelets ---------------------------------------------------------------------------------------------------
def scaling_filter(name: str) -> list[float]:
    """Orthonormal scaling filters: haar in closed form, dbN by spectral factorisation of Daubechies' polynomial."""
    import numpy as np

    if name in ("haar", "db1"):
        return [math.sqrt(0.5)] * 2
    n = int(name.removeprefix("db"))
    p = np.array([math.comb(n - 1 + k, k) for k in range(n)][::-1], float)  # in y = (2 - z - 1/z) / 4
    zs = []
    for y in np.roots(p):
        z = np.roots([1, 4 * y - 2, 1])
        zs.append(z[np.argmin(np.abs(z))])
    h = np.real(np.poly(np.array(zs + [-1.0] * n)))
    return (h / h.sum() * math.sqrt(2)).tolist()


def quadrature_mirror(h: list[float]) -> list[float]:
    return [(-1) ** k * h[len(h) - 1 - k] for k in range(len(h))]


def dwt(df: DataFrame, wavelet: str, n: int, *keys: str) -> DataFrame:
    """One periodic level (keys, i, a, d): each sample goes to the len/2 coefficients that use it; an odd length repeats its last sample."""
    h = scaling_filter(wavelet)
    g = quadrature_mirror(h)
    if n % 2:
        df = df.unionByName(df.where(F.col("i") == n - 1).withColumn("i", F.lit(n).cast("bigint")))
        n += 1
    taps = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(a).alias("h"), F.lit(b).alias("g")) for k, (a, b) in enumerate(zip(h, g))))
    rows = df.select(*keys, "i", "x", F.explode(taps).alias("t")).where(F.pmod(F.col("i") - F.col("t.k"), F.lit(2)) == 0)
    at = F.pmod(F.col("i") - F.col("t.k"), F.lit(n)) / 2
    return rows.groupBy(*keys, at.cast("bigint").alias("i")).agg(F.sum(F.col("x") * F.col("t.h")).alias("a"), F.sum(F.col("x") * F.col("t.g")).alias("d"))


def idwt(coefs: DataFrame, wavelet: str, n: int, *keys: str) -> DataFrame:
    """The inverse of dwt for an even length n: (keys, i, x)."""
    h = scaling_filter(wavelet)
    g = quadrature_mirror(h)
    taps = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(a).alias("h"), F.lit(b).alias("g")) for k, (a, b) in enumerate(zip(h, g))))
    rows = coefs.select(*keys, "i", "a", "d", F.explode(taps).alias("t"))
    return rows.groupBy(*keys, F.pmod(2 * F.col("i") + F.col("t.k"), F.lit(n)).alias("i")).agg(F.sum(F.col("a") * F.col("t.h") + F.col("d") * F.col("t.g")).alias("x"))


def wavedec(df: DataFrame, wavelet: str, n: int, *keys: str, level: int | None = None) -> DataFrame:
    """(keys, band, i, v): band 0 is the approximation, band k the details of level k."""
    level = min(level or 64, int(math.log2(max(n, 1))))
    at, size, out = df.select(*keys, "i", "x"), n, None
    for k in range(1, level + 1):
        both = dwt(at, wavelet, size, *keys)
        size = (size + 1) // 2
        part = both.select(*keys, F.lit(k).alias("band"), "i", F.col("d").alias("v"))
        out = part if out is None else out.unionByName(part)
        at = both.select(*keys, "i", F.col("a").alias("x"))
    return out.unionByName(at.select(*keys, F.lit(0).alias("band"), "i", F.col("x").alias("v")))


def wavelet_energy(coefs: DataFrame, *keys: str) -> DataFrame:
    return coefs.groupBy(*keys, "band").agg(F.sum(F.col("v") * F.col("v")).alias("energy"))


def soft_threshold(x, t) -> Column:
    x, t = (F.col(x) if isinstance(x, str) else x), t if isinstance(t, Column) else F.lit(float(t))
    return F.signum(x) * F.greatest(F.abs(x) - t, F.lit(0.0))


def hard_threshold(x, t) -> Column:
    x, t = (F.col(x) if isinstance(x, str) else x), t if isinstance(t, Column) else F.lit(float(t))
    return F.when(F.abs(x) > t, x).otherwise(0.0)


def universal_threshold(coefs: DataFrame, n: int, *keys: str) -> DataFrame:
    """median|d| / 0.6745 of the finest band times sqrt(2 log n)."""
    return coefs.where("band = 1").groupBy(*keys).agg((F.percentile(F.abs("v"), F.lit(0.5)) / 0.6745 * math.sqrt(2 * math.log(n))).alias("threshold"))


def swt_level(df: DataFrame, wavelet: str, n: int, level: int, *keys: str) -> DataFrame:
    """One undecimated level: taps 2**(level-1) apart, (keys, i, a, d)."""
    h = scaling_filter(wavelet)
    g = quadrature_mirror(h)
    step = 1 << (level - 1)
    taps = F.array(*(F.struct(F.lit(k * step).alias("k"), F.lit(a).alias("h"), F.lit(b).alias("g")) for k, (a, b) in enumerate(zip(h, g))))
    rows = df.select(*keys, "i", "x", F.explode(taps).alias("t"))
    return rows.groupBy(*keys, F.pmod(F.col("i") - F.col("t.k"), F.lit(n)).alias("i")).agg(F.sum(F.col("x") * F.col("t.h")).alias("a"), F.sum(F.col("x") * F.col("t.g")).alias("d"))


def morlet(t: Column, w0: float = 5.0) -> Column:
    env = math.pi**-0.25 * F.exp(-t * t / 2)
    return F.struct((env * F.cos(w0 * t)).alias("re"), (env * F.sin(w0 * t)).alias("im"))


def mexican_hat(t: Column, sigma: float = 1.0) -> Column:
    u = t * t / (sigma * sigma)
    return 2 / (math.sqrt(3 * sigma) * math.pi**0.25) * (1 - u) * F.exp(-u / 2)
