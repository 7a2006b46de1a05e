"""IEEE semantics for Spark columns.

Spark raises on division by zero, gives NULL for logarithms of non-positive numbers, orders NaN as the largest value and
truncates integer division. These expressions give the array semantics instead, inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def ieee_div(a, b) -> Column:
    a, b = _c(a).cast("double"), _c(b).cast("double")
    zero = F.when((a == 0) | F.isnan(a), NAN).when(a > 0, INF).otherwise(-INF)
    return F.when(b == 0, zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def ieee_log(x, base: str = "e") -> Column:
    x = _c(x).cast("double")
    f = {"e": F.log, "2": F.log2, "10": F.log10}[base]
    return F.when(x == 0, -INF).when((x < 0) | F.isnan(x), NAN).otherwise(f(x))


def ieee_log1p(x) -> Column:
    x = _c(x).cast("double")
    return F.when(x == -1, -INF).when((x < -1) | F.isnan(x), NAN).otherwise(F.log1p(x))


def nan_minimum(a, b) -> Column:
    """Element-wise minimum; NaN wins."""
    return F.when(F.isnan(_c(a)) | F.isnan(_c(b)), NAN).otherwise(F.least(_c(a), _c(b)))


def nan_maximum(a, b) -> Column:
    return F.when(F.isnan(_c(a)) | F.isnan(_c(b)), NAN).otherwise(F.greatest(_c(a), _c(b)))


def nan_min(x) -> Column:
    """Aggregate minimum; NaN wins."""
    return F.when(F.bool_or(F.isnan(_c(x))), NAN).otherwise(F.min(_c(x)))


def floor(x) -> Column:
    """Spark's floor is a bigint: it saturates, and makes NaN zero. Doubles from 2^53 on are whole."""
    x = _c(x).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) >= 9007199254740992.0), x).otherwise(F.floor(x).cast("double"))


def floor_divide(a, b) -> Column:
    return floor(ieee_div(a, b))


def remainder(a, b) -> Column:
    """Floored remainder: it has the sign of b."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    safe = F.when(b == 0, F.lit(1.0)).otherwise(b)
    return F.when(b == 0, NAN).otherwise(a - safe * floor(a / safe))


def divmod_(a, b) -> Column:
    return F.struct(floor_divide(a, b).alias("quotient"), remainder(a, b).alias("remainder"))


def logaddexp(a, b) -> Column:
    hi, lo = F.greatest(_c(a), _c(b)), F.least(_c(a), _c(b))
    return F.when(hi == -INF, -INF).when(hi == INF, INF).otherwise(hi + F.log1p(F.exp(lo - hi)))


def logaddexp2(a, b) -> Column:
    hi, lo = F.greatest(_c(a), _c(b)), F.least(_c(a), _c(b))
    return F.when(hi == -INF, -INF).when(hi == INF, INF).otherwise(hi + F.log2(1 + F.pow(F.lit(2.0), lo - hi)))


def sinc(x) -> Column:
    t = _c(x) * F.pi()
    return F.when(_c(x) == 0, 1.0).otherwise(F.sin(t) / t)


def isclose(a, b, rtol: float = 1e-5, atol: float = 1e-8, equal_nan: bool = False) -> Column:
    a, b = _c(a).cast("double"), _c(b).cast("double")
    finite = ~F.isnan(a) & ~F.isnan(b) & (F.abs(a) < INF) & (F.abs(b) < INF)
    both = F.isnan(a) & F.isnan(b) if equal_nan else F.lit(False)
    return F.when(finite, F.abs(a - b) <= atol + rtol * F.abs(b)).otherwise((~F.isnan(a) & ~F.isnan(b) & (a == b)) | both)


def nan_to_num(x, nan: float = 0.0, posinf: float = 1.7976931348623157e308, neginf: float = -1.7976931348623157e308) -> Column:
    x = _c(x)
    return F.when(F.isnan(x), nan).when(x == INF, posinf).when(x == -INF, neginf).otherwise(x)


def heaviside(x, at_zero) -> Column:
    return F.when(F.isnan(_c(x)), NAN).when(_c(x) < 0, 0.0).when(_c(x) > 0, 1.0).otherwise(_c(at_zero))


def unary(name: str, x) -> Column:
    """A unary array function by name, with IEEE results."""
    x = _c(x).cast("double")
    plain = {"sqrt": F.sqrt, "cbrt": F.cbrt, "exp": F.exp, "expm1": F.expm1, "sin": F.sin, "cos": F.cos, "tan": F.tan, "arcsin": F.asin, "arccos": F.acos, "arctan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "arcsinh": F.asinh, "degrees": F.degrees, "radians": F.radians, "absolute": F.abs, "rint": F.rint, "sign": F.signum, "arctanh": F.atanh, "arccosh": F.acosh}
    if name in plain:
        return plain[name](x)
    whole = F.abs(x) >= 9007199254740992.0
    return {
        "exp2": lambda: F.pow(F.lit(2.0), x),
        "log": lambda: ieee_log(x),
        "log2": lambda: ieee_log(x, "2"),
        "log10": lambda: ieee_log(x, "10"),
        "log1p": lambda: ieee_log1p(x),
        "negative": lambda: -x,
        "positive": lambda: x,
        "square": lambda: x * x,
        "reciprocal": lambda: ieee_div(1.0, x),
        "floor": lambda: floor(x),
        "ceil": lambda: F.when(F.isnan(x) | whole, x).otherwise(F.ceil(x).cast("double")),
        "trunc": lambda: F.when(F.isnan(x) | whole, x).otherwise(x.cast("bigint").cast("double")),
        "isnan": lambda: F.isnan(x),
        "isinf": lambda: F.abs(x) == INF,
        "isfinite": lambda: ~F.isnan(x) & (F.abs(x) < INF),
        "signbit": lambda: x < 0,
        "sinc": lambda: sinc(x),
    }[name]()


def binary(name: str, a, b) -> Column:
    a, b = _c(a), _c(b)
    ops = {
        "add": lambda: a + b, "subtract": lambda: a - b, "multiply": lambda: a * b, "divide": lambda: ieee_div(a, b),
        "floor_divide": lambda: floor_divide(a, b), "remainder": lambda: remainder(a, b), "mod": lambda: remainder(a, b),
        "fmod": lambda: F.when(b == 0, NAN).otherwise(a - b * (a / F.when(b == 0, F.lit(1.0)).otherwise(b)).cast("bigint")),
        "power": lambda: F.pow(a, b), "minimum": lambda: nan_minimum(a, b), "maximum": lambda: nan_maximum(a, b),
        "fmin": lambda: F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.least(a, b)), "fmax": lambda: F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.greatest(a, b)),
        "arctan2": lambda: F.atan2(a, b), "hypot": lambda: F.hypot(a, b), "logaddexp": lambda: logaddexp(a, b), "logaddexp2": lambda: logaddexp2(a, b),
        "copysign": lambda: F.when(b < 0, -F.abs(a)).otherwise(F.abs(a)), "heaviside": lambda: heaviside(a, b),
        "equal": lambda: (a == b) & ~F.isnan(a) & ~F.isnan(b), "not_equal": lambda: (a != b) | F.isnan(a) | F.isnan(b), "less": lambda: (a < b) & ~F.isnan(a) & ~F.isnan(b), "less_equal": lambda: (a <= b) & ~F.isnan(a) & ~F.isnan(b),
        "greater": lambda: (a > b) & ~F.isnan(a) & ~F.isnan(b), "greater_equal": lambda: (a >= b) & ~F.isnan(a) & ~F.isnan(b),
        "logical_and": lambda: (a != 0) & (b != 0), "logical_or": lambda: (a != 0) | (b != 0), "logical_xor": lambda: (a != 0) != (b != 0),
        "bitwise_and": lambda: a.bitwiseAND(b), "bitwise_or": lambda: a.bitwiseOR(b), "bitwise_xor": lambda: a.bitwiseXOR(b),
        "left_shift": lambda: F.call_function("shiftleft", a, b.cast("int")), "right_shift": lambda: F.call_function("shiftright", a, b.cast("int")),
    }
    return ops[name]()


# complex numbers are structs (re, im)
def complex_(re, im) -> Column:
    return F.struct(_c(re).cast("double").alias("re"), _c(im).cast("double").alias("im"))


def c_add(a: Column, b: Column) -> Column:
    return complex_(a["re"] + b["re"], a["im"] + b["im"])


def c_mul(a: Column, b: Column) -> Column:
    return complex_(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def c_conj(a: Column) -> Column:
    return complex_(a["re"], -a["im"])


def c_abs(a: Column) -> Column:
    return F.hypot(a["re"], a["im"])


def c_angle(a: Column) -> Column:
    return F.atan2(a["im"], a["re"])


def c_exp(a: Column) -> Column:
    return complex_(F.exp(a["re"]) * F.cos(a["im"]), F.exp(a["re"]) * F.sin(a["im"]))


def c_div(a: Column, b: Column) -> Column:
    n = b["re"] * b["re"] + b["im"] * b["im"]
    return complex_(ieee_div(a["re"] * b["re"] + a["im"] * b["im"], n), ieee_div(a["im"] * b["re"] - a["re"] * b["im"], n))
