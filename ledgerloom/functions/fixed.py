"""Fixed-point numbers: a 64-bit integer with D fractional bits (D = 0, 8, 16 or 32)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import _c, add, eq, ge, gt, lt, product128, sub

WIDTHS = (0, 8, 16, 32)


def _check(d: int) -> None:
    if d not in WIDTHS:
        raise ValueError(f"D must be one of {WIDTHS}")


def to_fixed(x, d: int) -> Column:
    """The double x as fixed point; what lies below 2^-D is cut off toward zero."""
    _check(d)
    return (_c(x).cast("double") * float(1 << d)).cast("bigint")


def from_fixed(raw, d: int) -> Column:
    _check(d)
    return _c(raw).cast("double") / float(1 << d)


def _shifted(high: Column, low: Column, by: int) -> Column:
    """A 128-bit number shifted right by 0 to 127 bits, rounded down; the low 64 bits of that."""
    if by >= 64:
        return F.shiftright(high, by - 64)
    return F.shiftrightunsigned(low, by).bitwiseOR(F.shiftleft(high, 64 - by)) if by else low


def _rest(high: Column, low: Column, by: int) -> Column:
    """Whether any of the low `by` bits is set."""
    bits = lambda x, n: x.bitwiseAND(F.lit((1 << n) - 1 if n < 64 else -1).cast("bigint")) != 0
    if not by:
        return F.lit(False)
    return bits(low, min(by, 64)) if by <= 64 else bits(low, 64) | bits(high, by - 64)


def fixed_mul(a, b, d: int, shift: int = 0) -> Column:
    """Product of two scalars, cut off toward zero (and divided by 2^shift), modulo 2^64."""
    _check(d)
    high, low = product128(a, b)
    down = _shifted(high, low, d + shift)
    return F.when((high < 0) & _rest(high, low, d + shift), add(down, F.lit(1))).otherwise(down)


def fixed_mul_floor(a, b, d: int, shift: int = 0) -> Column:
    """Product as matrices have it: rounded toward minus infinity, modulo 2^64."""
    _check(d)
    return _shifted(*product128(a, b), d + shift)


def fixed_lt(a, b) -> Column:
    """Comparisons of fixed-point numbers of the same D are those of their integers."""
    return lt(a, b)


def fixed_gt(a, b) -> Column:
    return gt(a, b)


def fixed_ge(a, b) -> Column:
    return ge(a, b)


def fixed_eq(a, b) -> Column:
    return eq(a, b)


def fixed_add(a, b) -> Column:
    return add(a, b)


def fixed_sub(a, b) -> Column:
    return sub(a, b)


def square_difference(a, b) -> Column:
    """(a - b)^2 for each row."""
    return F.pow(_c(a) - _c(b), F.lit(2))
