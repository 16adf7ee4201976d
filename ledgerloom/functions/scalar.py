"""Comparisons, logic and bits on 64-bit columns: signed, two's complement, wrapping.

Arithmetic goes by 32-bit halves, none of whose partial results can overflow, so the results do
not depend on spark.sql.ansi.enabled and stay within generated code. A null operand gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDE = "decimal(38,0)"  # for sums, which may pass 64 bits


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def wrap(x, bits: int = 64) -> Column:
    """x modulo 2^bits as a signed number of `bits` bits (64 at most)."""
    if not 1 <= bits <= 64:
        raise ValueError("bits must be 1..64")
    half, full = F.lit(str(1 << (bits - 1))).cast(_WIDE), F.lit(str(1 << bits)).cast(_WIDE)
    return (F.pmod(_c(x).cast(_WIDE) + half, full) - half).cast("bigint")


def trim(x, bits: int) -> Column:
    """The low `bits` bits, unsigned (63 at most)."""
    return _c(x).cast("bigint").bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))


def lt(a, b) -> Column:
    return _c(a) < _c(b)


def gt(a, b) -> Column:
    return _c(a) > _c(b)


def ge(a, b) -> Column:
    return _c(a) >= _c(b)


def eq(a, b) -> Column:
    return _c(a) == _c(b)


def msb(x) -> Column:
    """The sign bit."""
    return _c(x) < 0


def xor(a, b) -> Column:
    return _c(a).bitwiseXOR(_c(b))


def or_(a, b) -> Column:
    return _c(a).bitwiseOR(_c(b))


def and_(a, b) -> Column:
    return _c(a).bitwiseAND(_c(b))


def not_(a) -> Column:
    return F.bitwise_not(_c(a))


def nor(*xs) -> Column:
    """True where every bit of every operand is zero."""
    out = F.lit(True)
    for x in xs:
        out = out & (_c(x) == 0)
    return out


def _long(x) -> Column:
    return _c(x).cast("bigint")


_LOW32 = 0xFFFFFFFF


def low32(x: Column) -> Column:
    """The low half, unsigned."""
    return x.bitwiseAND(F.lit(_LOW32).cast("bigint"))


def high32(x: Column) -> Column:
    """The high half, signed."""
    return F.shiftright(x, 32)


def _of_halves(high: Column, low: Column) -> Column:
    return F.shiftleft(high, 32).bitwiseOR(low32(low))


def narrow(x: Column, bits: int) -> Column:
    """The low `bits` bits (64 at most) as a signed number."""
    if not 1 <= bits <= 64:
        raise ValueError("bits must be 1..64")
    return x if bits == 64 else F.shiftright(F.shiftleft(x, 64 - bits), 64 - bits)


def _add(x: Column, y: Column) -> Column:
    low = low32(x) + low32(y)
    return _of_halves(high32(x) + high32(y) + high32(low), low)


def add(a, b, bits: int = 64) -> Column:
    return narrow(_add(_long(a), _long(b)), bits)


def sub(a, b, bits: int = 64) -> Column:
    x, y = _long(a), _long(b)
    low = low32(x) - low32(y)
    return narrow(_of_halves(high32(x) - high32(y) + high32(low), low), bits)


def _low_product(x: Column, y: Column) -> tuple[Column, Column]:
    """High and low half of the product of the low halves: one factor goes in parts of 16 bits."""
    a, b = low32(x), low32(y)
    upper, lower = F.shiftright(a, 16) * b, a.bitwiseAND(F.lit(0xFFFF).cast("bigint")) * b
    high = F.shiftright(upper + F.shiftright(lower, 16), 16)
    return high, low32(F.shiftleft(upper.bitwiseAND(F.lit(0xFFFF).cast("bigint")), 16) + low32(lower))


def product128(a, b) -> tuple[Column, Column]:
    """The 128-bit product of two numbers: its high half, signed, and its low half as 64 bits."""
    x, y = _long(a), _long(b)
    high, low = _low_product(x, y)
    first = high32(x) * low32(y) + high
    second = low32(x) * high32(y) + low32(first)
    return high32(x) * high32(y) + high32(first) + high32(second), _of_halves(second, low)


def mul(a, b, bits: int = 64) -> Column:
    """Product modulo 2^bits."""
    return narrow(product128(a, b)[1], bits)


def max_(a, b) -> Column:
    return F.greatest(_c(a), _c(b))


def min_(a, b) -> Column:
    return F.least(_c(a), _c(b))


def max_min_split(a, b) -> Column:
    return F.struct(max_(a, b).alias("max"), min_(a, b).alias("min"))


def select(flag, yes, no) -> Column:
    return F.when(_c(flag), _c(yes)).otherwise(_c(no))


def keep_if(flag, x) -> Column:
    """x where flag, else 0: a number times a bit."""
    return F.when(_c(flag), _c(x)).otherwise(F.lit(0))


def shift(x, by: int) -> Column:
    """Arithmetic shift: left for a positive number of bits, right for a negative one."""
    return F.shiftleft(_c(x), by) if by >= 0 else F.shiftright(_c(x), -by)


def split_at(x, bits: int) -> Column:
    """(x >> bits, the low bits of x)."""
    return F.struct(F.shiftright(_c(x), bits).alias("high"), trim(x, bits).alias("low"))


def bit(x, i: int) -> Column:
    """Bit i as an integer."""
    return F.shiftright(_c(x), i).bitwiseAND(F.lit(1).cast("bigint"))


def bits_of(x, n: int) -> Column:
    """The low n bits, lowest first, as an array of integers."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.pmod(F.floor(_c(x).cast(_WIDE) / F.pow(F.lit(2.0), i).cast(_WIDE)), F.lit(2)).cast("bigint")) if n > 62 else F.array(*(bit(x, i) for i in range(n)))


def bool_to_int(flag) -> Column:
    return _c(flag).cast("bigint")


def to_binary(x) -> Column:
    """The two's complement bits as text."""
    return F.bin(_c(x))


def all_false(n: int) -> Column:
    """n bits, none of them set."""
    return F.array(*(F.lit(False) for _ in range(n)))


def all_true(n: int) -> Column:
    return F.array(*(F.lit(True) for _ in range(n)))


def random_mask(seed: int) -> Column:
    """A random 64-bit number for each row."""
    return F.xxhash64(F.rand(seed))
