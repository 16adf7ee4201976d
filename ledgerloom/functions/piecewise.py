"""Piecewise polynomials: region t holds threshold[t-1] <= x < threshold[t]."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import _c


def _poly(x: Column, coefficients: Sequence[float]) -> Column:
    """Horner's rule, lowest coefficient first; none is 0."""
    out = F.lit(0.0)
    for c in reversed(coefficients):
        out = out * x + F.lit(float(c))
    return out


def piecewise(x, thresholds: Sequence[float], coefficients: Sequence[Sequence[float]], linear: bool = False) -> Column:
    """The polynomial of x's region. `linear` asks for degrees up to 1 with integer slopes."""
    if len(coefficients) != len(thresholds) + 1:
        raise ValueError("one more polynomial than thresholds is needed")
    if list(thresholds) != sorted(thresholds):
        raise ValueError("thresholds must ascend")
    if linear and any(len(c) > 2 or (len(c) == 2 and c[1] != int(c[1])) for c in coefficients):
        raise ValueError("a linear piecewise function takes degree 1 and integer slopes only")
    v = _c(x).cast("double")
    if not thresholds:
        return _poly(v, coefficients[0])
    out = F.when(v < F.lit(float(thresholds[0])), _poly(v, coefficients[0]))
    for t, c in zip(thresholds[1:], coefficients[1:-1]):
        out = out.when(v < F.lit(float(t)), _poly(v, c))
    return out.otherwise(_poly(v, coefficients[-1]))


def regions(x, thresholds: Sequence[float]) -> Column:
    """A bit for each region: whether x lies in it."""
    v, t = _c(x).cast("double"), [None, *map(float, thresholds), None]
    own = []
    for lo, hi in zip(t, t[1:]):
        c = F.lit(True)
        if lo is not None:
            c = c & (v >= F.lit(lo))
        if hi is not None:
            c = c & (v < F.lit(hi))
        own.append(c)
    return F.array(*own)


def relu(x) -> Column:
    return F.greatest(_c(x), F.lit(0).cast("double"))


def logistic_pw(x) -> Column:
    """The linear approximation: 0 below -1/2, 1 from 1/2 on, x + 1/2 between."""
    return piecewise(x, (-0.5, 0.5), ((), (0.5, 1), (1,)), linear=True)


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-_c(x).cast("double")))
