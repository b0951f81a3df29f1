"""Vector functions over arrays: expressions for plans, numpy for Arrow functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def to_int8(a: Column, offset: float = -2.0, factor: float = 20.0) -> Column:
    """``(x - offset) * factor``, rounded half to even and clipped to a byte."""
    return F.transform(a, lambda x: F.greatest(F.lit(-128.0), F.least(F.lit(127.0), F.rint((x.cast("double") - offset) * factor))).cast("tinyint"))


def from_int8(a: Column, offset: float = -2.0, factor: float = 20.0) -> Column:
    return F.transform(a, lambda x: x.cast("double") / factor + offset)


def to_int4(a: Column, offset: float = -2.0, factor: float = 4.0) -> Column:
    """Two 4-bit codes in a byte: the first half of the vector low, the second half high."""
    codes = F.transform(a, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(15.0), F.rint((x.cast("double") - offset) * factor))).cast("int"))
    half = (F.size(a) / 2).cast("int")
    return F.zip_with(F.slice(codes, F.lit(1), half), F.slice(codes, half + 1, half), lambda x, y: x + F.shiftleft(y, 4))


def from_int4(a: Column, offset: float = -2.0, factor: float = 4.0) -> Column:
    back = lambda c: c.cast("double") / factor + offset
    return F.concat(F.transform(a, lambda x: back(x.bitwiseAND(F.lit(15)))), F.transform(a, lambda x: back(F.shiftright(x, 4))))


def softmax_over(score: Column, window) -> Column:
    """Shares of ``exp(score)`` in a window, shifted by its largest."""
    top = F.max(score).over(window)
    return F.exp(score - top) / F.sum(F.exp(score - top)).over(window)
