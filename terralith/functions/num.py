"""Numeric Column helpers. NULL stands for masked and for not-a-number everywhere in the engine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Value = Column | float | int


def col(x: Value | str) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def masked(x: Column) -> Column:
    """NULL for not-a-number."""
    return F.when(~F.isnan(x), x)


def same(a: Column, b: Column) -> Column:
    """Equality under which two not-a-numbers are equal, and NULLs are too."""
    return a.eqNullSafe(b)


def over(a: Value, b: Value) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(col(a), col(b))


def shown(x: Column, digits: int = 6) -> Column:
    """Rounded for comparison across engines, without a negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def total(terms) -> Column:
    return reduce(lambda a, b: a + b, terms)


def polynomial(x: Column, coefficients: list[Value]) -> Column:
    """c0 + x*(c1 + x*(...)), without the zero terms at the end."""
    cs = list(coefficients)
    while len(cs) > 1 and not isinstance(cs[-1], Column) and cs[-1] == 0:
        cs.pop()
    out = col(cs[-1])
    for c in reversed(cs[:-1]):
        out = col(c) + x * out
    return out


Matrix = list[list[Column]]


def product(a: Matrix, b: Matrix) -> Matrix:
    return [[total(a[i][k] * b[k][j] for k in range(len(b))) for j in range(len(b[0]))] for i in range(len(a))]


def transposed(a: Matrix) -> Matrix:
    return [list(r) for r in zip(*a, strict=True)]


def applied(a: Matrix, v: list[Column]) -> list[Column]:
    return [total(x * y for x, y in zip(row, v, strict=True)) for row in a]


def to_dtype(x: Column, dtype: str) -> Column:
    """A float as a pixel of an integer type: half-even rounding, then clipping to the type's range; NULL stays."""
    low, high, kind = {"uint8": (0, 255, "short"), "uint16": (0, 65535, "int"), "int16": (-32768, 32767, "short")}[dtype]
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), F.rint(x))).cast(kind)
