"""3-vectors as triples of columns: plain arithmetic that stays inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(*names: str) -> Vec:
    x, y, z = (F.col(n) for n in names)
    return x, y, z


def const(x: float, y: float, z: float) -> Vec:
    return F.lit(float(x)), F.lit(float(y)), F.lit(float(z))


def add(a: Vec, b: Vec) -> Vec:
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


def sub(a: Vec, b: Vec) -> Vec:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def scale(a: Vec, k) -> Vec:
    return a[0] * k, a[1] * k, a[2] * k


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vec) -> Vec:
    """A zero vector is an error, as a direction has no meaning without a length."""
    n = F.coalesce(F.nullif(norm(a), F.lit(0.0)), F.raise_error(F.lit("a zero vector has no direction")).cast("double"))
    return a[0] / n, a[1] / n, a[2] / n


def bind(df: DataFrame, name: str, a: Vec) -> tuple[DataFrame, Vec]:
    """Gives a vector three columns, so that later expressions refer to it and don't repeat it."""
    names = [f"{name}_{c}" for c in "xyz"]
    return df.withColumns(dict(zip(names, a))), vec(*names)


def pick(condition: Column, a: Vec, b: Vec) -> Vec:
    return tuple(F.when(condition, x).otherwise(y) for x, y in zip(a, b))  # type: ignore[return-value]


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


TAU = 2.0 * math.pi
