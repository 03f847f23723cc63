"""Box arithmetic as columns. Boxes are x0, y0, x1, y1; coordinates may be integers or floats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clip(lo: Column, value: Column, hi: Column) -> Column:
    return F.least(hi, F.greatest(lo, value))


def to_rect(x0: str, y0: str, x1: str, y1: str) -> list[Column]:
    """Integer rectangle x, y, width, height; each truncated on its own, so x + width may differ from the truncated right edge."""
    return [c(x0).cast("int").alias("rx"), c(y0).cast("int").alias("ry"), (c(x1) - c(x0)).cast("int").alias("rw"), (c(y1) - c(y0)).cast("int").alias("rh")]


def normalized(value: str, size: Column) -> Column:
    """Coordinate in thousandths of the page, single precision, cut towards zero."""
    return ((c(value).cast("float") / size.cast("float")).cast("float") * F.lit(1000.0).cast("float")).cast("int")


def overlap(a: str, b: str, plus: int = 0) -> Column:
    """Area of the intersection of boxes with column prefixes `a` and `b`; with plus=1 edges count as pixels."""
    side = lambda lo, hi: F.greatest(F.lit(0), F.least(c(a + hi), c(b + hi)) - F.greatest(c(a + lo), c(b + lo)) + plus)
    return side("x0", "x1") * side("y0", "y1")


def area(a: str, plus: int = 0) -> Column:
    return (c(a + "x1") - c(a + "x0") + plus) * (c(a + "y1") - c(a + "y0") + plus)


def iou(a: str, b: str, plus: int = 0) -> Column:
    """Intersection over union in [0, 1]; 0 for boxes apart or without area."""
    inter = overlap(a, b, plus).cast("double")
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(inter, area(a, plus) + area(b, plus) - inter))), F.lit(0.0))
