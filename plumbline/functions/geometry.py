"""Polylines as arrays of points (struct x, y), by higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _steps(points: Column, fn) -> Column:
    n = F.greatest(F.size(points) - 1, F.lit(0))
    return F.zip_with(F.slice(points, 1, n), F.slice(points, 2, n), fn)


def length(points: Column) -> Column:
    """Sum of step lengths; 0 for fewer than two points."""
    return F.aggregate(_steps(points, lambda a, b: F.sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))), F.lit(0.0), lambda s, d: s + d)


def area(points: Column) -> Column:
    """Shoelace area of the closed polygon."""
    closed = F.concat(points, F.slice(points, 1, 1))
    return F.abs(F.aggregate(_steps(closed, lambda a, b: a.x * b.y - b.x * a.y), F.lit(0.0), lambda s, d: s + d)) / 2


def simplify(points: Column, eps: float = 0.02) -> Column:
    """Drop vertices on a straight run, judged against the last kept vertex; both ends stay.

    The kind of a run: cross product below ``eps`` and a positive dot product of unit directions.
    """
    def fold(kept: Column, at: Column) -> Column:
        last, here, after = F.element_at(kept, -1), F.element_at(points, at), F.element_at(points, at + 1)
        ax, ay, bx, by = here.x - last.x, here.y - last.y, after.x - here.x, after.y - here.y
        n = F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by)
        straight = (n > 0) & (F.abs(ax * by - ay * bx) < eps * n) & (ax * bx + ay * by > 0)
        return F.when(straight, kept).otherwise(F.concat(kept, F.array(here)))

    inner = F.when(F.size(points) > 2, F.sequence(F.lit(2), F.size(points) - 1)).otherwise(F.array().cast("array<int>"))
    kept = F.aggregate(inner, F.slice(points, 1, 1), fold)
    return F.when(F.size(points) > 1, F.concat(kept, F.slice(points, -1, 1))).otherwise(points)


def sample(points: Column, every: float = 40.0) -> Column:
    """Points at most ``every`` apart along the line, ends included."""
    def run(a: Column, b: Column) -> Column:
        d = F.sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))
        n = F.greatest(F.ceil(d / every), F.lit(1)).cast("int")
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((a.x + (b.x - a.x) * i / n).alias("x"), (a.y + (b.y - a.y) * i / n).alias("y")))

    return F.concat(F.flatten(_steps(points, run)), F.slice(points, -1, 1))


def arc(cx: Column, cy: Column, r: Column, a0: Column, a1: Column, n: int) -> Column:
    """n + 1 points from angle a0 to a1 (degrees, anticlockwise)."""
    span = F.pmod(a1 - a0, F.lit(360.0))
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.struct((cx + r * F.cos(F.radians(a0 + span * i / n))).alias("x"), (cy + r * F.sin(F.radians(a0 + span * i / n))).alias("y")))
