"""Scalar rules of schedules: tolerances, nearest standard sizes, weights, statuses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Standard diameters in mm.
STANDARD = [8, 10, 12, 16, 20, 25, 32]
#: Absolute floor and relative part of each tolerance family.
FAMILIES = {"row": (30.0, 0.08), "straight": (80.0, 0.15), "bent": (120.0, 0.20), "weight": (0.05, 0.01), "audit": (0.02, 0.005)}


def close(a: Column, b: Column, floor: float, rel: float) -> Column:
    """|a - b| within max(floor, rel * larger magnitude); false if either is null."""
    return F.coalesce(F.abs(a - b) <= F.greatest(F.lit(floor), F.lit(rel) * F.greatest(F.abs(a), F.abs(b))), F.lit(False))


def tolerance(target: Column, family: str) -> Column:
    floor, rel = FAMILIES[family]
    return F.greatest(F.lit(floor), F.lit(rel) * target)


def snap(x: Column, sizes: list[int] | None = None, reach: float = 2.0) -> Column:
    """Nearest standard size, the smaller on a tie; null beyond ``reach``."""
    best = F.array_min(F.array(*[F.struct(F.abs(x - F.lit(float(s))).alias("d"), F.lit(s).alias("s")) for s in sizes or STANDARD]))
    return F.when(best["d"] <= reach, best["s"])


def unit_weight(dia: Column) -> Column:
    """kg per metre by the d squared over 162 rule."""
    return dia * dia / 162.0


def mass_per_mm(dia: Column) -> Column:
    """kg per mm from the density of steel; never mixed with unit_weight in one comparison."""
    return F.pi() / 4 * dia * dia * 7850e-9


def orientation(dx: Column, dy: Column, degrees: float = 3.0) -> Column:
    """h, v or other by the angle of a run."""
    angle = F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(180.0))
    return F.when((angle <= degrees) | (angle >= 180 - degrees), "h").when(F.abs(angle - 90) <= degrees, "v").otherwise("other")
