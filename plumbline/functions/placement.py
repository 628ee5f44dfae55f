"""Scalar rules that place bars: lines, boxes, bends, shapes, confidences. Column expressions only."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Segment columns in the order in which a shape runs through them; there is no F.
SEGMENTS = ["A", "B", "C", "D", "E", "G"]
#: Right, up, left, down.
TURNS = [(1.0, 0.0), (0.0, 1.0), (-1.0, 0.0), (0.0, -1.0)]
#: Shape codes and their families.
FAMILY = {"M_00": "straight", "M_17": "u_bar", "M_17A": "u_bar", "M_T1": "link_tie", "M_T10": "link_tie"}


def angle(dx: Column, dy: Column) -> Column:
    """Direction without sense, from 0 to below pi; within 1e-9 of pi it is 0, so that a line along x has one form."""
    a = F.pmod(F.atan2(dy, dx), F.pi())
    return F.when(a >= F.pi() - 1e-9, 0.0).otherwise(a)


def line_form(x0: Column, y0: Column, x1: Column, y1: Column) -> dict[str, Column]:
    """angle, off (signed distance of the line from the origin) and the extent s0 to s1 along it."""
    a = angle(x1 - x0, y1 - y0)
    ux, uy = F.cos(a), F.sin(a)
    s, e = x0 * ux + y0 * uy, x1 * ux + y1 * uy
    return {"angle": a, "off": y0 * ux - x0 * uy, "s0": F.least(s, e), "s1": F.greatest(s, e)}


def run_family(dx: Column, dy: Column, degrees: float = 8.0) -> Column:
    """h, v or other; the bound itself is other."""
    a = F.degrees(angle(dx, dy))
    return F.when((a < degrees) | (a > 180 - degrees), "h").when(F.abs(a - 90) < degrees, "v").otherwise("other")


def in_box(x: Column, y: Column, box: tuple[Column, Column, Column, Column], pad: float = 0.0) -> Column:
    """Inside x0, y0, x1, y1 grown by ``pad``, edges included."""
    return x.between(box[0] - pad, box[2] + pad) & y.between(box[1] - pad, box[3] + pad)


def segment_distance(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Distance of a point from a segment; from its first end if the segment has no length."""
    vx, vy = x1 - x0, y1 - y0
    n = vx * vx + vy * vy
    t = F.when(n < 1e-9, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x0) * vx + (py - y0) * vy) / F.when(n < 1e-9, 1.0).otherwise(n))))
    ex, ey = px - x0 - t * vx, py - y0 - t * vy
    return F.sqrt(ex * ex + ey * ey)


def nonzero_segments(by_name: dict[str, Column]) -> Column:
    """Segments above 1e-6 in their fixed order, as an array; null counts as zero."""
    return F.filter(F.array(*[F.coalesce(by_name[k].cast("double"), F.lit(0.0)) for k in SEGMENTS if k in by_name]), lambda v: v > 1e-6)


def bent_length(segments: Column, dia_mm: Column, closed_tie: Column) -> Column:
    """Sum of segments in metres less two diameters a bend; a closed tie has 8 bends, else one between segments."""
    total = F.aggregate(segments, F.lit(0.0), lambda s, v: s + v)
    bends = F.when(closed_tie, F.lit(8)).otherwise(F.greatest(F.size(segments) - 1, F.lit(0)))
    return total - bends * 2 * (dia_mm / 1000.0)


def run_count(extent: Column, pitch: Column) -> Column:
    """Bars of a run; null without a positive pitch."""
    return F.when(pitch > 0, F.floor(extent / pitch) + 1)


def zigzag(segments: Column) -> Column:
    """Points (x, y) of a schematic line that turns left after each segment, from the origin."""
    def step(points: Column, at: Column) -> Column:
        last, d = F.element_at(points, -1), F.element_at(segments, at)
        turn = F.element_at(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in TURNS]), ((at - 1) % 4) + 1)
        return F.concat(points, F.array(F.struct((last.x + turn.x * d).alias("x"), (last.y + turn.y * d).alias("y"))))

    places = F.when(F.size(segments) > 0, F.sequence(F.lit(1), F.size(segments))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))), step)


def shape_family(shape: Column) -> Column:
    """Family of a shape code; null and empty are '?', other unknown codes bent_other."""
    known = F.create_map(*[F.lit(x) for x in chain(*FAMILY.items())])
    return F.when(F.coalesce(shape, F.lit("")) == "", "?").otherwise(F.coalesce(F.try_element_at(known, shape), F.lit("bent_other")))


def fused_confidence(views: Column, inside: Column) -> Column:
    """More views agree, more confidence, up to 0.98; outside the concrete it is cut to six tenths."""
    c = F.least(F.lit(0.98), F.lit(0.90) + F.lit(0.04) * (views - 1))
    return F.when(inside, c).otherwise(F.round(c * 0.6, 2))


#: Cover and the thickness taken where none is known, how near a leg comes to the clear thickness, how far a bar may exceed a panel.
COVER, THICKNESS, CLEAR, EXCESS = 30.0, 200.0, 18.0, 20.0


def bar_axes(legs: Column, length: Column, dia: Column, shape: Column, note: Column, thickness: Column, width: Column, height: Column) -> dict[str, Column]:
    """run and fold axis (X, Y or Z) of a bar in its panel, and whether it crosses the thickness.

    It does if it is noted as a U bar or link, has a tie's shape, or a leg equals the clear thickness; then it folds into Y,
    else into the plane. It runs along the side that its longest leg (its length, without legs) fits into with the least slack.
    """
    real = F.filter(legs, lambda v: v > 0)
    clear = F.when(F.coalesce(thickness, F.lit(0)) == 0, F.lit(THICKNESS)).otherwise(thickness) - 2 * (COVER + dia / 2)
    words = F.lower(F.coalesce(note, F.lit("")))
    through = F.exists(real, lambda v: F.abs(v - clear) <= CLEAR) | words.contains("u bar") | words.contains("link") | F.coalesce(shape, F.lit("")).startswith("M_T")
    long = F.coalesce(F.array_max(real), length)
    sides = [F.struct((side - long < -EXCESS).alias("over"), F.abs(side - long).alias("slack"), F.lit(axis).alias("axis")) for axis, side in (("X", width), ("Z", height))]
    run = F.array_min(F.array(*sides))["axis"]
    return {"run": run, "fold": F.when(through, "Y").when(run == "X", "Z").otherwise("X"), "through": through}


def in_panel(u: Column, v: Column, run: Column, fold: Column, origin: tuple[Column, Column, Column]) -> Column:
    """Point (x, y, z) of a point (u, v) of the bending plane: u along the run axis, v along the fold axis."""
    return F.struct(*[(o + F.when(run == a, u).otherwise(0.0) + F.when(fold == a, v).otherwise(0.0)).alias(a.lower()) for a, o in zip("XYZ", origin)])
