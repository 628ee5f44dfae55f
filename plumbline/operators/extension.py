"""What bindings leave open: marks carried on along a measured or a stated pitch, then to circles of sections.

Positions beyond a run follow from its ends, its pitch and the element's size, so they are counted, not walked. Only
the choice among the few pools of a diameter is sequential; it runs over counts, and circles join by their number.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import ship

#: Bars nearer than this are one, a pitch is no smaller, a gap is a multiple of it within this share, a
#: grid may stand out by this share of a pitch.
SAME, LEAST_PITCH, WHOLE, OVER = 15.0, 20.0, 0.12, 0.4


def true_pitch(steps: Column) -> Column:
    """The step of which all steps are near-integer multiples: the least, or a half to a sixth of it; the last that fits."""

    def fits(c: Column) -> Column:
        return F.forall(steps, lambda s: F.abs(s / c - F.rint(s / c)) < WHOLE)

    base = F.array_min(steps)
    tried = F.filter(F.transform(F.sequence(F.lit(1), F.lit(6)), lambda k: base / k), lambda c: (c >= LEAST_PITCH) & fits(c))
    return F.coalesce(F.try_element_at(tried, F.lit(-1)), base)


def _apart(sorted_: Column) -> Column:
    """Sorted values less those at most SAME above the last kept one."""
    keep = lambda kept, v: F.when(v - F.element_at(kept, -1) > SAME, F.concat(kept, F.array(v))).otherwise(kept)
    return F.aggregate(F.slice(sorted_, 2, F.greatest(F.size(sorted_), F.lit(1))), F.slice(sorted_, 1, 1), keep)


def _outward(low: Column, high: Column, pitch: Column, span: Column, need: Column) -> Column:
    """Places at the pitch below ``low``, then above ``high``, inside the span (OVER pitches of slack), ``need`` at most."""
    slack = OVER * pitch
    down = F.greatest(F.floor((low + slack) / pitch), F.lit(0))
    up = F.greatest(F.floor((span + slack - high) / pitch), F.lit(0))
    first = F.least(down, need).cast("int")
    second = F.greatest(F.least(up, need - first), F.lit(0)).cast("int")
    run = lambda n, at: F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), at)).otherwise(F.array().cast("array<double>"))
    return F.concat(run(first, lambda i: low - i * pitch), run(second, lambda i: high + i * pitch))


def _spans(elements: DataFrame, keys: list[str]) -> DataFrame:
    return elements.select(*keys, F.explode(F.array(F.struct(F.lit("v").alias("axis"), F.col("width").alias("span")), F.struct(F.lit("h").alias("axis"), F.col("height").alias("span")))).alias("s")).select(*keys, "s.axis", "s.span").filter("span > 0")


def pitch_extension(marks: DataFrame, taken: DataFrame, bars: DataFrame, elements: DataFrame, keys: list[str]) -> DataFrame:
    """keys, mark, axis, pitch, at, evidence: places of missing bars along the line that a mark's arrays set.

    marks: keys, mark, need; taken: keys, mark, array, n (arrays bound to it); bars: keys, array, axis, x, y (where each
    bar starts); elements: keys, width, height. The mark's largest array (ties by id) names the axis; the bars of all its arrays on that axis,
    rounded to 0.1 and those within SAME of the last kept one left out, set the steps, the steps the pitch (see
    true_pitch). Missing bars follow outwards, first below, then above, as far as the element goes. Marks with fewer
    than two places, no need, or a pitch below LEAST_PITCH are left alone. Nulls take no part.
    """
    own = taken.select(*keys, "mark", "array", "n").dropDuplicates([*keys, "mark", "array"])
    placed = bars.dropna(subset=["array", "axis"]).select(*keys, "array", "axis", F.round(F.when(F.col("axis") == "v", F.col("x")).otherwise(F.col("y")).cast("double"), 1).alias("at"))
    held = own.join(placed.dropna(subset=["at"]), [*keys, "array"])
    main = held.groupBy(*keys, "mark").agg(F.min(F.struct((-F.col("n")).alias("m"), "array", "axis")).alias("b")).select(*keys, "mark", F.col("b.axis").alias("axis"))
    places = held.join(main, [*keys, "mark", "axis"]).groupBy(*keys, "mark", "axis").agg(F.array_sort(F.collect_set("at")).alias("all"))
    kept = places.withColumn("kept", _apart(F.col("all"))).filter(F.size("kept") >= 2)
    stepped = kept.withColumn("steps", F.zip_with(F.slice("kept", 2, F.size("kept")), F.slice("kept", 1, F.size("kept") - 1), lambda b, a: b - a))
    pitched = stepped.withColumn("pitch", true_pitch(F.col("steps"))).filter(F.col("pitch") >= LEAST_PITCH)
    open_ = pitched.join(marks.filter("need > 0").select(*keys, "mark", "need"), [*keys, "mark"]).join(_spans(elements, keys), [*keys, "axis"])
    at = F.explode(_outward(F.col("kept")[0], F.element_at("kept", -1), F.col("pitch"), F.col("span"), F.col("need")))
    return open_.select(*keys, "mark", "axis", "pitch", at.alias("at"), F.lit("pitch_extended").alias("evidence"))


def note_pitch_extension(marks: DataFrame, notes: DataFrame, anchors: DataFrame, elements: DataFrame, keys: list[str]) -> DataFrame:
    """keys, mark, axis, pitch, at, evidence: places along the pitch that a note states for exactly this mark.

    marks: keys, mark, dia, qty, need; notes: keys, note, dia, qty, spacing; anchors: keys, mark, bar, axis, at (bars
    already placed). A note counts if diameter and quantity are the mark's; the first by ``note`` gives the pitch, the first
    bar the axis and the place from which the grid runs both ways. Pitches below LEAST_PITCH, marks without a bar or
    need, and nulls are left alone.
    """
    said = notes.filter("spacing is not null and spacing <> 0").groupBy(*keys, "dia", "qty").agg(F.min_by("spacing", "note").cast("double").alias("pitch")).filter(F.col("pitch") >= LEAST_PITCH)
    first = anchors.dropna(subset=["axis", "at"]).groupBy(*keys, "mark").agg(F.min(F.struct("bar", "axis", "at")).alias("b")).select(*keys, "mark", "b.axis", F.col("b.at").cast("double").alias("start"))
    open_ = marks.filter("need > 0").join(said, [*keys, "dia", "qty"]).join(first, [*keys, "mark"]).join(_spans(elements, keys), [*keys, "axis"])
    at = F.explode(_outward(F.col("start"), F.col("start"), F.col("pitch"), F.col("span"), F.col("need")))
    return open_.select(*keys, "mark", "axis", "pitch", at.alias("at"), F.lit("note_pitch_extended").alias("evidence"))


def section_pass(marks: DataFrame, circles: DataFrame, elements: DataFrame, keys: list[str]) -> DataFrame:
    """keys, mark, circle, sheet, kind, x0, y0, z0, x1, y1, z1: circles of sections that become bars of short marks.

    marks: keys, mark, dia, need, length; circles: keys, sheet, kind ('plan_cut': the bar runs in z, else in x), dia,
    circle, px, py; elements: keys, width, height, thickness. Marks of a diameter come by missing length, falling (ties by mark); those longer
    than 1.5 times the element's longest side plus 300 don't (no sides known: all do). Each takes from the pool (sheet, kind) with most circles
    left (ties by sheet, then kind), in order of circle. Nulls take no part; no circle is used twice.
    """
    ship(marks.sparkSession)
    side = F.greatest(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("width", "height", "thickness")])
    size = elements.groupBy(*keys).agg(F.max(side).alias("side"))
    open_ = marks.filter("need > 0").dropna(subset=["mark", "dia", "length"]).join(size, keys, "left").filter("coalesce(side, 0) = 0 or length <= side * 1.5 + 300").select(*keys, "dia", "mark", F.col("need").cast("long").alias("need"), F.col("length").cast("double").alias("length"))
    known = circles.dropna(subset=["sheet", "kind", "dia", "px", "py"])
    pools = known.groupBy(*keys, "dia", "sheet", "kind").agg(F.count(F.lit(1)).alias("n"))
    kinds = dict(open_.dtypes) | {c: t for c, t in pools.dtypes if c in ("sheet", "kind")}

    def share(m: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        left = {(r.sheet, r.kind): [r.n, 0] for r in p.sort_values(["sheet", "kind"]).itertuples()}
        rows = []
        for r in m.assign(missing=-m["need"] * m["length"]).sort_values(["missing", "mark"]).itertuples():
            best = max(left, key=lambda k: left[k][0] - left[k][1], default=None)
            if best is None or left[best][0] == left[best][1]:
                break
            take = min(r.need, left[best][0] - left[best][1])
            rows.append((*[getattr(r, k) for k in keys], r.dia, r.mark, *best, left[best][1] + 1, left[best][1] + take, r.length))
            left[best][1] += take
        return pd.DataFrame(rows, columns=[*keys, "dia", "mark", "sheet", "kind", "first", "last", "length"])

    ddl = ", ".join([*[f"{c} {kinds[c]}" for c in (*keys, "dia", "mark", "sheet", "kind")], "first long, last long, length double"])
    by = [*keys, "dia"]
    taken = open_.groupBy(*by).cogroup(pools.groupBy(*by)).applyInPandas(lambda m, p: share(m, p), ddl).withColumn("i", F.explode(F.sequence("first", "last")))
    pool = Window.partitionBy(*by, "sheet", "kind").orderBy("circle", "px", "py")
    met = taken.join(known.withColumn("i", F.row_number().over(pool).cast("long")), [*by, "sheet", "kind", "i"])
    cover, up = 30.0 + F.col("dia") / 2.0, F.col("kind") == "plan_cut"
    ends = [F.when(up, a).otherwise(b) for a, b in ((F.col("px"), cover), (F.col("py"), F.col("px")), (cover, F.col("py")), (F.col("px"), cover + F.col("length")), (F.col("py"), F.col("px")), (cover + F.col("length"), F.col("py")))]
    return met.select(*keys, "mark", "circle", "sheet", "kind", *[e.cast("double").alias(n) for e, n in zip(ends, ("x0", "y0", "z0", "x1", "y1", "z1"))])
