"""Bars that drawings only imply: ties over stretches that two main bars share, hairpins at free ends, column ties.

Stretches covered by several bars are found by sums of events along an axis. What remains greedy is over the few
stacks of a panel.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import ship
from .clustering import anchor_groups, interval_union, single_link
from .joins import band_join


def prevailing(callouts: DataFrame, key: str) -> DataFrame:
    """key, dia, pitch, n: the most frequent callout (key, dia, pitch) of each panel; of equally frequent ones the smallest."""
    counts = callouts.dropna(subset=["dia", "pitch"]).groupBy(key, "dia", "pitch").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("m"), "dia", "pitch")).alias("b"))
    return best.select(key, "b.dia", "b.pitch", (-F.col("b.m")).alias("n"))


def covered(spans: DataFrame, keys: list[str], least) -> DataFrame:
    """(keys, lo, hi): stretches of positive length that at least ``least`` spans (keys, lo, hi) cover.

    ``least``: a number, or a column of the spans, the same over a key. Spans without length cover nothing. The
    events of a key pass one window, sorted; equal places are summed before it.
    """
    need = F.lit(least) if isinstance(least, int) else F.first(least)
    known = spans.filter("lo < hi")
    needs = known.groupBy(*keys).agg(need.alias("__need"))
    events = known.select(*keys, F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(1).alias("d")), F.struct(F.col("hi").alias("at"), F.lit(-1).alias("d")))).alias("e"))
    sums = events.groupBy(*keys, "e.at").agg(F.sum("e.d").alias("d"))
    along = Window.partitionBy(*keys).orderBy("at")
    deep = sums.withColumn("depth", F.sum("d").over(along)).withColumn("until", F.lead("at").over(along)).join(needs, keys).filter(F.col("depth") >= F.col("__need"))
    return interval_union(deep.select(*keys, F.col("at").alias("lo"), F.col("until").alias("hi")), keys, "lo", "hi").select(*keys, "lo", "hi")


def tie_stacks(bars: DataFrame, callouts: DataFrame, key: str, reach: float = 160.0) -> DataFrame:
    """key, a, b, dia, pitch, runs array<struct<lo, hi>>, covered: pairs of main bars that ties wrap.

    bars: key, dia, x, lo, hi (upright meshes); callouts: key, dia, pitch, one for each "Ties" instance. Main bars are
    at least 12 and thicker than the prevailing tie. Bars at one x (rounded) are united where they are at most 1 apart. Neighbouring x at
    most ``reach`` apart are a pair if they share stretches longer than two pitches. Pairs are taken by what they share, falling
    (ties to the left), each x once, as many as the callout has instances. Nulls take no part.
    """
    tie = prevailing(callouts, key)
    main = bars.dropna(subset=["x", "lo", "hi", "dia"]).join(tie.select(key, F.col("dia").alias("tie"), "pitch", "n"), key).filter("dia >= 12 and dia > tie")
    spans = interval_union(main.select(key, F.round("x", 0).alias("x"), "lo", "hi"), [key, "x"], "lo", "hi", 1).select(key, "x", "lo", "hi")
    beside = Window.partitionBy(key).orderBy("x")
    pairs = spans.select(key, "x").distinct().withColumn("b", F.lead("x").over(beside)).filter(F.col("b") - F.col("x") <= reach).select(key, F.col("x").alias("a"), "b")
    both = pairs.join(spans.select(key, F.col("x").alias("a"), "lo", "hi"), [key, "a"]).unionByName(pairs.join(spans.select(key, F.col("x").alias("b"), "lo", "hi"), [key, "b"]).select(key, "a", "b", "lo", "hi"))
    runs = covered(both, [key, "a", "b"], 2).join(tie.select(key, "dia", "pitch", "n"), key).filter(F.col("hi") - F.col("lo") > 2 * F.col("pitch"))
    scored = runs.groupBy(key, "a", "b", "dia", "pitch", "n").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("runs"), F.sum(F.col("hi") - F.col("lo")).alias("covered"))
    # pairs can only compete along a chain of near bars
    chains = single_link(scored.select(key, F.col("a").alias("x")), [key], "x", reach, "chain").select(key, F.col("x").alias("a"), "chain").distinct()
    kinds = dict(scored.dtypes)

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        used, keep = set(), []
        for r in pdf.sort_values(["covered", "a"], ascending=[False, True]).itertuples():
            if not used & {r.a, r.b}:
                used |= {r.a, r.b}
                keep.append(r.Index)
        return pdf.loc[keep].drop(columns="chain")

    ship(bars.sparkSession)
    ddl = ", ".join(f"{c} {kinds[c]}" for c in (key, "a", "b", "dia", "pitch", "n", "runs", "covered"))
    columns = [key, "a", "b", "dia", "pitch", "n", "runs", "covered"]
    free = scored.join(chains, [key, "a"]).select(*columns, "chain").groupBy(key, "chain").applyInPandas(lambda pdf: take(pdf)[columns], ddl)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("covered"), "a"))
    return free.withColumn("__r", rank).filter(F.col("__r") <= F.col("n")).drop("__r", "n")


def place_ties(stacks: DataFrame, panels: DataFrame, key: str, cover: float = 30.0) -> DataFrame:
    """key, dia, x_lo, x_hi, y, loop_mm: closed loops with two tails of 80, at the pitch along each stack's runs.

    panels: key, width, height, thickness. Runs are cut to the panel less its cover; each holds one tie at least.
    """
    run = stacks.join(panels.select(key, "height", "thickness"), key).withColumn("r", F.explode("runs"))
    lo, hi = F.greatest(F.col("r.lo"), F.lit(cover)), F.least(F.col("r.hi"), F.col("height") - cover)
    n = F.greatest(F.floor((hi - lo) / F.col("pitch")).cast("int") + 1, F.lit(1))
    ys = F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda k: lo + k * F.col("pitch")))
    deep, wide = F.col("thickness") - 2 * cover, F.col("x_hi") - F.col("x_lo")
    return run.select(key, "dia", (F.col("a") - cover).alias("x_lo"), (F.col("b") + cover).alias("x_hi"), ys.alias("y"), "thickness").withColumn("loop_mm", 2 * wide + deep + 160.0).drop("thickness")


def hairpins(bars: DataFrame, ubars: DataFrame, callouts: DataFrame, panels: DataFrame, key: str, cover: float = 30.0, leg: float = 400.0) -> DataFrame:
    """key, x, y, way, dia: hairpins that close the free ends of bars on several faces.

    bars: key, dia, x, z, lo, hi (upright meshes); ubars: key, x, y (those detected); callouts: key, dia, pitch; panels:
    key, height. Of the prevailing diameter, bars at one x (rounded) on two depths (rounded) or more: a stretch that
    all depths cover (each united where it is at most 5 apart) has a hairpin at both ends, its leg pointing inwards
    (way 1: up). It is left out if a detected one is nearer than 120 in x and 200 in y, if the end is outside the
    panel, or if its leg, from the end moved into the cover, would leave it. Nulls take no part.
    """
    dia = prevailing(callouts, key).select(key, "dia")
    mine = bars.dropna(subset=["x", "z", "lo", "hi"]).join(dia, [key, "dia"]).select(key, "dia", F.round("x", 0).alias("x"), F.round("z", 0).alias("z"), "lo", "hi")
    faces = mine.groupBy(key, "dia", "x").agg(F.countDistinct("z").alias("faces")).filter("faces >= 2")
    spans = interval_union(mine, [key, "dia", "x", "z"], "lo", "hi", 5).join(faces, [key, "dia", "x"])
    common = covered(spans, [key, "dia", "x"], "faces")
    ends = common.select(key, "dia", "x", F.explode(F.array(F.struct(F.col("lo").alias("y_end"), F.lit(1).alias("way")), F.struct(F.col("hi").alias("y_end"), F.lit(-1).alias("way")))).alias("e")).select(key, "dia", "x", "e.*")
    seen = ubars.dropna(subset=["x", "y"]).select(key, F.col("x").alias("ux"), F.col("y").alias("uy"))
    near = band_join(ends, seen, [key], "x", "ux", -120.0, 120.0).filter((F.abs(F.col("ux") - F.col("x")) < 120) & (F.abs(F.col("uy") - F.col("y_end")) < 200)).select(key, "dia", "x", "y_end", "way").distinct()
    free = ends.join(near, [key, "dia", "x", "y_end", "way"], "left_anti").join(panels.select(key, "height"), key)
    y = F.least(F.greatest("y_end", F.lit(cover)), F.col("height") - cover)
    inside = F.col("y_end").between(0, F.col("height")) & (y + leg * F.col("way")).between(0, F.col("height"))
    return free.filter(inside).select(key, "x", y.alias("y"), "way", "dia")


def column_ties(bars: DataFrame, straight: DataFrame, panels: DataFrame, key: str, cover: float = 40.0, apart: float = 20.0) -> DataFrame:
    """key, dia, y, x_lo, x_hi, z_lo, z_hi, n: ties around slim columns, one for each level of lines across.

    bars: key, id, dia, z_source, x0, x1, y, length (level meshes); straight: key, dia, length of straight marks;
    panels: key, width, height, thickness. Only panels at least four times as high as wide and as thick, wider and
    thicker than twice the cover. Lines whose depth is ``plane-snap`` or ``default``, over 70 % of the clear width, and
    of no straight mark's length (max(30, 8 %)), are ties; levels at most ``apart`` above a tie's first belong to it.
    """
    slim = panels.filter((F.col("height") >= 4 * F.col("width")) & (F.col("height") >= 4 * F.col("thickness")) & (F.col("width") > 2 * cover) & (F.col("thickness") > 2 * cover))
    lines = bars.join(slim.select(key, "width"), key).filter(F.col("z_source").isin("plane-snap", "default") & (F.abs(F.col("x1") - F.col("x0")) >= 0.7 * (F.col("width") - 2 * cover)))
    cell = lambda v: F.floor(F.log(F.greatest(v, F.lit(1.0))) * 8)
    tol = F.greatest(F.lit(30.0), 0.08 * F.col("__t"))
    marks = straight.select(key, "dia", F.col("length").alias("__t")).filter("__t is not null").distinct()
    marks = marks.withColumn("__c", F.explode(F.sequence(cell(F.col("__t") - tol), cell(F.col("__t") + tol))))
    real = lines.select(key, "dia", "id", "length", cell(F.col("length")).alias("__c")).join(marks, [key, "dia", "__c"]).filter(F.abs(F.col("length") - F.col("__t")) <= tol).select(key, "id").distinct()
    levels = anchor_groups(lines.join(real, [key, "id"], "left_anti"), [key, "dia"], "y", apart)
    return levels.join(slim.select(key, "width", "thickness"), key).select(key, "dia", F.col("anchor").alias("y"), F.lit(cover).alias("x_lo"), (F.col("width") - cover).alias("x_hi"), F.lit(cover).alias("z_lo"), (F.col("thickness") - cover).alias("z_hi"), "n")
