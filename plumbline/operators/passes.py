"""Model-building rules that are plain relations: depth look-ups, calibrations, drops, placements, evidence tests.

Rows with nulls in a compared column satisfy no range test; ties are broken as each docstring says; empty inputs give
empty results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import shared_folder, ship, stored
from .clustering import components, single_link
from .joins import LEAST_CELL, band_join, boxes_over_points, linked_in_cells, near_values


def depth_lookup(bars: DataFrame, readings: DataFrame, key: str, reach: float = 40.0, radius: float = 0.5, tol: float = 8.0, spread: float = 15.0) -> DataFrame:
    """bar, depth, n, sections, corroborated: readings of like radius near a bar's coordinate, in clusters of ``tol``.

    ``bars``: key, bar, coord, r; ``readings``: key, section, c, rr, z. The cluster with most readings counts, the
    lowest of several. It is corroborated by two sections, or if all readings lie within ``spread``.
    """
    near = band_join(bars, readings, [key], "coord", "c", -reach, reach).filter(F.abs(F.col("rr") - F.col("r")) <= radius)
    grouped = single_link(near, [key, "bar"], "z", tol)
    per = grouped.groupBy(key, "bar", "cluster").agg(F.avg("z").alias("depth"), F.count(F.lit(1)).alias("n"), F.countDistinct("section").alias("sections"))
    whole = near.groupBy(key, "bar").agg((F.max("z") - F.min("z")).alias("all_spread"))
    best = per.groupBy(key, "bar").agg(F.max_by(F.struct("depth", "n", "sections"), F.struct(F.col("n"), -F.col("cluster"))).alias("b"))
    return best.join(whole, [key, "bar"]).select(key, "bar", "b.depth", "b.n", "b.sections", ((F.col("b.sections") >= 2) | (F.col("all_spread") <= spread)).alias("corroborated"))


def elevation_candidates(views: DataFrame, sheet: str, share: float = 0.30, least: float = 300.0) -> DataFrame:
    """Views (w, h, bars, outline) with at least ``share`` of their sheet's largest number of bars, an outline, and no side below ``least``."""
    most = views.groupBy(sheet).agg(F.max("bars").alias("__most"))
    return views.join(most, sheet).filter((F.col("bars") >= share * F.col("__most")) & F.col("outline") & (F.least("w", "h") >= least)).drop("__most")


def outline_and_openings(loops: DataFrame, key: str, layers: list[str], share: float = 0.95) -> DataFrame:
    """key, outline, openings: the largest loop of the first layer that has any, and the number of closed loops below ``share`` of it."""
    rank = F.array_position(F.array(*[F.lit(x) for x in layers]), F.col("layer"))
    known = loops.withColumn("__rank", rank).filter("__rank > 0")
    first = known.groupBy(key).agg(F.min("__rank").alias("__first"))
    out = known.join(first, key).filter("__rank = __first").groupBy(key).agg(F.max("area").alias("outline"))
    inner = loops.filter("closed").join(out, key).groupBy(key).agg(F.sum((F.col("area") < share * F.col("outline")).cast("long")).alias("openings"))
    return out.join(inner, key, "left").select(key, "outline", F.coalesce("openings", F.lit(0)).alias("openings"))


def section_thickness(views: DataFrame, key: str, share: float = 0.5, near: float = 0.20) -> DataFrame:
    """key, thickness: median of the views' short sides that are at most ``share`` of the panel's.

    Without any, the median of the sides within ``near`` of the raw median, where two are; else null.
    ``views``: key, w, h, panel_w, panel_h.
    """
    t = views.withColumn("t", F.least("w", "h"))
    raw = t.groupBy(key).agg(F.median("t").alias("raw"), F.count("t").alias("readings"))
    marked = t.join(raw, key).withColumn("thin", F.col("t") <= share * F.least("panel_w", "panel_h")).withColumn("like", F.abs(F.col("t") - F.col("raw")) <= near * F.col("raw"))
    fall = F.when((F.first("readings") >= 2) & (F.sum(F.col("like").cast("int")) >= 2), F.median(F.when(F.col("like"), F.col("t"))))
    return marked.groupBy(key).agg(F.coalesce(F.median(F.when(F.col("thin"), F.col("t"))), fall).alias("thickness"))


def calibrate_on_count(bars: DataFrame, marks: DataFrame, key: str, kind: str) -> DataFrame:
    """bars (key, kind, dia, length) with ``scaled``: a kind's bars of a diameter take a mark's length if they are exactly as many as it asks for.

    ``marks``: key, dia, qty, len. Of several marks with that number the smallest length counts.
    """
    n = bars.filter(F.col("kind") == kind).groupBy(key, "dia").agg(F.count(F.lit(1)).alias("qty"))
    hit = n.join(marks.select(key, "dia", "qty", "len"), [key, "dia", "qty"]).groupBy(key, "dia").agg(F.min("len").alias("__len"))
    return bars.join(hit, [key, "dia"], "left").withColumn("scaled", F.when(F.col("kind") == kind, F.coalesce("__len", "length")).otherwise(F.col("length"))).drop("__len")


def calibrate_uniform(bars: DataFrame, marks: DataFrame, key: str, spread: float = 0.05, other: float = 0.10) -> DataFrame:
    """key, kind, dia, len: kinds whose bars are as many as a bent mark asks for, nearly alike, not yet of its length, and near no other mark's.

    ``marks``: key, mark, dia, qty, len, shape; straight shapes (M_00) don't count as targets but as others.
    """
    per = bars.groupBy(key, "kind", "dia").agg(F.count(F.lit(1)).alias("qty"), F.min("length").alias("lo"), F.max("length").alias("hi"), F.avg("length").alias("mean"))
    per = per.filter(F.col("hi") - F.col("lo") <= spread * F.col("mean"))
    hit = per.join(marks.filter("shape <> 'M_00'").select(key, "dia", "qty", "mark", "len"), [key, "dia", "qty"]).filter(F.abs(F.col("mean") - F.col("len")) > spread * F.col("len"))
    rest = marks.select(F.col(key).alias("__k"), F.col("dia").alias("__d"), F.col("mark").alias("__m"), F.col("len").alias("__l"))
    clash = (F.col(key) == F.col("__k")) & (F.col("dia") == F.col("__d")) & (F.col("mark") != F.col("__m")) & (F.abs(F.col("mean") - F.col("__l")) <= other * F.col("__l"))
    return hit.join(rest, clash, "left_anti").select(key, "kind", "dia", "mark", "len")


def drop_unscheduled_dowels(bars: DataFrame, marks: DataFrame, key: str, kind: str = "face-dowel", shape: str = "17A") -> DataFrame:
    """Bars less those of ``kind`` whose diameter is scheduled, but in no shape that contains ``shape``."""
    per = marks.groupBy(F.col(key).alias("__k"), F.col("dia").alias("__d")).agg(F.max(F.col("shape").contains(shape)).alias("__has")).filter("not __has")
    gone = (F.col(key) == F.col("__k")) & (F.col("dia") == F.col("__d")) & (F.col("kind") == kind)
    return bars.join(per, gone, "left_anti")


def dowel_only(marks: DataFrame, key: str) -> DataFrame:
    """key, dia: diameters whose every mark is a bent shape of two legs. ``marks``: key, dia, shape, legs."""
    return marks.groupBy(key, "dia").agg(F.bool_and((F.col("shape") != "M_00") & (F.col("legs") == 2)).alias("b")).filter("b").select(key, "dia")


def drop_unclaimed_ties(bars: DataFrame, marks: DataFrame, panels: DataFrame, key: str, slim: float = 4.0, share: float = 0.70, floor: float = 30.0, rel: float = 0.08) -> DataFrame:
    """Bars less the tie candidates of column-shaped panels (h at least ``slim`` times w and t): dowel-only diameters that
    span ``share`` of the width and have no mark's length."""
    slender = panels.filter((F.col("h") >= slim * F.col("w")) & (F.col("h") >= slim * F.col("t"))).select(key, "w")
    asked = bars.join(slender, key).join(dowel_only(marks, key), [key, "dia"], "left_semi").filter(F.col("length") >= share * F.col("w"))
    claimed = near_values(marks.select(key, "dia", F.col("len").alias("__l")), asked, [key, "dia"], "__l", "length", floor, rel).select(key, "dia", "length").distinct()
    gone = asked.join(claimed, [key, "dia", "length"], "left_anti").select("bar")
    return bars.join(gone, "bar", "left_anti")


def predicted_rows(texts: DataFrame, key: str, cover_m: float = 0.03) -> DataFrame:
    """key, kind, dia, n from the labels of a panel: ties once a pitch over the clear height of each run, crack and other bars as counted.

    ``texts``: key, text, height (mm); equal labels of a panel are instances of one. Labels of other forms give no row.
    """
    n = texts.filter(F.trim("text") != "").groupBy(key, F.trim("text").alias("text"), "height").agg(F.count(F.lit(1)).alias("inst"))
    tie, count = r"(?i)T(\d+)\s*TIES?\s*@\s*(\d+)", r"(?i)^(\d+)\s*-\s*T(\d+)\s*(.*)$"
    get = lambda p, i: F.regexp_extract("text", p, i).try_cast("int")
    run = F.col("height") / 1000 - 2 * cover_m
    ties = n.filter(F.col("text").rlike(tie)).select(key, F.lit("ties").alias("kind"), get(tie, 1).alias("dia"), (F.col("inst") * (F.floor(run / (get(tie, 2) / 1000) + 1e-9) + 1)).alias("n"))
    label = F.when(F.lower(F.regexp_extract("text", count, 3)).contains("crack"), "crack").otherwise("detail")
    bars = n.filter(~F.col("text").rlike(tie) & F.col("text").rlike(count)).select(key, label.alias("kind"), get(count, 2).alias("dia"), (F.col("inst") * get(count, 1)).cast("long").alias("n"))
    return ties.unionByName(bars).groupBy(key, "kind", "dia").agg(F.sum("n").alias("n"))


def grid_places(marks: DataFrame, lo: str, hi: str, qty: str) -> DataFrame:
    """One row a bar: ``place`` evenly from lo to hi (the middle for one bar). A quantity of 0, negative or null gives none."""
    n = F.col(qty)
    out = marks.filter(n > 0).withColumn("i", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))))
    step = F.when(n > 1, (F.col(hi) - F.col(lo)) / (n - 1))
    return out.withColumn("place", F.when(n > 1, F.col(lo) + F.col("i") * step).otherwise((F.col(lo) + F.col(hi)) / 2))


def mirror_fill(bars: DataFrame, key: str, x: str, width: str, tol: float = 15.0) -> DataFrame:
    """Bars with those that their mirror image lacks: ``mirrored`` marks the added ones; an image within ``tol`` of a bar adds none."""
    own = bars.withColumn("mirrored", F.lit(False))
    image = bars.withColumn("__x", F.col(width) - F.col(x))
    met = band_join(image.select(key, "__x").distinct(), bars.select(key, F.col(x).alias("__hx")).distinct(), [key], "__x", "__hx", -tol, tol).select(key, "__x").distinct()
    lacks = image.join(met, [key, "__x"], "left_anti")
    return own.unionByName(lacks.drop(x).withColumnRenamed("__x", x).withColumn("mirrored", F.lit(True)).select(*own.columns))


def dimension_evidence(absent: DataFrame, signals: DataFrame, key: str, low: float = 20.0, high: float = 15000.0, floor: float = 30.0, rel: float = 0.08) -> DataFrame:
    """Rows of ``absent`` (key, mark, len) for which a dimension or hatch extent (key, extent) of their key is within tolerance."""
    s = signals.filter((F.col("extent") > low) & (F.col("extent") < high)).select(key, F.col("extent").alias("__e"))
    return absent.join(near_values(absent, s, [key], "len", "__e", floor, rel).select(key, "len").distinct(), [key, "len"], "left_semi").select(*absent.columns)


def cross_view_clusters(circles: DataFrame, key: str, tol: float) -> DataFrame:
    """id, component of circles (key, id, view, dia, x, y) linked across different views of a key: same diameter, both axes within ``tol``.

    Only components that span two views are given. Circles are linked in cells by few pairs (see spanning_links), not by all. Ids are unique.
    Circles of one view at one place have the same links, so they are one: copies make no pairs. Nulls are linked with nothing.
    """
    place = [key, "dia", "view", "x", "y"]
    shared_folder(ship(circles.sparkSession))
    known = circles.select("id", *place).dropna()
    once = stored(known.groupBy(*place).agg(F.min("id").alias("id")), "circles")
    # equal views have equal numbers within a key; cells are four times as wide as the tolerance, so most circles lie in one
    views = once.select(key, "view").distinct().withColumn("__view", F.row_number().over(Window.partitionBy(key).orderBy("view")).cast("double"))
    own = once.join(views, [key, "view"]).select(key, "dia", "id", "__view", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    wide = 4 * max(tol, LEAST_CELL)
    cell = lambda c: F.floor(c / wide).cast("long")
    reach = lambda c: tol + 1e-9 * (F.abs(c) + tol)
    near = lambda c: F.explode(F.sequence(cell(F.col(c) - reach(c)), cell(F.col(c) + reach(c))))

    def meets(one: list, others: list) -> np.ndarray:
        return (others[0] != one[0]) & (np.abs(others[1] - one[1]) <= tol) & (np.abs(others[2] - one[2]) <= tol)

    held, asked = own.withColumns({"__cx": cell(F.col("x")), "__cy": cell(F.col("y"))}), own.withColumn("__cx", near("x")).withColumn("__cy", near("y"))
    edges = linked_in_cells(held, asked, [key, "dia", "__cx", "__cy"], ["__view", "x", "y"], meets)
    comp = components(once.select(F.col("id").alias("node")), edges)
    named = once.join(comp, F.col("id") == F.col("node"))
    wide = named.groupBy("component").agg(F.countDistinct("view").alias("views")).filter("views >= 2")
    linked = named.join(wide, "component").select(*place, "component", "views")
    return known.join(linked, place).select("id", "component", "views")


def first_containing_view(texts: DataFrame, views: DataFrame, key: str, margin: float) -> DataFrame:
    """texts (key, id, x, y) with ``view``: the first (by rank, then name) whose box (x0, y0, x1, y1), widened by ``margin``, holds them; null in none.

    Texts of one place ask once, and of views with the same box only the first takes part; both meet by cells of the box's level.
    """
    sides = ("__x0", "__y0", "__x1", "__y1")
    wide = [(F.col(c) + m).alias(f"__{c}") for c, m in (("x0", -margin), ("y0", -margin), ("x1", margin), ("y1", margin))]
    v = views.filter("rank is not null").select(key, F.struct("rank", "view").alias("__v"), *wide).groupBy(key, *sides).agg(F.min("__v").alias("__v"))
    places = texts.select(key, "x", "y").distinct()
    inside = F.col("x").between(F.col("__x0"), F.col("__x1")) & F.col("y").between(F.col("__y0"), F.col("__y1"))
    best = boxes_over_points(v, places, [key], sides, ("x", "y")).filter(inside).groupBy(key, "x", "y").agg(F.min("__v").alias("__v"))
    return texts.join(best, [key, "x", "y"], "left").select(*texts.columns, F.col("__v.view").alias("view"))


def fused_extent(clusters: DataFrame, runs: DataFrame, outlines: DataFrame, key: str, reach: float) -> DataFrame:
    """clusters (key, id, dia, x) with lo, hi and source: the nearest run of that diameter within ``reach``, else the outline of the key.

    ``runs``: key, dia, rx, lo, hi; of equally near ones the one with the smallest rx. ``outlines``: key, lo, hi.
    """
    r = runs.select(key, "dia", "rx", F.col("lo").alias("__lo"), F.col("hi").alias("__hi"))
    hit = band_join(clusters.select(key, "id", "dia", "x"), r, [key, "dia"], "x", "rx", -reach, reach)
    best = hit.groupBy("id").agg(F.min_by(F.struct("__lo", "__hi"), F.struct(F.abs(F.col("x") - F.col("rx")), F.col("rx"), F.col("__lo"))).alias("r"))
    o = outlines.select(key, F.col("lo").alias("__olo"), F.col("hi").alias("__ohi"))
    j = clusters.join(best, "id", "left").join(o, key, "left")
    return j.select(key, "id", F.coalesce("r.__lo", "__olo").alias("lo"), F.coalesce("r.__hi", "__ohi").alias("hi"), F.when(F.col("r").isNotNull(), "run").otherwise("outline").alias("source"))


def cut_extent(spans: DataFrame, cuts: DataFrame, key: str) -> DataFrame:
    """key, lo, hi, on_cut: of the merged spans (key, lo, hi) the longest that contains a cut (key, at), else the longest; ties to the lower."""
    w = Window.partitionBy(key).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    new = spans.withColumn("__new", F.coalesce(F.col("lo") > F.max("hi").over(w), F.lit(True)).cast("int"))
    no = new.withColumn("__no", F.sum("__new").over(Window.partitionBy(key).orderBy("lo", "hi")))
    merged = no.groupBy(key, "__no").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # merged spans are apart: a cut can only lie on the last one that begins before it
    both = merged.select(key, F.col("lo").alias("at"), "lo", "hi", F.lit(0).alias("__cut")).unionByName(cuts.filter("at is not null").select(key, "at", F.lit(1).alias("__cut")), allowMissingColumns=True)
    upto = Window.partitionBy(key).orderBy("at", "__cut").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumns({f"__{c}": F.last(c, ignorenulls=True).over(upto) for c in ("lo", "hi")}).filter("__cut = 0 or at <= __hi")
    held = seen.groupBy(key, F.col("__lo").alias("lo"), F.col("__hi").alias("hi")).agg((F.max("__cut") == 1).alias("on_cut"))
    best = F.max_by(F.struct("lo", "hi", "on_cut"), F.struct(F.col("on_cut"), F.col("hi") - F.col("lo"), -F.col("lo")))
    return held.groupBy(key).agg(best.alias("b")).select(key, "b.*")


def exact_hit(gaps: Column, sizes: list[float], reach: float = 0.35) -> Column:
    """The first gap of an array that is within ``reach`` of a standard size, and that size; null without one."""
    near = F.transform(gaps, lambda g: F.struct(g.alias("gap"), F.get(F.filter(F.array(*[F.lit(float(s)) for s in sizes]), lambda s: F.abs(g - s) < reach), F.lit(0)).alias("size")))
    return F.get(F.filter(near, lambda x: x["size"].isNotNull()), F.lit(0))


def drop_fragments(bars: DataFrame, marks: DataFrame, keys: list[str], share: float = 0.5) -> DataFrame:
    """Bars (keys, length) less those shorter than ``share`` of the least of the marks' longest segments of their keys (marks:
    keys, segments array). Keys hold the panel and the diameter; bars without a mark, and those of unknown length, stay."""
    floors = marks.groupBy(*keys).agg(F.min(F.array_max("segments")).alias("__floor"))
    return bars.join(floors, keys, "left").filter(F.coalesce(F.col("length") >= share * F.col("__floor"), F.lit(True))).drop("__floor")
