"""Views brought into one frame: senses and offsets by votes, cut stations from markers, outlines of views."""

from __future__ import annotations

from bisect import bisect_left
from math import dist, inf

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import ship
from .dealing import in_groups
from .joins import band_join


def view_senses(points: DataFrame, runs: DataFrame, views: DataFrame, sheet: str, tol: float = 3.0) -> DataFrame:
    """sheet, view, ahead, back, sense, confidence: does a section read as the elevation does, or mirrored?

    points: sheet, view, id, dia, u; runs: sheet, dia, at; views: sheet, view, span. A point agrees if a run of its
    diameter lies within ``tol`` of u (ahead) or of span - u (back). Sense is 1 unless more agree back. Confidence:
    |ahead - back| / (ahead + back), 0 if none agrees, rounded to 2 places. Views without points have none; nulls
    never agree.
    """
    p = points.select(sheet, "view", "id", "dia", "u").join(views.select(sheet, "view", "span"), [sheet, "view"])
    both = p.select(sheet, "view", "id", "dia", F.explode(F.array(F.struct(F.lit(1).alias("way"), F.col("u").cast("double").alias("v")), F.struct(F.lit(-1).alias("way"), (F.col("span") - F.col("u")).cast("double").alias("v")))).alias("s")).select(sheet, "view", "id", "dia", "s.way", "s.v")
    seen = runs.filter("at is not null").select(sheet, "dia", F.col("at").cast("double").alias("at")).distinct()
    hits = band_join(both, seen, [sheet, "dia"], "v", "at", -tol, tol).select(sheet, "view", "id", "way").distinct()
    sums = hits.groupBy(sheet, "view").agg(F.count(F.when(F.col("way") == 1, 1)).alias("ahead"), F.count(F.when(F.col("way") == -1, 1)).alias("back"))
    out = views.select(sheet, "view").join(sums, [sheet, "view"], "left").select(sheet, "view", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("ahead", "back")])
    total = F.col("ahead") + F.col("back")
    return out.withColumn("sense", F.when(F.col("ahead") >= F.col("back"), 1).otherwise(-1)).withColumn("confidence", F.when(total == 0, 0.0).otherwise(F.round(F.abs(F.col("ahead") - F.col("back")) / total, 2)))


def offset_votes(points: DataFrame, runs: DataFrame, sheet: str, cell: float = 5.0) -> DataFrame:
    """sheet, view, sense, offset, votes: where a view best lies on the elevation, of unknown origin and sense.

    points: sheet, view, class, u; runs: sheet, class, at. Coordinates are counted in cells of ``cell`` first; a cell of
    the view and one of the elevation, of one class, vote for their offset, at - u or at + u, with the smaller of both
    counts. So votes are bounded by occupied cells, not by rows. The best of each view has most votes, ties to sense 1,
    then the smallest |offset|, then the smaller. Offsets are the lower bounds of cells. Nulls don't vote.
    """
    at = lambda c: F.floor(F.col(c) / cell).cast("long")
    mine = points.filter("u is not null").groupBy(sheet, "view", "class", at("u").alias("i")).agg(F.count(F.lit(1)).alias("n"))
    held = runs.filter("at is not null").groupBy(sheet, "class", at("at").alias("j")).agg(F.count(F.lit(1)).alias("m"))
    both = mine.join(held, [sheet, "class"]).withColumn("w", F.least("n", "m")).withColumn("way", F.explode(F.array(F.lit(1), F.lit(-1))))
    offset = F.when(F.col("way") == 1, F.col("j") - F.col("i")).otherwise(F.col("j") + F.col("i") + 1)
    votes = both.groupBy(sheet, "view", "way", offset.alias("o")).agg(F.sum("w").alias("votes"))
    best = votes.groupBy(sheet, "view").agg(F.min(F.struct((-F.col("votes")).alias("v"), (-F.col("way")).alias("w"), F.abs("o").alias("d"), "o")).alias("b"))
    return best.select(sheet, "view", (-F.col("b.w")).alias("sense"), (F.col("b.o") * cell).alias("offset"), (-F.col("b.v")).alias("votes"))


def cut_stations(stubs: DataFrame, numbers: DataFrame, sheet: str, reach: float = 1500.0) -> DataFrame:
    """sheet, number, axis, station, distance: numbered cut lines, from the pairs of stubs that mark their ends.

    stubs: sheet, axis ('Z' or 'X'), station, other; numbers: sheet, number, x, y. Stubs of one axis at one station
    (to 0.1) are a cut line if there are two at least. Its number is the nearest: distance to the station, plus 0.15
    of the distance to the nearer stub along the line; beyond ``reach`` it has none. A number labels one cut, the first
    by axis and station. Ties go to the smaller number. Nulls are left out.

    A cut looks from its station outwards, so its work does not grow with the numbers farther away than the best.
    """
    lines = stubs.dropna(subset=["station", "other"]).groupBy(sheet, "axis", F.round("station", 1).alias("station")).agg(F.collect_set("other").alias("others"), F.count(F.lit(1)).alias("n")).filter("n >= 2")
    # a number lies within reach of its station: bands of four reaches, in up to two of which a number stands, part a sheet
    n, wide = numbers.dropna(subset=[sheet, "number", "x", "y"]), 4 * reach
    band = lambda c: F.floor(c / wide).cast("long")
    sides = n.select(sheet, "number", F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(v).cast("double").alias("at"), F.col(u).cast("double").alias("along")) for a, v, u in (("Z", "y", "x"), ("X", "x", "y"))])).alias("s")).select(sheet, "s.axis", "number", "s.at", "s.along")
    held = sides.withColumn("band", F.explode(F.sequence(band(F.col("at") - reach), band(F.col("at") + reach)))).withColumn("side", F.lit(0))
    asked = lines.filter(F.col(sheet).isNotNull()).select(sheet, "axis", F.col("station").cast("double").alias("at"), F.array_sort(F.col("others").cast("array<double>")).alias("others"), band(F.col("station")).alias("band"), F.lit(1).alias("side"))
    both = held.unionByName(asked, allowMissingColumns=True).select(sheet, "axis", "band", "side", "at", "along", "number", "others")

    def nearest(rows: list[tuple]) -> list[tuple]:
        known = [r[4:7] for r in rows if not r[3]]
        at, out = [v for v, _, _ in known], []
        for key, axis, _, side, station, _, _, others in rows:
            if not side:
                continue
            i = bisect_left(at, station)
            j, best = i - 1, (reach, None)
            while True:
                # from the station outwards, until the distance across alone is more than the best
                low, high = station - at[j] if j >= 0 else inf, at[i] - station if i < len(at) else inf
                if min(low, high) > best[0]:
                    break
                if low <= high:
                    v, along, number = known[j]
                    j -= 1
                else:
                    v, along, number = known[i]
                    i += 1
                k = bisect_left(others, along)
                d = abs(v - station) + 0.15 * min(abs(along - o) for o in others[max(k - 1, 0) : k + 1])
                if d <= reach and (best[1] is None or (d, number) < best):
                    best = (d, number)
            if best[1] is not None:
                out.append((key, axis, station, *best))
        return out

    kinds = dict(n.dtypes) | dict(lines.dtypes)
    best = in_groups(both, [sheet, "axis", "band"], ["side", "at"], nearest, f"`{sheet}` {kinds[sheet]}, axis string, station double, d double, number {kinds['number']}")
    first = F.row_number().over(Window.partitionBy(sheet, "number").orderBy("axis", "station"))  # a number's few cuts
    return best.withColumn("r", first).filter("r = 1").select(sheet, "number", "axis", "station", F.col("d").alias("distance"))


def thickness_flips(points: DataFrame, sheet: str) -> DataFrame:
    """sheet, flip: do end cuts measure the thickness the other way than plan cuts?

    points: sheet, kind ('plan_cut' or 'end_cut'), y, thickness. Of the points within the thickness, both kinds' means
    must be more than 2 off the middle and on different sides of it. Sheets lacking a kind don't flip.
    """
    inside = points.filter("y between 0 and thickness")
    mean = lambda k: F.avg(F.when(F.col("kind") == k, F.col("y") - F.col("thickness") / 2))
    m = points.select(sheet).distinct().join(inside.groupBy(sheet).agg(mean("plan_cut").alias("a"), mean("end_cut").alias("b")), sheet, "left")
    return m.select(sheet, F.coalesce((F.abs("a") > 2) & (F.abs("b") > 2) & (F.col("a") * F.col("b") < 0), F.lit(False)).alias("flip"))


def _bins(width: Column) -> Column:
    return F.greatest(F.lit(60), F.least(F.lit(1200), (width / 3).cast("int")))


def walk_profile(x0: float, step: float, cells: list[tuple]) -> list[tuple]:
    """The closed outline of a profile (bin, top, bottom), bins one after another: along the top, back along the bottom.

    A level lasts while the next bin's differs by less than 1 from the level at which it began; points on a straight
    line and repeated points are left out.
    """

    def side(at: int) -> list[tuple]:
        out: list[tuple] = []
        for cell in cells:
            left, right, y = x0 + cell[0] * step, x0 + (cell[0] + 1) * step, cell[at]
            if out and abs(out[-1][1] - y) < 1.0:
                out[-1] = (right, out[-1][1])
            else:
                out += [(left, y), (left, y), (right, y)] if out else [(left, y), (right, y)]
        return out

    ring: list[tuple] = []
    for p in side(1) + side(2)[::-1]:
        if not ring or dist(ring[-1], p) >= 0.5:
            ring.append(p)
    kept = []
    for i, p in enumerate(ring):
        a, b = ring[i - 1], ring[(i + 1) % len(ring)]
        if abs((p[0] - a[0]) * (b[1] - a[1]) - (p[1] - a[1]) * (b[0] - a[0])) >= 1e-6:
            kept.append((round(p[0], 2), round(p[1], 2)))
    return kept


def longest_row(size: np.ndarray, at: np.ndarray, top: np.ndarray, bottom: np.ndarray) -> list[tuple]:
    """(bin, top, bottom) of the longest row of neighbouring bins at least 1 high, the first of equal ones; none: empty.

    Blocks of 2 ** size bins from ``at`` on have a highest and a lowest edge; larger ones hand theirs to both halves.
    """
    end = int(max(at + (1 << size)))
    high, low = np.full(end, -np.inf), np.full(end, np.inf)
    for s in range(int(max(size)), -1, -1):
        if s < max(size):
            half = 1 << s
            high[half:] = np.maximum(high[half:], high[: end - half].copy())
            low[half:] = np.minimum(low[half:], low[: end - half].copy())
        here = size == s
        np.maximum.at(high, at[here], top[here])
        np.minimum.at(low, at[here], bottom[here])
    good = np.flatnonzero(high - low >= 1)
    rows = np.split(good, np.flatnonzero(np.diff(good) > 1) + 1)
    return [(int(b), float(high[b]), float(low[b])) for b in max(rows, key=len)]


def view_outlines(segments: DataFrame, keys: list[str], min_run: float = 25.0) -> DataFrame:
    """keys, points, area: the rectilinear outline of each view, steps and notches included.

    segments: keys, x1, y1, x2, y2. The width of all segments is cut into bins of about 3 (60 to 1200 of them); level
    segments (2 of slack) of ``min_run`` give each bin they cover its highest and lowest edge; the
    longest row of bins at least 1 high, the first of equal ones, is walked as a polygon: 1200 bins at most a view,
    however many segments it has. Views of no width or without such bins give no row; null coordinates are left out.

    A segment's bins are the union of two blocks of one power of two, so it is two rows and not as many as it has bins; a
    view has 13,000 different blocks at most, from which its bins' edges follow when it is walked.
    """
    ship(segments.sparkSession)
    known = segments.dropna(subset=["x1", "y1", "x2", "y2"])
    frame = known.groupBy(*keys).agg(F.min(F.least("x1", "x2")).alias("x0"), (F.max(F.greatest("x1", "x2")) - F.min(F.least("x1", "x2"))).alias("w")).filter("w > 0")
    frame = frame.withColumn("bins", _bins(F.col("w"))).withColumn("step", F.col("w") / F.col("bins"))
    level = known.filter((F.abs(F.col("y1") - F.col("y2")) <= 2.0) & (F.abs(F.col("x1") - F.col("x2")) >= min_run)).join(frame, keys)
    place = lambda x, half: F.greatest(F.lit(0), F.least(F.col("bins") - 1, ((x - F.col("x0")) / F.col("step") + half).cast("int")))
    held = level.select(*keys, "x0", "step", ((F.col("y1") + F.col("y2")) / 2).alias("y"), place(F.least("x1", "x2"), 0.5).alias("low"), place(F.greatest("x1", "x2"), -0.5).alias("high")).filter("low <= high")
    size = F.floor(F.log2(F.col("high") - F.col("low") + 1.5)).cast("int")
    sized = held.withColumn("size", size).withColumn("last", F.col("high") - F.expr("shiftleft(1, size)") + 1)
    blocks = sized.select(*keys, "x0", "step", "y", "size", F.explode(F.array_distinct(F.array("low", "last"))).alias("at"))
    edges = blocks.groupBy(*keys, "x0", "step", "size", "at").agg(F.max("y").alias("top"), F.min("y").alias("bottom"))
    views = edges.groupBy(*keys, "x0", "step").agg(*[F.collect_list(c).alias(c) for c in ("size", "at", "top", "bottom")])

    def walk(batches):
        for pdf in batches:
            rings = [walk_profile(x0, step, longest_row(*blocks)) for x0, step, *blocks in zip(*(pdf[c] for c in ("x0", "step", "size", "at", "top", "bottom")))]
            out = pdf[keys].copy()
            out["points"] = [[{"x": x, "y": y} for x, y in r] for r in rings]
            out["area"] = [abs(sum(x * v - u * y for (x, y), (u, v) in zip(r, r[1:] + r[:1]))) / 2 for r in rings]
            yield pd.DataFrame(out)[[bool(r) for r in rings]]

    kinds = dict(views.dtypes)
    return views.mapInPandas(walk, ", ".join([*[f"{k} {kinds[k]}" for k in keys], "points array<struct<x:double,y:double>>, area double"]))


#: A section view agrees with its elevation within this, is slimmer than this share, and depths are pooled by buckets of this.
POSITION_TOL, SLIM, BUCKET = 20.0, 0.3, 30.0


def section_views(views: DataFrame, elevations: DataFrame, key: str, tol: float = POSITION_TOL) -> DataFrame:
    """key, view, way, x0, y0, x1, y1: outlines beside an elevation that are cuts of it.

    views: key, view, x0, y0, x1, y1; elevations: key and the same sides, one of each key. Outlines inside the elevation (1 of slack) are part
    of it. ``vertical``: the elevation's range in y, within ``tol`` at both ends, and narrower than 0.3 of its height; else
    ``horizontal``: its width, within three times ``tol``, and lower than 0.3 of it. Others, and those with nulls, are left out.
    """
    e = elevations.select(key, *[F.col(c).alias(f"e{c}") for c in ("x0", "y0", "x1", "y1")])
    v = views.join(e, key)
    inside = (F.col("x0") >= F.col("ex0") - 1) & (F.col("x1") <= F.col("ex1") + 1) & (F.col("y0") >= F.col("ey0") - 1) & (F.col("y1") <= F.col("ey1") + 1)
    w, h, ew, eh = (F.col(b) - F.col(a) for a, b in (("x0", "x1"), ("y0", "y1"), ("ex0", "ex1"), ("ey0", "ey1")))
    upright = (F.abs(F.col("y0") - F.col("ey0")) < tol) & (F.abs(F.col("y1") - F.col("ey1")) < tol) & (w < SLIM * eh)
    level = (F.abs(w - ew) < 3 * tol) & (h < SLIM * ew)
    return v.filter(~inside).withColumn("way", F.when(upright, "vertical").when(level, "horizontal")).filter("way is not null").select(key, "view", "way", "x0", "y0", "x1", "y1")


def depth_pairs(circles: DataFrame, sections: DataFrame, elevations: DataFrame, key: str) -> DataFrame:
    """key, family, bucket, dia, front, back, n: how deep bars lie, from their circles in section views.

    circles: key, view, x, y, dia; sections: of section_views; elevations: key, x0, x1 (and more). A vertical cut tells the depth of level
    bars (family ``h``, bucket y / 30), as the share of its width; a horizontal one that of upright bars (``v``), as the share of its height,
    its x (to 30) carried over to the elevation's. Shares of one bucket and diameter below one half are the front, the
    others the back, by their means; without both, front is the mean of all and back null. Views without depth tell nothing.
    """
    s = sections.join(elevations.select(key, F.col("x0").alias("ex0"), (F.col("x1") - F.col("x0")).alias("ew")), key)
    c = circles.select(key, "view", F.col("x").alias("cx"), F.col("y").alias("cy"), "dia").join(s, [key, "view"]).filter("cx between x0 and x1 and cy between y0 and y1")
    w, h, up = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("way") == "vertical"
    there = F.col("ex0") + (F.rint(F.col("cx") / BUCKET) * BUCKET - F.col("x0")) / w * F.col("ew")
    told = c.filter(F.when(up, w > 0).otherwise((h > 0) & (w > 0))).select(key, F.when(up, "h").otherwise("v").alias("family"), F.rint(F.when(up, F.col("cy")).otherwise(there) / BUCKET).cast("long").alias("bucket"), "dia", F.when(up, (F.col("cx") - F.col("x0")) / w).otherwise((F.col("cy") - F.col("y0")) / h).alias("f"))
    # decimals sum to the same in any order; doubles turn a mean that ends in a 5 now up, now down
    mean = lambda c: F.sum(F.when(c, F.col("f").cast("decimal(38,18)"))).cast("double") / F.count(F.when(c, 1))
    low, high = mean(F.col("f") < 0.5), mean(F.col("f") >= 0.5)
    sums = told.groupBy(key, "family", "bucket", "dia").agg(low.alias("low"), high.alias("high"), F.count(F.lit(1)).alias("n"))
    both = F.col("low").isNotNull() & F.col("high").isNotNull()
    return sums.select(key, "family", "bucket", "dia", F.coalesce("low", "high").alias("front"), F.when(both, F.col("high")).alias("back"), "n")
