"""Tolerance, band, radius, overlap and nearest joins as bucketed equi-joins.

A bare range predicate would become a nested loop. Here one side is exploded into the neighbouring buckets
of its value, the join is on key and bucket, and the exact predicate filters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dealing import in_groups, in_tables

#: Pairs that a worker holds at once.
PAIRS = 1 << 20
#: Cells are no smaller than this, where a gap or radius is 0.
LEAST_CELL = 1e-6


def band_join(left: DataFrame, right: DataFrame, keys: list[str], x: str, y: str, low: float, high: float) -> DataFrame:
    """Pairs with equal keys and y - x between low and high (both included)."""
    width = max(high - low, 1e-9)
    l = left.withColumn("__b", F.floor((F.col(x) + low) / width).cast("long")).withColumn("__b", F.explode(F.array(F.col("__b"), F.col("__b") + 1)))
    r = right.withColumn("__b", F.floor(F.col(y) / width).cast("long"))
    return l.join(r, [*keys, "__b"]).filter((F.col(y) - F.col(x) >= low) & (F.col(y) - F.col(x) <= high)).drop("__b")


def near_values(owner: DataFrame, other: DataFrame, keys: list[str], x: str, y: str, floor: float, rel: float) -> DataFrame:
    """Distinct (keys, x, y) with equal keys and y within max(floor, rel * x) of x; ``owner`` has x, ``other`` y; nulls have no partner.

    Values meet by cells of their logarithm, which suit a tolerance that grows with the value.
    """
    def cell(v: Column) -> Column:
        return F.floor(F.log(F.greatest(v, F.lit(1.0))) * 8)

    tol = F.greatest(F.lit(float(floor)), rel * F.col(x))
    asked = owner.filter(F.col(x).isNotNull()).select(*keys, x).distinct().withColumn("__c", F.explode(F.sequence(cell(F.col(x) - tol), cell(F.col(x) + tol))))
    held = other.filter(F.col(y).isNotNull()).select(*keys, y).distinct().withColumn("__c", cell(F.col(y)))
    return asked.join(held, [*keys, "__c"]).filter(F.abs(F.col(y) - F.col(x)) <= tol).select(*keys, x, y)


def spanning_links(n: int, m: int, meets: Callable[[int, int, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of n left and m right things that join all that any chain of pairs joins, each thing being found once.

    ``meets(side, k, others)``: which of the others, of the other side, the k-th of this side (0: left) makes a pair with. Only things not yet
    found are asked, so in a crowd, where the first ones meet nearly all, few pairs are looked at.
    """
    free, pairs = [np.arange(n), np.arange(m)], ([], [])
    while len(free[0]) and len(free[1]):
        waiting = [(0, int(free[0][0]))]
        free[0] = free[0][1:]
        while waiting and (len(free[0]) or len(free[1])):
            side, k = waiting.pop()
            others = free[1 - side]
            if not len(others):
                continue
            hit = meets(side, k, others)
            found = others[hit]
            if len(found):
                free[1 - side] = others[~hit]
                pairs[side].append(np.full(len(found), k))
                pairs[1 - side].append(found)
                waiting.extend((1 - side, f) for f in found.tolist())
    return tuple(np.concatenate([np.zeros(0, np.int64), *p]) for p in pairs)


def linked_in_cells(left: DataFrame, right: DataFrame, cell: list[str], numbers: list[str], meets: Callable) -> DataFrame:
    """(a, b): ids of links that join what pairs of left and right rows (cell, id, numbers as doubles) of one cell join, without making all pairs.

    ``meets(one, others)``: which of the others (arrays by number) a right one, given as numbers, makes a pair with; ``meets`` holds both ways.
    """
    columns = [*cell, "id", *numbers]
    both = left.select(*columns, F.lit(0).alias("__s")).unionByName(right.select(*columns, F.lit(1).alias("__s")))
    kind = dict(both.dtypes)["id"]

    def run(rows: pa.Table) -> pa.Table | None:
        n = rows.num_rows - int(rows.column("__s").to_numpy().sum())
        if not n or n == rows.num_rows:
            return None
        at = [rows.column(c).to_numpy() for c in numbers]
        sides = [[c[:n] for c in at], [c[n:] for c in at]]
        a, b = spanning_links(n, rows.num_rows - n, lambda side, k, others: meets([c[k] for c in sides[side]], [c[others] for c in sides[1 - side]]))
        ids = rows.column("id")
        return pa.table([ids.take(pa.array(a)), ids.take(pa.array(b + n))], ["a", "b"])

    met = in_tables(both, cell, ["__s"], run, f"a {kind}, b {kind}").filter("a <> b")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def touching_boxes(boxes: DataFrame, keys: list[str], gap: float, spanning: bool = False) -> DataFrame:
    """(a, b): ids of boxes (keys, id, x0, y0, x1, y1) of one key at most ``gap`` apart in x and in y, each pair once; 0: those that touch.

    A box lies in the cells of its level, a power of two times the gap and no less than its size, so in nine at most; a smaller
    box asks for it at that level. Boxes with a null touch none. ``spanning``: only links that join what the pairs join, a
    few a box, however many boxes touch.
    """
    unit = max(gap, LEAST_CELL)
    size = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(unit))
    own = boxes.select(*keys, "id", "x0", "y0", "x1", "y1").dropna().withColumn("__l", F.ceil(F.log2(size / unit)).cast("int"))
    width = F.pow(F.lit(2.0), F.col("__at")) * unit

    def spread(df: DataFrame, pad: float) -> DataFrame:
        for c, lo, hi in (("__cx", "x0", "x1"), ("__cy", "y0", "y1")):
            df = df.withColumn(c, F.explode(F.sequence(F.floor((F.col(lo) - pad) / width), F.floor((F.col(hi) + pad) / width))))
        return df

    # a key has few levels: their number grows with the logarithm of the largest box
    levels = own.select(*keys, F.col("__l").alias("__at")).distinct()
    dealt = spread(own.withColumn("__at", F.col("__l")), gap)
    asked = spread(own.join(levels, keys).filter("__l <= __at"), 0.0).select(*keys, "__at", "__cx", "__cy", F.col("__l").alias("__m"), *[F.col(c).alias(f"{c}_") for c in ("id", "x0", "y0", "x1", "y1")])
    if spanning:
        level = [*keys, "__at", "__cx", "__cy"]
        sides = [*[F.col(f"{c}_").cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]]
        small = asked.select(*level, F.col("id_").alias("id"), *sides)
        large = dealt.select(*level, "id", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])

        def meets(one: list, others: list) -> np.ndarray:
            (x0, y0, x1, y1), (u0, v0, u1, v1) = one, others
            return (x0 - gap <= u1) & (u0 - gap <= x1) & (y0 - gap <= v1) & (v0 - gap <= y1)

        return linked_in_cells(large, small, level, ["x0", "y0", "x1", "y1"], meets)
    near = [F.col(f"{c}0") - gap <= F.col(f"{c}1_") for c in "xy"] + [F.col(f"{c}0_") - gap <= F.col(f"{c}1") for c in "xy"]
    met = dealt.join(asked, [*keys, "__at", "__cx", "__cy"]).filter(near[0] & near[1] & near[2] & near[3] & ((F.col("__m") < F.col("__l")) & (F.col("id") != F.col("id_")) | (F.col("id_") < F.col("id"))))
    return met.select(F.least("id", "id_").alias("a"), F.greatest("id", "id_").alias("b")).distinct()


def boxes_and_points(boxes: DataFrame, points: DataFrame, keys: list[str], sides: tuple[str, str, str, str], xy: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    """Boxes and points with the cells (__l, __cx, __cy) in which boxes_over_points pairs them."""
    x0, y0, x1, y1 = (F.col(c) for c in sides)
    slack = 1e-9 * (F.abs(x0) + F.abs(y0) + F.abs(x1) + F.abs(y1) + 1)
    dealt = boxes.dropna(subset=list(sides)).filter((x0 <= x1) & (y0 <= y1)).withColumn("__l", F.ceil(F.log2(F.greatest(x1 - x0, y1 - y0, F.lit(1.0)))).cast("int"))
    width = F.pow(F.lit(2.0), F.col("__l"))
    cells = lambda a, b: F.explode(F.sequence(F.floor((a - slack) / width).cast("long"), F.floor((b + slack) / width).cast("long")))
    levels = dealt.select(*keys, "__l").distinct()
    dealt = dealt.withColumn("__cx", cells(x0, x1)).withColumn("__cy", cells(y0, y1))
    asked = points.dropna(subset=list(xy)).join(levels, keys).withColumns({n: F.floor(F.col(c) / width).cast("long") for n, c in zip(("__cx", "__cy"), xy)})
    return dealt, asked


def boxes_over_points(boxes: DataFrame, points: DataFrame, keys: list[str], sides: tuple[str, str, str, str], xy: tuple[str, str]) -> DataFrame:
    """Pairs of boxes and points of equal keys that share a cell: all where the box (x0, y0, x1, y1) holds the point, and some beside.

    A box lies in the cells of its level, a power of two no less than its size, so in nine at most; a point asks each
    level of its key, of which there are few. The caller tells who is inside. Boxes without a whole size and points without a place meet none.
    """
    dealt, asked = boxes_and_points(boxes, points, keys, sides, xy)
    return dealt.join(asked, [*keys, "__l", "__cx", "__cy"]).drop("__l", "__cx", "__cy")


def radius_join(left: DataFrame, right: DataFrame, keys: list[str], lxy: tuple[str, str], rxy: tuple[str, str], radius: float) -> DataFrame:
    """Pairs with equal keys at most ``radius`` apart (0: at one point), by grid cells."""
    def cell(c: str) -> Column:
        return F.floor(F.col(c) / max(radius, LEAST_CELL)).cast("long")

    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    l = left.withColumn("__dx", F.explode(around)).withColumn("__dy", F.explode(around)).withColumn("__cx", cell(lxy[0]) + F.col("__dx")).withColumn("__cy", cell(lxy[1]) + F.col("__dy")).drop("__dx", "__dy")
    r = right.withColumn("__cx", cell(rxy[0])).withColumn("__cy", cell(rxy[1]))
    d2 = (F.col(lxy[0]) - F.col(rxy[0])) ** 2 + (F.col(lxy[1]) - F.col(rxy[1])) ** 2
    return l.join(r, [*keys, "__cx", "__cy"]).filter(d2 <= radius * radius).drop("__cx", "__cy")


def nearest_capped(left: DataFrame, right: DataFrame, keys: list[str], lid: str, x: str, y: str, rid: str, cap: float) -> DataFrame:
    """(keys, lid, rid, distance): the nearest right row within ``cap``, ties to the smaller rid; none leaves nulls.

    The nearest is the last value at or below, or the first at or above, so a key's rows are sorted and no pairs are made.
    """
    held = right.filter(F.col(y).isNotNull() & ~F.isnan(y)).groupBy(*keys, F.col(y).cast("double").alias("__v")).agg(F.min(rid).alias("__r"))
    asked = left.select(*keys, F.col(x).cast("double").alias("__v"), F.col(lid).alias("__a"))
    both = asked.withColumn("__r", F.lit(None).cast(held.schema["__r"].dataType)).unionByName(held.withColumn("__a", F.lit(None).cast(left.schema[lid].dataType)), allowMissingColumns=True)
    both = both.withColumn("__y", F.when(F.col("__r").isNotNull(), F.struct(F.col("__v").alias("y"), F.col("__r").alias("r"))))
    side = lambda order: F.last("__y", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order))
    met = both.withColumn("__low", side([F.col("__v")])).withColumn("__high", side([F.col("__v").desc()])).filter("__r is null")
    near = lambda c: F.when(F.abs(F.col(f"{c}.y") - F.col("__v")) <= cap, F.struct(F.abs(F.col(f"{c}.y") - F.col("__v")).alias("d"), F.col(f"{c}.r").alias("r")))
    return met.select(*keys, F.col("__a").alias(lid), F.least(near("__low"), near("__high")).alias("__m")).select(*keys, lid, F.col("__m.r").alias(rid), F.col("__m.d").alias("distance"))


def _repeated(df: DataFrame, id_: str) -> DataFrame:
    """Ids on more than one row."""
    return df.groupBy(id_).agg(F.count(F.lit(1)).alias("__k")).filter("__k > 1").select(id_)


def near_pair_sums(df: DataFrame, keys: list[str], id_: str, value: str, tol: float) -> DataFrame:
    """(keys, pairs, gap): number of pairs of one key and different ids at most ``tol`` apart, and the sum of their distances; keys without pairs are absent.

    Rows of one value are counted together, so copies of values add no pairs to the join. Null ids and values have no partner.
    """
    rows = df.select(*keys, id_, value).dropna()
    counted = rows.groupBy(*keys, F.col(value).alias("__x")).agg(F.count(F.lit(1)).alias("__n"))
    other = counted.select(*keys, F.col("__x").alias("__y"), F.col("__n").alias("__m"))
    apart = band_join(counted, other, keys, "__x", "__y", -tol, tol).filter("__x < __y").select(*keys, (F.col("__n") * F.col("__m")).alias("__p"), (F.col("__n") * F.col("__m") * (F.col("__y") - F.col("__x"))).alias("__g"))
    equal = counted.filter("__n > 1").select(*keys, F.expr("__n * (__n - 1) div 2").alias("__p"), F.lit(0.0).alias("__g"))
    # pairs of rows that share an id were counted above
    own = rows.join(_repeated(rows, id_), id_).withColumn("__i", F.monotonically_increasing_id())
    twin = own.select(*keys, id_, F.col(value).alias("__y"), F.col("__i").alias("__j"))
    same = own.join(twin, [*keys, id_]).withColumn("__d", F.abs(F.col("__y") - F.col(value))).filter((F.col("__i") < F.col("__j")) & (F.col("__d") <= tol)).select(*keys, F.lit(-1).cast("long").alias("__p"), (-F.col("__d")).alias("__g"))
    sums = apart.unionByName(equal).unionByName(same).groupBy(*keys).agg(F.sum("__p").alias("pairs"), F.sum("__g").alias("gap"))
    return sums.filter("pairs > 0")


def radius_counts(df: DataFrame, keys: list[str], id_: str, xy: tuple[str, str], radius: float) -> DataFrame:
    """(id, near): number of other ids with a row of the same key at most ``radius`` away from a row of this one; ids without any are absent.

    Rows at one point are counted together, so copies of points add no pairs to the join; only ids on several rows are
    told apart one by one. Null ids and places have no neighbour.
    """
    rows = df.select(*keys, F.col(id_).alias("__id"), F.col(xy[0]).alias("__x"), F.col(xy[1]).alias("__y")).dropna()
    many = _repeated(rows, "__id")
    once, several = rows.join(many, "__id", "left_anti"), rows.join(many, "__id", "left_semi")
    points = once.groupBy(*keys, "__x", "__y").agg(F.count(F.lit(1)).alias("__n"))
    places = rows.select(*keys, "__x", "__y").distinct()

    def around(a: DataFrame, b: DataFrame, *kept: str) -> DataFrame:
        b = b.select(*keys, F.col("__x").alias("__u"), F.col("__y").alias("__v"), *kept)
        return radius_join(a, b, keys, ("__x", "__y"), ("__u", "__v"), radius)

    at = [*keys, "__x", "__y"]
    counts = around(places, points, "__n").groupBy(*at).agg(F.sum("__n").alias("__c"))
    others = around(places, several.withColumnRenamed("__id", "__o"), "__o").groupBy(*at).agg(F.countDistinct("__o").alias("__e"))
    single = once.join(counts, at).join(others, at, "left").select("__id", (F.col("__c") - 1 + F.coalesce("__e", F.lit(0))).alias("near"))
    all_ = around(several, rows.withColumnRenamed("__id", "__o"), "__o").filter("__id <> __o").groupBy("__id").agg(F.countDistinct("__o").alias("near"))
    return single.unionByName(all_).filter("near > 0").withColumnRenamed("__id", id_)


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], lo: str, hi: str, lo2: str, hi2: str, cell: float) -> DataFrame:
    """Pairs with equal keys whose intervals overlap, with ``overlap``; each pair once.

    An interval lies in the cells of its level, a power of two times ``cell`` and no less than its length, so in two at
    most, however long it is. It is asked at its own level by longer and equal ones, and asks the others' levels, of which a key has few.
    """
    level = lambda a, b: F.ceil(F.log2(F.greatest(F.col(b) - F.col(a), F.lit(cell)) / cell)).cast("int")

    def cells(df: DataFrame, a: str, b: str, at: str) -> DataFrame:
        width = F.pow(F.lit(2.0), F.col(at)) * cell
        return df.withColumn("__c", F.explode(F.sequence(F.floor(F.col(a) / width).cast("long"), F.floor(F.col(b) / width).cast("long"))))

    l, r = left.filter(F.col(lo) <= F.col(hi)).withColumn("__l", level(lo, hi)), right.filter(F.col(lo2) <= F.col(hi2)).withColumn("__r", level(lo2, hi2))
    # the pair meets once: at the longer one's level, in the first cell that both touch there
    l_at, r_at = l.select(*keys, F.col("__l").alias("__w")).distinct(), r.select(*keys, F.col("__r").alias("__w")).distinct()
    one = cells(l.withColumn("__w", F.col("__l")), lo, hi, "__w").join(cells(r.join(l_at, keys).filter("__r <= __w"), lo2, hi2, "__w"), [*keys, "__w", "__c"])
    two = cells(l.join(r_at, keys).filter("__l < __w"), lo, hi, "__w").join(cells(r.withColumn("__w", F.col("__r")), lo2, hi2, "__w"), [*keys, "__w", "__c"])
    width = F.pow(F.lit(2.0), F.col("__w")) * cell
    first = F.greatest(F.floor(F.col(lo) / width), F.floor(F.col(lo2) / width))
    shared = F.least(hi, hi2) - F.greatest(lo, lo2)
    return one.unionByName(two).filter(F.col("__c") == first).withColumn("overlap", shared).filter("overlap > 0").drop("__c", "__w", "__l", "__r")


def edge_votes(edges: DataFrame, low: float = 5.0, high: float = 34.0) -> DataFrame:
    """Parallel edges (grp, edge, off, lo, hi) paired by a vote: each pair votes its overlap for its offset gap, rounded
    to whole units, on both edges; an edge keeps its heaviest (weights to 6 places, so that the order of summing breaks
    no tie; ties to the smaller gap); pairs stay where both edges agree.

    A group's edges are sorted once and its pairs made in blocks, first to count votes, then to give out those that
    stay: edges are shuffled, pairs are not. Edges without a group, number or offset take no part.
    """
    kinds = dict(edges.dtypes)
    least, gaps = floor(low + 0.5), floor(high + 0.5) - floor(low + 0.5) + 1

    def pairs(off: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple]:
        """(first, second, gap from the least, overlap) of pairs, a block of edges at a time."""
        slack = 1e-9 * (abs(low) + abs(high) + np.abs(off))
        begin, end = np.searchsorted(off, off + low - slack), np.searchsorted(off, off + high + slack, side="right")
        upto = np.concatenate([[0], np.cumsum(end - begin)])
        at = 0
        while at < len(off):
            stop = max(at + 1, int(np.searchsorted(upto, upto[at] + PAIRS, side="right")) - 1)
            n = end[at:stop] - begin[at:stop]
            one = np.repeat(np.arange(at, stop), n)
            two = np.arange(len(one)) + np.repeat(begin[at:stop] - (upto[at:stop] - upto[at]), n)
            gap, over = off[two] - off[one], np.fmin(hi[one], hi[two]) - np.fmax(lo[one], lo[two])
            kept = (gap >= low) & (gap <= high) & (over > 0.2)
            yield one[kept], two[kept], np.floor(gap[kept] + 0.5).astype(np.int64) - least, over[kept]
            at = stop

    def run(rows: list[tuple]) -> Iterator[tuple]:
        group, names, *sides = zip(*rows)
        off, lo, hi = (np.array(c, float) for c in sides)
        number = {e: i for i, e in enumerate(dict.fromkeys(names))}
        edge = np.array([number[e] for e in names])
        votes = np.zeros(len(number) * gaps)
        for one, two, gap, over in pairs(off, lo, hi):
            for side in (one, two):
                np.add.at(votes, edge[side] * gaps + gap, over)
        won = votes.reshape(-1, gaps).round(6).argmax(axis=1)
        for one, two, gap, over in pairs(off, lo, hi):
            agreed = (won[edge[one]] == gap) & (won[edge[two]] == gap)
            for i, j, g, o in zip(one[agreed].tolist(), two[agreed].tolist(), gap[agreed].tolist(), over[agreed].tolist()):
                yield group[0], names[i], names[j], g + least, o

    known = edges.dropna(subset=["grp", "edge", "off"]).select("grp", "edge", *[F.col(c).cast("double").alias(c) for c in ("off", "lo", "hi")])
    return in_groups(known, ["grp"], ["off"], run, f"grp {kinds['grp']}, e1 {kinds['edge']}, e2 {kinds['edge']}, dia long, ov double")
