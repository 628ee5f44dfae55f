"""Bent bars put together from the fragments in which they were drawn.

Ends that touch are found by cells and joined; growth is greedy in the order of fragments, but never leaves a
connected component of touching fragments, so components are dealt out, not whole panels.
"""

from __future__ import annotations

from math import dist, log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import shared_folder, ship
from .clustering import components
from .dealing import in_groups
from .joins import band_join, near_values, radius_join
from .linking import linked
from .pieces import _Grid

POINT = "struct<x:double,y:double,z:double>"


def fragment_ceilings(marks: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """keys, ceiling: the length below which a drawn bar cannot be a whole one of any mark.

    marks: keys, length, qty, shape, segments array<double>. 1.15 of the longest segment of bent marks (shape other
    than M_00) or, without segments or where ``strict``, half the shortest mark. Marks without length or quantity, or
    with nulls there, don't count.
    """
    whole = marks.filter("qty > 0 and length > 0")
    bent = F.coalesce(F.upper(F.trim("shape")) != "M_00", F.lit(True)) & F.lit(not strict)
    longest = F.array_max(F.filter(F.coalesce("segments", F.array().cast("array<double>")), lambda s: s > 0))
    sums = whole.groupBy(*keys).agg(F.max(F.when(bent, longest)).alias("leg"), F.min("length").alias("least"))
    return sums.select(*keys, F.coalesce(F.col("leg") * 1.15, F.col("least") * 0.5).alias("ceiling"))


def touching_ends(fragments: DataFrame, keys: list[str], gap: float) -> DataFrame:
    """(keys, a, b): pairs of fragments (a < b) with an end of each at most ``gap`` apart, each pair once."""
    size = max(gap, 1e-6)
    ends = fragments.select(*keys, "frag", F.explode(F.array(F.element_at("points", 1), F.element_at("points", -1))).alias("p"))
    cell = lambda c: F.floor(F.col(f"p.{c}") / size).cast("long")
    around = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    wide = ends.select(*keys, "frag", "p", around.alias("__dx")).select("*", around.alias("__dy"))
    wide = wide.select(*keys, F.col("frag").alias("a"), F.col("p").alias("pa"), (cell("x") + F.col("__dx")).alias("__x"), (cell("y") + F.col("__dy")).alias("__y"))
    near = ends.select(*keys, F.col("frag").alias("b"), F.col("p").alias("pb"), cell("x").alias("__x"), cell("y").alias("__y"))
    apart = sum(((F.col(f"pa.{c}") - F.col(f"pb.{c}")) ** 2 for c in "xyz"), F.lit(0.0))
    return wide.join(near, [*keys, "__x", "__y"]).filter((F.col("a") < F.col("b")) & (apart <= gap * gap)).select(*keys, "a", "b").distinct()


def grow(fragments: list[tuple], gap: float, depth: float) -> list[tuple]:
    """Chains (members, points) of (id, points), sorted by id: the first free fragment takes, pass by pass in order, each
    free one that touches its last end, else its first, and whose depth differs by ``depth`` at most from its own."""
    if len(fragments) == 1:
        return [([fragments[0][0]], list(fragments[0][1]))]
    grid, free, out = _Grid(max(gap, 1e-6)), [True] * len(fragments), []
    for i, (_, pts) in enumerate(fragments):
        for p in (pts[0], pts[-1]):
            grid.put(p, i)

    def next_to(low: int, ends: tuple, z: float) -> int | None:
        for j in grid.near(*ends):
            if j >= low and free[j] and abs(fragments[j][1][0][2] - z) <= depth and any(dist(e, f) <= gap for e in ends for f in (fragments[j][1][0], fragments[j][1][-1])):
                return j
        return None

    for i, (name, own) in enumerate(fragments):
        if not free[i]:
            continue
        free[i], members, pts, low, grew = False, [name], list(own), 0, False
        while True:
            j = next_to(low, (pts[0], pts[-1]), own[0][2])
            if j is None:
                if not grew:
                    break
                low, grew = 0, False
                continue
            new = fragments[j][1]
            if dist(pts[-1], new[0]) <= gap:
                pts = pts + new[1:]
            elif dist(pts[-1], new[-1]) <= gap:
                pts = pts + new[-2::-1]
            elif dist(pts[0], new[-1]) <= gap:
                pts = new[:-1] + pts
            else:
                pts = new[::-1][:-1] + pts
            free[j], grew, low = False, True, j + 1
            members.append(fragments[j][0])
        out.append((members, pts))
    return out


def chain_fragments(fragments: DataFrame, keys: list[str], gap: float = 20.0, depth: float = 2.0) -> DataFrame:
    """keys, chain, members, n, length, points: fragments joined end to end, in order of ``frag``.

    fragments: keys, frag (unique over all keys), points array<struct<x, y, z>>. A chain is named by its first
    fragment; fragments without points or with null coordinates stay out, single ones are chains of one. An empty
    table gives no row.
    """
    shared_folder(ship(fragments.sparkSession))
    known = fragments.filter(F.size("points") > 0).filter(~F.exists("points", lambda p: p.isNull() | p["x"].isNull() | p["y"].isNull() | p["z"].isNull())).select(*keys, "frag", "points")
    named = components(known.select(F.col("frag").alias("node")), touching_ends(known, keys, gap).select("a", "b"))
    kinds = dict(known.dtypes)

    width = len(keys)

    def run(rows: list[tuple]) -> list[tuple]:
        made = grow([(r[width], [(p["x"], p["y"], p["z"]) for p in r[width + 1]]) for r in rows], gap, depth)
        return [(*rows[0][:width], members[0], members, len(members), sum(dist(a, b) for a, b in zip(pts, pts[1:])), [dict(zip("xyz", p)) for p in pts]) for members, pts in made]

    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], f"chain {kinds['frag']}", f"members array<{kinds['frag']}>", "n int, length double", f"points array<{POINT}>"])
    rows = known.join(named.withColumnRenamed("node", "frag"), "frag").select(*keys, "frag", "points", "component")
    return in_groups(rows, [*keys, "component"], ["frag"], run, schema)


def wanted(marks: DataFrame, bars: DataFrame, keys: list[str]) -> DataFrame:
    """marks with ``need``: quantity less the bars (keys, length) within max(30, 8 %) of their length."""
    held = bars.filter("length is not null").groupBy(*keys, F.col("length").alias("__l")).agg(F.count(F.lit(1)).alias("__n"))
    met = near_values(marks, held, keys, "length", "__l", 30.0, 0.08).join(held, [*keys, "__l"])
    found = met.groupBy(*keys, "length").agg(F.sum("__n").alias("__n"))
    return marks.join(found, [*keys, "length"], "left").withColumn("need", (F.col("qty") - F.coalesce("__n", F.lit(0))).cast("long")).drop("__n")


def accept_chains(chains: DataFrame, marks: DataFrame, keys: list[str], share: float = 0.15) -> DataFrame:
    """keys, mark, chain, n, length: chains of two fragments at least that become bars of bent marks.

    marks: keys, mark, length, need. Marks by falling length (then name) take the first chains, by name, whose length
    is within ``share`` of theirs, as many as they need; a chain is used once. Nulls take no part.
    """
    made = chains.filter("n >= 2 and length >= 1").select(*keys, "chain", "n", F.log("length").alias("__y"), F.col("length").alias("path"))
    asked = marks.filter("need > 0 and length > 0").select(*keys, "mark", "length", "need", F.log("length").alias("__x"))
    pairs = band_join(asked, made, keys, "__x", "__y", log(1 - share) - 1e-9, log(1 + share) + 1e-9).filter(F.abs(F.col("path") - F.col("length")) <= share * F.col("length")).drop("__x", "__y")
    kinds = dict(pairs.dtypes)

    width = len(keys)

    def run(rows: list[tuple]) -> list[tuple]:
        used, left, out = set(), {}, []
        for r in rows:
            mark, chain, n, need, path, length = r[width : width + 6]
            if left.setdefault((length, mark), need) > 0 and chain not in used:
                used.add(chain)
                left[length, mark] -= 1
                out.append((*r[:width], mark, chain, n, path))
        return out

    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], f"mark {kinds['mark']}", f"chain {kinds['chain']}", "n int, length double"])
    dealt = linked(pairs, keys, "mark", "chain").select(*keys, "mark", "chain", "n", "need", "path", "length", "component")
    return in_groups(dealt, [*keys, "component"], [F.col("length").desc(), "mark", "chain"], run, schema)


def shapes_by_evidence(marks: DataFrame, fragments: DataFrame, labels: DataFrame, bars: DataFrame, keys: list[str], radius: float = 2200.0, least: int = 3) -> DataFrame:
    """keys, mark, bar, length, evidence: bars of bent marks whose fragments lie by their labels.

    marks: keys, mark, length, qty, shape; fragments: keys, frag (unique over all keys), points (those below the strict
    ceiling, see fragment_ceilings); labels: keys, mark, x, y, one for each instance drawn; bars: keys, length (all that
    stand). A bent mark (shape other than M_00) that needs more bars than stand (see wanted), and of whose diameter at
    least ``least`` fragments have a point within ``radius`` of one of its labels, gets all it needs; ``bar`` counts from 0.
    """
    bent = marks.filter("qty > 0 and length > 0").filter(F.coalesce(F.upper(F.trim("shape")) != "M_00", F.lit(True)))
    short = wanted(bent, bars, keys).filter("need > 0").select(*keys, "mark", "length", "need")
    at = labels.dropna(subset=["x", "y"]).join(short.select(*keys, "mark"), [*keys, "mark"]).select(*keys, "mark", F.col("x").alias("lx"), F.col("y").alias("ly"))
    ends = fragments.select(*keys, "frag", F.explode("points").alias("p")).select(*keys, "frag", F.col("p.x").alias("px"), F.col("p.y").alias("py")).dropna(subset=["px", "py"])
    near = radius_join(ends, at, keys, ("px", "py"), ("lx", "ly"), radius).groupBy(*keys, "mark").agg(F.countDistinct("frag").alias("n")).filter(F.col("n") >= least)
    return short.join(near.select(*keys, "mark"), [*keys, "mark"]).select(*keys, "mark", F.explode(F.sequence(F.lit(0).cast("long"), F.col("need") - 1)).alias("bar"), "length", F.lit("bent-shape-evidence-origin").alias("evidence"))
