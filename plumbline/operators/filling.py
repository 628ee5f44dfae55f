"""Schedules filled from drawn bars: which bar serves which mark, what is left to be made, and what it weighs (M2, M3, M5, M6).

A tolerance reaches only so far: the lengths of a key fall apart where no mark reaches over a gap, and each part is a
task of its own.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import ship
from .dealing import in_groups
from .matching import _Pool, reach_parts
from .reports import unit_kg


class _Named(_Pool):
    """Lengths with the items that have them; items of one length are used in their order."""

    def __init__(self, rows: list[tuple]):
        held: dict = {}
        for length, item in sorted(rows, reverse=True):
            held.setdefault(length, []).append(item)
        super().__init__(held)
        self.items = [held[x] for x in self.at]

    def take(self, x: float, tol: float) -> tuple | None:
        i = self.nearest(x)
        if i is None or abs(self.at[i] - x) > tol:
            return None
        item = self.items[i].pop()
        if not self.items[i]:
            self.use(i)
        return item, self.at[i]


def claim_bars(rows: DataFrame, bars: DataFrame, keys: list[str], floor: float = 80.0, rel: float = 0.15) -> DataFrame:
    """keys, mark, unit, item, length: the bars that marks claim, the longest mark first (ties by mark).

    rows: keys, mark (unique within keys), qty, target; bars: keys, item, length. Each unit, numbered from 0, takes the unused length
    nearest to the target within max(floor, rel * target) (the shorter of two equally near, equal ones by item). Units
    without a bar have nulls: the shortfall. (80, 15 %) is the rule for straight rows (M2), (120, 20 %) for bent ones by
    the sum of their segments (M3). Rows without quantity or target claim nothing. No bars: all is shortfall.
    """
    ship(rows.sparkSession)
    asked = rows.filter("qty > 0 and target is not null").select(*keys, "mark", F.col("qty").cast("long").alias("qty"), F.col("target").cast("double").alias("target"))
    demand, pool = reach_parts(asked, bars.select(*keys, "item", "length"), keys, F.greatest(F.lit(floor), rel * F.col("target")))
    kinds = dict(asked.dtypes) | {"item": dict(bars.dtypes)["item"]}

    width = len(keys) + 2
    empty = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    by = [*keys, "part"]
    one = demand.select(*by, F.lit(0).alias("side"), "mark", "qty", "target", empty("item"), F.lit(None).cast("double").alias("length"))
    two = pool.select(*by, F.lit(1).alias("side"), empty("mark"), empty("qty"), empty("target"), "item", F.col("length").cast("double").alias("length"))

    def run(rows: list[tuple]) -> list[tuple]:
        free, out = _Named([(r[-1], r[-2]) for r in rows if r[width - 1]]), []
        for r in rows:
            if not r[width - 1]:
                mark, qty, target = r[width : width + 3]
                for unit in range(qty):
                    out.append((*r[: len(keys)], mark, unit, *(free.take(target, max(floor, rel * target)) or (None, None))))
        return out

    ddl = ", ".join([*[f"{k} {kinds[k]}" for k in keys], f"mark {kinds['mark']}", f"unit long, item {kinds['item']}, length double"])
    return in_groups(one.unionByName(two), by, ["side", F.col("target").desc(), "mark"], run, ddl)


def made_bars(claims: DataFrame, rows: DataFrame, bars: DataFrame, panels: DataFrame, keys: list[str], panel: str) -> DataFrame:
    """keys, mark, unit, x0, y0, x1, y1: where the shortfall of straight rows is drawn (M2).

    claims: of claim_bars; rows: keys, mark, target; bars: keys, item, x0, y0, x1, y1; panels: panel, x0, y0, x1, y1 (the
    elevation). With claimed bars, units of the shortfall repeat their middles in turn, in order of claim; a single one
    is mirrored along the bar's direction. The direction is that of most claimed bars (level on a tie). Without any, units are
    spread over the panel's diagonal, level if the target is nearer to its width than to its height. Bars are moved into the panel where they fit.
    """
    box = panels.select(panel, F.col("x0").alias("ex"), F.col("y0").alias("ey"), (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"))
    where = bars.select(*keys, "item", ((F.col("x0") + F.col("x1")) / 2).alias("mx"), ((F.col("y0") + F.col("y1")) / 2).alias("my"), (F.abs(F.col("y1") - F.col("y0")) < F.abs(F.col("x1") - F.col("x0"))).alias("level"))
    had = claims.filter("item is not null").join(where, [*keys, "item"])
    seen = had.groupBy(*keys, "mark").agg(F.array_sort(F.collect_list(F.struct("unit", "mx", "my"))).alias("src"), F.count(F.when(F.col("level"), 1)).alias("levels"), F.count(F.lit(1)).alias("n"))
    lack = claims.filter("item is null").join(rows.select(*keys, "mark", F.col("target").cast("double").alias("target")), [*keys, "mark"]).join(seen, [*keys, "mark"], "left").join(box, panel)
    n = F.coalesce("n", F.lit(0))
    k, short = F.col("unit") - n, F.count(F.lit(1)).over(Window.partitionBy(*keys, "mark"))
    flat = F.when(n > 0, F.col("levels") >= F.col("n") - F.col("levels")).otherwise(F.abs(F.col("target") - F.col("w")) <= F.abs(F.col("target") - F.col("h")))
    src = F.get("src", F.when(n > 0, F.pmod(k, n)).cast("int"))
    at = lack.withColumns({"flat": flat, "sx": src["mx"] - F.col("ex"), "sy": src["my"] - F.col("ey"), "share": (k + 0.5) / short, "one": n == 1})
    cx = F.when(F.col("sx").isNull(), F.col("share") * F.col("w")).when(F.col("flat") & F.col("one"), F.col("w") - F.col("sx")).otherwise(F.col("sx"))
    cy = F.when(F.col("sy").isNull(), F.col("share") * F.col("h")).when(~F.col("flat") & F.col("one"), F.col("h") - F.col("sy")).otherwise(F.col("sy"))
    half = F.col("target") / 2
    inside = lambda c, size: F.least(F.greatest(c, half), F.greatest(F.col(size) - half, half))
    mx, my = F.when(F.col("flat"), inside(cx, "w")).otherwise(cx) + F.col("ex"), F.when(F.col("flat"), cy).otherwise(inside(cy, "h")) + F.col("ey")
    dx, dy = F.when(F.col("flat"), half).otherwise(0.0), F.when(F.col("flat"), 0.0).otherwise(half)
    return at.select(*keys, "mark", "unit", (mx - dx).alias("x0"), (my - dy).alias("y0"), (mx + dx).alias("x1"), (my + dy).alias("y1"))


#: Kinds of bars that have no direction, and the ratios at which a bar counts as one or as two of a row.
BENT = ("tie", "link", "u-bar", "hook", "shape", "face-dowel", "diagonal")
UNITS = ((1, 0.75, 1.30), (2, 1.75, 2.45))


def orientation(kind: Column, width: Column, height: Column) -> Column:
    """Horizontal or Vertical if a bar is more than twice as wide as high, or the other way; Other for bent kinds and the rest."""
    return F.when(kind.isin(*BENT), "Other").when(width > 2 * height, "Horizontal").when(height > 2 * width, "Vertical").otherwise("Other")


def fill_rows(rows: DataFrame, bars: DataFrame, keys: list[str]) -> DataFrame:
    """keys, sno, dia, nos, units, found: bars given to the schedule rows that they fit best (M5).

    rows: keys, sno, dia, descr, nos, length; bars: keys, bar, dia, length, orient. Bars by falling length (ties by bar)
    take the row of their diameter (a row of 15 is one of 16) that is nearest to its length, the first by sno: first as
    one unit (ratio 0.75 to 1.30), then those left as two (1.75 to 2.45), as far as the row's number goes. A row that
    says horizontal or vertical takes no bar of the other direction. Rows without length take none; null bars neither.
    """
    ship(rows.sparkSession)
    word = F.lower(F.coalesce("descr", F.lit("")))
    want = F.when(word.contains("horizontal"), "Horizontal").when(word.contains("vertical"), "Vertical")
    r = rows.select(*keys, "sno", F.col("dia").alias("printed"), F.when(F.col("dia") == 15, 16).otherwise(F.col("dia")).cast("long").alias("dia"), want.alias("want"), F.col("nos").cast("long").alias("nos"), F.col("length").cast("double").alias("length"))
    b = bars.dropna(subset=["length", "dia"]).select(*keys, "bar", F.col("dia").cast("long").alias("dia"), F.col("length").cast("double").alias("length"), F.coalesce("orient", F.lit("Other")).alias("orient"))
    kinds = dict(r.dtypes)
    n = len(keys) + 2

    def run(group: list[tuple]) -> list[tuple]:
        d = [g for g in group if not g[n - 1]]
        if not d:
            return []
        left, units, found = [g[n + 3] or 0 for g in d], [0] * len(d), [0.0] * len(d)
        wants = [g[n + 2] for g in d]
        free = [(g[n + 4], g[n + 6]) for g in group[len(d) :]]
        # rows by length: a bar looks only at those its ratios reach
        order = sorted((g[n + 4], i) for i, g in enumerate(d) if g[n + 4] and g[n + 4] > 0 and left[i] > 0)
        lengths = [x for x, _ in order]
        for k, low, high in UNITS:
            rest = []
            for length, way in free:
                best = None
                for x, i in order[bisect_left(lengths, length / high * (1 - 1e-9)) : bisect_right(lengths, length / low * (1 + 1e-9))]:
                    if left[i] >= k and low <= length / x <= high and (wants[i] in (None, way) or way == "Other"):
                        off = abs(length / (k * x) - 1)
                        if best is None or (off, i) < best:
                            best = (off, i)
                if best:
                    i = best[1]
                    left[i] -= k
                    units[i] += k
                    found[i] += length
                else:
                    rest.append((length, way))
            free = rest
        return [(*g[: n - 2], g[n + 1], g[n], g[n + 3], u, f) for g, u, f in zip(d, units, found)]

    ddl = ", ".join([*[f"{k} {kinds[k]}" for k in keys], f"sno {kinds['sno']}, dia {kinds['printed']}, nos long, units long, found double"])
    one = r.select(*keys, "dia", F.lit(0).alias("side"), "printed", "sno", "want", "nos", "length")
    both = one.unionByName(b.withColumn("side", F.lit(1)), allowMissingColumns=True).select(*one.columns, "bar", "orient")
    return in_groups(both, [*keys, "dia"], ["side", F.asc_nulls_last("sno"), F.desc("length"), "bar"], run, ddl)


def with_missing(verdicts: DataFrame, dia: str) -> DataFrame:
    """Verdicts of ``tiered`` with missing (units that no pool has) and missing_kg, 3 places (M6)."""
    missing = F.greatest(F.col("qty") - F.col("found_1") - F.col("found_2") - F.col("found_3"), F.lit(0))
    return verdicts.withColumn("missing", missing).withColumn("missing_kg", F.round(missing * F.col("target") / 1000 * unit_kg(F.col(dia)), 3))
