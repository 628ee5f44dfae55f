"""Capacity-limited greedy matching. Eligibility needs equal keys and lengths within a tolerance, so keys, and parts of a
key over whose gaps no tolerance reaches, split the work without loss.

Sequential choices run inside a part, over rows that Spark has sorted and without a frame for each part; sums along an
order are windows.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import ship
from .dealing import in_groups


def _match(demand: DataFrame, pool: DataFrame, keys: list[str], by: list[str], order: list[Column], ddl: str, fn) -> DataFrame:
    """keys and the rows that ``fn`` gives for each ``by``, which begins with the keys: its marks as (mark, qty, target), in
    ``order`` (nulls last), and its lengths as (length, tier), rising.

    demand: keys, mark, qty, target; pool: keys, length and, of several pools, tier. Null lengths are of no use.
    """
    kinds, n, m = dict(demand.dtypes), len(keys), len(by)
    at = [f"__o{i}" for i in range(len(order))]
    marks = demand.select(*by, F.lit(0).alias("__side"), "mark", F.col("qty").cast("long").alias("qty"), F.col("target").cast("double").alias("__x"), *[c.alias(a) for c, a in zip(order, at)])
    tier = F.col("tier") if "tier" in pool.columns else F.lit(0)
    lengths = pool.filter("length is not null").select(*by, F.lit(1).alias("__side"), tier.cast("long").alias("qty"), F.col("length").cast("double").alias("__x"))

    def run(rows: list[tuple]) -> list[tuple]:
        d = [r[m + 1 : m + 4] for r in rows if not r[m]]
        if not d:
            return []
        head = rows[0][:n]
        return [(*head, *r) for r in fn(d, [(r[m + 3], r[m + 2]) for r in rows if r[m]])]

    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], ddl.format(**kinds)])
    return in_groups(marks.unionByName(lengths, allowMissingColumns=True), by, ["__side", *[F.asc_nulls_last(a) for a in at], "__x"], run, schema)


def _match_parts(demand: DataFrame, pool: DataFrame, keys: list[str], floor: float, rel: float, order: list[Column], ddl: str, fn) -> DataFrame:
    """The same part by part (see reach_parts), where no mark takes a length beyond max(floor, rel * target)."""
    marks, lengths = reach_parts(demand, pool, keys, F.greatest(F.lit(float(floor)), F.lit(float(rel)) * F.col("target")))
    return _match(marks, lengths, keys, [*keys, "part"], order, ddl, fn)


def reach_parts(demand: DataFrame, pool: DataFrame, keys: list[str], tol: Column) -> tuple[DataFrame, DataFrame]:
    """demand and pool with ``part``: no mark of one part can take a length of another.

    demand: keys, target; pool: keys, length; ``tol``: of the demand. The marks' reaches are united along the length; a
    length in none of them, and a null one, is dropped from the pool. Both sides pass one sorted window a key.
    """
    d = demand.withColumn("__lo", F.col("target") - tol).withColumn("__hi", F.col("target") + tol)
    along = Window.partitionBy(*keys).orderBy("__lo", "__hi")
    before = F.max("__hi").over(along.rowsBetween(Window.unboundedPreceding, -1))
    numbered = d.withColumn("__new", F.when(before.isNull() | (F.col("__lo") > before), 1).otherwise(0)).withColumn("part", F.sum("__new").over(along))
    spans = numbered.groupBy(*keys, "part").agg(F.min("__lo").alias("__at"), F.max("__hi").alias("__hi"))
    held = [c for c in pool.columns if c not in keys]
    marks = spans.select(*keys, "__at", "part", "__hi", *[F.lit(None).cast(dict(pool.dtypes)[c]).alias(c) for c in held], F.lit(0).alias("__kind"))
    rows = pool.filter("length is not null").select(*keys, F.col("length").cast("double").alias("__at"), F.lit(None).cast("long").alias("part"), F.lit(None).cast("double").alias("__hi"), *held, F.lit(1).alias("__kind"))
    last = Window.partitionBy(*keys).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = marks.unionByName(rows).withColumns({c: F.last(c, ignorenulls=True).over(last) for c in ("part", "__hi")})
    found = placed.filter((F.col("__kind") == 1) & (F.col("__at") <= F.col("__hi"))).select(*keys, *held, "part")
    return numbered.drop("__lo", "__hi", "__new"), found


def first_fit(demand: DataFrame, pool: DataFrame, keys: list[str], floor: float = 30.0, rel: float = 0.08, order: str | None = None) -> DataFrame:
    """keys, mark, qty, target, found, status: marks take the first unused lengths within max(floor, rel * target).

    ``order`` names the column by which marks come (their place in a file); without it they come by mark.
    """
    def run(d: list[tuple], p: list[tuple]) -> list[tuple]:
        pool_, rows = _Pool([x for x, _ in p]), []
        for mark, qty, target in d:
            tol = max(floor, rel * (target or 0.0))
            found = pool_.first_within(target - tol, target + tol, qty or 0) if target is not None else 0
            rows.append((mark, qty, target, found, _status(found, qty)))
        return rows

    return _match_parts(demand, pool.select(*keys, "length"), keys, floor, rel, [F.col(order or "mark")], _FOUND, run)


#: Columns of what marks found.
_FOUND = "mark {mark}, qty long, target double, found long, status string"


def _status(found: int, qty: int | None) -> str:
    return "OK" if qty is not None and found >= qty else "SHORT" if found else "DEAD_END"


def greedy_nearest(demand: DataFrame, pool: DataFrame, keys: list[str], floor: float = 30.0, rel: float = 0.08, descending: bool = False) -> DataFrame:
    """Like first_fit, each unit taking the nearest unused length; demands by target (M4 rising, M2 falling)."""
    def run(d: list[tuple], p: list[tuple]) -> list[tuple]:
        pool_, rows = _Pool([x for x, _ in p]), []
        for mark, qty, target in d:
            found = pool_.nearest_within(target, max(floor, rel * target), qty or 0) if target is not None else 0
            rows.append((mark, qty, target, found, _status(found, qty)))
        return rows

    target = F.col("target").cast("double")
    return _match_parts(demand, pool.select(*keys, "length"), keys, floor, rel, [-target if descending else target, F.col("mark")], _FOUND, run)


def best_fit_bars(demand: DataFrame, pool: DataFrame, keys: list[str]) -> DataFrame:
    """keys, mark, qty, filled: bars by length falling take the row of best ratio, first as one unit (ratio 0.75 to 1.30),
    then as two (1.75 to 2.45); a row takes up to its capacity."""
    def run(d: list[tuple], p: list[tuple]) -> list[tuple]:
        left = [qty or 0 for _, qty, _ in d]
        bars = [x for x, _ in reversed(p)]
        taken = [False] * len(bars)
        for units, low, high in ((1, 0.75, 1.30), (2, 1.75, 2.45)):
            for i, bar in enumerate(bars):
                if taken[i]:
                    continue
                fits = [(abs(bar / t - units), j) for j, (_, _, t) in enumerate(d) if left[j] >= units and t is not None and t > 0 and low <= bar / t <= high]
                if fits:
                    _, j = min(fits)
                    left[j] -= units
                    taken[i] = True
        return [(mark, qty, None if qty is None else qty - x) for (mark, qty, _), x in zip(d, left)]

    return _match(demand, pool, keys, keys, [F.col("mark"), F.col("target")], "mark {mark}, qty long, filled long", run)


def scored_assign(candidates: DataFrame, key: str, a: str, b: str, score: str) -> DataFrame:
    """key, a, b, score: candidates by (score, a, b), each side used once."""
    kinds = dict(candidates.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        seen_a, seen_b, keep = set(), set(), []
        for r in pdf.sort_values([score, a, b], kind="stable").itertuples():
            x, y = getattr(r, a), getattr(r, b)
            if x not in seen_a and y not in seen_b:
                seen_a.add(x)
                seen_b.add(y)
                keep.append(r.Index)
        return pdf.loc[keep, [key, a, b, score]]

    ship(candidates.sparkSession)
    return candidates.select(key, a, b, score).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {a} {kinds[a]}, {b} {kinds[b]}, {score} double")


class _Pool:
    """Sorted lengths of which each is used once; the next unused one is found by union-find, not by a scan."""

    def __init__(self, lengths):
        self.at = sorted(lengths)
        self.up = list(range(len(self.at) + 1))
        self.down = list(range(len(self.at) + 1))  # shifted by one: 0 stands for none

    @staticmethod
    def _root(links: list[int], i: int) -> int:
        while links[i] != i:
            links[i] = links[links[i]]
            i = links[i]
        return i

    def free_from(self, i: int) -> int:
        """The first unused place from i on; len(at) without one."""
        return self._root(self.up, i)

    def free_until(self, i: int) -> int:
        """The last unused place up to i; -1 without one."""
        return self._root(self.down, i + 1) - 1

    def use(self, i: int) -> None:
        self.up[i], self.down[i + 1] = i + 1, i

    def nearest(self, x: float) -> int | None:
        """The unused length nearest to x, the lower of two; None if all are used."""
        i = bisect_left(self.at, x)
        near = [j for j in (self.free_until(i - 1), self.free_from(i)) if 0 <= j < len(self.at)]
        return min(near, key=lambda j: (abs(self.at[j] - x), j)) if near else None

    def first_within(self, low: float, high: float, most: float) -> int:
        """Use the first unused lengths from low to high, ``most`` of them at most; how many."""
        n, i = 0, self.free_from(bisect_left(self.at, low))
        while n < most and i < len(self.at) and self.at[i] <= high:
            self.use(i)
            n, i = n + 1, self.free_from(i)
        return n

    def nearest_within(self, x: float, tol: float, most: int) -> int:
        """Use the unused lengths nearest to x, as long as they lie within tol."""
        n = 0
        while n < most:
            i = self.nearest(x)
            if i is None or abs(self.at[i] - x) > tol:
                break
            self.use(i)
            n += 1
        return n

    def left(self) -> list[float]:
        return [x for i, x in enumerate(self.at) if self.up[i] == i]


def excess(raw, current) -> list[float]:
    """What is left of the raw lengths when each current one, in order, takes the raw one nearest to it, however far."""
    pool = _Pool(raw)
    for x in current:
        i = pool.nearest(x)
        if i is None:
            break
        pool.use(i)
    return pool.left()


def _pools(pools: list[DataFrame], keys: list[str]) -> DataFrame:
    """Pools (keys, length) as one, told apart by ``tier``, so that a key's pools meet its demand in one exchange."""
    out = None
    for tier, pool in enumerate(pools):
        rows = pool.select(*keys, F.col("length").cast("double").alias("length"), F.lit(tier).alias("tier"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _lengths(p: list[tuple], tier: int) -> list[float]:
    return [x for x, t in p if t == tier]


def tiered(demand: DataFrame, pools: list[DataFrame], keys: list[str], floor: float = 30.0, rel: float = 0.08) -> DataFrame:
    """keys, mark, qty, found_1, found_2, found_3, verdict: marks by rising target (then mark) through three pools in one exchange.

    First the current pool by first fit; what lacks from the excess of the raw pool over the current one by nearest
    (see ``excess``), then from the permissive pool by nearest. Pools are shared: a length is used once. OK: the current pool suffices;
    RECOVERABLE: all three do; SHORT: something was found; else DEAD_END. Missing pools are empty.
    """
    def run(d: list[tuple], p: list[tuple]) -> list[tuple]:
        current = _lengths(p, 0)
        first, second, third = _Pool(current), _Pool(excess(_lengths(p, 1), current)), _Pool(_lengths(p, 2))
        rows = []
        for mark, qty, target in d:
            a = b = c = 0
            if qty is not None and target is not None:
                tol = max(floor, rel * target)
                a = first.first_within(target - tol, target + tol, qty)
                b = second.nearest_within(target, tol, qty - a)
                c = third.nearest_within(target, tol, qty - a - b)
            asked = float("inf") if qty is None else qty
            verdict = "OK" if a >= asked else "RECOVERABLE" if a + b + c >= asked else "SHORT" if a + b + c else "DEAD_END"
            rows.append((mark, qty, target, a, b, c, verdict))
        return rows

    ddl = "mark {mark}, qty long, target double, found_1 long, found_2 long, found_3 long, verdict string"
    return _match(demand, _pools(pools, keys), keys, keys, [F.col("target"), F.col("mark")], ddl, run)


def evidence_sweep(demand: DataFrame, pools: list[DataFrame], keys: list[str], floor: float = 30.0, rel: float = 0.08) -> DataFrame:
    """keys, mark, qty, found, unclaimed, verdict for the marks that the current pool leaves short, by rising target (then mark).

    The current pool goes by first fit. Of the raw pool a mark claims *all* unused lengths within tolerance, also one that is
    not short. POSSIBLE_BUG: more raw lengths than found ones; EVIDENCE_USED: some; DEAD_END: none. Marks that ask for nothing are left out.
    """
    def run(d: list[tuple], p: list[tuple]) -> list[tuple]:
        current, raw, rows = _Pool(_lengths(p, 0)), _Pool(_lengths(p, 1)), []
        for mark, qty, target in d:
            if not ((qty or 0) > 0 and (target or 0.0) > 0):
                continue
            tol = max(floor, rel * target)
            found = current.first_within(target - tol, target + tol, qty)
            more = raw.first_within(target - tol, target + tol, float("inf"))
            if found < qty:
                rows.append((mark, qty, target, found, more, "DEAD_END" if not more else "POSSIBLE_BUG" if more > found else "EVIDENCE_USED"))
        return rows

    ddl = "mark {mark}, qty long, target double, found long, unclaimed long, verdict string"
    return _match_parts(demand, _pools(pools, keys), keys, floor, rel, [F.col("target"), F.col("mark")], ddl, run)


def sequential_slices(demand: DataFrame, keys: list[str], order: list[str], qty: str) -> DataFrame:
    """Marks in order take consecutive pool places: adds first and last place (from 1)."""
    upto = F.sum(qty).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return demand.withColumn("last", upto).withColumn("first", F.col("last") - F.col(qty) + 1)


def budget_trim(df: DataFrame, keys: list[str], order: list, kg: str, budget: str) -> DataFrame:
    """Rows that stay when rows are dropped in order until the total is within the budget."""
    part = Window.partitionBy(*keys)
    before = F.coalesce(F.sum(kg).over(part.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("__left", F.sum(kg).over(part) - before).filter(F.col("__left") <= F.col(budget)).drop("__left")
