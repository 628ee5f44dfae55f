"""Rails: parallel outlines a diameter apart become bars, each stretch of a rail being used once."""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from . import joins


class _Free:
    """Stretches of a rail that no bar has taken: sorted, apart from each other."""

    def __init__(self, lo: float, hi: float):
        self.begin, self.end = [lo], [hi]

    def within(self, lo: float, hi: float) -> list[tuple[float, float]]:
        i, out = max(bisect_right(self.begin, lo) - 1, 0), []
        while i < len(self.begin) and self.begin[i] < hi:
            a, b = max(self.begin[i], lo), min(self.end[i], hi)
            if a < b:
                out.append((a, b))
            i += 1
        return out

    def cut(self, lo: float, hi: float) -> None:
        """Take out a stretch that lies in one free one."""
        i = bisect_right(self.begin, lo) - 1
        rest = [(a, b) for a, b in ((self.begin[i], lo), (hi, self.end[i])) if a < b]
        self.begin[i : i + 1], self.end[i : i + 1] = [a for a, _ in rest], [b for _, b in rest]


def rail_bars(rails: DataFrame, keys: list[str], low: float = 5.0, high: float = 34.0, least: float = 30.0) -> DataFrame:
    """(keys, rail_a, rail_b, off, lo, hi, dia): rails whose offsets differ by ``low`` to ``high`` are a bar where both are free.

    Pairs come by overlap falling; equal ones by (offset, lo, id) of the lower rail, then of the upper, falling. A pair takes
    each stretch of at least ``least`` that is free on both rails, and only that, so that a long rail serves several short ones.
    Keys hold the view and the direction; rails (rail, off, lo, hi), ids being unique in a key. Rails with a null have no bar.

    Pairs are made by a join on bands of the offset; what a task folds is the pairs of one key, not all rails of a sheet.
    """
    kinds = dict(rails.dtypes)

    def side(s: str) -> DataFrame:
        return rails.select(*keys, F.col("rail").alias(f"rail_{s}"), *[F.col(c).cast("double").alias(f"{c}_{s}") for c in ("off", "lo", "hi")])

    pairs = joins.band_join(side("a"), side("b"), keys, "off_a", "off_b", low, high)
    over = (F.least("hi_a", "hi_b") - F.greatest("lo_a", "lo_b")).alias("over")
    pairs = pairs.select(*keys, *[f"{c}_{s}" for s in "ab" for c in ("rail", "off", "lo", "hi")], over).filter(F.col("over") >= least)
    order = ["over", *[f"{c}_{s}" for s in "ab" for c in ("off", "lo", "rail")]]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        free: dict[object, _Free] = {}
        head, rows = [pdf[k].iloc[0] for k in keys], []
        for r in pdf.sort_values(order, ascending=False).itertuples(index=False):
            for rail, lo, hi in ((r.rail_a, r.lo_a, r.hi_a), (r.rail_b, r.lo_b, r.hi_b)):
                if rail not in free:
                    free[rail] = _Free(lo, hi)
            a, b = free[r.rail_a], free[r.rail_b]
            both = [s for lo, hi in a.within(max(r.lo_a, r.lo_b), min(r.hi_a, r.hi_b)) for s in b.within(lo, hi)]
            for lo, hi in both:
                if hi - lo >= least:
                    a.cut(lo, hi)
                    b.cut(lo, hi)
                    rows.append((*head, r.rail_a, r.rail_b, (r.off_a + r.off_b) / 2, lo, hi, r.off_b - r.off_a))
        return pd.DataFrame(rows, columns=[*keys, "rail_a", "rail_b", "off", "lo", "hi", "dia"])

    ship(rails.sparkSession)
    ddl = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], f"rail_a {kinds['rail']}, rail_b {kinds['rail']}, off double, lo double, hi double, dia double"])
    return pairs.groupBy(*keys).applyInPandas(run, ddl)
