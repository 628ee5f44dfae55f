"""Counts, rollups, agreements and findings over schedules, models and drawings."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import ship


def money(c: Column) -> Column:
    """Exact sums: two places, as decimals."""
    return c.cast("decimal(18,2)")


def diameter_rollup(rows: DataFrame, panel: str, dia: str, qty: str, length: str) -> DataFrame:
    """panel, dia, n_rows, qty, length, g_panel, g_dia: sums by panel and diameter, by panel, and over all (A10).

    g_panel and g_dia are 1 where a row sums over all of them, so that a null diameter is told from the sum.
    """
    sums = rows.rollup(panel, dia).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(qty).alias("qty"), F.sum(money(F.col(length))).cast("double").alias("length"), F.grouping(panel).alias("g_panel"), F.grouping(dia).alias("g_dia"))
    return sums.select(F.col(panel).alias("panel"), F.col(dia).alias("dia"), "n_rows", "qty", "length", "g_panel", "g_dia")


def kind_census(entities: DataFrame, keys: list[str], instance: str, drawn: str) -> DataFrame:
    """keys, n, instances, drawn: entities, distinct instances and drawn length of each kind (A9). Null lengths add nothing."""
    return entities.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(instance).alias("instances"), F.sum(F.col(drawn).cast("decimal(18,4)")).cast("double").alias("drawn"))


def distance_stats(rows: DataFrame, key: str, value: str, near: float) -> DataFrame:
    """key, med, p90, within: exact median, ninth decile and share at most ``near`` of a distance, 4 places."""
    share = F.count_if(F.col(value) <= near).cast("double") / F.count(F.lit(1))
    return rows.groupBy(key).agg(F.round(F.percentile(value, F.lit(0.5)), 4).alias("med"), F.round(F.percentile(value, F.lit(0.9)), 4).alias("p90"), F.round(share, 4).alias("within"))


def projected_counts(rows: DataFrame, value: str, step: int, by: str) -> DataFrame:
    """key, by, n: rows by a coordinate cut to multiples of ``step``, and ``by``."""
    return rows.groupBy((F.floor(F.col(value) / step).cast("bigint") * step).alias("key"), by).agg(F.count(F.lit(1)).alias("n"))


def against_first(rows: DataFrame, mark: str, source: str, fields: dict[str, float | None]) -> DataFrame:
    """mark, base_src, src, <field>_diff: sources of a mark that differ from its first by source.

    fields: the largest difference that still is none, or null for equality. A source is a row for each mark.
    """
    first = rows.groupBy(mark).agg(F.min_by(F.struct(source, *fields), source).alias("__f"))
    j = rows.join(first, mark).filter(F.col(source) != F.col(f"__f.{source}"))
    differs = {f: (F.col(f) != F.col(f"__f.{f}")) if t is None else (F.abs(F.col(f) - F.col(f"__f.{f}")) > t) for f, t in fields.items()}
    told = j.select(mark, F.col(f"__f.{source}").alias("base_src"), F.col(source).alias("src"), *[F.coalesce(d, F.lit(False)).cast("int").alias(f"{f}_diff") for f, d in differs.items()])
    return told.filter(reduce(Column.__or__, [F.col(f"{f}_diff") == 1 for f in fields]))


def source_agreement(rows: DataFrame, mark: str, source: str, value: str, tol: float = 1.0) -> DataFrame:
    """mark, sources, status: SINGLE_SOURCE, AGREE if all values are within ``tol`` of the first source's, else DISAGREE."""
    sums = rows.groupBy(mark).agg(F.count(F.lit(1)).alias("sources"), F.min(value).alias("__lo"), F.max(value).alias("__hi"), F.min_by(value, source).alias("__v"))
    apart = F.greatest(F.col("__hi") - F.col("__v"), F.col("__v") - F.col("__lo"))
    return sums.select(mark, "sources", F.when(F.col("sources") == 1, "SINGLE_SOURCE").when(apart <= tol, "AGREE").otherwise("DISAGREE").alias("status"))


def combined_sheets(sheets: DataFrame, base: str, total: str, demand: Column, share: float = 0.95) -> DataFrame:
    """base, total, sheets, verdict: what the sheets of one base hold together, OK from ``share`` of the demand."""
    t = F.sum(total).cast("double")
    return sheets.groupBy(base).agg(t.alias("total"), F.count(F.lit(1)).alias("sheets"), F.when(t >= share * demand, "OK").otherwise("SHORTFALL").alias("verdict"))


def best_candidate(rows: DataFrame, group: str, item: str, preferred: Column, size: str) -> DataFrame:
    """grp, best, n_views, extras: the candidate of each group, preferred ones first, then the largest, ties to the smaller item."""
    rank = F.struct(F.when(preferred, 0).otherwise(1).alias("p"), (-F.col(size)).alias("s"), F.col(item).alias("i"), F.col(size).alias("n"))
    best = rows.groupBy(F.col(group).alias("grp")).agg(F.min(rank).alias("b"), (F.count(F.lit(1)) - 1).alias("extras"))
    return best.select("grp", F.col("b.i").alias("best"), F.col("b.n").alias("n_views"), "extras")


def ranked_candidates(rows: DataFrame, key: str, item: str, order: list[Column], top: int) -> DataFrame:
    """key, item, rank_no: the first ``top`` candidates of each key by ``order``, then by item."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order, item))
    return rows.select("*", rank.alias("rank_no")).filter(F.col("rank_no") <= top).select(key, item, "rank_no")


def known_sizes(rows: DataFrame, key: str, catalogue: DataFrame, size: str, sizes: list[int]) -> DataFrame:
    """Distinct keys whose catalogue entry (of the same key) has one of the standard sizes."""
    good = catalogue.filter(F.col(size).isin(*sizes)).select(F.col(catalogue.columns[0]).alias(key))
    return rows.select(key).distinct().join(good.distinct(), key, "left_semi")


def without_evidence(rows: DataFrame, key: str, evidence: DataFrame, on: str) -> DataFrame:
    """Rows that no evidence names (J12): phantoms. A row of null key has none."""
    return rows.join(evidence.select(F.col(on).alias(key)).distinct(), key, "left_anti")


def set_report(left: DataFrame, right: DataFrame, third: DataFrame, fourth: DataFrame, both: str, only: str) -> DataFrame:
    """k, side: keys that two sides share, and keys that a third has and a fourth lacks (O8). One column each; distinct, nulls equal."""
    one = lambda df: df.toDF("k")
    return one(left).intersect(one(right)).withColumn("side", F.lit(both)).unionByName(one(third).subtract(one(fourth)).withColumn("side", F.lit(only)))


def findings(*checks: tuple[str, DataFrame, str, str, Column]) -> DataFrame:
    """check_name, id, val of the rows that fail each check (name, rows, id, value, condition) (O9). A null value fails none."""
    return reduce(DataFrame.unionByName, [df.filter(bad).select(F.lit(name).alias("check_name"), F.col(i).cast("bigint").alias("id"), F.col(v).cast("double").alias("val")) for name, df, i, v, bad in checks])


def sleeves(arcs: DataFrame, keys: list[str], start: str, end: str, least: float = 100.0) -> DataFrame:
    """keys, coverage, arcs: circles of which arcs cover at least ``least`` degrees in sum (C14)."""
    turn = F.pmod(F.col(end) - F.col(start) + 360, F.lit(360))
    return arcs.groupBy(*keys).agg(F.sum(turn).alias("coverage"), F.count(F.lit(1)).alias("arcs")).filter(F.col("coverage") >= least)


def remapped(rows: DataFrame, frames: DataFrame, view: str, x: str) -> DataFrame:
    """rows with ``x_there``: a coordinate of a view's crop (c0, c1) in its extent (e0, e1), 4 places (J16). Frames without width map nothing."""
    f = frames.filter("c1 > c0").select(view, "c0", "c1", "e0", "e1")
    return rows.join(f, view).withColumn("x_there", F.round(F.col("e0") + (F.col(x) - F.col("c0")) / (F.col("c1") - F.col("c0")) * (F.col("e1") - F.col("e0")), 4)).drop("c0", "c1", "e0", "e1")


def schedule_fit(marks: DataFrame, tags: DataFrame, schedule: str, slack: float = 25.0) -> DataFrame:
    """schedule, element, score, tag_overlap: the element that a schedule belongs to.

    marks: schedule, row, mark, len, qty; tags: mark, element, span. Candidates are elements with a tag of one of the
    schedule's marks. Score: 200 times the share of marks that the element's tags name; less the metres by which bars
    are longer than its span and ``slack``; plus 50 times the longest bar over the span, 50 at most. The highest score
    has it, ties go to the greater element.
    """
    want = marks.groupBy(schedule).agg(F.countDistinct("mark").alias("want"))
    met = marks.select(schedule, "mark").distinct().join(tags, "mark")
    both = met.groupBy(schedule, "element").agg(F.countDistinct("mark").alias("both"))
    fit = met.select(schedule, "element", "span").distinct().join(marks, schedule)
    over = F.sum((F.greatest(F.col("len") - F.col("span") - slack, F.lit(0)) * F.col("qty")).cast("decimal(18,3)")).cast("double")
    fit = fit.groupBy(schedule, "element").agg((-over / 1000 + F.least(F.max("len") / F.max("span"), F.lit(1)) * 50).alias("fit"))
    share = F.col("both").cast("double") / F.col("want")
    scored = fit.join(both, [schedule, "element"]).join(want, schedule).select(schedule, "element", F.round(share * 200 + F.col("fit"), 6).alias("score"), F.round(share, 2).alias("tag_overlap"))
    return scored.groupBy(schedule).agg(F.max(F.struct("score", "element", "tag_overlap")).alias("b")).select(schedule, "b.element", "b.score", "b.tag_overlap")


def reach(value: np.ndarray, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest double x with |x - value| / max(value, 1) <= tol, as these operations round."""
    size = np.maximum(value, 1.0)
    fits = lambda x: np.abs(x - value) / size <= tol
    ends = []
    for sign in (-1.0, 1.0):
        x = value + sign * tol * size
        while (off := ~fits(x)).any():
            x = np.where(off, np.nextafter(x, -sign * np.inf), x)
        while (more := fits(np.nextafter(x, sign * np.inf))).any():
            x = np.where(more, np.nextafter(x, sign * np.inf), x)
        ends.append(x)
    return ends[0], ends[1]


def _bars_near(asked: DataFrame, held: DataFrame, tol: float) -> DataFrame:
    """(dia, at, near, bars): of each asked length the number of held ones (dia, len, n) within ``tol``, and the sum of their n.

    The rounded distance grows with the true one, so what is near lies between two ends: differences of running sums along
    the lengths of a diameter, without pairs.
    """
    ship(asked.sparkSession)

    def ends(parts):
        for pdf in parts:
            pdf["lo"], pdf["hi"] = reach(pdf["at"].to_numpy(float), tol)
            yield pdf

    dia = asked.schema["dia"].dataType.simpleString()
    known = asked.select("dia", F.col("at").cast("double").alias("at")).filter(F.abs("at") < float("inf")).distinct()
    bounds = known.mapInPandas(ends, f"dia {dia}, at double, lo double, hi double")
    none = F.lit(None).cast("double").alias("at")
    # at equal places: lower ends, lengths, upper ends
    marks = [bounds.select("dia", F.col(c).alias("x"), F.lit(k).alias("k"), "at", F.lit(0).cast("long").alias("c"), F.lit(0).cast(held.schema["n"].dataType).alias("n")) for c, k in (("lo", 0), ("hi", 2))]
    rows = held.filter("len is not null").select("dia", F.col("len").cast("double").alias("x"), F.lit(1).alias("k"), none, F.lit(1).cast("long").alias("c"), F.coalesce("n", F.lit(0)).alias("n"))
    so_far = Window.partitionBy("dia").orderBy("x", "k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = marks[0].unionByName(marks[1]).unionByName(rows).withColumns({"c": F.sum("c").over(so_far), "n": F.sum("n").over(so_far)}).filter("k <> 1")
    less = lambda c: F.sum(F.when(F.col("k") == 2, F.col(c)).otherwise(-F.col(c)))
    return summed.groupBy("dia", "at").agg(less("c").alias("near"), less("n").alias("bars"))


def unlocated_reasons(marks: DataFrame, runs: DataFrame, tol: float = 0.1) -> DataFrame:
    """mark, pool, legs, reason: why bars of a mark were not found.

    marks: mark, dia, cut, leg, qty, located; runs: dia, len, n. pool and legs: bars of runs within ``tol`` of the cut
    length and of the leg. In this order: no run of the diameter; none near either length; some bars located; only legs
    match; fewer drawn than scheduled; else others claimed them. Runs are counted along their lengths and never meet marks one by one.
    """
    held = runs.filter("dia is not null").groupBy("dia", "len").agg(F.sum("n").alias("n"))
    some = held.groupBy("dia").agg(F.count("len").alias("runs"))
    asked = marks.select("dia", F.col("cut").alias("at")).unionByName(marks.select("dia", F.col("leg").alias("at")))
    near = _bars_near(asked.filter("dia is not null"), held, tol)
    j = marks.join(some, "dia", "left")
    for c in ("cut", "leg"):
        j = j.withColumn("at", F.col(c).cast("double")).join(near.withColumnsRenamed({"near": f"near_{c}", "bars": f"bars_{c}"}), ["dia", "at"], "left").drop("at")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    told = F.max((F.coalesce("runs", F.lit(0)) > 0) & (F.col("cut").isNotNull() | F.col("leg").isNotNull()))
    g = j.groupBy("mark").agg(total("runs").alias("runs"), told.alias("told"), (total("near_cut") + total("near_leg")).alias("near"), total("bars_cut").alias("pool"), total("bars_leg").alias("legs"), F.max("qty").alias("qty"), F.max("located").alias("located"))
    reason = F.when(F.col("runs") == 0, "NO_BAR_OF_DIAMETER").when(F.col("told") & (F.col("near") == 0), "NO_RUN_OF_LENGTH").when(F.col("located") > 0, "PARTLY_DRAWN").when(F.col("pool") == 0, "LEG_MATCH_ONLY").when(F.col("pool") < F.col("qty"), "TOO_FEW_DRAWN").otherwise("CLAIMED_BY_OTHERS")
    return g.select("mark", "pool", "legs", reason.alias("reason"))
