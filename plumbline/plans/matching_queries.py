"""Greedy matching of demands to observed pools."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching
from .tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _sides(spark, sf_dir):
    """Demand: rows with flag A by supplier and part; pools: rows with flag R, N of status O, N of status F."""
    l = table(spark, sf_dir, "lineitem")
    demand = l.filter("l_returnflag = 'A'").groupBy("l_suppkey", F.col("l_partkey").alias("mark")).agg(F.count(F.lit(1)).cast("long").alias("qty"), F.round(F.min("l_extendedprice"), 2).alias("target"))
    pools = [l.filter(c).select("l_suppkey", F.col("l_extendedprice").alias("length")) for c in ("l_returnflag = 'R'", "l_returnflag = 'N' and l_linestatus = 'O'", "l_returnflag = 'N' and l_linestatus = 'F'")]
    return demand, pools


def greedy_first_fit(spark, sf_dir):
    """Marks in order take the first lengths within tolerance (M1)."""
    d, p = _sides(spark, sf_dir)
    return matching.first_fit(d, p[0], ["l_suppkey"])


def greedy_nearest(spark, sf_dir):
    """Rising demands take the nearest unused lengths (M4)."""
    d, p = _sides(spark, sf_dir)
    return matching.greedy_nearest(d, p[0], ["l_suppkey"])


def greedy_straight(spark, sf_dir):
    """Falling demands, wide tolerance (M2)."""
    d, p = _sides(spark, sf_dir)
    return matching.greedy_nearest(d, p[0], ["l_suppkey"], 80.0, 0.15, descending=True)


def greedy_bent(spark, sf_dir):
    """Falling demands, widest tolerance (M3)."""
    d, p = _sides(spark, sf_dir)
    return matching.greedy_nearest(d, p[0], ["l_suppkey"], 120.0, 0.20, descending=True)


def greedy_best_fit(spark, sf_dir):
    """Bars by length falling take the row of best ratio, in one or two units (M5)."""
    d, p = _sides(spark, sf_dir)
    return matching.best_fit_bars(d, p[0], ["l_suppkey"])


def tiered_verdict(spark, sf_dir):
    """Current pool, then excess of the raw pool, then permissive pool."""
    d, p = _sides(spark, sf_dir)
    return matching.tiered(d, p, ["l_suppkey"])


def evidence_sweep(spark, sf_dir):
    """Short marks against all raw lengths (M7)."""
    d, p = _sides(spark, sf_dir)
    return matching.evidence_sweep(d, p[:2], ["l_suppkey"])


def scored_assign(spark, sf_dir):
    """Global order of scores, each side used once (M8)."""
    from ..operators.joins import band_join

    d, p = _sides(spark, sf_dir)
    marks = d.select("l_suppkey", "mark", "target")
    items = p[0].groupBy("l_suppkey", "length").agg(F.count(F.lit(1)).alias("n")).select("l_suppkey", F.col("length").alias("item"), "length")
    c = band_join(marks, items, ["l_suppkey"], "target", "length", -200.0, 200.0)
    return matching.scored_assign(c.withColumn("score", 100 * F.abs(F.col("length") - F.col("target")) / F.col("target")), "l_suppkey", "mark", "item", "score")


QUERIES = {f.__name__: f for f in (greedy_first_fit, greedy_nearest, greedy_straight, greedy_bent, greedy_best_fit, tiered_verdict, evidence_sweep, scored_assign)}
