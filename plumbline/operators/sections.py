"""Marks placed by section evidence alone.

Marks in order take units in order of trust, so the n-th unit belongs to the mark whose quantities reach n: running
sums on both sides and one equi-join, without a walk through an element.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of cut and tiers of evidence, in the order in which marks take them.
KINDS = ["plan_cut", "end_cut"]
TIERS = ["cluster", "pitch", "single"]
EVIDENCE = {"cluster": "section_multi_cut", "pitch": "section_pitch", "single": "section_single_cut"}


def triangulate(units: DataFrame, marks: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys, mark, kind, tier, unit, seq, evidence: which unit of evidence places which bar of a mark.

    units: keys, kind, tier, unit, strength (cuts that see a cluster, circles of a pitch group, 1 for a single circle),
    n (circles to give out: 1 for clusters and singles). Plan cuts come before end cuts; in each, clusters, then pitch
    groups, then single circles, the stronger first (ties by unit), a group's circles one by one. ``seq`` is the circle's number in
    its group, from 0. marks: keys, mark, qty, columns of ``order``; marks of no or null quantity take nothing, those that
    come when all is taken neither. Units of other kinds or tiers, and of no circles, are not evidence.
    """
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")) * 10 + F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col("tier"))
    known = units.filter(F.col("kind").isin(*KINDS) & F.col("tier").isin(*TIERS) & (F.col("n") > 0)).withColumn("__p", place)
    upto = Window.partitionBy(*keys).orderBy("__p", F.desc("strength"), "unit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = known.withColumn("__last", F.sum("n").over(upto))
    total = numbered.groupBy(*keys).agg(F.max("__last").alias("__all"))
    each = numbered.select(*keys, "kind", "tier", "unit", "n", "__last", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("seq"))
    each = each.withColumn("__at", F.col("__last") - F.col("n") + F.col("seq") + 1)
    asked = marks.filter("qty > 0")
    sofar = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slices = asked.withColumn("__to", F.sum("qty").over(sofar)).join(total, keys).withColumn("__from", F.col("__to") - F.col("qty") + 1).filter(F.col("__from") <= F.col("__all"))
    wanted = slices.select(*keys, "mark", F.explode(F.sequence(F.col("__from").cast("long"), F.least("__to", "__all").cast("long"))).alias("__at"))
    told = F.element_at(F.create_map(*[F.lit(x) for pair in EVIDENCE.items() for x in pair]), F.col("tier"))
    return wanted.join(each, [*keys, "__at"]).select(*keys, "mark", "kind", "tier", "unit", "seq", told.alias("evidence"))
