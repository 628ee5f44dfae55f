"""Operator 13: how five document filters interact, in every order in which they can be applied.

A relational word pipeline: words are exploded, counted by (document, word), then summed by document for totals and
distinct words; the other flags are outer-joined to them. What a filter order keeps and removes depends only on how
many documents fail which set of filters, so each part is told by 32 conditional counts (and as many of good and of
toxic documents), from which the 120 orders are read off. No order looks at documents again.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare

#: The filters' letters; filter i is bit i of a document's mask.
FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
#: Words lie between these characters.
GAP = "[\\x20\\x09-\\x0D]+"


def failures(docs: DataFrame, labels: DataFrame, min_words: int = 200, distinct_pct: int = 50, caps_pct: int = 2, marks: str = "[#$%&*|]") -> DataFrame:
    """(part, mask, good, toxic, n): documents by the set of filters they fail.

    A: fewer than min_words words; B: 100 * distinct < distinct_pct * words; C: 100 * capitals > caps_pct * code points;
    D: holds one of marks; E: the text of a smaller doc_id. Null texts are empty, null sources the part ''. A row
    without doc_id neither fails E nor makes others fail it. Repeated rows count each, also where they share a doc_id
    and differ in text. Labels repeated for a doc_id: one of them is enough. Only doc_id, text, source and the labels'
    doc_id, quality, toxic are read. An empty table gives no row.
    """
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", text.alias("text"), F.coalesce("source", F.lit("")).alias("part"), F.xxhash64(text).alias("h"))
    # equal rows are one before they are shuffled; from then on a document's words stay where its text is
    texts = docs.groupBy("doc_id", "h").agg(F.first("text").alias("text"))
    by_word = texts.select("doc_id", "h", F.explode(F.split("text", GAP)).alias("word")).filter("word <> ''").groupBy("doc_id", "h", "word").agg(F.count(F.lit(1)).alias("c"))
    by_doc = by_word.groupBy(F.col("doc_id").alias("wd"), F.col("h").alias("wh")).agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("distinct_words"))
    capitals = F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    flags = docs.select("doc_id", "h", "part", F.sha2("text", 256).alias("digest"), (100 * capitals > caps_pct * F.length("text")).alias("c"), F.col("text").rlike(marks).alias("d"))
    flags = flags.groupBy("doc_id", "h", "part", "digest", "c", "d").agg(F.count(F.lit(1)).alias("n"))
    # the first holder of each text; it is looked up by text and doc_id, so no text's copies meet in one task
    first = flags.filter("doc_id is not null").groupBy(F.col("digest").alias("fd")).agg(F.min("doc_id").alias("fi")).withColumn("first", F.lit(True))
    met = flags.join(first, (F.col("digest") == F.col("fd")) & (F.col("doc_id") == F.col("fi")), "left").join(by_doc, F.col("doc_id").eqNullSafe(F.col("wd")) & (F.col("h") == F.col("wh")), "left")
    total, distinct = F.coalesce("total", F.lit(0)), F.coalesce("distinct_words", F.lit(0))
    fails = [total < min_words, 100 * distinct < distinct_pct * total, F.col("c"), F.col("d"), F.col("doc_id").isNotNull() & F.col("first").isNull()]
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    masked = met.select("doc_id", "part", mask.alias("mask"), "n").groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    known = labels.groupBy(F.col("doc_id").alias("ld")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    rows = masked.join(known, F.col("doc_id") == F.col("ld"), "left").select("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"), "n")
    return rows.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def interaction_report(failed: DataFrame) -> DataFrame:
    """One row per part, filter order and step from ``failures``: what a filter removes at its place in an order.

    kept: after this step; removed: here; redundant: fail it but went before; unique_fails: fail nothing else;
    good_lost, toxic_lost: of those removed here; shapley: removed by the filter, summed over all orders.
    """
    counts = [F.sum(F.when(F.col("mask") == m, F.col("n") * F.col(w) if w else F.col("n")).otherwise(0)).alias(f"{w or 'n'}{m}") for w in ("", "good", "toxic") for m in range(MASKS)]
    parts = failed.groupBy("part").agg(*counts)
    cells = F.array(*[F.struct(F.lit(m).alias("mask"), *[F.col(f"{w}{m}").alias(w) for w in ("n", "good", "toxic")], F.lit(math.factorial(len(FILTERS)) // max(m.bit_count(), 1)).alias("firsts")) for m in range(MASKS)])
    # orders and steps are fixed: their rows are exploded for each part
    steps = [f"{o} {i + 1} {1 << FILTERS.index(x)} {sum(1 << FILTERS.index(y) for y in o[:i])}" for o in map("".join, permutations(FILTERS)) for i, x in enumerate(o)]
    rows = parts.select("part", cells.alias("cells"), F.explode(F.split(F.lit(",".join(steps)), ",")).alias("at")).withColumn("at", F.split("at", " "))
    rows = rows.select("part", "cells", F.col("at")[0].alias("filter_order"), *[F.col("at")[i].cast("int").alias(c) for i, c in ((1, "step"), (2, "bit"), (3, "before"))])
    bit, before = F.col("bit"), F.col("before")

    def total(what, fails: bool | None, gone: bool | None) -> Column:
        """Sum over the masks that hold this filter's bit, or an earlier one's, or don't (None: either)."""

        def one(x: Column) -> Column:
            ok = F.lit(True)
            ok = ok if fails is None else ok & ((x["mask"].bitwiseAND(bit) != 0) == F.lit(fails))
            return ok if gone is None else ok & ((x["mask"].bitwiseAND(before) != 0) == F.lit(gone))

        return F.aggregate(F.filter("cells", one), F.lit(0).cast("long"), lambda sofar, x: sofar + what(x))

    return rows.select(
        "part",
        "filter_order",
        "step",
        total(lambda x: x["n"], False, False).alias("kept"),
        total(lambda x: x["n"], True, False).alias("removed"),
        total(lambda x: x["n"], True, True).alias("redundant"),
        F.get("cells", bit)["n"].alias("unique_fails"),
        total(lambda x: x["good"], True, False).alias("good_lost"),
        total(lambda x: x["toxic"], True, False).alias("toxic_lost"),
        # of the orders, one in as many as a document's failures has this filter before its others
        total(lambda x: x["n"] * x["firsts"], True, None).alias("shapley"),
    )


ORACLE_SQL = """
with d as (select doc_id, coalesce(source, '') part, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') ws from documents),
f as (select doc_id, part, (case when len(ws) < 200 then 1 else 0 end) + (case when 100 * len(list_distinct(ws)) < 50 * len(ws) then 2 else 0 end)
  + (case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) then 4 else 0 end) + (case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end)
  + (case when doc_id > min(doc_id) over (partition by t) then 16 else 0 end) m from d),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) good, max(case when toxic = 1 then 1 else 0 end) toxic from labels group by doc_id),
g as (select part, m, count(*) n, sum(coalesce(good, 0)) good, sum(coalesce(toxic, 0)) toxic from f left join l using (doc_id) group by all),
x as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(c, b)),
o as (select a.c || b.c || c.c || d.c || e.c filter_order, [a.b, b.b, c.b, d.b, e.b] bits from x a, x b, x c, x d, x e where a.b + b.b + c.b + d.b + e.b = 31 and len(list_distinct([a.b, b.b, c.b, d.b, e.b])) = 5),
s as (select filter_order, step, bits[step] bit, cast(coalesce(list_sum(bits[:step - 1]), 0) as integer) before from o, (select unnest(range(1, 6)) step)),
r as (select part, filter_order, cast(step as integer) step, bit,
  sum(case when m & (bit | before) = 0 then n else 0 end) kept, sum(case when m & bit <> 0 and m & before = 0 then n else 0 end) removed,
  sum(case when m & bit <> 0 and m & before <> 0 then n else 0 end) redundant, sum(case when m = bit then n else 0 end) unique_fails,
  sum(case when m & bit <> 0 and m & before = 0 then good else 0 end) good_lost, sum(case when m & bit <> 0 and m & before = 0 then toxic else 0 end) toxic_lost
  from g, s group by all)
select part, filter_order, step, cast(kept as bigint) kept, cast(removed as bigint) removed, cast(redundant as bigint) redundant, cast(unique_fails as bigint) unique_fails,
  cast(good_lost as bigint) good_lost, cast(toxic_lost as bigint) toxic_lost, cast(sum(removed) over (partition by part, bit) as bigint) shapley from r
"""


def op13_filter_interactions(spark, sf_dir: str) -> DataFrame:
    """The interaction of filters A to E over all documents, by source, for all 120 orders.

    Null and empty texts have no words (they fail A only, or E); very long texts are exploded whole; repeated rows
    count each; further columns are not read; an empty table gives no row.
    """
    prepare(spark)
    return interaction_report(failures(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")))
