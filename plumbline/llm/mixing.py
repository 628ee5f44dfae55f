"""Operator 3: mixing sources to target weights by entropy balancing.

Each source gets a token target. Documents get rates w that stay between 0 and LIMIT, meet every target, and
are as close to 1 as a bounded entropy allows; the optimum is an exponential tilt of the odds by the
document's size: w / (LIMIT - w) = exp(lambda * size / mean size) / (LIMIT - 1). The convex dual has one
multiplier for each source and is solved by safeguarded Newton steps whose gradients and curvatures are
aggregated by Spark from counts of (source, size). Rates are then rounded to whole copies, sizes in
descending order, each carrying the words still owed to the next, so a source misses its target by about
half its smallest document.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, free, prepare, ranked, stored, without

LIMIT = 3
WORD = r"[^\x20\x09-\x0D]+"
#: Newton or halving steps after which it is an error not to have ended.
STEPS = 200


def targets(sources: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Add rank, weight and target to (source, source_size): weights 1, 2, 3 repeating by code point, null last.

    Targets share all sizes by weight, stop at ``limit`` times a source's size, and the excess is reshared by
    weight until none is above. One row for each source goes through one window.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked_ = sources.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double"))
    ranked_ = ranked_.withColumn("most", F.col("source_size") * float(limit))
    # sources that stop are those with the least most / weight; the level is set by the others
    by = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = by.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(earlier), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)))
    held = ranked_.withColumn("level", level).withColumn("pos", F.row_number().over(by))
    held = held.withColumn("first", F.min(F.when(F.col("most") > F.col("level") * F.col("weight"), F.col("pos"))).over(everything))
    final = F.max(F.when(F.col("pos") == F.col("first"), F.col("level"))).over(everything)
    stops = F.col("first").isNull() | (F.col("pos") < F.col("first"))
    return held.withColumn("final", final).withColumn("target", F.when(stops, F.col("most")).otherwise(F.col("final") * F.col("weight"))).select("source", "source_size", "target")


def rate(lam, u, limit: int = LIMIT):
    return limit / (1 + (limit - 1) * F.exp(F.greatest(F.least(-lam * u, F.lit(700.0)), F.lit(-700.0))))


def rates(counts: DataFrame, wanted: DataFrame, limit: int = LIMIT, steps: int = STEPS, tolerance: float = 1e-5) -> DataFrame:
    """Multipliers by Newton steps: (source, source_size, target, mean, lam).

    ``counts``: source, size, n. A step that leaves the bracket known to hold the root is replaced by halving.
    Sources at their limit, or without words, need no step; a source ends when its target is met or its bracket
    has closed.
    """
    sums = counts.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean")).select(F.col("source").alias("k"), "mean")
    dual = wanted.join(sums, F.col("source").eqNullSafe(F.col("k")), "left").drop("k")
    idle = (F.col("source_size") == 0) | (F.col("target") >= F.col("source_size") * float(limit) * (1 - 1e-12))
    dual = stored(dual.select("source", "source_size", "target", "mean", F.lit(0.0).alias("lam"), F.lit(-1e8).alias("low"), F.lit(1e8).alias("high"), idle.alias("done")), "dual")
    for _ in range(steps):
        open_ = dual.filter("not done").select(F.col("source").alias("k"), "lam", "mean")
        u = F.col("size") / F.col("mean")
        w = rate(F.col("lam"), u, limit)
        grown = counts.join(open_, F.col("source").eqNullSafe(F.col("k"))).groupBy("k").agg(
            F.sum(F.col("n") * F.col("size") * w).alias("got"), F.sum(F.col("n") * F.col("size") * u * w * (1 - w / limit)).alias("slope"))
        joined = dual.join(grown.withColumnRenamed("k", "g"), F.col("source").eqNullSafe(F.col("g")), "left")
        miss = F.col("got") - F.col("target")
        low = F.when(miss < 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(miss > 0, F.col("lam")).otherwise(F.col("high"))
        step = F.col("lam") - miss / F.when(F.col("slope") > 1e-12, F.col("slope"))
        inside = (step > low) & (step < high)
        new = F.when(F.coalesce(inside, F.lit(False)), step).otherwise((low + high) / 2)
        done = F.col("done") | (F.abs(miss) <= tolerance * F.col("target")) | (high - low <= 1e-9 * F.greatest(F.lit(1.0), F.abs("lam")))
        before, dual = dual, stored(joined.select("source", "source_size", "target", "mean", F.when(done, F.col("lam")).otherwise(new).alias("lam"), F.when(done, F.col("low")).otherwise(low).alias("low"), F.when(done, F.col("high")).otherwise(high).alias("high"), done.alias("done")), "dual")
        forget(before)
        if dual.filter("not done").isEmpty():
            return dual
    raise RuntimeError(f"the dual did not settle in {steps} steps")


def copies_of_sizes(counts: DataFrame, dual: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Whole copies for each (source, size): adds ``copies``, to be dealt among its n documents.

    Grouped by source over counts, so a group has one row for each distinct size and not for each document. A
    null source is a group of its own; no rows give none.
    """
    saturated = (F.col("target") >= F.col("source_size") * float(limit) * (1 - 1e-12)) & (F.col("source_size") > 0)
    d = dual.select(F.col("source").alias("k"), "target", "mean", "lam", saturated.alias("full"))
    w = F.when(F.col("full"), F.lit(float(limit))).when(F.col("mean") > 0, rate(F.col("lam"), F.col("size") / F.col("mean"), limit)).otherwise(1.0)
    rated = counts.join(d, F.col("source").eqNullSafe(F.col("k"))).select("source", "size", "n", "target", w.alias("w"))

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ascending=False, ignore_index=True)
        owed, out = 0.0, []
        for size, n, w in zip(pdf["size"], pdf["n"], pdf["w"]):
            owed += size * n * w
            c = int(np.clip(np.floor(owed / size + 0.5), 0, limit * n)) if size > 0 else int(n)
            owed -= c * size
            out.append(c)
        return pd.DataFrame({"source": pdf["source"], "size": pdf["size"], "n": pdf["n"], "copies": out})

    prepare(counts.sparkSession)
    return rated.groupBy("source").applyInPandas(carry, "source string, size long, n long, copies long")


def mix(docs: DataFrame, size: str, source: str, key: list[str], limit: int = LIMIT) -> DataFrame:
    """Add source_size, target and copies (0 to ``limit``) to every row; ``key`` orders rows of equal size.

    Null sources are a source of their own, the last. Sizes of 0 keep one copy. An empty table stays empty. Equal
    rows are interchangeable; columns of the added names are replaced.
    """
    docs = without(docs, *({"source_size", "target", "copies"} - {size, source, *key}))
    z, src, rank, ks, kz, n, c = free(docs, "__size", "__source", "__rank", "__s", "__z", "__n", "__c")
    rows = docs.withColumn(z, F.col(size).cast("long")).withColumn(src, F.col(source))
    counts = stored(rows.groupBy(F.col(src).alias("source"), F.col(z).alias("size")).agg(F.count(F.lit(1)).alias("n")), "size-counts")
    wanted = targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), limit)
    dual = rates(counts, wanted, limit)
    made = copies_of_sizes(counts, dual, limit).join(dual.select(F.col("source").alias("k"), "source_size", "target"), F.col("source").eqNullSafe(F.col("k"))).drop("k")
    made = made.select(F.col("source").alias(ks), F.col("size").alias(kz), F.col("n").alias(n), F.col("copies").alias(c), "source_size", "target")
    placed = ranked(rows, [src, z], [F.col(k) for k in key], rank, 64)
    joined = placed.join(made, F.col(src).eqNullSafe(F.col(ks)) & (F.col(z) == F.col(kz)))
    copies = F.floor(F.col(c) / F.col(n)) + F.when(F.col(rank) < F.col(c) % F.col(n), 1).otherwise(0)
    return joined.withColumn("copies", copies.cast("int")).select(*docs.columns, "source_size", "target", "copies")


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def op3_entropy_mixing(spark, sf_dir: str) -> DataFrame:
    """Mix all documents: whole copies whose words come near each source's target.

    Null texts have size 0 and a null source is a source of its own; equal rows are interchangeable; an empty table
    gives no row.
    """
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("h"))
    out = mix(stored(docs, "mix-docs"), "size", "source", ["doc_id", "h"])
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")
