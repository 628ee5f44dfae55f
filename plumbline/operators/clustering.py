"""One-dimensional clusters, interval unions, folds along an order, and components of links."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..runtime import shared_folder, ship, stored
from .joins import touching_boxes


def single_link(df: DataFrame, keys: list[str], value: str, tol: float, out: str = "cluster") -> DataFrame:
    """Cluster number from 0: a gap over ``tol`` to the previous value begins a new one."""
    w = Window.partitionBy(*keys).orderBy(value)
    gap = F.col(value) - F.lag(value).over(w)
    return df.withColumn("__new", F.when(gap > tol, 1).otherwise(0)).withColumn(out, F.sum("__new").over(w)).drop("__new")


def _fold(df: DataFrame, keys: list[str], value: str, out: dict[str, str], step: Callable[[Any, float], tuple[Any, tuple | None]], close: Callable[[Any], tuple | None]) -> DataFrame:
    """Rows (keys, out) that a pass over each key's values, from low to high, gives; null values take no part.

    For rules that look back at the last thing taken, which no window can carry. Rows are dealt by key and sorted by Spark,
    which spills; ``step(state, value)``, with None as state where a key begins, gives the next state and a row to give out
    or None, and ``close`` the last row. A worker holds one state and one Arrow batch, however many rows a key has.
    """
    kinds = [T.StructField(k, df.schema[k].dataType) for k in keys]
    spark_kinds = {"long": T.LongType(), "double": T.DoubleType()}
    schema = T.StructType([*kinds, *[T.StructField(n, spark_kinds[k]) for n, k in out.items()]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None

        def batch(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found)) if found else [[] for _ in arrow]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for part in batches:
            found: list[tuple] = []
            *heads, values = [c.to_pylist() for c in part.columns]
            for key, v in zip(zip(*heads) if heads else repeat(()), values):
                if key != held:
                    last = close(state) if state is not None else None
                    if last is not None:
                        found.append((*held, *last))
                    held, state = key, None
                state, row = step(state, v)
                if row is not None:
                    found.append((*key, *row))
            yield batch(found)
        last = close(state) if state is not None else None
        if last is not None:
            yield batch([(*held, *last)])

    ship(df.sparkSession)
    rows = df.select(*keys, F.col(value).cast("double").alias("__v")).filter("__v is not null")
    dealt = rows.repartition(*keys) if keys else rows.repartition(1)
    return dealt.sortWithinPartitions(*keys, "__v").mapInArrow(run, schema)


def _islands(df: DataFrame, keys: list[str], value: str, reach: Callable[[Column], Column]) -> DataFrame:
    """df with ``__island``: a value beyond the previous one by more than ``reach(previous)`` begins a new one.

    A rule that starts afresh there folds islands apart: a key's rows are sorted once by Spark and then dealt by island.
    """
    along = Window.partitionBy(*keys).orderBy(value)
    before = F.lag(value).over(along)
    new = F.when(F.col(value) - before > reach(before), 1).otherwise(0)
    return df.filter(F.col(value).isNotNull()).withColumn("__new", new).withColumn("__island", F.sum("__new").over(along)).drop("__new")


def anchor_groups(df: DataFrame, keys: list[str], value: str, tol: float, rel: float = 0.0) -> DataFrame:
    """One row for each group (keys, group_no, anchor, n): values join while within max(tol, rel * first) of the group's first.

    A gap over that from the last value is one from the first too, so islands between such gaps are folded apart (rel: 0 or more).
    """

    def step(state, v):
        if state is None:
            return (0, v, 1), None
        number, anchor, n = state
        if v - anchor <= max(tol, rel * anchor):
            return (number, anchor, n + 1), None
        return (number + 1, v, 1), state

    apart = _islands(df.withColumn(value, F.col(value).cast("double")), keys, value, lambda before: F.greatest(F.lit(float(tol)), F.lit(float(rel)) * before))
    groups = _fold(apart, [*keys, "__island"], value, {"group_no": "long", "anchor": "double", "n": "long"}, step, lambda state: state)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("anchor")) - 1
    return groups.select(*keys, number.cast("long").alias("group_no"), "anchor", "n")


def interval_union(df: DataFrame, keys: list[str], lo: str, hi: str, gap: float | Column = 0) -> DataFrame:
    """(keys, lo, hi, n): islands of intervals that overlap or lie at most ``gap`` apart; equal intervals are numbered together."""
    w = Window.partitionBy(*keys).orderBy(lo, hi)
    reach = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("__new", F.when(reach.isNull() | (F.col(lo) > reach + gap), 1).otherwise(0))
    numbered = marked.withColumn("__island", F.sum("__new").over(w))
    return numbered.groupBy(*keys, "__island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi), F.count(F.lit(1)).alias("n")).drop("__island")


def debounced(df: DataFrame, keys: list[str], ts: str, seconds: float) -> DataFrame:
    """(keys, ts) of emitted events: more than ``seconds`` after the last emitted one. Counts from emissions, so it is a fold.

    After a gap of more than ``seconds`` the next event is emitted whatever came before: islands are folded apart.
    """

    def step(last, t):
        return (t, (t,)) if last is None or t - last > seconds else (last, None)

    apart = _islands(df.withColumn(ts, F.col(ts).cast("double")), keys, ts, lambda before: F.lit(float(seconds)))
    return _fold(apart, [*keys, "__island"], ts, {ts: "double"}, step, lambda last: None).drop("__island")


def pitch_runs(df: DataFrame, keys: list[str], value: str, floor: float = 8.0, rel: float = 0.18) -> DataFrame:
    """(keys, run_no, n, pitch, lo, hi): the first nonzero gap sets the pitch; a gap off by more than max(floor, rel) ends the run."""

    def step(state, x):
        if state is None:
            return (0, 1, None, x, x), None
        number, n, pitch, lo, hi = state
        gap = x - hi
        if gap == 0 or pitch is None or abs(gap - pitch) <= max(floor, rel * pitch):
            return (number, n + 1, gap if pitch is None and gap else pitch, lo, x), None
        return (number + 1, 1, None, x, x), state

    return _fold(df, keys, value, {"run_no": "long", "n": "long", "pitch": "double", "lo": "double", "hi": "double"}, step, lambda state: state)


def outline_components(boxes: DataFrame, keys: list[str], gap: float = 3.0, least: int = 3) -> DataFrame:
    """(keys, component, n, x0, y0, x1, y1): outlines joined by boxes at most ``gap`` apart; those of fewer than ``least`` go.

    Boxes (keys, id, x0, y0, x1, y1), ids being unique over all keys; a component is named by its least id.
    Equal boxes are one, and others are linked in cells by few pairs, so crowds make no more links than boxes.
    """
    sides = ["x0", "y0", "x1", "y1"]
    whole = boxes.select(*keys, "id", *sides).dropna()
    # a box touches its copies, but for one whose sides are the wrong way round by more than the gap
    apart = F.when((F.col("x0") - gap > F.col("x1")) | (F.col("y0") - gap > F.col("y1")), F.col("id"))
    once = whole.groupBy(*keys, *sides, apart.alias("__apart")).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    once = stored(once.drop("__apart"), "outlines")
    named = components(once.select(F.col("id").alias("node")), touching_boxes(once, keys, gap, True))
    ends = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    return once.join(named, F.col("id") == F.col("node")).groupBy(*keys, "component").agg(F.sum("n").alias("n"), *ends).filter(F.col("n") >= least)


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component): least node reachable. Links with an end that is no node don't count.

    Alternating large-star and small-star steps: the number of rounds grows with the logarithm of a component's
    diameter. Each round is checkpointed; links that still change after ``rounds`` raise.
    """
    shared_folder(nodes.sparkSession)
    known = nodes.select("node").distinct()
    whole = edges.select("a", "b").join(known.withColumnRenamed("node", "a"), "a", "left_semi").join(known.withColumnRenamed("node", "b"), "b", "left_semi")
    links = whole.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).filter("lo <> hi").distinct().checkpoint()
    sums = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")).alias("h")]
    before = links.agg(*sums).first()
    for _ in range(rounds):
        both = links.select(F.col("hi").alias("n"), F.col("lo").alias("m")).unionByName(links.select(F.col("lo").alias("n"), F.col("hi").alias("m")))
        least = both.groupBy("n").agg(F.least(F.min("m"), F.first("n")).alias("r"))
        large = both.filter("m > n").join(least, "n").select(F.col("r").alias("lo"), F.col("m").alias("hi")).distinct()
        down = large.groupBy("hi").agg(F.min("lo").alias("r"))
        small = large.join(down, "hi").select(F.col("r").alias("lo"), F.col("lo").alias("hi")).filter("lo <> hi").unionByName(down.select(F.col("r").alias("lo"), "hi"))
        links = small.distinct().checkpoint()
        after = links.agg(*sums).first()
        if after == before:  # a star forest repeats itself
            break
        before = after
    else:
        raise RuntimeError(f"components: links still change after {rounds} rounds")
    roots = links.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("component"))
