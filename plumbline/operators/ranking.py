"""Places over whole tables, without one task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import shared_folder, ship


def global_rank(df: DataFrame, order: list[Column | str], out: str) -> DataFrame:
    """df with ``out``: places from 1 by ``order``, as row_number over the whole table gives them (ties as they come).

    Rows are dealt by ranges of the order and kept so; a range's first place is the number of rows before it. One row
    for each range is broadcast. An empty table stays empty; a column of that name is replaced.
    """
    shared_folder(ship(df.sparkSession))
    dealt = df.drop(out).repartitionByRange(*order).withColumn("__range", F.spark_partition_id()).checkpoint()
    counts = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    firsts = counts.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) + F.col("__before")
    return dealt.join(F.broadcast(firsts), "__range").withColumn(out, place).drop("__range", "__before")
