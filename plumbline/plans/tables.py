"""Access to the parquet tables, by name or from SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query that Spark SQL runs over the tables that its text names."""
    used = [n for n in NAMES if re.search(rf"\b{n}\b", text)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _views(spark, sf_dir, used).sql(text)

    return run


def _views(spark: SparkSession, sf_dir: str, names: list[str]) -> SparkSession:
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)
    return spark
