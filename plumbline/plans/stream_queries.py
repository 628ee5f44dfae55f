"""Streams run to their end over the parquet tables, to be compared with their batch twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..runtime import shared_folder, ship
from ..streaming import gate
from .tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _folder(spark) -> str:
    return f"{shared_folder(ship(spark))}/stream-{uuid.uuid4().hex}"


def _source(spark, sf_dir, folder):
    """Events as a file stream. A stream reads a folder, so the table is first laid there."""
    table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{folder}/in")
    return spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double, props string").parquet(f"{folder}/in")


def stream_debounce(spark, sf_dir):
    """Debounced events of the stream by gate (the event type) and person."""
    folder = _folder(spark)
    q = gate.debounce_stream(_source(spark, sf_dir, folder), ["event_type", "user_id"], 7200.0).writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("event_type string, user_id long, t double").parquet(f"{folder}/out")


def stream_daily_upsert(spark, sf_dir):
    """Daily rows kept up by batches of the stream."""
    folder = _folder(spark)
    s = _source(spark, sf_dir, folder).filter("event_type in ('view', 'purchase')")
    q = gate.daily_upsert(s.select("user_id", "ts", F.when(F.col("event_type") == "view", "in").otherwise("out").alias("mode"), "event_id"), f"{folder}/daily", f"{folder}/state")
    q.awaitTermination()
    last = q.lastProgress["batchId"] if q.lastProgress else 0
    return spark.read.parquet(f"{folder}/daily/v{max(last, 0)}")


def stream_mirror(spark, sf_dir):
    """The mirror of the daily rows: a second sink of the same batches."""
    folder = _folder(spark)
    s = _source(spark, sf_dir, folder).filter("event_type in ('view', 'purchase')")
    q = gate.daily_upsert(s.select("user_id", "ts", F.when(F.col("event_type") == "view", "in").otherwise("out").alias("mode"), "event_id"), f"{folder}/daily", f"{folder}/state", lambda t, n: t.write.mode("overwrite").parquet(f"{folder}/mirror"))
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/mirror")


def stream_identify(spark, sf_dir):
    """Nearest known encoding of a stream of faces, the registry being read anew for each batch."""
    folder = _folder(spark)
    e = table(spark, sf_dir, "embeddings")
    faces = e.filter("vec_id % 25 <> 0").select(F.col("vec_id").alias("face"), F.col("embedding").alias("v"))
    faces.write.parquet(f"{folder}/in")
    known = lambda: e.filter("vec_id % 25 = 0").select(F.col("vec_id").alias("employee_id"), F.col("embedding").alias("e"))
    gate.identify_stream(spark.readStream.schema(faces.schema).parquet(f"{folder}/in"), known, f"{folder}/out", f"{folder}/state", 0.9).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("face", "employee_id", F.round("distance", 6).alias("distance"))


QUERIES = {f.__name__: f for f in (stream_debounce, stream_daily_upsert, stream_mirror, stream_identify)}
