"""Gate events as streams: debouncing with state, daily upserts with a mirror, faces against a registry that changes."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.attendance import daily, identify

_LOG = logging.getLogger(__name__)


def debounce_stream(events: DataFrame, keys: Sequence[str], seconds: float, delay: str = "1 hour") -> DataFrame:
    """(keys, t) emitted more than ``seconds`` after the last emitted one, by event time in each batch's order.

    Keys are a gate and a person: each gate counts for itself. State of a key is one number; it goes when the watermark is ``seconds`` past it.
    """
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        out = []
        for t in sorted(x for p in parts for x in p["t"]):
            if last is None or t - last > seconds:
                out.append(t)
                last = t
        state.update((last,))
        state.setTimeoutTimestamp(max(int((last + seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({**{n: [k] * len(out) for n, k in zip(keys, key)}, "t": out})

    marked = events.withWatermark("ts", delay).select(*keys, "ts", F.unix_seconds("ts").cast("double").alias("t"))
    kinds = dict(events.dtypes)
    ddl = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "t double"])
    return marked.groupBy(*keys).applyInPandasWithState(run, ddl, "last double", "append", GroupStateTimeout.EventTimeTimeout)


def merge_daily(old: DataFrame | None, batch: DataFrame) -> DataFrame:
    """The daily table after a batch: an IN fills a blank only, an OUT always overwrites."""
    new = daily(batch, "user_id", "ts", "mode", "event_id")
    if old is None:
        return new
    n = new.select(F.col("user_id").alias("u"), F.col("day").alias("d"), F.col("in_ts").alias("i"), F.col("out_ts").alias("o"))
    j = old.join(n, (F.col("user_id") == F.col("u")) & (F.col("day") == F.col("d")), "full_outer")
    return j.select(F.coalesce("user_id", "u").alias("user_id"), F.coalesce("day", "d").alias("day"), F.coalesce("in_ts", "i").alias("in_ts"), F.coalesce("o", "out_ts").alias("out_ts"))


def daily_upsert(stream: DataFrame, path: str, checkpoint: str, mirror: Callable[[DataFrame, int], None] | None = None):
    """Write the stream's daily table as versions under ``path``: one folder for each batch, so a batch that runs again
    overwrites only its own.

    ``mirror(table, batch)`` is given each version once it stands. It does its best: what it raises is logged and leaves
    the table and the stream as they are; as each version holds all days, the next call makes good a missed one.
    """
    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{path}/v{number - 1}") if number else None
        merge_daily(old, batch).write.mode("overwrite").parquet(f"{path}/v{number}")
        if mirror:
            try:
                mirror(spark.read.parquet(f"{path}/v{number}"), number)
            except Exception as e:  # the mirror's own trouble, whatever it is
                _LOG.warning("mirror of batch %d failed, the table is unaffected: %s", number, e)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def identify_stream(faces: DataFrame, registry: Callable[[], DataFrame], path: str, checkpoint: str, limit: float = 0.5):
    """(face, employee_id, distance) of a stream of faces (face, v) under ``path``, one folder for each batch.

    ``registry()`` gives the known people (employee_id, e) and is asked anew for every batch, so that whoever is enrolled
    or removed counts from the next batch on, without a restart. An empty registry leaves every face without an id.
    """
    def put(batch: DataFrame, number: int) -> None:
        known = registry()
        met = identify(batch, known, limit)
        out = batch.select("face").join(met, "face", "left") if known.isEmpty() else met
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return faces.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
