"""Helpers shared by the corpus operators: shared storage, worker imports, distributed ranks."""

from __future__ import annotations

import contextlib
import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..runtime import shared_folder, ship

#: Buckets in which a rank is first counted, so that no window holds a whole hot key: so many at least, and as many
#: as RANK_SHARE times the shuffle partitions, which a session sets by its data.
RANK_BUCKETS, RANK_SHARE = 512, 2

#: A key is hot if it holds more than one of HOT parts of all rows: there are fewer than HOT of them.
HOT = 256


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and make sure a checkpoint folder is set."""
    shared_folder(ship(spark))
    return spark


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share."""
    return f"{shared_folder(ship(spark))}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(df: DataFrame | None) -> None:
    """Delete a stored table that nothing reads any more; other frames are left alone."""
    path = getattr(df, "stored_at", None) if df is not None else None
    if isinstance(path, str):
        jvm, spark = df.sparkSession.sparkContext._jvm, df.sparkSession
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def hot_keys(df: DataFrame, key: str, n: int) -> DataFrame:
    """Keys with more than n / HOT of df's n rows: fewer than HOT rows."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__c")).filter(F.col("__c") * HOT > n).select(key)


def hot_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, how: str = "inner", also: Column | None = None, per_key: int = 1) -> DataFrame:
    """Join on ``key`` (and ``also``) where some of left's keys are hot: their rows stay where they are and meet a broadcast.

    ``hot``: fewer than HOT keys; right has at most ``per_key`` rows of each, so at most HOT * per_key rows are
    broadcast. Other keys are joined as usual. ``right`` names its key ``__key``.
    """
    few = F.broadcast(hot.select(F.col(key).alias("__hot")))
    on = F.col(key) == F.col("__key")
    on = on if also is None else on & also
    at_hand = right.join(few, F.col("__key") == F.col("__hot"), "left_semi")
    one = left.join(few, F.col(key) == F.col("__hot"), "left_semi").join(F.broadcast(at_hand), on, how)
    two = left.join(few, F.col(key) == F.col("__hot"), "left_anti").join(right, on, how)
    return one.unionByName(two).drop("__key") if how != "left_semi" else one.unionByName(two)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow whose function gets and gives whole record batches; an empty batch is passed on as it is."""
    prepare(df.sparkSession)

    def run(batches):
        large_apart()
        yield from fn(batches)
        give_back()

    return df.mapInArrow(run, schema)


_MODEL: dict = {}


def worker_model(key, make):
    """The model a worker keeps between tasks: the last one only, so that those of successive stages don't add up."""
    if key not in _MODEL:
        _MODEL.clear()
        _MODEL[key] = make()
    return _MODEL[key]


def large_apart(bytes_: int = 4 << 20) -> None:
    """Let large arrays live outside the heap, so that they go back to the system when they are freed."""
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)  # glibc only
    if mallopt:
        mallopt(-3, bytes_)  # M_MMAP_THRESHOLD


def give_back() -> None:
    """Return what a finished task freed to the system: idle workers stay alive beside the next stage's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


@contextlib.contextmanager
def rows_a_batch(spark: SparkSession, rows: int):
    """While it holds, Arrow batches of tables written inside have at most so many rows: long texts then take less room
    on both sides. The session's setting comes back afterwards; a smaller one stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    spark.conf.set(name, str(min(before, rows) if before > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, str(before))


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)


def texts_of(column) -> list[str]:
    """Strings of an Arrow column; null becomes the empty string."""
    return [x or "" for x in column.to_pylist()]


def each_text(column, rows: int = 500):
    """The same one by one, a few rows at a time."""
    for at in range(0, len(column), rows):
        yield from texts_of(column.slice(at, rows))


def ranked(df: DataFrame, keys: list[str], order: list[Column], out: str, buckets: int = RANK_BUCKETS) -> DataFrame:
    """Add a gapless rank from 0 within ``keys``, without one task ever holding a whole key.

    Rows are dealt into hash buckets of the order columns; bucket counts give each bucket's offset
    and a window ranks inside key and bucket only. The rank follows bucket first, then ``order``; it is
    the same on each run. Equal rows are interchangeable; an empty table stays empty; a column named ``out`` is replaced.
    """
    df = without(df, out)
    buckets = max(buckets, buckets * RANK_SHARE * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // RANK_BUCKETS)
    b, base, local, kb, *ks = free(df, f"__{out}_bucket", f"__{out}_base", "__local", "__kb", *[f"__k{i}" for i in range(len(keys))])
    hashed = df.withColumn(b, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    (rows,) = free(hashed, "__n")
    counts = hashed.groupBy(*keys, b).agg(F.count(F.lit(1)).alias(rows))
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*[F.col(k).alias(n) for n, k in zip(ks, keys)], F.col(b).alias(kb), F.coalesce(F.sum(rows).over(before), F.lit(0)).alias(base))
    on = F.col(b) == F.col(kb)
    for n, k in zip(ks, keys):
        on = on & F.col(k).eqNullSafe(F.col(n))
    inner = Window.partitionBy(*keys, b).orderBy(*order)
    placed = hashed.withColumn(local, F.row_number().over(inner) - 1)
    return placed.join(bases, on).withColumn(out, F.col(local) + F.col(base)).select(*df.columns, out)


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest node reachable by links: (node, component). ``nodes``: node; ``edges``: a, b (any order).

    Alternating large-star and small-star steps (map-side aggregated minima, joins on node): the number of
    rounds grows with the logarithm of a component's diameter. Each round is checkpointed; it is an error if
    they don't settle. Links to nodes that are not listed join the others all the same.
    """
    prepare(nodes.sparkSession)
    links = edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).filter("lo <> hi").distinct().checkpoint()
    for _ in range(rounds):
        if links.isEmpty():
            break
        both = links.select(F.col("hi").alias("n"), F.col("lo").alias("m")).unionByName(links.select(F.col("lo").alias("n"), F.col("hi").alias("m")))
        least = both.groupBy("n").agg(F.least(F.min("m"), F.first("n")).alias("r"))
        large = both.filter("m > n").join(least, "n").select(F.col("r").alias("lo"), F.col("m").alias("hi")).filter("lo <> hi").distinct()
        down = large.groupBy("hi").agg(F.min("lo").alias("r"))
        small = large.join(down, "hi").select(F.col("r").alias("lo"), F.col("lo").alias("hi")).filter("lo <> hi").unionByName(down.select(F.col("r").alias("lo"), "hi"))
        new = small.distinct().checkpoint()
        # a star forest is the fixed point: it repeats itself
        sums = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")).alias("h")]
        done = links.agg(*sums).first() == new.agg(*sums).first()
        links = new
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = links.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("component"))


def crc_text(column: Column) -> Column:
    return F.crc32(F.coalesce(column, F.lit("")).cast("binary"))


def learn_rows(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text modulo ``modulus``; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def uint32(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, dtype="<u4")


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns of these names (in any case), which an operator is about to add."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]) if taken & {c.lower() for c in df.columns} else df


def free(df: DataFrame, *names: str) -> list[str]:
    """These names, with underscores behind them as far as df, or another of them, holds them (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def extended(df: DataFrame, ddl: str) -> StructType:
    """The schema of df with further columns behind its own."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])
