"""Operator 2: balanced label propagation over shards, with DataFrame functions only.

Linked documents (equal texts by default) move towards the shards of their neighbours. A group of links is
kept as a star around its key, never as pairs. In each round a group's shards are ranked by how many of its
members they hold; the first k of them, k being what the group's size needs, are its targets, and members
elsewhere ask to move there. A shard grants moves up to its quota: its capacity less the linked members that
stay. Documents without links cost no cut edge anywhere, so they yield their places and are dealt out last,
into whatever room is left, so that the numbers of rows differ by one at most (law ``rows``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT, crc_text, forget, hot_join, prepare, ranked, stored

SHARDS = 24
ROUNDS = 4
#: Buckets in which groups of like size wait for a shard's quota.
TURNS = 64


def capacities(n: Column, shards: int, shard: Column) -> Column:
    """Rows of a shard: n / shards, the first n mod shards shards one more."""
    return (F.floor(n / shards) + F.when(shard < n % shards, 1).otherwise(0)).cast("long")


def shard_by_propagation(nodes: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Place rows of (node, link) into shards: adds ``shard``. ``node`` orders rows, ``link`` names a row's group.

    Rows with equal non-null links are neighbours; a null link means none. Repeated nodes are rows of their own.
    An empty table stays empty. A group larger than a shard aims at as few shards as hold it; members for which
    other groups leave no room there stay where they are. Only node and link are read; the result has these and shard.
    """
    nodes = nodes.select("node", "link")
    spark = nodes.sparkSession
    base = stored(ranked(nodes, [], [F.col("node"), F.col("link")], "pos"), "shard-nodes")
    n = base.count()
    grid = spark.range(shards).select(F.col("id").cast("int").alias("s"), capacities(F.lit(n), shards, F.col("id")).alias("cap"))
    least = max(1, n // shards)
    sizes = stored(base.filter("link is not null").groupBy("link").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "shard-sizes")
    hot = sizes.filter(F.col("m") * HOT > n).select("link")
    linked = hot_join(base, sizes.select(F.col("link").alias("__key")), "link", hot, "left_semi")
    # the start: rows as they come, dealt out in order of their rank
    state = stored(linked.select("pos", "link", (F.col("pos") % shards).cast("int").alias("shard")), "shard-state")
    for _ in range(rounds):
        held = state.groupBy("link", "shard").agg(F.count(F.lit(1)).alias("c"))
        # a group's targets: its fullest shards, ties by a hash so that groups spread evenly
        rank = F.row_number().over(Window.partitionBy("link").orderBy(F.desc("c"), F.xxhash64("link", "shard")))
        wish = held.withColumn("t", rank - 1).join(sizes, "link").withColumn("k", F.ceil(F.col("m") / least))
        targets = wish.filter("t < k")
        room = targets.groupBy(F.col("shard").alias("s")).agg(F.sum("c").alias("stay"))
        # members outside the targets ask for them in the order of their rank; the room of a target is what it lacks
        share = F.ceil(F.col("m") / F.least(F.col("k"), F.lit(shards)))
        lack = targets.withColumn("want", F.greatest(share - F.col("c"), F.lit(0)))
        # quotas: a shard grants what its capacity leaves beside the members that stay, smaller groups first
        granted = _running(lack).join(F.broadcast(grid.join(room, "s", "left")), F.col("shard") == F.col("s"))  # one row a shard
        granted = granted.withColumn("quota", F.greatest(F.col("cap") - F.coalesce("stay", F.lit(0)), F.lit(0)))
        granted = granted.withColumn("grant", F.greatest(F.least(F.col("want"), F.col("quota") - (F.col("run") - F.col("want"))), F.lit(0)).cast("long")).filter("grant > 0")
        upto = Window.partitionBy("link").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        offers = granted.withColumn("hi", F.sum("grant").over(upto)).select(F.col("link").alias("__key"), F.col("shard").alias("to"), "hi", (F.col("hi") - F.col("grant")).alias("lo"))
        told = wish.select(F.col("link").alias("__key"), F.col("shard").alias("ws"), (F.col("t") >= F.col("k")).alias("out"))
        marked = stored(hot_join(state, told, "link", hot, also=F.col("shard") == F.col("ws"), per_key=shards).drop("ws"), "shard-marked")
        asking = ranked(marked.filter("out").drop("out"), ["link"], [F.col("pos")], "ask", 64)
        moved = hot_join(asking, offers, "link", hot, "left", (F.col("ask") >= F.col("lo")) & (F.col("ask") < F.col("hi")), shards)
        moved = moved.select("pos", "link", F.coalesce("to", "shard").alias("shard"))
        before, state = state, stored(marked.filter("not out").select("pos", "link", "shard").unionByName(moved), "shard-state")
        forget(before)
        forget(marked)
    return _settle(base, state, grid)


def _running(lack: DataFrame) -> DataFrame:
    """Add ``run``, the running sum of ``want`` in each shard, smaller groups first, without a window over a whole shard.

    Groups of like size (powers of two) are dealt into TURNS buckets by a hash; buckets are summed first, so a window
    holds one bucket of one shard. At most shards * 64 * TURNS sums are broadcast.
    """
    dealt = lack.withColumn("g", (F.floor(F.log2(F.col("m").cast("double"))) * TURNS + F.pmod(F.xxhash64("link"), F.lit(TURNS))).cast("int"))
    sums = dealt.groupBy(F.col("shard").alias("gs"), F.col("g").alias("gg")).agg(F.sum("want").alias("w"))
    before = Window.partitionBy("gs").orderBy("gg").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("gs", "gg", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("base"))
    turn = Window.partitionBy("shard", "g").orderBy("m", F.xxhash64("link")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = dealt.withColumn("own", F.sum("want").over(turn))
    return inner.join(F.broadcast(bases), (F.col("shard") == F.col("gs")) & (F.col("g") == F.col("gg"))).withColumn("run", F.col("own") + F.col("base")).drop("gs", "gg", "base", "own", "g")


def _settle(base: DataFrame, state: DataFrame, grid: DataFrame) -> DataFrame:
    """Give every shard exactly its capacity: linked rows beyond it yield, unlinked rows take the room left."""
    over = ranked(state, ["shard"], [F.xxhash64("link"), F.col("pos")], "r")
    kept = stored(over.join(grid, F.col("shard") == F.col("s")).filter("r < cap").select("pos", "shard"), "shard-kept")
    free = ranked(base.select("pos", "node", "link").join(kept.select("pos"), "pos", "left_anti"), [], [F.col("pos")], "f")
    used = kept.groupBy("shard").agg(F.count(F.lit(1)).alias("u"))
    before = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row for each shard
    left = grid.join(used, F.col("s") == F.col("shard"), "left").select("s", (F.col("cap") - F.coalesce("u", F.lit(0))).alias("open"))
    left = left.withColumn("hi", F.sum("open").over(before)).withColumn("lo", F.col("hi") - F.col("open")).filter("open > 0")
    dealt = free.join(F.broadcast(left), (F.col("f") >= F.col("lo")) & (F.col("f") < F.col("hi"))).select("pos", F.col("s").alias("shard"))
    return base.join(kept.unionByName(dealt), "pos").drop("pos")


def op2_label_propagation(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of equal row counts; documents with equal texts are linked.

    Null texts are linked with nothing, empty ones with each other; a null doc_id comes first; equal rows are
    interchangeable; an empty table gives no row.
    """
    prepare(spark)
    text = F.col("text")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")
    digest = F.when(text.isNotNull(), F.concat_ws(":", F.xxhash64(text), F.crc32(text.cast("binary")), F.octet_length(text)))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.struct("doc_id", size.alias("size"), crc_text(text).alias("crc")).alias("node"), digest.alias("link"))
    placed = stored(shard_by_propagation(docs).select("node.doc_id", "node.size", F.col("node.crc").alias("text_crc32"), "shard"), "shards")
    out = ranked(placed, ["shard"], [F.col("doc_id"), F.col("size"), F.col("text_crc32")], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
