"""Operator 4: n-gram Jaccard join with filters under several global token orders.

Two sets with Jaccard similarity of at least t share l tokens among their first n - ceil(t n) + l tokens under
any fixed order of all tokens. The join uses three orders and takes only pairs that pass all:

* order A: rising approximate frequency (a counting sketch of fixed size over all documents), then hash;
  a set stays only if so many of its prefix tokens as a link needs (l: a tenth) stand in other sets' prefixes;
* order B: rising exact frequency among the sets that passed order A, then hash (l: one); its lists give pairs;
* order C: a hash of the token (l: one).

A pair from B's lists is looked at whole only if its two prefixes under A and under C share enough tokens, which is
told from the prefixes alone, before the sets meet.

Documents with equal sets are one node. Within the list of a B token every node is verified against a hub
first. Links found join nodes into components; only sets of the same list that are still in different
components are compared afterwards: in short lists the pairs that lengths, unique tokens and the triangle
inequality of Jaccard distance leave possible, in long ones blocks of sets against blocks. So no link between
components is lost and no long list is expanded into its pairs.

Shingles and sets are compared by 64-bit hashes. All sizes of intersections are exact on these.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT, components, hot_join, map_arrow, prepare, stored, worker_model

WORDS, PERCENT = 5, 80
#: Counters of the sketch: a power of two. Its size does not depend on the data.
SLOTS = 1 << 22
_CHUNKS = 32
#: Parts of a sketch or bit filter that one task joins.
FAN = 16
#: Bytes of text hashed at a time; a longer text makes a longer lot.
LOT = 1_000_000
_U = np.uint64
_TABLE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_P, _Q = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    powers = worker_model("powers", dict)
    held = powers.get(base)
    if held is None or len(held) < n:
        x = np.full(max(n, LOT + 100_000), base, np.uint64)
        x[0] = 1
        held = powers[base] = np.cumprod(x)
    return held[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_sets(texts: list[str | None], k: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each whole text. Words are runs of bytes other than white space, A-Z lower-cased.

    A text of fewer than k words is one shingle; null and texts without words have the empty set.
    """
    out: list[np.ndarray] = []
    lot, size = [], 0
    for t in texts:
        lot.append((t or "").encode("utf-8", "surrogatepass").lower())
        size += len(lot[-1]) + 1
        if size >= LOT:
            out += _lot(lot, k)
            lot, size = [], 0
    return out + _lot(lot, k) if lot else out


def _lot(raw: list[bytes], k: int) -> list[np.ndarray]:
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends_doc = np.cumsum([len(r) + 1 for r in raw])
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.diff(np.concatenate([[False], word]).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[data] * _powers(_P, len(data)))])
    words = _mix((sums[end] - sums[begin]) * _powers(_Q, len(data))[begin] + (end - begin).astype(np.uint64))
    at = np.concatenate([[0], np.searchsorted(begin, ends_doc)])
    rolled = np.zeros(max(len(words) - k + 1, 0), np.uint64)
    for i in range(k):
        rolled = rolled * _U(_P) + words[i : i + len(rolled)]
    rolled = _mix(rolled)
    empty, sets = np.zeros(0, np.uint64), []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= k:
            s = np.sort(rolled[a : b - k + 1])
            keep = np.ones(len(s), bool)
            keep[1:] = s[1:] != s[:-1]
            sets.append(s[keep])
        elif b > a:
            x = _U(b - a)
            for w in words[a:b]:
                x = _U((int(x) * _Q + int(w)) % (1 << 64))
            sets.append(_mix(np.array([x], np.uint64)))
        else:
            sets.append(empty)
    return sets


def needed(n: int) -> int:
    """Shared tokens that order A asks of a set's prefix: a tenth of the set."""
    return -(-n // 10)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """Tokens of a prefix in which a partner's first needed(n) common tokens stand: n - ceil(n percent / 100) + needed(n)."""
    return min(n, n - -(-n * percent // 100) + needed(n))


def least_shared(n: int, percent: int = PERCENT) -> int:
    """Common tokens that stand in both prefixes for any partner: its size is ceil(n percent / 100) at least."""
    return needed(-(-n * percent // 100))


def prefix_c(tokens: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The first n - ceil(n percent / 100) + 1 tokens by a hash: one of them at least is in any partner's."""
    p = min(len(tokens), len(tokens) - -(-len(tokens) * percent // 100) + 1)
    return tokens[np.argpartition(_mix(tokens ^ _U(_P)), p - 1)[:p]] if p < len(tokens) else tokens


def set_key(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def order_a(tokens: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Keys by which order A sorts: level of the sketch first, then a hash of the token."""
    return (levels[(tokens & _U(len(levels) - 1)).astype(np.int64)].astype(np.uint64) << _U(56)) | (_mix(tokens) >> _U(8))


def prefix_a(tokens: np.ndarray, levels: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    p = prefix_length(len(tokens), percent)
    return tokens[np.argpartition(order_a(tokens, levels), p - 1)[:p]] if p < len(tokens) else tokens


def _sets_and_counts(docs: DataFrame, k: int) -> DataFrame:
    """One pass over all texts: a row for each document (kind 0) and each task's part of the sketch (kind 1)."""
    fields = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("h", pa.int64()), ("u", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("task", pa.int32()), ("counts", pa.binary())])

    def run(batches):
        counts = None
        for b in batches:
            sets = shingle_sets(b.column(3).to_pylist(), k)
            if counts is None:
                counts = np.zeros(SLOTS, np.uint32)
            if any(len(s) for s in sets):
                counts += np.bincount((np.concatenate(sets) & _U(SLOTS - 1)).astype(np.int64), minlength=SLOTS).astype(np.uint32)
            m = len(sets)
            yield pa.RecordBatch.from_arrays([pa.array([0] * m, pa.int32()), b.column(0), b.column(1), b.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], schema=fields)
        if counts is not None:
            part, task = np.minimum(counts, 65535).astype("<u2").reshape(_CHUNKS, -1), TaskContext.get().partitionId()
            for i in range(_CHUNKS):
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([1, None, None, None, i, None, task, zlib.compress(part[i].tobytes(), 1)], fields)], schema=fields)

    return map_arrow(docs, run, "kind int, doc_id long, h long, u long, n long, key long, task int, counts binary")


def _levels(counted: DataFrame) -> np.ndarray:
    """The sketch's counters as levels (log2), summed by a tree of FAN parts a step; SLOTS bytes reach the driver."""
    def total(pdf: pd.DataFrame) -> np.ndarray:
        out = np.zeros(SLOTS // _CHUNKS, np.int64)
        for c in pdf["counts"]:
            out += np.frombuffer(zlib.decompress(c), "<u4" if pdf["wide"].iloc[0] else "<u2")
        return np.minimum(out, (1 << 32) - 1)

    def add(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": [key[0]], "task": [key[1]], "wide": [True], "counts": [zlib.compress(total(pdf).astype("<u4").tobytes(), 1)]})

    def level(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": [pdf["n"].iloc[0]], "levels": [np.frexp(total(pdf).astype(np.float64))[1].astype(np.uint8).tobytes()]})

    parts = counted.select("n", "task", F.lit(False).alias("wide"), "counts")
    width = (counted.agg(F.max("task")).first()[0] or 0) + 1
    while width > FAN:
        parts, width = parts.withColumn("task", F.floor(F.col("task") / FAN).cast("int")).groupBy("n", "task").applyInPandas(add, "n long, task int, wide boolean, counts binary"), -(-width // FAN)
    out = np.zeros((_CHUNKS, SLOTS // _CHUNKS), np.uint8)
    for r in parts.groupBy("n").applyInPandas(level, "n long, levels binary").collect():
        out[r["n"]] = np.frombuffer(r["levels"], np.uint8)
    return out.ravel()


#: Bits of the filter that spares the texts of other documents a second look. Its size does not depend on the
#: data; where it fills up, more texts are looked at and the result stays the same.
BITS = 1 << 26


def _places(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = _mix(u.astype(np.int64).view(np.uint64))
    return (x & _U(BITS - 1)).astype(np.int64), (x >> _U(32) & _U(BITS - 1)).astype(np.int64)


def _has(bits: np.ndarray, u: np.ndarray) -> np.ndarray:
    a, b = _places(u)
    return (bits[a >> 3] >> (a & 7) & bits[b >> 3] >> (b & 7) & 1).astype(bool)


def _bits(ids: DataFrame) -> np.ndarray:
    """A bit filter of one long column: set by each task, joined chunk by chunk in a tree; BITS / 8 bytes reach the driver."""
    step = BITS // 8 // _CHUNKS

    def run(batches):
        held = np.zeros(BITS // 8, np.uint8)
        for b in batches:
            for at in _places(b.column(0).to_numpy()):
                np.bitwise_or.at(held, at >> 3, (1 << (at & 7)).astype(np.uint8))
        for i in range(_CHUNKS):
            if held[i * step : (i + 1) * step].any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([zlib.compress(held[i * step : (i + 1) * step].tobytes(), 1)], pa.binary())], names=["n", "task", "bits"])

    def join(key, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(step, np.uint8)
        for x in pdf["bits"]:
            total |= np.frombuffer(zlib.decompress(x), np.uint8)
        return pd.DataFrame({"n": [key[0]], "task": [key[1]], "bits": [zlib.compress(total.tobytes(), 1)]})

    parts = stored(map_arrow(ids, run, "n int, task int, bits binary"), "jaccard-bits")
    width = (parts.agg(F.max("task")).first()[0] or 0) + 1
    while True:
        parts, width = parts.withColumn("task", F.floor(F.col("task") / FAN).cast("int")).groupBy("n", "task").applyInPandas(join, "n int, task int, bits binary"), -(-width // FAN)
        if width == 1:
            break
    out = np.zeros(BITS // 8, np.uint8)
    for r in parts.collect():
        out[r["n"] * step : (r["n"] + 1) * step] = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return out


def similarity_components(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, h (hash of the text), n_shingles, component_id, group_key for every row of doc_id, text.

    component_id: smallest doc_id reachable by links, itself included. Null texts and texts without words
    link with nothing, nor do they reach their copies (null group_key). Null doc_ids form no smallest id, so component_id is null only if a
    component has no other; repeated rows are kept. An empty table gives an empty one; other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    base = docs.select("doc_id", F.xxhash64("text").alias("h"), F.xxhash64("doc_id", "text").alias("u"), "text")
    passed = stored(_sets_and_counts(base, k), "jaccard-base")
    rows = passed.filter("kind = 0").select("doc_id", "h", "u", "n", "key")
    levels = spark.sparkContext.broadcast(_levels(passed.filter("kind = 1")))
    firsts = rows.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"), F.min("u").alias("rep"))

    def tokens_a(batches):
        seen = set()  # a task gives each set once
        for b in batches:
            sets = {set_key(s): s for s in shingle_sets(b.column(0).to_pylist(), k) if len(s)}
            out = [(prefix_a(s, levels.value, percent), key, least_shared(len(s), percent)) for key, s in sets.items() if key not in seen]
            seen.update(sets)
            if out:
                size = [len(p) for p, _, _ in out]
                cols = [np.concatenate([p for p, _, _ in out]).view(np.int64), np.repeat(np.array([x for _, x, _ in out]), size), np.repeat(np.array([m for _, _, m in out], np.int32), size)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["token", "key", "least"])

    # order A: which sets share enough prefix tokens with other sets
    prefixes = map_arrow(base.select("text"), tokens_a, "token long, key long, least int")
    by_token = Window.partitionBy("token")
    met = prefixes.withColumn("lo", F.min("key").over(by_token)).withColumn("hi", F.max("key").over(by_token)).filter("lo <> hi").select("token", "key", "least").distinct()
    survivors = met.groupBy("key", "least").agg(F.count(F.lit(1)).alias("c")).filter("c >= least").select("key")
    chosen = spark.sparkContext.broadcast(_bits(firsts.join(survivors, "key").select("rep")))

    def tokens_all(batches):
        for b in batches:
            u = b.column(0).to_numpy()
            at = np.flatnonzero(_has(chosen.value, u))
            text = b.column(1).take(pa.array(at)).to_pylist()
            sets = {set_key(s): s for s in shingle_sets(text, k) if len(s)}
            forms = [list(sets.values()), [prefix_a(s, levels.value, percent) for s in sets.values()], [prefix_c(s, percent) for s in sets.values()]]
            yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.int64()), *[pa.array([x.view(np.int64) for x in f], pa.list_(pa.int64())) for f in forms]], names=["key", "tokens", "a_first", "c_first"])

    # a few sets beyond those chosen may pass the bits, or pass twice; both do no harm below
    sets = stored(map_arrow(base.select("u", "text"), tokens_all, "key long, tokens array<long>, a_first array<long>, c_first array<long>"), "jaccard-sets")
    levels.unpersist()
    chosen.unpersist()
    links = _links(sets, percent)
    comp = components(sets.select(F.col("key").alias("node")).distinct(), links)
    least = comp.join(firsts.select(F.col("key").alias("node"), "least"), "node").groupBy("component").agg(F.min("least").alias("cid"))
    named = comp.join(least, "component").select(F.col("node").alias("key"), "cid", "component")
    ids = stored(firsts.select("key", "least").join(named, "key", "left").select("key", F.coalesce("cid", "least").alias("cid"), F.coalesce("component", "key").alias("group_key")), "jaccard-ids")
    out = rows.join(ids, "key", "left")
    return out.select("doc_id", "h", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("cid", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"), "group_key")


def _links(sets: DataFrame, percent: int) -> DataFrame:
    """Enough verified links (a, b) between sets that their components are those of all links.

    ``sets``: key, tokens and the prefixes a_first and c_first; repeated keys do no harm, an empty table has no link.
    """
    long = sets.select("key", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    often = long.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("token"))).filter("df > 1")
    # order B: a set's prefix is its first p tokens by (df, hash); unique ones need no list, only their number
    common = often.select("key", "n", F.struct("df", F.xxhash64("token").alias("o"), "token").alias("t"))
    nodes = common.groupBy("key", "n").agg(F.sort_array(F.collect_set("t")).alias("ts")).withColumn("r", F.size("ts"))
    p = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    lists = nodes.filter(F.col("r") * 100 >= F.col("n") * percent).select("key", "n", "r", F.explode(F.slice("ts", 1, F.greatest(p - (F.col("n") - F.col("r")), F.lit(0)).cast("int"))).alias("t")).select("key", "n", "r", "t.token")
    lists = stored(lists, "jaccard-lists")
    # the hub of a list: least share of unique tokens; a node no list mate can match leaves the list
    # (a list of one node has no pair)
    hubs = lists.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.max(F.struct((F.col("r") / F.col("n")).alias("q"), "key", "n")).alias("hub"), F.min("n").alias("least")).filter("m > 1")
    best = F.col("r") / (F.col("n") + F.greatest("least", "r") - F.col("r"))
    hot = hubs.filter(F.col("m") * HOT > lists.count()).select("token")
    listed = stored(hot_join(lists, hubs.withColumnRenamed("token", "__key"), "token", hot).filter(best * 100 >= percent - 1e-6).select("token", "key", "n", "r", "m", F.col("hub.key").alias("hub"), F.col("hub.n").alias("hub_n")), "jaccard-listed")
    near = (F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * percent) & (F.col("key") != F.col("hub"))
    spokes = listed.filter(near).select(F.col("hub").alias("a"), F.col("key").alias("b")).distinct()
    first = stored(_verify(spokes, sets, percent), "jaccard-spokes")
    found = first.filter("linked").select("a", "b")
    comp = stored(components(listed.select(F.col("key").alias("node")).distinct(), found), "jaccard-comp")
    tagged = listed.join(comp, F.col("key") == F.col("node")).drop("node")
    dist = first.select(F.col("a").alias("hub"), F.col("b").alias("key"), "distance")
    tagged = tagged.join(dist, ["hub", "key"], "left").withColumn("distance", F.when(F.col("hub") == F.col("key"), 0.0).otherwise(F.col("distance")))
    per = tagged.groupBy("token", "component").agg(F.count(F.lit(1)).alias("c"))
    main = per.groupBy("token").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("c", "component")).alias("main")).filter("parts > 1").select("token", F.col("main.component").alias("main"))
    every = stored(tagged.join(main, "token"), "jaccard-open")
    open_ = every.filter(F.col("m") <= PAIRED)
    x, y = open_.filter("component <> main").alias("x"), open_.alias("y")
    ordered = (F.col("y.component") == F.col("y.main")) | (F.col("x.key") < F.col("y.key"))
    overlap = F.least("x.r", "y.r") * (100 + percent) >= (F.col("x.n") + F.col("y.n")) * percent
    sizes = F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent
    triangle = F.coalesce(F.abs(F.col("x.distance") - F.col("y.distance")) <= 1 - percent / 100 + 1e-9, F.lit(True))
    new = (F.col("x.key") != F.col("x.hub")) & (F.col("y.key") != F.col("y.hub"))
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.component") != F.col("y.component")) & ordered & sizes & overlap & triangle & new).select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()
    second = _verify(pairs, sets, percent).filter("linked").select("a", "b")
    long_lists = every.filter(F.col("m") > PAIRED).select("hub", "key", "component", "n").distinct()
    return stored(found.unionByName(second).unionByName(_block_links(long_lists, sets, percent)), "jaccard-links")


#: Lists of up to so many sets are compared pair by pair; longer ones in blocks of about so many tokens.
PAIRED, BLOCK_TOKENS = 48, 60_000


def _block_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components within the lists of a hub: (hub, key, component, n), blocks of sets against blocks.

    Overlaps of two blocks are one product of incidence matrices. For each set and each other component
    one link is enough. Sets of the list's largest component are only compared with the others.
    """
    size = members.groupBy("hub").agg(F.sum("n").alias("total"))
    per = members.groupBy("hub", "component").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("cn"))
    main = per.groupBy("hub").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("c", "component", "cn")).alias("main")).filter("parts > 1").select("hub", F.col("main.component").alias("main"), F.col("main.cn").alias("main_n"))
    spread = F.pmod(F.xxhash64("key"), F.lit(1 << 40))
    held = members.join(size, "hub").join(main, "hub").join(sets, "key")
    held = held.withColumn("block", (spread % F.ceil(F.col("total") / BLOCK_TOKENS)).cast("int")).withColumn("part", (spread % F.greatest(F.ceil((F.col("total") - F.col("main_n")) / BLOCK_TOKENS), F.lit(1))).cast("int"))
    packed = F.collect_list(F.struct("key", "component", "tokens", "a_first", "c_first"))
    left = held.filter("component <> main").groupBy("hub", "part").agg(packed.alias("l")).select("hub", "l")
    right = held.groupBy("hub", "block").agg(packed.alias("r")).select("hub", "r")

    def run(batches):
        for b in batches:
            a_out, b_out = [], []
            for i in range(b.num_rows):
                x, y = _unpack(b.column(0)[i].values), _unpack(b.column(1)[i].values)
                few = np.minimum(least_shared_of(x[3], percent)[:, None], least_shared_of(y[3], percent)[None])
                maybe = (_overlaps(*x[4], *y[4]) >= few) & (_overlaps(*x[5], *y[5]) > 0)
                if not maybe.any():
                    continue
                both = _overlaps(x[2], x[3], y[2], y[3])
                linked = maybe & (100 * both >= percent * (x[3][:, None] + y[3][None] - both)) & (x[1][:, None] != y[1][None])
                at = np.argwhere(linked)
                if len(at):
                    _, first = np.unique(np.stack([at[:, 0], y[1][at[:, 1]]]), axis=1, return_index=True)
                    a_out.append(x[0][at[first, 0]])
                    b_out.append(y[0][at[first, 1]])
            if a_out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a_out)), pa.array(np.concatenate(b_out))], names=["a", "b"])

    return map_arrow(left.join(right, "hub").select("l", "r"), run, "a long, b long")


def least_shared_of(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-(-(-n * percent // 100)) // 10)


def _unpack(v) -> tuple:
    """Keys, components, all tokens and sizes of a packed block, and (tokens, sizes) of the prefixes under A and C."""
    lists = [(v.field(c).flatten().to_numpy(), np.asarray(v.field(c).value_lengths()).astype(np.int64)) for c in ("tokens", "a_first", "c_first")]
    return v.field("key").to_numpy(), v.field("component").to_numpy(), *lists[0], lists[1], lists[2]


def _overlaps(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray, width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets of two blocks."""
    common = np.intersect1d(x, y)
    out = np.zeros((len(nx), len(ny)), np.int64)
    ox, oy = np.repeat(np.arange(len(nx)), nx), np.repeat(np.arange(len(ny)), ny)
    for at in range(0, len(common), width):
        part = common[at : at + width]
        one, two = np.zeros((len(nx), len(part)), np.float32), np.zeros((len(ny), len(part)), np.float32)
        for m, tokens, owner in ((one, x, ox), (two, y, oy)):
            i = np.searchsorted(part, tokens).clip(max=len(part) - 1)
            hit = part[i] == tokens
            m[owner[hit], i[hit]] = 1
        out += (one @ two.T).astype(np.int64)
    return out


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked, distance) of the pairs whose prefixes under orders A and C share what a link needs; others cannot link."""
    heads = [sets.select(F.col("key").alias(c), F.col("a_first").alias(f"{c}_a"), F.col("c_first").alias(f"{c}_c"), F.size("tokens").alias(f"{c}_n")) for c in "ab"]
    few = F.ceil(F.ceil(F.least("a_n", "b_n") * percent / 100) / 10)
    met = pairs.join(heads[1], "b").join(heads[0], "a").filter((F.size(F.array_intersect("a_a", "b_a")) >= few) & F.arrays_overlap("a_c", "b_c")).select("a", "b")
    left = sets.select(F.col("key").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("key").alias("b"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    union = F.size("ta") + F.size("tb") - F.col("both")
    joined = met.join(right, "b").join(left, "a").withColumn("both", both)
    return joined.select("a", "b", (F.col("both") * 100 >= union * percent).alias("linked"), (1 - F.col("both") / union).alias("distance"))


def op4_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Components of all documents under links of similarity 0.8 or more on five-word shingles.

    Null, empty and wordless texts link with nothing; a null doc_id is no component's smallest; repeated rows stay;
    an empty table gives no row.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return similarity_components(docs).select("doc_id", "n_shingles", "component_id")
