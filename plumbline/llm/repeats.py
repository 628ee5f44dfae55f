"""Operator 11: repeated spans, by compaction of a De Bruijn graph whose edges are windows of 13 words.

Edges are sought by seeds. A window's seed is the least hash among its runs of SEED words, so equal windows have equal
seeds, and neighbouring windows mostly share one: a text is dealt out as runs of windows with one seed, a fourth as
many rows as windows. Each run carries its windows' digests; within a lot of documents edges met twice are told apart
before anything is shuffled, so a passage that many documents share reaches its seed's task once a lot.

An edge that also starts in a document of smaller id is joined to that source: (document, place) -> (source, place).
Edges one after another whose sources follow one another too do not branch: they compact into paths, by joins of
neighbouring places and of each path's beginning with its end. Finally every path is verified at its
source coordinates: both sides hash the words themselves, and a path whose hashes differ (a collision of digests)
stops the run, which starts again with other hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, each_text, forget, map_arrow, prepare, stored

#: Words of a window, of the runs from which its seed is taken, and bytes of a window's digest beside the seed.
WINDOW, SEED, DIGEST = 13, 6, 5
#: Words of a lot, within which edges are told apart before the shuffle, and windows in a row at most.
LOT, RUN = 1 << 20, 64
#: A place holds a tag of the text above these bits, so that rows sharing a doc_id are kept apart.
PLACE_BITS, TAG_BITS = 38, 24
TRIES = 3


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts, and the number of words of each."""
    split = pc.ascii_split_whitespace(texts)  # splits where str.split does on ASCII alone, with empty ends
    words, lengths = split.flatten(), pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    coded = words.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    names = coded.dictionary.cast(pa.binary()).to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w, salt) for w in names), dtype=np.uint64, count=len(names))
    empty = np.fromiter((not w for w in names), dtype=bool, count=len(names))
    codes = coded.indices.to_numpy(zero_copy_only=False)
    shown = ~empty[codes] if len(codes) else np.zeros(0, bool)
    return hashes[codes[shown]], np.bincount(owner[shown], minlength=len(lengths)).astype(np.int64)


def _rolled(x: np.ndarray, n: int, salt: int) -> np.ndarray:
    """Hash of the n words from each place on; places less than n from the end are left out."""
    m = len(x) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    base, out = np.uint64(0xD6E8FEB86659FD93), np.zeros(m, np.uint64)
    for i in range(n):
        out *= base
        out += x[i : i + m]
    return _mixed(out, salt)


def windows_of(x: np.ndarray, lengths: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in x, hash, seed) of each window that lies within one text."""
    ends = np.cumsum(lengths)
    starts = ends - lengths
    counts = np.maximum(lengths - WINDOW + 1, 0)
    n = int(counts.sum())
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    at = np.arange(n) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
    seed, width, need = _rolled(x, SEED, salt + 1), 1, WINDOW - SEED + 1
    while width < need:  # least of a sliding stretch, by doubling its width
        step = min(width, need - width)
        seed = np.minimum(seed[:-step], seed[step:])
        width += step
    return at, _rolled(x, WINDOW, salt + 2)[at], seed[at]


_ROW = pa.schema([("seed", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64()), ("windows", pa.binary()), ("n", pa.int64()), ("source", pa.int64()), ("source_place", pa.int64())])
_ROW_DDL = "seed long, doc_id long, place long, windows binary, n long, source long, source_place long"
_PATH = pa.schema([_ROW.field(c) for c in ("doc_id", "place", "n", "source", "source_place")])
_PATH_DDL = "doc_id long, place long, n long, source long, source_place long"


def _runs(*same: np.ndarray, longest: int = 0) -> np.ndarray:
    """Starts of runs in which each array keeps its value (places: given as differences to their index)."""
    n = len(same[0])
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([a[1:] != a[:-1] for a in same])
    starts = np.flatnonzero(new)
    if longest:
        sizes = np.diff(np.append(starts, n))
        parts = (sizes + longest - 1) // longest
        starts = np.repeat(starts, parts) + longest * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    return starts


def _claims(doc, place, source, source_place) -> list[np.ndarray]:
    """Join edges that follow one another, on both sides, into (doc, place, n, source, source_place)."""
    order = np.lexsort((place, place - source_place, source, doc))
    doc, place, source, source_place = (a[order] for a in (doc, place, source, source_place))
    starts = _runs(doc, source, place - source_place, place - np.arange(len(place))) if len(doc) else np.zeros(0, np.int64)
    return [doc[starts], place[starts], np.diff(np.append(starts, len(doc))), source[starts], source_place[starts]]


def _first_of(keys: tuple[np.ndarray, ...], doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For each edge the index of its first occurrence: least document, then place, among equal keys."""
    order = np.lexsort((place, doc, *keys[::-1]))
    new = _runs(*[k[order] for k in keys]) if len(order) else np.zeros(0, np.int64)
    first = np.empty(len(order), np.int64)
    first[order] = np.repeat(order[new], np.diff(np.append(new, len(order))))
    return first


def _lots(batches, with_text: int):
    """(doc_ids, tags, texts) of some documents at a time: as many as have about LOT words, or one longer text."""
    ids, tags, texts, size = [], [], [], 0
    for b in batches:
        for i, t, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), each_text(b.column(with_text))):
            ids.append(i)
            tags.append(t)
            texts.append(text)
            size += len(text)
            if size >= 6 * LOT or len(ids) >= 1 << 16:
                yield ids, tags, texts
                ids, tags, texts, size = [], [], [], 0
    if ids:
        yield ids, tags, texts


def _edges(salt: int):
    """Documents (doc_id, tag, text) as runs of windows with one seed, and paths whose source is in the same lot."""

    def run(batches):
        for ids, tags, texts in _lots(batches, 2):
            x, lengths = word_hashes(pa.array(texts, pa.large_string()), salt)
            at, full, seed = windows_of(x, lengths, salt)
            if not len(at):
                continue
            owner = np.repeat(np.arange(len(ids)), np.maximum(lengths - WINDOW + 1, 0))
            doc = np.array(ids, np.int64)[owner]
            place = (np.array(tags, np.int64) << PLACE_BITS)[owner] + at - (np.cumsum(lengths) - lengths)[owner]
            first = _first_of((full,), doc, place)
            known = doc[first] < doc
            local = _claims(doc[known], place[known], doc[first][known], place[first][known])
            k = len(local[0])
            if k:
                # seeds of their own spread these rows
                yield batch(_ROW, [_mixed((local[0] * 31 + local[1]).astype(np.uint64), salt).astype(np.int64), local[0], local[1], pa.nulls(k, pa.binary()), local[2], local[3], local[4]])
            doc, place, full, seed = (a[~known] for a in (doc, place, full, seed))
            if not len(doc):
                continue
            starts = _runs(seed, doc, place - np.arange(len(place)), longest=RUN)
            sizes = np.diff(np.append(starts, len(doc)))
            raw = np.ascontiguousarray(full.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :DIGEST])
            for low in range(0, len(starts), 1 << 16):
                part = slice(low, low + (1 << 16))
                s, n = starts[part], sizes[part]
                data = raw[s[0] : s[-1] + n[-1]].tobytes()
                offsets = np.append(0, np.cumsum(n * DIGEST)).astype(np.int32)
                windows = pa.Array.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                nulls = pa.nulls(len(s), pa.int64())
                yield batch(_ROW, [seed[s].astype(np.int64), doc[s], place[s], windows, n, nulls, nulls])

    return run


def _opened(t: pa.Table) -> list[np.ndarray]:
    """Runs of windows as single edges: seed, digest, doc, place."""
    n = t.column("n").to_numpy()
    windows = t.column("windows").combine_chunks()
    windows = windows.chunk(0) if isinstance(windows, pa.ChunkedArray) else windows
    offsets = np.frombuffer(windows.buffers()[1], np.int32)[windows.offset : windows.offset + len(windows) + 1]
    raw = np.frombuffer(windows.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, DIGEST)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :DIGEST] = raw
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return [np.repeat(t.column("seed").to_numpy(), n), wide.view("<u8").ravel(), np.repeat(t.column("doc_id").to_numpy(), n), np.repeat(t.column("place").to_numpy(), n) + inner]


def _meet(batches):
    """Rows sorted by (seed, doc_id, place) become paths: an edge's first place is the source of those in later documents.

    A seed that goes on in the next batch takes along the first place of each of its edges, not its rows.
    """
    kept, last = None, None  # open edges of the last seed: digest, doc, place
    for b in batches:
        t = pa.Table.from_batches([b])
        told = t.filter(pc.is_valid(t.column("source")))
        if told.num_rows:
            yield batch(_PATH, [told.column(c).combine_chunks() for c in _PATH.names])
        t = t.filter(pc.is_null(t.column("source")))
        if not t.num_rows:
            continue
        seeds = t.column("seed").to_numpy()
        ending = seeds[-1]
        # rows of a seed met once tell nothing, unless it may go on
        again = np.zeros(len(seeds), bool)
        again[1:] |= seeds[1:] == seeds[:-1]
        again[:-1] |= seeds[1:] == seeds[:-1]
        again |= (seeds == ending) | (seeds == (last if last is not None else ending))
        seed, digest, doc, place = _opened(t.filter(pa.array(again)))
        if kept is not None and seed[0] == last:
            seed, digest, doc, place = (np.concatenate([a, z]) for a, z in zip((np.full(len(kept[0]), last), *kept), (seed, digest, doc, place)))
        first = _first_of((seed, digest), doc, place)
        known = doc[first] < doc
        if known.any():
            yield batch(_PATH, _claims(doc[known], place[known], doc[first][known], place[first][known]))
        mine = np.flatnonzero((seed == ending) & (first == np.arange(len(seed))))
        last, kept = ending, [a[mine] for a in (digest, doc, place)]


def compact(edges: DataFrame) -> DataFrame:
    """Join stretches (doc_id, place, n, source, source_place) that touch or overlap on one line into whole paths.

    A line is a document, a source and their distance. Its edges are held as bits, 64 places a word; a word is joined
    to its neighbours on both sides to see where a path begins, ends or only passes. Paths of a line are apart, so its
    i-th beginning and its i-th end belong together. Equal stretches, as repeated rows give them, count once.
    """
    line = ["doc_id", "source", "apart"]
    ones = F.lit(-1).cast("long")
    parts = edges.select("doc_id", "source", (F.col("place") - F.col("source_place")).alias("apart"), "place", (F.col("place") + F.col("n")).alias("end"))
    parts = parts.withColumn("block", F.explode(F.sequence(F.shiftright("place", 6), F.shiftright(F.col("end") - 1, 6))))
    low, high = F.greatest(F.col("place") - F.col("block") * 64, F.lit(0)), F.least(F.col("end") - F.col("block") * 64, F.lit(64))
    bits = F.call_function("shiftleft", ones, low.cast("int")).bitwiseAND(F.call_function("shiftrightunsigned", ones, (64 - high).cast("int")))
    words = stored(parts.select(*line, "block", bits.alias("bits")).groupBy(*line, "block").agg(F.bit_or("bits").alias("bits")), "edges")
    before = words.filter("bits < 0").select(*line, (F.col("block") + 1).alias("block"), F.lit(1).alias("from_before"))
    behind = words.filter("bits & 1 = 1").select(*line, (F.col("block") - 1).alias("block"), F.lit(1).alias("goes_on"))
    met = words.join(before, [*line, "block"], "left").join(behind, [*line, "block"], "left")
    place = F.col("block") * 64 + F.col("bit")

    def bounds(inner: str) -> DataFrame:
        edge = F.expr(f"bits & ~({inner})")
        found = met.select(*line, "block", F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(edge, i) == 1)).alias("bit"))
        return found.select(*line, place.alias("at"), F.row_number().over(Window.partitionBy(*line).orderBy("block", "bit")).alias("i"))

    first = bounds("shiftleft(bits, 1) | coalesce(from_before, 0)").withColumnRenamed("at", "place")
    final = bounds("shiftrightunsigned(bits, 1) | shiftleft(cast(coalesce(goes_on, 0) as bigint), 63)").withColumnRenamed("at", "end")
    paths = first.join(final, [*line, "i"])
    return paths.select("doc_id", "place", (F.col("end") - F.col("place") + 1).alias("n"), "source", (F.col("place") - F.col("apart")).alias("source_place"))


def _span_hash(words: list[bytes], place: int, n: int) -> str:
    at = place & ((1 << PLACE_BITS) - 1)
    return xxhash.xxh3_128_hexdigest(b" ".join(words[at : at + n + WINDOW - 1]))


def _apply(batches):
    """Remove covered words; hash every path on the side that this row is (doc_id, tag, text, paths, asked)."""
    kinds = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("hashes", pa.list_(pa.struct([("source", pa.int64()), ("source_place", pa.int64()), ("n", pa.int64()), ("hash", pa.string())])))])
    for b in batches:
        for at in range(0, b.num_rows, 64):
            rows = []
            part = b.slice(at, 64)
            for doc, text, paths, asked in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "paths", "asked"))):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                gone = np.zeros(len(words) + 1, np.int64)
                hashes = {}
                for p in paths or ():
                    start = p["place"] & ((1 << PLACE_BITS) - 1)
                    gone[start] += 1
                    gone[min(start + p["n"] + WINDOW - 1, len(words))] -= 1
                    hashes[p["source"], p["source_place"], p["n"], _span_hash(words, p["place"], p["n"])] = None
                for p in asked or ():
                    hashes[doc, p["source_place"], p["n"], _span_hash(words, p["source_place"], p["n"])] = None
                stays = np.cumsum(gone[:-1]) == 0
                kept = [w for w, ok in zip(words, stays.tolist()) if ok] if paths else words
                rows.append((doc, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), [dict(zip(("source", "source_place", "n", "hash"), h)) for h in hashes]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), kinds)], schema=kinds)


def repeated_paths(docs: DataFrame, salt: int = 0) -> DataFrame:
    """(doc_id, place, n, source, source_place): maximal paths of n windows that also start in a smaller doc_id.

    ``docs``: doc_id long, tag long (of the text), text. A place is a word's number, with the tag above PLACE_BITS bits.
    Rows without doc_id have no paths and are no source; null texts have no words. Digests are not verified here.
    """
    prepare(docs.sparkSession)
    edges = map_arrow(docs.filter("doc_id is not null").select("doc_id", "tag", "text"), _edges(salt), _ROW_DDL)
    met = map_arrow(edges.repartition("seed").sortWithinPartitions("seed", "doc_id", "place"), _meet, _PATH_DDL)
    return compact(met)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row of (doc_id, text).

    Words are what stands between ASCII white space. A word goes if a window of 13 words over it also starts in a
    document of smaller doc_id; all windows are judged on the input. Null texts have no words; rows without doc_id keep
    all; repeated rows give equal rows, rows sharing a doc_id but not the text are judged apart and not by each other.
    Other columns are not read; an empty table gives no row.
    """
    text = F.coalesce("text", F.lit(""))
    tagged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).bitwiseAND(F.lit((1 << TAG_BITS) - 1)).alias("tag"), text.alias("text"))
    for salt in range(TRIES):
        paths = stored(repeated_paths(tagged, 7 * salt), "paths")
        mine = paths.groupBy(F.col("doc_id").alias("pd"), F.shiftright("place", PLACE_BITS).alias("pt")).agg(F.collect_list(F.struct("place", "n", "source", "source_place")).alias("paths"))
        sources = paths.select("source", "source_place", "n").distinct()
        asked = sources.groupBy(F.col("source").alias("pd"), F.shiftright("source_place", PLACE_BITS).alias("pt")).agg(F.collect_list(F.struct("source_place", "n")).alias("asked"))
        told = mine.join(asked, ["pd", "pt"], "full")
        joined = tagged.join(told, (F.col("doc_id") == F.col("pd")) & (F.col("tag") == F.col("pt")), "left").select("doc_id", "text", "paths", "asked")
        ddl = "doc_id long, n_words long, n_removed long, kept_sha256 string, hashes array<struct<source:long,source_place:long,n:long,hash:string>>"
        out = stored(map_arrow(joined, _apply, ddl), "kept")
        forget(paths)
        sides = out.select(F.explode("hashes").alias("h")).groupBy("h.source", "h.source_place", "h.n").agg(F.min("h.hash").alias("a"), F.max("h.hash").alias("b"))
        if sides.filter("a <> b").isEmpty():
            return out.drop("hashes")
        forget(out)
    raise RuntimeError(f"digests of windows collided under {TRIES} hashes")


ORACLE_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
s as (select doc_id, w, unnest(range(1, len(w) - 11)) p from d),
g as (select doc_id, p, array_to_string(w[p:p + 12], ' ') t from s),
f as (select doc_id, p, doc_id > min(doc_id) over (partition by t) again from g),
c as (select distinct doc_id, p + o q from f, range(13) x(o) where again),
gone as (select doc_id, list(q) qs from c group by doc_id)
select doc_id, len(w) n_words, coalesce(len(qs), 0) n_removed,
 sha256(array_to_string(case when qs is null then w else list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: not list_contains(qs, x[2])), lambda x: x[1]) end, ' ')) kept_sha256
from d left join gone using (doc_id)
"""


def op11_repeated_spans(spark, sf_dir: str) -> DataFrame:
    """All documents without the words of windows that smaller documents hold too.

    Null and empty texts have no words and keep the hash of the empty string; very long texts are taken whole; ties,
    repeated rows and null doc_ids as in ``remove_repeats``; an empty table gives no row.
    """
    prepare(spark)
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
