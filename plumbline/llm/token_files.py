"""Operator 10: token ids in binary files, coded by a static range asymmetric numeral system."""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import rans
from .common import each_text, map_arrow, prepare, shared_path
from .tokens import Room, default_path, encoder

#: Ids after which a frame is closed; a frame holds whole documents, so only a longer document exceeds it.
FRAME_IDS = 1 << 21

#: A worker that only writes files may hold more than one that shares its machine with a pipeline's stages.
ROOM = Room(lot=12_000_000, known=1_000_000, runs=300_000)

FRAME_SCHEMA = "part int, frame int, base long, n long, doc_ids array<long>, lengths array<long>, freq_table binary, states binary, starts binary, words binary, word_crcs binary, id_crcs binary"
_FIELDS = pa.schema([("part", pa.int32()), ("frame", pa.int32()), ("base", pa.int64()), ("n", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), *[(k, pa.binary()) for k in ("freq_table", "states", "starts", "words", "word_crcs", "id_crcs")]])


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None, kind: str = "byte", end_id: int = 0, frame_ids: int = FRAME_IDS, room: Room = ROOM) -> None:
    """Encode doc_id, text and write frames under ``path`` in ascending doc_id order (null first).

    Null text is the empty text (just the end id). Repeated doc_ids are kept, ordered by their text's hash;
    equal rows are interchangeable. An empty table writes no frame. Very long texts are encoded whole and make a
    frame of their own length. Other columns, whatever their names, are ignored.
    """
    vocabulary = vocabulary or default_path("byte_bpe_50k.json")
    end = np.array([end_id], "<u4").tobytes()

    def frames(batches):
        enc, part = encoder(vocabulary, kind, room), TaskContext.get().partitionId()
        held, ids, size, base, frame = [], [], 0, 0, 0

        def close():
            coded = rans.encode(np.frombuffer(b"".join(ids), "<u4"))
            return pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip([part, frame, base, coded.n, held, [len(x) // 4 for x in ids], coded.table, coded.states, coded.starts, coded.words, coded.word_crcs, coded.id_crcs], _FIELDS)], schema=_FIELDS)

        for b in batches:
            for doc, coded in zip(b.column(0).to_pylist(), enc.stream(each_text(b.column(1)))):
                coded += end
                held.append(doc)
                ids.append(coded)
                size += len(coded) // 4
                if size >= frame_ids:
                    yield close()
                    base, frame, held, ids, size = base + size, frame + 1, [], [], 0
        if held:
            yield close()

    tie = F.xxhash64(F.col("text"))
    ordered = docs.select("doc_id", "text").withColumn("tie", tie).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    map_arrow(ordered.select("doc_id", "text"), frames, FRAME_SCHEMA).write.option("compression", "none").parquet(path)


def read_token_files(spark, path: str, with_ids: bool = False) -> DataFrame:
    """Decode every frame: part, frame, base, doc_id, start_in_part, n_tokens, ids_crc32 (and ids, if asked for)."""
    schema = "part int, doc_id long, start_in_part long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    fields = pa.schema([("part", pa.int32()), *[(k, pa.int64()) for k in ("doc_id", "start_in_part", "n_tokens", "ids_crc32")], *[("ids", pa.list_(pa.int64()))] * with_ids])

    def documents(batches):
        for b in batches:
            for row in b.to_pylist():
                ids = rans.decode(rans.Frame(row["n"], row["freq_table"], row["states"], row["starts"], row["words"], row["word_crcs"], row["id_crcs"]))
                ends = np.cumsum(row["lengths"])
                begins = ends - row["lengths"]
                own = [ids[a:e] for a, e in zip(begins, ends)]
                cols = [[row["part"]] * len(own), row["doc_ids"], (begins + row["base"]).tolist(), row["lengths"], [crc32(x.tobytes()) for x in own]] + [[x.tolist() for x in own]] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, fields)], schema=fields)

    # frames are large: few per Arrow batch keep the worker's memory small
    return map_arrow(spark.read.schema(FRAME_SCHEMA).parquet(path), documents, schema)


def token_index(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, read back from the files."""
    parts = spark.read.schema(FRAME_SCHEMA).parquet(path).groupBy("part").agg(F.sum("n").alias("n"))
    before = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return read_token_files(spark, path).join(before, F.col("part") == F.col("p")).select("doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def op10_token_files(spark, sf_dir: str) -> DataFrame:
    """All documents through the byte-level vocabulary, written in ascending doc_id order and read back.

    A null doc_id comes first; null and empty texts are the end id alone; rows with the same doc_id follow their
    texts' hash; an empty table gives no row.
    """
    prepare(spark)
    path = shared_path(spark, "token-files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return token_index(spark, path)
