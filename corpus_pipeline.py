"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Every stage works on all that its predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import jaccard_join, langid, mixing, packing, toxicity
from plumbline.llm.common import free, learn_rows, prepare, rows_a_batch, stored

#: The stages are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.7 or more go. The model learns from labels outside the held-out third.

    Null and empty texts are scored as blank; very long ones whole; repeated rows alike; columns of any name stay.
    """
    (score,) = free(docs, "__toxicity")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(learn_rows(F.col("doc_id"), 3) != 1)
    model = toxicity.train(docs, labels)
    scored = toxicity.score_documents(docs, model, score)
    return scored.filter(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language can be told (null, or without a letter) go.

    Very long texts are read whole; repeated rows are told alike; columns of any name stay.
    """
    lang, score = free(docs, "__lang", "__score")
    model = langid.train(docs.filter(learn_rows(F.col("doc_id"), 4) != 2))
    tagged = langid.identify(docs, model, lang, score)
    return tagged.filter(F.col(lang) != langid.UNKNOWN).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of links one document stays: smallest doc_id, then hash. Wordless documents stay."""
    h, kd, kh = free(docs, "__h", "__kd", "__kh")
    found = stored(jaccard_join.similarity_components(docs.select("doc_id", "text")), "groups")
    keep = found.filter("n_shingles > 0").groupBy("group_key").agg(F.min(F.struct("doc_id", "h")).alias("k")).select(F.col("k.doc_id").alias(kd), F.col("k.h").alias(kh))
    hashed = docs.withColumn(h, F.xxhash64("text"))
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(mixing.WORD)
    kept = hashed.filter(worded).join(keep, F.col("doc_id").eqNullSafe(F.col(kd)) & (F.col(h) == F.col(kh)), "left_semi").dropDuplicates(["doc_id", h])
    return kept.unionByName(hashed.filter(~worded)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document appears as often as the mix takes it: 0 to 3 times.

    Null texts have no words and stay once; null sources are one source; rows equal in every column share their copies;
    columns of any name stay.
    """
    h, d, k, n, one = free(docs, "__h", "__d", "__k", "__copies", "__copy")
    hashed = docs.withColumn(h, F.xxhash64(*docs.columns))
    small = stored(hashed.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), F.col(h).alias("h")), "mix-docs")
    copies = mixing.mix(small, "size", "source", ["doc_id", "h"]).groupBy(F.col("doc_id").alias(d), F.col("h").alias(k)).agg(F.sum("copies").cast("int").alias(n)).filter(F.col(n) > 0)
    once = hashed.dropDuplicates(["doc_id", h])
    joined = once.join(copies, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(h) == F.col(k)))
    return joined.withColumn(one, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences of at most 4096 tokens.

    Null and empty texts are the end id alone; longer texts are cut; repeated rows are packed each; other columns go.
    """
    with rows_a_batch(spark, 1000):  # workers of the earlier stages still stand beside these
        cut = stored(packing.pieces(docs), "pieces")
    return packing.pack(cut, ["doc_id", "piece", "ids_crc32"])


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_known_languages),
    ("near duplicates", keep_one_of_each_group),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
