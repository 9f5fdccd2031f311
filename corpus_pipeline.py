"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; stages meet in Parquet tables. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodspark.llm import bpe, common, decontaminate, language_id, simhash, suffix_dedup
from floodspark.llm.queries import table, tokenizer_file


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language. Null and empty texts, those without a letter and those without any known
    n-gram go; a null lang is only not learned from; repeated rows share their fate; an empty table gives no rows."""
    pred, score = common.unused(docs, "lang_pred", "lang_score")
    model = language_id.fit(docs.select("doc_id", "text", "lang"))
    told = language_id.identify(docs, model, pred, score)
    return told.filter((told[pred] != "und") & (told[score] > 0)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest doc_id, null ones last. Null and empty texts are near
    copies of each other; of equal rows one stays; an empty table gives no rows."""
    return simhash.keep_one(docs, k=3, radius=3)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of repeated 200-byte strings; characters cut through go as well. n_chars follows where a
    text changes. All rows stay; a null text stays null; equal rows repeat each other; an empty table gives no rows."""
    own, no, at, kept = common.unused(docs, "text_hash", "cut_id", "cut_hash", "cut_text")
    left = suffix_dedup.repeated_bytes(docs, width=200).filter("n_removed > 0").groupBy("doc_id", "text_hash").agg(F.first("kept").alias("kept"))
    left = left.select(F.col("doc_id").alias(no), F.col("text_hash").alias(at), suffix_dedup.valid_text("kept").alias(kept))
    rows = docs.withColumn(own, F.xxhash64("text"))
    rows = rows.join(left, rows["doc_id"].eqNullSafe(left[no]) & (rows[own] == left[at]), "left").withColumn("text", F.coalesce(kept, "text"))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col(at).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no 10-word phrase of a benchmark item. Null and empty texts hold none and stay; repeated
    rows share their fate; an empty table, or an empty benchmark, changes nothing."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), width=10)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers), n_tokens and decoded text of every row. A null text
    counts as empty; an empty table gives no rows."""
    return bpe.encode_decode(docs, tokenizer_file())


STAGES = [("language ID", identify_language), ("SimHash near-dedup", drop_near_duplicates), ("suffix-array dedup", cut_repeats), ("benchmark decontamination", decontaminate_benchmark), ("BPE encoding and decoding", encode)]

#: SQL cannot express the language model, so the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.stored(docs)
    return docs
