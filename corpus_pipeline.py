"""Documents to training sequences in five stages; each keeps the columns of documents until the last."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusveil.llm import jaccard, langid, lines, packing, pii
from corpusveil.llm.frames import prepare
from corpusveil.llm.queries import CAPACITY, table
from corpusveil.session import materialize

#: A text goes if less than this share of its letters is in its main language.
LEAST_SHARE = 0.5


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars as the text now has."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose main language is known and holds LEAST_SHARE of the letters; the model
    learns from all documents with a language. Texts without a letter go."""
    return langid.accepted(docs, langid.fit(docs), LEAST_SHARE)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line go, and documents of which no line is left."""
    clean = lines.dedup_lines(docs)
    return _sized(clean.where((F.col("n_kept") > 0) | (F.col("n_lines") == 0)).select(docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that links of 0.8 Jaccard on five-word shingles join, one with the smallest id stays.

    Rows are decided one by one: an id on two texts may stay with one of them. Rows without an id
    come last, so they stay only in a group without ids. Of rows that repeat id and text one stays
    (by the other columns). Texts without a word are linked with nothing: all their rows stay.
    """
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", "text"))
    found = jaccard.jaccard_components(keyed, "_key").where(F.col("n_shingles") > 0)
    rows = materialize(
        found.groupBy(F.col("doc_id").alias("_key"), F.col("component_id").alias("_comp")).agg(F.count(F.lit(1)).alias("_n")), "rows"
    )
    named = keyed.select("_key", "doc_id").distinct().join(rows.select("_key", "_comp"), "_key")
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_key").alias("key")))
    stays = materialize(named.groupBy("_comp").agg(first.alias("first")).select(F.col("first.key").alias("_key")), "stays")
    left = keyed.join(rows.select("_key").join(stays, "_key", "left_anti"), "_key", "left_anti")
    repeated = materialize(rows.where("_n > 1").select("_key").join(stays, "_key", "left_semi"), "repeated")
    if repeated.isEmpty():
        return left.select(docs.columns)
    again = left.join(repeated, "_key", "left_semi").groupBy("_key", F.xxhash64(F.lit(1), "text")).agg(F.min(F.struct(*docs.columns)).alias("row"))
    return left.join(repeated, "_key", "left_anti").select(docs.columns).unionByName(again.select("row.*"))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, disguised or not, becomes <EMAIL>, <IP>, <CARD> or <PHONE>."""
    return _sized(pii.mask(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of CAPACITY tokens."""
    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), CAPACITY)
    sized = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(sized, "length", CAPACITY, ["doc_id", "piece"])


def _shipped(stage: Callable) -> Callable:
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        prepare(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    (f.__name__, _shipped(f)) for f in (language_id, line_dedup, near_duplicates, mask_pii, best_fit_packing)
]

#: The tokenizer, the language model and the disguises are not SQL: tests/llm compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stored and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
