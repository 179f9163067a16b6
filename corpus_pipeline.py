"""From ``documents`` to packed sequences: five stages, each on all that the one before kept.

Null texts count as empty and go at the quality stage; repeated rows and copies
leave one row; an empty table passes through as an empty table; columns beyond
those of ``documents`` are carried along up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textfacts.llm.common import fresh_name, keep_rows, materialize, table
from textfacts.llm.exact_dedup import exact_dedup
from textfacts.llm.language import identify, train, training_rows
from textfacts.llm.ngram_join import near_duplicates, text_key
from textfacts.llm.packing import pack_documents
from textfacts.llm.quality import keep_quality

#: A document stays if one language makes up at least this share of it.
LEAST_SHARE = 0.5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and their source's adaptive thresholds."""
    return keep_quality(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters in which one learned language prevails."""
    own = fresh_name(docs, "__mixture_")
    judged = identify(docs, train(training_rows(docs)), prefix=own)
    return judged.filter((F.col(f"{own}lang_pred") != "und") & (F.col(f"{own}score") >= LEAST_SHARE)).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest id."""
    decided = exact_dedup(docs).select("doc_id", F.unhex(F.substring("text_sha256", 1, 32)).alias("key"), "kept")
    return keep_rows(docs, decided, text_key(F.coalesce(F.col("text"), F.lit(""))))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, the document with the least id."""
    decided = near_duplicates(docs).select("doc_id", F.col("vid").alias("key"), F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))
    return keep_rows(docs, decided, text_key(F.coalesce(F.col("text"), F.lit(""))))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of 4096 ids."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality_rules), ("language", language), ("exact", exact), ("near", near), ("packing", packing)]

#: Near copies and packing have no SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
