"""Exact deduplication: skew-safe combining in three stages.

1. *Local*: every task first combines its own equal texts (the map side of the
   grouping), so a text held by a third of all rows leaves a task once.
2. *Salted*: the local winners meet per (digest, salt, text).  Only digests that
   hold more than 1/1000 of all rows are salted - at most 1000 such digests can
   exist, which is what bounds the broadcast list of them.
3. *Global*: the salt winners of a hot text (one per salt) are combined.

Texts are compared by their full content at each stage: the text itself is a
grouping key.  A digest alone decides nothing; each document finds its group by
(sha-256, xxhash64, length), and the job fails if two different texts ever share
that triple.  Everything is built-in DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

#: A digest is hot from this share of all rows on (and from HOT_ROWS rows on).
HOT_SHARE = 1000
HOT_ROWS = 500
SALTS = 64


def exact_dedup(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = SALTS,
    hot_rows: int = HOT_ROWS,
    digest: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts (a null text counts as empty) the row with the largest id
    stays; a null id loses to any other.  Rows repeated with the same id and text
    are copies of each other and exactly one of them is kept.  An empty table
    gives an empty result; other columns of ``docs`` are not read.  ``digest``
    replaces the grouping digest (tests force collisions with it).
    """
    sha256 = F.sha2(F.col("text").cast("binary"), 256)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn(
        "digest", digest(F.col("text")) if digest else sha256
    )
    least = max(hot_rows, docs.count() // HOT_SHARE)
    hot = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > least).select("digest", F.lit(True).alias("hot"))
    tagged = rows.join(F.broadcast(hot), "digest", "left").select(
        "doc_id",
        "text",
        "digest",
        F.xxhash64("text").alias("finger"),
        F.length("text").alias("chars"),
        sha256.alias("text_sha256"),
        F.coalesce("hot", F.lit(False)).alias("hot"),
        F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(salts))).otherwise(F.lit(0)).cast("int").alias("salt"),
    )

    salted = tagged.groupBy("digest", "salt", "text").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"), F.first("finger").alias("finger"), F.first("chars").alias("chars"), F.first("hot").alias("hot")
    )
    # Only a hot text has to travel again; a cold one is already whole and is told apart by its winner.
    met = salted.select(
        "digest", "finger", "chars", "hot", "keep_id", "n", F.when(F.col("hot"), F.col("text")).alias("hot_text"), F.when(~F.col("hot"), F.struct(F.col("keep_id"), F.hash("text"))).alias("cold_key")
    ).repartition("digest")
    groups = met.groupBy("digest", "finger", "chars", "hot", "hot_text", "cold_key").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    same = W.partitionBy("digest", "finger", "chars")
    groups = groups.withColumn("texts", F.count(F.lit(1)).over(same)).withColumn(
        "group_size", F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two different texts share sha-256, xxhash64 and length")).cast("long"))
    )
    every_salt = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    groups = groups.select("digest", "finger", "chars", "keep_id", "group_size", F.explode(every_salt).alias("salt"))

    keys = ["digest", "finger", "chars", "salt"]
    found = tagged.select("doc_id", "text_sha256", *keys).join(groups, keys)
    is_winner = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    # Ties among winners are repeated rows; the others get a group of their own so that none gathers.
    tie = F.row_number().over(W.partitionBy("digest", "finger", F.when(is_winner, F.lit(-1)).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)))).orderBy("doc_id"))
    return found.select("doc_id", "keep_id", "group_size", (is_winner & (tie == 1)).alias("kept"), "text_sha256")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with the row that stays for its text."""
    return exact_dedup(table(spark, sf_dir, "documents"))


OP3_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""
