"""Helpers shared by the operators: table access, shared storage, word rules."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: the ASCII blanks; everything else belongs to a word.
WORD_SPLIT = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``, read by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies use for the 256 bytes: printable
    Latin-1 characters stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(other)}


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id's decimal text modulo ``modulus`` (a null id counts as '')."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def fresh_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores put before it until no column starts with it."""
    while any(c.lower().startswith(name.lower()) for c in docs.columns):
        name = f"_{name}"
    return name


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder path that all executors and the driver share.

    ``spark.checkpoint.dir`` names the place.  Where it is unset a session on one
    machine gets a temporary folder, remembered in the session; a cluster an error,
    as its executors share no such folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("textfacts.local.shared.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="textfacts-shared-")
        spark.conf.set("textfacts.local.shared.dir", root)
    return f"{root.rstrip('/')}/textfacts-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and a
    lost executor costs a re-read, not a recomputation."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: More dropped rows than this (about 60 bytes each) are joined by a shuffle, not by a broadcast.
BROADCAST_DROPPED = 300_000


def keep_rows(docs: DataFrame, decisions: DataFrame, key: Column, *, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that ``decisions`` (doc_id, key, kept) keep, with all their columns.

    Rows are found by id and text key.  Of rows repeated with both equal, one stays
    where the decision keeps only one.
    """
    own = fresh_name(docs, "__keep_")
    by_row = materialize(decisions.groupBy("doc_id", "key").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")))
    gone = by_row.filter(~F.col("kept")).select(F.col("doc_id").alias(f"{own}id"), F.col("key").alias(f"{own}gone"))
    counts = by_row.agg(F.count(F.when(~F.col("kept"), 1)).alias("gone"), F.count(F.when(F.col("kept") & (F.col("n") > 1), 1)).alias("doubled")).first()
    if counts["gone"] <= BROADCAST_DROPPED:
        gone = F.broadcast(gone)
    rows = docs.withColumn(f"{own}key", key)
    rows = rows.join(gone, (F.col(f"{own}key") == F.col(f"{own}gone")) & rows[id_col].eqNullSafe(F.col(f"{own}id")), "left_anti")
    if counts["doubled"]:
        rows = rows.dropDuplicates([id_col, f"{own}key"])
    return rows.drop(f"{own}key")
