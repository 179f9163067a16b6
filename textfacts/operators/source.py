"""Source diagnostics: confusable identifiers, hidden characters and spans."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import columns as C
from ..functions import kernels as K
from ..functions import unicode_data as U

#: Words whose skeletons a worker remembers, and their longest length.
REMEMBERED_WORDS, SHORT_WORD = 200_000, 64


def identifier_spans(sources: DataFrame, *, pattern: str = r"[A-Za-z_][A-Za-z0-9_]*") -> DataFrame:
    """source_id, scope, idx, text of the identifiers that a pattern finds in (source_id, scope, text)."""
    return sources.select("source_id", "scope", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("idx", "text"))


def confusable_classes(identifiers: DataFrame, tables: dict, direction: str = "LTR") -> DataFrame:
    """source_id, scope, skeleton, different texts, pairs of occurrences with different text.

    Pairs are counted from the sizes of the texts' groups, not built.
    """
    distinct = identifiers.groupBy("source_id", "scope", "text").agg(F.count(F.lit(1)).alias("n"))
    keyed = distinct.withColumn("skeleton_sha256", C.skeleton_digest("text", tables, direction))
    g = keyed.groupBy("source_id", "scope", "skeleton_sha256").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    return g.filter("texts > 1").select("source_id", "scope", "skeleton_sha256", "texts", F.expr("(n * n - squares) div 2").alias("pairs"))


def _by_look(identifiers: DataFrame, tables: dict, direction: str) -> DataFrame:
    """source_id, scope, look (the skeleton), and text where it differs from that; a batch's repeats once.

    A worker remembers the skeletons of short words, which come again in source after source.  The plan
    cannot carry a condition on the look below this step, so no word is looked at twice.
    """
    prototype = tables["prototype"]
    rows = identifiers.select("source_id", "scope", "text").dropna()
    keys = [k for k, _ in rows.dtypes]
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("look", T.StringType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        U.use(tables)
        skeleton = K.skeletons(prototype, direction)

        def look(text: str) -> str | None:
            try:
                return skeleton(text)
            except K.TextFactError:
                return None

        remembered = lru_cache(REMEMBERED_WORDS)(look)
        for batch in batches:
            found = pa.Table.from_batches([batch])
            if not any(pa.types.is_nested(t) for t in found.schema.types):
                found = found.group_by(keys).aggregate([])
            words = found.column("text").to_pylist()
            looks = [remembered(w) if len(w) <= SHORT_WORD else look(w) for w in words]
            own = [None if w == x else w for w, x in zip(words, looks)]
            out = pa.table([found.column("source_id"), found.column("scope"), pa.array(looks, pa.string()), pa.array(own, pa.string())], names=schema.names)
            yield from out.filter(out.column("look").is_valid()).combine_chunks().to_batches()

    return rows.mapInArrow(run, schema)


def confusable_pairs(identifiers: DataFrame, tables: dict, direction: str = "LTR") -> DataFrame:
    """source_id, scope, left and right text of the different confusable identifiers, each pair of texts once.

    One shuffle, by the look; only the texts of classes with more than one row are gathered.
    """
    key = ["source_id", "scope", "look"]
    rows = _by_look(identifiers, tables, direction).repartition(*key)
    several = rows.withColumn("__n", F.count(F.lit(1)).over(W.partitionBy(*key))).filter("__n > 1")
    classes = several.groupBy(*key).agg(F.collect_set(F.coalesce("text", "look")).alias("texts")).filter(F.size("texts") > 1)
    pairs = classes.select("source_id", "scope", "texts", F.explode("texts").alias("left_text")).select("source_id", "scope", "left_text", F.explode("texts").alias("right_text"))
    return pairs.filter(C.utf16_order("left_text") < C.utf16_order("right_text"))


def hidden_characters(sources: DataFrame) -> DataFrame:
    """source_id, pos (code point), character of bidi controls, default ignorables and format characters."""
    hidden = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in C._ranges("".join(set(U.characters("Bidi_Control") + U.characters("Default_Ignorable_Code_Point") + U.characters("gc=Cf"))))) + "]"
    some = sources.filter(F.col("text").rlike(hidden))
    return some.select("source_id", F.posexplode(F.split("text", "")).alias("pos", "character")).filter(F.col("character").rlike(hidden))


def hidden_in_spans(hidden: DataFrame, spans: DataFrame) -> DataFrame:
    """Each hidden character with the spans (source_id, start, end) that cover it: start <= pos < end."""
    s = spans.withColumnRenamed("source_id", "__source")
    return hidden.join(s, (hidden["source_id"] == s["__source"]) & (F.col("start") <= F.col("pos")) & (F.col("pos") < F.col("end"))).drop("__source")
