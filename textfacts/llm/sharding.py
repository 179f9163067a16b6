"""Sharding by longest-processing-time scheduling.

Equal texts stay together.  Groups, sorted by size, go to the least-loaded shard
through a heap.  The schedule is made on the driver over a bounded number of
units, whatever the number of groups:

* a group larger than 1/UNITS of all bytes is a unit of its own (fewer than UNITS
  such groups can exist);
* the others are dealt by text digest into BUNDLES bundles, each a unit.

So no shard exceeds the mean by more than a large group forces, or else by one
unit.  Documents find their shard by a broadcast of those bounded lists, without
a join on the text.  Sizes are summed per digest with map-side combining, so a
group that holds a third of all rows is no hot spot; slots are numbered inside
(shard, bucket) with offsets from bucket counts, so no task numbers a whole shard.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

SHARDS = 24
UNITS = 16_384
BUNDLES = 8_192
BUCKETS = 256


def longest_first(units: Iterable[tuple[str, int]], shards: int) -> dict[str, int]:
    """Shard of each (name, size): longest first, each to the least-loaded shard."""
    heap = [(0, k) for k in range(shards)]
    where = {}
    for name, size in sorted(units, key=lambda u: (-u[1], u[0])):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        where[name] = shard
    return where


def shard(docs: DataFrame, *, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    Size: UTF-8 bytes of the text plus ``overhead``.  Null texts count as empty
    and stay with the empty ones; repeated rows each get a slot; ties in size go
    by digest, ties in id by size and checksum.  An empty table gives an empty
    result; other columns are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.sha2(text.cast("binary"), 256).alias("digest"),
    )
    bundle = F.concat(F.lit("b"), F.pmod(F.xxhash64("digest"), F.lit(BUNDLES)).cast("string"))
    groups = rows.groupBy("digest").agg(F.sum("size").alias("size"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    alone = F.col("size") * UNITS > F.lit(total)
    units = groups.groupBy(F.when(alone, F.col("digest")).otherwise(bundle).alias("unit")).agg(F.sum("size").alias("size"))
    # At most UNITS + BUNDLES rows reach the driver.
    where = longest_first(((r["unit"], r["size"]) for r in units.toLocalIterator()), shards)
    plan = spark.createDataFrame(list(where.items()), "unit string, shard int")
    single = F.broadcast(plan.filter(F.length("unit") == 64).select(F.col("unit").alias("digest"), F.col("shard").alias("own")))
    bundled = F.broadcast(plan.filter(F.length("unit") < 64).select(F.col("unit").alias("bundle"), F.col("shard").alias("shared")))
    placed = rows.join(single, "digest", "left").withColumn("bundle", bundle).join(bundled, "bundle", "left")
    placed = placed.select("doc_id", "size", "text_crc32", F.coalesce("own", "shared").alias("shard"), F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(BUCKETS)).cast("int").alias("bucket"))
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    first = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))  # at most shards x BUCKETS rows
    within = W.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")
    numbered = placed.withColumn("k", F.row_number().over(within) - 1).join(F.broadcast(first), ["shard", "bucket"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("k")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near-equal bytes."""
    return shard(table(spark, sf_dir, "documents"))
