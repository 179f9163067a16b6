"""Records: canonical JSON, digests, Merkle roots, and comparison of recorded results."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import written


def canonical_json(value) -> str:
    """JSON with keys in UTF-16 order and finite numbers only."""
    def check(v):
        if isinstance(v, float) and not math.isfinite(v):
            raise ValueError("only finite numbers")
        if isinstance(v, dict):
            return {k: check(v[k]) for k in sorted(v, key=lambda k: k.encode("utf-16-be", "surrogatepass"))}
        return [check(x) for x in v] if isinstance(v, (list, tuple)) else v

    return json.dumps(check(value), ensure_ascii=False, separators=(",", ":"))


def unique_keys(text: str) -> object:
    """Parsed JSON; a repeated key is an error."""
    def hook(pairs):
        if len({k for k, _ in pairs}) != len(pairs):
            raise ValueError("repeated key")
        return dict(pairs)

    return json.loads(text, object_pairs_hook=hook)


def merkle(leaves: list[bytes]) -> str:
    """Root over leaf hashes: an odd node is doubled, no leaves give sha256(00)."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"\0").digest()]
    while len(level) > 1:
        level += level[-1:] * (len(level) % 2)
        level = [hashlib.sha256(b"\1" + a + b).digest() for a, b in zip(level[::2], level[1::2])]
    return level[0].hex()


class _Peaks:
    """A tree under construction: the roots of its full subtrees, in memory of its height."""

    def __init__(self):
        self.peaks: list[tuple[bytes, int]] = []

    def push(self, h: bytes, height: int = 0) -> None:
        while self.peaks and self.peaks[-1][1] == height:
            h = hashlib.sha256(b"\1" + self.peaks.pop()[0] + h).digest()
            height += 1
        self.peaks.append((h, height))

    def root(self) -> tuple[bytes, int]:
        while len(self.peaks) > 1:
            h, height = self.peaks.pop()
            self.push(lifted(h, height, self.peaks[-1][1]), self.peaks[-1][1])
        return self.peaks[0]


def lifted(h: bytes, height: int, to: int) -> bytes:
    """A node without a neighbour, doubled level by level."""
    for _ in range(to - height):
        h = hashlib.sha256(b"\1" + h + h).digest()
    return h


#: Leaves of one block of a tree are 2 to this power; blocks are folded apart from one another.
BLOCK_HEIGHT = 12
_NODES = "grp string, block long, leaves long, hash binary, height int"


def merkle_roots(rows: DataFrame, group: str, order: str, leaf: str, *, block_height: int = BLOCK_HEIGHT) -> DataFrame:
    """group, leaves, root: the Merkle root of each group's leaves in order.

    Leaves are dealt by range, numbered within their group from the counts of the ranges, and folded by
    aligned blocks; only the blocks' roots of a group meet, so a group may hold any share of the rows.
    A null leaf counts as empty; a null group is a group.
    """
    def fold(batches: Iterator[pa.RecordBatch], of_blocks: bool) -> Iterator[pa.RecordBatch]:
        out, now, held = [], None, []
        tree, n = _Peaks(), 0

        def close() -> None:
            # A tree of one node is that node; of more, all are lifted to one height first.
            if len(held) == 1:
                h, height = held[0]
            else:
                h, height = tree.root()
            out.append((*now, n, h, height))

        for batch in batches:
            for g, block, leaves, h, height in zip(*(c.to_pylist() for c in batch.columns)):
                key = (g, None if of_blocks else block)
                if n and key != now:
                    close()
                    tree, n, held = _Peaks(), 0, []
                now, n = key, n + leaves
                if len(held) < 2:
                    held.append((h, height))
                tree.push(lifted(h, height, block_height) if of_blocks else h, block_height if of_blocks else 0)
        if n:
            close()
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], ["grp", "block", "leaves", "hash", "height"])

    text = F.coalesce(F.col(leaf).cast("string"), F.lit("")).cast("binary")
    hashed = rows.select(F.col(group).cast("string").alias("grp"), F.col(order).alias("o"), F.col(leaf).cast("string").alias("x"), F.unhex(F.sha2(F.concat(F.unhex(F.lit("00")), text), 256)).alias("hash"))
    dealt = hashed.repartitionByRange("grp", "o", "x").sortWithinPartitions("grp", "o", "x")
    # Written once: a partition worked out again could be cut elsewhere.
    dealt = written(dealt.select("grp", "hash", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "leaves")
    counts = dealt.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("least"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("grp").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("grp").alias("__g"), F.col("part").alias("__p"), (before - F.col("least")).alias("shift"))
    numbered = dealt.join(starts, dealt["grp"].eqNullSafe(starts["__g"]) & (dealt["part"] == starts["__p"])).withColumn("k", F.col("at") + F.col("shift"))
    nodes = numbered.select("grp", F.shiftright("k", block_height).alias("block"), "k", "hash").repartition("grp", "block").sortWithinPartitions("grp", "block", "k")
    blocks = nodes.select("grp", "block", F.lit(1).cast("long").alias("leaves"), "hash", F.lit(0).alias("height")).mapInArrow(lambda b: fold(b, False), _NODES)
    blocks = blocks.repartition("grp").sortWithinPartitions("grp", "block")
    return blocks.mapInArrow(lambda b: fold(b, True), _NODES).select("grp", "leaves", F.lower(F.hex("hash")).alias("root"))


def compare_records(left: DataFrame, right: DataFrame, key: str, digests: list[str]) -> DataFrame:
    """key, change: 'added', 'removed', 'same', or the names of the digests that differ."""
    a = left.select(F.col(key).alias("__a"), *[F.col(d).alias(f"__a_{d}") for d in digests])
    b = right.select(F.col(key).alias("__b"), *[F.col(d).alias(f"__b_{d}") for d in digests])
    changed = F.concat_ws(",", *[F.when(~F.col(f"__a_{d}").eqNullSafe(F.col(f"__b_{d}")), F.lit(d)) for d in digests])
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(changed == "", "same").otherwise(changed)
    return a.join(b, F.col("__a") == F.col("__b"), "full_outer").select(F.coalesce("__a", "__b").alias(key), change.alias("change"))


#: How far a record can be expected to repeat, by operation.
REPRODUCIBILITY = {"compare": "environment_bound", "declared_collation": "environment_bound"}


def measure(cases: DataFrame, operation: str, result: Column, arguments: list[str], environment: dict[str, str] | None = None) -> DataFrame:
    """case_id, operation, reproducibility and the digests of request, result, environment and record.

    ``cases`` holds case_id and the argument columns.  Digests are over JSON with a
    fixed field order; ``environment`` (see ``plans.identity``) is kept apart, so a
    change of host does not change what a result says.
    """
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    request = sha(F.to_json(F.struct(F.lit(operation).alias("operation"), *[F.col(a) for a in arguments]), {"ignoreNullFields": "false"}))
    told = sha(F.to_json(F.struct(result.alias("result")), {"ignoreNullFields": "false"}))
    host = F.lit(hashlib.sha256(canonical_json(environment or {}).encode()).hexdigest())
    rows = cases.select("case_id", F.lit(operation).alias("operation"), F.lit(REPRODUCIBILITY.get(operation, "cross_runtime_exact")).alias("reproducibility"), request.alias("request_sha256"), told.alias("semantic_sha256"), host.alias("environment_sha256"))
    return rows.withColumn("record_sha256", F.sha2(F.concat_ws("\0", "operation", "request_sha256", "semantic_sha256", "environment_sha256"), 256))


def invalid_records(records: DataFrame) -> DataFrame:
    """Records whose digests are malformed or do not add up."""
    names = ["request_sha256", "semantic_sha256", "environment_sha256"]
    good = F.col("record_sha256") == F.sha2(F.concat_ws("\0", "operation", *names), 256)
    for n in names:
        good = good & F.col(n).rlike("^[0-9a-f]{64}$")
    return records.filter(~F.coalesce(good, F.lit(False)))


def replay(recorded: DataFrame, again: DataFrame) -> DataFrame:
    """case_id and what changed: added, removed, same, or the digests that differ in order of request, semantic, environment."""
    return compare_records(recorded, again, "case_id", ["request_sha256", "semantic_sha256", "environment_sha256"])


def manifest(records: DataFrame) -> DataFrame:
    """operation, cases and the Merkle root of its records in case order."""
    return merkle_roots(records, "operation", "case_id", "record_sha256").select(F.col("grp").alias("operation"), F.col("leaves").alias("cases"), "root")
