"""N-gram Jaccard self-join by chosen paths.

Documents are sets of five-word shingles; two different texts are linked when the
Jaccard similarity of their sets is at least 4/5.

*Paths.*  A run starts with all documents at its root.  At a node every document
samples tokens of its own set, each with probability ``FANOUT / size`` by a hash
of node and token, and goes to one child per sampled token: similar sets sample
the same tokens and stay together, while documents that only share a passage part
at the next token.  A node with at most ``SMALL`` documents is compared at once.  So
is a larger one whose documents are on average ``DENSE`` similar: splitting would
only repeat a family in all its children.  Any other is split again.  A document's
path ids up to ``DEPTH`` depend on its own set alone, so they are made in one pass
over the text, and the recursion is a sequence of counts and joins over ids; what is
left at the last level is compared whatever its size.

*Recall.*  A pair of similarity 0.8 stays together for a level with probability
0.83 and for three levels with 0.73 on average; runs are repeated until the
``RECALL`` asked for (see :func:`runs_for`).

*Comparing.*  In a node, min-hash sketches rule out pairs (kept from an estimate
of 0.6 on: five standard errors below 0.8) and sizes do (ratio under 4/5); what
is left makes candidate groups through a spanning forest.  Inside each candidate
group all pairs are then compared exactly on their whole texts.  A text and its
copies are one vertex, for which one row's text travels.

*Bounds.*  A node or group larger than a block is compared block against block,
each pair of blocks in a task of its own, so neither a task nor the driver holds
an unbounded group; links are counted where they are found and never emitted as
pairs.  Copies of a text are one vertex throughout.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .components import components

SHINGLE = 5
RECALL = 0.9985
SIMILARITY = 0.8
DEPTH = 3
FANOUT = 2.0
SMALL = 512
DENSE = 0.5
SKETCH = 96
SKETCH_PASS = 0.6
#: More open nodes than this (8 bytes each) are joined by a shuffle, not by a broadcast.
BROADCAST_NODES = 1_000_000
#: Values of the hash by which rows that carry no vertex's text stay where they are: at most this many (8 bytes each) are broadcast.
ROW_HASHES = 1 << 21
#: Documents of a node, or of a candidate group, that one task compares with each other.
NODE_BLOCK = 512
GROUP_BLOCK = 256



def runs_for(recall: float, depth: int = DEPTH, fanout: float = FANOUT) -> int:
    """Runs after which a pair of similarity ``SIMILARITY`` has met in a leaf with probability ``recall``.

    The pair shares 2s/(1+s) of each set's tokens, so the number of nodes that both
    go on to from a common node is Poisson with the mean ``fanout`` times that; the
    chance to share some path of full depth is that of a branching process to last.
    """
    mean = fanout * 2 * SIMILARITY / (1 + SIMILARITY)
    lost = 0.0
    for _ in range(depth):
        lost = math.exp(-mean * (1 - lost))
    return math.ceil(math.log(1 - recall) / math.log(lost))


RUNS = runs_for(RECALL)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_STEPS = _mix(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)
_SKETCHES = _mix(np.arange(1000, 1000 + SKETCH, dtype=np.uint64)) | np.uint64(1)
_ROOTS = _mix(np.arange(50_000, 50_000 + 64, dtype=np.uint64))


def shingles(data: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles of a UTF-8 text.

    Words are runs of anything but the ASCII blanks.  A text of one to four words
    is one shingle; a text without words has none.
    """
    import xxhash

    words = data.split()  # bytes.split() parts at exactly the ASCII blanks
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - SHINGLE + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(h))):
        rolled += h[k : k + n] * _STEPS[k]
    return np.unique(_mix(rolled))


def paths(tokens: np.ndarray, runs: int = RUNS, depth: int = DEPTH, fanout: float = FANOUT) -> tuple[list[int], list[int], list[int]]:
    """Node ids of a set over all runs, the place of each node's parent (-1: a root), and its level."""
    nodes: list[int] = []
    up: list[int] = []
    level: list[int] = []
    if not len(tokens):
        return nodes, up, level
    most = np.uint64(min(2**64 - 1, int(2**64 * fanout / len(tokens))))
    front = [(int(_ROOTS[r]), -1) for r in range(runs)]
    for d in range(depth):
        grown = []
        for path, place in front:
            p = np.uint64(path)
            g = (tokens ^ p) * _M1
            g = (g ^ (g >> np.uint64(29))) * _M2
            for child in _mix(tokens[g < most] * _STEPS[0] + p).tolist():
                grown.append((child, len(nodes)))
                nodes.append(child - (1 << 64) if child >= 1 << 63 else child)
                up.append(place)
                level.append(d + 1)
        front = grown
    return nodes, up, level


def sketch(tokens: np.ndarray) -> bytes:
    """One byte for each of ``SKETCH`` min-hashes."""
    if not len(tokens):
        return bytes(SKETCH)
    least = np.full(SKETCH, np.uint64(2**64 - 1))
    for at in range(0, len(tokens), 8192):
        least = np.minimum(least, (tokens[at : at + 8192, None] * _SKETCHES).min(axis=0))
    return (_mix(least) >> np.uint64(56)).astype(np.uint8).tobytes()


def text_key(text: Column) -> Column:
    """16 bytes of the text's sha-256: what stands for a text and all its copies."""
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


def signatures(docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """doc_id, vid (key of the text), n (shingles), nodes, up, level, sketch, bits (one of each of 32 min-hashes)."""
    schema = "doc_id long, vid binary, n int, nodes array<long>, up array<int>, level array<int>, sketch binary, bits int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                vid, n, nodes, up, level, sketches, bits = [], [], [], [], [], [], []
                for text in part.column(1):
                    data = (text.as_py() or "").encode()
                    tokens = shingles(data)
                    path = paths(tokens)
                    vid.append(hashlib.sha256(data).digest()[:16])
                    n.append(len(tokens))
                    nodes.append(path[0])
                    up.append(path[1])
                    level.append(path[2])
                    sketches.append(sketch(tokens))
                    bits.append(int.from_bytes(np.packbits(np.frombuffer(sketches[-1][:32], np.uint8) & 1).tobytes(), "little", signed=True))
                ints = pa.list_(pa.int32())
                arrays = [part.column(0), pa.array(vid, pa.binary()), pa.array(n, pa.int32()), pa.array(nodes, pa.list_(pa.int64())), pa.array(up, ints), pa.array(level, ints), pa.array(sketches, pa.binary()), pa.array(bits, pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "vid", "n", "nodes", "up", "level", "sketch", "bits"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def dense_nodes(members: DataFrame, *, dense: float = DENSE) -> DataFrame:
    """The nodes of ``members`` (node, bits) whose documents are ``dense`` similar on average.

    Two sets of similarity s agree in a one-bit min-hash with probability (1 + s) / 2.
    Bits are summed per node with map-side combining, so no pair is looked at.
    """
    ones = [F.sum(F.expr(f"shiftright(bits, {k}) & 1")).alias(f"b{k}") for k in range(32)]
    summed = members.groupBy("node").agg(F.count(F.lit(1)).alias("n"), *ones)
    agree = sum(((F.col(f"b{k}") / F.col("n")) ** 2 + (1 - F.col(f"b{k}") / F.col("n")) ** 2 for k in range(32)), F.lit(0.0)) / 32
    return summed.filter(2 * agree - 1 >= dense).select("node")


def buckets(signed: DataFrame, *, small: int = SMALL, depth: int = DEPTH, dense: float = DENSE) -> DataFrame:
    """node, vid, size of the nodes to compare: small ones, dense ones, and what is left at the last level."""
    found = None
    opened = None
    for d in range(1, depth + 1):
        entry = F.expr(f"filter(transform(nodes, (x, i) -> CASE WHEN level[i] = {d} THEN struct(x AS node, CASE WHEN up[i] >= 0 THEN nodes[up[i]] END AS parent) END), x -> x IS NOT NULL)")
        rows = signed.select("vid", "bits", F.explode(entry).alias("e")).select("vid", "bits", "e.node", "e.parent")
        if opened is not None:  # children of open nodes only; a child's documents are among its parent's
            rows = rows.join(opened, "parent", "left_semi")
        rows = rows.select("vid", "bits", "node").distinct()
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > 1)
        shared = materialize(rows.join(sizes, "node"))
        if d == depth:
            ready = shared
        else:
            large = shared.filter(F.col("size") > small)
            opened = materialize(large.select("node").distinct().join(dense_nodes(large, dense=dense), "node", "left_anti").select(F.col("node").alias("parent")))
            n = opened.count()
            opened = F.broadcast(opened) if n <= BROADCAST_NODES else opened
            ready = shared.join(opened, F.col("node") == F.col("parent"), "left_anti") if n else shared
        found = ready if found is None else found.unionByName(ready)
        if d < depth and not n:
            break
    return found.select("node", "vid", "size")


def _in_blocks(rows: DataFrame, key: str, size: str, block: int) -> DataFrame:
    """Deals the rows of each key into blocks and sends each block to its pairs: adds i, j, own."""
    parts = F.ceil(F.col(size) / block).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("vid"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other")
    return rows.repartition(F.col(key), F.col("i"), F.col("j")).sortWithinPartitions(key, "i", "j", "vid")


def _groups(batches: Iterator[pa.RecordBatch], keys: int, block: int = 2000) -> Iterator[list[tuple]]:
    """Runs of rows that agree on their first ``keys`` columns."""
    held: list[tuple] = []
    for batch in batches:
        for at in range(0, batch.num_rows, block):
            for row in zip(*(c.to_pylist() for c in batch.slice(at, block).columns)):
                if held and held[-1][:keys] != row[:keys]:
                    yield held
                    held = []
                held.append(row)
    if held:
        yield held


def _forest(linked: np.ndarray) -> list[int]:
    """Least place reachable from each place of a symmetric boolean matrix."""
    n = len(linked)
    root = [-1] * n
    for start in range(n):
        if root[start] >= 0:
            continue
        root[start], todo = start, [start]
        while todo:
            for k in np.flatnonzero(linked[todo.pop()]).tolist():
                if root[k] < 0:
                    root[k] = start
                    todo.append(k)
    return root


def _across(rows_own: np.ndarray, i: int, j: int) -> np.ndarray | bool:
    """Pairs that a block pair answers for: all within a block, or those across two."""
    return True if i == j else rows_own[:, None] != rows_own[None, :]


def candidates(members: DataFrame) -> DataFrame:
    """a, b: a spanning forest of the pairs in each node that sketches cannot rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[bytes] = []
        b: list[bytes] = []
        for rows in _groups(batches, 3):
            if len(rows) < 2:
                continue
            own = np.array([r[3] for r in rows])
            n = np.array([r[5] for r in rows])
            s = np.frombuffer(b"".join(r[6] for r in rows), np.uint8).reshape(len(rows), SKETCH)
            linked = np.zeros((len(rows), len(rows)), bool)
            for k in range(len(rows)):
                linked[k] = (s == s[k]).sum(axis=1) >= SKETCH_PASS * SKETCH
            linked &= 5 * np.minimum(n[:, None], n[None, :]) >= 4 * np.maximum(n[:, None], n[None, :])
            linked &= _across(own, rows[0][1], rows[0][2])
            for k, r in enumerate(_forest(linked)):
                if r != k:
                    a.append(rows[k][4])
                    b.append(rows[r][4])
            if len(a) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    dealt = _in_blocks(members, "node", "size", NODE_BLOCK).select("node", "i", "j", "own", "vid", "n", "sketch")
    return dealt.mapInArrow(run, "a binary, b binary")


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 matrices over column blocks."""
    m = len(sets)
    flat = np.concatenate(sets) if m else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((m, m), np.float64)
    width = 4096
    for at in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(column, [at, at + width])
        x = np.zeros((m, width), np.float32)
        x[row[lo:hi], column[lo:hi] - at] = 1
        total += x @ x.T
    np.fill_diagonal(total, [len(s) for s in sets])
    return total.astype(np.int64)


def verify(members: DataFrame) -> DataFrame:
    """vid, root, links, parts of the groups' exact links; root is the least linked vid seen in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        names = ["grp", "vid", "root", "links", "parts"]
        kinds = [pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        for rows in _groups(batches, 3, 64):
            sets = [shingles(r[6].encode()) for r in rows]
            n = np.array([len(s) for s in sets], np.int64)
            common = common_counts(sets)
            # c / (x + y - c) >= 4/5, in integers
            linked = 9 * common >= 4 * (n[:, None] + n[None, :])
            linked &= _across(np.array([r[3] for r in rows]), rows[0][1], rows[0][2])
            np.fill_diagonal(linked, False)
            root = _forest(linked)
            out += [(r[0], r[4], rows[root[k]][4], int(linked[k].sum()), r[5]) for k, r in enumerate(rows)]
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kinds)], names)
                out = []
        columns = list(zip(*out)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names)

    dealt = _in_blocks(members, "grp", "size", GROUP_BLOCK).withColumn("parts", F.ceil(F.col("size") / GROUP_BLOCK))
    return dealt.select("grp", "i", "j", "own", "vid", "parts", "text").mapInArrow(run, "grp binary, vid binary, root binary, links long, parts long")


def _texts(docs: DataFrame, text: Column, id_col: str, signed: DataFrame, grouped: DataFrame) -> DataFrame:
    """vid, text of the grouped vertices.

    Of a vertex's copies one row stands for all.  Before anything is shuffled, rows
    go by a hash of id and text that no such row has; at most ``ROW_HASHES`` values
    exist, whatever the number of rows.  The join on the vertex decides.
    """
    place = lambda vid, doc_id: F.pmod(F.xxhash64(vid, doc_id), F.lit(ROW_HASHES))
    first = signed.select("vid", "doc_id").join(grouped.select("vid"), "vid").groupBy("vid").agg(F.min("doc_id").alias("doc_id"))
    places = materialize(first.select(place("vid", "doc_id").alias("place")).distinct())
    rows = docs.select(text_key(text).alias("vid"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("place", place("vid", "doc_id")).join(F.broadcast(places), "place", "left_semi")
    return rows.groupBy("vid").agg(F.min("text").alias("text"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, class_id, n_links, vid.

    ``n_links`` is the number of other, different texts with similarity 0.8 or
    more (copies of a text are not counted); ``class_id`` is the least doc_id of
    the documents connected by links, copies included.  Null counts as empty; a
    text without words links to nothing but its copies; repeated rows share their
    class; a class of null ids only has a null class_id.  Other columns are not
    read; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    signed = materialize(signatures(docs, id_col=id_col, text_col=text_col))
    in_node = buckets(signed)
    vertex = signed.groupBy("vid").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    groups = components(candidates(in_node.join(vertex, "vid")))
    groups = groups.select(F.col("vertex").alias("vid"), F.col("root").alias("grp"))
    sized = materialize(groups.join(groups.groupBy("grp").agg(F.count(F.lit(1)).alias("size")), "grp"))
    checked = materialize(verify(sized.join(_texts(docs, text, id_col, signed, sized), "vid")))
    # A group of one block is settled by its task; larger ones are joined up over their blocks.
    large = checked.filter((F.col("parts") > 1) & (F.col("vid") != F.col("root")))
    joined = components(large.select(F.col("vid").alias("a"), F.col("root").alias("b"))).select(F.col("vertex").alias("vid"), F.col("root").alias("far_root"))
    near = checked.groupBy("vid").agg(F.sum("links").alias("links"), F.min(F.when(F.col("parts") == 1, F.col("root"))).alias("root")).join(joined, "vid", "left")
    near = near.select("vid", "links", F.coalesce("far_root", "root", "vid").alias("root"))
    least = signed.groupBy("vid").agg(F.min("doc_id").alias("least"))
    known = least.join(near, "vid", "left").select("vid", "least", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vid").alias("root"))
    classes = known.groupBy("root").agg(F.min("least").alias("class_id"))
    of_text = known.join(classes, "root").select("vid", "class_id", "n_links")
    return signed.select("doc_id", "vid").join(of_text, "vid").select("doc_id", "class_id", "n_links", "vid")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near copies and its number of links."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")
