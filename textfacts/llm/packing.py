"""Packing token sequences into windows by best-fit decreasing.

Every document becomes token ids (a word-piece vocabulary file, then an end id).
A document longer than a window is first cut into full windows; what is left of
it is packed.  Best-fit decreasing takes the pieces from long to short and puts
each into the open window with the least room that still holds it; a segment
tree over the remaining capacities finds that window.

At scale the pieces (48 bytes each) are dealt in turn into as many partitions as
their number asks for, ``PER_TASK`` pieces each whatever the session's settings, and
each is packed on its own: the only loss against one global packing is the last few
windows of each partition.

Tokenising dominates.  The vocabulary's rules never look across a blank, so each
distinct word is encoded once per worker and remembered.  A word of Latin letters,
digits and ASCII signs is merged by the ranks of the vocabulary file (its order of
ids is its order of merges); any other goes through the tokenizer itself.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_letters, materialize, table

WINDOW = 4096
END_ID = 2
#: Words a worker remembers, over all its tasks; beyond that it starts anew (about 100 MB).
CACHE_WORDS = 500_000
#: Texts whose new words are encoded together.
SLICE = 200
#: Pieces that one task packs: 1 MB of rows, and thousands of windows against the few that stay open.
PER_TASK = 20_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"


#: Words whose splitting is the same by these rules as by the vocabulary's: Latin-1 letters need no composing.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: Stands for the end of a word in the ranks; no byte of UTF-8 has this value.
_END = b"\xff"
_WORD_END = "</w>"


class WordTokens:
    """Token ids of texts as little-endian unsigned 32-bit bytes, word by word."""

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.limit, self.known = limit, {}
        letters = byte_letters()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.marks = [t["content"] for t in spec["added_tokens"]]
        ranks = {}
        for token, i in spec["model"]["vocab"].items():
            ends = token != _WORD_END and token.endswith(_WORD_END)
            body = token.removesuffix(_WORD_END) if ends else token
            if all(c in letters for c in body):
                ranks[bytes(letters[c] for c in body) + _END * ends] = i
        self.merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def _add(self, words: list[str]) -> None:
        """Remembers the ids of new words."""
        known, merge, other = self.known, self.merge, []
        for word in words:
            if _PLAIN.fullmatch(word) and not any(m in word for m in self.marks):
                ids = [i for piece in _PIECES.findall(word.lower()) for i in merge(piece.encode() + _END)]
                known[word] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                other.append(word)
        for at in range(0, len(other), 10_000):
            some = other[at : at + 10_000]
            for word, got in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                known[word] = struct.pack(f"<{len(ids)}I", *ids) if (ids := got.ids) else b""

    def encode_all(self, texts: list[str]) -> list[bytes]:
        # Only blanks that the vocabulary's own rules treat as blanks split; others stay inside a "word".
        words = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        known = self.known
        new = list(set().union(*words).difference(known))
        if len(known) + len(new) > self.limit:
            known.clear()
            new = list(set().union(*words))
        self._add(new)
        return [b"".join(map(known.__getitem__, w)) for w in words]


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    """The worker's own tokenizer and memory, kept from task to task."""
    return WordTokens(path)


def cut(ids: bytes, window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of the full windows of a document and of what is left."""
    n = len(ids) // 4
    return [(at, min(window, n - at), zlib.crc32(ids[4 * at : 4 * min(at + window, n)])) for at in range(0, n, window)]


class RoomTree:
    """Segment tree over remaining capacities 0..size-1: is any window with that room open?"""

    def __init__(self, size: int):
        self.leaves = 1 << (size - 1).bit_length()
        self.any = bytearray(2 * self.leaves)

    def set(self, room: int, present: bool) -> None:
        i = self.leaves + room
        self.any[i] = present
        while i > 1:
            i >>= 1
            now = self.any[2 * i] | self.any[2 * i + 1]
            if self.any[i] == now:
                return
            self.any[i] = now

    def tightest(self, need: int) -> int:
        """The least room >= need that some open window has, or -1."""
        i, tree = self.leaves + need, self.any
        if tree[i]:
            return need
        while i > 1:
            if not i & 1 and tree[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if tree[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return -1


def best_fit_decreasing(lengths: Iterable[int], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """For each length (1..window): the sequence it goes to and its offset there."""
    lengths = np.asarray(lengths, dtype=np.int64)
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, open_by_room, made = RoomTree(window + 1), [[] for _ in range(window + 1)], 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        room = tree.tightest(need)
        if room < 0:
            at, room, made = made, window, made + 1
        else:
            at = open_by_room[room].pop()
            if not open_by_room[room]:
                tree.set(room, False)
        sequence[i], offset[i] = at, window - room
        if left := room - need:
            if not open_by_room[left]:
                tree.set(left, True)
            open_by_room[left].append(at)
    return sequence, offset


def pieces(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: every document's ids, cut into windows."""
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(path)
        for batch in batches:
            out: list[tuple] = []
            for at in range(0, batch.num_rows, SLICE):
                some = batch.slice(at, SLICE)
                for doc_id, ids in zip(some.column(0).to_pylist(), tokens.encode_all([t or "" for t in some.column(1).to_pylist()])):
                    ids += end
                    out += [(doc_id, *piece, len(ids) // 4) for piece in cut(ids, window)]
            names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 5, names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def pack(cuts: DataFrame, *, window: int = WINDOW, per_task: int = PER_TASK) -> DataFrame:
    """Adds sequence_id (unique, not gapless over partitions) and offset to pieces.

    Pieces are dealt in turn, so copies of a row spread like any others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        first = (context.partitionId() if context else 0) << 40
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        # A fixed order first, so that a task that runs again packs the same way.
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        sequence, offset = best_fit_decreasing(rows.column("length").to_numpy(), window)
        rows = rows.append_column("sequence_id", pa.array(sequence + first)).append_column("offset", pa.array(offset))
        yield from rows.to_batches(max_chunksize=50_000)

    cuts = materialize(cuts)  # encoded once: the number of pieces decides the number of tasks
    return cuts.repartition(max(1, -(-cuts.count() // per_task))).mapInArrow(run, PACKED)


def pack_documents(docs: DataFrame, path: str, **options) -> DataFrame:
    """One row per piece of each document: where it starts, and where it is packed.

    Null and empty texts are the end id alone; repeated rows are packed one by
    one; a null id stays null; an empty table gives an empty result.  Other
    columns are not read.
    """
    return pack(pieces(docs, path, **options), window=options.get("window", WINDOW))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 ids."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
