"""Byte-pair encoding and decoding with content-defined chunk reuse.

A text is cut where a rolling hash of the bytes before a place says so: before a
blank or before a character beyond ASCII, at one in ``CUT_ONE_IN`` of these places,
which makes chunks of about a kilobyte.  The cuts depend on content alone, so texts
that share a passage share its chunks; a worker encodes a chunk once and remembers
the ids of the latest ``CACHE_BYTES`` of chunks over all its tasks and texts.

A chunk encoded on its own need not agree with its place in the whole text.  The
join of two chunks is kept only if it is at a *seam*: a blank after a printable ASCII
character, or a Han letter after a stop.  The vocabulary's splitting rule matches from
left to right, lets a blank only begin a piece, keeps signs from letters and looks at
most one character ahead, so every encoding of any text around a seam splits there.  At other joins the ends of both chunks are encoded
again as one window, from seam to seam.  The window grows, twice as many ids on each
side at a time, until its first and last id agree with those of the two chunks; what
is outside of it is then right.  A window that reaches a whole chunk goes on
into the next one.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_letters, table

#: Bytes under the rolling hash, and the share of the places it looks at that it cuts.
HASH_WINDOW = 8
CUT_ONE_IN = 128
#: Bytes of chunks and ids that a worker remembers, over all its tasks; the chunks unused for longest go.
CACHE_BYTES = 64 << 20
#: Ids on each side of a join in its first window.
FIRST_WINDOW = 4
#: The splitting rule that the vocabulary file names ("ByteLevel").
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_BLANKS = b"\t\n\x0b\x0c\r "
#: Signs before Han letters (U+5000 to U+9FFF): a piece has either signs or letters.
_STOPS = {c.encode() for c in "、。，！？"}


class ChunkCodec:
    """encode: text -> ids as little-endian unsigned 32-bit bytes; decode: back."""

    def __init__(self, path: str, *, hash_window: int = HASH_WINDOW, cut_one_in: int = CUT_ONE_IN, limit: int = CACHE_BYTES):
        import tiktoken

        self.hash_window, self.cut_one_in, self.limit = hash_window, cut_one_in, limit
        self.known: dict[bytes, np.ndarray] = {}
        self.held = 0
        #: Chunks met, chunks taken from memory, joins encoded again and windows that took.
        self.met = self.reused = self.repaired = self.windows = 0
        letters = byte_letters()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.marks = {t["content"]: np.array([t["id"]], "<u4") for t in spec["added_tokens"]}
        marks = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in marks}
        self.encoding = tiktoken.Encoding("chunks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=marks)
        self.size = np.zeros(1 + max(*ranks.values(), *marks.values()), np.int64)
        for token, i in ranks.items():
            self.size[i] = len(token)

    def cuts(self, data: bytes) -> list[int]:
        """Where the rolling hash cuts."""
        b = np.frombuffer(data, np.uint8)
        at = np.flatnonzero((b == 32) | (b == 10) | (b >= 0xC0))
        at = at[at >= self.hash_window]
        rolled = np.zeros(len(at), np.uint32)
        for k in range(1, self.hash_window + 1):
            rolled = rolled * np.uint32(0x01000193) + b[at - k]
        rolled *= np.uint32(0x9E3779B1)
        return at[rolled < np.uint32(0xFFFFFFFF // self.cut_one_in)].tolist()

    def _ids(self, data: bytes) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(data.decode()), "<u4")

    def _chunk(self, data: bytes) -> np.ndarray:
        self.met += 1
        ids = self.known.pop(data, None)
        if ids is None:
            ids = self._ids(data)
            self.held += len(data) + ids.nbytes
            while self.held > self.limit and self.known:
                oldest = next(iter(self.known))
                self.held -= len(oldest) + self.known.pop(oldest).nbytes
        else:
            self.reused += 1
        self.known[data] = ids
        return ids

    @staticmethod
    def _seam(data: bytes, at: int) -> bool:
        """Whether all encodings of texts around this place split there."""
        if at in (0, len(data)):
            return True
        here = data[at]
        return here in _BLANKS and 0x21 <= data[at - 1] <= 0x7E or 0xE5 <= here <= 0xE9 and data[at - 3 : at] in _STOPS

    def _repair(self, data: bytes, left: list[np.ndarray], join: int, right: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids up to the end of a window around the join, and the right chunk's ids after it.

        ``left`` are the ids from a seam to data[join], in parts; ``right`` those of
        data from there.  None if the window would have to grow beyond the right chunk.
        """
        before = left[0] if len(left) == 1 else np.concatenate(left)
        k = FIRST_WINDOW
        while True:
            i, j = max(0, len(before) - k), min(len(right), k)
            lo, hi = join - int(self.size[before[i:]].sum()), join + int(self.size[right[:j]].sum())
            while i and not self._seam(data, lo):
                i -= 1
                lo -= int(self.size[before[i]])
            while j < len(right) and not self._seam(data, hi):
                hi += int(self.size[right[j]])
                j += 1
            if j == len(right) and hi < len(data):
                return None
            self.windows += 1
            ids = self._ids(data[lo:hi])
            if (i == 0 or ids[0] == before[i]) and (j == len(right) or ids[-1] == right[j - 1]):
                self.repaired += 1
                return np.concatenate([before[:i], ids]), right[j:]
            k *= 2

    def encode(self, text: str) -> bytes:
        return self.encode_ids(text).tobytes()

    def encode_ids(self, text: str) -> np.ndarray:
        for mark, of_mark in self.marks.items():
            if mark in text:  # the library takes these out first and encodes what is between them alone
                parts = [of_mark] * (2 * (n := len(between := text.split(mark))) - 1)
                parts[::2] = [self.encode_ids(between[k]) for k in range(n)]
                return np.concatenate(parts)
        data = text.encode()
        ends = [*self.cuts(data), len(data)]
        done: list[np.ndarray] = []  # ids up to the last seam
        open_: list[np.ndarray] = []  # ids from there to ``join``
        join = k = 0
        while k < len(ends):
            end = ends[k]
            ids = self._chunk(data[join:end])
            if self._seam(data, join):
                done += open_
                open_ = [ids]
            else:
                # A window beyond this chunk: the chunk and the next are taken as one, then the next two, four ...
                more = 1
                while (fixed := self._repair(data, open_, join, ids)) is None:
                    k = min(k + more, len(ends) - 1)
                    more *= 2
                    end = ends[k]
                    ids = self._ids(data[join:end])
                open_ = list(fixed)
            join = end
            k += 1
        return np.concatenate([*done, *open_]) if done or open_ else np.zeros(0, "<u4")

    def decode(self, ids: bytes) -> str:
        return self.encoding.decode_bytes(np.frombuffer(ids, "<u4").tolist()).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def chunk_codec(path: str) -> ChunkCodec:
    """The worker's own codec and memory, kept from task to task."""
    return ChunkCodec(path)


def encode_texts(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) for every row; null and empty texts give no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = chunk_codec(path)
        for batch in batches:
            for rows in _slices(batch):
                ids = [codec.encode_ids(t or "").astype(np.int32) for t in rows.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(rows: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text: the texts that arrays of ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = chunk_codec(path)
        for batch in batches:
            for part in _slices(batch):
                texts = [codec.decode(np.asarray(i.as_py() or [], "<u4").tobytes()) for i in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_tokens and the digests of the ids and of the text decoded from them, per row.

    Null counts as empty; repeated rows give repeated results; other columns are
    not read; an empty table gives an empty result.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = chunk_codec(path)
        for batch in batches:
            n, of_ids, of_text = [], [], []
            for rows in _slices(batch):
                for text in rows.column(1).to_pylist():
                    ids = codec.encode(text or "")
                    n.append(len(ids) // 4)
                    of_ids.append(hashlib.sha256(ids).hexdigest())
                    of_text.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def op8_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and round trip of every whole document."""
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
