"""Chunk codec and packing against the tokenizers library itself."""

import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from textfacts.llm.bpe_chunks import ChunkCodec, decode_ids, digests, encode_texts
from textfacts.llm.packing import RoomTree, WordTokens, best_fit_decreasing, cut, pack, pack_documents, pieces

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "  ", "\n\n x", "a  b", "a \n b", "it's  'll re's", "x<|endoftext|> y <|endoftext|>", "  a   b", "é ́a", "日本 語　テ", "tab\tq\x0b\x0c\r\n", "1 22 333 !!!  ??? ", "ΑΣ ΣΑΣ", "a\x1cb \x1f", "🙂 👨‍👩‍👧 é"]


def ids_of(raw: bytes) -> list[int]:
    return list(struct.unpack(f"<{len(raw) // 4}I", raw))


@pytest.fixture(scope="module")
def codec():
    return ChunkCodec(BYTE), Tokenizer.from_file(BYTE), WordTokens(WORD), Tokenizer.from_file(WORD)


@pytest.mark.parametrize("text", ODD + [" ".join(ODD), "\n".join(ODD) * 3])
def test_same_as_library(codec, text):
    mine, theirs, words, whole = codec
    raw = mine.encode(text)
    assert ids_of(raw) == theirs.encode(text, add_special_tokens=False).ids
    assert mine.decode(raw) == theirs.decode(ids_of(raw), skip_special_tokens=False) == text
    assert ids_of(words.encode(text)) == whole.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r'ab1.,<|>éΣ 　́語"), st.characters(blacklist_categories=["Cs"])), max_size=60))
def test_any_text(codec, text):
    mine, theirs, words, whole = codec
    raw = mine.encode(text)
    assert ids_of(raw) == theirs.encode(text, add_special_tokens=False).ids
    assert mine.decode(raw) == theirs.decode(ids_of(raw), skip_special_tokens=False)
    assert ids_of(words.encode(text)) == whole.encode(text, add_special_tokens=False).ids


def prose(seed: int, words: int, letters: str = "aeinrst") -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(words))


@pytest.mark.parametrize("text", [prose(1, 3000, "aeéßñ"), "日本語の文章。日本、語文" * 150, "語文" * 1000, "one  two \n\n three   four " * 200, "   ".join(prose(k, 5) for k in range(300)), "é" * 2000 + " a b " * 50])
@pytest.mark.parametrize("cut_one_in", [2, 9])
def test_joins_are_repaired_by_encoding_again(text, cut_one_in):
    codec = ChunkCodec(BYTE, cut_one_in=cut_one_in)
    assert ids_of(codec.encode(text)) == Tokenizer.from_file(BYTE).encode(text, add_special_tokens=False).ids
    if len(codec.cuts(text.encode())) > 50 and text[0] not in "é語":
        assert codec.repaired > 10 and codec.windows >= codec.repaired


def test_chunks_are_shared_by_texts():
    codec = ChunkCodec(BYTE)
    shared = prose(2, 4000)
    codec.encode(prose(3, 100) + " " + shared)
    met = codec.met
    assert len(shared) / met > 300 and codec.reused == 0
    codec.encode(prose(4, 50) + " " + shared + " " + prose(5, 50))
    assert codec.reused >= (codec.met - met) * 0.8


def test_small_cache_changes_nothing():
    text = " ".join(str(k) for k in range(500))
    small = ChunkCodec(BYTE, limit=3000, cut_one_in=8)
    assert small.encode(text) == small.encode(text) == ChunkCodec(BYTE).encode(text)
    assert sum(len(k) + v.nbytes for k, v in small.known.items()) == small.held <= 3000


def test_room_tree_against_search():
    rng, tree, rooms = random.Random(1), RoomTree(65), set()
    for _ in range(3000):
        room = rng.randrange(65)
        tree.set(room, room not in rooms)
        rooms ^= {room}
        need = rng.randrange(65)
        assert tree.tightest(need) == min((r for r in rooms if r >= need), default=-1)


def test_best_fit_decreasing_against_search():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 101, 400)
    sequence, offset = best_fit_decreasing(lengths, 100)
    rooms: list[int] = []
    for i in np.argsort(-lengths, kind="stable"):
        fits = [(r, -k) for k, r in enumerate(rooms) if r >= lengths[i]]
        if fits:
            room = min(fits)[0]
            assert 100 - offset[i] == room
            rooms[rooms.index(room)] -= lengths[i]
        else:
            assert offset[i] == 0
            rooms.append(100 - lengths[i])
    assert sorted(rooms) == sorted(100 - np.bincount(sequence, lengths).astype(int))


def test_cut_covers_everything():
    ids = struct.pack("<10I", *range(10))
    assert [(s, n) for s, n, _ in cut(ids, 4)] == [(0, 4), (4, 4), (8, 2)]
    assert cut(ids, 4)[2][2] == zlib.crc32(struct.pack("<2I", 8, 9))


ROWS = [(1, "plain words here", "x"), (1, "plain words here", "x"), (2, None, "y"), (3, "", None), (None, "no id", "z"), (9, "long " * 9000, "q")]


def test_packing_query(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, length string")
    got = pack_documents(docs, WORD).toPandas()
    whole = Tokenizer.from_file(WORD)
    total = sum(len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in ROWS)
    assert got["length"].sum() == total
    for _, seq in got.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert (seq["offset"].to_numpy() == np.concatenate([[0], seq["length"].cumsum().to_numpy()[:-1]])).all()
        assert seq["length"].sum() <= 4096
    assert pack_documents(docs.limit(0), WORD).count() == 0


def test_packing_fills_windows_whatever_the_partitions(spark):
    """Copies of one row spread over the tasks, and the fill does not depend on the session's partitions."""
    docs = spark.createDataFrame([(k % 7, "word " * (1 + 37 * k % 900)) for k in range(1500)] + [(5, "copied row here")] * 700, "doc_id long, text string")
    cuts = pieces(docs.repartition(9), WORD)
    whole = pack(cuts).toPandas()
    assert whole["length"].sum() / (4096 * whole["sequence_id"].nunique()) > 0.99
    split = pack(cuts, per_task=500)
    assert split.rdd.getNumPartitions() == 5
    rows = split.toPandas()
    assert (rows["sequence_id"] // (1 << 40)).value_counts().max() <= 500
    assert rows["length"].sum() == whole["length"].sum() and rows["length"].sum() / (4096 * rows["sequence_id"].nunique()) > 0.95


def test_codec_query(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, ids string")
    encoded = encode_texts(docs, BYTE)
    back = decode_ids(encoded, BYTE).toPandas()
    assert sorted(back["text"]) == sorted(t or "" for _, t, _ in ROWS)
    got = digests(docs, BYTE).toPandas()
    assert len(got) == len(ROWS) and got["n_tokens"].min() == 0
    assert digests(docs.limit(0), BYTE).count() == 0
