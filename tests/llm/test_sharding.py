"""Sharding laws against plain Python."""

import random
import zlib

from textfacts.llm import sharding
from textfacts.llm.sharding import longest_first, shard


def check(got, rows, shards):
    assert sorted(zip(got["size"], got["text_crc32"])) == sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t, *_ in rows)
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    assert set(got["shard"]) <= set(range(shards))
    assert (got.groupby("text_crc32")["shard"].nunique() == 1).all()
    assert set(got["law"]) == {"bytes"} and got["grown_shard"].isna().all()


def test_heap_against_search():
    rng = random.Random(5)
    units = [(f"u{k}", rng.randrange(1, 50)) for k in range(200)]
    where, loads = longest_first(units, 7), [0] * 7
    for name, size in sorted(units, key=lambda u: (-u[1], u[0])):
        assert where[name] == min(range(7), key=lambda k: (loads[k], k))
        loads[where[name]] += size


def test_groups_slots_and_balance(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(k, "w" * rng.randrange(0, 200) + str(k % 300), "x") for k in range(900)] + [(None, None, None), (None, None, None), (7, "", "x"), (7, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size string")
    got = shard(docs, shards=5).toPandas()
    check(got, rows, 5)
    sums = got.groupby("shard")["size"].sum()
    assert sums.max() - sums.min() < 700
    monkeypatch.setattr(sharding, "UNITS", 20)  # nearly all groups go through bundles
    monkeypatch.setattr(sharding, "BUNDLES", 64)
    check(shard(docs, shards=5).toPandas(), rows, 5)


def test_one_group_holds_a_third(spark):
    rows = [(k, "same text" if k % 3 == 0 else f"text {k}") for k in range(300)]
    check(shard(spark.createDataFrame(rows, "doc_id long, text string")).toPandas(), rows, 24)


def test_empty(spark):
    assert shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0
