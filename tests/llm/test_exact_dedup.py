"""Exact deduplication against a dictionary, with forced digest collisions and salting."""

import hashlib

import pytest
from pyspark.sql import functions as F

from textfacts.llm.exact_dedup import exact_dedup


def expected(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(text or "", []).append(doc_id)
    out = []
    for doc_id, text, *_ in rows:
        ids = groups[text or ""]
        known = [i for i in ids if i is not None]
        out.append((doc_id, max(known) if known else None, len(ids), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(k, f"text {k % 40}", "e") for k in range(200)] + [(500 + k, "hot", "e") for k in range(300)] + [(900, None, "n"), (901, "", "n"), (None, "no id", "z"), (None, "no id", "z"), (7000, "twice", "q"), (7000, "twice", "q"), (7001, "l" * 200_000, "q")]


@pytest.mark.parametrize("digest", [None, lambda t: F.pmod(F.length(t), F.lit(3)).cast("string"), lambda t: F.lit("one")])
def test_against_dictionary(spark, digest):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, digest string")
    got = exact_dedup(docs, hot_rows=20, salts=4, digest=digest).toPandas().astype(object)
    got = got.where(got.notna(), None)
    assert sorted(zip(got.doc_id, got.keep_id, got.group_size, got.text_sha256), key=str) == expected(ROWS)
    kept = got[got.kept]
    assert sorted(kept.text_sha256) == sorted({hashlib.sha256((t or "").encode()).hexdigest() for _, t, _ in ROWS})
    assert all(a == b for a, b in zip(kept.doc_id, kept.keep_id))


def test_empty(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
