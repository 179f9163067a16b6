"""The pipeline's stages on a small corpus with known duplicates and rejects."""

import random

import corpus_pipeline as P
import pytest


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    syllables = {"en": ["the", "ing", "ther", "wh", "ou"], "fr": ["eau", "ç", "oi", "ais", "elle"]}
    word = lambda lang: "".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 5)))
    text = lambda lang, n=120: " ".join(word(lang) for _ in range(n))
    rows = [(k, text(lang), lang, "src", 0, "extra") for k, lang in enumerate(["en", "fr"] * 60)]
    near = rows[5][1].split()
    near[60] = "changed"
    rows += [(200, rows[3][1], "fr", "src", 0, "x"), (201, rows[3][1], "fr", "src", 0, "x"), (201, rows[3][1], "fr", "src", 0, "x"), (202, " ".join(near), "fr", "src", 0, "x")]
    rows += [(300, None, "en", "src", 0, "x"), (301, "", None, None, 0, "x"), (302, " ".join(f"{w}***" for w in text("en").split()), "en", "src", 0, "x"), (303, "1 2 3 4 5 6 7 8 9 10 11 12", "en", "src", 0, "x")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __extra string")


def test_stages(spark, corpus):
    rows, docs = corpus
    kept = {}
    for name, stage in P.STAGES[:-1]:
        docs = P.materialize(stage(spark, docs, ""))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "__extra"]
        kept[name] = sorted(r["doc_id"] for r in docs.collect())
    ids = sorted(r[0] for r in rows)
    assert kept["quality"] == [i for i in ids if i not in (300, 301, 302)] or kept["quality"] == [i for i in ids if i not in (300, 301, 302, 303)]
    assert kept["language"] == [i for i in ids if i < 300]
    assert kept["exact"] == sorted({i for i in ids if i < 300} - {3, 200})
    assert kept["near"] == sorted({i for i in ids if i < 300} - {3, 200, 202})
    packed = P.STAGES[-1][1](spark, docs, "").toPandas()
    assert sorted(set(packed["doc_id"])) == kept["near"]


def test_empty(spark, corpus):
    docs = corpus[1].limit(0)
    for _, stage in P.STAGES[:-1]:
        docs = P.materialize(stage(spark, docs, ""))
    assert P.STAGES[-1][1](spark, docs, "").count() == 0
