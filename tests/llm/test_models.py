"""Language mixture, toxicity network and licence rules."""

import random

import numpy as np
import pytest

from textfacts.llm import language as L
from textfacts.llm import toxicity as X
from textfacts.llm.licences import licence_scan, scan

PARTS = {"aa": ["the", "ing", "ther", "wh", "ou"], "bb": ["eau", "oi", "ais", "elle", "ç"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_language(spark):
    rng = random.Random(1)
    rows = [(k, text(rng, lang, 50), lang, "x") for k, lang in enumerate(["aa", "bb"] * 40)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = L.train(labelled, per_language=20)
    mixed = text(rng, "aa", 60) + " " + text(rng, "bb", 30)
    asked = [(1, text(rng, "aa", 30), "q"), (2, text(rng, "bb", 30), "q"), (3, mixed, "q"), (4, None, "q"), (5, " 12 !! ", "q"), (6, text(rng, "bb", 30_000), "q"), (6, "", "q")]
    got = L.identify(spark.createDataFrame(asked, "doc_id long, text string, score string"), model, prefix="p_").collect()
    by = {(r["doc_id"], r["text"]): r for r in got}
    assert [by[a[0], a[1]]["p_lang_pred"] for a in asked] == ["aa", "bb", "aa", "und", "und", "bb", "und"]
    assert by[3, mixed]["p_shares"] == pytest.approx([2 / 3, 1 / 3], abs=0.06) and all(r["score"] == "q" for r in got)
    assert L.identify(labelled.limit(0), model).count() == 0
    none = L.train(labelled.limit(0))
    assert {r["lang_pred"] for r in L.identify(labelled.limit(2), none).collect()} == {"und"}


def test_em_finds_the_mixture():
    rng = np.random.default_rng(2)
    p = np.where(rng.random((3000, 1)) < 0.7, [[1.0, 0.05, 0.05]], [[0.05, 1.0, 0.05]])
    shares = L.mixture(p)
    assert shares[2] == 0 and shares[0] == pytest.approx(0.7, abs=0.04)


def test_gradients():
    net = X.Network(3)
    grams = [X.hashed(w) for w in ("one", "two", "three", "four")]
    ids, mask, y = np.array([[0, 1, 2], [3, 2, 0]]), np.array([[1, 1, 1], [1, 1, 0]], np.float32), np.array([1, 0], np.float32)
    inside = np.array([[0, 1, 1], [1, 1, 0]], np.float32)

    def loss(k, at, eps):
        old = net.p[k][at]
        net.p[k][at] = old + eps
        lengths = [len(g[1]) for g in grams]
        v = np.stack([net.p["word"][g[0]] + net.p["char"][g[1]].mean(axis=0) for g in grams]).astype(np.float32)
        x = v[ids.T]
        s = net.score(x @ net.p["xf"] + net.p["cf"], x @ net.p["xb"] + net.p["cb"], mask.T, inside.T)
        net.p[k][at] = old
        assert lengths
        return float(-(y * np.log(s) + (1 - y) * np.log(1 - s)).mean())

    picks = [("xf", (2, 5)), ("ub", (1, 20)), ("uf", (3, 2)), ("cb", (9,)), ("a", (4, 3)), ("v", (2,)), ("o", (7,)), ("word", (grams[2][0], 4)), ("char", (grams[0][1][0], 1))]
    want = [(loss(k, at, 1e-2) - loss(k, at, -1e-2)) / 2e-2 for k, at in picks]
    before = {k: v.copy() for k, v in net.p.items()}
    net.learn(grams, ids, mask, inside, y, 0.0)
    for (k, at), w in zip(picks, want):
        assert 10 * net.m1[k][at] == pytest.approx(w, abs=2e-4), k
    assert all((before[k] == net.p[k]).all() for k in before)


def test_windows_cover_everything():
    lengths = np.array([0, 1, 32, 33, 100])
    doc, start, n = X.windows(lengths)
    for d, size in enumerate(lengths):
        seen = {w for k in np.flatnonzero(doc == d) for w in range(start[k], start[k] + n[k])}
        assert seen == set(range(size))


def test_toxicity(spark):
    rng = random.Random(4)
    texts, labels = [], []
    for k in range(300):
        words = text(rng, "aa", rng.randrange(40, 160)).split()
        if k % 3 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["vile", "rotten", "hateful"]))
        texts.append(" ".join(words))
        labels.append(int(k % 3 == 0))
    net = X.fit(texts[:200], labels[:200])
    rows = [(k, t, "x") for k, t in enumerate(texts[200:])] + [(900, None, "x"), (901, "", "x"), (902, "...", "x"), (903, text(rng, "aa", 40_000) + " vile rotten hateful vile", "x")]
    got = {r["doc_id"]: r for r in X.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string, score string"), net).collect()}
    right = sum(got[k]["predicted"] == labels[200 + k] for k in range(100))
    assert right >= 95
    assert got[900]["score"] == got[901]["score"] == got[902]["score"] == 0 and got[903]["predicted"] == 1
    assert X.score_toxicity(spark.createDataFrame([], "doc_id long, text string"), net).count() == 0


MIT = "MIT License\n\nCopyright (c) 2020 A B\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."


def test_licences(spark):
    names = lambda t: [m[0] for m in scan(t)]
    assert names("Released under the MIT License.") == ["MIT"]
    assert names(MIT) == ["MIT"] and scan(MIT)[0][1:] == (0, len(MIT))
    assert names("x.\nThis work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0.") == ["GPL-3.0-only", "CC-BY-NC-4.0"]
    assert names("Licensed under the Apache License, Version 2.0.") == ["Apache-2.0"]
    assert names("SPDX-License-Identifier: LGPL-2.1-or-later") == ["LGPL-2.1-or-later"]
    assert names("He was licensed to drive. No permission was given.") == [] and names("") == []
    rows = [(1, "a\n" * 50_000 + "Released under the MIT License.", "x"), (2, None, "x"), (2, None, "x")]
    got = licence_scan(spark.createDataFrame(rows, "doc_id long, text string, licences string")).collect()
    assert sorted((r["doc_id"], r["licences"]) for r in got) == [(1, ["MIT"]), (2, []), (2, [])]
