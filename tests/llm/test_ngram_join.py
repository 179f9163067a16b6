"""The chosen-path join against brute force."""

import random

import numpy as np
import pytest

from textfacts.llm import ngram_join as J
from textfacts.llm.components import components


def brute(rows):
    """class_id and n_links of each row, by comparing every pair of different texts."""
    sets = {}
    for _, t, *_ in rows:
        w = (t or "").encode().split()
        sets[t or ""] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    texts = list(sets)
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    links = dict.fromkeys(texts, 0)
    for i, a in enumerate(texts):
        for b in texts[:i]:
            x, y = sets[a], sets[b]
            if x and y and 5 * len(x & y) >= 4 * len(x | y):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for d, t, *_ in rows:
        r = find(t or "")
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return sorted(((d, least.get(find(t or "")), links[t or ""]) for d, t, *_ in rows), key=str)


def corpus(seed=2, families=25, copies=12):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(4000))
    passage = [word() for _ in range(60)]
    rows = []
    for _ in range(families):
        base = [word() for _ in range(rng.randrange(30, 200))]
        for _ in range(rng.randrange(1, copies)):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 40)):
                w[rng.randrange(len(w))] = word()
            rows.append(" ".join(w))
    rows += [" ".join(passage + [word() for _ in range(80)]) for _ in range(60)]
    rows += rows[:10] + ["one two three", "one  two three", "", None, "   "]
    rng.shuffle(rows)
    return [(k * 3, t, "extra") for k, t in enumerate(rows)] + [(None, "lonely row", None), (7, "lonely row", None), (7, "lonely row", None)]


@pytest.mark.parametrize("small,node,group,dense", [(512, 512, 256, 0.5), (4, 8, 5, 0.5), (4, 8, 5, 2.0)])
def test_against_brute_force(spark, monkeypatch, small, node, group, dense):
    monkeypatch.setattr(J, "NODE_BLOCK", node)
    monkeypatch.setattr(J, "GROUP_BLOCK", group)
    monkeypatch.setattr(J.buckets, "__kwdefaults__", {"small": small, "depth": J.DEPTH, "dense": dense})
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, vid string")
    got = J.near_duplicates(docs).toPandas().astype(object)
    got = got.where(got.notna(), None)
    assert sorted(zip(got.doc_id, got.class_id, got.n_links), key=str) == brute(rows)


def test_empty(spark):
    assert J.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_recall_at_the_threshold():
    """Pairs of similarity just above 0.8 meet on some path."""
    rng = np.random.default_rng(4)
    met = 0
    for _ in range(300):
        x = rng.integers(1, 2**63, 300).astype(np.uint64)
        y = x.copy()
        y[:33] = rng.integers(1, 2**63, 33).astype(np.uint64)
        a, b = (set(n for n, d in zip(p[0], p[2]) if d == J.DEPTH) for p in (J.paths(np.sort(x)), J.paths(np.sort(y))))
        met += bool(a & b)
    assert met >= 295


def test_runs_for_a_recall():
    assert J.RUNS == J.runs_for(0.9985) == 5 and J.runs_for(0.9) < J.runs_for(0.999999)


def test_dense_nodes(spark):
    """A family is dense, documents that share a passage are not."""
    rng = np.random.default_rng(5)
    word = lambda n: rng.integers(1, 2**63, n).astype(np.uint64)
    base, passage = word(200), word(60)
    family = [np.concatenate([base[:190], word(10)]) for _ in range(40)]
    sharing = [np.concatenate([passage, word(140)]) for _ in range(40)]
    bits = lambda s: int.from_bytes(np.packbits(np.frombuffer(J.sketch(np.sort(s))[:32], np.uint8) & 1).tobytes(), "little", signed=True)
    rows = [(1, bits(s)) for s in family] + [(2, bits(s)) for s in sharing]
    assert [r["node"] for r in J.dense_nodes(spark.createDataFrame(rows, "node long, bits int")).collect()] == [1]


def test_common_counts():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 60, 40)).astype(np.uint64) for _ in range(20)] + [np.zeros(0, np.uint64)]
    got = J.common_counts(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(21) for j in range(21))


def test_components(spark):
    rng = random.Random(1)
    pairs = [(k, k + 1) for k in range(0, 60) if k % 20] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(50)]
    got = {r["vertex"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {v: v for p in pairs for v in p if p[0] != p[1]}
    for _ in range(100):
        for a, b in pairs:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root
