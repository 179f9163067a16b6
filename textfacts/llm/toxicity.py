"""Toxicity scores from a bidirectional gated recurrent network, in numpy.

Inputs of a step are a word vector and the mean of its character-trigram vectors
(both hashed).  A gated recurrent layer runs in each direction over the text, in
segments of ``SEGMENT`` words that it enters ``CONTEXT`` words early from either side,
so every word has one state.  Attention pools the states of a window of ``WINDOW``
words and a logistic unit scores it.  A window starts at every word that has a whole
window from there on; a document's score is that of its most toxic window.  All
overlapping windows share the states of their words, and the weighted sums of a window
are differences of running sums, so scoring each of them costs no more than one run
over the text.  Training looks at windows that start every ``STRIDE`` words, with the
context around them.

A label says that a document is toxic, not where.  Training therefore alternates:
each toxic document teaches by the windows that the network so far finds most
toxic, clean documents by their most toxic and by random ones.

The network is fitted on the driver to at most ``PER_CLASS`` labelled documents of
each class, taken in the order of a hash; every document is scored whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, table

PER_CLASS = 1500
WINDOW = 32
STRIDE = 24
SEGMENT = 64
CONTEXT = 8
WORD_BUCKETS = 1 << 14
CHAR_BUCKETS = 1 << 12
WIDTH = 12
HIDDEN = 8
ROUNDS = 5
THRESHOLD = 0.7
CACHE_WORDS = 400_000
#: Training windows, and segments of text, that pass through the network together.
CHUNK = 2048
WORDS = re.compile(r"\w+")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def hashed(word: str) -> tuple[int, list[int]]:
    """Bucket of the word and buckets of its character trigrams."""
    marked = f"^{word}$".encode("utf-8", "surrogatepass")
    return zlib.crc32(marked) % WORD_BUCKETS, [zlib.crc32(marked[k : k + 3], 7) % CHAR_BUCKETS for k in range(max(1, len(marked) - 2))]


class Network:
    """Parameters, forward and backward pass; all arrays are float32."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.3 / np.sqrt(shape[0] if len(shape) > 1 else 1)).astype(np.float32)
        self.p = {"word": (rng.standard_normal((WORD_BUCKETS, WIDTH)) * 0.05).astype(np.float32), "char": (rng.standard_normal((CHAR_BUCKETS, WIDTH)) * 0.05).astype(np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": draw(WIDTH, 3 * HIDDEN), f"u{d}": draw(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"a": draw(2 * HIDDEN, HIDDEN), "v": draw(HIDDEN, 1)[:, 0], "o": draw(2 * HIDDEN, 1)[:, 0], "q": np.array([-1.0], np.float32)}
        self.m1, self.m2, self.step = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0

    def vectors(self, words: list[str]) -> np.ndarray:
        """Input vectors of distinct words."""
        grams = [hashed(w) for w in words]
        lengths = np.array([len(g[1]) for g in grams])
        flat = np.fromiter((i for g in grams for i in g[1]), np.int64, int(lengths.sum()))
        chars = np.add.reduceat(self.p["char"][flat], np.concatenate([[0], np.cumsum(lengths)[:-1]]), axis=0) / lengths[:, None]
        return (self.p["word"][[g[0] for g in grams]] + chars).astype(np.float32)

    def _run(self, gates: np.ndarray, mask: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """States (steps, windows, hidden) of one direction from the inputs' gate sums (steps, windows, 3 x hidden)."""
        steps, n, H = len(gates), gates.shape[1], HIDDEN
        u, h, out = self.p[f"u{d}"], np.zeros((n, H), np.float32), np.zeros((steps, n, H), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            hu = h @ u
            zr = _sigmoid(gates[t, :, : 2 * H] + hu[:, : 2 * H])
            z, r = zr[:, :H], zr[:, H:]
            new = np.tanh(gates[t, :, 2 * H :] + r * hu[:, 2 * H :])
            m = mask[t][:, None]
            nxt = new + z * (h - new)
            nxt = h + m * (nxt - h)
            if keep is not None:
                keep.append((t, h, z, r, new, hu[:, 2 * H :], m))
            h = nxt
            out[t] = h
        return out

    def pool(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
        key = np.tanh(states @ self.p["a"])
        e = key @ self.p["v"] + (mask - 1) * 1e4
        w = np.exp(e - e.max(axis=0))
        w /= w.sum(axis=0)
        c = (w[:, :, None] * states).sum(axis=0)
        return _sigmoid(c @ self.p["o"] + self.p["q"][0]), c, w, key

    def score(self, gates_f: np.ndarray, gates_b: np.ndarray, mask: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Scores of windows from gate sums (steps, windows, 3 x hidden) of each direction; ``inside``: the window's own steps."""
        states = np.concatenate([self._run(gates_f, mask, "f", None), self._run(gates_b, mask, "b", None)], axis=2)
        return self.pool(states, inside)[0]

    def sweep(self, gates: np.ndarray, first: np.ndarray, lengths: np.ndarray, d: str, out: np.ndarray, base: np.ndarray) -> None:
        """One direction over segments from long to short: states of ``lengths`` words from gate row ``first`` go to ``out`` from ``base``.

        Only the segments that still have words take part in a step.
        """
        H, u = HIDDEN, self.p[f"u{d}"]
        h = np.zeros((len(first), H), np.float32)
        active = len(first) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")
        for t, n in enumerate(active.tolist()):
            at = t if d == "f" else lengths[:n] - 1 - t
            x = gates[first[:n] + at]
            hu = h[:n] @ u
            zr = _sigmoid(x[:, : 2 * H] + hu[:, : 2 * H])
            new = np.tanh(x[:, 2 * H :] + zr[:, H:] * hu[:, 2 * H :])
            h = new + zr[:, :H] * (h[:n] - new)
            out[base[:n] + at] = h

    def learn(self, vectors_of: list, ids: np.ndarray, mask: np.ndarray, inside: np.ndarray, y: np.ndarray, rate: float) -> float:
        """One step of Adam on windows ids (windows, steps) of distinct words ``vectors_of`` (word bucket, trigram buckets)."""
        p, H = self.p, HIDDEN
        wb = np.array([g[0] for g in vectors_of])
        lengths = np.array([len(g[1]) for g in vectors_of])
        flat = np.fromiter((i for g in vectors_of for i in g[1]), np.int64, int(lengths.sum()))
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        table_ = (p["word"][wb] + np.add.reduceat(p["char"][flat], first, axis=0) / lengths[:, None]).astype(np.float32)
        x, mask = table_[ids.T], mask.T
        kept: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([self._run(x @ p[f"x{d}"] + p[f"c{d}"], mask, d, kept[d]) for d in "fb"], axis=2)
        s, c, w, key = self.pool(states, inside.T)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        ds = (s - y) / len(y)
        g["o"], g["q"] = c.T @ ds, np.array([ds.sum()], np.float32)
        dc = ds[:, None] * p["o"]
        dstates = w[:, :, None] * dc
        dw = (states * dc).sum(axis=2)
        de = w * (dw - (w * dw).sum(axis=0))
        g["v"] = np.einsum("tnk,tn->k", key, de)
        dkey = de[:, :, None] * p["v"] * (1 - key * key)
        g["a"] = np.einsum("tni,tnk->ik", states, dkey)
        dstates = dstates + dkey @ p["a"].T
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            u, dh, own = p[f"u{d}"], np.zeros((x.shape[1], H), np.float32), dstates[:, :, k * H : (k + 1) * H]
            for t, h, z, r, new, hn, m in reversed(kept[d]):
                dh = dh + own[t]
                dnxt, dh_prev = dh * m, dh * (1 - m)
                dz = dnxt * (h - new)
                dnew = dnxt * (1 - z)
                dh_prev = dh_prev + dnxt * z
                dpre = dnew * (1 - new * new)
                gate = np.concatenate([dz * z * (1 - z), dpre * hn * r * (1 - r), dpre], axis=1)
                hu = np.concatenate([gate[:, : 2 * H], dpre * r], axis=1)
                g[f"u{d}"] += h.T @ hu
                g[f"x{d}"] += x[t].T @ gate
                g[f"c{d}"] += gate.sum(axis=0)
                dx[t] += gate @ p[f"x{d}"].T
                dh = dh_prev + hu @ u.T
        per_word = np.zeros((len(wb), WIDTH), np.float32)
        np.add.at(per_word, ids.T.ravel(), dx.reshape(-1, WIDTH))
        np.add.at(g["word"], wb, per_word)
        np.add.at(g["char"], flat, np.repeat(per_word / lengths[:, None], lengths, axis=0))
        self.step += 1
        for k in p:
            self.m1[k] += 0.1 * (g[k] - self.m1[k])
            self.m2[k] += 0.001 * (g[k] * g[k] - self.m2[k])
            p[k] -= (rate * (self.m1[k] / (1 - 0.9**self.step)) / (np.sqrt(self.m2[k] / (1 - 0.999**self.step)) + 1e-8)).astype(np.float32)
        return float(-(y * np.log(s + 1e-7) + (1 - y) * np.log(1 - s + 1e-7)).mean())


def windows(lengths: np.ndarray, stride: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, words) of every window over documents with so many words."""
    count = np.where(lengths > 0, np.maximum(0, -(-(lengths - WINDOW) // stride)) + 1, 0)
    doc = np.repeat(np.arange(len(lengths)), count)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * stride
    return doc, start, np.minimum(WINDOW, lengths[doc] - start)


def segments(lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, first own word, own words, first word run, words run) of every segment."""
    count = -(-lengths // SEGMENT)
    doc = np.repeat(np.arange(len(lengths)), count)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * SEGMENT
    own = np.minimum(SEGMENT, lengths[doc] - start)
    lo = np.maximum(start - CONTEXT, 0)
    return doc, start, own, lo, np.minimum(start + own + CONTEXT, lengths[doc]) - lo


class Scorer:
    """Scores whole texts with a fitted network; remembers the gate sums of words."""

    def __init__(self, network: Network, limit: int = CACHE_WORDS):
        self.network, self.limit, self.places = network, limit, {}
        self.gates = np.zeros((1024, 6 * HIDDEN), np.float32)

    def ids(self, words: list[str]) -> np.ndarray:
        places = self.places
        new = list(set(words).difference(places))
        if new:
            if len(places) + len(new) > self.limit and places:
                places.clear()
                new = list(set(words))
            need = len(places) + len(new)
            if need > len(self.gates):
                grown = np.zeros((max(need, 2 * len(self.gates)), self.gates.shape[1]), np.float32)
                grown[: len(self.gates)] = self.gates
                self.gates = grown
            p, v = self.network.p, self.network.vectors(new)
            self.gates[need - len(new) : need] = np.concatenate([v @ p["xf"] + p["cf"], v @ p["xb"] + p["cb"]], axis=1)
            places.update(zip(new, range(need - len(new), need)))
        return np.fromiter(map(places.__getitem__, words), np.int64, len(words))

    def states(self, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """States (words, 2 x hidden) of the words ``flat`` of documents with so many words."""
        out = np.zeros((len(flat), 2 * HIDDEN), np.float32)
        doc, start, own, lo, n = segments(lengths)
        origin = (np.cumsum(lengths) - lengths)[doc]
        order = np.argsort(-n, kind="stable")
        for at in range(0, len(order), CHUNK):
            k = order[at : at + CHUNK]
            run = n[k]
            base = np.cumsum(run) - run
            gates = self.gates[flat[np.repeat(origin[k] + lo[k] - base, run) + np.arange(run.sum())]]
            for d, side in enumerate("fb"):
                got = np.zeros((len(gates), HIDDEN), np.float32)
                self.network.sweep(gates[:, 3 * HIDDEN * d : 3 * HIDDEN * (d + 1)], base, run, side, got, base)
                mine = np.arange(own[k].sum()) - np.repeat(np.cumsum(own[k]) - own[k], own[k])
                out[mine + np.repeat(origin[k] + start[k], own[k]), HIDDEN * d : HIDDEN * (d + 1)] = got[mine + np.repeat(base + start[k] - lo[k], own[k])]
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        """The highest window score of each text; 0 without words."""
        words = [WORDS.findall(t.lower()) for t in texts]
        lengths = np.array([len(w) for w in words], np.int64)
        out = np.zeros(len(texts))
        if not lengths.sum():
            return out
        flat = self.ids([x for w in words for x in w])
        states, p = self.states(flat, lengths), self.network.p
        weight = np.exp((np.tanh(states @ p["a"]) @ p["v"]).astype(np.float64))
        sums = np.zeros((2, len(flat) + 1))
        np.cumsum(weight, out=sums[0, 1:])
        np.cumsum(weight * (states @ p["o"]), out=sums[1, 1:])
        doc, start, n = windows(lengths)
        at = (np.cumsum(lengths) - lengths)[doc] + start
        low, high = sums[:, at], sums[:, at + n]
        np.maximum.at(out, doc, _sigmoid((high[1] - low[1]) / (high[0] - low[0]) + p["q"][0]))
        return out


def fit(texts: list[str], labels: list[int], *, rounds: int = ROUNDS, seed: int = 1) -> Network:
    """A network from labelled texts; with one class only, its scores stay near that class's share."""
    rng, net = np.random.default_rng(seed), Network(seed)
    words = [WORDS.findall((t or "").lower()) for t in texts]
    keep = [k for k, w in enumerate(words) if w]
    words, y = [words[k] for k in keep], np.array([labels[k] for k in keep], np.float32)
    if not words:
        return net
    known = {w: k for k, w in enumerate(dict.fromkeys(x for w in words for x in w))}
    grams = [hashed(w) for w in known]
    # One input dimension starts as the log-odds of the word's bucket over documents.
    seen = np.ones((2, WORD_BUCKETS))
    for w, label in zip(words, y):
        seen[int(label)][list({grams[known[x]][0] for x in w})] += 1
    odds = np.log(seen[1] / (y.sum() + 2)) - np.log(seen[0] / (len(y) - y.sum() + 2))
    net.p["word"][:, 0] = np.clip(odds / 3, -1, 1) * (np.abs(odds) > 1)
    lengths = np.array([len(w) for w in words], np.int64)
    flat = np.fromiter((known[x] for w in words for x in w), np.int64, int(lengths.sum()))
    doc, start, n = windows(lengths, STRIDE)
    at = (np.cumsum(lengths) - lengths)[doc] + start
    before = np.minimum(start, CONTEXT)
    after = np.minimum(lengths[doc] - start - n, CONTEXT)
    steps = np.arange(WINDOW)
    for turn in range(rounds):
        if turn:
            scores = np.concatenate([_scores(net, grams, flat, *(v[i : i + CHUNK] for v in (at, n, before, after))) for i in range(0, len(at), CHUNK)])
        else:
            scores = odds[np.array([g[0] for g in grams])[flat[np.minimum(at[:, None] + steps, len(flat) - 1)]]].max(axis=1)
        order = np.lexsort((-scores, doc))
        top = order[np.concatenate([[True], doc[order][1:] != doc[order][:-1]])]
        clean = np.flatnonzero(y[doc] == 0)
        chosen = np.concatenate([top, rng.choice(clean, min(len(clean), len(top)), replace=False) if len(clean) else clean])
        for _ in range(2):
            rng.shuffle(chosen)
            for i in range(0, len(chosen), 128):
                w = chosen[i : i + 128]
                ids, mask, inside = _windows_of(flat, at[w], n[w], before[w], after[w])
                distinct, local = np.unique(ids, return_inverse=True)
                net.learn([grams[k] for k in distinct], local.reshape(ids.shape), mask, inside, y[doc[w]], 0.01 if turn < rounds - 2 else 0.003)
    return net


def _windows_of(flat: np.ndarray, at: np.ndarray, n: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, ...]:
    """ids, mask and inside (windows, steps) of windows with the words around them."""
    steps = np.arange(WINDOW + 2 * CONTEXT)
    ids = flat[np.minimum((at - before)[:, None] + steps, len(flat) - 1)]
    mask = steps < (before + n + after)[:, None]
    inside = (steps >= before[:, None]) & (steps < (before + n)[:, None])
    return ids, mask.astype(np.float32), inside.astype(np.float32)


def _scores(net: Network, grams: list, flat: np.ndarray, at: np.ndarray, n: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    ids, mask, inside = _windows_of(flat, at, n, before, after)
    distinct, local = np.unique(ids, return_inverse=True)
    p = net.p
    lengths = np.array([len(grams[k][1]) for k in distinct])
    chars = np.fromiter((i for k in distinct for i in grams[k][1]), np.int64, int(lengths.sum()))
    v = p["word"][[grams[k][0] for k in distinct]] + np.add.reduceat(p["char"][chars], np.concatenate([[0], np.cumsum(lengths)[:-1]]), axis=0) / lengths[:, None]
    x = v.astype(np.float32)[local.reshape(ids.shape).T]
    return net.score(x @ p["xf"] + p["cf"], x @ p["xb"] + p["cb"], mask.T, inside.T)


def training_sample(docs: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS) -> tuple[list[str], list[int]]:
    """Texts and labels of at most ``per_class`` labelled rows of each class.

    Repeated ids, in either table, teach once: by the least text and the greatest label.
    """
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = usable.filter("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).union(usable.filter("toxic = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class))
    # At most 2 x per_class rows of 12 bytes are broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    return [r["text"] or "" for r in rows], [r["toxic"] for r in rows]


def score_toxicity(docs: DataFrame, network: Network, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (0 to 1), predicted (score >= threshold) for every row.

    Null, empty and wordless texts score 0; repeated rows score alike; other
    columns are not read; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Scorer(network))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                scores = scorer.score([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    network = fit(*training_sample(docs, table(spark, sf_dir, "labels").filter(fold("doc_id", 3) != 1)))
    return score_toxicity(docs, network).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
