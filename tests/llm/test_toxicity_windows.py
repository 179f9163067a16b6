"""Every window of a text is scored."""

import numpy as np

from textfacts.llm import toxicity as X


def test_a_window_starts_at_every_word():
    doc, start, n = X.windows(np.array([0, 5, X.WINDOW, X.WINDOW + 9]))
    assert doc.tolist() == [1, 2, *[3] * 10] and start.tolist() == [0, 0, *range(10)]
    assert n.tolist() == [5, *[X.WINDOW] * 11]


def by_hand(net, words):
    """Every state step by step, every window on its own."""
    H, p, n = X.HIDDEN, net.p, len(words)
    sig = lambda x: 1 / (1 + np.exp(-x))
    x = [net.vectors([w])[0] for w in words]
    states = np.zeros((n, 2 * H))
    for start in range(0, n, X.SEGMENT):
        own = range(start, min(start + X.SEGMENT, n))
        run = range(max(0, start - X.CONTEXT), min(n, own[-1] + 1 + X.CONTEXT))
        for d, order in (("f", run), ("b", reversed(run))):
            h = np.zeros(H)
            for t in order:
                g, u = x[t] @ p[f"x{d}"] + p[f"c{d}"], h @ p[f"u{d}"]
                z, r = sig(g[:H] + u[:H]), sig(g[H : 2 * H] + u[H : 2 * H])
                new = np.tanh(g[2 * H :] + r * u[2 * H :])
                h = (1 - z) * new + z * h
                if t in own:
                    states[t, :H] = h if d == "f" else states[t, :H]
                    states[t, H:] = h if d == "b" else states[t, H:]
    best = 0.0
    for k in range(max(1, n - X.WINDOW + 1)):
        part = states[k : k + X.WINDOW]
        w = np.exp(np.tanh(part @ p["a"]) @ p["v"])
        best = max(best, sig((w / w.sum()) @ part @ p["o"] + p["q"][0]))
    return best


def test_score_is_that_of_the_best_window():
    rng = np.random.default_rng(2)
    net = X.Network(3)
    net.p["word"] = rng.standard_normal(net.p["word"].shape).astype(np.float32)
    texts = [[f"w{k}" for k in rng.integers(0, 50, n)] for n in (1, 5, X.WINDOW, X.WINDOW + 1, X.SEGMENT, X.SEGMENT + 1, 3 * X.SEGMENT + 7, 500)]
    got = X.Scorer(net).score(["", *map(" ".join, texts), "..."])
    assert got[0] == got[-1] == 0
    assert np.allclose(got[1:-1], [by_hand(net, t) for t in texts], atol=1e-5)
    # A text's score does not depend on the texts beside it.
    assert np.allclose(got[1:-1], [X.Scorer(net).score([" ".join(t)])[0] for t in texts], atol=1e-6)


def test_repeated_ids_teach_once(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, "c"), (None, "d"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (2, 0), (None, 1), (3, 0), (4, None)], "doc_id long, toxic int")
    assert sorted(zip(*X.training_sample(docs, labels))) == [("", 0), ("a", 1), ("c", 0)]
