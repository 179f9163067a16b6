"""Quality measures against plain Python, verdicts on planted outliers."""

import random
import re
from collections import Counter

from textfacts.llm.quality import CARRY, keep_quality, quality_verdicts


def base(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    count = Counter(windows)
    covered = {k + i for k, w in enumerate(windows) if count[w] > 1 for i in range(5)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def corpus():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 7)))
    clean = [" ".join(word() for _ in range(60)) for _ in range(120)]
    odd = [None, "", "   \n\t", "one", "a b c d e a b c d e", "x " * 3000, "l\nl\n\n l\nl", "a\x0bb\x0cc\rd\te\x1cf g", "# * $ % & | < >", "\n".join(["same line here"] * 30), "tab\there\n" * 5]
    junk = [" ".join(word() + "***" for _ in range(60)) for _ in range(4)]
    rows = [(k, t, "en" if k % 2 else None, "s", "clash", "clash") for k, t in enumerate(clean + odd + junk)]
    return [*rows, rows[0], (None, clean[0], "en", "tiny", "c", "c")], len(clean), len(odd)


def test_measures_and_verdicts(spark):
    rows, n_clean, n_odd = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words string, kept string")
    got = quality_verdicts(docs).collect()
    assert len(got) == len(rows)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for r in got:
        m = r[CARRY]
        want = base(r["text"])
        assert tuple(m[k] for k in names) == want
        assert m["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert r["n_words"] in ("clash", "c")
        if r["doc_id"] is None or r["doc_id"] < n_clean:
            assert m["kept"]
        if r["doc_id"] is not None and r["doc_id"] >= n_clean + n_odd:
            assert not m["kept"] and not m["base_failed"]


def test_names_that_clash(spark):
    """A column named like the added struct, or like its parts, is kept as it is."""
    rows, _, _ = corpus()
    docs = spark.createDataFrame([(r[0], r[1], r[2], r[3], "mine", "limit", "odd") for r in rows], f"doc_id long, text string, lang string, source string, {CARRY} string, __limit_lang string, `a.b` string").drop("a.b")
    plain = quality_verdicts(docs.select("doc_id", "text", "lang", "source"))
    got = quality_verdicts(docs)
    assert got.columns[:-1] == docs.columns and got.columns[-1] not in docs.columns
    key = lambda r: str((r[0], r[1], r[2]))
    assert sorted((key(r), r[-1].kept) for r in got.collect()) == sorted((key(r), r[-1].kept) for r in plain.collect())
    stays = keep_quality(docs)
    assert stays.columns == docs.columns and stays.count() == plain.filter(f"{CARRY}.kept").count()


def test_empty(spark):
    assert quality_verdicts(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0
