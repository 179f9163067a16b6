"""Literal expectations of the text-fact kernels."""

import itertools
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textfacts.functions import kernels as K
from textfacts.functions import protocol as P
from textfacts.functions import unicode_data as U
from textfacts.functions.bidi import display_order

FAMILY = "\U0001f468‍\U0001f469‍\U0001f467‍\U0001f466"


def test_graphemes_and_chunks():
    assert K.graphemes("é" + FAMILY) == ["é", FAMILY]
    assert K.graphemes("क्ष") == ["क्ष"]
    assert K.chunk("A" + FAMILY + "\r\nB", 25) == ["A", FAMILY, "\r\nB"]
    with pytest.raises(K.TextFactError, match="CHUNK_GRAPHEME_TOO_LARGE"):
        K.chunk(FAMILY, 24)


def test_coordinates():
    end = K.coordinates("a\r\nb \U0001f642")[-1]
    assert (end["utf8"], end["utf16"], end["code_point"], end["grapheme"], end["line"], end["column_code_point"]) == (11, 7, 6, 5, 3, 1)
    assert K.coordinates("")[0]["line"] == 1


def test_normalisation():
    assert K.normalize("é", "NFC") == "é"
    w = K.normalization_witness("①À̕", "NFKC")
    assert w["output"] == "1À̕" and w["ordered"] == "1À̕" and w["reordered"] == 2
    assert w["compositions"] == [("A", "̀", "À", 1)]
    with pytest.raises(K.TextFactError, match="INVALID_UNICODE"):
        K.normalize("\ud800", "NFC")
    assert K.nfkc_casefold("Straße") == "strasse" and K.nfkc_casefold("Å") == "å" and K.nfkc_casefold("a­b") == "ab"
    assert [K.lowercase(t) for t in ("ΟΣ", "ΟΣΑ", "ÁΣ", "AΣ́A", "İ")] == ["ος", "οσα", "áς", "aσ́a", "i̇"]


def test_codecs():
    assert K.decode_utf8(bytes.fromhex("61E1804180")) == ("a�A�", [(1, 3), (4, 5)])
    assert K.decode_utf8(bytes.fromhex("61E228A1")) == ("a�(�", [(1, 2), (3, 4)])
    assert K.decode_utf16le(bytes.fromhex("30D8EF"))[1] == [(0, 3)]
    assert K.transcode("A\U0001f600".encode(), "utf-8", "utf-16le", False)["encoded"].hex() == "41003dd800de"
    with pytest.raises(K.TextFactError, match="DECODE_FAILED"):
        K.transcode(bytes.fromhex("61C328"), "utf-8", "utf-8", False)


@pytest.mark.parametrize("codec,name", [(K.decode_utf8, "utf-8"), (K.decode_utf16le, "utf-16-le")])
def test_codecs_on_all_short_inputs(codec, name):
    rng = random.Random(1)
    for data in [bytes([a, b]) for a in range(0, 256, 3) for b in range(0, 256, 5)] + [rng.randbytes(7) for _ in range(2000)]:
        assert codec(data)[0] == data.decode(name, "replace")


def brute_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_alignment():
    assert K.align(list("Aé\U0001f642Z"), list("Axé\U0001f642Y")) == [("equal", 0, 1, 0, 1), ("replace", 1, 2, 1, 4), ("equal", 2, 3, 4, 5), ("replace", 3, 4, 5, 6)]
    assert K.align(list("aa"), list("a")) == [("equal", 0, 1, 0, 1), ("delete", 1, 2, 1, 1)]


@settings(max_examples=150, deadline=None)
@given(st.text("abc", max_size=14), st.text("abc", max_size=14))
def test_alignment_is_longest_and_contiguous(a, b):
    segments = K.align(list(a), list(b))
    assert sum(e - s for k, s, e, _, _ in segments if k == "equal") == brute_lcs(a, b)
    i = j = 0
    for kind, s, e, p, q in segments:
        assert (s, p) == (i, j) and (kind != "equal" or a[s:e] == b[p:q])
        i, j = e, q
    assert (i, j) == (len(a), len(b))


def test_scripts_and_restriction():
    allowed = frozenset(c for c in map(chr, range(0x3000)) if c.isalnum())
    assert K.resolve_scripts("pаy") == ("empty", []) and K.resolve_scripts("12")[0] == "all"
    assert K.restriction_level("abc", allowed) == "ascii_only"
    assert K.restriction_level("аб", allowed) == "single_script"
    assert K.restriction_level("aб", allowed) == "minimally_restrictive"
    assert K.restriction_level("a b", allowed) == "unrestricted"
    assert K.xid_failures("hello_1") == [] and K.xid_failures("") == [(0, None)] and K.xid_failures("1a") == [(0, "U+0031")]
    assert K.mixed_numbers("1١") and not K.mixed_numbers("123")


def test_display_order():
    assert display_order("abc אבג", "LTR") == "abc גבא"
    assert display_order("א(1)", "FS") == "(1)א"
    assert display_order("aא<ב", "LTR") == "aב>א"


def test_confusables(spark):
    proto = U.uts39_tables(spark)["prototype"]
    got = K.confusable("pаypаl", "paypal", proto)
    assert got == {"relation": "confusable", "class": "mixed_script", "uts39Confusable": True}
    assert K.confusable("☝", "☝️", proto)["relation"] == "confusable"
    assert K.confusable("A1<שׂ", "Αשֺ>1", proto)["uts39Confusable"]
    assert K.confusable("same", "same", proto, "FS")["relation"] == "identical"


def test_precis():
    assert P.precis("Ｕser", "precis_username_case_mapped")[0] == "user"
    assert P.precis("ÁΣ", "precis_username_case_mapped")[0] == "áς"
    assert P.precis("A B", "precis_opaque_string")[0] == "A B" and P.precis("¹", "precis_opaque_string")[0] == "¹"
    for bad in ("a b", "﷐", "͸", "¹", "K", ""):
        with pytest.raises(K.TextFactError, match="PROTOCOL_STRING_INVALID"):
            P.precis(bad, "precis_username_case_mapped")


def test_domains():
    assert P.uts46("faß.de", "to_ascii") == "xn--fa-hia.de"
    assert P.uts46("xn--fa-hia.de", "to_unicode") == "faß.de"
    assert P.uts46("EXAMPLE.com", "to_ascii") == "example.com"
    assert P.uts46("fa\u00df.\u03bf\u03c2", "to_ascii", transitional=True) == "fass." + P.uts46("\u03bf\u03c3", "to_ascii")
    assert P.uts46("a\u200db.de", "to_ascii", transitional=True) == "ab.de"
    with pytest.raises(K.TextFactError, match="PROTOCOL_STRING_INVALID"):
        P.uts46("xn--0.de", "to_unicode")
    assert P.uts46("xn--0.de", "to_unicode", ignore_invalid_punycode=True) == "xn--0.de"
    with pytest.raises(K.TextFactError, match="INVALID_INPUT"):
        P.uts46("a.de", "to_ascii", guess=True)
    for bad in ("-bad", "a..b", "xn--a", "a" * 64):
        with pytest.raises(K.TextFactError):
            P.uts46(bad, "to_ascii")


@given(st.text(alphabet=st.one_of(st.sampled_from("ab\r\n é́‍\U0001f468\U0001f467؀กำ한가\U0001f1e9\U0001f1ea\xad\xa9"), st.characters(blacklist_categories=["Cs"])), max_size=30))
def test_grapheme_count_counts_graphemes(text):
    assert K.grapheme_count(text) == len(K.graphemes(text))


def _split(left, right, i0, i1, j0, j1):
    """The highest split at the middle of the left side, again and again; the first match of a single item."""
    if i1 - i0 < 2:
        return [(i0, j) for j in range(j0, j1) if i1 > i0 and left[i0] == right[j]][:1]

    def common(x, y):
        row = [0] * (len(y) + 1)
        for a in x:
            row = [0, *itertools.accumulate((max(row[j + 1], row[j] + (a == b)) for j, b in enumerate(y)), max)]
        return row[-1]

    mid = (i0 + i1) // 2
    cut = max(range(j0, j1 + 1), key=lambda j: (common(left[i0:mid], right[j0:j]) + common(left[mid:i1], right[j:j1]), j))
    return _split(left, right, i0, mid, j0, cut) + _split(left, right, mid, i1, cut, j1)


@pytest.mark.parametrize("kept_bits", [1 << 28, 40])
def test_align_takes_the_highest_splits(monkeypatch, kept_bits):
    monkeypatch.setattr(K, "KEPT_BITS", kept_bits)
    chance = random.Random(5)
    for _ in range(400):
        left, right = ("".join(chance.choices("abc", k=chance.randint(0, 9))) for _ in range(2))
        got = [(i + d, p + d) for kind, i, j, p, _ in K.align(left, right) if kind == "equal" for d in range(j - i)]
        assert got == _split(left, right, 0, len(left), 0, len(right)), (left, right)


def test_align_many_pairs_in_time():
    left = list("so that what which " * 28)
    right = list("so that w‮hat whích\r\n" * 28)
    began = time.process_time()
    for _ in range(200):
        K.align(left, right)
    assert time.process_time() - began < 3


def test_one_coordinate_as_in_all():
    chance = random.Random(6)
    for _ in range(500):
        text = "".join(chance.choices("ab\r\ńé \U0001f468‍\U0001f1e6", k=chance.randint(0, 8)))
        assert [K.coordinate(text, k) for k in range(len(text) + 1)] == K.coordinates(text)
