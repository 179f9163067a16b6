"""Reports on texts, pairs and sources, and the witnesses, against literal expectations."""

import pytest
from pyspark.sql import functions as F

from textfacts import plans
from textfacts.functions import columns as C
from textfacts.functions import reports as Q
from textfacts.functions import unicode_data as U
from textfacts.functions.kernels import TextFactError


@pytest.fixture(scope="module")
def tables(spark):
    return U.report_tables(spark)


def test_coordinate():
    assert Q.coordinate("a\U0001f642b", 3)["code_point"] == 2
    for bad in (2, 5, -1):
        with pytest.raises(TextFactError, match="INVALID_SPAN"):
            Q.coordinate("a\U0001f642b", bad)


def test_identifier_profiles(tables):
    assert Q.identifier_profile("hello_1", "uax31_xid", tables)["conforms"]
    fold = Q.identifier_profile("Straße", "uax31_nfkc_casefold", tables)
    assert fold["transformed"] == "strasse" and fold["changed"] and fold["conforms"]
    assert Q.identifier_profile("", "uax31_xid", tables)["syntax_failures"] == [{"index_utf16": 0, "index_code_point": 0, "label": None, "required": "XID_Start"}]
    bad = Q.identifier_profile("\U0001f642a-", "uts39_general_security", tables)
    assert [(f["index_utf16"], f["required"]) for f in bad["syntax_failures"]] == [(0, "XID_Start"), (3, "XID_Continue")]
    assert [f["label"] for f in bad["restricted"]] == ["U+1F642"] and bad["restriction_level"] == "unrestricted"  # the hyphen is Inclusion
    assert Q.identifier_profile("a1١", "uax31_xid", tables)["decimal_systems"] == ["U+0030", "U+0660"]


def test_observations(tables):
    got = Q.security("a\u202e\u017f", "identifier", "uax31_xid", 2, tables)
    assert (got["code_points"], got["bidi_controls"], got["format_characters"], got["characters_truncated"]) == (3, 1, 1, True)
    assert got["status_allowed"] == 1 and sum(t["n"] for t in got["type_counts"] if t["type"] == "Recommended") == 1
    assert [c["signals"] for c in got["characters"]] == [[], ["bidi_control", "default_ignorable", "format_character"]]
    assert got["characters"][0]["identifier_types"] == ["Recommended"] and got["characters"][0]["bidi_class"] == "L"
    assert "profile" not in Q.security("a", "free_text", None, 0, tables)
    for arguments in (("free_text", "uax31_xid"), ("identifier", None), ("other", None)):
        with pytest.raises(TextFactError, match="INVALID_INPUT"):
            Q.security("a", *arguments, 1, tables)


@pytest.mark.parametrize(
    "a,b,direction,relation,kind",
    [("pаypаl", "paypal", "LTR", "confusable", "mixed_script"), ("\u261d", "\u261d\ufe0f", "LTR", "confusable", "mixed_script"), ("same", "same", "FS", "identical", None), ("abc", "abd", "RTL", "not_confusable", None), ("A1<\u05e9\u05c2", "\u0391\u05e9\u05ba>1", "LTR", "confusable", "mixed_script")],
)
def test_comparison(tables, a, b, direction, relation, kind):
    got = Q.comparison(a, b, direction, tables)
    assert (got["relation"], got["uts39_confusable"]) == (relation, relation != "not_confusable")
    assert got["class"] == kind or a.startswith("A1")


def test_difference(tables):
    a, b = "A\u00e9\U0001f642Z", "Axe\u0301\U0001f642Y"
    got = Q.difference(a, b, 64, True, "LTR", tables)
    fields = ("kind", "left_start", "left_end", "right_start", "right_end")
    assert [tuple(s[f] for f in fields) for s in got["code_point_alignment"]["segments"]] == [("equal", 0, 1, 0, 1), ("replace", 1, 2, 1, 4), ("equal", 2, 3, 4, 5), ("replace", 3, 4, 5, 6)]
    assert [tuple(s[f] for f in fields) for s in got["grapheme_alignment"]["segments"]] == [("equal", 0, 1, 0, 1), ("replace", 1, 2, 1, 3), ("equal", 2, 3, 3, 4), ("replace", 3, 4, 4, 5)]
    assert [got["code_point_alignment"][k] for k in ("matched", "inserted", "deleted", "changes")] == [2, 4, 2, 2]
    last = got["grapheme_alignment"]["segments"][-1]
    assert (last["left_from"]["utf16"], last["left_to"]["utf16"], last["right_from"]["utf16"]) == (4, 5, 6)
    first = got["first_code_point"]
    assert (first["index"], first["left"], first["right"], first["left_at"]["utf8"]) == (1, "é", "x", 1)
    ended = Q.difference("a", "ab", 64, False, None, None)
    assert ended["first_grapheme"]["left"] is None and ended["first_grapheme"]["left_at"]["code_point"] == 1 and "segments" not in ended["grapheme_alignment"]
    same = Q.difference("\u00e9", "e\u0301", 64, False, None, None)
    assert same["nfc"]["equal"] and same["nfc"]["right_changed"] and not same["nfc"]["left_changed"] and same["first_code_point"]["index"] == 0
    assert Q.difference("x\r\ny", "x\r\ny", 64, False, None, None)["first_code_point"] is None
    hidden = Q.invisible("a\u200bb\u200b", 2)
    assert hidden["default_ignorables"] == 2 and len(hidden["items"]) == 1 and hidden["truncated"]


def test_segment_digest_parts_fields_by_zeros():
    import hashlib

    want = hashlib.sha256(b"s\x00code_point\x00equal\x000\x001\x000\x001").hexdigest()
    assert Q.segment_digest("code_point", [("equal", 0, 1, 0, 1)], "s") == want


def test_source(tables):
    text = "let pаypаl = paypal;\rnext\u202e"
    spans = [{"kind": "identifier", "start_utf16": 4, "end_utf16": 10, "scope": "file"}, {"kind": "identifier", "start_utf16": 13, "end_utf16": 19, "scope": "file"}, {"kind": "token", "start_utf16": 0, "end_utf16": len(text)}]
    got = Q.source(text, spans, "LTR", 64, tables)
    assert (got["confusable_pairs"], got["abnormal_line_ending_count"], got["hidden_count"]) == (1, 1, 1) and got["hidden"][0]["spans"] == [2]
    wide = [{"kind": "identifier", "start_utf16": k, "end_utf16": k + 1, "scope": s} for k, s in ((0, "a"), (2, "a"))]
    assert Q.source("A Ａ", wide, "LTR", 64, tables)["confusable_pairs"] == 1
    wide[1]["scope"] = "b"
    assert Q.source("A Ａ", wide, "LTR", 64, tables)["confusable_pairs"] == 0
    for bad, code in (({"kind": "token", "start_utf16": 1, "end_utf16": 2}, "INVALID_SPAN"), ({"kind": "token", "start_utf16": 0, "end_utf16": 0}, "INVALID_SPAN"), ({"kind": "token", "start_utf16": 0, "end_utf16": 9}, "INVALID_INPUT"), ({"kind": "identifier", "start_utf16": 0, "end_utf16": 2, "scope": ""}, "INVALID_INPUT")):
        with pytest.raises(TextFactError, match=code):
            Q.source("\U0001f600", [bad], "LTR", 64, tables)


def test_pairs_are_counted_as_brute_force_does(tables):
    text = "A Ａ A А B Ａ"
    spans = [{"kind": "identifier", "start_utf16": k, "end_utf16": k + 1, "scope": "s"} for k in range(0, len(text), 2)]
    shown = [text[k] for k in range(0, len(text), 2)]
    look = lambda x, y: x != y and Q.comparison(x, y, "LTR", tables)["uts39_confusable"]
    want = sum(look(x, y) for k, x in enumerate(shown) for y in shown[k + 1 :])
    assert Q.source(text, spans, "LTR", 64, tables)["confusable_pairs"] == want > 0


def test_witnesses():
    w = Q.transcode_witness(bytes.fromhex("61E1804180"), "utf-8", "utf-8", True)
    assert [(s["source_start"], s["source_end"], s["target_start"], s["target_end"]) for s in w["segments"] if s["kind"] == "replacement"] == [(1, 3, 1, 4), (4, 5, 5, 8)]
    assert Q.transcode_witness("�".encode(), "utf-8", "utf-16le", False)["replacement_count"] == 0
    assert Q.transcode_witness(b"\xff\xfeA\x00", "utf-16le", "utf-8", False)["bom_handling"] == "preserved_as_character"
    p = Q.precis_witness("Ｕser", "precis_username_case_mapped")
    assert p["output"] == "user" and p["stabilized_after_pass"] == 2 and [s["output"] for s in p["passes"][0]["steps"]] == ["User", "user", "user"]
    assert Q.precis_witness("user", "precis_username_case_mapped")["pass_count"] == 1
    u = Q.uts46_witness("faß.de", "to_ascii")
    assert (u["output"], u["input_ascii"], u["output_ascii"], u["changed"]) == ("xn--fa-hia.de", False, True, True)


def test_locales(spark):
    assert [Q.locale_tag(x) for x in ("EN", "zh-hant-tw", "es-419")] == ["en", "zh-Hant-TW", "es-419"]
    for bad in ("not_a_locale", "e", "en-", "en-US-x"):
        with pytest.raises(TextFactError, match="INVALID_LOCALE"):
            C.collated("a", bad)
    r = spark.createDataFrame([("A", "a")], "a string, b string").select(C.compare("a", "b", "en-US", "base").alias("r")).first()["r"]
    assert r["collates_equal"]


def test_columns(spark):
    df = spark.createDataFrame([("pаypаl", "paypal", [("identifier", 0, 6, "f")]), (None, None, None), ("\U0001f600", "x", [("token", 1, 2, None)])], "a string, b string, s array<struct<kind:string,start_utf16:int,end_utf16:int,scope:string>>")
    run = lambda op, *c, **o: [r["result"] for r in plans.apply(op, df, *c, **o).collect()]
    pair = run("security_pair", "a", "b", profile="uts39_general_security", direction="LTR")
    assert pair[0]["comparison"]["class"] == "mixed_script" and pair[0]["profile"]["conforms"] and pair[1]["mode"] is None
    assert run("security", "a")[0]["script_resolution"] == "empty"
    assert [r["error"] and r["error"]["code"] for r in run("security_source", "a", "s", direction="LTR")] == [None, None, "INVALID_SPAN"]
    diff = run("explain_difference", "a", "b", direction="LTR", witness=True)
    assert diff[0]["confusable"]["relation"] == "confusable" and len(diff[0]["grapheme_alignment"]["segments"]) == 5
    assert run("protocol_profile", "b", profile="precis_username_case_mapped", witness=True)[0]["pass_count"] == 1
    at = df.select(C.coordinate("a", F.lit(1)).alias("r")).collect()
    assert at[0]["r"]["at"]["utf8"] == 1 and at[2]["r"]["error"]["code"] == "INVALID_SPAN"
    for bad in ({"mode": "identifier"}, {"profile": "uax31_xid"}):
        with pytest.raises(TextFactError, match="INVALID_INPUT"):
            plans.build("security", "a", **bad)
    with pytest.raises(TextFactError, match="INVALID_INPUT"):
        plans.build("security_source", "a", "s")


def test_parts_of_a_difference(spark):
    pair = spark.createDataFrame([("aéx", "aé‮y")], "a string, b string")
    whole = pair.select(C.difference_report("a", "b").alias("r")).first()["r"].asDict()
    names = ["exact", "nfc", "first_code_point", "right_invisible", "code_point_alignment"]
    some = pair.select(C.difference_report("a", "b", parts=names).alias("r")).first()["r"].asDict()
    assert set(some) == {*names, "error"} and all(some[n] == whole[n] for n in some)
    with pytest.raises(TextFactError):
        C.difference_report("a", "b", parts=["guess"])


def test_witness_in_parts_of_a_batch(spark, monkeypatch):
    """Segments as arrays are those of one character after another, however a batch is cut."""
    raws = [b"", b"\xffa", None, "é\U0001f642�".encode() + b"\xe2\x82", b"\xff\xfe\xef\xbf\xbd\xc3", b"x" * 40]
    monkeypatch.setattr(C, "WITNESS_BYTES", 8)
    rows = spark.createDataFrame([(k, bytearray(r) if r is not None else None) for k, r in enumerate(raws)], "k int, raw binary").coalesce(1)
    for source, target in (("utf-8", "utf-16le"), ("utf-16le", "utf-8"), ("utf-8", "utf-8")):
        got = {r["k"]: r["r"] for r in rows.select("k", C.transcode_witness("raw", source, target, True).alias("r")).collect()}
        for k, raw in enumerate(raws):
            if raw is None:
                assert got[k]["segments"] is None and got[k]["segment_count"] is None
                continue
            want = Q.K.transcode(raw, source, target, True)
            ends, at, unit, out, segments = dict(want["replacements"]), 0, 0, 0, []
            for c in want["text"]:
                bad = c == "�" and at in ends
                to, u, t = ends[at] if bad else at + len(c.encode(source)), unit + 1 + (c > "￿"), out + len(c.encode(target))
                segments.append(("replacement" if bad else "scalar", f"U+{ord(c):04X}", at, to, unit, u, out, t))
                at, unit, out = to, u, t
            assert [tuple(x) for x in got[k]["segments"]] == segments and got[k]["segment_count"] == len(segments)
    failed = rows.select("k", C.transcode_witness("raw", "utf-8", "utf-8").alias("r")).filter("k = 1").first()["r"]
    assert failed["error"]["code"] == "DECODE_FAILED" and failed["segments"] is None


def test_witness_batches_are_bounded(spark):
    """Ten thousand texts of one batch leave in pieces, not as one array of all their segments."""
    import pyarrow as pa

    run = C._witness_run(C._schema(C._WITNESS), "utf-8", "utf-8", True)
    pieces = list(run(iter([pa.array([b"a" * 1000] * 2000)])))
    assert sum(map(len, pieces)) == 2000 and max(p.nbytes for p in pieces) < 100 * C.WITNESS_BYTES
