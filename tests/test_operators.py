"""Namespace, source, record, plan, source and streaming operators on small rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from textfacts import plans
from textfacts.functions import columns as C
from textfacts.functions import kernels as K
from textfacts.functions import unicode_data as U
from textfacts.functions.kernels import TextFactError
from textfacts.operators import namespace as N
from textfacts.operators import records as R
from textfacts.operators import source as S
from textfacts.sources import parse_requests, tagged_text


def test_namespace(spark):
    items = spark.createDataFrame([("user-1", "paypal", "a"), ("user-2", "pаypal", "a"), ("user-3", "ＰａｙＰａｌ", "a"), ("user-4", "paypal", "b")], "id string, text string, scope string")
    relations = [N.Relation(k) for k in N.SIMPLE]
    rows = N.keyed(items, relations, tables=U.uts39_tables(spark), direction="LTR")
    found = N.groups(rows)
    member = {}
    for r in N.members(rows, found).collect():
        member.setdefault(r["relation"], set()).add(r["id"])
    assert member["nfkc_casefold"] == {"user-1", "user-3"} and {"user-1", "user-2"} <= member["uts39_confusable"]
    assert [r["id"] for r in N.isolated(items, N.members(rows, found)).collect()] == ["user-4"]
    with pytest.raises(TextFactError, match="INVALID_INPUT"):
        N.keyed(items, [])


def test_exact_groups_need_no_different_texts(spark):
    items = spark.createDataFrame([(1, "x", None), (2, "x", None)], "id long, text string, scope string")
    got = N.groups(N.keyed(items, [N.Relation("exact"), N.Relation("nfc")])).collect()
    assert [r["relation"] for r in got] == ["exact"] and got[0]["key_sha256"] == hashlib.sha256(b"x").hexdigest()


def test_source(spark):
    rows = spark.createDataFrame([(1, "file", "let pаypal = paypal;‮")], "source_id long, scope string, text string")
    ids = S.identifier_spans(rows, pattern=r"[\p{L}_][\p{L}\p{Nd}_]*")
    pairs = S.confusable_pairs(ids, U.uts39_tables(spark)).collect()
    assert [(r["left_text"], r["right_text"]) for r in pairs] == [("paypal", "pаypal")]
    assert S.confusable_classes(ids, U.uts39_tables(spark)).first()["pairs"] == 1
    hidden = S.hidden_characters(rows)
    assert [r["pos"] for r in hidden.collect()] == [20]
    spans = spark.createDataFrame([(1, 0, 20), (1, 20, 21)], "source_id long, start int, end int")
    assert S.hidden_in_spans(hidden, spans).count() == 1


def test_confusable_pairs_look_once(spark):
    text = "paypal pаypal раураӏ scope ѕсоре Scope אב בא"
    ids = S.identifier_spans(spark.createDataFrame([(1, "f", text), (1, "f", text), (2, "f", "paypal"), (3, "f", "pаypal"), (None, "f", text)], "source_id long, scope string, text string"), pattern=r"[\p{L}_]+")
    tables = U.uts39_tables(spark)
    pairs = S.confusable_pairs(ids, tables)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    key = {w: K.bidi_skeleton(w, tables["prototype"]) for w in text.split()}
    assert sorted(tuple(r) for r in pairs.collect()) == sorted((1, "f", a, b) for a in key for b in key if a < b and key[a] == key[b])
    assert plan.count("ArrowEvalPython") + plan.count("MapInArrow") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_skeletons_of_many_texts(spark):
    tables = U.uts39_tables(spark)
    U.use(tables)
    for direction in ("LTR", "RTL", "FS"):
        many = K.skeletons(tables["prototype"], direction)
        for t in ["", "paypal", "pаypal", "_1a", "אב(c)", "a\u200bm", "é1", "e\u0301\u0327", "x\u202ey", "paypal"]:
            assert many(t) == K.bidi_skeleton(t, tables["prototype"], direction)
        with pytest.raises(TextFactError):
            many("a\ud800")


def test_records(spark):
    assert R.canonical_json({"b": 1, "a": [True, None, "é"]}) == '{"a":[true,null,"é"],"b":1}'
    with pytest.raises(ValueError):
        R.canonical_json(float("nan"))
    with pytest.raises(ValueError):
        R.unique_keys('{"a":1,"a":2}')
    for n in range(1, 12):
        rows = spark.createDataFrame([("g", k, f"leaf{k}") for k in range(n)], "g string, o int, x string")
        assert R.merkle_roots(rows, "g", "o", "x").first()["root"] == R.merkle([f"leaf{k}".encode() for k in range(n)])
    # One group holds most rows; blocks of four leaves.
    rows = [("hot", k, f"leaf{k}") for k in range(61)] + [("b", k, None if k == 3 else "same") for k in range(9)] + [(None, 0, "x"), ("four", 0, "y")]
    got = {r["grp"]: (r["leaves"], r["root"]) for r in R.merkle_roots(spark.createDataFrame(rows, "g string, o int, x string"), "g", "o", "x", block_height=2).collect()}
    want = {g: [(x or "").encode() for h, _, x in rows if h == g] for g, _, _ in rows}
    assert got == {g: (len(v), R.merkle(v)) for g, v in want.items()}
    a, b = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id long, h string"), spark.createDataFrame([(2, "y"), (3, "q"), (4, "w")], "id long, h string")
    assert {r["id"]: r["change"] for r in R.compare_records(a, b, "id", ["h"]).collect()} == {1: "removed", 2: "same", 3: "h", 4: "added"}


def test_plans(spark):
    df = spark.createDataFrame([("é", "x"), ("a" * 5000, "y"), (None, "z")], "t string, k string")
    got = {r["k"]: r for r in plans.apply("normalize", df, "t", form="NFC", limits="strict").collect()}
    assert got["x"]["result"]["output"] == "é" and got["y"]["result_error"] == "REQUEST_TOO_LARGE" and got["y"]["result"]["output"] is None
    with pytest.raises(TextFactError, match="UNKNOWN_OPERATION"):
        plans.build("guess", "t")
    with pytest.raises(TextFactError, match="INVALID_INPUT"):
        plans.build("inspect", "t", other=1)
    assert plans.catalogue(spark).count() == 10 and "icu" in plans.identity(spark)
    plans.register(spark)
    assert spark.sql("SELECT tf_nfkc_casefold('Straße') AS x").first()["x"] == "strasse"
    assert [r["chunk"] for r in spark.sql("SELECT * FROM tf_chunks('abcdef', 4)").collect()] == ["abcd", "ef"]


def test_strict_limits(spark):
    df = spark.createDataFrame([("a" * 4096, 1), ("ab", 2), ("a" * 200, 3)], "t string, k int")
    got = {r["k"]: r for r in plans.apply("index", df, "t", max_chunk_bytes=1, limits="strict").collect()}
    assert got[3]["result"]["error"]["code"] == "TOO_MANY_CHUNKS" and got[2]["result"]["chunks"] == ["a", "b"]
    got = {r["k"]: r for r in plans.apply("index", df, "t", limits="strict").collect()}
    assert got[1]["result_error"] == "RESULT_TOO_LARGE" and got[1]["result"] is None and got[2]["result_error"] is None
    pair = spark.createDataFrame([("ab" * 32, "ac" * 32)], "a string, b string")
    assert plans.apply("explain_difference", pair, "a", "b", witness=True, limits="strict").first()["result_error"] == "RESULT_TOO_LARGE"
    assert plans.apply("explain_difference", pair, "a", "b", limits="strict").first()["result_error"] is None
    for bad in ({"detail_limit": 129}, {"detail_limit": -1}):
        with pytest.raises(TextFactError, match="INVALID_INPUT"):
            plans.apply("inspect", df, "t", limits="strict", **bad)


def test_errors_stay_in_their_row(spark):
    df = spark.createDataFrame([("a b",), ("user",)], "t string")
    got = df.select(C.protocol_profile("t", "precis_username_case_mapped").alias("r")).collect()
    assert [r["r"]["error"] and r["r"]["error"]["code"] for r in got] == ["PROTOCOL_STRING_INVALID", None]


def test_utf16_order_and_compare(spark):
    df = spark.createDataFrame([("",), ("\U00010000",)], "t string")
    assert [r["t"] for r in df.orderBy(C.utf16_order("t")).collect()] == ["\U00010000", ""]
    r = spark.createDataFrame([("A", "a")], "a string, b string").select(C.compare("a", "b", "en", "base").alias("r")).first()["r"]
    assert r["collates_equal"] and not r["code_unit_equal"]
    with pytest.raises(TextFactError, match="UNSUPPORTED_COLLATION_OPTION"):
        C.collated("a", "en", numeric=True)


def test_requests_and_units(spark):
    lines = spark.createDataFrame([('{"id":"1","operation":"inspect","arguments":{"text":"x"}}',), ("nonsense",), (None,)], "value string")
    assert [r["error"] for r in parse_requests(lines).collect()] == [None, "INVALID_INPUT", "INVALID_UNICODE"]
    tagged = spark.createDataFrame([(("utf16_code_units", None, [0xD800, 0x0301, 0xDC00]),)], "t struct<kind:string,value:string,units:array<int>>")
    r = tagged.select(C.inspect_units(tagged_text("t")[1]).alias("r")).first()["r"]
    assert not r["well_formed"] and r["graphemes"] == 2 and r["unpaired"] == 2


def test_inspect_and_index(spark):
    r = spark.createDataFrame([("éx",)], "t string").select(C.inspect("t").alias("r"), C.index("t", 4).alias("i")).first()
    assert (r["r"]["code_points"], r["r"]["graphemes"], r["r"]["utf8_hex"]) == (3, 2, "65cc8178") and r["i"]["chunks"] == ["éx"]
