"""Queries over the driver's tables, with SQL for those that SQL can express.

The tables hold composed Latin letters only, so most queries first make hostile
variants with ``replace()``, alike in both engines.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .functions import columns as C
from .functions import unicode_data as U
from .operators import namespace as N
from .operators import records as R
from .operators import source as S
from .operators.counts import character_counts
from .sources.shared import shared_path, spread, written
from .streaming import read_table_stream, run_stream

_SWAPS = {
    "decomposed": [("é", "é"), ("ñ", "ñ")],
    "cyrillic": [("a", "а")],
    "emoji": [("z", "\U0001f642"), ("b", "\U0001f468‍\U0001f469‍\U0001f467")],
    "lines": [(". ", ".\r\n"), (", ", ", "), ("? ", "?\r")],
    "hidden": [("w", "w‮"), ("k", "k​")],
    "compat": [("fi", "ﬁ"), ("1", "①")],
}


def _variant(c: str, *kinds: str) -> Column:
    out = F.col(c)
    for kind in kinds:
        for a, b in _SWAPS[kind]:
            out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _sql(c: str, *kinds: str) -> str:
    for kind in kinds:
        for a, b in _SWAPS[kind]:
            codes = " || ".join(f"chr({ord(x)})" for x in b)
            c = f"replace({c}, '{a}', {codes})"
    return c


def _docs(spark: SparkSession, d: str, *kinds: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "source", _variant("text", *kinds).alias("t"))


def _wide(spark: SparkSession, d: str, *kinds: str) -> DataFrame:
    """The documents over all cores, for queries whose kernels take longer than moving the texts."""
    rows = spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "source", "text"))
    return rows.select("doc_id", "lang", "source", _variant("text", *kinds).alias("t"))


def _d(*kinds: str) -> str:
    return f"(SELECT doc_id, lang, source, {_sql('text', *kinds)} AS t FROM documents) d"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_COUNTS = "length(t) AS code_points, strlen(t) AS utf8_bytes, length(t) + length(regexp_replace(t, '[\\x{0}-\\x{FFFF}]', '', 'g')) AS utf16_units, sha256(t) AS sha256"


@_query(f"SELECT doc_id, {_COUNTS} FROM {_d('emoji', 'decomposed')}")
def inspect_counts(spark, d):
    return _docs(spark, d, "emoji", "decomposed").select("doc_id", C.inspect_counts("t").alias("r")).select("doc_id", "r.*")


def _n(x: str) -> str:
    return f"((strlen(t) - strlen(replace(t, {x}, ''))) // strlen({x}))"


_CRLF, _CR, _LF, _NEL, _LS, _PS = "chr(13) || chr(10)", "chr(13)", "chr(10)", "chr(133)", "chr(8232)", "chr(8233)"
_CRLF = f"({_CRLF})"


@_query(
    f"SELECT doc_id, {_n(_CRLF)} AS crlf, {_n(_LF)} - {_n(_CRLF)} AS lf, {_n(_CR)} - {_n(_CRLF)} AS cr, {_n(_NEL)} AS nel, {_n(_LS)} AS ls, {_n(_PS)} AS ps, "
    f"1 + {_n(_LF)} + {_n(_CR)} - {_n(_CRLF)} + {_n(_NEL)} + {_n(_LS)} + {_n(_PS)} AS lines FROM {_d('lines')}"
)
def line_endings(spark, d):
    return _docs(spark, d, "lines").select("doc_id", C.line_endings("t").alias("r")).select("doc_id", "r.*")


@_query(f"SELECT doc_id, lower(hex(encode(t))) AS utf8_hex FROM {_d('emoji')}")
def utf8_hex(spark, d):
    return _docs(spark, d, "emoji").select("doc_id", C.encoded("t", "utf-8", "hex").alias("utf8_hex"))


@_query(f"SELECT doc_id, base64(encode(t)) AS utf8_base64 FROM {_d('cyrillic')}")
def utf8_base64(spark, d):
    return _docs(spark, d, "cyrillic").select("doc_id", C.encoded("t", "utf-8", "base64").alias("utf8_base64"))


@_query(f"SELECT doc_id, length_grapheme(t) AS graphemes FROM {_d('emoji', 'decomposed')}")
def grapheme_count(spark, d):
    return _wide(spark, d, "emoji", "decomposed").select("doc_id", C.grapheme_count("t").alias("graphemes"))


@_query(f"SELECT doc_id, nfc_normalize(t) <> t AS changed, sha256(nfc_normalize(t)) AS nfc_sha256, strlen(nfc_normalize(t)) AS utf8_bytes FROM {_d('decomposed')}")
def normalize_nfc(spark, d):
    r = C.normalize("t", "NFC")
    return _wide(spark, d, "decomposed").select("doc_id", r.alias("r")).select("doc_id", "r.changed", C.digest("r.output").alias("nfc_sha256"), "r.utf8_bytes")


@_query(f"SELECT doc_id, sha256(replace(replace(t, chr(64257), 'fi'), chr(9312), '1')) AS nfkc_sha256 FROM {_d('compat')}")
def normalize_nfkc(spark, d):
    return _wide(spark, d, "compat").select("doc_id", C.digest(C.normalize("t", "NFKC")["output"]).alias("nfkc_sha256"))


@_query(f"SELECT doc_id, sha256(lower(replace(replace(replace(t, 'ß', 'ss'), chr(64257), 'fi'), chr(9312), '1'))) AS casefold_sha256 FROM {_d('compat')}")
def nfkc_casefold(spark, d):
    return _wide(spark, d, "compat").select("doc_id", C.digest(C.nfkc_casefold("t")).alias("casefold_sha256"))


@_query("SELECT doc_id, sha256(lower(text)) AS lower_sha256 FROM documents")
def lowercase(spark, d):
    return _wide(spark, d).select("doc_id", C.digest(C.lowercase("t")).alias("lower_sha256"))


@_query(f"SELECT doc_id, {_n('chr(8238)')} AS bidi_controls, {_n('chr(8203)')} + {_n('chr(8238)')} AS default_ignorables, {_n('chr(8203)')} + {_n('chr(8238)')} AS format_characters FROM {_d('hidden')}")
def signal_counts(spark, d):
    return _wide(spark, d, "hidden").select("doc_id", C.signal_counts("t").alias("r")).select("doc_id", "r.*")


@_query(f"SELECT ch AS character, printf('U+%04X', unicode(ch)) AS label, count(*) AS n FROM (SELECT unnest(string_split(t, '')) AS ch FROM {_d('emoji')}) WHERE ch <> '' GROUP BY ALL")
def code_point_histogram(spark, d):
    return character_counts(_wide(spark, d, "emoji"), "t").select("character", C.label("character").alias("label"), "n")


@_query(f"SELECT doc_id, 2 * (length(t) + length(regexp_replace(t, '[\\x{{0}}-\\x{{FFFF}}]', '', 'g'))) AS utf16_bytes, true AS round_trip FROM {_d('emoji')}")
def transcode_utf16(spark, d):
    r = C.transcode(F.col("t").cast("binary"), "utf-8", "utf-16le")
    return _wide(spark, d, "emoji").select("doc_id", r.alias("r")).select("doc_id", F.octet_length("r.encoded").cast("long").alias("utf16_bytes"), "r.round_trip")


@_query("SELECT doc_id, length(text) AS code_points, CASE WHEN strlen(text) > 0 THEN 1 ELSE 0 END AS replacements FROM documents")
def transcode_lossy(spark, d):
    """A byte that no text holds, before each text: one replacement, at its place."""
    raw = F.concat(F.unhex(F.lit("FF")), F.col("t").cast("binary"))
    rows = _wide(spark, d).select("doc_id", C.transcode(raw, "utf-8", "utf-16le", lossy=True).alias("r"))
    return rows.select("doc_id", (F.length("r.text") - 1).cast("long").alias("code_points"), F.when(F.length("r.text") > 1, F.size("r.replacements")).otherwise(0).alias("replacements"))


@_query("SELECT page_id, lower(regexp_extract(url, '//([^/?#]*)', 1)) AS to_ascii, false AS failed FROM pages")
def domain_to_ascii(spark, d):
    host = F.regexp_extract("url", "//([^/?#]*)", 1)
    rows = spark.read.parquet(f"{d}/pages.parquet").select("page_id", C.protocol_profile(host, "uts46", "to_ascii").alias("r"))
    return rows.select("page_id", F.col("r.output").alias("to_ascii"), F.col("r.error").isNotNull().alias("failed"))


@_query("SELECT c_custkey, lower(c_name) AS output, lower(c_name) <> c_name AS changed FROM customer")
def precis_username(spark, d):
    rows = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", C.protocol_profile("c_name", "precis_username_case_mapped").alias("r"))
    return rows.select("c_custkey", "r.output", "r.changed")


_BIDI = [("abc אבג", "LTR"), ("א(1)", "FS"), ("aא<ב", "LTR"), ("א∈ב", "RTL"), ("א⊂ב⊃ג", "RTL"), ("(א)", "RTL"), ("plain", "LTR")]
_SHOWN = ["abc גבא", "(1)א", "aב>א", "ב∋א", "ג⊂ב⊃א", "(א)", "plain"]
_LOOK = [("pаypаl", "paypal", "confusable", True), ("paypal", "paypal", "identical", True), ("abc", "abd", "not_confusable", False)]


def _literal(v) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower()


def _values(rows: list[tuple]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)


#: The confusable prototypes of the tables' characters that have one, decomposed.
_PROTOTYPES = {"%": "º/₀", "m": "rn", "I": "l", "1": "l", "|": "l", "0": "O", "`": "'", '"': "''", "а": "a", "\u0327": "\u0326"}


def _skeleton_sql(c: str) -> str:
    """The UTS #39 skeleton of the tables' Latin texts, and of their Cyrillic disguise."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    for x in "ÄÇÈÉÊÍÑÓÖÜäçèéêíñóöü":
        c = f"replace({c}, '{x}', {' || '.join(f'chr({ord(y)})' for y in unicodedata.normalize('NFD', x))})"
    for a, b in _PROTOTYPES.items():
        c = f"replace({c}, {quoted(a)}, {quoted(b)})"
    return c


@_query(f"SELECT * FROM ({_values([(t, d, o) for (t, d), o in zip(_BIDI, _SHOWN)])}) v(text, direction, shown)")
def display_order(spark, d):
    """Visual order of known texts."""
    tables = U.uts39_tables(spark)
    rows = spark.createDataFrame(_BIDI, "text string, direction string")
    shown = F.coalesce(*[F.when(F.col("direction") == k, C.display_order("text", tables, k)["output"]) for k in ("LTR", "RTL", "FS")])
    return rows.select("text", "direction", shown.alias("shown"))


@_query(f"SELECT * FROM ({_values(_LOOK)}) v(a, b, relation, same)")
def compare_confusables(spark, d):
    rows = spark.createDataFrame([r[:2] for r in _LOOK], "a string, b string")
    r = rows.select("a", "b", C.confusable("a", "b", U.uts39_tables(spark)).alias("r"))
    return r.select("a", "b", "r.relation", F.col("r.uts39Confusable").alias("same"))


@_query("SELECT a.c_custkey, lower(a.c_name) AS name, true AS same, false AS other FROM customer a")
def precis_compare(spark, d):
    """Each name against its capitals, and against another name."""
    rows = spark.read.parquet(f"{d}/customer.parquet")
    profile = "precis_username_case_mapped"
    same, other = C.protocol_compare("c_name", F.upper("c_name"), profile), C.protocol_compare("c_name", F.concat("c_name", F.lit("x")), profile)
    r = rows.select("c_custkey", same.alias("s"), other.alias("o"))
    return r.select("c_custkey", F.col("s.left").alias("name"), F.col("s.equal").alias("same"), F.col("o.equal").alias("other"))


def _items(spark, d, *kinds):
    return _docs(spark, d, *kinds).select(F.col("doc_id").alias("id"), F.col("t").alias("text"), F.col("lang").alias("scope"))


def _mixed(spark, d):
    """Every second document decomposed, so that copies differ in form."""
    rows = spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang"))
    t = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(_variant("text", "decomposed"))
    return rows.select(F.col("doc_id").alias("id"), t.alias("text"), F.col("lang").alias("scope"))


_ITEMS = f"(SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN text ELSE {_sql('text', 'decomposed')} END AS text, lang AS scope FROM documents)"
_KEYED = f"(SELECT id, text, scope, 'exact' AS relation, sha256(text) AS key_sha256 FROM {_ITEMS} UNION ALL SELECT id, text, scope, 'nfc', sha256(nfc_normalize(text)) FROM {_ITEMS})"
_GROUPS = f"(SELECT relation, scope, key_sha256, count(*) AS members, count(DISTINCT text) AS distinct_texts, min(id) AS first_id FROM {_KEYED} GROUP BY ALL HAVING count(*) > 1 AND (relation = 'exact' OR count(DISTINCT text) > 1))"
_MEMBERS = f"(SELECT k.relation, k.scope, k.key_sha256, k.id FROM {_KEYED} k SEMI JOIN {_GROUPS} g ON k.relation = g.relation AND k.scope IS NOT DISTINCT FROM g.scope AND k.key_sha256 = g.key_sha256)"
_RELATIONS = [N.Relation("exact"), N.Relation("nfc")]


def _namespace(spark, d):
    items = _mixed(spark, d)
    rows = written(N.keyed(items, _RELATIONS), "keyed")  # digests only, read twice
    found = N.groups(rows)
    return items, rows, found


@_query(f"SELECT * FROM {_GROUPS}")
def namespace_groups(spark, d):
    return _namespace(spark, d)[2]


@_query(f"SELECT * FROM {_MEMBERS}")
def namespace_members(spark, d):
    _, rows, found = _namespace(spark, d)
    return N.members(rows, found)


@_query(f"SELECT id FROM {_ITEMS} ANTI JOIN {_MEMBERS} m USING (id)")
def namespace_isolated(spark, d):
    items, rows, found = _namespace(spark, d)
    return N.isolated(items, N.members(rows, found))


@_query(f"SELECT i.*, g.groups, m.grouped_items, i.items - m.grouped_items AS isolated_items FROM (SELECT count(*) AS items, count(DISTINCT scope) AS scopes, sum(strlen(text))::BIGINT AS utf8_bytes FROM {_ITEMS}) i, (SELECT count(*) AS groups FROM {_GROUPS}) g, (SELECT count(DISTINCT id) AS grouped_items FROM {_MEMBERS}) m")
def namespace_summary(spark, d):
    items, rows, found = _namespace(spark, d)
    return N.summary(items, found, N.members(rows, found))


@_query(f"SELECT relation, count(*) AS groups, sum(members)::BIGINT AS members FROM {_GROUPS} GROUP BY relation")
def namespace_relations(spark, d):
    return N.relation_summary(_namespace(spark, d)[2])


@_query("SELECT p_name AS id, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def duplicate_ids(spark, d):
    return N.duplicate_ids(spark.read.parquet(f"{d}/part.parquet").select(F.col("p_name").alias("id")))


_BLIND = "(SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN text ELSE lower(replace(text, 'é', 'e')) END AS text, lang AS scope FROM documents)"


@_query(
    "SELECT 'declared_collation:locale=en:sensitivity=base' AS relation, scope, sha256(min(text)) AS key_sha256, count(*) AS members, count(DISTINCT text) AS distinct_texts, min(id) AS first_id "
    f"FROM {_BLIND} GROUP BY scope, lower(strip_accents(text)) HAVING count(*) > 1 AND count(DISTINCT text) > 1"
)
def namespace_collation(spark, d):
    """Documents that an accent- and case-blind collation takes for equal, per language."""
    rows = spark.read.parquet(f"{d}/documents.parquet")
    t = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.lower(F.replace("text", F.lit("é"), F.lit("e"))))
    items = rows.select(F.col("doc_id").alias("id"), t.alias("text"), F.col("lang").alias("scope"))
    return N.groups(N.keyed(items, [N.Relation("declared_collation", (("locale", "en"), ("sensitivity", "base")))]))


_DISGUISED = f"(SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN text ELSE {_sql('text', 'cyrillic')} END AS text, lang AS scope FROM documents)"


@_query(
    "SELECT 'uts39_confusable' AS relation, scope, sha256(sha256(look)) AS key_sha256, count(*) AS members, count(DISTINCT text) AS distinct_texts, min(id) AS first_id "
    f"FROM (SELECT *, {_skeleton_sql('text')} AS look FROM {_DISGUISED}) GROUP BY scope, look HAVING count(*) > 1 AND count(DISTINCT text) > 1"
)
def namespace_confusable(spark, d):
    """Documents whose texts look alike, with every second one in Cyrillic disguise."""
    rows = spark.read.parquet(f"{d}/documents.parquet")
    t = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(_variant("text", "cyrillic"))
    items = rows.select(F.col("doc_id").alias("id"), t.alias("text"), F.col("lang").alias("scope"))
    return N.groups(N.keyed(items, [N.Relation("uts39_confusable")], tables=U.uts39_tables(spark), direction="LTR"))


@_query(f"SELECT doc_id, s.name, count(*) AS hidden FROM (SELECT doc_id, t, unnest(range(0, length(t))) AS pos FROM {_d('hidden')}) x JOIN (VALUES ('head', 0, 100), ('body', 50, 1000000)) s(name, a, b) ON s.a <= pos AND pos < s.b WHERE substr(t, pos + 1, 1) IN (chr(8238), chr(8203)) GROUP BY ALL")
def hidden_by_span(spark, d):
    docs = _docs(spark, d, "hidden").select(F.col("doc_id").alias("source_id"), F.col("t").alias("text"))
    spans = docs.select("source_id", F.explode(F.array(F.struct(F.lit("head").alias("name"), F.lit(0).alias("start"), F.lit(100).alias("end")), F.struct(F.lit("body").alias("name"), F.lit(50).alias("start"), F.lit(1_000_000).alias("end")))).alias("s")).select("source_id", "s.*")
    return S.hidden_in_spans(S.hidden_characters(docs), spans).groupBy(F.col("source_id").alias("doc_id"), "name").agg(F.count(F.lit(1)).alias("hidden"))


_TURNS = f"(SELECT conv_id, CASE WHEN turn % 2 = 0 THEN text ELSE {_sql('text', 'cyrillic')} END AS text FROM conversations)"
_WORDS = f"(SELECT conv_id, word, {_skeleton_sql('word')} AS look, count(*) AS n FROM (SELECT conv_id, unnest(regexp_extract_all(text, '[\\p{{L}}_][\\p{{L}}\\p{{Nd}}_]*')) AS word FROM {_TURNS}) GROUP BY ALL)"


def _identifiers(spark, d):
    """Words of each conversation, half of its turns in Cyrillic disguise."""
    t = F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(_variant("text", "cyrillic"))
    rows = spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("source_id"), F.lit("conversation").alias("scope"), t.alias("text"))
    return S.identifier_spans(rows, pattern=r"[\p{L}_][\p{L}\p{Nd}_]*")


@_query(f"SELECT a.conv_id AS source_id, 'conversation' AS scope, a.word AS left_text, b.word AS right_text FROM {_WORDS} a JOIN {_WORDS} b ON a.conv_id = b.conv_id AND a.look = b.look AND a.word < b.word")
def source_confusable_pairs(spark, d):
    """Different words of one conversation that look alike, each pair of words once."""
    return S.confusable_pairs(_identifiers(spark, d), U.uts39_tables(spark))


@_query(f"SELECT conv_id AS source_id, 'conversation' AS scope, sha256(look) AS skeleton_sha256, count(*) AS texts, ((sum(n) * sum(n) - sum(n * n)) // 2)::BIGINT AS pairs FROM {_WORDS} GROUP BY conv_id, look HAVING count(*) > 1")
def source_confusable_classes(spark, d):
    """The same words by class: their occurrences' pairs are counted, not built."""
    return S.confusable_classes(_identifiers(spark, d), U.uts39_tables(spark))


@_query(
    f"SELECT p_partkey, CASE WHEN p_name LIKE '%a%' THEN 'empty' ELSE 'set' END AS script_resolution, CASE WHEN p_name LIKE '% %' THEN 'unrestricted' WHEN p_name LIKE '%a%' THEN 'minimally_restrictive' ELSE 'ascii_only' END AS restriction_level, "
    f"false AS mixed_numbers, p_name NOT LIKE '% %' AS xid, {_n(chr(39) + ' ' + chr(39))} AS not_allowed FROM (SELECT p_partkey, p_name, p_name AS t FROM part)"
)
def security_facts(spark, d):
    rows = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", _variant("p_name", "cyrillic").alias("t"))
    r = rows.select("p_partkey", C.security("t", U.uts39_tables(spark)).alias("r"))
    return r.select("p_partkey", "r.script_resolution", "r.restriction_level", "r.mixed_numbers", "r.xid", "r.not_allowed")


_NAME = f"replace({_sql('p_name', 'cyrillic')}, ' ', '_')"


@_query(
    f"SELECT p_partkey, {_NAME} AS transformed, true AS conforms, CASE WHEN p_name LIKE '%a%' THEN 'minimally_restrictive' ELSE 'ascii_only' END AS restriction_level, length(p_name) AS allowed, length(p_name) AS recommended, "
    "CASE WHEN p_name LIKE '%a%' THEN 'confusable' ELSE 'identical' END AS relation, CASE WHEN p_name LIKE '%a%' THEN 'mixed_script' END AS class, "
    f"sha256({_skeleton_sql(_NAME)}) AS skeleton_sha256 FROM part"
)
def security_identifiers(spark, d):
    """Part names as identifiers in Cyrillic disguise, each against its plain name."""
    plain = F.replace("p_name", F.lit(" "), F.lit("_"))
    rows = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.replace(_variant("p_name", "cyrillic"), F.lit(" "), F.lit("_")).alias("t"), plain.alias("plain"))
    r = rows.select("p_partkey", C.security_report("t", U.report_tables(spark), "identifier", "uts39_general_security", "plain", "LTR").alias("r"))
    kind = F.filter("r.type_counts", lambda x: x["type"] == "Recommended")[0]["n"]
    return r.select("p_partkey", "r.profile.transformed", "r.profile.conforms", "r.profile.restriction_level", F.col("r.status_allowed").alias("allowed"), kind.alias("recommended"), "r.comparison.relation", "r.comparison.class", F.col("r.comparison.left_skeleton_sha256").alias("skeleton_sha256"))


_PAIRS = f"(SELECT conv_id, turn, text AS x, {_sql('text', 'decomposed', 'hidden', 'lines')} AS t FROM conversations)"


@_query(
    "SELECT conv_id, turn, x = t AS exact, strlen(t) AS right_utf8_bytes, length(t) AS right_code_points, nfc_normalize(x) = nfc_normalize(t) AS nfc_equal, sha256(nfc_normalize(t)) AS nfc_sha256, "
    "CASE WHEN x <> t THEN (SELECT min(k) FROM range(0, 1 + greatest(length(x), length(t))) r(k) WHERE substr(x, k::INT + 1, 1) <> substr(t, k::INT + 1, 1)) END AS first_difference, "
    f"{_n('chr(8238)')} AS bidi_controls, {_n('chr(8238)')} + {_n('chr(8203)')} AS default_ignorables, length(t) - length(x) AS grown FROM {_PAIRS}"
)
def difference_facts(spark, d):
    """Each turn against itself with decomposed letters, hidden characters and odd line endings."""
    rows = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.col("text").alias("x"), _variant("text", "decomposed", "hidden", "lines").alias("t"))
    parts = ("exact", "right_utf8_bytes", "right_code_points", "nfc", "first_code_point", "right_invisible", "code_point_alignment")
    r = spread(rows).select("conv_id", "turn", C.difference_report("x", "t", parts=parts).alias("r"))
    a = F.col("r.code_point_alignment")
    return r.select("conv_id", "turn", "r.exact", "r.right_utf8_bytes", "r.right_code_points", F.col("r.nfc.equal").alias("nfc_equal"), F.col("r.nfc.right_sha256").alias("nfc_sha256"), F.col("r.first_code_point.index").alias("first_difference"), "r.right_invisible.bidi_controls", "r.right_invisible.default_ignorables", (a["inserted"] - a["deleted"]).alias("grown"))


#: Pairs, and the counts of their alignment by code points and by clusters.
_ALIGNED = [("A\u00e9\U0001f642Z", "Axe\u0301\U0001f642Y", 2, 4, 2, 4, 4), ("aa", "a", 1, 0, 1, 2, 2), ("ab" * 32, "ac" * 32, 32, 32, 32, 64, 64), ("", "x", 0, 1, 0, 1, 1), ("x", "x", 1, 0, 0, 1, 1)]


@_query(f"SELECT * FROM ({_values(_ALIGNED)}) v(a, b, matched, inserted, deleted, code_point_segments, grapheme_segments)")
def difference_alignment(spark, d):
    """Alignments of known pairs."""
    rows = spark.createDataFrame([r[:2] for r in _ALIGNED], "a string, b string").select("a", "b", C.difference_report("a", "b").alias("r"))
    c = F.col("r.code_point_alignment")
    return rows.select("a", "b", *[c[n].cast("int").alias(n) for n in ("matched", "inserted", "deleted")], c["segment_count"].cast("int").alias("code_point_segments"), F.col("r.grapheme_alignment.segment_count").cast("int").alias("grapheme_segments"))


@_query(f"SELECT doc_id, {_n('chr(8203)')} + {_n('chr(8238)')} AS hidden, {_n('chr(8203)')} + {_n('chr(8238)')} AS covered, {_n(_CR)} - {_n(_CRLF)} + {_n(_NEL)} + {_n(_LS)} + {_n(_PS)} AS abnormal, NULL::VARCHAR AS code FROM {_d('hidden', 'lines')} WHERE length(t) > 0 UNION ALL SELECT doc_id, NULL, NULL, NULL, 'INVALID_SPAN' FROM {_d('hidden', 'lines')} WHERE length(t) = 0")
def source_report(spark, d):
    """Documents as sources with one span over the whole text; the span of an empty text is refused."""
    rows = _wide(spark, d, "hidden", "lines")
    spans = F.array(F.struct(F.lit("token").alias("kind"), F.lit(0).alias("start_utf16"), C.utf16_units("t").alias("end_utf16"), F.lit(None).cast("string").alias("scope")))
    r = rows.select("doc_id", C.source_report("t", spans, U.uts39_tables(spark), "LTR", 1_000_000).alias("r"))
    covered = F.size(F.filter("r.hidden", lambda x: F.size(x["spans"]) == 1)).cast("long")
    return r.select("doc_id", F.col("r.hidden_count").alias("hidden"), F.when(F.col("r.hidden_count").isNotNull(), covered).alias("covered"), F.col("r.abnormal_line_ending_count").alias("abnormal"), F.col("r.error.code").alias("code"))


#: Texts with the output and number of passes of the case-mapped username profile, and their domain form.
_ENFORCED = [("Ｕser", "user", 2, "user"), ("user", "user", 1, "user"), ("faß", "faß", 1, "xn--fa-hia"), ("a b", None, None, None)]


@_query(f"SELECT * FROM ({_values(_ENFORCED)}) v(text, output, stabilized_after_pass, to_ascii)")
def protocol_witnesses(spark, d):
    rows = spark.createDataFrame([r[:1] for r in _ENFORCED], "text string")
    r = rows.select("text", C.protocol_witness("text", "precis_username_case_mapped").alias("p"), C.protocol_witness("text", "uts46", "to_ascii").alias("u"))
    return r.select("text", "p.output", F.col("p.stabilized_after_pass").cast("int").alias("stabilized_after_pass"), F.col("u.output").alias("to_ascii"))


@_query(f"SELECT doc_id, length(t) + 1 AS segment_count, CASE WHEN length(t) >= 0 THEN 1 END AS replacement_count, strlen(t) + 1 AS source_end, strlen(t) + 3 AS target_end FROM {_d('emoji')}")
def transcode_segments(spark, d):
    """A byte that no text holds, before each text: every later character keeps its place."""
    raw = F.concat(F.unhex(F.lit("FF")), F.col("t").cast("binary"))
    r = _wide(spark, d, "emoji").select("doc_id", C.transcode_witness(raw, "utf-8", "utf-8", lossy=True).alias("r"))
    last = F.element_at("r.segments", -1)
    return r.select("doc_id", "r.segment_count", F.col("r.replacement_count").cast("int").alias("replacement_count"), last["source_end"].alias("source_end"), last["target_end"].alias("target_end"))


@_query()
def explain_difference(spark, d):
    """Each turn against the one before it."""
    rows = spark.read.parquet(f"{d}/conversations.parquet")
    before = F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))
    pairs = rows.withColumn("before", before).filter(F.col("before").isNotNull())
    r = pairs.select("conv_id", "turn", C.explain_difference("before", "text").alias("r"))
    return r.select("conv_id", "turn", "r.exact", "r.casefold", "r.first_difference", "r.matched", "r.inserted", "r.deleted", F.size("r.segments").alias("segments"))


@_query(
    f"WITH RECURSIVE cut AS (SELECT doc_id, -1 AS idx, NULL::VARCHAR AS chunk, t AS rest FROM {_d('emoji')} UNION ALL SELECT doc_id, idx + 1, left_grapheme(w, k::BIGINT), substr(rest, length(left_grapheme(w, k::BIGINT)) + 1) "
    "FROM (SELECT doc_id, idx, rest, substr(rest, 1, 256) AS w, list_max(list_filter(range(1, 257), lambda j: strlen(left_grapheme(substr(rest, 1, 256), j)) <= 256)) AS k FROM cut WHERE rest <> '')) "
    "SELECT doc_id, idx, sha256(chunk) AS sha256, strlen(chunk)::INT AS utf8_bytes FROM cut WHERE idx >= 0"
)
def chunk_texts(spark, d):
    return _wide(spark, d, "emoji").select("doc_id", F.posexplode(C.chunks("t", 256)["chunks"]).alias("idx", "chunk")).select("doc_id", "idx", C.digest("chunk").alias("sha256"), F.octet_length("chunk").alias("utf8_bytes"))


@_query(f"SELECT a.doc_id, CASE WHEN a.h = b.h THEN 'same' ELSE 'sha256' END AS change FROM (SELECT doc_id, sha256(text) AS h FROM documents) a JOIN (SELECT doc_id, sha256(t) AS h FROM {_d('decomposed')}) b USING (doc_id)")
def record_changes(spark, d):
    a = _docs(spark, d).select("doc_id", C.digest("t").alias("sha256"))
    b = _docs(spark, d, "decomposed").select("doc_id", C.digest("t").alias("sha256"))
    return R.compare_records(a, b, "doc_id", ["sha256"])


def _merkle_sql(leaves: str) -> str:
    """grp, leaves, root of (grp, o, x): a level at a time, an odd node doubled."""
    return (
        "WITH RECURSIVE level AS (SELECT grp, count(*) OVER (PARTITION BY grp) AS leaves, count(*) OVER (PARTITION BY grp) AS n, row_number() OVER (PARTITION BY grp ORDER BY o, x) - 1 AS k, "
        f"unhex(sha256(unhex('00') || encode(x))) AS d FROM ({leaves}) UNION ALL "
        "SELECT grp, any_value(leaves), (any_value(n) + 1) // 2, k // 2, unhex(sha256(unhex('01') || min(d) FILTER (k % 2 = 0) || coalesce(min(d) FILTER (k % 2 = 1), min(d) FILTER (k % 2 = 0)))) "
        "FROM level WHERE n > 1 GROUP BY grp, k // 2) SELECT grp, leaves, lower(hex(d)) AS root FROM level WHERE n = 1"
    )


_REQUEST = """sha256('{"operation":"inspect_counts","text":' || to_json(t)::VARCHAR || '}')"""
_RESULT = """sha256('{"result":{"code_points":' || length(t) || ',"utf8_bytes":' || strlen(t) || ',"utf16_units":' || length(t) || ',"sha256":"' || sha256(t) || '"}}')"""
_RECORD = f"sha256(concat_ws(chr(0), 'inspect_counts', {_REQUEST}, {_RESULT}, sha256('{{}}')))"


@_query("SELECT doc_id AS case_id, CASE WHEN doc_id % 10 = 0 THEN 'request_sha256,semantic_sha256' ELSE 'same' END AS change FROM documents")
def measurement_records(spark, d):
    """A record of each document's inspection, replayed after every tenth text was changed."""
    rows = _docs(spark, d).select(F.col("doc_id").alias("case_id"), F.col("t").alias("text"))
    recorded = R.measure(rows, "inspect_counts", C.inspect_counts("text"), ["text"])
    changed = rows.withColumn("text", F.when(F.col("case_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return R.replay(recorded, R.measure(changed, "inspect_counts", C.inspect_counts("text"), ["text"]))


@_query("SELECT grp AS operation, leaves AS cases, root FROM (" + _merkle_sql(f"SELECT 'inspect_counts' AS grp, doc_id AS o, {_RECORD} AS x FROM {_d()}") + ")")
def behavior_manifest(spark, d):
    rows = _docs(spark, d).select(F.col("doc_id").alias("case_id"), F.col("t").alias("text"))
    return R.manifest(R.measure(rows, "inspect_counts", C.inspect_counts("text"), ["text"]))


@_query(_merkle_sql("SELECT source AS grp, doc_id AS o, sha256(text) AS x FROM documents"))
def merkle_roots(spark, d):
    return R.merkle_roots(_docs(spark, d).select("source", "doc_id", C.digest("t").alias("leaf")), "source", "doc_id", "leaf")


@_query("SELECT n_nationkey, rank() OVER (ORDER BY upper(n_name)) AS place FROM nation")
def collation_order(spark, d):
    rows = spark.read.parquet(f"{d}/nation.parquet")
    return rows.select("n_nationkey", F.rank().over(W.orderBy(C.collated("n_name", "en", "base"))).cast("long").alias("place"))


@_query(f"SELECT doc_id, {_COUNTS} FROM {_d('emoji')}")
def stream_inspect(spark, d):
    """The same facts through a stream that appends parquet exactly once."""
    out = shared_path(spark, "stream")
    path = f"{d}/documents.parquet"
    # The file source lists directories; one file is read by name through its folder.
    folder = spark.read.parquet(path)
    if _is_folder(spark, path):
        stream = read_table_stream(spark, path, folder.schema)
    else:
        stream = spark.readStream.schema(folder.schema).option("pathGlobFilter", "documents.parquet").parquet(d)
    facts = stream.select("doc_id", C.inspect_counts(_variant("text", "emoji")).alias("r")).select("doc_id", "r.*")
    run_stream(facts, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema(facts.schema).parquet(f"{out}/rows")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
