"""Column builders.  Plain counts, digests and encodings are SQL; the others run a
kernel per Arrow batch, return one struct per row and an ``error`` struct instead of
failing the job.  A null input gives a null result."""

from __future__ import annotations

import json
from collections.abc import Callable, Collection, Iterator

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import bidi
from . import kernels as K
from . import protocol as P
from . import reports as Q
from . import unicode_data as U

ERROR = T.StructType([T.StructField("code", T.StringType()), T.StructField("message", T.StringType()), T.StructField("details", T.MapType(T.StringType(), T.StringType()))])


def _schema(ddl: str) -> T.StructType:
    return T.StructType([*T._parse_datatype_string(ddl).fields, T.StructField("error", ERROR)]) if ddl else T.StructType([T.StructField("error", ERROR)])


def _kernel(ddl: str, function: Callable[..., dict], *columns: Column) -> Column:
    """A struct column of ``function`` over the columns' values; each distinct input of a batch is worked out once."""
    schema = _schema(ddl)
    kind = to_arrow_type(schema)
    names = [f.name for f in schema.fields]

    @F.arrow_udf(schema)
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            arrays = batch if isinstance(batch, tuple) else (batch,)
            known: dict[tuple, dict] = {}
            rows = []
            for values in zip(*(a.to_pylist() for a in arrays)):
                got = known.get(values)
                if got is None:
                    if None in values:
                        got = {}
                    else:
                        try:
                            got = function(*values)
                        except K.TextFactError as e:
                            got = {"error": {"code": e.code, "message": str(e), "details": list(e.details.items())}}
                    known[values] = got
                rows.append(got)
            yield pa.StructArray.from_arrays([pa.array([r.get(n) for r in rows], kind.field(n).type) for n in names], fields=list(kind))

    return run(*columns)


def _ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def _unless(plain: Column, value: Column, c: Column, kernel: Callable[[Column], Column]) -> Column:
    """``value`` where ``plain`` holds, by SQL alone; the kernel is sent the other texts only."""
    return F.when(plain, value).otherwise(kernel(F.when(~plain, c)))


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- SQL only -----------------------------------------------------------------


def utf16_units(c: str | Column) -> Column:
    return (F.octet_length(F.encode(col(c), "UTF-16LE")) / 2).cast("long")


def utf16_order(c: str | Column) -> Column:
    """Sort key for UTF-16 code unit order, which differs from Spark's byte order."""
    return F.hex(F.encode(col(c), "UTF-16BE"))


def digest(c: str | Column) -> Column:
    return F.sha2(col(c).cast("binary"), 256)


def inspect_counts(c: str | Column) -> Column:
    c = col(c)
    return F.struct(F.length(c).cast("long").alias("code_points"), F.octet_length(c).cast("long").alias("utf8_bytes"), utf16_units(c).alias("utf16_units"), digest(c).alias("sha256"))


def line_endings(c: str | Column) -> Column:
    """Counts of each line ending, and of lines (an empty text has one)."""
    c = col(c)
    n = lambda s: ((F.octet_length(c) - F.octet_length(F.replace(c, F.lit(s), F.lit("")))) / len(s.encode())).cast("long")
    crlf, cr, lf = n("\r\n"), n("\r"), n("\n")
    others = [n(x) for x in ("\x85", " ", " ")]
    return F.struct(crlf.alias("crlf"), (lf - crlf).alias("lf"), (cr - crlf).alias("cr"), *[o.alias(k) for o, k in zip(others, ("nel", "ls", "ps"))], (1 + lf + cr - crlf + others[0] + others[1] + others[2]).alias("lines"))


def signal_counts(c: str | Column) -> Column:
    """Counts of bidi controls, default ignorables and format characters.

    An ASCII text has none.  Of any other text one pass keeps the characters of all
    three sets, and what is left, mostly nothing, is counted.
    """
    c = col(c)
    sets = {"bidi_controls": U.characters("Bidi_Control"), "default_ignorables": U.characters("Default_Ignorable_Code_Point"), "format_characters": U.characters("gc=Cf")}
    inside = lambda chars: "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in _ranges(chars))
    left = F.when(_ascii(c), F.lit("")).otherwise(F.regexp_replace(c, f"[^{inside(''.join(set().union(*sets.values())))}]+", ""))
    left = F.when(c.isNotNull(), left)
    return F.transform(F.array(left), lambda x: F.struct(*[F.length(F.regexp_replace(x, f"[^{inside(chars)}]+", "")).cast("long").alias(name) for name, chars in sets.items()]))[0]


def _ranges(chars: str) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for c in sorted(map(ord, chars)):
        if out and out[-1][1] == c - 1:
            out[-1] = (out[-1][0], c)
        else:
            out.append((c, c))
    return out


def label(c: str | Column) -> Column:
    """U+XXXX of a one-character column."""
    h = F.ltrim(F.hex(F.encode(col(c), "UTF-32")), F.lit("0"))
    return F.concat(F.lit("U+"), F.lpad(h, F.greatest(F.length(h), F.lit(4)), F.lit("0")))


def code_points(c: str | Column) -> Column:
    """Array of (index, character); label exploded characters with :func:`label`."""
    return F.transform(F.filter(F.split(col(c), ""), lambda x: x != ""), lambda x, i: F.struct(i.alias("index"), x.alias("character")))


def encoded(c: str | Column, encoding: str, representation: str) -> Column:
    """The text's bytes: 'hex', 'base64' (one line) or 'bytes'."""
    raw = F.encode(col(c), {"utf-8": "UTF-8", "utf-16le": "UTF-16LE"}[encoding])
    return {"hex": F.lower(F.hex(raw)), "base64": F.regexp_replace(F.base64(raw), r"\s", ""), "bytes": raw}[representation]


COLLATIONS = {"variant": "", "accent": "_CI", "case": "_AI", "base": "_CI_AI"}


def collated(c: str | Column, locale: str, sensitivity: str = "variant", **options) -> Column:
    """The column under a declared collation; options that Spark's collations lack are refused."""
    locale = Q.locale_tag(locale)
    if sensitivity not in COLLATIONS:
        raise K.TextFactError("INVALID_COLLATION", sensitivity=sensitivity)
    if unsupported := {k: v for k, v in options.items() if v not in (None, False, "false", "sort", "default", "best fit", "lookup")}:
        raise K.TextFactError("UNSUPPORTED_COLLATION_OPTION", **unsupported)
    return F.collate(col(c), _spark_locale(locale) + COLLATIONS[sensitivity])


def _spark_locale(tag: str) -> str:
    """Spark's name of a locale: parts joined by _, the region by its three letters."""
    *parts, last = tag.split("-")
    if len(last) != 2 or not parts:
        return tag.replace("-", "_")
    locale = SparkSession.active()._jvm.com.ibm.icu.util.ULocale.forLanguageTag(tag)
    return "_".join([*parts, locale.getISO3Country()])


def compare(left: str | Column, right: str | Column, locale: str, sensitivity: str = "variant", **options) -> Column:
    """order (-1, 0, 1), collates_equal, code_unit_equal, canonical and compatibility equivalence."""
    a, b = collated(left, locale, sensitivity, **options), collated(right, locale, sensitivity, **options)
    order = F.when(a == b, 0).when(a < b, -1).otherwise(1)
    same = lambda form: normalize(left, form)["output"] == normalize(right, form)["output"]
    return F.struct(order.alias("order"), (a == b).alias("collates_equal"), (col(left) == col(right)).alias("code_unit_equal"), same("NFD").alias("canonical_equivalent"), same("NFKD").alias("compatibility_equivalent"))


# --- kernels ------------------------------------------------------------------


def grapheme_count(c: str | Column) -> Column:
    c = col(c)
    plain = _ascii(c) & ~F.contains(c, F.lit("\r"))
    return _unless(plain, F.length(c).cast("long"), c, lambda x: _kernel("n long", lambda t: {"n": K.grapheme_count(t)}, x)["n"])


def inspect(c: str | Column, detail_limit: int = 64) -> Column:
    def run(t):
        g, spans, at = K.graphemes(t), [], 0
        for x in g:
            spans.append({"text": x, "start": at, "end": at + len(x)})
            at += len(x)
        return {"code_points": len(t), "graphemes": len(g), "utf16_units": K.utf16_units(t), "utf8_bytes": len(t.encode()), "utf8_hex": t.encode().hex(), "utf16le_hex": t.encode("utf-16-le").hex(), "characters": [{"character": x, "label": K.label(x)} for x in t[:detail_limit]], "characters_truncated": len(t) > detail_limit, "clusters": spans[:detail_limit], "clusters_truncated": len(g) > detail_limit}

    return _kernel("code_points long, graphemes long, utf16_units long, utf8_bytes long, utf8_hex string, utf16le_hex string, characters array<struct<character:string,label:string>>, characters_truncated boolean, clusters array<struct<text:string,start:int,end:int>>, clusters_truncated boolean", run, col(c))


def inspect_units(c: str | Column) -> Column:
    """Facts of UTF-16LE units in a binary column, which may hold lone surrogates."""
    def run(raw):
        text = bytes(raw).decode("utf-16-le", "surrogatepass")
        ok = not any("\ud800" <= x <= "\udfff" for x in text)
        return {"well_formed": ok, "code_points": len(text), "graphemes": len(K.graphemes(text)), "utf8_bytes": len(text.encode()) if ok else None, "unpaired": sum("\ud800" <= x <= "\udfff" for x in text)}

    return _kernel("well_formed boolean, code_points long, graphemes long, utf8_bytes long, unpaired long", run, col(c))


def index(c: str | Column, max_chunk_bytes: int | None = None, max_chunks: int | None = None) -> Column:
    """Coordinates at every boundary, and grapheme-safe chunks where asked for."""
    kind = "utf8:long,utf16:long,code_point:long,grapheme:long,line:long,column_code_point:long,column_utf16:long"
    return _kernel(f"boundaries array<struct<{kind}>>, chunks array<string>", lambda t: {"boundaries": K.coordinates(t), "chunks": K.chunk(t, max_chunk_bytes, max_chunks) if max_chunk_bytes else None}, col(c))


def chunks(c: str | Column, max_bytes: int) -> Column:
    return _kernel("chunks array<string>", lambda t: {"chunks": K.chunk(t, max_bytes)}, col(c))


def normalize(c: str | Column, form: str) -> Column:
    if form not in K.FORMS:
        raise K.TextFactError("INVALID_INPUT", form=form)

    def run(t):
        n = K.normalize(t, form)
        # NFC and NFD are canonically equivalent to their input by definition.
        return {"output": n, "changed": n != t, "canonical_equivalent": form in ("NFC", "NFD") or n == t or K.normalize(t, "NFD") == K.normalize(n, "NFD"), "utf8_bytes": len(n.encode())}

    c = col(c)
    same = F.struct(c.alias("output"), F.lit(False).alias("changed"), F.lit(True).alias("canonical_equivalent"), F.octet_length(c).cast("long").alias("utf8_bytes"), F.lit(None).cast(ERROR).alias("error"))
    return _unless(_ascii(c), same, c, lambda x: _kernel("output string, changed boolean, canonical_equivalent boolean, utf8_bytes long", run, x))


def normalization_witness(c: str | Column, form: str) -> Column:
    def run(t):
        w = K.normalization_witness(t, form)
        return w | {"compositions": [dict(zip(("first", "second", "composed", "index"), s)) for s in w["compositions"]]}

    return _kernel("decomposed string, ordered string, reordered long, output string, compositions array<struct<first:string,second:string,composed:string,index:int>>", run, col(c))


def nfkc_casefold(c: str | Column) -> Column:
    c = col(c)
    return _unless(_ascii(c), F.lower(c), c, lambda x: _kernel("output string", lambda t: {"output": K.nfkc_casefold(t)}, x)["output"])


def lowercase(c: str | Column) -> Column:
    c = col(c)
    return _unless(_ascii(c), F.lower(c), c, lambda x: _kernel("output string", lambda t: {"output": K.lowercase(t)}, x)["output"])


def transcode(c: str | Column, source: str, target: str, lossy: bool = False) -> Column:
    """Bytes of one encoding into another, with the exact place of each replacement."""
    def run(raw):
        r = K.transcode(bytes(raw), source, target, lossy)
        return r | {"replacements": [{"start": a, "end": b} for a, b in r["replacements"]]}

    return _kernel("text string, encoded binary, bom string, replacements array<struct<start:int,end:int>>, round_trip boolean", run, col(c))


def security(c: str | Column, tables: dict) -> Column:
    """Scripts, signals, identifier syntax and restriction level of a text."""
    allowed = tables["allowed"]

    def run(t):
        K.require_well_formed(t)
        kind, found = K.resolve_scripts(t)
        return {"script_resolution": kind, "scripts": found, "bidi_controls": sum(U.has("Bidi_Control", x) for x in t), "default_ignorables": sum(U.has("Default_Ignorable_Code_Point", x) for x in t), "format_characters": sum(U.general_category(x) == "Cf" for x in t), "not_allowed": sum(x not in allowed for x in t), "restriction_level": K.restriction_level(t, allowed), "mixed_numbers": K.mixed_numbers(t), "xid": not K.xid_failures(t), "xid_casefold": not K.xid_failures(K.nfkc_casefold(t))}

    return _kernel("script_resolution string, scripts array<string>, bidi_controls long, default_ignorables long, format_characters long, not_allowed long, restriction_level string, mixed_numbers boolean, xid boolean, xid_casefold boolean", run, col(c))


def skeleton_digest(c: str | Column, tables: dict, direction: str = "LTR") -> Column:
    """SHA-256 of the bidi skeleton; the skeleton itself is no public value."""
    prototype = tables["prototype"]

    def run(t):
        U.use(tables)
        return {"sha256": K.sha256(K.bidi_skeleton(t, prototype, direction))}

    return _kernel("sha256 string", run, col(c))["sha256"]


def display_order(c: str | Column, tables: dict, direction: str = "LTR") -> Column:
    """The text in visual order (UAX #9), as a struct with ``output``."""
    def run(t):
        U.use(tables)
        return {"output": bidi.display_order(K.require_well_formed(t), direction)}

    return _kernel("output string", run, col(c))


def confusable(left: str | Column, right: str | Column, tables: dict, direction: str = "LTR") -> Column:
    prototype = tables["prototype"]

    def run(a, b):
        U.use(tables)
        return K.confusable(a, b, prototype, direction)

    return _kernel("relation string, class string, uts39Confusable boolean", run, col(left), col(right))


def explain_difference(left: str | Column, right: str | Column, unit: str = "grapheme") -> Column:
    """Normalisation relations, first difference and alignment of a pair."""
    def run(a, b):
        K.require_well_formed(a), K.require_well_formed(b)
        x, y = (K.graphemes(a), K.graphemes(b)) if unit == "grapheme" else (list(a), list(b))
        segments = K.align(x, y)
        first = next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)) if len(x) != len(y) else None)
        matched = sum(e - s for k, s, e, _, _ in segments if k == "equal")
        return {"exact": a == b, **{f.lower(): K.normalize(a, f) == K.normalize(b, f) for f in K.FORMS}, "casefold": K.nfkc_casefold(a) == K.nfkc_casefold(b), "first_difference": first, "matched": matched, "inserted": len(y) - matched, "deleted": len(x) - matched, "segments": [dict(zip(("kind", "left_start", "left_end", "right_start", "right_end"), s)) for s in segments]}

    return _kernel("exact boolean, nfc boolean, nfd boolean, nfkc boolean, nfkd boolean, casefold boolean, first_difference long, matched long, inserted long, deleted long, segments array<struct<kind:string,left_start:int,left_end:int,right_start:int,right_end:int>>", run, col(left), col(right))


ACTIONS = {"uts46": ("to_ascii", "to_unicode"), "precis": ("enforce",)}


def protocol_profile(c: str | Column, profile: str, action: str = "enforce", **options) -> Column:
    """PRECIS enforcement, or UTS #46 to_ascii / to_unicode; :func:`protocol_compare` compares."""
    if action not in ACTIONS["uts46" if profile == "uts46" else "precis"]:
        raise K.TextFactError("INVALID_INPUT", profile=profile, action=action)

    def run(t):
        out = P.uts46(t, action, **options) if profile == "uts46" else P.precis(t, profile)[0]
        return {"output": out, "changed": out != t}

    return _kernel("output string, changed boolean", run, col(c))


def protocol_compare(left: str | Column, right: str | Column, profile: str, **options) -> Column:
    """Whether two texts are one identifier under a profile: both are enforced, and equal; what either refuses is its error."""
    def run(a, b):
        x, y = (P.uts46(t, "to_ascii", **options) if profile == "uts46" else P.precis(t, profile)[0] for t in (a, b))
        return {"left": x, "right": y, "equal": x == y}

    return _kernel("left string, right string, equal boolean", run, col(left), col(right))


# --- reports ------------------------------------------------------------------

_AT = "struct<utf8:long,utf16:long,code_point:long,grapheme:long,line:long,column_code_point:long,column_utf16:long>"
_DETAIL = "array<struct<index_utf16:long,label:string,character:string,scripts:array<string>,bidi_class:string,signals:array<string>,identifier_status:string,identifier_types:array<string>>>"
_PROFILE = "struct<name:string,transformed:string,changed:boolean,conforms:boolean,syntax_failures:array<struct<index_utf16:long,index_code_point:long,label:string,required:string>>,restricted:array<struct<index_utf16:long,label:string>>,restriction_level:string,mixed_numbers:boolean,decimal_systems:array<string>>"
_COMPARISON = "struct<relation:string,uts39_confusable:boolean,class:string,direction:string,left_resolution:string,left_scripts:array<string>,right_resolution:string,right_scripts:array<string>,shared_scripts:array<string>,left_skeleton_sha256:string,right_skeleton_sha256:string>"
_RELATION = "struct<equal:boolean,left_changed:boolean,right_changed:boolean,left_sha256:string,right_sha256:string>"
_FIRST = f"struct<index:long,left:string,left_at:{_AT},right:string,right_at:{_AT}>"
_INVISIBLE = "struct<bidi_controls:long,default_ignorables:long,format_characters:long,items:array<struct<index_utf16:long,label:string,character:string,signals:array<string>>>,truncated:boolean>"
_ENDINGS = "array<struct<kind:string,start_utf16:long,end_utf16:long>>"
_ALIGNMENT = f"struct<unit:string,left_items:long,right_items:long,matched:long,inserted:long,deleted:long,segment_count:long,changes:long,segments_sha256:string,segments:array<struct<kind:string,left_start:long,left_end:long,right_start:long,right_end:long,left_from:{_AT},left_to:{_AT},right_from:{_AT},right_to:{_AT}>>>"
_OBSERVED = f"mode string, code_points long, utf16_units long, bidi_controls long, default_ignorables long, format_characters long, script_resolution string, scripts array<string>, characters {_DETAIL}, characters_truncated boolean, status_allowed long, status_restricted long, type_counts array<struct<type:string,n:long>>, profile {_PROFILE}, comparison {_COMPARISON}"


def security_report(c: str | Column, tables: dict, mode: str = "free_text", profile: str | None = None, comparison: str | Column | None = None, direction: str | None = None, detail_limit: int = 64) -> Column:
    """Observations on a text; of an identifier also its profile, and its comparison with another column's text."""
    if mode not in Q.MODES or (mode == "identifier") != (profile in Q.PROFILES) or (comparison is None) != (direction not in Q.DIRECTIONS) or (comparison is not None and mode != "identifier"):
        raise K.TextFactError("INVALID_INPUT", mode=mode, profile=profile, confusableDirection=direction)
    run = lambda t, other=None: Q.security(t, mode, profile, detail_limit, tables, other, direction)
    return _kernel(_OBSERVED, run, *([col(c)] if comparison is None else [col(c), col(comparison)]))


def difference_report(left: str | Column, right: str | Column, tables: dict | None = None, direction: str | None = None, detail_limit: int = 64, witness: bool = False, parts: Collection[str] | None = None) -> Column:
    """Everything that tells two texts apart; the confusable comparison with a direction, the segments with a witness.

    With ``parts`` (names of the report's fields) no other part is made.  Alignment takes
    time in proportion to the product of the lengths: strict limits keep it short.
    """
    if direction is not None and (direction not in Q.DIRECTIONS or tables is None):
        raise K.TextFactError("INVALID_INPUT", confusableDirection=direction)
    kinds = {"exact": "boolean"} | {f"{s}_{n}": "long" for s in ("left", "right") for n in ("utf8_bytes", "utf16_units", "code_points", "graphemes")}
    kinds |= dict.fromkeys(("nfc", "nfd", "nfkc", "nfkd", "casefold"), _RELATION) | dict.fromkeys(("first_code_point", "first_grapheme"), _FIRST)
    kinds |= {f"{s}_{n}": kind for n, kind in (("invisible", _INVISIBLE), ("line_endings", _ENDINGS)) for s in ("left", "right")}
    kinds |= dict.fromkeys(("code_point_alignment", "grapheme_alignment"), _ALIGNMENT) | {"confusable": _COMPARISON}
    if parts is not None and (unknown := set(parts) - set(kinds)):
        raise K.TextFactError("INVALID_INPUT", parts=sorted(unknown))
    ddl = ", ".join(f"{name} {kind}" for name, kind in kinds.items() if parts is None or name in parts)
    return _kernel(ddl, lambda a, b: Q.difference(a, b, detail_limit, witness, direction, tables, parts), col(left), col(right))


def source_report(c: str | Column, spans: str | Column, tables: dict, direction: str, detail_limit: int = 64) -> Column:
    """Diagnostics of a source over its own spans (array of kind, start_utf16, end_utf16, scope); a bad span is the row's error."""
    if direction not in Q.DIRECTIONS:
        raise K.TextFactError("INVALID_INPUT", confusableDirection=direction)
    # As JSON, so that a batch's rows can be told apart by value.
    keep = F.to_json(F.transform(col(spans), lambda s: F.struct(s["kind"].alias("kind"), s["start_utf16"].alias("start_utf16"), s["end_utf16"].alias("end_utf16"), s["scope"].alias("scope"))), {"ignoreNullFields": "false"})
    ddl = f"span_count long, identifiers long, spans array<struct<index:int,kind:string,scope:string,text:string,start:{_AT},end:{_AT}>>, hidden array<struct<index_utf16:long,label:string,signals:array<string>,spans:array<int>>>, hidden_count long, abnormal_line_endings {_ENDINGS}, abnormal_line_ending_count long, confusable_classes array<struct<scope:string,skeleton_sha256:string,texts:array<string>,spans:array<int>,pairs:long>>, confusable_pairs long"
    return _kernel(ddl, lambda t, s: Q.source(t, json.loads(s), direction, detail_limit, tables), col(c), keep)


def coordinate(c: str | Column, utf16: str | Column) -> Column:
    """The coordinate at a UTF-16 offset; INVALID_SPAN where there is no boundary."""
    return _kernel(f"at {_AT}", lambda t, k: {"at": Q.coordinate(t, k)}, col(c), col(utf16))


#: Bytes of source that are turned into segments at once; a longer text stands alone.
WITNESS_BYTES = 1 << 18


_WITNESS = f"segment_count long, replacement_count long, bom string, bom_handling string, segments array<struct<kind:string,label:string,{','.join(f'{p}:long' for p in Q.PLACES)}>>"


def transcode_witness(c: str | Column, source: str, target: str, lossy: bool = False) -> Column:
    """Each decoded character's place in the source, the text and the target.

    Segments take some 80 bytes a character, so a batch of texts is answered in several smaller ones.
    """
    schema = _schema(_WITNESS)
    return F.arrow_udf(_witness_run(schema, source, target, lossy), schema)(col(c))


def _witness_run(schema: T.StructType, source: str, target: str, lossy: bool) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    kind = to_arrow_type(schema)
    names = [f.name for f in schema.fields]

    def one(raw: bytes | None) -> dict:
        if raw is None:
            return {}
        try:
            return Q.transcode_places(raw, source, target, lossy)
        except K.TextFactError as e:
            return {"error": {"code": e.code, "message": str(e), "details": list(e.details.items())}}

    def segments(rows: list[dict]) -> pa.Array:
        import numpy as np

        known = [r for r in rows if "codes" in r]
        joined = lambda parts, dtype: np.concatenate([*parts, np.zeros(0, dtype)]).astype(dtype)
        codes = pa.array(joined([r["codes"] for r in known], np.uint32)).dictionary_encode()
        labels = pa.array([f"U+{x:04X}" for x in codes.dictionary.to_pylist()], pa.string()).take(codes.indices)
        kinds = pa.array(["scalar", "replacement"]).take(pa.array(joined([r["bad"] for r in known], np.int8)))
        bounds = [pa.array(joined([r["bounds"][k][cut] for r in known], np.int64)) for k in range(3) for cut in (slice(None, -1), slice(1, None))]
        item = kind.field("segments").type.value_type
        values = pa.StructArray.from_arrays([kinds, labels, *bounds], fields=list(item))
        sizes = np.cumsum([0, *(r.get("segment_count", 0) for r in rows)])
        offsets = pa.array(sizes[:-1].tolist() + [int(sizes[-1])], pa.int32(), mask=np.array([*("codes" not in r for r in rows), False]))
        return pa.ListArray.from_arrays(offsets, values).cast(kind.field("segments").type)

    def answered(rows: list[dict]) -> pa.Array:
        arrays = [segments(rows) if n == "segments" else pa.array([r.get(n) for r in rows], kind.field(n).type) for n in names]
        return pa.StructArray.from_arrays(arrays, fields=list(kind))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows, size = [], 0
            for value in batch:
                raw = value.as_py()
                if rows and size + len(raw or b"") > WITNESS_BYTES:
                    yield answered(rows)
                    rows, size = [], 0
                rows.append(one(raw))
                size += len(raw or b"")
            if rows:
                yield answered(rows)

    return run


def protocol_witness(c: str | Column, profile: str, action: str = "enforce", **options) -> Column:
    """How an identifier came about: the passes of a PRECIS profile, or the facts of a UTS #46 conversion."""
    if action not in ACTIONS["uts46" if profile == "uts46" else "precis"]:
        raise K.TextFactError("INVALID_INPUT", profile=profile, action=action)
    if profile == "uts46":
        ddl = "output string, action string, input_code_points long, output_code_points long, input_ascii boolean, output_ascii boolean, input_root boolean, output_root boolean, changed boolean"
        return _kernel(ddl, lambda t: Q.uts46_witness(t, action, **options), col(c))
    ddl = "output string, pass_count long, stabilized_after_pass long, passes array<struct<index:int,input:string,output:string,changed:boolean,steps:array<struct<stage:string,output:string,changed:boolean>>>>"
    return _kernel(ddl, lambda t: Q.precis_witness(t, profile), col(c))
