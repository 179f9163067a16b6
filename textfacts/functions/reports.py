"""Whole reports on a text, a pair or a source; plain dicts, no Spark.

They put the facts of :mod:`kernels`, :mod:`bidi` and :mod:`protocol` together:
complete counts with bounded detail, coordinates at every place they name, and
witnesses that show how an output came about.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from collections.abc import Collection
from functools import lru_cache
from itertools import accumulate

from . import kernels as K
from . import protocol as P
from . import unicode_data as U

MODES = ("free_text", "identifier")
PROFILES = ("uax31_xid", "uax31_nfkc_casefold", "uts39_general_security")
DIRECTIONS = ("LTR", "RTL", "FS")
SIGNALS = {"bidi_control": "Bidi_Control", "default_ignorable": "Default_Ignorable_Code_Point", "format_character": "gc=Cf"}


def one_of(value: str, known: tuple[str, ...], field: str) -> str:
    if value not in known:
        raise K.TextFactError("INVALID_INPUT", field=field, value=value)
    return value


# --- places -------------------------------------------------------------------


def offsets(text: str) -> list[int]:
    """The UTF-16 offset of every code point boundary."""
    return list(accumulate((1 + (c > "\uffff") for c in text), initial=0))


def places(text: str) -> dict[int, dict]:
    """The coordinate of every code point boundary, by its offset in UTF-16 units."""
    return {c["utf16"]: c for c in K.coordinates(text)}


def coordinate(text: str, utf16: int) -> dict:
    """The coordinate at a UTF-16 offset; INVALID_SPAN inside a pair or outside the text."""
    at = places(text).get(utf16)
    if at is None:
        raise K.TextFactError("INVALID_SPAN", offset=utf16)
    return at


def line_ending_items(text: str, limit: int) -> list[dict]:
    """The first line endings with kind and offsets."""
    kinds = {"\r\n": "CRLF", "\n": "LF", "\r": "CR", "\x85": "NEL", "\u2028": "LS", "\u2029": "PS"}
    out, at = [], offsets(text)
    for found in K.LINE_BREAK.finditer(text):
        if len(out) == limit:
            break
        start = at[found.start()]
        out.append({"kind": kinds[found.group()], "start_utf16": start, "end_utf16": start + len(found.group())})
    return out


# --- security -----------------------------------------------------------------


@lru_cache(200_000)
def signals(char: str) -> list[str]:
    """Kinds of hidden character that a character is; not to be changed, as it is remembered."""
    return [name for name, prop in SIGNALS.items() if U.has(prop, char)]


def identifier_types(char: str, types: dict[str, list[tuple[int, int]]]) -> list[str]:
    """Identifier types of UTS #39, sorted; Not_Character where there is none."""
    c, found = ord(char), []
    for name, ranges in types.items():
        k = bisect_right(ranges, (c, 0x110000)) - 1
        if k >= 0 and ranges[k][0] <= c <= ranges[k][1]:
            found.append(name)
    return sorted(found) or ["Not_Character"]


def decimal_systems(text: str) -> list[str]:
    """Labels of the zeros of the number systems in a text."""
    zeros = {ord(c) - unicodedata.decimal(c) for c in text if unicodedata.decimal(c, None) is not None}
    return [K.label(chr(z)) for z in sorted(zeros)]


def observe(text: str, mode: str, limit: int, tables: dict) -> dict:
    """Counts over the whole text, and detail of its first ``limit`` characters."""
    K.require_well_formed(text)
    named = one_of(mode, MODES, "mode") == "identifier"
    counts = dict.fromkeys(SIGNALS, 0)
    kinds: dict[str, int] = {}
    allowed, detail, at = 0, [], 0
    for k, c in enumerate(text):
        own = signals(c)
        for s in own:
            counts[s] += 1
        if not named and k >= limit:
            at += 1 + (c > "\uffff")
            continue
        status = types = None
        if named:
            status, types = "Allowed" if c in tables["allowed"] else "Restricted", identifier_types(c, tables["types"])
            allowed += status == "Allowed"
            for t in types:
                kinds[t] = kinds.get(t, 0) + 1
        if k < limit:
            detail.append({"index_utf16": at, "label": K.label(c), "character": c, "scripts": list(U.scripts(c)), "bidi_class": U.bidi_class(c), "signals": own, "identifier_status": status, "identifier_types": types})
        at += 1 + (c > "\uffff")
    # Each character once: repeats do not change an intersection.
    resolution, scripts = K.resolve_scripts("".join(dict.fromkeys(text)))
    out = {"mode": mode, "code_points": len(text), "utf16_units": at, **{f"{s}s": n for s, n in counts.items()}, "script_resolution": resolution, "scripts": scripts, "characters": detail, "characters_truncated": len(text) > limit}
    if named:
        out |= {"status_allowed": allowed, "status_restricted": len(text) - allowed, "type_counts": [{"type": t, "n": kinds[t]} for t in sorted(kinds)]}
    return out


def identifier_profile(text: str, profile: str, tables: dict) -> dict:
    """What a named identifier profile says of a text, with every failure."""
    one_of(profile, PROFILES, "profile")
    shown = K.nfkc_casefold(text) if profile == "uax31_nfkc_casefold" else text
    at = offsets(shown)
    failures = [{"index_utf16": at[k], "index_code_point": k, "label": which, "required": "XID_Continue" if k else "XID_Start"} for k, which in K.xid_failures(shown)]
    strict = profile == "uts39_general_security"
    restricted = [{"index_utf16": at[k], "label": K.label(c)} for k, c in enumerate(shown) if strict and c not in tables["allowed"]]
    systems = decimal_systems(shown)
    return {"name": profile, "transformed": shown, "changed": shown != text, "conforms": not failures and not restricted, "syntax_failures": failures, "restricted": restricted, "restriction_level": K.restriction_level(shown, tables["allowed"]), "mixed_numbers": len(systems) > 1, "decimal_systems": systems}


def comparison(left: str, right: str, direction: str, tables: dict) -> dict:
    """Whether two texts are confusable under bidiSkeleton(direction), of which class, and why."""
    one_of(direction, DIRECTIONS, "confusableDirection")
    U.use(tables)
    a, b = (K.sha256(K.bidi_skeleton(t, tables["prototype"], direction)) for t in (left, right))
    (lk, ls), (rk, rs) = K.resolve_scripts(left), K.resolve_scripts(right)
    both = lk == rk == "set"
    shared = sorted(set(ls) & set(rs)) if both else []
    kind = None
    if a == b and left != right:
        kind = "single_script" if shared else "whole_script" if both else "mixed_script"
    return {"relation": "identical" if left == right else "confusable" if a == b else "not_confusable", "uts39_confusable": a == b, "class": kind, "direction": direction, "left_resolution": lk, "left_scripts": ls, "right_resolution": rk, "right_scripts": rs, "shared_scripts": shared, "left_skeleton_sha256": a, "right_skeleton_sha256": b}


def security(text: str, mode: str, profile: str | None, limit: int, tables: dict, other: str | None = None, direction: str | None = None) -> dict:
    """Observations; in identifier mode the profile and, with another text, the comparison."""
    if (mode == "identifier") != (profile is not None) or (other is None) != (direction is None) or (other is not None and mode != "identifier"):
        raise K.TextFactError("INVALID_INPUT", mode=mode, profile=profile)
    out = observe(text, mode, limit, tables)
    if profile is not None:
        out["profile"] = identifier_profile(text, profile, tables)
    if other is not None:
        out["comparison"] = comparison(text, K.require_well_formed(other), direction, tables)
    return out


# --- difference ---------------------------------------------------------------


def relation(left: str, right: str, function) -> dict:
    """Two outputs of one transformation: equal, changed, digests."""
    a, b = function(left), function(right)
    return {"equal": a == b, "left_changed": a != left, "right_changed": b != right, "left_sha256": K.sha256(a), "right_sha256": K.sha256(b)}


def first_difference(left: list[str], right: list[str], left_text: str, right_text: str) -> dict | None:
    """Index, item and coordinate on either side of the first difference; an ended side has no item."""
    k = next((k for k, (x, y) in enumerate(zip(left, right)) if x != y), min(len(left), len(right)))
    if k == len(left) == len(right):
        return None
    item = lambda side: side[k] if k < len(side) else None
    at = lambda side, text: K.coordinate(text, sum(map(len, side[:k])))
    return {"index": k, "left": item(left), "left_at": at(left, left_text), "right": item(right), "right_at": at(right, right_text)}


def invisible(text: str, limit: int) -> dict:
    """Complete signal counts, and the hidden ones of the first ``limit`` characters."""
    hidden = {c: s for c in set(text) if (s := signals(c))}
    items = [{"index_utf16": K.utf16_units(text[:k]), "label": K.label(c), "character": c, "signals": hidden[c]} for k, c in enumerate(text[:limit]) if c in hidden]
    return {**{f"{n}s": sum(text.count(c) for c, s in hidden.items() if n in s) for n in SIGNALS}, "items": items, "truncated": len(text) > limit}


def segment_digest(unit: str, segments: list[tuple], schema: str = "alignment-segments-1") -> str:
    """SHA-256 over schema, unit and the segments' fields, parted by zero characters."""
    return K.sha256("\0".join([schema, unit, *[f"{kind}\0{i}\0{j}\0{p}\0{q}" for kind, i, j, p, q in segments]]))


def alignment(left: list[str], right: list[str], unit: str, texts: tuple[str, str] | None = None) -> dict:
    """Counts and digest of the aligned segments; with the texts also each segment's coordinates."""
    segments = K.align(left, right)
    matched = sum(b - a for kind, a, b, _, _ in segments if kind == "equal")
    out = {"unit": unit, "left_items": len(left), "right_items": len(right), "matched": matched, "inserted": len(right) - matched, "deleted": len(left) - matched, "segment_count": len(segments), "changes": sum(s[0] != "equal" for s in segments), "segments_sha256": segment_digest(unit, segments)}
    if texts is not None:
        tables = []
        for side, text in zip((left, right), texts):
            places_of, offset = K.coordinates(text), [0]
            for x in side:
                offset.append(offset[-1] + len(x))
            tables.append([places_of[o] for o in offset])
        a, b = tables
        out["segments"] = [{"kind": kind, "left_start": i, "left_end": j, "right_start": p, "right_end": q, "left_from": a[i], "left_to": a[j], "right_from": b[p], "right_to": b[q]} for kind, i, j, p, q in segments]
    return out


def difference(left: str, right: str, limit: int, full: bool, direction: str | None, tables: dict | None, parts: Collection[str] | None = None) -> dict:
    """Everything that tells two texts apart, or the named parts of that; each is whole."""
    a, b = map(K.require_well_formed, (left, right))
    clusters = lru_cache(None)(K.graphemes)
    made = {"exact": lambda: a == b}
    for side, t in (("left", a), ("right", b)):
        made |= {
            f"{side}_utf8_bytes": lambda t=t: len(t.encode()),
            f"{side}_utf16_units": lambda t=t: K.utf16_units(t),
            f"{side}_code_points": lambda t=t: len(t),
            f"{side}_graphemes": lambda t=t: len(clusters(t)),
            f"{side}_invisible": lambda t=t: invisible(t, limit),
            f"{side}_line_endings": lambda t=t: line_ending_items(t, limit),
        }
    made |= {f.lower(): lambda f=f: relation(a, b, lambda t: K.normalize(t, f)) for f in K.FORMS}
    made |= {
        "casefold": lambda: relation(a, b, K.nfkc_casefold),
        "first_code_point": lambda: first_difference(list(a), list(b), a, b),
        "first_grapheme": lambda: first_difference(clusters(a), clusters(b), a, b),
        "code_point_alignment": lambda: alignment(list(a), list(b), "code_point", (a, b) if full else None),
        "grapheme_alignment": lambda: alignment(clusters(a), clusters(b), "extended_grapheme_cluster", (a, b) if full else None),
    }
    if direction is not None:
        made["confusable"] = lambda: comparison(a, b, direction, tables)
    return {k: make() for k, make in made.items() if parts is None or k in parts}


# --- sources ------------------------------------------------------------------


def check_spans(text: str, spans: list[dict], at: dict[int, dict]) -> list[dict]:
    """The spans with text and coordinates; a bad one is named in the error."""
    out = []
    units = text.encode("utf-16-le")
    for k, s in enumerate(spans):
        kind, start, end, scope = s["kind"], s["start_utf16"], s["end_utf16"], s.get("scope")
        one_of(kind, ("identifier", "token"), f"spans[{k}].kind")
        if kind == "identifier" and not (scope and K.utf16_units(scope) <= 64) or kind == "token" and scope is not None:
            raise K.TextFactError("INVALID_INPUT", field=f"spans[{k}].scope")
        if start is None or end is None or not 0 <= start <= len(units) // 2 or not 0 <= end <= len(units) // 2:
            raise K.TextFactError("INVALID_INPUT", field=f"spans[{k}]")
        if end <= start or start not in at or end not in at:
            raise K.TextFactError("INVALID_SPAN", field=f"spans[{k}]", start=start, end=end)
        out.append({"index": k, "kind": kind, "scope": scope, "text": units[2 * start : 2 * end].decode("utf-16-le"), "start": at[start], "end": at[end]})
    return out


def source(text: str, spans: list[dict], direction: str, limit: int, tables: dict) -> dict:
    """Hidden characters with the spans that cover them, abnormal line endings, and classes of
    confusable identifiers of one scope.

    A class lists its different texts and the indexes of all its spans; ``pairs`` counts the pairs of
    spans with different text without building them.
    """
    K.require_well_formed(text)
    one_of(direction, DIRECTIONS, "confusableDirection")
    U.use(tables)
    known = check_spans(text, spans, places(text))
    hidden, at = [], 0
    for c in text:
        if s := signals(c):
            hidden.append({"index_utf16": at, "label": K.label(c), "signals": s, "spans": [x["index"] for x in known if x["start"]["utf16"] <= at < x["end"]["utf16"]]})
        at += K.utf16_units(c)
    endings = [e for e in line_ending_items(text, len(text)) if e["kind"] not in ("LF", "CRLF")]
    groups: dict[tuple[str, str], dict[str, list[int]]] = {}
    for x in known:
        if x["kind"] == "identifier":
            key = x["scope"], K.sha256(K.bidi_skeleton(x["text"], tables["prototype"], direction))
            groups.setdefault(key, {}).setdefault(x["text"], []).append(x["index"])
    classes = []
    for (scope, key), texts in sorted(groups.items()):
        if len(texts) > 1:
            sizes = [len(v) for v in texts.values()]
            classes.append({"scope": scope, "skeleton_sha256": key, "texts": sorted(texts, key=lambda t: t.encode("utf-16-be")), "spans": sorted(i for v in texts.values() for i in v), "pairs": (sum(sizes) ** 2 - sum(n * n for n in sizes)) // 2})
    return {"span_count": len(known), "identifiers": sum(x["kind"] == "identifier" for x in known), "spans": known, "hidden": hidden[:limit], "hidden_count": len(hidden), "abnormal_line_endings": endings[:limit], "abnormal_line_ending_count": len(endings), "confusable_classes": classes, "confusable_pairs": sum(c["pairs"] for c in classes)}


# --- witnesses ----------------------------------------------------------------


PLACES = ("source_start", "source_end", "decoded_start", "decoded_end", "target_start", "target_end")


def transcode_places(data: bytes, source_encoding: str, target: str, lossy: bool) -> dict:
    """What :func:`transcode_witness` holds, with the segments as arrays: the characters' code points,
    which of them stand for invalid bytes, and the boundaries in source, text (UTF-16) and target."""
    import numpy as np

    result = K.transcode(data, source_encoding, target, lossy)
    ends = dict(result["replacements"])
    codes = np.frombuffer(result["text"].encode("utf-32-le"), np.uint32)
    sizes = {
        "utf-8": 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF),
        "utf-16le": 2 + 2 * (codes > 0xFFFF).astype(np.int64),
    }
    own, bad = sizes[source_encoding].copy(), np.zeros(len(codes), bool)
    if ends:
        starts, shift = np.cumsum(own) - own, 0
        for k in np.flatnonzero(codes == 0xFFFD).tolist():
            byte = int(starts[k]) + shift
            if byte in ends:
                bad[k], shift = True, shift + ends[byte] - byte - int(own[k])
                own[k] = ends[byte] - byte
    bounds = [np.concatenate([[0], np.cumsum(x)]) for x in (own, sizes["utf-16le"] // 2, sizes[target])]
    return {"segment_count": len(codes), "replacement_count": len(ends), "bom": result["bom"], "bom_handling": "preserved_as_character" if result["bom"] else "not_present", "codes": codes, "bad": bad, "bounds": bounds}


def transcode_witness(data: bytes, source_encoding: str, target: str, lossy: bool) -> dict:
    """Each character's place in the source bytes, the decoded text (UTF-16) and the target bytes."""
    r = transcode_places(data, source_encoding, target, lossy)
    codes, bad = r.pop("codes").tolist(), r.pop("bad").tolist()
    ends = [x.tolist() for x in r.pop("bounds")]
    places = zip(*(x for b in ends for x in (b, b[1:])))
    return r | {"segments": [{"kind": "replacement" if no else "scalar", "label": f"U+{c:04X}", **dict(zip(PLACES, at))} for c, no, at in zip(codes, bad, places)]}


def precis_witness(text: str, profile: str) -> dict:
    """Every pass of an enforcement with its mappings, until one changes nothing."""
    output = P.precis(text, profile)[0]
    kind, mapped = P.PROFILES[profile]
    first = ("width_mapping", lambda t: t.translate(K.width_map())) if kind == "identifier" else ("space_mapping", lambda t: "".join(" " if U.general_category(c) == "Zs" else c for c in t))
    stages = [first, *([("case_mapping", K.lowercase)] if mapped else []), ("nfc", lambda t: unicodedata.normalize("NFC", t))]
    passes, now = [], text
    while not passes or passes[-1]["changed"]:
        before, steps = now, []
        for name, run in stages:
            new = run(now)
            steps.append({"stage": name, "output": new, "changed": new != now})
            now = new
        passes.append({"index": len(passes) + 1, "input": before, "output": now, "changed": now != before, "steps": steps})
    return {"output": output, "pass_count": len(passes), "stabilized_after_pass": len(passes), "passes": passes}


def uts46_witness(text: str, action: str, **options) -> dict:
    output = P.uts46(text, action, **options)
    return {"output": output, "action": action, "input_code_points": len(text), "output_code_points": len(output), "input_ascii": text.isascii(), "output_ascii": output.isascii(), "input_root": text.endswith("."), "output_root": output.endswith("."), "changed": text != output}


@lru_cache(None)
def locale_tag(locale: str) -> str:
    """A well-formed BCP 47 tag of language, script and region, in canonical case; else INVALID_LOCALE."""
    parts = locale.split("-")
    language, rest = parts[0], parts[1:]
    if not (language.isascii() and language.isalpha() and len(language) in (2, 3)):
        raise K.TextFactError("INVALID_LOCALE", locale=locale)
    out = [language.lower()]
    if rest and len(rest[0]) == 4 and rest[0].isascii() and rest[0].isalpha():
        out.append(rest.pop(0).title())
    if rest and rest[0].isascii() and (len(rest[0]) == 2 and rest[0].isalpha() or len(rest[0]) == 3 and rest[0].isdigit()):
        out.append(rest.pop(0).upper())
    if rest:
        raise K.TextFactError("INVALID_LOCALE", locale=locale)
    return "-".join(out)
