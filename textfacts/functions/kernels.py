"""Pure functions on str and bytes; no Spark in here.

Written from the published standards: UAX #9, #15, #29, #31, UTS #39, #46,
RFC 3492, 5893, 8264-8266.  Text is a sequence of code points; lone surrogates are
refused by :func:`require_well_formed`.
"""

from __future__ import annotations

import codecs
import hashlib
import unicodedata
from collections.abc import Callable, Sequence
from functools import lru_cache
from itertools import islice
from math import isqrt
from operator import xor

import regex

from . import unicode_data as U


class TextFactError(ValueError):
    """An error with a stable code, returned per row instead of failing the job."""

    def __init__(self, code: str, message: str = "", **details):
        super().__init__(message or code)
        self.code, self.details = code, {k: str(v) for k, v in details.items()}


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def require_well_formed(text: str) -> str:
    if regex.search("[\ud800-\udfff]", text):
        raise TextFactError("INVALID_UNICODE")
    return text


def utf16_units(text: str) -> int:
    return len(text) + sum(c > "\uffff" for c in text)


def label(char: str) -> str:
    return f"U+{ord(char):04X}"


# --- coordinates and segments -------------------------------------------------

LINE_BREAK = regex.compile("\r\n|[\n\r\x85\u2028\u2029]")


def graphemes(text: str) -> list[str]:
    """Extended grapheme clusters."""
    if text.isascii() and "\r" not in text:
        return list(text)
    return regex.findall(r"\X", text)


_CLUSTER = regex.compile(r"\X")
#: Characters from U+0300 on with a neighbour below on either side; two characters below are never in one cluster but CR LF.
_NEAR_MARKS = regex.compile("[\\x00-\\u02ff]?(?:[^\\x00-\\u02ff]+[\\x00-\\u02ff]?)+")


def grapheme_count(text: str) -> int:
    """Number of clusters; only what stands near a character from U+0300 on is segmented."""
    text = text.replace("\r\n", "\n")
    if text.isascii():
        return len(text)
    near = _NEAR_MARKS.findall(text)
    return len(text) - sum(map(len, near)) + sum(len(_CLUSTER.findall(x)) for x in near)


def coordinates(text: str) -> list[dict]:
    """One entry per boundary: UTF-8, UTF-16, code point, grapheme, line (from 1), columns."""
    starts, at = set(), 0
    for g in graphemes(text):
        starts.add(at)
        at += len(g)
    out, u8, u16, grapheme, line, col_cp, col_u16 = [], 0, 0, -1, 1, 0, 0
    for k, c in enumerate([*text, ""]):
        grapheme += k in starts
        inside = bool(c) and k not in starts
        out.append({"utf8": u8, "utf16": u16, "code_point": k, "grapheme": None if inside else (grapheme if c else len(starts)), "line": line, "column_code_point": col_cp, "column_utf16": col_u16})
        if not c:
            break
        w16 = 2 if c > "\uffff" else 1
        u8 += len(c.encode("utf-8", "surrogatepass"))
        u16 += w16
        if c in "\n\x85\u2028\u2029" or (c == "\r" and text[k + 1 : k + 2] != "\n"):
            line, col_cp, col_u16 = line + 1, 0, 0
        else:
            col_cp, col_u16 = col_cp + 1, col_u16 + w16
    return out


_LINE_END = regex.compile("[\n\x85\u2028\u2029]|\r(?!\n)")


def coordinate(text: str, k: int) -> dict:
    """The entry of :func:`coordinates` for one boundary, without the others."""
    before = text[:k]
    breaks = [x.end() for x in _LINE_END.finditer(text) if x.end() <= k] if not before.isprintable() else []
    line = breaks[-1] if breaks else 0
    grapheme = grapheme_count(before)
    inside = k < len(text) and grapheme_count(text[: k + 1]) == grapheme
    return {"utf8": len(before.encode("utf-8", "surrogatepass")), "utf16": utf16_units(before), "code_point": k, "grapheme": None if inside else grapheme, "line": len(breaks) + 1, "column_code_point": k - line, "column_utf16": utf16_units(before[line:])}


def chunk(text: str, max_bytes: int, limit: int | None = None) -> list[str]:
    """Greedy chunks of whole graphemes, each of at most ``max_bytes`` UTF-8 bytes."""
    out, held, size = [], [], 0
    for g in graphemes(require_well_formed(text)):
        n = len(g.encode())
        if n > max_bytes:
            raise TextFactError("CHUNK_GRAPHEME_TOO_LARGE", graphemeBytes=n, maximum=max_bytes)
        if size + n > max_bytes:
            out.append("".join(held))
            held, size = [], 0
        held.append(g)
        size += n
    if held:
        out.append("".join(held))
    if limit is not None and len(out) > limit:
        raise TextFactError("TOO_MANY_CHUNKS", chunks=len(out), maximum=limit)
    return out


# --- normalisation and case ---------------------------------------------------

FORMS = ("NFC", "NFD", "NFKC", "NFKD")


def normalize(text: str, form: str) -> str:
    return unicodedata.normalize(form, require_well_formed(text))


def normalization_witness(text: str, form: str) -> dict:
    """Stages of a normalisation: decomposed, canonically ordered, composed."""
    require_well_formed(text)
    kind = "NFKD" if form in ("NFKC", "NFKD") else "NFD"
    raw = []
    for c in text:
        raw += unicodedata.normalize(kind, c)
    ordered = list(raw)
    start = 0
    while start < len(ordered):
        if unicodedata.combining(ordered[start]) == 0:
            start += 1
            continue
        end = start
        while end < len(ordered) and unicodedata.combining(ordered[end]):
            end += 1
        ordered[start:end] = sorted(ordered[start:end], key=unicodedata.combining)
        start = end
    composed, steps = ordered, []
    if form in ("NFC", "NFKC"):
        composed, starter, last = [], -1, 0
        for c in ordered:
            ccc = unicodedata.combining(c)
            if starter >= 0 and (starter == len(composed) - 1 or last < ccc):
                pair = unicodedata.normalize("NFC", composed[starter] + c)
                if len(pair) == 1 and pair != c:
                    steps.append((composed[starter], c, pair, starter))
                    composed[starter] = pair
                    continue
            if ccc == 0:
                starter = len(composed)
            last = ccc
            composed.append(c)
    return {"decomposed": "".join(raw), "ordered": "".join(ordered), "reordered": sum(a != b for a, b in zip(raw, ordered)), "compositions": steps, "output": unicodedata.normalize(form, text)}


@lru_cache(100_000)
def _nfkc_cf(char: str) -> str:
    if U.has("Default_Ignorable_Code_Point", char):
        return ""
    folded = char
    for _ in range(4):
        new = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", folded).casefold())
        new = "".join(c for c in new if not U.has("Default_Ignorable_Code_Point", c))
        if new == folded:
            break
        folded = new
    return unicodedata.normalize("NFKD", folded) if len(folded) > 1 and unicodedata.normalize("NFC", folded) != folded else folded


def nfkc_casefold(text: str) -> str:
    """NFKC_Casefold: per code point, then NFC."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", "".join(map(_nfkc_cf, require_well_formed(text))))


def lowercase(text: str) -> str:
    """Default lower case with the Final_Sigma context."""
    out = []
    for k, c in enumerate(text):
        if c != "\u03a3":
            out.append("i\u0307" if c == "\u0130" else c.lower())
            continue
        before = next((x for x in reversed(text[:k]) if not U.has("Case_Ignorable", x)), "")
        after = next((x for x in text[k + 1 :] if not U.has("Case_Ignorable", x)), "")
        out.append("\u03c2" if before and U.has("Cased", before) and not (after and U.has("Cased", after)) else "\u03c3")
    return "".join(out)


@lru_cache(None)
def width_map() -> dict[int, str]:
    """Wide and narrow characters and what they stand for."""
    out = {}
    for c in range(0x3000, 0x10000):
        kind = unicodedata.decomposition(chr(c))
        if kind.startswith(("<wide>", "<narrow>")):
            out[c] = "".join(chr(int(x, 16)) for x in kind.split()[1:])
    return out


# --- encodings ----------------------------------------------------------------


def decode_utf8(data: bytes) -> tuple[str, list[tuple[int, int]]]:
    """Text with one U+FFFD per maximal invalid part, and the (start, end) of each."""
    bad: list[tuple[int, int]] = []

    def note(e: UnicodeDecodeError) -> tuple[str, int]:
        bad.append((e.start, e.end))
        return "\ufffd", e.end

    codecs.register_error("textfacts.note", note)
    return data.decode("utf-8", "textfacts.note"), bad


def decode_utf16le(data: bytes) -> tuple[str, list[tuple[int, int]]]:
    """The same for UTF-16LE: lone units and odd tails, a high unit with an odd tail once."""
    out, bad, at, n = [], [], 0, len(data)
    while at < n:
        if at + 1 >= n:
            out.append("\ufffd")
            bad.append((at, n))
            break
        unit = data[at] | data[at + 1] << 8
        if 0xD800 <= unit < 0xDC00:
            if at + 3 < n and 0xDC00 <= (low := data[at + 2] | data[at + 3] << 8) < 0xE000:
                out.append(chr(0x10000 + ((unit - 0xD800) << 10) + (low - 0xDC00)))
                at += 4
                continue
            end = n if at + 3 == n else at + 2
            out.append("\ufffd")
            bad.append((at, end))
            at = end
        elif 0xDC00 <= unit < 0xE000:
            out.append("\ufffd")
            bad.append((at, at + 2))
            at += 2
        else:
            out.append(chr(unit))
            at += 2
    return "".join(out), bad


DECODERS = {"utf-8": decode_utf8, "utf-16le": decode_utf16le}


def transcode(data: bytes, source: str, target: str, lossy: bool) -> dict:
    if source not in DECODERS or target not in DECODERS:
        raise TextFactError("UNSUPPORTED_ENCODING", encoding=source if source not in DECODERS else target)
    text, bad = DECODERS[source](data)
    if bad and not lossy:
        raise TextFactError("DECODE_FAILED", firstInvalidByte=bad[0][0])
    bom = {"utf-8": b"\xef\xbb\xbf", "utf-16le": b"\xff\xfe"}[source]
    return {"text": text, "encoded": text.encode(target), "bom": source if data.startswith(bom) else None, "replacements": bad, "round_trip": not bad and text.encode(source) == data}


# --- alignment ----------------------------------------------------------------


#: Bits of rows that an alignment keeps at once; of longer pairs only every so many rows are kept, the others made again.
KEPT_BITS = 1 << 28


class _Masks(dict):
    """The places of an item as bits, kept for as many items as there is room for."""

    def __init__(self, where: dict[str, list[int]], size: int):
        super().__init__()
        self.where, self.bytes, self.room = where, (size + 7) // 8, KEPT_BITS // (size + 1)

    def __missing__(self, x: str) -> int:
        bits = bytearray(self.bytes)
        for k in self.where[x]:
            bits[k >> 3] |= 1 << (k & 7)
        out = int.from_bytes(bits, "little")
        if len(self) < self.room:
            self[x] = out
        return out


def align(left: Sequence[str], right: Sequence[str]) -> list[tuple[str, int, int, int, int]]:
    """(kind, left start, left end, right start, right end): equal, replace, insert, delete.

    A longest common subsequence; ties take the highest split of the right side at
    every item of the left one, and the first match of the first item.  Rows of
    lengths are bits of an integer: a 0 where the length grows (Crochemore et al.,
    Hyyro).  From the end, an item is left out where the row before is as long, and
    else meets the last of its kind: the path of the highest splits.
    """
    n, m = len(left), len(right)
    if left == right:
        return [("equal", 0, n, 0, n)] if n else []
    where: dict[str, list[int]] = {}
    for k, x in enumerate(right):
        where.setdefault(x, []).append(k)
    masks = _Masks(where, m)
    full = (1 << m) - 1
    items = [(k, x) for k, x in enumerate(left) if x in where]  # no other item can meet anything
    step = max(len(items) if len(items) <= masks.room else isqrt(len(items)), 1)

    def rows(row: int, start: int) -> list[int]:
        out = [row]
        for _, x in items[start : start + step]:
            same = row & masks[x]
            row = (row + same | row ^ same) & full
            out.append(row)
        return out

    heads = [full]
    for start in range(0, len(items) - step, step):
        heads.append(rows(heads[-1], start)[-1])
    first = {x: v[0] for x, v in where.items()}
    runs, i, j, end, low = [], -1, -1, m, full
    for block in range(len(heads) - 1, -1, -1):
        made = rows(heads[block], block * step)
        changed = list(map(xor, made, islice(made, 1, None)))
        for (k, x), bits in zip(reversed(items[block * step : (block + 1) * step]), reversed(changed)):
            if not k:
                if (y := first[x]) >= end:
                    break
            elif (bits & low).bit_count() & 1:  # as many more as one: the row grows up to here
                held = where[x]
                y = held.pop()
                while y >= end:
                    y = held.pop()
                low >>= end - y
                end = y
            else:
                continue
            if k + 1 == i and y + 1 == j:
                runs[-1][:2] = k, y
            else:
                runs.append([k, y, k + 1])
            i, j = k, y
    out: list[tuple[str, int, int, int, int]] = []
    i = j = 0
    for x, y, stop in [*reversed(runs), [n, m, n]]:
        if x > i or y > j:
            out.append(("replace" if x > i and y > j else "delete" if x > i else "insert", i, x, j, y))
        i, j = stop, y + stop - x
        if stop > x:
            out.append(("equal", x, i, y, j))
    return out


# --- identifiers and confusables ----------------------------------------------


def resolve_scripts(text: str) -> tuple[str, list[str]]:
    """('all' | 'empty' | 'set', scripts) of the intersection of augmented script sets."""
    found: frozenset[str] | None = None
    for c in text:
        own = U.augmented_scripts(c)
        if own is not None:
            found = own if found is None else found & own
    return ("all", []) if found is None else ("set", sorted(found)) if found else ("empty", [])


def mixed_numbers(text: str) -> bool:
    return len({ord(c) - unicodedata.decimal(c) for c in text if unicodedata.decimal(c, None) is not None}) > 1


def restriction_level(text: str, allowed: frozenset[str]) -> str:
    """Restriction level of UTS #39, section 5.2."""
    if any(c not in allowed for c in text):
        return "unrestricted"
    if text.isascii():
        return "ascii_only"
    if resolve_scripts(text)[0] != "empty":
        return "single_script"
    sets = [s for c in text if (s := U.augmented_scripts(c)) is not None]
    for cover in ({"Latn", "Jpan"}, {"Latn", "Hanb"}, {"Latn", "Kore"}):
        if all(s & cover for s in sets):
            return "highly_restrictive"
    rest = [s for s in sets if "Latn" not in s]
    common = frozenset.intersection(*rest) if rest else frozenset()
    if any(s in U.RECOMMENDED_SCRIPTS - {"Cyrl", "Grek", "Latn", "Zyyy", "Zinh"} for s in common):
        return "moderately_restrictive"
    return "minimally_restrictive"


def xid_failures(text: str) -> list[tuple[int, str | None]]:
    if not text:
        return [(0, None)]
    return [(k, label(c)) for k, c in enumerate(text) if not U.has("XID_Continue" if k else "XID_Start", c)]


def skeleton(text: str, prototype: dict[str, str]) -> str:
    """UTS #39 skeleton of text in display order."""
    d = unicodedata.normalize("NFD", text)
    return unicodedata.normalize("NFD", "".join(prototype.get(c, c) for c in d if not U.has("Default_Ignorable_Code_Point", c)))


def bidi_skeleton(text: str, prototype: dict[str, str], direction: str = "LTR") -> str:
    from .bidi import display_order

    return skeleton(display_order(require_well_formed(text), direction), prototype)


class _Prototypes(dict):
    """For str.translate: what each character becomes in a skeleton, worked out once."""

    def __init__(self, prototype: dict[str, str]):
        super().__init__()
        self.prototype = prototype

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = out = "" if U.has("Default_Ignorable_Code_Point", c) else self.prototype.get(c, c)
        return out


def skeletons(prototype: dict[str, str], direction: str = "LTR") -> Callable[[str], str]:
    """:func:`bidi_skeleton` for many texts: properties of characters are looked up once each."""
    from .bidi import display_order, needs_levels

    table, plain = _Prototypes(prototype), set()

    def run(text: str) -> str:
        if direction == "RTL" or not plain.issuperset(text):
            if direction == "RTL" or needs_levels(require_well_formed(text)):
                text = display_order(require_well_formed(text), direction)
            else:
                plain.update(text)
        return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(table))

    return run


def confusable(left: str, right: str, prototype: dict[str, str], direction: str = "LTR") -> dict:
    same = bidi_skeleton(left, prototype, direction) == bidi_skeleton(right, prototype, direction)
    (lk, ls), (rk, rs) = resolve_scripts(left), resolve_scripts(right)
    kind = None
    if same and left != right:
        shared = set(ls) & set(rs)
        single = lk == rk == "set"
        kind = "single_script" if single and shared else "whole_script" if single else "mixed_script"
    return {"relation": "identical" if left == right else "confusable" if same else "not_confusable", "class": kind, "uts39Confusable": same}
