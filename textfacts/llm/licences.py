"""Licence scanning by sentence rules.

A text is read as a stream of normalised words (letters, digits and plus signs, in
lower case), so that line ends, comment marks and wrapping do not matter.  From every
word at the start of a line, a sentence or a list item the longest sentence known from
licences is taken that ends at a line end or a stop (full stop, exclamation or
question mark, colon, semicolon); what is known becomes an identifier.  Ordered rules
- sequences of identifiers - are then matched against the document's identifiers in the
order they occur, longest rule first; between two identifiers of a rule at most
``GAP`` unknown sentences may stand.  Sentences with a variable part (a holder, a
year, a version) are known by pattern.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

GAP = 2

#: Normalised sentence -> identifier.
SENTENCES = {
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "this project is licensed under the mit license": "mit-notice",
    "mit license": "mit-title",
    "the mit license": "mit-title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit-grant",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-condition",
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": "mit-condition",
    "the software is provided as is without warranty of any kind express or implied": "as-is",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "as-is",
    "licensed under the apache license version 2 0": "apache2-notice",
    "licensed under the apache license version 2 0 the license": "apache2-notice",
    "apache license version 2 0": "apache2-title",
    "you may not use this file except in compliance with the license": "apache2-condition",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2-as-is",
    "see the license for the specific language governing permissions and limitations under the license": "apache2-see",
    "apache license version 2 0 january 2004": "apache2-title",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "all rights reserved": "all-rights",
    "this file is part of the public domain": "public-domain",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0bsd-grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
}
_GNU = r"gnu (lesser |library |affero )?general public license"
#: Patterns over the normalised words -> identifier, tried in this order.
PATTERNS = [
    (rf"(?:\S+ ){{1,12}}?is free software you can redistribute it and or modify it under the terms of the {_GNU}(?: version (\d)(?: (\d))?(?: only)?)? as published by the free software foundation(?: either)?(?: version (\d)(?: (\d))? of the license(?: only)?)?(?: or (?:at your option )?any later version)?", "gpl"),
    (rf"(?:this (?:work|project|program|software|library) is )?(?:licensed|released|distributed) under (?:the )?(?:terms of (?:the )?)?{_GNU}(?: version| v) ?(\d)(?: (\d))?(?: or (?:at your option )?(?:any )?later(?: version)?)?", "gpl"),
    (rf"{_GNU} version (\d)(?: (\d))?(?: \d{{1,2}} [a-z]+ \d{{4}}| [a-z]+ \d{{4}})?", "gpl"),
    (r"(?:this work is )?licensed under (?:a )?(?:creative commons |cc )((?:by|nc|sa|nd)(?: (?:nc|sa|nd))*) (\d)(?: (\d))?", "cc"),
    (r"(?:this work is )?licensed under cc0(?: 1 0)?", "cc0"),
    (r"(?:released|licensed) under the bsd (\d) clause license", "bsd-n"),
    (r"(?:this source code form is subject to the terms of the |the contents of this file are subject to the |(?:released|licensed) under the )?mozilla public license (?:version|v) (\d)(?: (\d))?(?: the license)?", "mpl"),
    (r"you may obtain a copy of the license at(?: https? www apache org licenses license 2 0(?: txt| html)?)?", "apache2-copy"),
    (r"neither the names? of (?:\S+ ){1,30}?(?:nor the names of (?:\S+ ){0,5}?contributors )?may be used to endorse or promote products derived from this software without specific prior written permission", "bsd-name"),
    (r"the names? of (?:\S+ ){1,30}?may not be used to endorse or promote products derived from this software without specific prior written permission", "bsd-name"),
    (r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", "bsd-advert"),
    (r"this software is provided by (?:\S+ ){1,30}?as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", "bsd-as-is"),
    (r"in no event shall (?:\S+ ){1,30}?be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage", "bsd-liability"),
    (r"the software is provided as is and (?:\S+ ){1,30}?disclaims? all warranties with regard to this software including all implied warranties of merchantability and fitness", "isc-as-is"),
    (r"in no event shall (?:\S+ ){1,30}?be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software", "isc-liability"),
    (r"in no event shall (?:\S+ ){1,30}?be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", "mit-liability"),
]
#: Patterns whose variable part goes on to the end of the line or sentence.
OPEN_PATTERNS = [
    (r"spdx license identifier (.+)", "spdx"),
    (r"(?:copyright|c|copyright c) (?:c )?\d{4}.*", "copyright"),
]
#: Ordered rules: the identifiers of a licence's sentences, and the licence.
_BSD3, _BSD2, _END = ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name"), ("bsd-grant", "bsd-source", "bsd-binary"), ("bsd-as-is", "bsd-liability")
_APACHE = ("apache2-notice", "apache2-condition", "apache2-copy")
RULES = [
    (("mit-grant", "mit-condition", "as-is", "mit-liability"), "MIT"),
    (("mit-grant", "mit-condition", "as-is"), "MIT"),
    (("mit-grant", "mit-condition"), "MIT"),
    ((*_APACHE, "apache2-as-is", "apache2-see"), "Apache-2.0"),
    ((*_APACHE, "apache2-as-is"), "Apache-2.0"),
    (_APACHE, "Apache-2.0"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-name", *_END), "BSD-4-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-name"), "BSD-4-Clause"),
    ((*_BSD3, *_END), "BSD-3-Clause"),
    (_BSD3, "BSD-3-Clause"),
    ((*_BSD2, *_END), "BSD-2-Clause"),
    (_BSD2, "BSD-2-Clause"),
    (("isc-grant", "isc-as-is", "isc-liability"), "ISC"),
    (("isc-grant", "isc-as-is"), "ISC"),
    (("isc-grant", "as-is"), "ISC"),
    (("0bsd-grant", "isc-as-is", "isc-liability"), "0BSD"),
    (("0bsd-grant", "isc-as-is"), "0BSD"),
    (("mit-notice",), "MIT"),
    (("mit-title",), "MIT"),
    (("mit-grant",), "MIT"),
    (("apache2-notice",), "Apache-2.0"),
    (("apache2-title",), "Apache-2.0"),
    (("unlicense",), "Unlicense"),
    (("public-domain",), "Public-Domain"),
    (("isc-grant",), "ISC"),
    (("0bsd-grant",), "0BSD"),
    (("cc0",), "CC0-1.0"),
    (("all-rights",), "All-Rights-Reserved"),
]

# A title and a copyright line before a licence belong to it.
_HEADS = [("mit-title", "copyright", "all-rights"), ("mit-title", "copyright"), ("copyright", "all-rights"), ("mit-title",), ("copyright",)]
RULES = [((*head, *rule), licence) for head in _HEADS for rule, licence in RULES if rule[0] in ("mit-grant", "isc-grant", "0bsd-grant", "bsd-grant", "apache2-notice") and ("mit-title" not in head or licence == "MIT")] + RULES
RULES.sort(key=lambda r: -len(r[0]))

_COMPILED = [(re.compile(p), kind) for p, kind in PATTERNS]
_OPEN = [(re.compile(p), kind) for p, kind in OPEN_PATTERNS]
_WORD = re.compile(r"[0-9a-z+]+|©")
#: Before a word that starts a sentence; after a word that ends one.
_STARTS = re.compile(r"\n|[.!?:;][\"')\]\u201d]*\s")
_ENDS = re.compile(r"\n|[\"')\]\u201d]*[.!?:;][\"')\]\u201d]*\s")
_LINE_ENDS = re.compile(r"\n|[\"')\]\u201d]*[.!?][\"')\]\u201d]*\s")
_STOP = re.compile(r"[\"')\]\u201d]*[.!?:;]?")
#: Full ends of sentences, for the gap between two known ones.
_FULL = re.compile(r"[.!?][\"')\]\u201d]*\s|\n[^0-9A-Za-z\n]*\n")
_BULLET = re.compile(r"\n[^0-9a-z\n]*[0-9a-z]{1,3}[.)\]]\s+")
#: Only texts with one of these letters runs can hold a known sentence.
_CLUE = re.compile(r"licen[cs]e|copyright|permission|warranty|compliance|redistribut|rights reserved|public domain|neither the name|spdx|\(c\)|©", re.I)


def _known_words() -> dict:
    """The known sentences as a tree of words; None holds the identifier of the sentence that ends there."""
    tree: dict = {}
    for sentence, kind in SENTENCES.items():
        at = tree
        for word in sentence.split():
            at = at.setdefault(word, {})
        at[None] = kind
    return tree


_TREE = _known_words()


def _patterned(m: re.Match, kind: str) -> str:
    """Identifier of a patterned sentence, with the parameters of its licence."""
    if kind == "gpl":
        family = {"lesser ": "LGPL", "library ": "LGPL", "affero ": "AGPL"}.get(m[1] or "", "GPL")
        major, minor = next(((a, b) for a, b in zip(m.groups()[1::2], m.groups()[2::2]) if a), ("1", None))
        later = "later" in m[0] or not any(m.groups()[1:])
        return f"={family}-{major}.{minor or 0}-{'or-later' if later else 'only'}"
    if kind == "cc":
        return f"=CC-{m[1].upper().replace(' ', '-')}-{m[2]}.{m[3] or 0}"
    if kind == "bsd-n":
        return f"=BSD-{m[1]}-Clause"
    if kind == "mpl":
        return f"=MPL-{m[1]}.{m[2] or 0}"
    return kind


def _sentences(text: str) -> Iterator[tuple[str, int, int]]:
    """(identifier, start, end) of the known sentences of a text, in order."""
    # One character stays one: offsets are those of the text.
    low = "".join(c if len(c) == 1 else "\0" for c in map(str.lower, text)) if not text.isascii() else text.lower()
    spans = [m.span() for m in _WORD.finditer(low)]
    words = [low[a:b].replace("licence", "license").replace("©", "c") for a, b in spans]
    n = len(words)
    stream = " ".join(words)
    at = list(accumulate((len(w) + 1 for w in words), initial=0))  # where words start in the stream
    gaps = [low[b:a] for (_, b), (a, _) in zip(spans, spans[1:])] + [low[spans[-1][1] :]] if spans else []
    ends = [k == n - 1 or _ENDS.search(gap) is not None for k, gap in enumerate(gaps)]
    bullets = {m.end() for m in _BULLET.finditer("\n" + low)}
    following = n - 1
    first_end = [0] * n
    for k in range(n - 1, -1, -1):
        if ends[k] and (k == n - 1 or _LINE_ENDS.search(gaps[k])):
            following = k
        first_end[k] = following
    k = 0
    while k < n:
        if k and not _STARTS.search(gaps[k - 1]) and spans[k][0] + 1 not in bullets:
            k += 1
            continue
        last, found, node, i = -1, None, _TREE, k
        while i < n and (node := node.get(words[i])) is not None:
            if None in node and ends[i]:
                last, found = i, node[None]
            i += 1
        for pattern, kind in _COMPILED:
            if m := pattern.match(stream, at[k]):
                # The longest part that ends at a word that ends a sentence.
                i = bisect_right(at, m.end()) - 1
                while i > last and i >= k:
                    if ends[i] and (part := pattern.fullmatch(stream, at[k], at[i] + len(words[i]))):
                        last, found = i, _patterned(part, kind)
                        break
                    i -= 1
        if found is None:
            for pattern, kind in _OPEN:
                i = first_end[k]
                if pattern.fullmatch(stream, at[k], at[i] + len(words[i])):
                    last, found = i, kind
                    if kind == "spdx":  # the identifier keeps its own spelling, with its line
                        line = text[spans[k][0] : re.compile(r"\)*").match(text, spans[i][1]).end()]
                        found = "=" + re.split(r"(?i)identifier\s*:?\s*", line)[-1].strip()
                    break
        if found is None:
            k += 1
            continue
        yield found, spans[k][0], _STOP.match(text, spans[last][1]).end()
        k = last + 1


def scan(text: str) -> list[tuple[str, int, int]]:
    """(licence, start, end) of each match, in order, by code points of ``text``."""
    if not _CLUE.search(text):
        return []
    known = list(_sentences(text))
    out, at = [], 0
    while at < len(known):
        name = known[at][0]
        if name.startswith("="):
            out.append((name[1:], known[at][1], known[at][2]))
            at += 1
            continue
        for rule, licence in RULES:
            part = known[at : at + len(rule)]
            if tuple(k[0] for k in part) == rule and all(len(_FULL.findall(text, a[2], b[1])) <= GAP + 1 for a, b in zip(part, part[1:])):
                out.append((licence, part[0][1], part[-1][2]))
                at += len(rule)
                break
        else:
            at += 1
    return out


def licence_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, licences (distinct, in order of first match), matches (licence, start, end).

    Every row gives a row; null and empty texts have no match; repeated rows give
    repeated results; other columns are not read.
    """
    schema = "doc_id long, licences array<string>, matches array<struct<licence:string,start:int,end:int>>"
    kind = pa.list_(pa.struct([("licence", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(t.as_py() or "") for t in batch.column(1)]
            names = [list(dict.fromkeys(m[0] for m in f)) for f in found]
            spans = [[dict(zip(("licence", "start", "end"), m)) for m in f] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.list_(pa.string())), pa.array(spans, kind)], ["doc_id", "licences", "matches"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document, in order of first match."""
    found = licence_scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("licences", ",").alias("licences"), F.size("matches").cast("long").alias("n_matches"))
