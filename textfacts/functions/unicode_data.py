"""Unicode properties by rule, without tables in the package.

Properties come from the ``regex`` library's data, normalisation from Python's
``unicodedata``; the identifier and confusable data of UTS #39 are asked of ICU in
Spark's own JVM once, on the driver (:func:`uts39_tables`), and travel to the
executors inside the kernels that need them.
"""

from __future__ import annotations

from functools import lru_cache

import regex

#: Long names of Bidi_Class, as the ``regex`` library spells them.
BIDI_CLASSES = ["L", "R", "AL", "EN", "ES", "ET", "AN", "CS", "NSM", "BN", "B", "S", "WS", "ON", "LRE", "LRO", "RLE", "RLO", "PDF", "LRI", "RLI", "FSI", "PDI"]
GENERAL_CATEGORIES = ["Lu", "Ll", "Lt", "Lm", "Lo", "Mn", "Mc", "Me", "Nd", "Nl", "No", "Pc", "Pd", "Ps", "Pe", "Pi", "Pf", "Po", "Sm", "Sc", "Sk", "So", "Zs", "Zl", "Zp", "Cc", "Cf", "Cs", "Co", "Cn"]
JOINING_TYPES = ["C", "D", "R", "L", "T", "U"]
#: Script codes that occur in Script and Script_Extensions.
SCRIPTS = (
    "Adlm Aghb Ahom Arab Armi Armn Avst Bali Bamu Bass Batk Beng Bhks Bopo Brah Brai Bugi Buhd Cakm Cans Cari Cham Cher Chrs Copt Cpmn Cprt Cyrl Deva Diak Dogr Dsrt Dupl Egyp Elba Elym Ethi Gara Geor Glag Gong Gonm Goth Gran Grek Gujr Gukh Guru "
    "Hang Hani Hano Hatr Hebr Hira Hluw Hmng Hmnp Hung Ital Java Kali Kana Kawi Khar Khmr Khoj Kits Knda Krai Kthi Lana Laoo Latn Lepc Limb Lina Linb Lisu Lyci Lydi Mahj Maka Mand Mani Marc Medf Mend Merc Mero Mlym Modi Mong Mroo Mtei Mult Mymr "
    "Nagm Nand Narb Nbat Newa Nkoo Nshu Ogam Olck Onao Orkh Orya Osge Osma Ougr Palm Pauc Perm Phag Phli Phlp Phnx Plrd Prti Rjng Rohg Runr Samr Sarb Saur Sgnw Shaw Shrd Sidd Sind Sinh Sogd Sogo Sora Soyo Sund Sunu Sylo Syrc "
    "Tagb Takr Tale Talu Taml Tang Tavt Telu Tfng Tglg Thaa Thai Tibt Tirh Tnsa Todr Toto Tutg Ugar Vaii Vith Wara Wcho Xpeo Xsux Yezi Yiii Zanb Zinh Zyyy"
).split()
#: Scripts that UAX #31 recommends for identifiers.
RECOMMENDED_SCRIPTS = frozenset("Arab Armn Beng Bopo Cyrl Deva Ethi Geor Grek Gujr Guru Hang Hani Hebr Hira Kana Khmr Knda Laoo Latn Mlym Mymr Orya Sinh Taml Telu Thaa Thai Tibt Zyyy Zinh".split())


@lru_cache(None)
def _pattern(prop: str) -> regex.Pattern | None:
    try:
        return regex.compile(rf"\p{{{prop}}}")
    except regex.error:
        return None


@lru_cache(200_000)
def has(prop: str, char: str) -> bool:
    """Whether the character has a property, e.g. ``has("XID_Start", "a")``."""
    p = _pattern(prop)
    return p is not None and p.match(char) is not None


@lru_cache(200_000)
def general_category(char: str) -> str:
    return next((g for g in GENERAL_CATEGORIES if has(f"gc={g}", char)), "Cn")


@lru_cache(200_000)
def bidi_class(char: str) -> str:
    return next((b for b in BIDI_CLASSES if has(f"bc={b}", char)), "L")


@lru_cache(200_000)
def joining_type(char: str) -> str:
    return next((j for j in JOINING_TYPES if has(f"jt={j}", char)), "U")


@lru_cache(200_000)
def scripts(char: str) -> tuple[str, ...]:
    """Script extensions of a character, sorted; its script where it has none."""
    found = tuple(s for s in SCRIPTS if has(f"scx={s}", char))
    return found or ("Zzzz",)


@lru_cache(200_000)
def augmented_scripts(char: str) -> frozenset[str] | None:
    """Augmented script set of UTS #39; None stands for all scripts."""
    own = set(scripts(char))
    if own & {"Zyyy", "Zinh"}:
        return None
    if "Hani" in own:
        own |= {"Hanb", "Jpan", "Kore"}
    if own & {"Hira", "Kana"}:
        own.add("Jpan")
    if "Hang" in own:
        own.add("Kore")
    if "Bopo" in own:
        own.add("Hanb")
    return frozenset(own)


@lru_cache(None)
def characters(prop: str) -> str:
    """All characters with a property, for small sets."""
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    return "".join(regex.findall(rf"\p{{{prop}}}", everything))


#: Mirrored partners and paired brackets, from ICU; empty until :func:`use` is given the tables.
MIRRORS: dict[str, str] = {}
BRACKETS: dict[str, tuple[str, str]] = {}
_TABLES: dict = {}


def use(tables: dict) -> None:
    """Lets this process mirror by the tables; kernels call it in their workers."""
    if not MIRRORS:
        MIRRORS.update(tables["mirrors"])
        BRACKETS.update(tables["brackets"])


def _mirror_tables(jvm) -> tuple[dict[str, str], dict[str, tuple[str, str]]]:
    """Partner of every mirrored character that has one; ('o' or 'c', canonical opening bracket) of every paired bracket."""
    import unicodedata

    char, prop = jvm.com.ibm.icu.lang.UCharacter, jvm.com.ibm.icu.lang.UProperty
    mirrors, brackets = {}, {}
    for c in characters("Bidi_Mirrored"):
        if (m := chr(char.getMirror(ord(c)))) != c:
            mirrors[c] = m
        # Values of the property: 0 none, 1 open, 2 close.
        if kind := char.getIntPropertyValue(ord(c), prop.BIDI_PAIRED_BRACKET_TYPE):
            opening = c if kind == 1 else chr(char.getBidiPairedBracket(ord(c)))
            brackets[c] = "oc"[kind - 1], unicodedata.normalize("NFD", opening)
    return mirrors, brackets


def uts39_tables(spark) -> dict:
    """Prototypes by character, the allowed characters, mirrors and brackets, from ICU on the driver."""
    if not _TABLES:
        import unicodedata

        jvm = spark._jvm
        checker = getattr(jvm.com.ibm.icu.text, "SpoofChecker$Builder")().build()
        assigned = [chr(c) for c in range(0x21, 0x110000) if not 0xD800 <= c < 0xE000 and not 0xE000 <= c < 0xF900 and c < 0xE0200 and unicodedata.category(chr(c)) != "Cn"]
        prototype = {}
        for at in range(0, len(assigned), 4000):
            part = [c for c in assigned[at : at + 4000] if unicodedata.normalize("NFD", c) == c]
            for c, s in zip(part, checker.getSkeleton("\n".join(part)).split("\n")):
                if s != c and not has("Default_Ignorable_Code_Point", c):
                    prototype[c] = s
        allowed = set()
        for held in (jvm.com.ibm.icu.text.SpoofChecker.RECOMMENDED, jvm.com.ibm.icu.text.SpoofChecker.INCLUSION):
            for k in range(held.getRangeCount()):
                allowed.update(map(chr, range(held.getRangeStart(k), held.getRangeEnd(k) + 1)))
        mirrors, brackets = _mirror_tables(jvm)
        _TABLES.update(prototype=prototype, allowed=frozenset(allowed), mirrors=mirrors, brackets=brackets)
        use(_TABLES)
    return _TABLES


#: Identifier_Type of UTS #39 in the order of ICU's constants, which start at Not_Character.
IDENTIFIER_TYPES = ["Not_Character", "Deprecated", "Default_Ignorable", "Not_NFKC", "Not_XID", "Exclusion", "Obsolete", "Technical", "Uncommon_Use", "Limited_Use", "Inclusion", "Recommended"]


def report_tables(spark) -> dict:
    """:func:`uts39_tables` with the ranges of every identifier type, which reports on identifiers need."""
    tables = uts39_tables(spark)
    if "types" not in tables:
        icu = spark._jvm.com.ibm.icu
        types = {}
        for value, name in enumerate(IDENTIFIER_TYPES[1:], 1):
            held = icu.text.UnicodeSet()
            held.applyIntPropertyValue(icu.lang.UProperty.IDENTIFIER_TYPE, value)
            types[name] = [(held.getRangeStart(k), held.getRangeEnd(k)) for k in range(held.getRangeCount())]
        tables["types"] = types
    return tables
