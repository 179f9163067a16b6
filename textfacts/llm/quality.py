"""Quality rules with adaptive thresholds.

Each text is measured by built-in expressions over its own row (no shuffle, no
Python).  The measures that set thresholds become mergeable quantile sketches
per (lang, source): a histogram whose buckets have a relative width of 1/64, so
sketches merge by adding counts, in any order, with the same result.  Thresholds
come from the sketch's quartiles and are joined back to every row.

The table is read twice: once for the sketches, which need no repeated windows, and
once for the verdicts.  Nothing in between holds a text, so no copy of the table is
written and a row with all its columns passes through once.

A sketch over fewer than ``MIN_ROWS`` rows says little about its source: it is
merged with those of its language, and then with all, until there are enough.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh_name, materialize, table

WINDOW = 5
MIN_ROWS = 50
#: Fence: quartile plus this many interquartile ranges.
FENCE = 4
#: Measures with a verdict, in integers, and the least spread each is given:
#: without it a source in which nearly all rows agree would reject every other.
SPREAD = {"symbols_ppm": 60_000, "dup_lines_ppm": 100_000, "word_milli": 700}
#: More threshold rows than this are joined by a shuffle, not by a broadcast.
BROADCAST_GROUPS = 50_000
#: What travels with a row from one projection to the next.
CARRY = "__textfacts_quality__"


def _strip(text: str, chars: str) -> str:
    """SQL for ``text`` without any of ``chars``: plain byte searches, no regular expression."""
    for c in chars:
        text = f"replace({text}, {_quoted(c)}, '')"
    return text


def _quoted(c: str) -> str:
    return f"'\\u{ord(c):04X}'"


def _blanked(text: str) -> str:
    """SQL for ``text`` with each of the other ASCII blanks as a space."""
    for c in "\t\n\x0b\x0c\r":
        text = f"replace({text}, {_quoted(c)}, ' ')"
    return text


def _let(value: str, name: str, body: str) -> str:
    """SQL that evaluates ``value`` once, as ``name``, inside ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _repeat_words() -> str:
    """SQL for n_repeat_words from the array ``words``.

    The 5-word windows are hashed; a text whose hashes all differ has no repeat.
    Only where two hashes agree are the windows themselves compared: sorted with
    their places, a window that equals a neighbour is one found twice or more.
    Each such place covers five words, counted once where windows overlap.
    """
    starts = f"sequence(0, size(words) - {WINDOW})"
    at = ", ".join(f"words[i + {k}]" for k in range(WINDOW))
    places = (
        "sort_array(filter(transform(ordered, (x, k) -> CASE WHEN (k > 0 AND ordered[greatest(k - 1, 0)].w = x.w) "
        "OR (k + 1 < size(ordered) AND ordered[least(k + 1, size(ordered) - 1)].w = x.w) THEN x.i END), p -> p IS NOT NULL))"
    )
    covered = f"aggregate(transform(places, (p, k) -> CASE WHEN k + 1 < size(places) THEN least({WINDOW}, places[least(k + 1, size(places) - 1)] - p) ELSE {WINDOW} END), 0L, (a, x) -> a + x)"
    exact = _let(f"sort_array(transform({starts}, i -> struct(concat_ws(' ', {at}) AS w, i AS i)))", "ordered", _let(places, "places", covered))
    maybe = _let(f"transform({starts}, i -> xxhash64({at}))", "hashes", f"CASE WHEN size(array_distinct(hashes)) < size(hashes) THEN {exact} ELSE 0L END")
    return f"CASE WHEN size(words) > {WINDOW} THEN {maybe} ELSE 0L END"


def verdict_column(docs: DataFrame) -> str:
    """The name of the struct that :func:`quality_verdicts` adds to ``docs``: ``CARRY``, or a longer one if that is taken."""
    return fresh_name(docs, CARRY)


def measure(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", repeats: bool = True) -> DataFrame:
    """``docs`` with one more column, the struct ``verdict_column(docs)`` of counts and measures.

    Without ``repeats`` the struct lacks the two counts that need the repeated windows.
    """
    name = verdict_column(docs)
    t = f"coalesce(`{text_col}`, '')"
    words = f"array_remove(split({_blanked(t)}, ' '), '')"
    blanks = "' \\t\\u000B\\u000C\\r'"
    lines = f"filter(split({t}, '\\n'), x -> trim(BOTH {blanks} FROM x) <> '')"
    of_words = _let(words, "words", "struct(cast(size(words) as bigint) AS n_words, cast(length(array_join(words, '')) as bigint) AS word_chars" + (f", {_repeat_words()} AS n_repeat_words)" if repeats else ")"))
    of_lines = _let(lines, "lines", "struct(cast(size(lines) as bigint) AS n_lines, cast(size(lines) - size(array_distinct(lines)) as bigint) AS n_dup_lines)")
    symbols = f"cast(length({t}) - length({_strip(t, '#*$%&|<>')}) as bigint)"
    # Columns of their own: the optimizer would inline the parts of one struct into each of their uses.
    parts = {"w": of_words, "l": of_lines, "n_symbols": symbols}
    counts = docs.withColumns({name + k: F.expr(e) for k, e in parts.items()})
    c = lambda k: F.col(name + k)
    n_words, some = c("w.n_words"), c("w.n_words") > 0
    share = lambda top, scale, of: F.when(some, F.expr(f"{name}{top} * {scale}L div {name}{of}")).otherwise(F.lit(0).cast("long"))
    repeated = [c("w.n_repeat_words").alias("n_repeat_words"), ((n_words < 10) | (100 * c("w.n_repeat_words") > 20 * n_words)).alias("base_failed")] if repeats else []
    return counts.withColumn(
        name,
        F.struct(
            F.col(lang_col).alias("lang"),
            F.col(source_col).alias("source"),
            n_words.alias("n_words"),
            c("w.word_chars").alias("word_chars"),
            c("n_symbols").alias("n_symbols"),
            c("l.n_dup_lines").alias("n_dup_lines"),
            *repeated,
            share("n_symbols", 1_000_000, "w.n_words").alias("symbols_ppm"),
            share("l.n_dup_lines", 1_000_000, "l.n_lines").alias("dup_lines_ppm"),
            share("w.word_chars", 1000, "w.n_words").alias("word_milli"),
        ),
    ).drop(*[name + k for k in parts])


def sketch(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, measure, bucket, n: mergeable histograms of the rows that have words."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    measured = measure(rows, repeats=False).select(f"{CARRY}.*")
    each = F.array(*[F.struct(F.lit(k).alias("measure"), F.col(k).alias("x")) for k in SPREAD])
    return (
        measured.filter(F.col("n_words") > 0)
        .select("lang", "source", F.explode(each).alias("m"))
        .select("lang", "source", "m.measure", F.expr("greatest(length(bin(m.x)) - 7, 0)").alias("e"), "m.x")
        .select("lang", "source", "measure", F.expr("e * 128L + shiftright(x, e)").alias("bucket"))
        .groupBy("lang", "source", "measure", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def thresholds(histograms: DataFrame) -> DataFrame:
    """low and high fence of each measure per lang and source, from merged sketches."""
    def quartiles(level: DataFrame, keys: list[str], tag: str) -> DataFrame:
        by = [*keys, "measure"]
        up = W.partitionBy(*by).orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
        ranked = level.withColumn("upto", F.sum("n").over(up)).withColumn("total", F.sum("n").over(W.partitionBy(*by)))
        value = F.expr("CASE WHEN bucket < 128 THEN bucket ELSE shiftleft(bucket % 128, cast(bucket div 128 as int)) END")
        return ranked.groupBy(*by).agg(
            F.max("total").alias(f"rows_{tag}"),
            F.min(F.when(F.col("upto") * 4 >= F.col("total"), value)).alias(f"q1_{tag}"),
            F.min(F.when(F.col("upto") * 4 >= F.col("total") * 3, value)).alias(f"q3_{tag}"),
        )

    per_lang = histograms.groupBy("lang", "measure", "bucket").agg(F.sum("n").alias("n"))
    over_all = per_lang.groupBy("measure", "bucket").agg(F.sum("n").alias("n"))
    a, b, c = quartiles(histograms, ["lang", "source"], "a"), quartiles(per_lang, ["lang"], "b"), quartiles(over_all, [], "c")
    b = b.withColumnRenamed("lang", "lang_b").withColumnRenamed("measure", "measure_b")
    all_levels = a.join(b, a.lang.eqNullSafe(b.lang_b) & (a.measure == b.measure_b)).join(c.withColumnRenamed("measure", "measure_c"), F.col("measure") == F.col("measure_c"))
    pick = lambda q: F.when(F.col("rows_a") >= MIN_ROWS, F.col(f"{q}_a")).when(F.col("rows_b") >= MIN_ROWS, F.col(f"{q}_b")).otherwise(F.col(f"{q}_c"))
    least = F.create_map(*[F.lit(x) for kv in SPREAD.items() for x in kv])[F.col("measure")]
    fenced = all_levels.select("lang", "source", "measure", pick("q1").alias("q1"), pick("q3").alias("q3"), least.alias("least"))
    reach = FENCE * F.greatest(F.col("q3") - F.col("q1"), F.col("least"))
    fenced = fenced.select("lang", "source", "measure", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))
    one = lambda k, x: F.max(F.when(F.col("measure") == k, F.col(x))).alias(f"{x}_{k}")
    return fenced.groupBy("lang", "source").agg(*[one(k, x) for k in SPREAD for x in ("low", "high")])


def quality_verdicts(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """All rows of ``docs``, its columns, and the struct ``verdict_column(docs)``, now with ``kept``.

    Null and empty texts have no words and fail the base rule; null lang or source
    is a value of its own.  Texts in sources too small for a sketch use the merged
    sketch of their language, then of all.  Repeated rows are judged alike; an empty
    table gives an empty result.  Other columns may have any names.
    """
    columns = {"text_col": text_col, "lang_col": lang_col, "source_col": source_col}
    limits = materialize(thresholds(sketch(docs, **columns)))
    name, limit = verdict_column(docs), fresh_name(docs, "__limit_")
    limits = limits.withColumnsRenamed({c: limit + c for c in limits.columns})
    if limits.count() <= BROADCAST_GROUPS:
        limits = F.broadcast(limits)
    q = lambda k: F.col(f"{name}.{k}")
    joined = measure(docs, **columns).join(limits, q("lang").eqNullSafe(F.col(f"{limit}lang")) & q("source").eqNullSafe(F.col(f"{limit}source")), "left")
    within = F.lit(True)
    for k in SPREAD:
        within = within & F.coalesce(q(k).between(F.col(f"{limit}low_{k}"), F.col(f"{limit}high_{k}")), F.lit(True))
    # One expression over both sides: a filter on it cannot be pushed below the join, where it would measure a text again.
    kept = F.when(q("base_failed"), F.lit(False)).otherwise(within)
    return joined.withColumn(name, F.col(name).withField("kept", kept)).select(*docs.columns, name)


def keep_quality(docs: DataFrame, **columns) -> DataFrame:
    """The rows of ``docs`` that are kept, with its own columns."""
    judged = quality_verdicts(docs, **columns)
    return judged.filter(F.col(f"{judged.columns[-1]}.kept")).select(*docs.columns)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and adaptive verdict of every document."""
    rows = quality_verdicts(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return rows.select("doc_id", *[F.col(f"{CARRY}.{k}").alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def _sql() -> str:
    measures = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS measure, {k} AS x, {v} AS least FROM q WHERE n_words > 0" for k, v in SPREAD.items())
    value = "CASE WHEN bucket < 128 THEN bucket ELSE (bucket % 128) << (bucket // 128)::INT END"

    def level(name: str, keys: str) -> str:
        by = f"{keys}measure"
        return (
            f"{name} AS (SELECT {by}, any_value(least) AS least, max(total) AS total, min(CASE WHEN upto * 4 >= total THEN {value} END) AS q1, min(CASE WHEN upto * 4 >= total * 3 THEN {value} END) AS q3 FROM "
            f"(SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {by}) AS total FROM (SELECT {by}, bucket, any_value(least) AS least, count(*) AS n FROM b GROUP BY {by}, bucket)) GROUP BY {by})"
        )

    within = " AND ".join(f"coalesce({k} BETWEEN low_{k} AND high_{k}, true)" for k in SPREAD)
    limits = ", ".join(f"max(CASE WHEN measure = '{k}' THEN low END) AS low_{k}, max(CASE WHEN measure = '{k}' THEN high END) AS high_{k}" for k in SPREAD)
    pick = lambda q: f"CASE WHEN s.total >= {MIN_ROWS} THEN s.{q} WHEN l.total >= {MIN_ROWS} THEN l.{q} ELSE g.{q} END"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
win AS (SELECT rid, i, array_to_string(words[i:i+{WINDOW - 1}], ' ') AS win
        FROM (SELECT rid, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w WHERE len(words) >= {WINDOW})),
rep AS (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM (SELECT *, count(*) OVER (PARTITION BY rid, win) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n FROM rep GROUP BY rid),
q0 AS (SELECT w.rid, doc_id, lang, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
       FROM w LEFT JOIN cov USING (rid)),
q AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        CASE WHEN n_words > 0 THEN n_symbols * 1000000 // n_words ELSE 0 END AS symbols_ppm,
        CASE WHEN n_words > 0 THEN n_dup_lines * 1000000 // n_lines ELSE 0 END AS dup_lines_ppm,
        CASE WHEN n_words > 0 THEN word_chars * 1000 // n_words ELSE 0 END AS word_milli FROM q0),
m AS ({measures}),
b AS (SELECT *, e * 128 + (x >> e) AS bucket FROM (SELECT *, greatest(length(bin(x)) - 7, 0)::INT AS e FROM m)),
{level('s', 'lang, source, ')},
{level('l', 'lang, ')},
{level('g', '')},
f AS (SELECT lang, source, measure, q1 - {FENCE} * greatest(q3 - q1, least) AS low, q3 + {FENCE} * greatest(q3 - q1, least) AS high FROM (
        SELECT s.lang, s.source, s.measure, s.least, {pick('q1')} AS q1, {pick('q3')} AS q3
        FROM s JOIN l ON s.lang IS NOT DISTINCT FROM l.lang AND s.measure = l.measure JOIN g ON s.measure = g.measure)),
lim AS (SELECT lang AS llang, source AS lsource, {limits} FROM f GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ({within}) AS kept
FROM q LEFT JOIN lim ON q.lang IS NOT DISTINCT FROM llang AND q.source IS NOT DISTINCT FROM lsource
"""


OP6_SQL = _sql()
