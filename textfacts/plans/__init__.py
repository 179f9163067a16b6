"""Dispatch by operation name, builder-time validation, limits, SQL names and identities."""

from __future__ import annotations

import platform

import pyspark
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions import kernels as K
from ..functions import unicode_data as U
from ..functions.kernels import TextFactError

#: Limits of strict mode.
LIMITS = {"text": 4096, "pair": 8192, "security_pair": 4096, "detail": 128, "locale": 128, "result": 65_536, "spans": 128, "scope": 64, "chunk": 4096, "chunks": 128, "items": 512, "relations": 5, "id": 128}
#: operation -> (argument columns, options)
OPERATIONS = {
    "inspect": (("text",), ("detail_limit",)),
    "normalize": (("text",), ("form", "witness")),
    "compare": (("left", "right"), ("locale", "sensitivity", "numeric", "ignorePunctuation", "caseFirst", "collation")),
    "transcode": (("bytes",), ("source", "target", "lossy", "witness")),
    "security": (("text",), ("mode", "profile", "detail_limit")),
    "security_pair": (("text", "comparison"), ("profile", "direction", "detail_limit")),
    "security_source": (("source", "spans"), ("direction", "detail_limit")),
    "explain_difference": (("left", "right"), ("direction", "detail_limit", "witness")),
    "index": (("text",), ("max_chunk_bytes", "max_chunks")),
    "protocol_profile": (("text",), ("profile", "action", "witness", *("use_std3", "check_bidi", "check_hyphens", "check_joiners", "verify_dns_length", "transitional", "ignore_invalid_punycode"))),
}


def _check(operation: str, options: dict) -> tuple[str, ...]:
    if operation not in OPERATIONS:
        raise TextFactError("UNKNOWN_OPERATION", operation=operation)
    arguments, known = OPERATIONS[operation]
    if unknown := sorted(set(options) - set(known)):
        raise TextFactError("INVALID_INPUT", unknown=unknown)
    return arguments


def build(operation: str, *columns: str | Column, spark: SparkSession | None = None, **options) -> Column:
    """The result column of an operation over its argument columns."""
    arguments = _check(operation, options)
    if len(columns) != len(arguments):
        raise TextFactError("INVALID_INPUT", missing=arguments[len(columns) :])
    if operation == "normalize":
        form = options.get("form", "NFC")
        return C.normalization_witness(*columns, form) if options.get("witness") else C.normalize(*columns, form)
    if operation in ("transcode", "protocol_profile") and options.pop("witness", False):
        return getattr(C, f"{operation.removesuffix('_profile')}_witness")(*columns, **options)
    if operation == "explain_difference":
        tables = U.uts39_tables(spark or SparkSession.active()) if options.get("direction") else None
        return C.difference_report(*columns, tables, **options)
    if operation.startswith("security"):
        tables = U.report_tables(spark or SparkSession.active())
        if operation == "security_source":
            return C.source_report(*columns, tables, **({"direction": None} | options))
        if operation == "security_pair":
            return C.security_report(columns[0], tables, "identifier", comparison=columns[1], **options)
        return C.security_report(columns[0], tables, **options)
    return getattr(C, operation)(*columns, **options)


def apply(operation: str, df: DataFrame, *columns: str, limits: str = "off", alias: str = "result", **options) -> DataFrame:
    """``df`` with the operation's struct as one more column.

    ``limits='strict'`` adds ``<alias>_error``: the code of a row that exceeds the
    text or the result budget, whose result is then null.  Options beyond their
    limits are refused at once.
    """
    if limits == "strict":
        options = _strict(operation, options)
    out = build(operation, *columns, spark=df.sparkSession, **options)
    if limits != "strict":
        return df.withColumn(alias, out)
    texts = columns[:1] if operation == "security_source" else columns
    size = sum((F.octet_length(c) for c in texts[1:]), F.octet_length(texts[0]))
    most = LIMITS["security_pair"] if operation == "security_pair" else LIMITS["pair"] if len(texts) > 1 else LIMITS["text"]
    split = df.withColumn(f"{alias}_error", F.when(size > most, F.lit("REQUEST_TOO_LARGE")))
    fits = F.col(f"{alias}_error").isNull()
    # Masked inputs: a condition around a kernel would not keep it from running.
    masked = split.withColumns({f"__arg{k}": F.when(fits, F.col(c)) for k, c in enumerate(columns)})
    done = masked.withColumn(alias, build(operation, *[f"__arg{k}" for k in range(len(columns))], spark=df.sparkSession, **options))
    large = F.coalesce(F.octet_length(F.to_json(F.struct(alias))) > LIMITS["result"], F.lit(False))
    done = done.withColumn(f"{alias}_error", F.coalesce(f"{alias}_error", F.when(large, F.lit("RESULT_TOO_LARGE"))))
    return done.withColumn(alias, F.when(~large, F.col(alias))).drop(*[f"__arg{k}" for k in range(len(columns))])


def _strict(operation: str, options: dict) -> dict:
    """The options under the limits of strict mode; INVALID_INPUT beyond them."""
    bounds = {"detail_limit": (0, LIMITS["detail"]), "max_chunk_bytes": (1, LIMITS["chunk"])}
    for name, (least, most) in bounds.items():
        if options.get(name) is not None and not least <= options[name] <= most:
            raise TextFactError("INVALID_INPUT", field=name, minimum=least, maximum=most)
    if len(options.get("locale", "")) > LIMITS["locale"]:
        raise TextFactError("INVALID_INPUT", field="locale", maximum=LIMITS["locale"])
    return options | {"max_chunks": LIMITS["chunks"]} if operation == "index" and options.get("max_chunk_bytes") else options


def register(spark: SparkSession) -> list[str]:
    """Registers the one-text kernels for SQL under ``tf_<name>`` and returns the names."""
    plain = {"tf_nfkc_casefold": K.nfkc_casefold, "tf_lowercase": K.lowercase, **{f"tf_{f.lower()}": (lambda t, f=f: K.normalize(t, f)) for f in K.FORMS}}

    for name, function in plain.items():
        def run(series, function=function):
            return series.map(lambda t: None if t is None else function(t))

        run.__annotations__ = {"series": "pandas.Series", "return": "pandas.Series"}
        spark.udf.register(name, F.pandas_udf(run, T.StringType(), F.PandasUDFType.SCALAR))

    @F.udtf(returnType="idx: int, chunk: string")
    class TfChunks:
        def eval(self, text: str, max_bytes: int):
            for k, part in enumerate(K.chunk(text, max_bytes) if text is not None else []):
                yield k, part

    @F.udtf(returnType="idx: int, grapheme: string")
    class TfGraphemes:
        def eval(self, text: str):
            yield from enumerate(K.graphemes(text) if text is not None else [])

    spark.udtf.register("tf_chunks", TfChunks)
    spark.udtf.register("tf_graphemes", TfGraphemes)
    return [*plain, "tf_chunks", "tf_graphemes"]


def catalogue(spark: SparkSession) -> DataFrame:
    """operation, arguments, options of everything :func:`build` knows."""
    return spark.createDataFrame([(k, list(a), list(o)) for k, (a, o) in OPERATIONS.items()], "operation string, arguments array<string>, options array<string>")


def identity(spark: SparkSession) -> dict[str, str]:
    """Versions of what results depend on."""
    import unicodedata

    import regex

    return {"spark": spark.version, "pyspark": pyspark.__version__, "python": platform.python_version(), "java": spark._jvm.System.getProperty("java.version"), "normalization": unicodedata.unidata_version, "properties": f"regex {regex.__version__}", "icu": spark._jvm.com.ibm.icu.util.VersionInfo.ICU_VERSION.toString()}
