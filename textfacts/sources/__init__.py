"""Reading requests and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One request per line: the operation and its arguments, as JSON text.
REQUEST = T.StructType([T.StructField("id", T.StringType()), T.StructField("operation", T.StringType()), T.StructField("arguments", T.StringType())])
#: A text given as a scalar string or as UTF-16 code units (which may be unpaired).
TAGGED = T.StructType([T.StructField("kind", T.StringType()), T.StructField("value", T.StringType()), T.StructField("units", T.ArrayType(T.IntegerType()))])


def parse_requests(lines: DataFrame, column: str = "value", max_bytes: int | None = 131_072) -> DataFrame:
    """id, operation, arguments, error from JSON lines; a bad line gives an error row, not a failure."""
    raw = F.col(column)
    valid = F.expr(f"is_valid_utf8({column})")
    parsed = F.from_json(raw, REQUEST)
    code = F.when(raw.isNull() | ~valid, "INVALID_UNICODE").when(F.octet_length(raw) > (max_bytes or 2**31 - 1), "REQUEST_TOO_LARGE").when(parsed["operation"].isNull(), "INVALID_INPUT")
    return lines.select(parsed["id"].alias("id"), parsed["operation"].alias("operation"), parsed["arguments"].alias("arguments"), code.alias("error"))


def read_requests(spark: SparkSession, path: str, **options) -> DataFrame:
    return parse_requests(spark.read.text(path), **options)


def tagged_text(c: str) -> tuple:
    """(text, units) columns of a tagged text: well-formed text as a string, units as UTF-16LE bytes."""
    tag = F.col(c)
    hexed = F.concat_ws("", F.transform(tag["units"], lambda u: F.concat(F.substring(F.lpad(F.hex(u), 4, "0"), 3, 2), F.substring(F.lpad(F.hex(u), 4, "0"), 1, 2))))
    return F.when(tag["kind"] == "unicode_scalar_string", tag["value"]), F.when(tag["kind"] == "utf16_code_units", F.unhex(hexed))


def write_results(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet through Spark's committer: readers see a finished result or none."""
    df.write.mode(mode).parquet(path)
