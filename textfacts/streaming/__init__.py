"""Text facts over streams.  Per-row operations need no state; their rows are the same in a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_table_stream(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def run_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the stream's rows to parquet exactly once, and stops when the input is read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, by: str, *, ts: str = "ts", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows per window and value; rows later than the watermark are dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")


def once_per_key(events: DataFrame, key: str, *, ts: str = "ts", within: str = "2 hours") -> DataFrame:
    """First row of each key within the watermark: repeated requests are answered once."""
    return events.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def for_each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
