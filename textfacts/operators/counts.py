"""Counts over the code points of a whole column."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def character_counts(rows: DataFrame, text: str) -> DataFrame:
    """character, n over all texts.

    Each task counts its own texts first - at most as many entries as there are
    code points - so the shuffle carries counts, not characters.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            for t in batch.column(0):
                total.update(t.as_py() or "")
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["character", "n"])

    return rows.select(text).mapInArrow(run, "character string, n long").groupBy("character").agg(F.sum("n").alias("n"))
