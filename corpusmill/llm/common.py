"""What several operators of this subpackage share: tables, words and Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusmill.operators.components import connected_components  # noqa: F401  used by the operators, as are these
from corpusmill.session import drop_staged, shared_folder, stage, staged  # noqa: F401

#: ASCII white space, which separates words in the contracts.
WHITE = r"[\x20\x09-\x0D]+"
#: The same characters, for functions that take a list of characters.
WHITE_CHARS = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Array of the words of a text, native; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WHITE))


def bounded_batches(rows: int = 1000) -> None:
    """Let Spark send Arrow batches of fewer rows than its default of 10,000, which are tens of megabytes of text on both sides. A
    setting that the caller has chosen is left alone."""
    spark = SparkSession.getActiveSession()
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark is not None and spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut or join Arrow batches to about `size` bytes of text (one row at least), so that memory does not follow row width."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            base = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + size, "right")))
            piece, weight = batch.slice(start, stop - start), int(ends[stop - 1]) - base
            if held and total + weight > size:
                yield pa.concat_batches(held)
                held, total = [], 0
                pa.default_memory_pool().release_unused()
            held.append(piece)
            total += weight
            start = stop
    if held:
        yield pa.concat_batches(held)


def word_codes(texts: pa.Array, pattern: str = " ") -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Split every text at `pattern`: distinct pieces, the code of every piece, and where each text begins among the codes."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), pattern)
    coded = pc.dictionary_encode(lists.values)
    offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), offsets
