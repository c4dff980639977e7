"""Structured Streaming forms: ingestion, de-duplication across batches, daily counts, keyed upsert.

Each function returns a streaming DataFrame or a `foreachBatch` function; the caller starts the query with its own
checkpoint location and trigger.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions.text import content_hash
from ..operators.dedup import flag_exact, flag_similar_titles, similar_to_kept
from ..operators.gates import Limits, has_min_content
from ..plans.curation import clean, validate
from ..session import stage
from ..sinks.writers import latest_version, upsert_snapshot


def raw_stream(spark: SparkSession, folder: str, schema: str = schemas.RAW, max_files: int = 1000) -> DataFrame:
    """JSON-lines files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(folder)


def curated_stream(raw: DataFrame, limits: Limits = Limits(), **options) -> DataFrame:
    """The row-local part of curation on a stream: cleaned, scored, with `reject_reasons` and `status` (too_short, invalid,
    kept). No state. Rows are marked rather than filtered: a filter would be pushed below the cleaning and run it twice."""
    terms = {"terms": options.pop("terms")} if "terms" in options else {}
    checked = validate(clean(raw, **options), limits, **terms)
    status = (
        F.when(~has_min_content(limits=limits), "too_short").when(~F.col("is_valid"), "invalid").otherwise("kept")
    )
    return checked.withColumn("status", status)


def first_arrivals(stream: DataFrame, event_time: str, delay: str = "1 day") -> DataFrame:
    """The first row of each content hash; a copy that arrives more than `delay` of event time later counts as new, which
    bounds the state."""
    return (
        stream.withColumn("hash_sha256", content_hash("title", "abstract"))
        .withWatermark(event_time, delay)
        .dropDuplicatesWithinWatermark(["hash_sha256"])
    )


def keep_first_batches(root: str, seq: str = "seq") -> Callable[[DataFrame, int], None]:
    """`foreachBatch` function: append to `root` the rows of each batch that repeat neither the content nor (closely) the
    title of a row kept before. The state is a narrow table beside it, content hash and title of every kept row, written before the
    rows, so no batch reads or hashes an old abstract. A batch is compared with the rows of earlier
    batches only, and overwrites its own folders, so a replay gives the same result."""
    keys = f"{root.rstrip('/')}-keys"

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = stage(batch, "batch")
        fresh = rows
        if latest_version(spark, root, batch_id) is not None:
            before = spark.read.schema("_h string, title string, version int").parquet(keys).where(F.col("version") < batch_id)
            same = rows.select(seq, content_hash("title", "abstract").alias("_h")).join(before.select("_h").distinct(), "_h", "left_semi")
            close = similar_to_kept(rows, before, seq=seq)
            gone = stage(same.select(seq).unionByName(close.select(F.col("seq").alias(seq))).distinct(), "seen")
            fresh = rows.join(gone, seq, "left_anti")
        titled = flag_similar_titles(fresh, seq=seq)
        untitled = flag_exact(fresh.where("coalesce(title, '') = ''"), seq=seq)
        dup = titled.unionByName(untitled).where("is_duplicate").select(F.col("seq").alias(seq))
        kept = stage(fresh.join(dup, seq, "left_anti"), "kept")
        kept.select(content_hash("title", "abstract").alias("_h"), "title").write.mode("overwrite").parquet(f"{keys}/version={batch_id}")
        kept.write.mode("overwrite").parquet(f"{root}/version={batch_id}")

    return run


def daily_counts(stream: DataFrame, ts: str = "ts", limit: int = 2000, delay: str = "1 hour") -> DataFrame:
    """Requests per UTC day against the limit; `window_start` is the day. In update mode a batch gives the days it changed, and a day that
    ended more than `delay` before the latest request leaves the state; requests later than that are not counted."""
    return (
        stream.withWatermark(ts, delay)
        .groupBy(F.window(ts, "1 day").alias("w"))
        .agg(F.count("*").alias("used"))
        .select(
            F.col("w.start").alias("window_start"),
            "used",
            F.greatest(F.lit(0).cast("bigint"), F.lit(limit) - F.col("used")).alias("remaining"),
        )
    )


def count_batches(root: str, key: str = "window_start", buckets: int = 8) -> Callable[[DataFrame, int], None]:
    """`foreachBatch` function for counts in update mode: a keyed table with the last counts of every `key` and `first_batch`, the batch
    that first saw it. A batch has one row per changed key; it commits by its manifest, so a replay gives the same table."""

    def run(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumns({"seq": F.lit(0).cast("bigint"), "first_batch": F.lit(batch_id).cast("bigint")})
        upsert_snapshot(root, rows, batch_id, key, "seq", "first_batch", buckets)

    return run


def upsert_batches(root: str, key="hash_sha256", seq="seq", keep="pmid", buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """`foreachBatch` function: one version of a keyed table per batch, named by the batch id. The data of the touched buckets come first,
    the manifest commits them; a replayed batch starts from the manifest before it, wherever the run before was stopped."""

    def run(batch: DataFrame, batch_id: int) -> None:
        upsert_snapshot(root, batch, batch_id, key, seq, keep, buckets)

    return run
