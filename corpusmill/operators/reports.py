"""Counters and reports as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..functions.urls import authority


def _counters(status: str) -> list[Column]:
    s = F.col(status)
    return [
        F.count("*").alias("processed"),
        F.count_if(s.isin("invalid", "kept")).alias("cleaned"),
        F.count_if(s == "kept").alias("validated"),
        F.count_if(s == "kept").alias("enriched"),
        F.count_if(s == "duplicate").alias("duplicates"),
        F.count_if(s.isin("too_short", "invalid")).alias("failures"),
    ]


def run_counters(records: DataFrame, status: str = "status") -> DataFrame:
    """One row of counters from the per-row status of a curation run."""
    return records.agg(*_counters(status))


def observed_counters(records: DataFrame, status: str = "status") -> tuple[DataFrame, Observation]:
    """`records` with the counters of `run_counters` attached: whatever writes the first result fills the second, `.get`, on its way, so the
    counters need no second pass. They count the rows of the first finished action."""
    observation = Observation()
    return records.observe(observation, *_counters(status)), observation


def validation_summary(records: DataFrame, valid: str = "is_valid") -> DataFrame:
    return records.agg(
        F.count_if(F.col(valid)).alias("valid"),
        F.count_if(~F.col(valid)).alias("invalid"),
        F.coalesce(F.count_if(F.col(valid)) / F.nullif(F.count("*"), F.lit(0)) * 100, F.lit(0.0)).alias("rate"),
    )


def topic_results(topics: DataFrame, pages: DataFrame, urls: DataFrame | None = None) -> DataFrame:
    """One row per topic, also for topics without pages: urls_found, urls_scraped, pages_kept, pages_rejected,
    avg_quality (over every scored page) and n_errors.

    `pages` holds (topic, quality_score, kept, error); `urls` holds (topic, url). Errors stay in the page table, one
    row each (`topic_errors`), instead of being gathered into one list. Both inputs are reduced to one row per topic
    with map-side combining before the join.
    """
    per_topic = pages.groupBy("topic").agg(
        F.count("*").alias("urls_scraped"),
        F.count_if(F.col("kept") & F.col("error").isNull()).alias("pages_kept"),
        F.count_if(~F.col("kept") | F.col("error").isNotNull()).alias("pages_rejected"),
        F.avg("quality_score").alias("avg_quality"),
        F.count("error").alias("n_errors"),
    )
    found = (pages if urls is None else urls).groupBy("topic").agg(F.count("*").alias("urls_found"))
    zero = F.lit(0).cast("bigint")
    return (
        topics.select("topic")
        .join(found, "topic", "left")
        .join(per_topic, "topic", "left")
        .select(
            "topic",
            F.coalesce("urls_found", zero).alias("urls_found"),
            F.coalesce("urls_scraped", zero).alias("urls_scraped"),
            F.coalesce("pages_kept", zero).alias("pages_kept"),
            F.coalesce("pages_rejected", zero).alias("pages_rejected"),
            F.coalesce("avg_quality", F.lit(0.0)).alias("avg_quality"),
            F.coalesce("n_errors", zero).alias("n_errors"),
        )
    )


def topic_errors(pages: DataFrame) -> DataFrame:
    return pages.where(F.col("error").isNotNull()).select("topic", "url", "error")


def run_totals(results: DataFrame) -> DataFrame:
    """Totals over topic results; the average weighs each topic by its kept pages. `failed` marks topics that broke."""
    failed = F.col("failed") if "failed" in results.columns else F.lit(False)
    kept = F.sum("pages_kept")
    return results.agg(
        F.count("*").alias("total_topics"),
        F.count_if(~failed).alias("topics_completed"),
        F.count_if(failed).alias("topics_failed"),
        F.coalesce(F.sum("urls_scraped"), F.lit(0)).alias("pages_scraped"),
        F.coalesce(kept, F.lit(0)).alias("pages_kept"),
        F.coalesce(F.sum("pages_rejected"), F.lit(0)).alias("pages_rejected"),
        F.coalesce(F.sum(F.col("avg_quality") * F.col("pages_kept")) / F.nullif(kept, F.lit(0)), F.lit(0.0)).alias(
            "avg_quality"
        ),
    )


def fetch_statistics(
    log: DataFrame, outcome: str = "outcome", url: str | None = None, failed: tuple[str, ...] = ("blocked", "error")
) -> DataFrame:
    """Requests, successes and failures; per domain plus a total row (domain NULL) when a URL column is named.

    Only blocked or broken requests count as failures; a 404 with a body was still served."""
    bad = F.col(outcome).isin(*failed)
    counts = [
        F.count("*").alias("requests"),
        F.count_if(~bad).alias("successes"),
        F.count_if(bad).alias("failures"),
    ]
    return log.agg(*counts) if url is None else log.rollup(authority(url).alias("domain")).agg(*counts)


def storage_statistics(df: DataFrame) -> DataFrame:
    """Number of files and total size in MB of a file-backed table."""
    files = df.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")
    ).distinct()
    return files.agg(
        F.count("*").alias("output_files"), (F.coalesce(F.sum("size"), F.lit(0)) / (1024 * 1024)).alias("total_size_mb")
    )
