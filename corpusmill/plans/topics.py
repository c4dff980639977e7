"""Pages of topics with model replies: judge, keep, attach question-answer pairs, report."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.gates import quality_gate
from ..operators.replies import parse_multilingual_qa, parse_qa, parse_validation, qa_total
from ..operators.reports import run_totals, topic_results


def judged_pages(pages: DataFrame, threshold: float = 0.7, multilingual: bool = True) -> DataFrame:
    """`pages` holds (topic, url, validation_reply, qa_reply). Adds `validation`, `quality_score`, `kept`, the parsed pairs
    of the kept pages, their number `qa_count`, and `error` (NULL here)."""
    judged = quality_gate(
        pages.withColumn("validation", parse_validation("validation_reply")).withColumn(
            "quality_score", F.coalesce(F.col("validation.quality_score"), F.lit(0.0))
        ),
        threshold,
    )
    name, pairs, count = (
        ("qa_pairs_multilingual", parse_multilingual_qa("qa_reply"), qa_total)
        if multilingual
        else ("qa_pairs", parse_qa("qa_reply"), F.size)
    )
    return (
        judged.withColumn(name, F.when(F.col("kept"), pairs))
        .withColumn("qa_count", F.coalesce(F.greatest(count(name), F.lit(0)), F.lit(0)))
        .withColumn("error", F.lit(None).cast("string"))
    )


def topic_report(topics: DataFrame, judged: DataFrame, urls: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(one row per topic, run totals)."""
    results = topic_results(topics, judged, urls)
    return results, run_totals(results)
