"""Filters and validation: content gate, record rules, thresholds, allow-lists, crawl rules, fetch outcomes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import ascii_ratio, text_or_empty, word_count
from ..functions.urls import authority, path_and_query, scheme

# Sites known to permit collection.
ALLOWED_DOMAINS = (
    "pubmed.ncbi.nlm.nih.gov",
    "www.ncbi.nlm.nih.gov",
    "eutils.ncbi.nlm.nih.gov",
    "www.who.int",
    "ghoapi.azureedge.net",
    "clinicaltrials.gov",
    "www.cdc.gov",
)


@dataclass(frozen=True)
class Limits:
    """Bounds of a valid record; the ranges accepted for each bound are checked on construction."""

    min_title: int = 10
    max_title: int = 250
    min_abstract: int = 200
    max_abstract: int = 3000
    min_words: int = 50
    min_ascii_ratio: float = 0.5
    min_quality: float = 0.9
    min_relevance: float = 0.6

    def __post_init__(self):
        if not 1 <= self.min_title <= self.max_title or not 1 <= self.min_abstract <= self.max_abstract:
            raise ValueError("length bounds must be positive and ordered")
        for name in ("min_ascii_ratio", "min_quality", "min_relevance"):
            if not 0.0 <= getattr(self, name) <= 1.0:
                raise ValueError(f"{name} must lie in [0, 1]")


def has_min_content(title="title", abstract="abstract", limits: Limits = Limits()) -> Column:
    return (F.length(title) >= limits.min_title) & (F.length(abstract) >= limits.min_abstract)


def record_rules(limits: Limits = Limits()) -> dict[str, Column]:
    """Rule name -> predicate that holds for a valid record."""
    title, abstract = text_or_empty("title"), text_or_empty("abstract")
    return {
        "title_length": F.length(title).between(limits.min_title, limits.max_title),
        "abstract_length": F.length(abstract).between(limits.min_abstract, limits.max_abstract),
        "source_missing": F.length(text_or_empty("source")) >= 1,
        "url_format": text_or_empty("url").rlike(r"\Ahttps?://"),
        "title_markup": ~title.rlike("<[^>]++>"),
        "abstract_markup": ~abstract.rlike("<[^>]++>"),
        "abstract_words": word_count(abstract) >= limits.min_words,
        "abstract_ascii": (F.length(abstract) == 0) | (ascii_ratio(abstract) >= limits.min_ascii_ratio),
        "score_range": (
            F.col("quality_score").between(0, 1)
            & F.col("relevance_score").between(0, 1)
            & F.col("completeness_score").between(0, 1)
        ),
    }


def threshold_rules(limits: Limits = Limits()) -> dict[str, Column]:
    return {
        "low_quality": F.col("quality_score") >= limits.min_quality,
        "low_relevance": F.col("relevance_score") >= limits.min_relevance,
    }


def reject_reasons(rules: dict[str, Column]) -> Column:
    """Names of the rules that do not hold, in rule order; an unknown outcome counts as a failure."""
    return F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    )


def on_allowlist(domain: Column | str, allowed: Sequence[str] = ALLOWED_DOMAINS) -> Column:
    """Whether a bare domain or the authority of a URL is on the list."""
    c = F.col(domain) if isinstance(domain, str) else domain
    return F.when(c.contains("://"), authority(c)).otherwise(F.regexp_extract(c, r"^([^/?#]*)", 1)).isin(*allowed)


def require_allowlist(df: DataFrame, domain: str, allowed: Sequence[str] = ALLOWED_DOMAINS) -> DataFrame:
    """Fail the job at the first row whose domain is not on the list."""
    message = F.concat(F.lit("domain not approved: "), F.col(domain))
    return df.where(F.when(on_allowlist(domain, allowed), F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def plain_path(path: Column) -> Column:
    """Path with percent escapes decoded, so that two spellings of one path compare equal; broken escapes stay as written."""
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)


def crawl_allowed(urls: DataFrame, rules: DataFrame, agent: str = "*", url: str = "url") -> DataFrame:
    """Add `allowed`: the first rule of the site whose prefix starts the path decides; no rule means allowed.

    `rules` holds (site, agent, ord, allow, prefix) with site as `scheme://authority`. A section applies when its agent
    occurs in the product token of the given user agent (the part before the first slash, whatever the case); the first such section in
    file order is used, else the `*` section. An empty prefix that forbids allows all. Paths are compared with
    escapes decoded. Rules are gathered per site first, so the join keeps one row per URL and a site with very many
    URLs is only a skewed join key, which adaptive execution splits.
    """
    token = F.lit(agent.split("/")[0].lower())
    general = F.col("agent") == "*"
    ranked = rules.where(general | F.contains(token, F.lower("agent"))).withColumn("_general", general.cast("int"))
    by_site = ranked.groupBy("site").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.col("_general").alias("general"), "ord", F.lower("agent").alias("agent"),
                    (F.col("allow") | (F.col("prefix") == "")).alias("allow"), plain_path(F.col("prefix")).alias("prefix"),
                )
            )
        ).alias("_rules")
    )
    keyed = urls.withColumn("_site", F.concat(scheme(url), F.lit("://"), authority(url))).withColumn(
        "_path", plain_path(path_and_query(url))
    )
    first = F.get("_rules", F.lit(0))
    section = F.filter("_rules", lambda r: (r["general"] == first["general"]) & (r["agent"] == first["agent"]))
    first_hit = F.get(F.filter(section, lambda r: F.startswith(F.col("_path"), r["prefix"])), F.lit(0))
    return (
        keyed.join(by_site.withColumnRenamed("site", "_site"), "_site", "left")
        .withColumn("allowed", F.coalesce(first_hit["allow"], F.lit(True)))
        .drop("_site", "_path", "_rules")
    )


def fetch_outcome(status: Column | str, content_type: Column | str, body_length: Column | str) -> Column:
    """Label of a fetch: `blocked`, `non_200`, `non_html` or `ok`."""
    status, content_type, body_length = (
        F.col(c) if isinstance(c, str) else c for c in (status, content_type, body_length)
    )
    return (
        F.when(status.isin(403, 429) | (body_length < 100), "blocked")
        .when(F.coalesce(status, F.lit(0)) != 200, "non_200")
        .when(~F.coalesce(content_type.contains("text/html"), F.lit(False)), "non_html")
        .otherwise("ok")
    )


def quality_gate(df: DataFrame, threshold: float = 0.7, score: str = "quality_score") -> DataFrame:
    """Add `kept`; a missing score counts as zero."""
    if not 0.0 <= threshold <= 1.0:
        raise ValueError("threshold must lie in [0, 1]")
    return df.withColumn("kept", F.coalesce(F.col(score), F.lit(0.0)) >= threshold)
