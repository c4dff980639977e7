"""Page tables: full page records, generic parse, link edges and caller-supplied parsers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from ..functions import html as H
from ..functions.urls import authority
from .rows import array_rows


def page_records(
    pages: DataFrame, url: str = "url", html: str = "html", scraped_at: Column | None = None, max_images: int | None = None,
    max_links: int | None = None, abstract_chars: int | None = None,
) -> DataFrame:
    """One record per page: url, domain, scraped_at, title, content, abstract, metadata, authors, date, keywords,
    images, links. A narrow job: nothing is shuffled. None limits nothing."""
    prepared = pages.select(F.col(url).alias("url"), H.strip_noise(F.col(html)).alias("_h")).withColumn(
        "_m", H.meta_entries(F.col("_h"))
    )
    h, m, u = F.col("_h"), F.col("_m"), F.col("url")
    return prepared.select(
        "url",
        authority(u).alias("domain"),
        (F.lit(None).cast("timestamp") if scraped_at is None else scraped_at).alias("scraped_at"),
        H.title(h, m).alias("title"),
        H.main_content(h).alias("content"),
        H.abstract(h, m, abstract_chars).alias("abstract"),
        H.metadata(m).alias("metadata"),
        H.authors(h, m).alias("authors"),
        H.date(h, m).alias("date"),
        H.keywords(m).alias("keywords"),
        H.images(h, u, max_images).alias("images"),
        H.links(h, u, max_links).alias("links"),
    )


def generic_records(
    pages: DataFrame, url: str = "url", html: str = "html", title_chars: int | None = None, content_chars: int | None = None
) -> DataFrame:
    """Raw article records from arbitrary pages; None limits nothing."""
    body = pages.select(F.col(url).alias("url"), H.strip_chrome(H.strip_noise(F.col(html))).alias("_h"))
    h = F.col("_h")
    none = F.array().cast("array<string>")
    return body.select(
        H.generic_title(h, title_chars).alias("title"),
        H.generic_content(h, content_chars).alias("abstract"),
        "url",
        F.lit("generic").alias("source"),
        none.alias("authors"),
        F.lit("").alias("date"),
        none.alias("keywords"),
    )


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """All internal links as rows (from_url, position, to_url, text)."""
    found = H.links(H.strip_noise(F.col(html)), F.col(url))
    edges = array_rows(pages.withColumn("from_url", F.col(url)), ["from_url"], found, "link")
    return edges.select(
        "from_url", "position", F.col("link.url").alias("to_url"), F.col("link.text").alias("text")
    )


def parse_pages(
    pages: DataFrame, parser: Callable[[str, str], dict | None], schema: str, url: str = "url", html: str = "html"
) -> DataFrame:
    """Apply a caller's `parser(content, url)` in Arrow batches; a failing page keeps its row with `error` set, a page
    for which the parser returns None is dropped."""
    import pandas as pd

    fields = StructType.fromDDL(schema).fieldNames()

    def run(batches):
        for batch in batches:
            rows = []
            for page_url, content in zip(batch["url"], batch["html"]):
                try:
                    found = parser(content, page_url)
                except Exception as failure:
                    rows.append({"page_url": page_url, "error": f"{type(failure).__name__}: {failure}"})
                    continue
                if found is not None:
                    rows.append({**{f: found.get(f) for f in fields}, "page_url": page_url})
            yield pd.DataFrame(rows, columns=["page_url", *fields, "error"]).astype(object)

    return pages.select(F.col(url).alias("url"), F.col(html).alias("html")).mapInPandas(
        run, f"page_url string, {schema}, error string"
    )
