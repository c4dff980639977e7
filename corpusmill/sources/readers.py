"""Readers for URL lists, JSON lines and article XML. Schemas are always declared, never inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import article_url, strip, unescape_entities
from .. import schemas

# Files of a project folder that match the pattern but hold no URLs.
NOT_URL_LISTS = ("config.toml", "requirements.txt", "requirements-minimal.txt")


def read_url_lists(
    spark: SparkSession, path: str, pattern: str = "*.txt", exclude: Sequence[str] = NOT_URL_LISTS
) -> DataFrame:
    """(list_name, url) from one file or every matching file of a folder: one URL per line, blank lines and `#` comments
    left out. `list_name` is the file name without its extension."""
    lines = spark.read.option("pathGlobFilter", pattern).text(path)
    url = strip(F.col("value"))
    return (
        lines.where(~F.col("_metadata.file_name").isin(*exclude))
        .select(F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "").alias("list_name"), url.alias("url"))
        .where((F.col("url") != "") & ~F.col("url").startswith("#"))
    )


def list_totals(url_lists: DataFrame) -> DataFrame:
    return url_lists.groupBy("list_name").agg(F.count("*").alias("urls"))


def read_jsonl(spark: SparkSession, path: str, schema: str = schemas.RAW, strict: bool = False) -> DataFrame:
    """JSON lines. `strict` fails the whole read at the first bad line; otherwise a bad line becomes a row with its text in
    `_corrupt_record`. Blank lines are skipped either way."""
    reader = spark.read.option("encoding", "UTF-8")
    if strict:
        return reader.schema(schema).option("mode", "FAILFAST").json(path)
    return (
        reader.schema(f"{schema}, _corrupt_record string")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path)
    )


_DATE = "struct<Year:string, Month:string>"
# Text fields are read as raw markup and flattened afterwards.
_CITATION = f"""
    PMID string,
    Article struct<
        ArticleTitle: string,
        Abstract: struct<AbstractText: array<string>>,
        AuthorList: struct<Author: array<struct<LastName:string, ForeName:string>>>,
        Journal: struct<JournalIssue: struct<PubDate: {_DATE}>>,
        PubDate: {_DATE}
    >,
    PubDate {_DATE},
    KeywordList array<struct<Keyword: array<string>>>
"""


def read_article_xml(spark: SparkSession, path: str) -> DataFrame:
    """RAW rows from article-set XML, one per `PubmedArticle`; the files are split at row tags.

    Rows without title or abstract are dropped. Authors need both names. The date is `YYYY` or `YYYY-Month`, from the
    citation itself or from the journal issue."""
    schema = f"MedlineCitation struct<{_struct_body(_CITATION)}>"
    rows = (
        spark.read.format("xml").option("rowTag", "PubmedArticle").option("attributePrefix", "_attr_")
        .option("valueTag", "_text").schema(schema).load(path)
    )
    return article_rows(rows)


def _struct_body(fields: str) -> str:
    from pyspark.sql.types import StructType

    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in StructType.fromDDL(" ".join(fields.split())))


def article_rows(rows: DataFrame) -> DataFrame:
    c = F.col("MedlineCitation")
    pmid = F.coalesce(_flat(c["PMID"]), F.lit(""))
    abstract = F.array_join(F.transform(c["Article"]["Abstract"]["AbstractText"], _flat), " ")
    authors = F.transform(
        F.filter(
            c["Article"]["AuthorList"]["Author"], lambda a: a["ForeName"].isNotNull() & a["LastName"].isNotNull()
        ),
        lambda a: F.concat(_flat(a["ForeName"]), F.lit(" "), _flat(a["LastName"])),
    )
    date = F.coalesce(c["PubDate"], c["Article"]["PubDate"], c["Article"]["Journal"]["JournalIssue"]["PubDate"])
    first_keywords = F.get(c["KeywordList"], F.lit(0))["Keyword"]
    none = F.array().cast("array<string>")
    return rows.select(
        pmid.alias("pmid"),
        F.coalesce(_flat(c["Article"]["ArticleTitle"]), F.lit("")).alias("title"),
        F.coalesce(abstract, F.lit("")).alias("abstract"),
        F.coalesce(authors, none).alias("authors"),
        F.coalesce(
            F.when(date["Month"].isNull(), _flat(date["Year"])).otherwise(
                F.concat(_flat(date["Year"]), F.lit("-"), _flat(date["Month"]))
            ),
            F.lit(""),
        ).alias("date"),
        F.coalesce(F.transform(first_keywords, _flat), none).alias("keywords"),
        F.lit("").alias("doi"),
        F.lit("pubmed").alias("source"),
        article_url(pmid).alias("url"),
    ).where((F.col("title") != "") & (F.col("abstract") != ""))


def _flat(markup: Column) -> Column:
    """Text of an element read as raw markup: inline tags out, references decoded."""
    return unescape_entities(F.regexp_replace(markup, "<[^>]++>", ""))
