"""Prompt tables for batch inference and parsing of the replies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import schemas
from ..functions.text import json_array_slice, json_object_slice, let, strip, text_or_empty, truncate_marked
from .rows import array_rows, map_rows

# Characters of content per prompt kind, sampling temperature and reply size.
PROMPT_SETTINGS = {
    "extract": (15000, 0.3, 2000),
    "multilingual_qa": (10000, 0.7, 4000),
    "qa": (10000, 0.7, 2000),
    "validate": (5000, 0.3, 1000),
}
# Language code -> name used in prompts.
LANGUAGE_NAMES = {
    "fr": "français", "en": "English", "es": "español", "ar": "العربية", "pt": "português", "de": "Deutsch",
    "it": "italiano", "zh": "中文", "ja": "日本語", "ru": "русский", "hi": "हिन्दी", "sw": "Kiswahili",
    "ko": "한국어", "tr": "Türkçe", "nl": "Nederlands", "pl": "polski", "vi": "Tiếng Việt", "th": "ไทย",
    "id": "Bahasa Indonesia",
}
_SYSTEM = {
    "extract": "You extract structured content from web pages.",
    "multilingual_qa": "You write educational questions and answers in several languages.",
    "qa": "You write educational questions and answers.",
    "validate": "You judge whether a text is sound subject matter.",
}


def prompt_table(
    df: DataFrame,
    kind: str,
    key: str,
    content: str = "content",
    url: str | None = None,
    count: int = 5,
    languages: Sequence[str] = ("fr", "en"),
) -> DataFrame:
    """One request row per document: key, kind, system, user, temperature, max_tokens. Nothing is called."""
    if kind not in PROMPT_SETTINGS:
        raise ValueError(f"unknown prompt kind: {kind}")
    limit, temperature, max_tokens = PROMPT_SETTINGS[kind]
    names = ", ".join(LANGUAGE_NAMES.get(code, code) for code in languages)
    head = {
        "extract": "Return one JSON object with title, main_content, summary, key_points, medical_entities, "
        "quality_score and content_type for this page.",
        "multilingual_qa": f"Write {count} question-answer pairs in each of these languages: {names}. "
        "Return one JSON object: language code -> list of {question, answer, type}.",
        "qa": f"Write {count} question-answer pairs. Return one JSON array of {{question, answer, type}}.",
        "validate": "Return one JSON object with is_medical, quality_score, relevance_score, issues, strengths and "
        "recommendation (keep, review or reject) for this text.",
    }[kind]
    parts = [F.lit(head + "\n")]
    if url is not None:
        parts += [F.lit("URL: "), text_or_empty(url), F.lit("\n")]
    parts.append(truncate_marked(content, limit))
    return df.select(
        key,
        F.lit(kind).alias("kind"),
        F.lit(_SYSTEM[kind]).alias("system"),
        F.concat(*parts).alias("user"),
        F.lit(temperature).alias("temperature"),
        F.lit(max_tokens).alias("max_tokens"),
    )


def _parsed(slice_: Column, schema: str, default: Column) -> Column:
    """`from_json` turns broken text into NULL fields and ignores whatever follows the first value, so validity is tested
    by itself: as the first of two array elements, only one complete value gives an array of length two."""

    def parse(s: Column) -> Column:
        valid = F.json_array_length(F.concat(F.lit("["), s, F.lit(",0]"))) == 2
        return F.when((s != "") & F.coalesce(valid, F.lit(False)), F.coalesce(F.from_json(s, schema), default)).otherwise(
            default
        )

    return let(slice_, parse)


def parse_validation(reply: Column | str) -> Column:
    """Struct of the judgement; a reply without valid JSON is a rejection with score 0."""
    default = F.from_json(
        F.lit('{"is_medical":false,"quality_score":0.0,"recommendation":"reject"}'), schemas.VALIDATION_REPLY
    )
    return _parsed(json_object_slice(reply), schemas.VALIDATION_REPLY, default)


def parse_qa(reply: Column | str) -> Column:
    return _parsed(json_array_slice(reply), schemas.QA_REPLY, F.array().cast(schemas.QA_REPLY))


def parse_multilingual_qa(reply: Column | str) -> Column:
    """Map language -> pairs; empty on failure."""
    return _parsed(json_object_slice(reply), schemas.MULTILINGUAL_REPLY, F.create_map().cast(schemas.MULTILINGUAL_REPLY))


def parse_content(reply: Column | str) -> Column:
    """Struct of the extracted page; NULL on failure."""
    nothing = F.lit(None).cast(f"struct<{_as_struct(schemas.CONTENT_REPLY)}>")
    return _parsed(json_object_slice(reply), schemas.CONTENT_REPLY, nothing)


def _as_struct(fields: str) -> str:
    from pyspark.sql.types import StructType

    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in StructType.fromDDL(fields))


def qa_total(pairs_by_language: Column | str) -> Column:
    c = F.col(pairs_by_language) if isinstance(pairs_by_language, str) else pairs_by_language
    return F.aggregate(F.map_values(c), F.lit(0), lambda n, ps: n + F.greatest(F.size(ps), F.lit(0)))


def multilingual_rows(df: DataFrame, *keys: str, pairs: str) -> DataFrame:
    """One row per language and pair."""
    by_language = map_rows(df, list(keys), pairs, "language", "ps")
    return array_rows(by_language, [*keys, "language"], "ps", "qa").select(
        *keys, "language", "position", "qa.question", "qa.answer", "qa.type"
    )


def reply_lines(df: DataFrame, key: str, reply: str, limit: int, urls_only: bool = False) -> DataFrame:
    """Lines of a reply, stripped, the first `limit` that count: rows (key, position, line).

    Topics skip empty lines and `#` comments; with `urls_only` a line must start with `http`. The selection happens in
    the row, before the explode.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    lines = F.transform(F.split(text_or_empty(reply), "\n"), strip)
    counts = (lambda s: s.startswith("http")) if urls_only else (lambda s: (s != "") & ~s.startswith("#"))
    return array_rows(df, [key], F.slice(F.filter(lines, counts), 1, limit), "line")
