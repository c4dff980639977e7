"""Declared schemas of the records that move between the operators."""

from __future__ import annotations

RAW = (
    "pmid string, title string, abstract string, authors array<string>, date string, keywords array<string>, "
    "doi string, source string, url string"
)
RAW_DEFAULTS = {"pmid": "", "title": "", "abstract": "", "date": "", "doi": "", "source": "unknown", "url": ""}

ENTITIES = "map<string, array<struct<text:string, label:string, start:int, end:int>>>"
QA_PAIRS = "array<struct<question:string, answer:string, type:string>>"
ENTRY = (
    RAW + f", entities {ENTITIES}, extracted_keywords array<string>, qa_pairs {QA_PAIRS}, category string, "
    "relevance_score double, quality_score double, completeness_score double, hash_sha256 string, hash_blake3 string, "
    "scraped_at timestamp, pii_free boolean, compliance_metadata map<string,string>, error_log string"
)
# Columns stored as JSON text in the flat layout.
JSON_COLUMNS = ("authors", "keywords", "entities", "extracted_keywords", "qa_pairs", "compliance_metadata")

# Replies of a language model.
VALIDATION_REPLY = (
    "is_medical boolean, quality_score double, relevance_score double, issues array<string>, "
    "strengths array<string>, recommendation string"
)
QA_REPLY = QA_PAIRS
MULTILINGUAL_REPLY = f"map<string, {QA_PAIRS}>"
CONTENT_REPLY = (
    "title string, main_content string, summary string, key_points array<string>, "
    "medical_entities struct<diseases:array<string>, symptoms:array<string>, treatments:array<string>>, "
    "quality_score double, content_type string"
)
