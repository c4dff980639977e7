"""Spark side of the registered queries: name -> callable(spark, folder of the tables)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusmill.functions import pii, scores, text as T
from corpusmill.functions.urls import authority
from corpusmill.operators import (
    dedup, entities as E, frontier, gates, keywords as K, pages as P, qa as Q, replies as R, reports, vectors as V,
)
from corpusmill.operators.rows import array_rows, map_rows
from corpusmill.operators.similarity import title_ratio
from corpusmill.plans import curation, topics, web
from corpusmill.session import shared_folder, spread, stage
from corpusmill.sinks import writers
from corpusmill.sources import readers
from corpusmill.streaming import streams

# Parameters of the checked runs. The invented prose of the tables has none of the default subject terms.
TERMS = ("tion", "the", "ent", "que", "sch", "ción", "aux", "and", "ing")
LIMITS = gates.Limits(max_title=400, max_abstract=6000, min_quality=0.6, min_relevance=0.5)
PII_TYPES = ("email", "phone", "credit_card", "address")
LEXICON = (
    ("the", "DISEASE"), ("of the", "SYMPTOM"), ("and", "CHEMICAL"), ("que la", "TREATMENT"), ("für", "ANATOMY"),
    ("les", "DISEASE"), ("en", "SYMPTOM"), ("for the", "CHEMICAL"), ("los", "DISEASE"), ("est", "TREATMENT"),
    ("un", "PERSON"), ("der", "SYMPTOM"), ("is", "TREATMENT"),
)
ALLOWED = ("ththre.example.com", "m.ththth.example.net", "blog.ththan.example.net", "ththin.example.com")
SCRAPED_AT = "2024-01-31 00:00:00"


# Accented letters as base and combining marks; two carry another mark in an order that is not canonical.
DECOMPOSED = {
    "ä": "a\u0308", "ö": "o\u0308\u0323", "ü": "u\u0308", "é": "e\u0301", "è": "e\u0300", "ê": "e\u0302\u0323", "ñ": "n\u0303", "ó": "o\u0301", "ç": "c\u0327", "Å": "\u212b",
}

# Tables whose rows are costly to work on.
TEXT_TABLES = ("documents", "pages")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def raw(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as raw records: the first line is the title, the whole text the abstract."""
    none = F.array().cast("array<string>")
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("seq"),
        F.col("doc_id").cast("string").alias("pmid"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("abstract"),
        none.alias("authors"),
        F.lit("").alias("date"),
        F.array("lang").alias("keywords"),
        F.lit("").alias("doi"),
        "source",
        F.concat(F.lit("https://corpus.example.org/"), F.col("doc_id")).alias("url"),
    )


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LEXICON), "phrase string, label string")


def joined(c: Column | str, sep: str = ",") -> Column:
    return F.array_join(c, sep)


# --- text -----------------------------------------------------------------------------------------------------------

def clean_documents(spark, folder):
    return curation.clean(raw(spark, folder), anonymize=False).select("seq", "title", "abstract")


def composed_documents(spark, folder):
    """Documents whose accented letters were taken apart, in canonical composition again."""
    apart = F.col("text")
    for letter, parts in DECOMPOSED.items():
        apart = F.replace(apart, F.lit(letter), F.lit(parts))
    documents = table(spark, folder, "documents").select("doc_id", apart.alias("apart"))
    return documents.select("doc_id", T.compose("apart").alias("composed"), F.length("apart").alias("n_apart"))


def content_hashes(spark, folder):
    return raw(spark, folder).select(
        "seq", T.content_hash("title", "abstract").alias("hash_sha256"), T.article_url("pmid").alias("article_url")
    )


def text_measures(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id",
        F.round(T.ascii_ratio("text"), 6).alias("ascii_ratio"),
        T.word_count("text").cast("bigint").alias("words"),
        T.topic_slug(F.concat_ws(" ", F.upper("lang"), "source")).alias("slug"),
        T.truncate_marked("text", 5000).alias("truncated"),
        T.prefix("text", 250).alias("first_250"),
    )


def compliance_records(spark, folder):
    at = F.lit(SCRAPED_AT).cast("timestamp_ntz")
    return table(spark, folder, "pages").select(
        "page_id", F.explode(T.compliance_metadata("url", at)).alias("key", "value")
    )


# --- personal data --------------------------------------------------------------------------------------------------

def pii_redaction(spark, folder):
    found = table(spark, folder, "documents").select("doc_id", pii.redact("text", pii.ALL_TYPES).alias("r"))
    return found.select("doc_id", F.col("r.text").alias("redacted"), joined("r.types").alias("types"))


def pii_counts(spark, folder):
    return map_rows(table(spark, folder, "documents"), ["doc_id"], pii.pii_counts("text", pii.ALL_TYPES), "type", "n")


def pii_totals(spark, folder):
    return pii_counts(spark, folder).groupBy("type").agg(F.sum("n").alias("n"), F.count("*").alias("documents"))


def pii_free_documents(spark, folder):
    return table(spark, folder, "documents").select("doc_id", pii.is_pii_free("text", pii.ALL_TYPES).alias("pii_free"))


# --- validation and scores ------------------------------------------------------------------------------------------

def content_gate(spark, folder):
    cleaned = curation.clean(raw(spark, folder), PII_TYPES)
    return cleaned.select("seq", gates.has_min_content().alias("long_enough"), "pii_free")


def record_scores(spark, folder):
    scored = curation.score(raw(spark, folder), TERMS)
    return scored.select(
        "seq",
        F.round("completeness_score", 6).alias("completeness"),
        F.round("quality_score", 6).alias("quality"),
        F.round("relevance_score", 6).alias("relevance"),
        scores.term_hits(terms=TERMS).cast("bigint").alias("hits"),
        scores.length_band().alias("length_band"),
    )


def record_validation(spark, folder):
    checked = curation.validate(raw(spark, folder), LIMITS, TERMS)
    return checked.select("seq", "is_valid", joined("reject_reasons").alias("reasons"))


def validation_summary(spark, folder):
    """With the default limits and terms, over records written to and read from JSON lines."""
    path = scratch(spark, "records")
    writers.write_jsonl(raw(spark, folder), path)
    checked = curation.validate(readers.read_jsonl(spark, path, strict=True))
    return reports.validation_summary(checked).select("valid", "invalid", F.round("rate", 6).alias("rate"))


def allowlist_flags(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id", authority("url").alias("domain"), gates.on_allowlist("url", ALLOWED).alias("allowed")
    )


def crawl_rules(spark, folder):
    """Rules derived from the pages: every site opens part of `/en/`, written with escapes, before closing it; mobile sites name
    a word of the agent, which is given as a full user-agent string."""
    pages = table(spark, folder, "pages")
    sites = pages.select(F.regexp_extract("url", r"^(https?://[^/?#]*)", 1).alias("site")).distinct()

    def rule(agent, ord_, allow, prefix):
        return sites.select("site", F.lit(agent).alias("agent"), F.lit(ord_).alias("ord"), F.lit(allow).alias("allow"),
                            F.lit(prefix).alias("prefix"))

    named = rule("Miner", 0, False, "/es").where(F.col("site").contains("://m."))
    rules = (
        rule("*", 0, True, "/%65n/4").unionByName(rule("*", 1, False, "/en%2F")).unionByName(rule("*", 2, False, "/fr"))
        .unionByName(named)
    )
    return gates.crawl_allowed(pages.select("page_id", "url"), rules, "MedMiner/2.1 (research)").select("page_id", "allowed")


def fetch_log(spark, folder):
    """Events as a crawl log: a user is a site, errors are failed fetches."""
    return table(spark, folder, "events").select(
        "event_id", "ts", F.concat(F.lit("https://site"), F.col("user_id"), F.lit(".example.org/"), F.col("event_type"))
        .alias("url"),
        F.expr("case when event_type <> 'error' then 200 when value < 10 then 403 when value < 20 then 429 else 404 end")
        .alias("status"),
        F.expr("case when event_type = 'click' then 'application/json' else 'text/html; charset=utf-8' end")
        .alias("content_type"),
        F.floor(F.col("value") * 100).alias("body_length"),
    ).withColumn("outcome", gates.fetch_outcome("status", "content_type", "body_length"))


def fetch_outcomes(spark, folder):
    return fetch_log(spark, folder).select("event_id", "outcome")


def fetch_statistics(spark, folder):
    stats = reports.fetch_statistics(fetch_log(spark, folder), url="url")
    return stats.select(F.coalesce("domain", F.lit("(all)")).alias("domain"), "requests", "successes", "failures")


# --- pages ----------------------------------------------------------------------------------------------------------

def page_records(spark, folder):
    records = P.page_records(table(spark, folder, "pages"), scraped_at=F.lit(SCRAPED_AT).cast("timestamp"), abstract_chars=500)
    return records.select(
        "url", "domain", "title", "content", "abstract", joined("authors").alias("authors"), "date",
        joined("keywords").alias("keywords"), F.size("metadata").alias("n_metadata"), F.size("images").alias("n_images"),
        F.size("links").alias("n_links"),
    )


def generic_records(spark, folder):
    return P.generic_records(table(spark, folder, "pages")).select("url", "title", "abstract", "source")


def link_edges(spark, folder):
    return P.link_edges(table(spark, folder, "pages"))


def parsed_pages(spark, folder):
    """A caller's own parser, run in Arrow batches."""

    def parser(content, url):
        return {"n_chars": len(content), "n_paragraphs": content.count("<p>"), "secure": url.startswith("https")}

    return P.parse_pages(table(spark, folder, "pages"), parser, "n_chars bigint, n_paragraphs bigint, secure boolean")


def url_lists(spark, folder):
    """Page URLs written as URL lists with comments and blank lines, then read back."""
    path = scratch(spark, "url-lists")
    pages = table(spark, folder, "pages")
    lines = pages.select(F.explode(F.array(
        F.concat(F.lit("# page "), F.col("page_id")), F.concat(F.lit("  "), F.col("url"), F.lit(" ")), F.lit("")
    )).alias("value"))
    lines.write.text(path)
    return path, readers.read_url_lists(spark, path)


def url_list_scan(spark, folder):
    return url_lists(spark, folder)[1].select("url")


def url_list_totals(spark, folder):
    return readers.list_totals(url_lists(spark, folder)[1]).agg(F.sum("urls").alias("urls"))


def listed_page_records(spark, folder):
    """The web flow: URL lists joined with the page table, records written per list and read back."""
    pages = table(spark, folder, "pages")
    lists = url_lists(spark, folder)[1].select(
        F.regexp_extract("url", r"\.example\.([a-z]+)", 1).alias("list_name"), "url"
    )
    path = scratch(spark, "web")
    web.write_page_records(web.page_records_for_lists(lists, pages), path)
    back = spark.read.schema("url string, title string, domain string, list_name string, topic_slug string").json(path)
    return back.select("list_name", "url", "domain", "title")


# --- duplicates -----------------------------------------------------------------------------------------------------

def exact_duplicates(spark, folder):
    return dedup.flag_exact(raw(spark, folder))


def similar_titles(spark, folder):
    return dedup.flag_similar_titles(raw(spark, folder))


def similar_title_ratios(spark, folder):
    """How close each dropped title is to the kept one."""
    records = raw(spark, folder).select("seq", "title")
    flags = stage(dedup.flag_similar_titles(records).where("is_duplicate"), "flags")
    both = flags.join(records, "seq").join(
        records.select(F.col("seq").alias("dup_of"), F.col("title").alias("kept_title")), "dup_of"
    )
    return both.select("seq", F.round(title_ratio("title", "kept_title"), 4).alias("ratio"))


def first_visits(spark, folder):
    log = fetch_log(spark, folder).select("url", "event_id", "ts", (F.col("outcome") == "ok").alias("ok"))
    return frontier.first_visits(log, seq="event_id", ok="ok").select("url", "event_id", "ts")


def unvisited_urls(spark, folder):
    log = fetch_log(spark, folder).select("url", (F.col("outcome") == "ok").alias("ok"))
    return frontier.unvisited(log.select("url").distinct(), log).select("url")


# --- enrichment -----------------------------------------------------------------------------------------------------

def document_keywords(spark, folder):
    found = array_rows(table(spark, folder, "documents"), ["doc_id"], K.keyword_counts("text"), "k", "i")
    return found.select("doc_id", (F.col("i") + 1).alias("rank"), "k.word", F.col("k.n").alias("n"))


def _tagged(spark, folder):
    return E.tag_entities(raw(spark, folder), lexicon(spark), "seq", max_words=2)


def entities(spark, folder):
    return E.entity_rows(_tagged(spark, folder), "seq").drop("position")


def entities_joined(spark, folder):
    """The same found span by span: mentions joined with the phrases of the lexicon, the first of equal texts per type."""
    known = lexicon(spark).select(E.phrase_key("phrase").alias("phrase"), "label", E.entity_type("label").alias("type"))
    found = E.first_spans(E.candidate_spans(raw(spark, folder), known, "seq", "abstract", 2), "seq")
    spans = found.join(known, "phrase").where(F.col("type").isin(*E.DEFAULT_TYPES))
    firsts = spans.groupBy("seq", "type", "lower").agg(F.min(F.struct("start", "end", "text", "label")).alias("e"))
    return firsts.select("seq", "type", "e.text", "e.label", "e.start", "e.end")


def entity_labels(spark, folder):
    """Labels and their types over the entities found in the documents."""
    found = E.entity_rows(_tagged(spark, folder), "seq").withColumn("type", E.entity_type("label"))
    return found.groupBy("label", "type").agg(F.count("*").alias("entities"), F.countDistinct("seq").alias("documents"))


def qa_training_rows(spark, folder):
    return Q.qa_rows(_tagged(spark, folder).withColumn("qa_pairs", Q.qa_pairs(max_pairs=4)), "seq")


def _cache(spark, folder):
    """Vectors known so far: texts of the labelled documents."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return (
        docs.join(labels, "doc_id", "left_semi").groupBy(V.text_key("text").alias("text_sha256"))
        .agg(F.array(F.max("n_chars").cast("float")).alias("embedding"))
    )


def cache_lookup(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return V.cache_lookup(docs, _cache(spark, folder)).select(
        "doc_id", "text_sha256", "hit", F.get("embedding", F.lit(0)).cast("double").alias("x0")
    )


def cache_misses(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return V.cache_misses(docs, _cache(spark, folder), row_id="doc_id").select("text_sha256")


def embedded_documents(spark, folder):
    """Misses vectorised by a caller's function, here the length of the text."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out, _ = V.embed_with_cache(docs, _cache(spark, folder), lambda c: F.array(F.length(c).cast("float")), row_id="doc_id")
    return out.select("doc_id", F.get("embedding", F.lit(0)).cast("double").alias("x0"))


def cosine_to_mean(spark, folder):
    """Similarity of each vector to the mean of its label."""
    vectors = table(spark, folder, "embeddings")
    means = V.mean_vectors(vectors, "label", "embedding")
    return vectors.join(means, "label").select(
        "vec_id", "label", F.round(V.cosine_similarity("embedding", "mean"), 6).alias("similarity")
    )


def nearest_to_mean(spark, folder):
    ranked = frontier.first_n_per_group(cosine_to_mean(spark, folder), "label", [F.desc("similarity"), F.col("vec_id")], 3)
    return ranked.select("label", "rank", "vec_id", "similarity")


def nearest_vectors(spark, folder):
    """The five nearest of all vectors to every twentieth one."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return V.nearest(vectors, vectors.where("vec_id % 20 = 0"), 5)


# --- model replies and topics ---------------------------------------------------------------------------------------

def topic_pages(spark, folder):
    """Documents as pages of topics (their source) with replies written from the labels."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    good, poor = "'{\"is_medical\": true, \"quality_score\": 0.9, \"recommendation\": \"keep\"}'", "0.35"
    return docs.join(labels, "doc_id", "left").select(
        F.col("source").alias("topic"),
        F.concat(F.lit("https://corpus.example.org/"), F.col("doc_id")).alias("url"),
        "doc_id", "text",
        F.expr(f"""case when toxic = 1 then 'Sure: {{"is_medical": true, "quality_score": {poor}, "recommendation": "review"}} Done.'
                        when quality = 1 then {good}
                        when quality = 0 then '{{"is_medical": true, "quality_score": }}'
                        else 'I cannot judge this text.' end""").alias("validation_reply"),
        F.expr("""case when lang = 'en' then concat('{"fr": [{"question": "Q1 ', source, '", "answer": "A1", "type": "definition"}], ',
                             '"en": [{"question": "Q2", "answer": "A2", "type": "symptom"}, {"question": "Q3", "answer": "A3", "type": "treatment"}]}')
                       when lang = 'fr' then concat('Voici: {"fr": [{"question": "Q4", "answer": "', source, '", "type": "definition"}]}')
                       when lang = 'de' then '{"fr": ['
                       else '' end""").alias("qa_reply"),
    )


def judged_pages(spark, folder):
    judged = topics.judged_pages(topic_pages(spark, folder), threshold=0.6)
    return judged.select(
        "doc_id", "topic", F.col("validation.recommendation").alias("recommendation"), "quality_score", "kept", "qa_count"
    )


def multilingual_qa(spark, folder):
    judged = topics.judged_pages(topic_pages(spark, folder), threshold=0.6)
    return R.multilingual_rows(judged, "doc_id", pairs="qa_pairs_multilingual")


def single_language_qa(spark, folder):
    """The same pairs asked for as one array."""
    replies = topic_pages(spark, folder).select("doc_id", "qa_reply")
    return replies.select("doc_id", F.size(R.parse_qa("qa_reply")).alias("pairs"))


def extracted_content(spark, folder):
    replies = table(spark, folder, "documents").select("doc_id", F.expr(
        """case when lang = 'fr' then concat('{"title": "T', doc_id, '", "quality_score": 0.5, "content_type": "guide"}')
                when lang = 'en' then concat('Result {"title": "E', source, '", "content_type": "article"} end')
                else 'nothing' end""").alias("reply"))
    return replies.select("doc_id", R.parse_content("reply").alias("c")).select(
        "doc_id", "c.title", "c.content_type", "c.quality_score"
    )


def prompts(spark, folder):
    docs = table(spark, folder, "documents").withColumn("u", F.concat(F.lit("https://corpus.example.org/"), "doc_id"))
    out = None
    for kind in R.PROMPT_SETTINGS:
        part = R.prompt_table(docs, kind, "doc_id", "text", "u", 3, ("fr", "en", "xx"))
        out = part if out is None else out.unionByName(part)
    return out.select("doc_id", "kind", F.length("user").alias("user_chars"), F.sha2(
        F.substring_index("user", "\n", -1), 256).alias("last_line"), "temperature", "max_tokens")


def topic_lines(spark, folder):
    """Non-comment lines of each text, the first five."""
    return R.reply_lines(table(spark, folder, "documents"), "doc_id", "text", 5)


def suggested_urls(spark, folder):
    """Page URLs suggested per language, one reply per page, the first three lines that are URLs."""
    replies = table(spark, folder, "pages").select(
        "page_id", F.concat(F.lit("Here:\n - "), F.col("url"), F.lit("\n"), F.col("url"), F.lit("\n\n  "), F.col("url"),
                            F.lit("#b \n# no\n"), F.col("url"), F.lit("?c\n"), F.col("url"), F.lit("?d")).alias("reply"))
    return R.reply_lines(replies, "page_id", "reply", 3, urls_only=True)


def topic_results(spark, folder):
    pages = topic_pages(spark, folder)
    names = pages.select("topic").distinct().unionByName(spark.range(1).select(F.lit("(no pages)").alias("topic")))
    results, _ = topics.topic_report(names, topics.judged_pages(pages, threshold=0.6))
    return results.withColumn("avg_quality", F.round("avg_quality", 6))


def topic_totals(spark, folder):
    pages = topic_pages(spark, folder)
    _, totals = topics.topic_report(pages.select("topic").distinct(), topics.judged_pages(pages, threshold=0.6))
    return totals.withColumn("avg_quality", F.round("avg_quality", 6))


def topic_folders(spark, folder):
    """Kept pages written to one folder per topic, and the run report; both read back."""
    judged = topics.judged_pages(topic_pages(spark, folder), threshold=0.6)
    root = scratch(spark, "topics")
    writers.write_by_group(judged.where("kept").select("topic", "url", "quality_score", "qa_count"), f"{root}/pages", "topic")
    results, totals = topics.topic_report(judged.select("topic").distinct(), judged)
    writers.write_report(totals, results, f"{root}/report")
    back = spark.read.schema("topic string, qa_count int, topic_slug string").json(f"{root}/pages")
    report = spark.read.schema("topic string, pages_kept bigint").json(f"{root}/report/results")
    counted = back.groupBy("topic_slug").agg(F.count("*").alias("pages"), F.sum("qa_count").alias("qa"))
    return report.join(counted, T.topic_slug("topic") == F.col("topic_slug"), "left").select(
        "topic", "pages_kept", F.coalesce("pages", F.lit(0).cast("bigint")).alias("pages"),
        F.coalesce("qa", F.lit(0).cast("bigint")).alias("qa"),
    )


# --- whole flow -----------------------------------------------------------------------------------------------------

def curated_exact(spark, folder):
    out = curation.curate(raw(spark, folder), dedup="exact", pii_types=PII_TYPES, terms=TERMS, limits=LIMITS)
    return out.select("seq", "status", "dup_of", joined("reject_reasons").alias("reasons"), "pii_free", "hash_sha256")


def curation_counters(spark, folder):
    out = curation.curate(raw(spark, folder), dedup="exact", pii_types=PII_TYPES, terms=TERMS, limits=LIMITS)
    return reports.run_counters(out)


def default_counters(spark, folder):
    """Default terms, limits and PII types."""
    return reports.run_counters(curation.curate(raw(spark, folder), dedup="exact"))


def curated_entries(spark, folder):
    """The whole flow with title de-duplication and enrichment."""
    out = curation.entries(
        raw(spark, folder), lexicon(spark), F.lit(SCRAPED_AT).cast("timestamp"),
        pii_types=PII_TYPES, terms=TERMS, limits=LIMITS,
    )
    return out.select(
        "seq", "pmid", "title", "hash_sha256", joined("extracted_keywords").alias("extracted_keywords"),
        F.size("entities").alias("n_entity_types"), F.size("qa_pairs").alias("n_qa"),
        F.round("quality_score", 6).alias("quality_score"), "pii_free",
    )


# --- sinks ----------------------------------------------------------------------------------------------------------

def exported_entries(spark, folder):
    """JSON lines, flat Parquet and keyed table written together, then compared by reading all three back."""
    rows = curation.score(raw(spark, folder), TERMS)
    paths = writers.export_all(rows, scratch(spark, "export"), "run", flatten_json=True)
    lines = readers.read_jsonl(spark, paths["jsonl"], "pmid string, title string, keywords array<string>", strict=True)
    flat = spark.read.parquet(paths["parquet"]).select("pmid", F.col("keywords").alias("keywords_json"))
    keyed = writers.read_snapshot(spark, paths["table"]).select("pmid", F.lit(True).alias("in_table"))
    return lines.join(flat, "pmid").join(keyed, "pmid", "left").select(
        "pmid", "title", joined("keywords").alias("keywords"), "keywords_json",
        F.coalesce("in_table", F.lit(False)).alias("in_table"),
    )


def upserted_table(spark, folder):
    """Two batches: the labelled documents, then all documents with another source mark."""
    docs = raw(spark, folder).withColumn("hash_sha256", T.content_hash("title", "abstract")).select(
        "seq", "pmid", "source", "url", "hash_sha256")
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("seq"))
    root = scratch(spark, "table")
    writers.upsert_snapshot(root, docs.join(labels, "seq", "left_semi"))
    writers.upsert_snapshot(root, docs.withColumn("source", F.concat(F.lit("again-"), F.col("source"))))
    return writers.read_snapshot(spark, root).select("hash_sha256", "pmid", "source", "url")


def stored_files(spark, folder):
    """Files and bytes of a table of texts, which has a known size: every text and a line end."""
    path = scratch(spark, "stored")
    texts = table(spark, folder, "documents").where("text is not null")
    texts.select("text").repartition(3).write.text(path)
    stats = reports.storage_statistics(spark.read.text(path))
    return stats.select(F.col("output_files").alias("files"), F.round(F.col("total_size_mb") * 1024 * 1024).cast("long").alias("bytes"))


def article_xml(spark, folder):
    """Documents written as article XML, with attributes and inline markup, then read back."""
    path = scratch(spark, "articles")
    f, lit = F.struct, F.lit
    author = f((F.concat(lit("L"), F.col("lang"))).alias("LastName"), lit("F").alias("ForeName"))
    group = f(lit("Group").alias("LastName"), lit(None).cast("string").alias("ForeName"))
    article = f(
        f(lit("Record ").alias("_VALUE"), F.col("source").alias("i")).alias("ArticleTitle"),
        f(F.array(
            f(lit("A").alias("_Label"), T.strip(T.collapse_ws(F.col("text"))).alias("_VALUE")),
            f(lit("B").alias("_Label"), F.col("lang").alias("_VALUE")),
        ).alias("AbstractText")).alias("Abstract"),
        f(F.array(author, group).alias("Author")).alias("AuthorList"),
        f(f(f(lit("2024").alias("Year"), lit("Jan").alias("Month")).alias("PubDate")).alias("JournalIssue")).alias("Journal"),
    )
    citation = f(
        f(lit("1").alias("_Version"), F.col("doc_id").cast("string").alias("_VALUE")).alias("PMID"),
        article.alias("Article"),
        f(F.array("lang", "source").alias("Keyword")).alias("KeywordList"),
    )
    table(spark, folder, "documents").select(citation.alias("MedlineCitation")).write.format("xml").option(
        "rootTag", "PubmedArticleSet").option("rowTag", "PubmedArticle").option("indent", "").save(path)
    back = readers.read_article_xml(spark, path)
    return back.select("pmid", "title", "abstract", joined("authors").alias("authors"), "date",
                       joined("keywords").alias("keywords"), "source", "url")


# --- limits and streams ---------------------------------------------------------------------------------------------

def first_urls_per_site(spark, folder):
    log = fetch_log(spark, folder).select(authority("url").alias("site"), "event_id", "url")
    return frontier.first_n_per_group(log, "site", ["event_id"], 5).select("site", "rank", "event_id", "url")


def daily_admission(spark, folder):
    log = table(spark, folder, "events").select("event_id", "ts")
    return frontier.daily_admission(log, limit=200).select("event_id", F.col("day").cast("string").alias("day"), "admitted")


def daily_remaining(spark, folder):
    out = frontier.daily_remaining(table(spark, folder, "events"), limit=400)
    return out.select(F.col("day").cast("string").alias("day"), "used", "remaining")


def sample_rows(spark, folder):
    """The three rows a run shows."""
    return raw(spark, folder).orderBy("seq").limit(3).select("seq", "pmid", "url")


def _run(stream_writer, spark, checkpoint: str | None = None) -> None:
    query = stream_writer.option("checkpointLocation", checkpoint or scratch(spark, "stream")).trigger(availableNow=True).start()
    query.awaitTermination()


def streamed_curation(spark, folder):
    """JSON files arriving in a folder, curated row by row."""
    source, sink = scratch(spark, "arriving"), scratch(spark, "curated")
    raw(spark, folder).write.json(source)
    stream = streams.raw_stream(spark, source, "seq bigint, " + "title string, abstract string, source string, url string")
    out = streams.curated_stream(stream, LIMITS, pii_types=PII_TYPES, terms=TERMS)
    _run(out.select("seq", "status", F.round("quality_score", 6).alias("quality")).writeStream.format("parquet")
         .option("path", sink), spark)
    return spark.read.schema("seq bigint, status string, quality double").parquet(sink)


def streamed_first_arrivals(spark, folder):
    """Number of distinct contents that pass the stream."""
    source, sink = scratch(spark, "arriving"), scratch(spark, "distinct")
    raw(spark, folder).select("seq", "title", "abstract", F.lit(SCRAPED_AT).cast("timestamp").alias("ts")).write.parquet(source)
    stream = spark.readStream.schema("seq bigint, title string, abstract string, ts timestamp").parquet(source)
    out = streams.first_arrivals(stream, "ts").select("hash_sha256")
    _run(out.writeStream.format("parquet").option("path", sink), spark)
    return spark.read.schema("hash_sha256 string").parquet(sink)


def streamed_daily_counts(spark, folder):
    source, sink = scratch(spark, "arriving"), scratch(spark, "daily")
    table(spark, folder, "events").select(F.col("ts").cast("timestamp").alias("ts")).write.parquet(source)
    stream = spark.readStream.schema("ts timestamp").parquet(source)
    counts = streams.daily_counts(stream, limit=400)
    _run(counts.writeStream.outputMode("update").foreachBatch(streams.count_batches(sink)), spark)
    back = writers.read_snapshot(spark, sink)
    return back.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "used", "remaining")


def streamed_upsert(spark, folder):
    """Keyed table kept by a stream."""
    source, root = scratch(spark, "arriving"), scratch(spark, "streamed-table")
    raw(spark, folder).withColumn("hash_sha256", T.content_hash("title", "abstract")).select(
        "seq", "pmid", "source", "hash_sha256").write.parquet(source)
    stream = spark.readStream.schema("seq bigint, pmid string, source string, hash_sha256 string").parquet(source)
    _run(stream.writeStream.foreachBatch(streams.upsert_batches(root)), spark)
    return writers.read_snapshot(spark, root).select("hash_sha256", "pmid", "source")


def streamed_keep_first(spark, folder):
    """Titles kept by a stream that remembers the titles of earlier batches; even ids arrive before odd ones."""
    source, root, checkpoint = scratch(spark, "arriving"), scratch(spark, "kept"), scratch(spark, "stream")
    docs = raw(spark, folder).select("seq", "title", "abstract")
    for half in (0, 1):
        docs.where(F.pmod("seq", F.lit(2)) == half).write.mode("append").parquet(source)
        stream = spark.readStream.schema("seq bigint, title string, abstract string").parquet(source)
        _run(stream.writeStream.foreachBatch(streams.keep_first_batches(root)), spark, checkpoint)
    return spark.read.parquet(root).select("seq")


ALL = [
    clean_documents, composed_documents, content_hashes, text_measures, compliance_records, pii_redaction, pii_counts, pii_totals,
    pii_free_documents, content_gate, record_scores, record_validation, validation_summary, allowlist_flags, crawl_rules,
    fetch_outcomes, fetch_statistics, page_records, generic_records, link_edges, parsed_pages, url_list_scan,
    url_list_totals, listed_page_records, exact_duplicates, similar_titles, similar_title_ratios, first_visits,
    unvisited_urls, document_keywords, entities, entities_joined, entity_labels, qa_training_rows, cache_lookup,
    cache_misses, embedded_documents, cosine_to_mean, nearest_to_mean, nearest_vectors, judged_pages, multilingual_qa, single_language_qa,
    extracted_content, prompts, topic_lines, suggested_urls, topic_results, topic_totals, topic_folders, curated_exact,
    curation_counters, default_counters, curated_entries, exported_entries, upserted_table, stored_files, article_xml,
    first_urls_per_site, daily_admission, daily_remaining, sample_rows, streamed_curation, streamed_first_arrivals,
    streamed_daily_counts, streamed_upsert, streamed_keep_first,
]
QUERIES = {f.__name__: f for f in ALL}
