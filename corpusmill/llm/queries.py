"""Registered queries of this subpackage and the DuckDB SQL that some of them are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusmill.llm import (
    decontamination, html_blocks, language_id, license_scan, line_quality, merkle_manifest, packing, secret_tags, simhash, source_divergence,
    token_frames, toxicity, warc_revisits,
)
from corpusmill.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@register
def op6_simhash_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


@register
def op9_line_quality(spark: SparkSession, folder: str) -> DataFrame:
    found = line_quality.line_verdicts(read_table(spark, folder, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words"
    )


@register
def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.contaminated(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "start", "n_words", "n_matches")


@register
def op8_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    found = packing.packed(read_table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc32").alias("ids_crc32"), "sequence_id", "offset")


@register
def op5_token_frames(spark: SparkSession, folder: str) -> DataFrame:
    path = token_frames.scratch_files(spark)
    return token_frames.read_frames(token_frames.write_frames(read_table(spark, folder, "documents"), path))


@register
def op3_secret_tags(spark: SparkSession, folder: str) -> DataFrame:
    found = read_table(spark, folder, "documents").select("doc_id", secret_tags.secret_scan("text").alias("s"))
    count = lambda kind: F.size(F.filter("s.spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), count("crf"), "s.base_sha256", F.col("s.digest").alias("spans"))


@register
def op1_html_blocks(spark: SparkSession, folder: str) -> DataFrame:
    found = html_blocks.main_text(read_table(spark, folder, "pages").select("page_id", "url", "html"), name="text")
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@register
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = read_table(spark, folder, "documents"), read_table(spark, folder, "labels")
    machine = toxicity.train(docs, labels.where(toxicity.fold() != 2).select("doc_id", "toxic"))
    found = toxicity.scores(docs, machine)
    held_out = F.coalesce(toxicity.fold("id") == 2, F.lit(False))
    return found.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@register
def op4_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = license_scan.license_matches(read_table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "template", "start", "n_words", "containment")


@register
def op2_warc_revisits(spark: SparkSession, folder: str) -> DataFrame:
    records = warc_revisits.records_from_pages(read_table(spark, folder, "pages"))
    found = warc_revisits.resolve_revisits(records)
    return found.select("record_id", "canonical", F.unix_timestamp("ts").alias("seconds"), "response_id", F.unix_timestamp("response_ts").alias("response_seconds"), "status", "headers")


@register
def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return source_divergence.divergences(read_table(spark, folder, "documents"))


@register
def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    found = merkle_manifest.audited(read_table(spark, folder, "documents"), {"text": merkle_manifest.lower_ascii(F.col("text"))}, tampered)
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@register
def op13_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    found = language_id.languages(docs, language_id.train(docs.where(language_id.learnable())))
    held_out = ~F.coalesce(language_id.learnable("id"), F.lit(True))
    return found.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "lang_pred", "score", "rejected")


# The pages of the tables keep their article in one element; the SQL states its text. References decode after the markup is gone, the oldest also without their semicolon (headings cut inside one).
ORACLE["op1_html_blocks"] = """
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) AS t FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(t, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, url, replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(t, '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&amp') AS t FROM b),
d AS (SELECT page_id, url, trim(regexp_replace(replace(t, '&amp', '&'), '[\\s\\x{A0}]+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, length(text) AS n_chars FROM d
"""

ORACLE["op2_warc_revisits"] = """
WITH p AS (
  SELECT page_id AS n, url, sha1(coalesce(html, '')) AS tag, 'day ' || (page_id % 28) AS day, length(coalesce(html, ''))::VARCHAR AS size, 1700000000 + page_id * 60 AS t FROM pages
),
made AS (
  SELECT n * 8 AS id, url, t AS s, 'response' AS kind, 200 AS code, '"' || tag || '"' AS etag, day AS lm, 'text/html' AS ct, 'first' AS served, size AS cl, NULL AS cc, NULL AS page, NULL AS front FROM p
  UNION ALL SELECT n * 8 + 1, url || '#again', t + 86400, 'revisit', 304, '"' || tag || '"', day, 'text/html', 'second', '0', NULL, NULL, NULL FROM p
  UNION ALL SELECT n * 8 + 2, url || '#late', t - 86400, 'revisit', 304, NULL, NULL, NULL, 'early', NULL, NULL, NULL, NULL FROM p WHERE n % 3 = 0
  UNION ALL SELECT n * 8 + 3, url, t + 172800, 'revisit', 304, '"' || tag || 'x"', day, 'text/html', 'other', NULL, NULL, NULL, NULL FROM p WHERE n % 4 = 0
  UNION ALL SELECT n * 8 + 4, url, t + 259200, 'revisit', 304, NULL, NULL, NULL, 'bare', '0', 'no-cache', NULL, NULL FROM p WHERE n % 5 = 0
  UNION ALL SELECT n * 8 + 5, 'https://www.front.example.org/', t, 'response', CASE WHEN n % 7 = 0 THEN 200 ELSE 404 END, '"' || tag[1] || '"', NULL, NULL, NULL, NULL, NULL, n::VARCHAR, NULL FROM p WHERE n % 2 = 0
  UNION ALL SELECT n * 8 + 6, 'http://front.example.org:80?utm_source=x', t, 'revisit', 304, 'W/"' || tag[2] || '"', NULL, NULL, NULL, NULL, NULL, NULL, 'yes' FROM p
),
cut AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '(?i)^[a-z][a-z0-9+.-]*://', '') AS rest FROM made WHERE kind = 'revisit' OR code = 200),
parts AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^[^@]*@', ''), '^www[.]|:(80|443)$', '', 'g') AS host,
    regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(rest, '[?](.*)$', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[a-z]+|gclid|fbclid|msclkid|sessionid|phpsessid|jsessionid|sid)(=|$)'))) AS query
  FROM cut
),
named AS (SELECT *, coalesce(host || path || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END, '') AS canonical FROM parts),
latest AS (
  SELECT *, last_value(CASE WHEN kind = 'response' AND url IS NOT NULL THEN id END IGNORE NULLS) OVER (
    PARTITION BY canonical ORDER BY s, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rid FROM named
),
both_sides AS (
  SELECT v.*, r.s AS rs, r.etag AS r_etag, r.lm AS r_lm, r.ct AS r_ct, r.served AS r_served, r.cl AS r_cl, r.cc AS r_cc, r.page AS r_page, r.front AS r_front,
    CASE WHEN v.rid IS NULL THEN 'no_response' WHEN regexp_replace(r.etag, '^W/', '') <> regexp_replace(v.etag, '^W/', '') THEN 'mismatch'
      WHEN regexp_replace(r.etag, '^W/', '') = regexp_replace(v.etag, '^W/', '') THEN 'resolved' WHEN r.lm <> v.lm THEN 'mismatch' WHEN r.lm = v.lm THEN 'resolved' ELSE 'unverified' END AS status
  FROM latest v LEFT JOIN made r ON r.id = v.rid WHERE v.kind = 'revisit'
),
merged AS (
  SELECT *, list_filter([
    '"cache-control":"' || coalesce(cc, r_cc) || '"', '"content-length":"' || r_cl || '"', '"content-type":"' || r_ct || '"', '"etag":"' || replace(coalesce(etag, r_etag), '"', '\\"') || '"',
    '"last-modified":"' || coalesce(lm, r_lm) || '"', '"x-front":"' || coalesce(front, r_front) || '"', '"x-page":"' || coalesce(page, r_page) || '"', '"x-served":"' || coalesce(served, r_served) || '"'
  ], lambda x: x IS NOT NULL) AS entries FROM both_sides
)
SELECT id AS record_id, canonical, s AS seconds, rid AS response_id, rs AS response_seconds, status,
  CASE WHEN status IN ('resolved', 'unverified') THEN '{' || array_to_string(entries, ',') || '}' END AS headers FROM merged
"""

ORACLE["op11_source_divergence"] = """
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents),
w AS (SELECT lang, source, r, unnest(t) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS m FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 3),
c AS (SELECT w.lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(m) AS total FROM kept GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM d),
sums AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (coalesce(s.total, 0) + v.v) AS p,
    1 + (1000000000::HUGEINT * (k.m + 1)) // (v.total + v.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN sums s USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
sides AS (SELECT a.lang, a.source, b.source AS item FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source),
between_them AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT s.lang, s.source, 'pair' AS part, s.item, coalesce(value, 0)::BIGINT AS value FROM sides s LEFT JOIN between_them b ON s.lang = b.lang AND s.source = b.source AND s.item = b.item),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM dense WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


def merkle_sql(levels: int = 9) -> str:
    """Both kinds of trees level by level: c0, c1, ... are the nodes, a proof folds the rows' digests upwards. Nine levels hold 8^9 rows."""

    def field(name: str) -> str:
        return f"coalesce(octet_length(encode({name}::VARCHAR))::VARCHAR || ':' || {name}::VARCHAR, '-')"

    def tree(prefix: str, leaves: str) -> list[str]:
        parts = [f"{prefix}0 AS (SELECT tree, pos, n, digest FROM {leaves})"]
        for k in range(levels):
            parts.append(f"{prefix}r{k} AS (SELECT tree, pos // 8 AS run, any_value(n) AS n, list(digest ORDER BY pos) AS kids FROM {prefix}{k} GROUP BY tree, pos // 8)")
            parts.append(f"{prefix}{k + 1} AS (SELECT tree, run AS pos, (n + 7) // 8 AS n, CASE WHEN n > 1 THEN sha256(array_to_string(kids, '')) ELSE kids[1] END AS digest FROM {prefix}r{k})")
        return parts

    def climb(prefix: str, name: str, tree_column: str, rows: str) -> list[str]:
        """(columns of rows, proof, folded): each level adds the siblings and hashes, where the tree still has several nodes."""
        parts, last = [], rows
        for k in range(levels):
            parts.append(f"""{name}{k} AS (SELECT x.* REPLACE (x.pos // 8 AS pos,
              x.proof || CASE WHEN r.n > 1 THEN array_to_string(r.kids[1:x.pos % 8], '') || array_to_string(r.kids[x.pos % 8 + 2:], '') ELSE '' END AS proof,
              CASE WHEN r.n > 1 THEN sha256(array_to_string(r.kids[1:x.pos % 8], '') || x.folded || array_to_string(r.kids[x.pos % 8 + 2:], '')) ELSE x.folded END AS folded)
              FROM {last} x JOIN {prefix}r{k} r ON r.tree = x.{tree_column} AND r.run = x.pos // 8)""")
            last = f"{name}{k}"
        return parts

    fields = [field(f) for f in ("doc_id", "source", "lang", "n_chars", "text")]
    lowered = fields[:-1] + [field("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")]
    crc = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
      lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))))"""
    parts = [
        f"""d AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({' || '.join(fields)}) AS digest, CASE WHEN {crc} % 3 = 0 THEN sha256({' || '.join(lowered)}) END AS altered FROM documents)""",
        """leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d)""",
        *tree("c", "leaves"),
        f"""langs AS (SELECT tree AS lang_tree, 'top' AS tree, digest, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n FROM c{levels})""",
        *tree("t", "langs"),
        "asked AS (SELECT doc_id, digest AS leaf, tree, pos, '' AS proof, coalesce(altered, digest) AS folded FROM leaves)",
        *climb("c", "x", "tree", "asked"),
        f"""upper_part AS (SELECT x.doc_id, x.leaf, l.digest AS subroot, l.tree, l.pos, x.proof, x.folded FROM x{levels - 1} x JOIN langs l ON l.lang_tree = x.tree)""",
        *climb("t", "y", "tree", "upper_part"),
    ]
    return f"""WITH {', '.join(parts)}
    SELECT doc_id, leaf, subroot, t.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = t.digest AS verified FROM y{levels - 1} y JOIN t{levels} t ON t.tree = y.tree"""


ORACLE["op12_merkle_manifest"] = merkle_sql()
