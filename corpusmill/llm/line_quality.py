"""Quality rules from cross-document line frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusmill.llm import simhash
from corpusmill.llm.common import WHITE, WHITE_CHARS, stage, words_of
from corpusmill.llm.decontamination import hash_filter, in_filter

SYMBOLS = "#*$%&|<>"
#: One character of white space.
WHITE_CHAR = WHITE.rstrip("+")
WINDOW = 5
#: Common lines up to this number are sent to every task as they are; more are joined by a shuffle, salted.
PLAIN_LINES = 50_000


def normal_lines(text: Column) -> Column:
    """The lines of a text in lower case, with digits as 0 and everything that is no letter or digit as one space. The text is worked on as a
    whole; line ends stay where they are."""
    bare = F.regexp_replace(F.lower(text), r"\p{Nd}", "0")
    return F.transform(F.split(F.regexp_replace(bare, r"[^\p{L}\p{N}\n]+", " "), "\n"), lambda x: F.btrim(x))


def line_key(line: Column) -> Column:
    """Hash of one line in its normal form."""
    return F.xxhash64(normal_lines(line)[0])


def repeated_words(windows: Column) -> Column:
    """Number of word positions inside windows that occur at least twice, from the array of window hashes in text order.

    Sorted (hash, position) pairs bring equal windows together; each repeated position then covers the words up to the next
    one, a window's length at most. Texts without a repeated window stop at the comparison of sizes."""
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(s: Column) -> Column:
        same = lambda k, j: F.coalesce(F.get(s, k)["h"] == F.get(s, j)["h"], F.lit(False))
        hit = F.filter(s, lambda x, k: same(k, k - 1) | same(k, k + 1))
        return F.sort_array(F.transform(hit, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

    return F.when(F.size(windows) == F.size(F.array_distinct(windows)), 0).otherwise(bound(bound(pairs, twice), covered))


def bound(value: Column, build) -> Column:
    """`build` over a variable, so that an expression used many times is computed once."""
    return F.transform(F.array(value), build)[0]


def measured(docs: DataFrame, text: str, id_column: str, host: str) -> DataFrame:
    """Narrow row per document: counts of the base rules, and hash and word count of its lines."""
    base = docs.select(
        F.col(id_column).alias("id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
        F.xxhash64(text).alias("digest"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    filled = F.split("text", "\n")
    hashed = base.select(
        "id", "host", "digest", "text", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("w"),
        F.filter(filled, lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("filled"), F.arrays_zip(filled.alias("line"), normal_lines(F.col("text")).alias("normal")).alias("lines"),
    )
    count = F.size("w")
    windows = F.when(
        count >= WINDOW,
        F.transform(F.sequence(F.lit(0), count - WINDOW), lambda i: F.xxhash64(*(F.get("w", i + k) for k in range(WINDOW)))),
    ).otherwise(F.array().cast("array<bigint>"))
    seen = hashed.select("*", windows.alias("windows"))
    # Only lines with a letter or digit have a normal form.
    lines = F.filter("lines", lambda x: x["normal"] != "")
    lines = F.transform(lines, lambda x: F.struct(F.xxhash64(x["normal"]).alias("h"), F.size(F.split(F.btrim(x["line"], F.lit(WHITE_CHARS)), WHITE)).alias("n")))
    return seen.select(
        "id", "host", "digest", F.size("w").cast("long").alias("n_words"),
        (F.length("text") - F.regexp_count("text", F.lit(WHITE_CHAR))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        (F.size("filled") - F.size(F.array_distinct("filled"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("windows")).cast("long").alias("n_repeat_words"), lines.alias("lines"),
    )


def with_common(lines: DataFrame, common: DataFrame, key: str, salts: int) -> DataFrame:
    """Rows of `lines` (host, h and others) whose line is in the staged table `common` (host, h). A common line is by nature a hot key: its
    occurrences are salted by `key`, and its single row is repeated for each salt. Rows repeated so are never broadcast: the optimizer takes them for as
    small as the table they come from, and the driver would hold all of them. A small table is broadcast without salts."""
    if common.count() <= PLAIN_LINES:
        return lines.join(F.broadcast(common), ["host", "h"])
    salted = lines.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int"))
    spread_out = common.select("host", "h", F.explode(F.lit(list(range(salts)))).alias("salt"))
    return salted.join(spread_out.hint("merge"), ["host", "h", "salt"]).drop("salt")


def copy_groups(docs: DataFrame, text: str, digests: DataFrame) -> DataFrame:
    """(digest, label) of the texts with the given digests: near duplicates by the rule of `simhash.near_duplicates`, among these
    texts, share a label. A Bloom filter of fixed size keeps the other texts from being fingerprinted."""
    bits = hash_filter(digests.select(F.col("digest").alias("h")))
    wanted = docs.select(F.xxhash64(text).alias("digest"), F.col(text).alias("text")).where(in_filter(bits, F.col("digest")))
    prints = wanted.select("digest", simhash.native_fingerprint(F.col("text")).alias("fingerprint")).distinct()
    prints = stage(prints.join(digests, "digest", "left_semi"), "prints")
    labels = simhash.connected_components(simhash.fingerprint_links(prints.select("fingerprint").distinct()))
    labels = stage(labels.select(F.col("node").alias("fingerprint"), "label"), "labels")
    return prints.join(labels, "fingerprint", "left").select("digest", F.coalesce("label", "fingerprint").alias("label"))


def common_lines(rows: DataFrame, docs: DataFrame, text: str, max_documents: int, max_share: float, salts: int) -> DataFrame:
    """(host, h) of lines above the limit: they stand in more than `max_documents` distinct documents of a host, and in more than the
    share `max_share` of all its distinct documents.

    Exact copies of a document count once (same digest), and so do near copies (one component of near duplicates), which
    near-duplicate removal brings down to one. Components are built only for documents with a line that is above the limit by
    digests. Every count is a hash aggregate that combines before its shuffle, so a line that a third of all documents
    hold arrives as one row per task.
    """
    found = rows.select("host", "digest", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    once = found.distinct()
    limits = rows.select("host", "digest").distinct().groupBy("host").agg(F.greatest(F.lit(max_documents), max_share * F.count("*")).alias("limit"))
    limits = stage(limits, "limits")
    above = lambda df: df.groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") > max_documents).join(limits, "host").where("n > limit")
    many = stage(above(once).select("host", "h"), "many")
    held = stage(with_common(once, many, "digest", salts), "held")
    groups = stage(copy_groups(docs, text, stage(held.select("digest").distinct(), "digests")), "groups")
    apart = held.join(groups, "digest").select("host", "h", "label").distinct()
    return above(apart).select("host", "h")


def line_verdicts(
    docs: DataFrame, text: str = "text", id_column: str = "doc_id", host: str = "source", max_documents: int = 10,
    max_share: float = 0.01, max_removed: float = 0.5, min_words: int = 10, salts: int = 32,
) -> DataFrame:
    """One row per row of `docs`: id, digest (of the text), host, the base counts, base_failed, kept, removed_words and removed (hashes of
    the lines to remove).

    base_failed: fewer than `min_words` words, or over a fifth of the words lie in five-word windows that the text repeats. Of
    the others those are depleted, and not kept, that lose over `max_removed` of their words with the common lines of their host
    (`common_lines`; a line counts if it holds a letter or digit) or keep fewer than `min_words`.

    A null text counts as empty and fails the base rule; null hosts are one host of their own; repeated rows give a row each, with
    the same verdict; an empty table gives no rows; other columns are not read.
    """
    rows = stage(measured(docs, text, id_column, host).select("*", F.monotonically_increasing_id().alias("row")), "lines")
    common = stage(common_lines(rows, docs, text, max_documents, max_share, salts), "common")
    held = rows.where(F.size("lines") > 0).select("row", "host", F.explode("lines").alias("line")).select("row", "host", "line.h", "line.n")
    removed = with_common(held, common, "row", salts).groupBy("row").agg(F.sum("n").alias("removed_words"), F.collect_set("h").alias("removed"))
    lost = F.coalesce("removed_words", F.lit(0))
    base_failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    depleted = (lost > max_removed * F.col("n_words")) | (F.col("n_words") - lost < min_words)
    return rows.drop("lines").join(removed, "row", "left").select(
        "id", "digest", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"),
        (~base_failed & ~depleted).alias("kept"), lost.alias("removed_words"), "removed",
    )


def apply_line_rules(docs: DataFrame, text: str = "text", id_column: str = "doc_id", host: str = "source", length: str = "n_chars", **limits) -> DataFrame:
    """`docs` without the rejected documents; the others lose the common lines of their host, and `length`, if there is such a
    column, is counted anew for them. Rows are recognised by id, host and text, so repeated rows share a fate."""
    found = line_verdicts(docs, text, id_column, host, **limits).where("kept")
    found = found.groupBy(F.col("id").alias("_id"), F.col("host").alias("_host"), F.col("digest").alias("_digest")).agg(F.first("removed").alias("_removed"))
    same = docs[id_column].eqNullSafe(F.col("_id")) & (F.coalesce(docs[host].cast("string"), F.lit("")) == F.col("_host")) & (F.xxhash64(docs[text]) == F.col("_digest"))
    kept = docs.join(found, same)
    lines = F.arrays_zip(F.split(text, "\n").alias("line"), normal_lines(F.col(text)).alias("normal"))
    rest = F.array_join(F.filter(lines, lambda x: ~F.array_contains("_removed", F.xxhash64(x["normal"])))["line"], "\n")
    changed = kept.withColumn(text, F.when(F.col("_removed").isNull(), F.col(text)).otherwise(rest))
    if length in docs.columns:
        changed = changed.withColumn(length, F.when(F.col("_removed").isNull(), F.col(length)).otherwise(F.length(text)).cast(docs.schema[length].dataType))
    return changed.select(*docs.columns)
