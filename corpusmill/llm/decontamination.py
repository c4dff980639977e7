"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusmill.llm.common import stage

#: Word offsets that each seed looks at; the positions between are ignored. Any 13 aligned words with at most 2
#: substitutions contain a placement of one of these seeds without a substitution (tested over all cases).
SEEDS = ((0, 1, 2, 3, 5, 8, 9), (0, 1, 2, 4, 5, 6, 7), (0, 1, 3, 6, 7, 9, 10))
#: Size of the filter of test hashes, a power of two: 2^20 bits. More test items let more rows pass it, never fewer.
FILTER_LONGS = 1 << 14


def plain_words(text: Column) -> Column:
    """Words of letters and digits in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def word_hashes(text: Column) -> Column:
    return F.transform(plain_words(text), lambda w: F.xxhash64(w))


def seed_hashes(hashes: str, number: int, seed: tuple[int, ...]) -> Column:
    """Hash of every placement of a seed, by the position of its first word."""
    last = F.size(hashes) - 1 - seed[-1]
    return F.when(
        last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.lit(number), *(F.get(hashes, i + o) for o in seed)))
    ).otherwise(F.array().cast("array<bigint>"))


def filter_bits(h: Column) -> tuple[Column, Column]:
    """Two bit numbers of the filter, from the two ends of a hash."""
    width = FILTER_LONGS.bit_length() + 5
    return F.shiftrightunsigned(h, 64 - width).cast("int"), h.bitwiseAND(F.lit((1 << width) - 1)).cast("int")


def hash_filter(keys: DataFrame) -> Column:
    """Bloom filter over the hashes `h`: an array of longs of fixed size whatever their number, as a scalar subquery over a staged table of one
    row. Put it into a column first; subqueries do not go into lambda functions, and a constant of this size would be repeated in
    every plan that uses it."""
    bits = keys.select(F.explode(F.array(*filter_bits(F.col("h")))).alias("bit"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63)))
    used = bits.groupBy(F.shiftright("bit", 6).cast("long").alias("id")).agg(F.bit_or(one).alias("bits"))
    longs = keys.sparkSession.range(FILTER_LONGS).join(used, "id", "left").select("id", F.coalesce("bits", F.lit(0)).alias("bits"))
    return stage(longs.agg(F.sort_array(F.collect_list(F.struct("id", "bits")))["bits"].alias("filter")), "filter").scalar()


def in_filter(bits: Column, h: Column) -> Column:
    tests = [F.getbit(F.get(bits, F.shiftright(b, 6)), b.bitwiseAND(F.lit(63))) == 1 for b in filter_bits(h)]
    return tests[0] & tests[1]


def alignments(docs: DataFrame, items: DataFrame, seeds=SEEDS, salts: int = 16) -> DataFrame:
    """Distinct (id, digest, item, shift) of documents and test items that agree on a seed; shift is the document's word position
    minus the item's.

    The seed hashes of a document are made and tested against the filter inside its row, so only hits and few chance
    survivors become rows. Both sides of the join are salted: a passage that a third of all documents quote is one hot key.
    """
    tests = items.select("item", F.posexplode(F.array(*(seed_hashes("w", k, s) for k, s in enumerate(seeds)))).alias("k", "hashes"))
    tests = stage(tests.select("item", F.posexplode("hashes").alias("at", "h")), "seeds")
    bits = hash_filter(tests)

    def hits(k: int) -> Column:
        found = lambda h, i: F.when(in_filter(F.col("filter"), h), F.struct(i.alias("at"), h.alias("h")))
        return F.filter(F.transform(seed_hashes("w", k, seeds[k]), found), lambda x: x.isNotNull())

    hashed = docs.select("id", "digest", word_hashes(F.col("text")).alias("w"), bits.alias("filter"))
    rows = hashed.select("id", "digest", F.explode_outer(F.concat(*(hits(k) for k in range(len(seeds))))).alias("hit")).where("hit is not null")
    rows = rows.select("id", "digest", "hit.h", "hit.at", F.pmod(F.col("digest"), F.lit(salts)).cast("int").alias("salt"))
    salted = tests.select("item", "h", F.col("at").alias("item_at"), F.explode(F.lit(list(range(salts)))).alias("salt"))
    return rows.join(salted, ["h", "salt"]).select("id", "digest", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct()


def short_overlaps(base: DataFrame, items: DataFrame, generic_words: int, generic_documents: int, salts: int) -> DataFrame:
    """Rows as of `contaminated` for items (item, w) shorter than a window: a document that holds all words of the item in a row.

    Placements of the lengths that occur are tested against the filter inside the row; a hit is verified word by word. Items of fewer
    than `generic_words` words that over `generic_documents` documents hold are left out as common phrases; by default none is."""
    lengths = sorted(r["n"] for r in items.select(F.size("w").alias("n")).distinct().collect())  # fewer than a window has words
    if not lengths:
        return base.sparkSession.createDataFrame([], base.select("id", "digest").schema).join(items.select("item").where("false")).selectExpr(
            "id", "digest", "item", "0 start", "0 n_words", "0 n_matches")
    keys = items.select("item", F.col("w").alias("iw"), F.xxhash64("w").alias("h"))
    bits = hash_filter(keys)

    def hits(n: int) -> Column:
        cut = lambda i: F.slice("w", i + 1, n)
        found = lambda i: F.when(in_filter(F.col("filter"), F.xxhash64(cut(i))), F.struct(i.alias("at"), cut(i).alias("dw"), F.xxhash64(cut(i)).alias("h")))
        every = F.transform(F.sequence(F.lit(0), F.size("w") - n), found)
        return F.when(F.size("w") >= n, F.filter(every, lambda x: x.isNotNull()))

    hashed = base.select("id", "digest", word_hashes(F.col("text")).alias("w"), bits.alias("filter"))
    none = F.array().cast("array<struct<at:int,dw:array<bigint>,h:bigint>>")
    rows = hashed.select("id", "digest", F.explode_outer(F.concat(*(F.coalesce(hits(n), none) for n in lengths))).alias("hit")).where("hit is not null")
    rows = rows.select("id", "digest", "hit.*", F.pmod(F.col("digest"), F.lit(salts)).cast("int").alias("salt"))
    salted = keys.select("*", F.explode(F.lit(list(range(salts)))).alias("salt"))
    found = rows.join(salted, ["h", "salt"]).where(F.col("dw") == F.col("iw"))
    found = stage(found.groupBy("id", "digest", "item").agg(F.min("at").alias("start"), F.min(F.size("iw")).alias("n_words")), "short")
    often = found.where(F.col("n_words") < generic_words).groupBy("item").agg(F.count("*").alias("n"))
    generic = often.where(F.col("n") > generic_documents).select(F.col("item").alias("i"))
    return found.join(generic, F.col("item").eqNullSafe(F.col("i")), "left_anti").select("id", "digest", "item", "start", "n_words", F.col("n_words").alias("n_matches"))


def contaminated(
    docs: DataFrame, items: DataFrame, text: str = "text", id_column: str = "doc_id", item_text: str = "text", item_column: str = "item_id",
    window: int = 13, substitutions: int = 2, salts: int = 16, generic_words: int = 0, generic_documents: int = 10,
) -> DataFrame:
    """(id, digest, item, start, n_words, n_matches), one row per document and item with a verified overlap.

    Overlap: in one alignment, without insertions, some `window` consecutive words differ in at most `substitutions`. start is
    the document's first overlapping word, n_words and n_matches cover all such windows of the best alignment. An item shorter
    than a window overlaps where all its words stand in a row (`short_overlaps`, which can leave out common phrases if asked to). Null texts are left out. Repeated rows (same id
    and text) share one result row, null ids are kept as null, repeated items are reported each; empty tables give no rows.
    """
    base = docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("digest"), F.col(text).alias("text"))
    every = items.select(F.col(item_column).alias("item"), word_hashes(F.col(item_text)).alias("w")).distinct()
    tests = every.where(F.size("w") >= window)
    short = short_overlaps(base, every.where(F.size("w").between(1, window - 1)), generic_words, generic_documents, salts)
    found = stage(alignments(base, tests, salts=salts), "alignments")
    wanted = found.select(F.col("id").alias("i"), F.col("digest").alias("d")).distinct()
    texts = base.join(wanted, F.col("id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d")), "left_semi").dropDuplicates(["id", "digest"])
    hashed = texts.select(F.col("id").alias("i"), F.col("digest").alias("d"), word_hashes(F.col("text")).alias("dw"))
    salted = tests.select(F.col("item").alias("i"), F.col("w").alias("iw"), F.explode(F.lit(list(range(salts)))).alias("s"))
    pairs = found.join(hashed, F.col("id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d"))).drop("i", "d")
    first = F.greatest(F.lit(0), -F.col("shift"))
    beyond = F.least(F.size("iw"), F.size("dw") - F.col("shift"))
    salt = F.pmod(F.col("digest"), F.lit(salts)).cast("int")
    cut = pairs.join(salted, F.col("item").eqNullSafe(F.col("i")) & (salt == F.col("s"))).drop("i", "s")
    cut = cut.withColumn("first", first).withColumn("length", beyond - first).where(F.col("length") >= window)
    equal = F.transform(F.sequence(F.lit(0), F.col("length") - 1), lambda k: F.get("iw", F.col("first") + k) == F.get("dw", F.col("first") + F.col("shift") + k))
    cut = cut.select("id", "digest", "item", (F.col("first") + F.col("shift")).alias("begin"), equal.alias("equal"))
    # A window is good if enough of its words match; a sliding sum over a slice stays linear in the item's length.
    good = F.filter(
        F.sequence(F.lit(0), F.size("equal") - window),
        lambda k: F.size(F.filter(F.slice("equal", k + 1, window), lambda x: x)) >= window - substitutions,
    )
    cut = cut.select("*", good.alias("good")).where(F.size("good") > 0)
    start, end = F.array_min("good"), F.array_max("good") + window
    cut = cut.select("id", "digest", "item", (F.col("begin") + start).alias("start"), (end - start).alias("n_words"),
                     F.size(F.filter(F.slice("equal", start + 1, end - start), lambda x: x)).alias("n_matches"))
    best = cut.groupBy("id", "digest", "item").agg(F.max(F.struct("n_matches", -F.col("n_words"), -F.col("start"))).alias("best"))
    found = best.select("id", "digest", "item", (-F.col("best.col3")).alias("start"), (-F.col("best.col2")).alias("n_words"), "best.n_matches")
    return found.unionByName(short)


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", id_column: str = "doc_id", **settings) -> DataFrame:
    """`docs` without the documents that overlap with a test item."""
    leaks = contaminated(docs, items, text, id_column, **settings).select(F.col("id").alias("_leak_id"), F.col("digest").alias("_leak_digest")).distinct()
    same = docs[id_column].eqNullSafe(F.col("_leak_id")) & (F.xxhash64(docs[text]) == F.col("_leak_digest"))
    return docs.join(stage(leaks, "leaks"), same, "left_anti")
