"""Divergence of the sources of a language: term counts folded into stripes, merged by term, and compared exactly."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusmill.llm.common import bounded_batches, slices, stage, word_codes

SCALE = 1_000_000_000
#: What a term is made of, byte by byte: ASCII letters (lower-cased) and all bytes of other characters. The rest parts terms.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
STRIPES = "lang string, term string, documents long, sources array<string>, counts array<long>"
#: Counts that a task holds before it spills its stripes; pairs of sources it holds, and compares at once.
HELD_COUNTS = 600_000
HELD_PAIRS = 200_000
BLOCK_PAIRS = 1 << 20
#: Rows of an Arrow batch of stripes.
ROWS = 10_000


def counted(batch: pa.RecordBatch) -> pa.Table:
    """(lang, source, term, count, documents) of a batch of documents (lang, source, text)."""
    texts = batch.column(2).cast(pa.binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2][bounds[0] : bounds[-1]].to_pybytes().translate(TERM_BYTES) if texts.buffers()[2] else b""
    clean = pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(np.ascontiguousarray(bounds - bounds[0])), pa.py_buffer(data)])
    terms, codes, offsets = word_codes(clean)
    document = np.repeat(np.arange(len(texts)), np.diff(offsets))
    full = codes != pc.index(terms, "").as_py()
    pairs, times = np.unique(document[full] * len(terms) + codes[full], return_counts=True)
    document, term = np.divmod(pairs, max(1, len(terms)))
    langs, sources = (pc.dictionary_encode(batch.column(k)) for k in (0, 1))
    lang, source = (x.indices.to_numpy().astype(np.int64)[document] for x in (langs, sources))
    keys, place = np.unique((lang * len(sources.dictionary) + source) * len(terms) + term, return_inverse=True)
    counts, documents = np.zeros(len(keys), np.int64), np.bincount(place, minlength=len(keys))
    np.add.at(counts, place, times)
    group, term = np.divmod(keys, max(1, len(terms)))
    lang, source = np.divmod(group, max(1, len(sources.dictionary)))
    return pa.table({"lang": langs.dictionary.take(pa.array(lang)), "source": sources.dictionary.take(pa.array(source)), "term": terms.take(pa.array(term)), "count": counts, "documents": documents})


def combined(tables: list[pa.Table]) -> pa.Table:
    """Counts added up by (lang, source, term), in a hash table."""
    found = pa.concat_tables(tables).group_by(["lang", "source", "term"], use_threads=False).aggregate([("count", "sum"), ("documents", "sum")])
    return found.select(["lang", "source", "term", "count_sum", "documents_sum"]).rename_columns(["lang", "source", "term", "count", "documents"])


def as_stripes(table: pa.Table) -> pa.RecordBatch:
    """A row per (lang, term) with its documents, sources and counts."""
    table = table.combine_chunks()
    langs, terms = (pc.dictionary_encode(table.column(c).combine_chunks()) for c in ("lang", "term"))
    key = langs.indices.to_numpy().astype(np.int64) * max(1, len(terms.dictionary)) + terms.indices.to_numpy()
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    offsets = pa.array(np.append(starts, len(key)).astype(np.int32))
    lang, term = np.divmod(key[starts], max(1, len(terms.dictionary)))
    pick = lambda c: table.column(c).combine_chunks().take(pa.array(order))
    documents = np.add.reduceat(pick("documents").to_numpy(), starts) if len(key) else np.zeros(0, np.int64)
    arrays = [langs.dictionary.take(pa.array(lang)), terms.dictionary.take(pa.array(term)), pa.array(documents, pa.int64())]
    arrays += [pa.ListArray.from_arrays(offsets, pick(c)) for c in ("source", "count")]
    return pa.RecordBatch.from_arrays(arrays, names=["lang", "term", "documents", "sources", "counts"])


def fold(docs: DataFrame, held: int = HELD_COUNTS) -> DataFrame:
    """Stripes of (lang, source, text): a task folds whole documents into (lang, term) -> (number of documents, count per source). It
    spills all its stripes when they hold `held` counts, so its memory does not follow the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: list[pa.Table] = []

        def spilled() -> Iterator[pa.RecordBatch]:
            stripes = as_stripes(combined(tables)) if tables else None
            tables.clear()
            for i in range(0, stripes.num_rows if stripes else 0, ROWS):
                yield stripes.slice(i, ROWS)

        for batch in slices(batches, "text", 4 << 20):
            tables.append(counted(batch))
            if sum(t.num_rows for t in tables) >= held:
                tables[:] = [combined(tables)]
                # What combining does not halve is spilled, so that it is not combined again and again.
                if tables[0].num_rows >= held // 2:
                    yield from spilled()
        yield from spilled()

    bounded_batches()
    return docs.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(run, STRIPES)


def added(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Neighbouring stripes of the same (lang, term) as one."""
    lang, term, documents, sources, counts = batch.columns
    new = pc.or_(*(pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)) for c in (lang, term))).to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(np.concatenate([[True], new]))
    run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, batch.num_rows)))
    coded = pc.dictionary_encode(sources.flatten())
    entry = np.repeat(run, sources.value_lengths().to_numpy())
    keys, place = np.unique(entry * len(coded.dictionary) + coded.indices.to_numpy(), return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, place, counts.flatten().to_numpy())
    entry, source = np.divmod(keys, max(1, len(coded.dictionary)))
    offsets = pa.array(np.searchsorted(entry, np.arange(len(starts) + 1)).astype(np.int32))
    at = pa.array(starts)
    arrays = [
        lang.take(at), term.take(at), pa.array(np.add.reduceat(documents.to_numpy(), starts), pa.int64()),
        pa.ListArray.from_arrays(offsets, coded.dictionary.take(pa.array(source))), pa.ListArray.from_arrays(offsets, pa.array(total)),
    ]
    return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, batch.schema)], schema=batch.schema)


def merge(stripes: DataFrame) -> DataFrame:
    """One stripe per (lang, term). Spilled stripes meet by key in sorted order and neighbours are added up, so a task holds one batch and
    the stripe that may go on in the next; a frequent term arrives once per spill, not once per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = added(batch if last is None else pa.concat_batches([last, batch]))
            yield whole.slice(0, whole.num_rows - 1)
            last = whole.slice(whole.num_rows - 1)
        if last is not None:
            yield last

    bounded_batches()
    return stripes.repartition("lang", "term").sortWithinPartitions("term", "lang").mapInArrow(run, STRIPES)


def quotient(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def rate(count: Column | str, total: Column | str) -> Column:
    """1 + floor(SCALE * (count + 1) / total); the product is a decimal, which holds it for every long."""
    above = (F.col(count) if isinstance(count, str) else count).cast("decimal(20,0)") + 1
    return (quotient(above * SCALE, F.col(total) if isinstance(total, str) else total) + 1).cast("long")


def gap(p: Column | str, q: Column | str) -> Column:
    """floor((p - q)^2 / q). Rates are at most SCALE + 1, so the square fits a long."""
    p, q = (F.col(c) if isinstance(c, str) else c for c in (p, q))
    return quotient((p - q) * (p - q), q)


def met_pairs(rows: DataFrame, held: int = HELD_PAIRS, block: int = BLOCK_PAIRS) -> DataFrame:
    """(lang, source, item, value): what the terms that two sources share add to their divergence, beyond what each source adds as if the
    other had none of them. A row of `rows` (lang, sources, rates, floors) is a merged stripe with the rate of each of its sources
    and the rate each has for a term it lacks. Values are summed per pair of sources before they leave the task; pairs are formed
    in blocks of `block`, whatever the number of sources of a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str, str], int] = defaultdict(int)

        def spilled() -> pa.RecordBatch:
            langs, sources, items = zip(*sums) if sums else ([],) * 3
            arrays = [pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(items, pa.string()), pa.array(sums.values(), pa.int64())]
            sums.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "item", "value"])

        def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
            return (p - q) ** 2 // q

        for batch in batches:
            lists = batch.column(1)
            size = np.diff(lists.offsets.to_numpy())
            coded = pc.dictionary_encode(lists.flatten())
            names, source = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
            rates, floors = (batch.column(k).flatten().to_numpy() for k in (2, 3))
            langs = pc.dictionary_encode(batch.column(0))
            row = np.repeat(np.arange(len(size)), size)
            lang = langs.indices.to_numpy().astype(np.int64)[row]
            first, partners = (np.cumsum(size) - size)[row], size[row]
            ends = np.cumsum(partners)
            start = 0
            while start < len(source):
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + block, "right")))
                width = partners[start:stop]
                left = np.repeat(np.arange(start, stop), width)
                right = np.repeat(first[start:stop] - np.cumsum(width) + width, width) + np.arange(len(left))
                apart = source[left] != source[right]
                left, right = left[apart], right[apart]
                p, p0, q, q0 = rates[left], floors[left], rates[right], floors[right]
                values = gaps(p, q) - gaps(p, q0) - gaps(p0, q) + gaps(p0, q0)
                keys, place = np.unique((lang[left] * len(names) + source[left]) * len(names) + source[right], return_inverse=True)
                total = np.zeros(len(keys), np.int64)
                np.add.at(total, place, values)
                for key, value in zip(keys.tolist(), total.tolist()):
                    rest, b = divmod(key, len(names))
                    k, a = divmod(rest, len(names))
                    sums[langs.dictionary[k].as_py(), names[a], names[b]] += value
                start = stop
            if len(sums) >= held:
                yield spilled()
        yield spilled()

    bounded_batches()
    return rows.select("lang", "sources", "rates", "floors").mapInArrow(run, "lang string, source string, item string, value long")


def divergences(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_documents: int = 3, top: int = 200,
    held: int = HELD_COUNTS,
) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from the others and from the whole language.

    Terms are runs of ASCII letters and other characters from U+0080 on, with A-Z lowered. A language keeps the terms that at
    least `min_documents` of its documents hold. A source's rate of a kept term is 1 + floor(10^9 (count + 1) / (total + kept terms)), and the
    gap of p from q is floor((p - q)^2 / q). Part `pair`: for every other source of the language, the sum of gaps over all kept terms,
    all ranks. Part `term`: kept terms that the source has more often than the language, with the gap, up to rank `top`. Ranks
    go by value downwards, then by the item's bytes.

    The sum over a pair is taken apart so that no term meets a source without it: gaps as if no term were shared come from the
    number of terms at each rate of a source, and what shared terms change comes from the stripes (`met_pairs`). All numbers are
    integers. Null texts, languages and sources are empty strings; a (lang, source) without terms takes part with the rate of
    count zero; a language without kept terms has pairs of value zero; repeated rows are documents of their own; an empty table
    gives no rows; other columns are not read.
    """
    given = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))))
    groups = stage(given.select("lang", "source").distinct(), "groups")
    stripes = stage(merge(fold(given, held)).where(F.col("documents") >= min_documents), "stripes")
    whole = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    counts = stripes.select("lang", "term", whole.alias("all"), F.explode(F.arrays_zip("sources", "counts")).alias("c"))
    counts = counts.select("lang", "term", "all", F.col("c.sources").alias("source"), F.col("c.counts").alias("n"))

    kept = stripes.groupBy("lang").agg(F.count("*").alias("kept"), F.sum(whole).alias("lang_total"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("held"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    facts = groups.join(totals, ["lang", "source"], "left").join(kept, "lang", "left").select("lang", "source", *map(zero, ("total", "held", "kept", "lang_total")))
    floor = F.when(F.col("kept") > 0, rate(F.lit(0), F.col("total") + F.col("kept")))
    facts = stage(facts.withColumn("floor", floor), "facts")

    rated = counts.join(facts, ["lang", "source"]).select(
        "lang", "term", "source", "floor", rate("n", F.col("total") + F.col("kept")).alias("p"), rate("all", F.col("lang_total") + F.col("kept")).alias("q")
    )
    rated = stage(rated, "rated")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    terms = ranked(rated.where("p > q").select("lang", "source", F.col("term").alias("item"), gap("p", "q").alias("value"))).where(F.col("rank") <= top)

    other = facts.select("lang", F.col("source").alias("item"), F.col("floor").alias("other_floor"))
    pairs = stage(facts.select("lang", "source", "held", "kept", "floor").join(other, "lang").where("source <> item"), "pairs")
    spectrum = rated.groupBy("lang", "source", "p").agg(F.count("*").alias("n"))
    none = gap("floor", "other_floor")
    key = ["lang", "source", "item"]
    parts = [
        pairs.select(*key, F.coalesce((F.col("kept") - F.col("held")) * none, F.lit(0)).alias("value")),
        pairs.join(spectrum, ["lang", "source"]).select(*key, (F.col("n") * gap("p", "other_floor")).alias("value")),
        pairs.join(spectrum.withColumnRenamed("source", "item"), ["lang", "item"]).select(*key, (F.col("n") * (gap("floor", "p") - none)).alias("value")),
    ]
    shared = rated.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "floor")).alias("s")).where(F.size("s") > 1)
    met = met_pairs(shared.select("lang", F.col("s.source").alias("sources"), F.col("s.p").alias("rates"), F.col("s.floor").alias("floors")))
    for part in (*parts[1:], met):
        parts[0] = parts[0].union(part)
    between = ranked(parts[0].groupBy(*key).agg(F.sum("value").alias("value")))
    shown = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return shown(between, "pair").union(shown(terms, "term"))
