"""Best-fit packing of documents into fixed-length sequences, planned on the histogram of lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from corpusmill.llm.common import bounded_batches, slices, stage
from corpusmill.llm.tokens import default_tokenizer_path, encode_documents, shared_encoder

PIECES = "id long, n_tokens long, lead int, crcs array<long>, part int, lead_rank long, full_start long"


def tokenized(docs: DataFrame, text: str, id_column: str, length: int, end_id: int, tokenizer: str, with_ids: bool) -> DataFrame:
    """One row per document: token count, the length of its first piece, checksums of its pieces, the task's number and, within the
    task, the rank among first pieces of that length and the number of full pieces before. Ranks are counted while the
    texts are read, so that no length, however frequent, is sorted or gathered; `stage` fixes them once written.

    A document of n tokens is cut into a first piece of 1 to `length` tokens and full pieces behind it; a first piece of
    full length counts as full (lead 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = shared_encoder(tokenizer), TaskContext.get().partitionId()
        ranks, full = np.zeros(length + 1, np.int64), 0
        for batch in slices(batches, "text"):
            ids, bounds = encode_documents(encoder, batch.column(1), end_id)
            counts = np.diff(bounds)
            leads = counts % length
            lead_ranks, full_starts, crcs = np.zeros(len(leads), np.int64), np.zeros(len(leads), np.int64), []
            for i, (a, b, lead) in enumerate(zip(bounds.tolist(), bounds[1:].tolist(), leads.tolist())):
                cuts = [a, *range(a + (lead or length), b, length), b]
                crcs.append([zlib.crc32(ids[x:y]) for x, y in zip(cuts, cuts[1:])])
                lead_ranks[i], full_starts[i] = ranks[lead], full
                ranks[lead] += 1
                full += (b - a) // length
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(leads, pa.int32()), pa.array(crcs, pa.list_(pa.int64())),
                       pa.array(np.full(len(leads), part, np.int32)), pa.array(lead_ranks), pa.array(full_starts)]
            names = ["id", "n_tokens", "lead", "crcs", "part", "lead_rank", "full_start"]
            if with_ids:
                columns.append(pa.array([ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    bounded_batches()
    narrow = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return narrow.mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))


def plan_slots(histogram: dict[int, int], length: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing over counts: rows (size, rank_from, rank_to, first_sequence, per_sequence, offset) and the number of sequences.

    Sequences with equal content are one class (space left, first number, how many). Sizes go in falling order; each fills the classes
    with the least space that still fits, as many per sequence as fit, and what is left over opens new sequences. A class only splits
    where a size runs out, and its space at least halves each time it is used, so a size range of `length` values needs at most
    about 3 * length classes and log2(length) rows for each of them, whatever the number of documents.
    """
    classes: dict[int, list[tuple[int, int]]] = {}  # space left -> (first sequence, number of sequences)
    rows, opened = [], 0
    for size in sorted((s for s, n in histogram.items() if n and s), reverse=True):
        rank, total = 0, histogram[size]

        def fill(first: int, number: int, space: int) -> None:
            nonlocal rank
            per = min(space // size, total - rank)
            full = min(number, (total - rank) // per)
            if full:
                rows.append((size, rank, rank + full * per, first, per, length - space))
                rank += full * per
                classes.setdefault(space - per * size, []).append((first, full))
            if full < number and rank < total:  # the last few, together in one more sequence
                rest = total - rank
                rows.append((size, rank, total, first + full, rest, length - space))
                rank = total
                classes.setdefault(space - rest * size, []).append((first + full, 1))
                full += 1
            if full < number:
                classes.setdefault(space, []).append((first + full, number - full))

        for space in sorted(k for k in classes if k >= size):
            if rank == total:
                break
            for first, number in classes.pop(space):
                if rank < total:
                    fill(first, number, space)
                else:
                    classes.setdefault(space, []).append((first, number))
        if rank < total:
            number = -(-(total - rank) // (length // size))
            first, opened = opened, opened + number
            fill(first, number, length)
    return rows, opened


def packed(
    docs: DataFrame, text: str = "text", id_column: str = "doc_id", length: int = 1024, end_id: int = 2, tokenizer: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, piece, start (tokens of the document before it), length, crc32 of its ids, sequence_id and offset; with
    `with_ids` also ids, little-endian unsigned 32-bit.

    Every document ends with `end_id`. Full pieces fill a sequence of their own. The shorter first pieces are planned on the
    histogram of their lengths (`length` counts, all that reaches the driver) and take planned slots by their rank within the
    length. A null or empty text is a document of one token; repeated rows are packed each; null ids stay null; an
    empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    rows = stage(tokenized(docs, text, id_column, length, end_id, tokenizer or default_tokenizer_path(), with_ids), "tokenized")
    counts = stage(rows.where("lead > 0").groupBy("lead", "part").agg(F.count("*").alias("n")), "counts")
    # (task, length) pairs before this one: a running sum over as many rows per length as there are tasks.
    before = counts.select(
        "lead", "part", (F.sum("n").over(Window.partitionBy("lead").orderBy("part")) - F.col("n")).alias("before")
    )
    slots, sequences = plan_slots({r["lead"]: r["n"] for r in counts.groupBy("lead").agg(F.sum("n").alias("n")).collect()}, length)
    schema = "lead int, rank_from long, rank_to long, first_sequence long, per_sequence long, slot long"
    plan = F.broadcast(spark.createDataFrame(slots, schema))  # bounded by `length`, see plan_slots
    extra = ["ids"] if with_ids else []
    leads = rows.where("lead > 0").join(before, ["part", "lead"]).withColumn("rank", F.col("before") + F.col("lead_rank"))
    leads = leads.join(plan, "lead").where("rank >= rank_from and rank < rank_to").withColumn("k", F.col("rank") - F.col("rank_from"))
    first = leads.select(
        "id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.col("lead").cast("long").alias("length"), F.get("crcs", F.lit(0)).alias("crc32"),
        (F.col("first_sequence") + F.expr("k div per_sequence")).alias("sequence_id"),
        (F.col("slot") + F.col("k") % F.col("per_sequence") * F.col("lead")).cast("long").alias("offset"), *extra,
    )
    lead_pieces = (F.col("lead") > 0).cast("int")
    # Numbers of full sequences: behind the planned ones, a range for each task.
    base = F.lit(sequences) + F.call_function("shiftleft", F.col("part").cast("long"), F.lit(40)) + F.col("full_start")
    full = rows.where(F.size("crcs") > lead_pieces).select(
        "id", "lead", base.alias("base"), lead_pieces.alias("skip"), *extra,
        F.posexplode(F.slice("crcs", lead_pieces + 1, F.size("crcs"))).alias("k", "crc32"),
    )
    full = full.select(
        "id", (F.col("k") + F.col("skip")).alias("piece"), (F.col("lead") + F.col("k").cast("long") * length).alias("start"), F.lit(length).cast("long").alias("length"),
        "crc32", (F.col("base") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *extra,
    )
    pieces = first.unionByName(full)
    if with_ids:
        pieces = pieces.withColumn("ids", F.substring("ids", (4 * F.col("start") + 1).cast("int"), (4 * F.col("length")).cast("int")))
    return pieces


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids) of `packed(..., with_ids=True)`: ids are the little-endian numbers of the sequence's pieces in order.
    A group holds one sequence, `length` tokens at most."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(ordered, F.lit(b""), lambda whole, x: F.concat(whole, x["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
