"""Toxicity scores from a factorization machine over hashed terms."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusmill.llm.common import bounded_batches, slices, stage, word_codes

BUCKETS = 1 << 22
WORD = re.compile(r"[^\W\d_]+")
#: A word counts whole and by its openings, so that endings not seen in training do not hide an insult.
OPENINGS = (4, 5, 6)


def piece_terms(piece: str) -> list[int]:
    """Hashed terms of one blank-separated piece of text."""
    terms = []
    for word in WORD.findall(piece.lower()):
        terms.append(zlib.crc32(b"w" + word.encode()) % BUCKETS)
        terms += [zlib.crc32(b"%d" % n + word[:n].encode()) % BUCKETS for n in OPENINGS if len(word) > n]
    return terms


class Machine:
    """score = sigmoid(bias + sum of weights + sum over pairs of terms of the product of their factors)."""

    def __init__(self, terms: list[int], factors: int = 6, seed: int = 11):
        self.place = {t: i for i, t in enumerate(terms)}
        self.bias = 0.0
        self.weights = np.zeros(len(terms))
        self.factors = np.random.default_rng(seed).normal(0, 0.05, (len(terms), factors))

    def raw(self, terms: np.ndarray, rows: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the sigmoid of `count` documents given as (term, row) pairs, and the factor sums of each."""
        sums = np.zeros((count, self.factors.shape[1]))
        np.add.at(sums, rows, self.factors[terms])
        squares = np.bincount(rows, (self.factors[terms] ** 2).sum(axis=1), count)
        return self.bias + np.bincount(rows, self.weights[terms], count) + 0.5 * ((sums**2).sum(axis=1) - squares), sums

    def fit(self, terms: np.ndarray, rows: np.ndarray, labels: np.ndarray, rounds: int = 250, rate: float = 0.1, decay: float = 1e-4) -> None:
        """Logistic loss, AdaGrad over all rows of the bounded sample."""
        count = len(labels)
        self.bias = float(np.log((labels.sum() + 1) / (count - labels.sum() + 1)))
        seen_w, seen_f, seen_b = np.full(len(self.weights), 1e-8), np.full(self.factors.shape, 1e-8), 1e-8
        for _ in range(rounds):
            scores, sums = self.raw(terms, rows, count)
            miss = (1 / (1 + np.exp(-np.clip(scores, -30, 30))) - labels) / count
            slope_w = np.bincount(terms, miss[rows], len(self.weights)) + decay * self.weights
            slope_f = np.zeros_like(self.factors)
            np.add.at(slope_f, terms, miss[rows, None] * (sums[rows] - self.factors[terms]))
            slope_f += decay * self.factors
            seen_w += slope_w**2
            seen_f += slope_f**2
            seen_b += miss.sum() ** 2
            self.weights -= rate * slope_w / np.sqrt(seen_w)
            self.factors -= 0.3 * rate * slope_f / np.sqrt(seen_f)
            self.bias -= rate * miss.sum() / np.sqrt(seen_b)

    def score_texts(self, texts: pa.Array, known: dict[str, tuple[int, ...]]) -> np.ndarray:
        pieces, codes, offsets = word_codes(texts)
        found = []
        for piece in pieces.to_pylist():
            if (places := known.get(piece)) is None:
                places = known[piece] = tuple(self.place[t] for t in piece_terms(piece) if t in self.place)
            found.append(places)
        telling = np.fromiter(map(bool, found), bool, len(found))
        at = np.flatnonzero(telling[codes]) if len(codes) else np.zeros(0, np.int64)
        rows = np.searchsorted(offsets, at, "right") - 1
        pairs = {(r, t) for r, c in zip(rows.tolist(), codes[at].tolist()) for t in found[c]}
        pairs = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        scores, _ = self.raw(pairs[:, 1], pairs[:, 0], len(texts))
        return 1 / (1 + np.exp(-np.clip(scores, -30, 30)))


def document_terms(docs: DataFrame, label: str) -> DataFrame:
    """(label, terms): distinct hashed terms of each document of the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            pieces, codes, offsets = word_codes(batch.column(1))
            terms = [piece_terms(p) for p in pieces.to_pylist()]
            rows = [sorted({t for c in set(codes[a:b].tolist()) for t in terms[c]}) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], names=["label", "terms"])

    bounded_batches()
    return docs.select(F.col(label).cast("int").alias("label"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "label int, terms array<int>")


def train(
    docs: DataFrame, labels: DataFrame, text: str = "text", id_column: str = "doc_id", label: str = "toxic", sample_rows: int = 10_000,
    max_terms: int = 4096, min_documents: int = 2, factors: int = 6,
) -> Machine:
    """Fit on a bounded sample of labelled rows: the `sample_rows` rows with the smallest hash of their id (all, if there are no more).

    Terms are counted on Spark; the `max_terms` that tell the classes apart best (likelihood ratio of their document counts) become the machine's
    inputs. Null labels are left out; without labels, or with one class only, every score is the share of that class."""
    chosen = labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull()).select(F.col(id_column).alias("_id"), F.col(label).alias("_label"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id", "_label").limit(sample_rows)
    # At most `sample_rows` rows of two numbers.
    sample = docs.select(F.col(id_column).alias("_i"), F.col(text).alias("text")).join(F.broadcast(chosen), F.col("_i") == F.col("_id"))
    rows = stage(document_terms(sample, "_label"), "terms")
    size, positive = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    counts = rows.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.sum("label").alias("hits")).where(F.col("n") >= min_documents)
    rate, n, hits = F.lit((positive + 1) / (size + 2)), F.col("n"), F.col("hits")
    gain = F.abs(hits * F.log((hits + 0.1) / (n * rate)) + (n - hits) * F.log((n - hits + 0.1) / (n * (1 - rate))))
    best = counts.select("term", gain.alias("gain")).where("gain > 4").orderBy(F.desc("gain"), "term").limit(max_terms)
    terms = [r["term"] for r in best.collect()]
    machine = Machine(terms, factors)
    known = F.lit(terms) if terms else F.array().cast("array<int>")
    kept = rows.select("label", F.array_intersect("terms", known).alias("terms")).collect()
    pairs = [(machine.place[t], i) for i, r in enumerate(kept) for t in r["terms"]]
    pairs = np.array(pairs, np.int64).reshape(-1, 2)
    machine.fit(pairs[:, 0], pairs[:, 1], np.array([r["label"] for r in kept], float))
    return machine


def scores(docs: DataFrame, machine: Machine, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(id, score) of every row, row-local. Only the text is an input; null and empty texts get the machine's bias."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for batch in slices(batches, "text"):
            if len(known) > 500_000:
                known.clear()
            found = machine.score_texts(batch.column(1), known)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["id", "score"])

    bounded_batches()
    narrow = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return narrow.mapInArrow(run, "id long, score double")


def fold(id_column: str = "doc_id", folds: int = 4) -> Column:
    """Fold of a row: crc32 of its id as text modulo `folds`."""
    return F.crc32(F.col(id_column).cast("string")) % folds
