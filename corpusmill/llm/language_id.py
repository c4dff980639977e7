"""Language identification: averaged hashed subword embeddings, a linear softmax and calibrated rejection."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusmill.llm.common import bounded_batches, slices, stage

BUCKET_BITS = 20
#: Subwords are runs of 1 to 4 characters of a word, of which the first and the last may be its border.
LONGEST = 4
BORDER = 1
UNKNOWN = "und"
#: Characters that are worked on at once, so that memory does not follow the length of a text.
BLOCK = 1 << 18


@cache
def character_kinds() -> np.ndarray:
    """2 for letters, 1 for the marks that belong to them, 0 for what parts words, by code point."""
    return np.fromiter(({"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)), np.uint8, 0x110000)


def character_stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of the lower-cased texts, each behind a border and with a border for all that is no letter or mark; where each
    text begins; whether it has a letter)."""
    lowered = [t.lower() for t in texts]
    stream = np.frombuffer(("\x01" + "\x01".join(lowered) + "\x01").encode("utf-32-le", "replace"), np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in lowered])]).astype(np.int64)
    kinds = character_kinds()[stream]
    lettered = np.add.reduceat(kinds == 2, starts[:-1], dtype=np.int64) > 0 if texts else np.zeros(0, bool)
    return np.where(kinds > 0, stream, np.uint32(BORDER)), starts, lettered


def grams(stream: np.ndarray, start: int, stop: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of subword: its bucket at every position of the stream from start to stop, and whether there is one."""
    border = stream[start : stop + LONGEST] == BORDER
    size = stop - start
    hashed, inside = np.zeros(size, np.uint32), np.ones(size, bool)
    for n in range(1, LONGEST + 1):
        found = min(size, len(stream) - start - n + 1)
        step = stream[start + n - 1 : start + n - 1 + found]
        hashed = hashed[:found] * np.uint32(0x9E3779B1) + step
        mixed = (hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)
        if n > 2:
            # All characters between the first and the last are no borders.
            inside = inside[:found] & ~border[n - 2 : n - 2 + found]
        there = ~border[:found] if n == 1 else ~(border[:found] & border[1 : 1 + found]) if n == 2 else inside
        yield mixed >> np.uint32(32 - BUCKET_BITS), there


def subwords(text: str) -> np.ndarray:
    """Buckets of the subwords of one text."""
    stream, _, _ = character_stream([text])
    return np.concatenate([buckets[there] for buckets, there in grams(stream, 0, len(stream) - 1)]).astype(np.int32)


class Model:
    """softmax of weights @ (mean embedding of the subwords) + bias, divided by a temperature. Buckets that training never met have a zero
    embedding but count in the mean, so foreign text draws the scores to the bias."""

    def __init__(self, languages: list[str], buckets: np.ndarray, size: int = 16, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.languages, self.buckets = languages, buckets
        self.embeddings = np.zeros((len(buckets) + 1, size))
        self.embeddings[:-1] = rng.uniform(-1 / size, 1 / size, (len(buckets), size))
        self.weights, self.bias = np.zeros((size, len(languages))), np.zeros(len(languages))
        self.temperature, self.threshold = 1.0, 0.0

    def places(self, subwords: np.ndarray) -> np.ndarray:
        """Rows of the embedding table; the last one is that of unknown buckets."""
        at = np.minimum(np.searchsorted(self.buckets, subwords), len(self.buckets) - 1)
        return np.where(self.buckets[at] == subwords, at, len(self.buckets))

    def logits(self, means: np.ndarray) -> np.ndarray:
        return means @ self.weights + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        scaled = logits / self.temperature
        scaled = np.exp(scaled - scaled.max(axis=1, keepdims=True))
        return scaled / scaled.sum(axis=1, keepdims=True)

    def means(self, places: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean embedding of each run of places; runs are not empty."""
        return np.add.reduceat(self.embeddings[places], offsets[:-1], axis=0) / np.diff(offsets)[:, None]

    def fit(self, places: np.ndarray, offsets: np.ndarray, labels: np.ndarray, epochs: int = 4, rate: float = 2.0, lift: float = 50, batch: int = 64, seed: int = 7) -> None:
        """Stochastic gradient descent on the cross-entropy over shuffled batches; the rate falls linearly to zero. A mean over many subwords
        leaves each a small gradient, so embeddings take steps `lift` times as long."""
        rng = np.random.default_rng(seed)
        sizes, starts = np.diff(offsets), offsets[:-1]
        steps, step = epochs * -(-len(labels) // batch), 0
        for _ in range(epochs):
            order = rng.permutation(len(labels))
            for begin in range(0, len(order), batch):
                rows = order[begin : begin + batch]
                size = sizes[rows]
                ends = np.cumsum(size)
                used = places[np.repeat(starts[rows] - ends + size, size) + np.arange(ends[-1])]
                means = self.means(used, np.concatenate([[0], ends]))
                logits = self.logits(means)
                miss = np.exp(logits - logits.max(axis=1, keepdims=True))
                miss /= miss.sum(axis=1, keepdims=True)
                miss[np.arange(len(rows)), labels[rows]] -= 1
                miss /= len(rows)
                now = rate * (1 - step / steps)
                back = (miss @ self.weights.T / size[:, None]).repeat(size, axis=0)
                self.weights -= now * means.T @ miss
                self.bias -= now * miss.sum(axis=0)
                touched, place = np.unique(used, return_inverse=True)
                slope = np.zeros((len(touched), back.shape[1]))
                np.add.at(slope, place, back)
                self.embeddings[touched] -= now * lift * slope
                self.embeddings[-1] = 0
                step += 1

    def calibrate(self, places: np.ndarray, offsets: np.ndarray, labels: np.ndarray, lost: float) -> None:
        """On rows that training did not use: the temperature with the least cross-entropy, then the threshold that rejects a share `lost`
        of them."""
        logits = self.logits(self.means(places, offsets))

        def loss(temperature: float) -> float:
            self.temperature = temperature
            return float(-np.log(self.probabilities(logits)[np.arange(len(labels)), labels] + 1e-12).mean())

        self.temperature = min(np.geomspace(0.05, 20, 61).tolist(), key=loss)
        self.threshold = float(np.quantile(self.probabilities(logits).max(axis=1), lost))

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(index of the likeliest language or -1 without letters, its calibrated probability) of each text.

        The mean and the softmax's weights are both linear, so where there are fewer languages than dimensions the embeddings are
        multiplied by the weights beforehand; every position then adds its subwords' rows to the sum of its text."""
        best, scores = np.full(len(texts), -1), np.zeros(len(texts))
        if not texts or not self.languages:
            return best, scores
        ahead = len(self.languages) <= self.embeddings.shape[1]
        table = (self.embeddings @ self.weights if ahead else self.embeddings).astype(np.float32)
        rows = np.full(1 << BUCKET_BITS, len(self.buckets), np.int32)
        rows[self.buckets] = np.arange(len(self.buckets))
        stream, starts, lettered = character_stream(texts)
        sums, counts = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts), np.int64)
        for start in range(0, int(starts[-1]), BLOCK):
            stop = min(start + BLOCK, int(starts[-1]))
            values, found = np.zeros((stop - start, table.shape[1]), np.float32), np.zeros(stop - start, np.int64)
            for buckets, there in grams(stream, start, stop):
                values[: len(there)] += table[np.where(there, rows[buckets], len(self.buckets))]
                found[: len(there)] += there
            first, last = np.searchsorted(starts, start, "right") - 1, np.searchsorted(starts, stop, "left")
            cuts = np.maximum(starts[first:last] - start, 0)
            sums[first:last] += np.add.reduceat(values, cuts, axis=0, dtype=np.float64)
            counts[first:last] += np.add.reduceat(found, cuts)
        means = sums[lettered] / counts[lettered, None]
        chances = self.probabilities(means + self.bias if ahead else self.logits(means))
        if lettered.any():
            best[lettered], scores[lettered] = chances.argmax(axis=1), chances.max(axis=1)
        return best, scores


def training_pieces(docs: DataFrame, text: str, id_column: str, lang: str, documents: int, pieces: int, words: int) -> DataFrame:
    """(language, subwords, spare) of the training sample: at most `documents` rows of each language (smallest hash of the id, then of language
    and text), of each at most `pieces` runs of `words` words (smallest hash). The ids are chosen from narrow columns; the texts of
    those rows only are fetched. A tenth is spare, for the calibration."""
    keyed = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(id_column).isNotNull())
    hashed = F.xxhash64(F.col(id_column).cast("string"))
    narrow = keyed.select(F.col(id_column).alias("_id"), F.col(lang).alias("_lang"), hashed.alias("_h"))
    # Of a large language twice as many rows as wanted pass, by their hash, so that no task ranks all of its rows.
    share = stage(narrow.groupBy("_lang").agg((2 * documents / F.count("*")).alias("_share")), "shares")
    near = narrow.join(share, "_lang").where(F.pmod("_h", F.lit(1 << 30)) < F.col("_share") * (1 << 30))
    order = Window.partitionBy("_lang").orderBy("_h", "_id")
    # Staged, so that the optimizer sees how small it is and does not shuffle the texts.
    chosen = stage(near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= documents).select("_id", "_lang").distinct(), "chosen")
    texts = keyed.select(F.col(id_column).alias("_id"), F.col(lang).alias("_lang"), F.col(text).alias("text")).join(chosen, ["_id", "_lang"])
    letters = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w.rlike(r"\p{L}"))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / words).cast("int")), lambda i: F.concat_ws(" ", F.slice("w", i * words + 1, F.lit(words))))
    cut = texts.select("_id", "_lang", letters.alias("w")).where(F.size("w") > 0).select("_id", "_lang", runs.alias("runs"))
    picked = F.slice(F.array_sort(F.transform("runs", lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("x")))), 1, pieces)
    return cut.select(F.col("_lang").cast("string").alias("language"), (F.pmod(F.xxhash64("_id", F.lit("spare")), F.lit(10)) == 0).alias("spare"), F.explode(picked["x"]).alias("text"))


def with_subwords(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [subwords(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["language", "spare", "subwords"])

    bounded_batches()
    return rows.mapInArrow(run, "language string, spare boolean, subwords array<int>")


def train(
    docs: DataFrame, text: str = "text", id_column: str = "doc_id", lang: str = "lang", documents: int = 1500, pieces: int = 4, words: int = 24,
    size: int = 16, lost: float = 0.005, rows: int = 12_000,
) -> Model:
    """Fit on a bounded sample of labelled rows: at most `documents` rows of each language, `pieces` runs of up to `words` words of each
    (`training_pieces`), and `rows` runs in all (smallest hash), which go to the driver. Short runs teach the model to decide on
    little text. Rows without text, language or id are left out; repeated rows count as often as they stand; ties fall by id.
    Without labelled rows the model knows no language."""
    sample = stage(with_subwords(training_pieces(docs, text, id_column, lang, documents, pieces, words)).where(F.size("subwords") > 0), "runs")
    table = sample.orderBy(F.xxhash64("subwords", "language"), "language").limit(rows).toArrow()
    names = table.column("language").to_numpy(zero_copy_only=False).astype(object)
    languages = sorted(set(names.tolist()), key=str.encode)
    lists = table.column("subwords").combine_chunks()
    found, offsets = lists.flatten().to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
    spare = table.column("spare").to_numpy(zero_copy_only=False).astype(bool)
    labels = np.array([languages.index(n) for n in names], np.int64)
    if spare.all() or not spare.any():
        spare = np.arange(len(labels)) % 10 == 9

    def part(keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.diff(offsets)
        return found[np.repeat(keep, sizes)], np.concatenate([[0], np.cumsum(sizes[keep])]), labels[keep]

    learnt, bounds, targets = part(~spare)
    model = Model(languages, np.unique(learnt), size)
    if len(targets):
        model.fit(model.places(learnt), bounds, targets)
    if spare.any():
        held, bounds, targets = part(spare)
        model.calibrate(model.places(held), bounds, targets, lost)
    return model


def languages(docs: DataFrame, model: Model, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(id, lang_pred, score, rejected) of every row, row-local and from the whole text alone. `und` with score 0 if the text is null
    or has no letter, or if the model knows no language; `rejected` where the calibrated probability is below the model's
    threshold, which text in no learned language is. Repeated rows give a row each; an empty table gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            best, scores = model.score(batch.column(1).to_pylist())
            named = [model.languages[i] if i >= 0 else UNKNOWN for i in best.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(named, pa.string()), pa.array(scores, pa.float64()), pa.array(scores < model.threshold)], names=["id", "lang_pred", "score", "rejected"])

    bounded_batches()
    narrow = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return narrow.mapInArrow(run, "id long, lang_pred string, score double, rejected boolean")


def learnable(id_column: str = "doc_id", folds: int = 4, held_out: int = 2) -> Column:
    """Rows that may be learned from: crc32 of the id as text is not `held_out` modulo `folds`."""
    return F.crc32(F.col(id_column).cast("string")) % folds != held_out
