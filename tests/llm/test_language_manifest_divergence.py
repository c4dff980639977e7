"""Language identification, Merkle manifest and source divergence against brute force."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from corpusmill.llm import language_id, merkle_manifest, source_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


# Source divergence


def slow_divergences(docs, top=200):
    count, per_lang, frequency, groups = collections.Counter(), collections.Counter(), collections.Counter(), set()
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = TERM.findall(lowered(text or ""))
        frequency.update((lang, t) for t in set(terms))
        count.update((lang, source, t) for t in terms)
        per_lang.update((lang, t) for t in terms)
    rows = []
    for lang, source in groups:
        kept = [t for (k, t), n in frequency.items() if k == lang and n >= 3]

        def rates(number):
            total = sum(number(t) for t in kept)
            return {t: 1 + 10**9 * (number(t) + 1) // (total + len(kept)) for t in kept}

        p = rates(lambda t: count[lang, source, t])
        pairs = []
        for k, other in groups:
            if k == lang and other != source:
                q = rates(lambda t: count[lang, other, t])
                pairs.append((-sum((p[t] - q[t]) ** 2 // q[t] for t in kept), other.encode(), other))
        q = rates(lambda t: per_lang[lang, t])
        found = [(-((p[t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if count[lang, source, t] and p[t] > q[t]]
        rows += [(lang, source, "pair", item, -v, i + 1) for i, (v, _, item) in enumerate(sorted(pairs))]
        rows += [(lang, source, "term", item, -v, i + 1) for i, (v, _, item) in enumerate(sorted(found)[:top])]
    return sorted(rows)


def divergence_rows(df, **options):
    return sorted(tuple(r) for r in source_divergence.divergences(df, **options).select("lang", "source", "part", "item", "value", "rank").collect())


def test_divergences_equal_brute_force(spark, sample):
    rows = [tuple(r) for r in sample.select("text", "lang", "source").collect()]
    assert divergence_rows(sample) == slow_divergences(rows)


def test_divergences_with_spills_and_ranks_cut(spark, sample):
    rows = [tuple(r) for r in sample.select("text", "lang", "source").collect()][:60]
    few = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    assert divergence_rows(few, held=50, top=7) == slow_divergences(rows, top=7)


def test_divergences_of_awkward_rows(spark, awkward, nothing):
    rows = [tuple(r) for r in awkward.select("text", "lang", "source").collect()]
    assert divergence_rows(awkward) == slow_divergences(rows)
    assert divergence_rows(nothing) == []


def test_sources_without_terms_and_languages_without_kept_terms(spark):
    rows = [("a b c", "x", "s1"), ("a b", "x", "s2"), ("a É é a", "x", "s2"), (None, "x", "s3"), ("1 2 !", "x", None), ("q", "y", "s1"), ("r", "y", "s2"), (None, None, None)]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    found = divergence_rows(df)
    assert found == slow_divergences(rows)
    assert [r[3:] for r in found if r[0] == "y"] == [("s2", 0, 1), ("s1", 0, 1)]


def test_met_pairs_in_blocks_equal_one_block(spark):
    rng = np.random.default_rng(2)
    rows = [("l", [f"s{i}" for i in rng.choice(40, k, replace=False)], rng.integers(5, 10**6, k).tolist(), rng.integers(1, 5, k).tolist()) for k in rng.integers(2, 30, 50).tolist()]
    df = spark.createDataFrame(rows, "lang string, sources array<string>, rates array<long>, floors array<long>")
    total = lambda **o: {tuple(r[:3]): r[3] for r in source_divergence.met_pairs(df, **o).groupBy("lang", "source", "item").agg(F.sum("value")).collect()}
    expected = collections.Counter()
    f = lambda p, q: (p - q) ** 2 // q
    for lang, sources, rates, floors in rows:
        for a, p, p0 in zip(sources, rates, floors):
            for b, q, q0 in zip(sources, rates, floors):
                if a != b:
                    expected[lang, a, b] += f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)
    assert total() == total(held=1, block=7) == dict(expected)


def test_rates_of_counts_beyond_a_long_product(spark):
    row = spark.createDataFrame([(10**17, 3 * 10**17)], "n long, t long").select(source_divergence.rate("n", "t").alias("r")).first()
    assert row["r"] == 1 + 10**9 * (10**17 + 1) // (3 * 10**17)


# Merkle manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def slow_tree(nodes):
    """(root, siblings of each node as functions of position)."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([H(*last[i : i + 8]) for i in range(0, len(last), 8)])

    def proof(position):
        parts = []
        for level in levels[:-1]:
            begin = position // 8 * 8
            parts.append((level[begin:position], level[position + 1 : begin + 8]))
            position //= 8
        return parts

    return levels[-1][0], proof


def slow_audit(docs):
    """docs: (doc_id, text, lang, source, n_chars)."""
    def leaf(d, change):
        text = d[1] if d[1] is None or not change else lowered(d[1])
        return H(*map(enc, (d[0], d[3], d[2], d[4], text)))

    by_lang = collections.defaultdict(list)
    for d in docs:
        by_lang[d[2]].append((d[0] is not None, d[0] or 0, leaf(d, False), d))
    langs = sorted(by_lang, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: slow_tree([x[2] for x in sorted(v, key=lambda x: x[:3])]) for k, v in by_lang.items()}
    root, top = slow_tree([trees[k][0] for k in langs])
    rows = []
    for number, k in enumerate(langs):
        for position, (_, _, given, d) in enumerate(sorted(by_lang[k], key=lambda x: x[:3])):
            parts = trees[k][1](position) + top(number)
            changed = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 3 == 0
            node = leaf(d, changed)
            for left, right in parts:
                node = H(*left, node, *right)
            rows.append((str(d[0]), given, trees[k][0], root, H(*(x for left, right in parts for x in left + right)), node, node == root))
    return sorted(rows)


def audit_rows(df):
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    found = merkle_manifest.audited(df, {"text": merkle_manifest.lower_ascii(F.col("text"))}, tampered)
    columns = "id leaf subroot root proof_sha256 folded_root verified".split()
    return sorted((str(r["id"]), *(r[c] for c in columns[1:])) for r in found.collect())


@pytest.mark.parametrize("size", [1, 2, 8, 9, 64, 65, 150])
def test_audit_equals_brute_force(spark, size):
    rows = [(i * 7, f"Text {i}" if i % 5 else None, None if i % 11 == 3 else "en" if i % 3 else f"l{i % 13}", f"s{i % 4}", i) for i in range(size)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = audit_rows(df)
    assert found == slow_audit(rows)
    assert size < 8 or {r[-1] for r in found} == {True, False}


def test_audit_of_awkward_rows(spark, awkward, nothing):
    rows = [tuple(r) for r in awkward.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert audit_rows(awkward) == slow_audit(rows)
    assert audit_rows(nothing) == []


def test_many_equal_rows_share_records(spark):
    rows = [(3, "Same", "en", "s", 4)] * 100 + [(4, "other", "en", "s", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert audit_rows(df) == slow_audit(rows)


def test_proofs_of_some_requests_only(spark, sample):
    rows = [tuple(r) for r in sample.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    given = merkle_manifest.digest_of(F.concat(*(merkle_manifest.encoded(F.col(f)) for f in ("doc_id", "source", "lang", "n_chars", "text"))))
    manifest = merkle_manifest.build_manifest(sample.select("doc_id", "lang", given.alias("given")), F.col("given"), "lang", ["doc_id"])
    asked = manifest.leaves.where("doc_id % 17 = 0 and tree <> '=en'").select("tree", "position", "height", "doc_id")
    found = merkle_manifest.inclusion_proofs(manifest, asked).select("doc_id", merkle_manifest.proof_digest(F.col("path")).alias("p"), F.hex("digest").alias("d")).collect()
    expected = {int(r[0]): (r[4], r[1]) for r in slow_audit(rows)}
    assert found and all((r["p"], r["d"].lower()) == expected[r["doc_id"]] for r in found)


# Language identification


@pytest.fixture(scope="module")
def learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs, language_id.train(docs.where(language_id.learnable()))


def test_held_out_accuracy(learned):
    docs, model = learned
    assert model.languages == ["de", "en", "es", "fr"]
    held = docs.where(~language_id.learnable())
    found = {r["id"]: r for r in language_id.languages(held, model).collect()}
    truth = {r["doc_id"]: r["lang"] for r in held.collect()}
    assert found.keys() == truth.keys() and len(truth) > 200
    assert sum(found[k]["lang_pred"] == truth[k] for k in truth) >= 0.99 * len(truth)
    assert sum(r["rejected"] for r in found.values()) <= 0.03 * len(found)
    assert all(0 <= r["score"] <= 1 for r in found.values())


def slow_subwords(text):
    found = []
    for word in regex.findall(r"[\p{L}\p{M}]+", text.lower()):
        marked = f"_{word}_"
        found += [marked[i : i + n] for n in range(1, 5) for i in range(len(marked) - n + 1) if marked[i : i + n] != "_"]
    return found


def test_subwords_are_the_grams_of_the_words():
    for text in ("a", "ab cd", "  The, quick-brown été 12 x² ", "", "日本語 テキスト", "e\u0301te\u0301!", "zz" * 300 + " z"):
        buckets, expected = collections.Counter(language_id.subwords(text).tolist()), collections.Counter(slow_subwords(text))
        assert sorted(buckets.values()) == sorted(expected.values())


@pytest.mark.parametrize("block", [1 << 18, 7])
def test_scores_equal_a_plain_mean(learned, block, monkeypatch):
    _, model = learned
    monkeypatch.setattr(language_id, "BLOCK", block)
    texts = ["The and of thing", "Être ou ne pas être", "", "12 34", "x" * 200 + " und der die " * 300, "日本語", "a"]
    best, scores = model.score(texts)
    place = {int(b): i for i, b in enumerate(model.buckets)}
    for text, b, s in zip(texts, best, scores):
        found = language_id.subwords(text).tolist()
        if not found:
            assert (b, s) == (-1, 0)
            continue
        mean = sum((model.embeddings[place[h]] for h in found if h in place), np.zeros(model.embeddings.shape[1])) / len(found)
        logits = (mean @ model.weights + model.bias) / model.temperature
        chances = np.exp(logits - logits.max()) / np.exp(logits - logits.max()).sum()
        assert b == chances.argmax() and s == pytest.approx(chances.max(), abs=1e-4)


def test_foreign_text_is_rejected_and_text_without_letters_undetermined(spark, learned):
    _, model = learned
    rows = [(1, "日本語のテキストです 今日は良い天気"), (2, "Привет как дела сегодня хорошо"), (3, "123 !! ²"), (4, None), (5, " \n "), (6, "the and of that for with"), (6, "the and of that for with")]
    found = [tuple(r) for r in language_id.languages(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()]
    assert [r[3] for r in found] == [True, True, True, True, True, False, False]
    assert [r[1:3] for r in found[2:5]] == [("und", 0.0)] * 3
    assert all(r[1] in model.languages for r in found[:2]) and found[5][1] == "en"


def test_learning_from_awkward_rows(spark, awkward, nothing):
    model = language_id.train(awkward)
    assert "en" in model.languages and set(model.languages) <= {"de", "en", "ja"}
    assert language_id.languages(awkward, model).count() == awkward.count()
    empty = language_id.train(nothing)
    assert empty.languages == [] and {r["lang_pred"] for r in language_id.languages(awkward, empty).collect()} == {"und"}
    assert language_id.languages(nothing, model).collect() == []


def test_gradient_step_lowers_the_loss():
    rng = np.random.default_rng(1)
    labels = rng.integers(0, 3, 300)
    rows = [np.concatenate([rng.integers(0, 50, 10), 100 + 10 * k + rng.integers(0, 10, 5)]) for k in labels]
    found, offsets = np.concatenate(rows), np.arange(0, 15 * 301, 15)
    model = language_id.Model(["a", "b", "c"], np.unique(found))
    model.fit(model.places(found), offsets, labels)
    assert (model.logits(model.means(model.places(found), offsets)).argmax(axis=1) == labels).mean() > 0.95
