import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import entities as E, keywords as K, qa as Q, vectors as V
from corpusmill.operators.frontier import first_n_per_group


def test_keywords_count_and_tie_order(spark, one):
    text = "The zebra saw an apple, apple zebra café naïve x2y under_score été? Zebra kiwi42 öl"
    expected = [w for w, _ in Counter(
        w for w in re.findall(rf"\b[{K.LETTERS}]{{3,}}\b", text.lower()) if w not in K.STOP_WORDS).most_common(4)]
    assert one(text, lambda c: K.keywords(c, 4)) == expected == ["zebra", "apple", "saw", "café"]
    assert one("", K.keywords) == [] and one(None, K.keywords) == []
    assert len(K.STOP_WORDS) == len(set(K.STOP_WORDS)) == 55


LEXICON = [("fever", "DISEASE"), ("high fever", "SYMPTOM"), ("aspirin", "CHEMICAL"), ("rest", "TREATMENT"), ("Paris", "GPE")]


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame(LEXICON, "phrase string, label string")


def test_entities(spark, lexicon):
    docs = spark.createDataFrame(
        [(1, "High  fever? FEVER, take Aspirin; fever and rest. In Paris: aspirin"), (2, "nothing"), (3, None)],
        "seq bigint, abstract string")
    got = {r.seq: r.entities for r in E.tag_entities(docs, lexicon, "seq").collect()}
    found = {k: [(e.text, e.label, e.start, e.end) for e in v] for k, v in got[1].items()}
    assert found == {
        "SYMPTOM": [("High  fever", "SYMPTOM", 0, 11)],
        "DISEASE": [("fever", "DISEASE", 6, 11)],
        "DRUG": [("Aspirin", "CHEMICAL", 25, 32)],
        "TREATMENT": [("rest", "TREATMENT", 44, 48)],
    }
    assert got[2] == {} and got[3] == {}


def test_entities_of_letters_with_special_cases(spark):
    lexicon = spark.createDataFrame([("İstanbul", "SYMPTOM"), ("ΟΔΟΣ Straße", "DISEASE"), ("", "DISEASE"), (None, "DISEASE")], "phrase string, label string")
    docs = spark.createDataFrame([(1, "İstanbul, İSTANBUL and Οδός; οδοσ ΟΔΟΣ straße")], "seq bigint, abstract string")
    found = E.tag_entities(docs, lexicon, "seq").first().entities
    assert [(e.text, e.start) for e in found["SYMPTOM"]] == [("İstanbul", 0)]
    assert [e.text for e in found["DISEASE"]] == ["ΟΔΟΣ straße"]


def test_entities_against_a_plain_search(spark):
    """Random texts, some longer than several blocks of runs, against a loop over all word runs."""
    rng = random.Random(4)
    phrases = {"a": "DISEASE", "b c": "SYMPTOM", "a b c": "CHEMICAL", "d": "GPE", "c c": "TREATMENT", "é_1": "ANATOMY"}
    texts = ["".join(rng.choice(["a", "A", "b", "c", "C", "d", "é_1", "x", "😀", "İ"]) + rng.choice([" ", "  ", ", ", "-\n"]) for _ in range(n))
             for n in [0, 1, 2, 3, 5, 9, 16, 32, 130, 700] * 3 + [9000]] + ["...", " a", "a", "😀 b C", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "seq bigint, abstract string")
    got = {r.seq: r.entities for r in E.tag_entities(docs, spark.createDataFrame(list(phrases.items()), "phrase string, label string"), "seq").collect()}
    kinds = {"DISEASE": "DISEASE", "SYMPTOM": "SYMPTOM", "CHEMICAL": "DRUG", "TREATMENT": "TREATMENT", "ANATOMY": "ANATOMY"}
    for seq, text in enumerate(texts):
        words, first = list(re.finditer(r"\w+", text or "")), {}
        for i in range(len(words)):
            for j in range(i, min(i + 3, len(words))):
                label = phrases.get(" ".join(w.group().lower() for w in words[i : j + 1]))
                if label in kinds:
                    start, end = words[i].start(), words[j].end()
                    first.setdefault((kinds[label], text[start:end].lower()), (text[start:end], label, start, end))
        expected = {}
        for (kind, _), e in first.items():
            expected.setdefault(kind, []).append(e)
        assert {k: [tuple(e) for e in v] for k, v in got[seq].items()} == {k: sorted(v, key=lambda e: e[2:]) for k, v in expected.items()}


def test_spans_that_leave_the_row_are_mentions(spark, lexicon):
    """Words outside the lexicon do not become rows; the filter grows with the lexicon and an empty lexicon finds nothing."""
    docs = spark.range(200).select(F.col("id").alias("seq"), F.concat(F.lit("fever "), F.array_join(F.transform(
        F.sequence(F.lit(0), F.lit(99)), lambda i: F.concat(F.lit("w"), (F.col("id") * 100 + i).cast("string"))), " ")).alias("abstract"))
    keyed = lambda df: df.select(E.phrase_key("phrase").alias("phrase"))
    many = spark.range(50_000).select(F.concat(F.lit("phrase "), F.col("id").cast("string")).alias("phrase"))
    for words in (keyed(lexicon), keyed(lexicon.select("phrase").unionByName(many))):
        spans = E.candidate_spans(docs, words, "seq", "abstract", 3)
        assert spans.where("phrase = 'fever'").count() == 200 and spans.count() < 200 + 0.03 * 200 * 300
    assert E.candidate_spans(docs, keyed(lexicon).where("false"), "seq", "abstract", 3).count() == 0


def test_label_mapping(spark):
    df = spark.createDataFrame([("ORG",), ("CHEMICAL",), ("XYZ",)], "label string").select(E.entity_type("label").alias("t"))
    assert [r.t for r in df.collect()] == ["ORGANIZATION", "DRUG", "OTHER"]


def test_qa_templates(spark, lexicon):
    doc = spark.createDataFrame([(1, "Title " * 30, "fever, high fever, rest and aspirin " * 40)], "seq bigint, title string, abstract string")
    tagged = E.tag_entities(doc, lexicon, "seq")
    rows = Q.qa_rows(tagged.withColumn("qa_pairs", Q.qa_pairs()), "seq").orderBy("position").collect()
    assert [r.type for r in rows] == ["definition", "symptoms", "treatment", "drugs", "summary"]
    abstract, title = doc.first().abstract, doc.first().title
    assert rows[0].question == "Qu'est-ce que fever ?" and rows[0].answer == f"{title}. {abstract[:500]}"
    assert rows[1].answer == f"Les symptômes incluent : high fever. {abstract[:300]}"
    assert rows[4].question.endswith(title[:100]) and rows[4].answer == abstract[:800]
    three = tagged.select(Q.qa_pairs(max_pairs=2).alias("p")).first().p
    assert [p.type for p in three] == ["definition", "symptoms"]
    none = doc.withColumn("entities", F.create_map().cast("map<string,array<struct<text:string>>>")).select(Q.qa_pairs().alias("p")).first().p
    assert [p.type for p in none] == ["summary"]


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([0.0, 0.0], [1.0, 1.0], 0.0), ([3.0, 4.0], [4.0, 3.0], 0.96)]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>, e double")
    for r in df.select(V.cosine_similarity("a", "b").alias("v"), "e").collect():
        assert r.v == pytest.approx(r.e)


def test_embedding_cache(spark):
    requests = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "bb"), (4, "ccc")], "id bigint, text string")
    cache = requests.where("id = 1").select(V.text_key("text").alias("text_sha256"), F.array(F.lit(9.0).cast("float")).alias("embedding"))
    assert V.cache_misses(requests, cache).count() == 2
    calls = spark.sparkContext.accumulator(0)

    import pandas as pd

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        calls.add(len(texts))
        return texts.map(lambda t: [float(len(t))])

    out, added = V.embed_with_cache(requests, cache, embed)
    assert {r.id: r.embedding for r in out.collect()} == {1: [9.0], 2: [2.0], 3: [2.0], 4: [3.0]}
    assert added.count() == 2 and calls.value == 2


def test_misses_are_settled_without_texts(spark):
    """Nothing but hashes and ids is shuffled before the misses are known, and a null text is one like any other."""
    rows = [(i, None if i % 5 == 0 else f"text {i % 7}") for i in range(200)]
    requests = spark.createDataFrame(rows, "id bigint, text string")
    cache = requests.where("text = 'text 3'").select(V.text_key("text").alias("text_sha256"), F.array(F.lit(1.0)).alias("embedding")).distinct()
    plan = V.missing_hashes(requests, cache)._jdf.queryExecution().optimizedPlan()
    assert plan.output().size() == 2 and "first(text" not in plan.toString()
    found = {r.text_sha256: r.text for r in V.cache_misses(requests, cache).collect()}
    import hashlib

    assert found == {hashlib.sha256((t or "").encode()).hexdigest(): t for t in [None, *(f"text {k}" for k in (0, 1, 2, 4, 5, 6))]}
    assert V.cache_misses(requests.where("false"), cache).count() == 0


def test_first_n(spark):
    df = spark.createDataFrame([("a", i) for i in range(9)] + [("b", 1)], "g string, i int")
    assert [(r.g, r.i, r["rank"]) for r in first_n_per_group(df, "g", ["i"], 2).orderBy("g", "i").collect()] == [
        ("a", 0, 1), ("a", 1, 2), ("b", 1, 1)]


def test_nearest_vectors_in_blocks_and_slices(spark):
    rng = random.Random(6)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(4)]) for i in range(90)] + [(90, [0.0] * 4), (91, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")

    def cosine(a, b):
        norms = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return round(sum(x * y for x, y in zip(a, b)) / norms, 6) if norms else 0.0

    known = dict(rows[:-1])
    expected = set()
    for q in range(0, 91, 7):
        order = sorted((-cosine(known[q], v), i) for i, v in known.items() if i != q)
        expected |= {(q, n + 1, i, -s + 0.0) for n, (s, i) in enumerate(order[:6])}
    for sizes in ({}, {"block": 4, "slice_rows": 9}):
        found = V.nearest(df, df.where("vec_id % 7 = 0"), 6, **sizes).collect()
        assert {(r.query_id, r["rank"], r.neighbour_id, r.similarity + 0.0) for r in found} == expected
    assert V.nearest(df.where("false"), df, 3).count() == 0


def test_equal_mentions_are_reduced_by_hash_before_they_are_sorted(spark):
    docs = spark.createDataFrame([(1, "The cat. " * 400 + "the  dog and the dog"), (2, "the DOG the dog"), (None, "cat"), (None, "a cat")], "seq long, abstract string")
    words = spark.createDataFrame([("the",), ("cat",), ("the dog",)], "phrase string")
    spans = E.candidate_spans(docs, words, "seq", "abstract", 2)
    firsts = E.first_spans(spans, "seq")
    assert "SortAggregate" not in firsts._jdf.queryExecution().executedPlan().toString()
    found = {tuple(r) for r in firsts.select("seq", "phrase", "text", "start", "end").collect()}
    every = spans.groupBy("seq", "phrase", "lower", "text").agg(F.min(F.struct("start", "end")).alias("e"))
    assert found == {tuple(r) for r in every.select("seq", "phrase", "text", "e.start", "e.end").collect()}
    assert (1, "the", "The", 0, 3) in found and (None, "cat", "cat", 0, 3) in found and len(found) < 15


def test_scores_of_a_block_are_held_in_parts():
    rng = np.random.default_rng(1)
    vectors = lambda n: pd.DataFrame({"id": range(n), "v": list(rng.integers(-3, 4, (n, 4)).astype(float))})
    queries, rows = vectors(1024), vectors(20_000)
    tracemalloc.start()
    found = V.best_of(3, 6)(queries, rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # All scores at once take 164 MB, and as much again while they are rounded.
    assert peak < 60e6
    few = V.best_of(3, 6, held=1)(queries.head(40), rows.head(500))
    assert few.equals(V.best_of(3, 6)(queries.head(40), rows.head(500))) and len(found) == 3 * 1024
