from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusmill import schemas
from corpusmill.plans import curation
from corpusmill.sinks import writers as W
from corpusmill.sources import readers as R

XML = """<?xml version="1.0"?>
<PubmedArticleSet>
 <PubmedArticle><MedlineCitation><PMID Version="1">11</PMID><Article>
   <ArticleTitle>On H<sub>2</sub>O &amp; <i>life</i></ArticleTitle>
   <Abstract><AbstractText Label="A">First.</AbstractText><AbstractText>Second <b>part</b>.</AbstractText></Abstract>
   <AuthorList><Author><LastName>Ray</LastName><ForeName>Zoe</ForeName></Author><Author><LastName>Solo</LastName></Author></AuthorList>
   <Journal><JournalIssue><PubDate><Year>2023</Year></PubDate></JournalIssue></Journal></Article>
   <KeywordList><Keyword>k1</Keyword><Keyword>k2</Keyword></KeywordList></MedlineCitation></PubmedArticle>
 <PubmedArticle><MedlineCitation><PMID>12</PMID><Article><ArticleTitle>No abstract</ArticleTitle></Article></MedlineCitation></PubmedArticle>
 <PubmedArticle><MedlineCitation><PMID>13</PMID><Article><ArticleTitle>Third</ArticleTitle>
   <Abstract><AbstractText>Only one.</AbstractText></Abstract></Article>
   <PubDate><Year>2024</Year><Month>Jan</Month></PubDate></MedlineCitation></PubmedArticle>
</PubmedArticleSet>"""


def test_article_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    rows = {r.pmid: r for r in R.read_article_xml(spark, str(tmp_path / "a.xml")).collect()}
    assert set(rows) == {"11", "13"}
    a = rows["11"]
    assert (a.title, a.abstract, a.authors, a.date, a.keywords) == ("On H2O & life", "First. Second part.", ["Zoe Ray"], "2023", ["k1", "k2"])
    assert (rows["13"].date, rows["13"].authors, rows["13"].keywords, rows["13"].source) == ("2024-Jan", [], [], "pubmed")
    assert a.url.endswith("/11/")


def test_url_lists(spark, tmp_path):
    (tmp_path / "one.list.txt").write_text("# note\n\n  https://a.example/1  \nhttps://a.example/2\n")
    (tmp_path / "two.txt").write_text("https://b.example/\n#https://no.example\n")
    (tmp_path / "requirements.txt").write_text("spark\n")
    (tmp_path / "other.md").write_text("https://no.example\n")
    lists = R.read_url_lists(spark, str(tmp_path))
    assert {(r.list_name, r.url) for r in lists.collect()} == {
        ("one.list", "https://a.example/1"), ("one.list", "https://a.example/2"), ("two", "https://b.example/")}
    assert {(r.list_name, r.urls) for r in R.list_totals(lists).collect()} == {("one.list", 2), ("two", 1)}


def test_jsonl_modes(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"pmid": "1", "authors": ["A"]}\n\n{"pmid": \n')
    loose = R.read_jsonl(spark, str(tmp_path / "x.jsonl")).cache()
    assert loose.count() == 2 and loose.where("_corrupt_record is not null").count() == 1
    with pytest.raises(Exception):
        R.read_jsonl(spark, str(tmp_path / "x.jsonl"), strict=True).collect()


@pytest.fixture(scope="module")
def entries(spark):
    text = "Each patient in this clinical study received one treatment and then reported on health and pain. " * 4
    raw = spark.createDataFrame(
        [(1, "10", "A first title about fever", text, "s1"), (2, "11", "Another title about coughs", text, "s2")],
        "seq bigint, pmid string, title string, abstract string, source string",
    ).withColumn("url", F.lit("https://x.example")).withColumn("keywords", F.array(F.lit("é"), F.lit('q"')))
    lexicon = spark.createDataFrame([("pain", "SYMPTOM")], "phrase string, label string")
    return curation.entries(raw, lexicon, F.lit("2024-01-01").cast("timestamp"))


def test_entries_have_the_declared_schema(entries):
    from pyspark.sql.types import StructType

    declared = StructType.fromDDL(schemas.ENTRY)
    assert entries.columns == ["seq", *declared.fieldNames()]
    for field in declared.fields:
        assert entries.schema[field.name].dataType.simpleString() == field.dataType.simpleString(), field.name
    assert entries.count() == 2


def test_export_round_trip(spark, entries, folder):
    paths = W.export_all(entries, folder("out"), "run", flatten_json=True)
    assert set(paths) == {"jsonl", "parquet", "table"} and len(set(paths.values())) == 3
    lines = R.read_jsonl(spark, paths["jsonl"], schemas.ENTRY, strict=True)
    plain = entries.drop("seq")
    assert sorted(map(str, lines.collect())) == sorted(map(str, plain.collect()))
    flat = spark.read.parquet(paths["parquet"]).first()
    assert flat.keywords == '["é","q\\""]' and flat.entities.startswith('{"SYMPTOM":[{"text":"pain"')
    only = W.export_all(entries, folder("some"), "run", jsonl=False, table=False)
    assert set(only) == {"parquet"}
    assert spark.read.parquet(only["parquet"]).schema["authors"].dataType.simpleString() == "array<string>"


def test_upsert(spark, folder):
    schema = "seq bigint, hash_sha256 string, pmid string, title string"
    root = folder("table")
    W.upsert_snapshot(root, spark.createDataFrame([(1, "h1", "p1", "a"), (2, "h1", "p2", "b"), (3, "h2", "p3", "c")], schema))
    first = {(r.hash_sha256, r.pmid, r.title) for r in W.read_snapshot(spark, root).collect()}
    assert first == {("h1", "p1", "b"), ("h2", "p3", "c")}
    W.upsert_snapshot(root, spark.createDataFrame([(1, "h2", "new", "d"), (2, "h3", None, "e")], schema))
    second = {(r.hash_sha256, r.pmid, r.title) for r in W.read_snapshot(spark, root).collect()}
    assert second == {("h1", "p1", "b"), ("h2", "p3", "d"), ("h3", None, "e")}
    assert W.read_manifest(spark, root)[0] == 1 and W.read_manifest(spark, root, below=1)[0] == 0
    assert {r.hash_sha256 for r in W.read_snapshot(spark, root, 0).collect()} == {"h1", "h2"}


def bucket_files(root):
    return {p.name: p.parent.name for p in Path(root).glob("data/*/*/*.parquet")}


def test_upsert_leaves_other_buckets_alone(spark, folder):
    root = folder("table")
    rows = spark.range(200).select(F.col("id").alias("seq"), F.concat(F.lit("h"), "id").alias("hash_sha256"), F.lit("p").alias("pmid"), F.lit("old").alias("title"))
    W.upsert_snapshot(root, rows, buckets=8)
    before = bucket_files(root)
    one = rows.where("seq = 17").withColumn("title", F.lit("new"))
    W.upsert_snapshot(root, one)
    hit = one.select(W.bucket_of("hash_sha256", 8)).first()[0]
    found = W.read_snapshot(spark, root)
    used = {p.rsplit("/", 1)[1] for p in found.inputFiles()}
    assert {f for f, b in before.items() if b != f"_bucket={hit}"} <= used
    assert not {f for f, b in before.items() if b == f"_bucket={hit}"} & used
    assert found.count() == 200 and {r.hash_sha256 for r in found.where("title = 'new'").collect()} == {"h17"}


def test_an_upsert_stopped_before_its_manifest_is_replayed(spark, folder, monkeypatch):
    schema = "seq bigint, hash_sha256 string, pmid string, title string"
    first = spark.createDataFrame([(i, f"h{i}", f"p{i}", "a") for i in range(20)], schema)
    second = spark.createDataFrame([(i, f"h{i + 10}", f"q{i}", "b") for i in range(20)], schema)
    whole, broken = folder("whole"), folder("broken")
    for root in (whole, broken):
        W.upsert_snapshot(root, first, 0, buckets=4)
    W.upsert_snapshot(whole, second, 1)
    with monkeypatch.context() as m:
        part = second.limit(7)

        def killed(*_):
            raise RuntimeError("killed")

        m.setattr(type(spark), "createDataFrame", killed)  # the run ends after the data are written
        with pytest.raises(RuntimeError, match="killed"):
            W.upsert_snapshot(broken, part, 1)
    rows = lambda root: sorted(map(tuple, W.read_snapshot(spark, root).collect()))
    assert rows(broken) == sorted(tuple(r)[1:] for r in first.collect())
    W.upsert_snapshot(broken, second, 1)
    W.upsert_snapshot(broken, second, 1)
    assert rows(broken) == rows(whole) and len(rows(whole)) == 30


def test_a_table_without_rows(spark, folder):
    empty = spark.createDataFrame([], "seq bigint, hash_sha256 string, pmid string, title string")
    W.upsert_snapshot(folder("t"), empty)
    assert W.read_snapshot(spark, folder("t")).columns == ["hash_sha256", "pmid", "title"] and W.read_snapshot(spark, folder("t")).count() == 0
    W.upsert_snapshot(folder("t"), spark.createDataFrame([(1, None, "p", "t")], empty.schema))
    assert W.read_manifest(spark, folder("t"))[0] == 1


def test_folders_per_topic(spark, folder):
    df = spark.createDataFrame([("Type 2 Fever", 1), ("Cough", 2)], "topic string, n int")
    W.write_by_group(df, folder("t"), "topic")
    back = spark.read.json(folder("t"))
    assert {(r.topic_slug, r.n) for r in back.collect()} == {("type_2_fever", 1), ("cough", 2)}
