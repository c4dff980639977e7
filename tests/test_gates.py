import pytest
from pyspark.sql import functions as F

from corpusmill.operators import gates
from corpusmill.plans import curation

ABSTRACT = "Each patient in this clinical study received one treatment and then reported on health and pain. " * 4
GOOD = dict(title="A title that is long enough", abstract=ABSTRACT, source="s", url="https://x.example/1")


def reasons(spark, limits=gates.Limits(), **changes):
    row = {**GOOD, **changes}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))
    return curation.validate(curation.with_defaults(df), limits).first()


def test_each_rule(spark):
    loose = gates.Limits(min_quality=0, min_relevance=0)
    assert reasons(spark, loose).reject_reasons == []
    assert reasons(spark, loose, title="short").reject_reasons == ["title_length"]
    assert reasons(spark, loose, title="x" * 251).reject_reasons == ["title_length"]
    assert reasons(spark, loose, abstract="A" * 250).reject_reasons == ["abstract_words"]
    assert reasons(spark, loose, abstract="word " * 700).reject_reasons == ["abstract_length"]
    assert reasons(spark, loose, source="").reject_reasons == ["source_missing"]
    assert reasons(spark, loose, url="ftp://x").reject_reasons == ["url_format"]
    assert reasons(spark, loose, title="A <b>title</b> here").reject_reasons == ["title_markup"]
    assert reasons(spark, loose, abstract="éé " * 100).reject_reasons == ["abstract_ascii"]
    assert reasons(spark, loose, abstract="ok " * 99 + "<i>").reject_reasons == ["abstract_markup"]


def test_scores_and_thresholds(spark):
    row = reasons(spark)
    # 388 characters: band 1.0; patient, treatment, clinical, health: 4 of 5 hits.
    assert row.quality_score == pytest.approx(0.9) and row.completeness_score == pytest.approx(0.4)
    assert row.relevance_score == pytest.approx(0.65) and row.is_valid
    assert reasons(spark, gates.Limits(min_quality=0.95, min_relevance=0.7)).reject_reasons == ["low_quality", "low_relevance"]


def test_limits_are_checked():
    for bad in (dict(min_quality=1.1), dict(min_title=20, max_title=10), dict(min_ascii_ratio=-1)):
        with pytest.raises(ValueError):
            gates.Limits(**bad)


def test_allowlist(spark, one):
    assert one("clinicaltrials.gov", gates.on_allowlist) and one("https://www.cdc.gov/x", gates.on_allowlist)
    assert not one("unknown.example", gates.on_allowlist)
    bad = spark.createDataFrame([("unknown.example",)], "d string")
    with pytest.raises(Exception, match="domain not approved"):
        gates.require_allowlist(bad, "d").collect()


def test_crawl_rules(spark):
    rules = spark.createDataFrame(
        [("http://a.example", "*", 0, True, "/x/ok"), ("http://a.example", "*", 1, False, "/x"),
         ("http://b.example", "*", 0, False, "/"), ("http://b.example", "Bot", 0, False, "/only?q")],
        "site string, agent string, ord int, allow boolean, prefix string")
    urls = ["http://a.example/x/ok/1", "http://a.example/x/2", "http://a.example/y", "http://b.example/z",
            "http://b.example/only?q=1", "https://a.example/x/2", "http://c.example"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r.url: r.allowed for r in gates.crawl_allowed(df, rules, "bot").collect()}
    assert [got[u] for u in urls] == [True, False, True, True, False, True, True]
    general = {r.url: r.allowed for r in gates.crawl_allowed(df, rules, "other").collect()}
    assert general["http://b.example/z"] is False


def test_fetch_outcome(spark):
    rows = [(200, "text/html; charset=utf-8", 500), (403, "text/html", 500), (200, "text/html", 99), (404, "text/html", 500),
            (200, "application/pdf", 500), (None, None, 500)]
    df = spark.createDataFrame(rows, "s int, t string, n int").select(gates.fetch_outcome("s", "t", "n").alias("o"))
    assert [r.o for r in df.collect()] == ["ok", "blocked", "blocked", "non_200", "non_html", "non_200"]


def test_quality_gate(spark):
    df = spark.createDataFrame([(0.7,), (0.69,), (None,)], "quality_score double")
    assert [r.kept for r in gates.quality_gate(df).collect()] == [True, False, False]


def test_crawl_rules_match_product_tokens_and_escapes(spark):
    rules = spark.createDataFrame(
        [("http://a.example", "*", 0, False, "/"), ("http://a.example", "medbot", 1, False, "/%7Eprivate/"), ("http://a.example", "bot", 2, False, "/all"),
         ("http://b.example", "medbot", 0, False, "")], "site string, agent string, ord int, allow boolean, prefix string")
    urls = ["http://a.example/~private/1", "http://a.example/%7eprivate/1", "http://a.example/all", "http://a.example/100%", "http://b.example/x"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r.url: r.allowed for r in gates.crawl_allowed(df, rules, "MedBot/1.0 (x/2)").collect()}
    assert [got[u] for u in urls] == [False, False, True, True, True]
    assert not any(r.allowed for r in gates.crawl_allowed(df.where("url like '%a.ex%'"), rules, "Crawler/medbot").collect())
