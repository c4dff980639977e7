import pytest
from pyspark.sql import functions as F

from corpusmill.operators import frontier, replies as R, reports
from corpusmill.plans import topics


def test_validation_reply(one):
    good = one('Sure {"is_medical": true, "quality_score": 0.8, "recommendation": "keep"} bye', R.parse_validation)
    assert (good.is_medical, good.quality_score, good.recommendation) == (True, 0.8, "keep")
    for broken in ('{"quality_score": ', "no json", "", None, '{"a": 1}}', '{"a": 1} and {"b": 2}'):
        r = one(broken, R.parse_validation)
        assert (r.is_medical, r.quality_score, r.recommendation) == (False, 0.0, "reject"), broken
    assert one('{"is_medical": true}', R.parse_validation).quality_score is None


def test_qa_replies(one):
    pairs = one('x [{"question": "q", "answer": "a", "type": "definition"}] y', R.parse_qa)
    assert pairs[0].question == "q"
    assert one('[{"question": "q"}], "en": [1]', R.parse_qa) == [] and one("nothing", R.parse_qa) == []
    by_language = '{"fr": [{"question": "q"}], "en": [{"question": "a"}, {"question": "b"}]}'
    assert one(by_language, lambda c: R.qa_total(R.parse_multilingual_qa(c))) == 3
    assert one("{oops", lambda c: R.qa_total(R.parse_multilingual_qa(c))) == 0
    assert one("{}", R.parse_content).title is None and one("none", R.parse_content) is None


def test_lines(spark):
    df = spark.createDataFrame([(1, " a \n#c\n\nb\nhttp://x \r\n d")], "id int, reply string")
    assert [r.line for r in R.reply_lines(df, "id", "reply", 3).collect()] == ["a", "b", "http://x"]
    assert [r.line for r in R.reply_lines(df, "id", "reply", 3, urls_only=True).collect()] == ["http://x"]


def test_prompt_table(spark):
    df = spark.createDataFrame([(1, "x" * 6000, "https://u.example")], "id int, content string, url string")
    row = R.prompt_table(df, "validate", "id", url="url").first()
    assert row.user.endswith("\n" + "x" * 5000 + "...") and (row.temperature, row.max_tokens) == (0.3, 1000)
    assert "français, English, xx" in R.prompt_table(df, "multilingual_qa", "id", languages=("fr", "en", "xx")).first().user
    with pytest.raises(ValueError):
        R.prompt_table(df, "other", "id")


def test_topic_flow(spark):
    good, poor = '{"quality_score": 0.9}', '{"quality_score": 0.1}'
    pages = spark.createDataFrame(
        [("t1", "u1", good, '{"fr": [{"question": "q"}]}'), ("t1", "u2", poor, ""), ("t2", "u3", "??", "")],
        "topic string, url string, validation_reply string, qa_reply string")
    judged = topics.judged_pages(pages)
    names = spark.createDataFrame([("t1",), ("t2",), ("t3",)], "topic string")
    results, totals = topics.topic_report(names, judged)
    got = {r.topic: (r.urls_scraped, r.pages_kept, r.pages_rejected, r.avg_quality) for r in results.collect()}
    assert got == {"t1": (2, 1, 1, 0.5), "t2": (1, 0, 1, 0.0), "t3": (0, 0, 0, 0.0)}
    total = totals.first()
    assert (total.total_topics, total.topics_completed, total.pages_kept, total.avg_quality) == (3, 3, 1, 0.5)
    assert [r.qa_count for r in judged.orderBy("url").collect()] == [1, 0, 0]
    failing = judged.withColumn("error", F.when(F.col("url") == "u1", "boom"))
    row = {r.topic: r for r in reports.topic_results(names, failing).collect()}["t1"]
    assert (row.pages_kept, row.pages_rejected, row.n_errors) == (0, 2, 1)
    assert reports.topic_errors(failing).count() == 1


def test_totals_of_nothing(spark):
    empty = spark.createDataFrame([], "topic string, urls_scraped bigint, pages_kept bigint, pages_rejected bigint, avg_quality double")
    assert reports.run_totals(empty).first().avg_quality == 0.0
    assert reports.validation_summary(spark.createDataFrame([], "is_valid boolean")).first().rate == 0.0


def test_fetch_statistics(spark):
    log = spark.createDataFrame(
        [("http://a.example/1", "ok"), ("http://a.example/2", "blocked"), ("http://b.example/", "non_200")], "url string, outcome string")
    got = {r.domain: (r.requests, r.successes, r.failures) for r in reports.fetch_statistics(log, url="url").collect()}
    assert got == {"a.example": (2, 1, 1), "b.example": (1, 1, 0), None: (3, 2, 1)}


def test_daily_quota(spark):
    rows = [(i, f"2024-01-0{1 + (i % 10 == 0)} 00:00:{i % 60:02d}") for i in range(100)]
    log = spark.createDataFrame(rows, "event_id bigint, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = frontier.daily_admission(log, limit=15, salts=4).collect()
    for day in {r.day for r in got}:
        mine = sorted((r.ts, r.event_id, r.admitted) for r in got if r.day == day)
        assert [m[2] for m in mine] == [i < 15 for i in range(len(mine))]
    left = {str(r.day): (r.used, r.remaining) for r in frontier.daily_remaining(log, limit=50).collect()}
    assert left == {"2024-01-01": (90, 0), "2024-01-02": (10, 40)}


def test_quota_contested_within_one_second(spark):
    rows = [(i, "2024-01-01 10:00:00") for i in range(200)] + [(500 + i, "2024-01-01 09:59:59") for i in range(5)]
    log = spark.createDataFrame(rows, "event_id bigint, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.event_id for r in frontier.daily_admission(log, limit=25, salts=8).where("admitted").collect()}
    assert got == {500, 501, 502, 503, 504, *range(20)}


def test_visits(spark):
    log = spark.createDataFrame([("u", 1, False), ("u", 2, True), ("u", 3, True), ("v", 4, False)], "url string, seq bigint, ok boolean")
    assert [(r.url, r.seq) for r in frontier.first_visits(log, ok="ok").collect()] == [("u", 2)]
    assert {(r.url, r.seq) for r in frontier.first_visits(log).collect()} == {("u", 1), ("v", 4)}
    assert [r.url for r in frontier.unvisited(log.select("url").distinct(), log).collect()] == ["v"]
