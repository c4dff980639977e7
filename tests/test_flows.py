import pytest
from pyspark.sql import functions as F

from corpusmill.operators.gates import Limits
from corpusmill.plans import curation, web
from corpusmill.streaming import streams

TEXT = "Each patient in this clinical study received one treatment and then reported on health and pain. " * 4
BASE = "Fever Treatment in Mountain Villages: A Review of the Known Practice"


def raw(spark, rows):
    return spark.createDataFrame(rows, "seq bigint, title string, abstract string").withColumns(
        {"source": F.lit("s"), "url": F.lit("https://x.example")})


ROWS = [(i, f"{BASE} - Part {i}", TEXT) for i in range(1, 6)] + [
    (6, "short", TEXT), (7, "Another matter: coughs and colds", TEXT), (8, "Words that are few but long", "x" * 400),
    (9, "A letter to a@b.org and others", TEXT + " call 555-123-4567")]


@pytest.mark.parametrize("parts", [1, 4])
def test_status_of_every_row(spark, parts):
    got = {r.seq: r for r in curation.curate(raw(spark, ROWS).repartition(parts)).collect()}
    assert [got[i].status for i in range(1, 10)] == [
        "kept", "duplicate", "duplicate", "duplicate", "duplicate", "too_short", "kept", "invalid", "kept"]
    assert [got[i].dup_of for i in range(1, 6)] == [None, 1, 1, 1, 1]
    assert got[8].reject_reasons == ["abstract_words", "low_quality", "low_relevance"]
    assert got[9].title == "A letter to and others" and not got[9].pii_free and got[1].pii_free
    assert "[PHONE_REDACTED]" in got[9].abstract


def test_short_rows_do_not_count_as_seen(spark):
    rows = [(1, BASE, "too short"), (2, BASE, TEXT)]
    got = {r.seq: r.status for r in curation.curate(raw(spark, rows)).collect()}
    assert got == {1: "too_short", 2: "kept"}


def test_exact_mode_and_no_redaction(spark):
    rows = ROWS[:3] + [(20, ROWS[0][1], TEXT)]
    got = {r.seq: r.status for r in curation.curate(raw(spark, rows), dedup="exact", anonymize=False).collect()}
    assert got == {1: "kept", 2: "kept", 3: "kept", 20: "duplicate"}
    with pytest.raises(ValueError):
        curation.curate(raw(spark, rows), dedup="other")


def test_web_flow(spark, folder):
    lists = spark.createDataFrame([("l1", "u1"), ("l1", "u1"), ("l2", "u1"), ("l2", "missing")], "list_name string, url string")
    pages = spark.createDataFrame([("u1", "<title>T</title>"), ("u2", "<title>no</title>")], "url string, html string")
    records = web.page_records_for_lists(lists, pages)
    assert {(r.list_name, r.url, r.title) for r in records.collect()} == {("l1", "u1", "T"), ("l2", "u1", "T")}


def run(query):
    query.trigger(availableNow=True).start().awaitTermination()


def test_stream_equals_batch(spark, folder):
    raw(spark, ROWS).write.json(folder("in"))
    stream = streams.raw_stream(spark, folder("in"), "seq bigint, title string, abstract string, source string, url string", 2)
    out = streams.curated_stream(stream, Limits(min_quality=0.5))
    run(out.select("seq", "status").writeStream.format("parquet").option("path", folder("out")).option("checkpointLocation", folder("c")))
    batch = curation.validate(curation.clean(raw(spark, ROWS)), Limits(min_quality=0.5))
    expected = {r.seq: "too_short" if len(r.title) < 10 else "kept" if r.is_valid else "invalid" for r in batch.collect()}
    assert {r.seq: r.status for r in spark.read.parquet(folder("out")).collect()} == expected


def test_keep_first_across_batches(spark, folder):
    files = [[(1, "Alpha beta gamma delta epsilon zeta", "x"), (2, "Something else entirely", "y")],
             [(3, "alpha beta gamma delta epsilon zeta", "z"), (4, "", "q"), (5, "New matter here", "w")],
             [(6, "Alpha beta gamma delta epsilon zetas", "v"), (7, "", "q"), (8, "New matter there, quite new", "u")]]
    run_batch = streams.keep_first_batches(folder("kept"))
    schema = "seq bigint, title string, abstract string"
    for i, rows in enumerate(files):
        run_batch(spark.createDataFrame(rows, schema), i)
    expected = {1, 2, 4, 5, 8}
    assert {r.seq for r in spark.read.parquet(folder("kept")).collect()} == expected
    run_batch(spark.createDataFrame(files[1], schema), 1)  # a replayed batch changes nothing
    assert {r.seq for r in spark.read.parquet(folder("kept")).collect()} == expected


def test_stream_upsert_replay(spark, folder):
    schema = "seq bigint, hash_sha256 string, pmid string, title string"
    upsert = streams.upsert_batches(folder("t"))
    first, second = [(1, "h", "p", "a")], [(2, "h", "q", "b"), (3, "g", "r", "c")]
    upsert(spark.createDataFrame(first, schema), 0)
    upsert(spark.createDataFrame(second, schema), 1)
    upsert(spark.createDataFrame(second, schema), 1)
    from corpusmill.sinks.writers import read_snapshot

    assert {tuple(r) for r in read_snapshot(spark, folder("t")).select("hash_sha256", "pmid", "title").collect()} == {("h", "p", "b"), ("g", "r", "c")}


def test_first_arrivals(spark, folder):
    rows = [(1, "t", "a", "2024-01-01 00:00:00"), (2, "t", "a", "2024-01-01 01:00:00"), (3, "t", "b", "2024-01-01 02:00:00")]
    df = spark.createDataFrame(rows, "seq bigint, title string, abstract string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(folder("in"))
    stream = spark.readStream.schema(df.schema).parquet(folder("in"))
    run(streams.first_arrivals(stream, "ts").writeStream.format("parquet").option("path", folder("o")).option("checkpointLocation", folder("c")))
    assert spark.read.parquet(folder("o")).count() == 2


def test_daily_counts_in_update_mode(spark, folder):
    """The table equals a plain count, the state holds the open days only, and a replayed batch changes nothing."""
    from corpusmill.sinks.writers import read_snapshot

    for day in range(6):
        rows = [(f"2024-01-0{day + 1} 12:00:00",)] * (day + 2) + ([(f"2024-01-0{day} 23:30:00",)] if day else [])
        df = spark.createDataFrame(rows, "ts string").select(F.col("ts").cast("timestamp").alias("ts"))
        df.coalesce(1).write.mode("append").parquet(folder("in"))
    stream = spark.readStream.schema("ts timestamp").option("maxFilesPerTrigger", 1).parquet(folder("in"))
    counts, sink, seen = streams.daily_counts(stream, limit=5, delay="18 hours"), streams.count_batches(folder("t")), []

    def run_batch(batch, batch_id):
        rows = spark.createDataFrame(batch.collect(), batch.schema)  # one pass, since each adds to the figures of the state
        for _ in range(2 if batch_id == 2 else 1):
            sink(rows, batch_id)
        seen.append(batch_id)

    query = counts.writeStream.outputMode("update").foreachBatch(run_batch).option("checkpointLocation", folder("c")).trigger(availableNow=True).start()
    query.awaitTermination()
    state = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert len(seen) >= 6 and max(state) <= 3
    table = read_snapshot(spark, folder("t"))
    got = {str(r.window_start)[:10]: (r.used, r.remaining) for r in table.collect()}
    used = {f"2024-01-0{d + 1}": d + 2 + (d < 5) for d in range(6)}
    assert got == {d: (n, max(0, 5 - n)) for d, n in used.items()}
    assert {str(r.window_start)[:10]: r.first_batch for r in table.collect()} == {f"2024-01-0{d + 1}": d for d in range(6)}


def test_counters_come_with_the_write(spark, folder):
    from corpusmill.operators import reports

    statuses = ["kept"] * 5 + ["invalid"] * 3 + ["duplicate", "too_short", None]
    records = spark.createDataFrame([(s,) for s in statuses], "status string")
    observed, counters = reports.observed_counters(records)
    observed.write.parquet(folder("o"))
    assert counters.get == reports.run_counters(records).first().asDict() == {
        "processed": 11, "cleaned": 8, "validated": 5, "enriched": 5, "duplicates": 1, "failures": 4}
