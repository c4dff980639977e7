"""Not-modified revisits of a web archive, resolved by an as-of join to the latest earlier full response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusmill.llm.common import stage

#: Headers that describe the stored body or one connection; a not-modified reply does not replace them.
KEPT_HEADERS = (
    "content-length", "content-encoding", "content-type", "content-range", "content-md5", "transfer-encoding", "connection", "keep-alive", "proxy-authenticate",
    "proxy-authorization", "proxy-connection", "te", "trailer", "upgrade",
)
#: Query parameters that name a campaign or session, not a resource.
TRACKING = "utm_[a-z]+|gclid|fbclid|msclkid|sessionid|phpsessid|jsessionid|sid"


def canonical_url(url: Column) -> Column:
    """Lower-case scheme-free host without www. and default port, path without a trailing slash, query without tracking parameters and in
    sorted order, no fragment. Null stays null."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_replace(bare, "^(?i)[a-z][a-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, "^[^@]*@", ""), "^www[.]|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(rest, "[?](.*)$", 1)
    parts = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(f"^({TRACKING})(=|$)")))
    return F.concat(host, path, F.when(F.size(parts) > 0, F.concat(F.lit("?"), F.array_join(parts, "&"))).otherwise(""))


def header_map(block: Column) -> Column:
    """Map of an HTTP header block: names in lower case, repeated names joined by a comma in order, lines without a colon passed over."""
    lines = F.filter(F.split(F.coalesce(block, F.lit("")), "\r?\n"), lambda x: x.rlike("^[^\\s:]+\\s*:"))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.array_join(F.transform(F.filter(pairs, lambda p: p["k"] == n), lambda p: p["v"]), ", ")))


def merged_headers(stored: Column, fresh: Column) -> Column:
    """Stored headers, renewed by those of the not-modified reply that may replace them."""
    permitted = F.map_filter(fresh, lambda k, v: ~k.isin(*KEPT_HEADERS))
    untouched = F.map_filter(stored, lambda k, v: ~F.map_contains_key(permitted, k))
    return F.map_concat(untouched, permitted)


def weak_tag(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def latest_before(events: DataFrame, key: str, order: list[str], value: str, pieces: int | None = None) -> DataFrame:
    """`events` with the column `value` of the latest earlier row of the same key that has one, as `earlier`.

    A parallel scan: rows are range-partitioned by key and order, so a hot key spreads over many pieces. Each (key, piece) is
    scanned by a window that one task can hold, and a key in several pieces carries its last value on; only the last
    value of every piece enters that second window, as many rows per key as there are pieces.
    """
    ranged = events.repartitionByRange(pieces, key, *order) if pieces else events.repartitionByRange(key, *order)
    rows = stage(ranged.withColumn("piece", F.spark_partition_id()), "events")
    before = Window.partitionBy(key, "piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("near", F.last(value, ignorenulls=True).over(before))
    ends = rows.where(F.col(value).isNotNull()).groupBy(key, "piece").agg(F.max(F.struct(*order, value))[value].alias("end"))
    spans = rows.groupBy(key).agg(F.min("piece").alias("first_piece"), F.max("piece").alias("last_piece")).where("first_piece < last_piece")
    # Pieces of a key without any value carry on what came before them.
    every = spans.select(key, F.explode(F.sequence("first_piece", "last_piece")).alias("piece")).join(ends, [key, "piece"], "left")
    carried = every.withColumn("far", F.last("end", ignorenulls=True).over(Window.partitionBy(key).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)))
    # A piece has at most one key that came over its lower border, so (piece) decides; the join stays one row per piece and key.
    carry = stage(carried.where("far is not null").select(F.col(key).alias("_k"), F.col("piece").alias("_p"), "far"), "carried")
    joined = local.join(carry, (F.col(key) == F.col("_k")) & (F.col("piece") == F.col("_p")), "left")
    return joined.withColumn("earlier", F.coalesce("near", "far")).drop("near", "far", "piece", "_k", "_p")


def resolve_revisits(records: DataFrame, pieces: int | None = None) -> DataFrame:
    """One row per revisit record: record_id, canonical, ts, response_id, response_ts, status and headers.

    `records`: record_id, url, ts, kind ('response' or 'revisit'), http_status, headers (header block as text). A full response is a
    'response' with status 200; a revisit is resolved by the latest one with an earlier time (or, at the same time, a smaller
    record_id) of the same canonical URL. status: `no_response` (none earlier), `mismatch` (an entity tag on both sides that differs, by
    weak comparison, or, without tags, differing Last-Modified), `resolved` (tag or date agree), `unverified` (no validator on
    both sides). headers is the merged map, JSON with sorted keys, for `resolved` and `unverified`.

    Bodies are not moved: response_id leads to the payload. Null urls are not resolved (`no_response`), rows with a null record_id or ts sort
    first, repeated rows are resolved each, records of another kind are passed over, an empty table gives no rows.
    """
    full = (F.col("kind") == "response") & (F.col("http_status") == 200)
    events = records.where(full | (F.col("kind") == "revisit")).select(
        "record_id", F.coalesce(canonical_url(F.col("url")), F.lit("")).alias("canonical"), "ts", (F.col("kind") == "revisit").alias("is_revisit"),
        header_map(F.col("headers")).alias("h"),
        F.when(full & F.col("url").isNotNull(), F.struct(F.col("record_id").alias("id"), F.col("ts").alias("ts"), F.to_json(header_map(F.col("headers"))).alias("h"))).alias("response"),
    )
    found = latest_before(events, "canonical", ["ts", "record_id", "is_revisit"], "response", pieces).where("is_revisit")
    stored = F.from_json(F.col("earlier.h"), "map<string,string>")
    rows = found.select("record_id", "canonical", "ts", F.col("earlier.id").alias("response_id"), F.col("earlier.ts").alias("response_ts"), "h", stored.alias("stored"))
    tags = weak_tag(F.col("stored")["etag"]), weak_tag(F.col("h")["etag"])
    dates = F.col("stored")["last-modified"], F.col("h")["last-modified"]
    status = (
        F.when(F.col("response_ts").isNull() & F.col("response_id").isNull(), "no_response")
        .when(tags[0] != tags[1], "mismatch").when(tags[0] == tags[1], "resolved")
        .when(dates[0] != dates[1], "mismatch").when(dates[0] == dates[1], "resolved").otherwise("unverified")
    )
    rows = rows.withColumn("status", status)
    entries = F.array_sort(F.map_entries(merged_headers(F.col("stored"), F.col("h"))))
    return rows.select(
        "record_id", "canonical", "ts", "response_id", "response_ts", "status",
        F.when(F.col("status").isin("resolved", "unverified"), F.to_json(F.map_from_entries(entries))).alias("headers"),
    )


def records_from_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Archive records made from a table of pages: each page is a full response, and is visited again once to three times under other
    spellings of its URL, with validators that agree, differ or lack. A third of all records belongs to one URL, as front pages do."""
    n = F.col(page_id)
    tag = F.sha1(F.coalesce(F.col(html), F.lit("")))
    hot = F.lit("https://www.front.example.org/")
    at = lambda day: F.timestamp_seconds(F.lit(1_700_000_000) + n * 60 + F.lit(day * 86_400))
    head = lambda etag, when, more: F.concat(F.lit("ETag: \""), etag, F.lit("\"\r\nLast-Modified: day "), when, F.lit("\r\nContent-Type: text/html\r\n"), more)
    day = (n % 28).cast("string")
    length = F.length(F.coalesce(F.col(html), F.lit(""))).cast("string")

    def record(k: int, address: Column, kind: str, code: Column, when: Column, headers: Column, keep: Column) -> Column:
        return F.when(keep, F.struct((n * 8 + k).alias("record_id"), address.alias("url"), when.alias("ts"), F.lit(kind).alias("kind"), code.alias("http_status"), headers.alias("headers")))

    yes, ok, unchanged = F.lit(True), F.lit(200), F.lit(304)
    made = F.array(
        record(0, F.col(url), "response", ok, at(0), F.concat(head(tag, day, F.lit("X-Served: first\r\nContent-Length: ")), length), yes),
        record(1, F.concat(F.col(url), F.lit("#again")), "revisit", unchanged, at(1), head(tag, day, F.lit("X-Served: second\r\nContent-Length: 0")), yes),
        record(2, F.concat(F.col(url), F.lit("#late")), "revisit", unchanged, at(-1), F.lit("X-Served: early"), n % 3 == 0),
        record(3, F.col(url), "revisit", unchanged, at(2), head(F.concat(tag, F.lit("x")), day, F.lit("X-Served: other")), n % 4 == 0),
        record(4, F.col(url), "revisit", unchanged, at(3), F.lit("X-Served: bare\r\nCache-Control: no-cache\r\nContent-Length: 0"), n % 5 == 0),
        record(5, hot, "response", F.when(n % 7 == 0, 200).otherwise(404), at(0), F.concat(F.lit("ETag: \""), F.substring(tag, 1, 1), F.lit("\"\r\nX-Page: "), n.cast("string")), n % 2 == 0),
        record(6, F.lit("http://front.example.org:80?utm_source=x"), "revisit", unchanged, at(0), F.concat(F.lit("ETag: W/\""), F.substring(tag, 2, 1), F.lit("\"\r\nX-Front: yes")), yes),
    )
    return pages.select(F.explode(F.filter(made, lambda r: r.isNotNull())).alias("r")).select("r.*")
