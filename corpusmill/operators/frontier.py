"""URL frontier: visited URLs, first-N per group, daily quota."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import stage


def first_visits(log: DataFrame, url: str = "url", seq: str = "seq", ok: str | None = None) -> DataFrame:
    """The first row of each URL in arrival order; with `ok`, the first successful one. `seq` is unique.

    Only the number is reduced, by a hash aggregate that combines before its shuffle, so a URL that makes up a third of the log costs one row per
    task; the wide row is then fetched by its number.
    """
    rows = log if ok is None else log.where(F.col(ok))
    first = rows.where(F.col(seq).isNotNull()).groupBy(url).agg(F.min(seq).alias("_first")).select("_first")
    return rows.join(first, F.col(seq) == F.col("_first"), "left_semi")


def unvisited(urls: DataFrame, log: DataFrame, url: str = "url", ok: str = "ok") -> DataFrame:
    """URLs that no successful fetch of the log covers yet."""
    done = log.where(F.col(ok)).select(url).distinct()
    return urls.join(done, url, "left_anti")


def first_n_per_group(df: DataFrame, group: str, order: list, n: int, salts: int = 16) -> DataFrame:
    """The first `n` rows of each group with their rank.

    Ranked twice: within `salts` slices of a group, then among the first n rows of the slices. A hot group is so sorted in slices
    and at most salts * n of its rows meet in one task, whatever n is; for small n Spark applies the limit before the shuffle too.
    """
    if n < 1:
        raise ValueError("n must be positive")
    slot = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if not dict(df.dtypes)[c].startswith(("map", "variant"))]), F.lit(salts))
    sliced = df.withColumn("_slot", slot)
    near = sliced.withColumn("rank", F.row_number().over(Window.partitionBy(group, "_slot").orderBy(*order))).where(F.col("rank") <= n).drop("_slot", "rank")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= n)


def daily_admission(
    requests: DataFrame, limit: int = 2000, ts: str = "ts", key: str = "event_id", salts: int = 64
) -> DataFrame:
    """Add `day` and `admitted`: the first `limit` requests of each UTC day pass. A request without a time has no day and does not pass.

    A day may hold a third of all rows, so it is never sorted. Counts per second, combined on the map side, tell in which
    second the quota of a day runs out; only the requests of that one second are ranked, in `salts` slices first. The
    result of all that is one row per day, the last admitted request.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    marked = requests.withColumn("day", F.to_date(ts))
    second = F.date_trunc("second", ts)
    counts = marked.groupBy("day", second.alias("_second")).agg(F.count("*").alias("_n"))
    # At most 86,400 rows per day.
    running = Window.partitionBy("day").orderBy("_second").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last_second = stage(
        counts.withColumn("_to", F.sum("_n").over(running))
        .where((F.col("_to") >= limit) & (F.col("_to") - F.col("_n") < limit))
        .select("day", "_second", (F.lit(limit) - (F.col("_to") - F.col("_n"))).alias("_room")),
        "last-second",
    )
    contested = marked.select(
        "day", second.alias("_second"), F.col(ts).alias("_ts"), F.col(key).alias("_key"),
        F.pmod(F.xxhash64(key), F.lit(salts)).alias("_slot"),
    ).join(last_second, ["day", "_second"])
    per_slot = contested.withColumn(
        "_r", F.row_number().over(Window.partitionBy("day", "_slot").orderBy("_ts", "_key"))
    ).where(F.col("_r") <= F.col("_room"))
    per_day = per_slot.withColumn(
        "_rank", F.row_number().over(Window.partitionBy("day").orderBy("_ts", "_key"))
    ).where(F.col("_rank") <= F.col("_room"))
    last = stage(per_day.groupBy("day").agg(F.max(F.struct("_ts", "_key")).alias("_last")), "quota")
    within = F.struct(F.col(ts), F.col(key)) <= F.struct("_last._ts", "_last._key")
    return (
        marked.join(last, "day", "left")
        .withColumn("admitted", F.when(F.col(ts).isNull(), F.lit(False)).when(F.col("_last").isNull(), F.lit(True)).otherwise(within))
        .drop("_last")
    )


def daily_remaining(requests: DataFrame, limit: int = 2000, ts: str = "ts") -> DataFrame:
    """Requests used and left per UTC day."""
    return (
        requests.groupBy(F.to_date(ts).alias("day"))
        .agg(F.count("*").alias("used"))
        .withColumn("remaining", F.greatest(F.lit(0).cast("bigint"), F.lit(limit) - F.col("used")))
    )
