"""Writers: JSON lines, Parquet, keyed and bucketed tables, folders per topic, and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions.text import topic_slug
from ..session import stage


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def flat_layout(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    return df.withColumns({c: F.to_json(c) for c in schemas.JSON_COLUMNS if c in df.columns})


def write_parquet(df: DataFrame, path: str, flatten_json: bool = False, mode: str = "errorifexists") -> None:
    """Zstandard Parquet; nested columns stay native, so they can be pruned, unless `flatten_json` asks for JSON text."""
    (flat_layout(df) if flatten_json else df).write.mode(mode).option("compression", "zstd").parquet(path)


def upsert(current: DataFrame, batch: DataFrame, key: str = "hash_sha256", seq: str = "seq", keep: str = "pmid") -> DataFrame:
    """`current` after the rows of `batch`: a known key takes every column of its last batch row except `keep`, which
    stays as first written; an unknown key is inserted.

    The current table is only anti-joined with the batch keys, and asked for (key, keep) of those keys; when the batch
    is small the optimizer broadcasts its keys and the current table is not shuffled. Copies of one key are reduced with
    map-side combining.
    """
    columns = [c for c in current.columns if c not in (key, keep)]
    ends = batch.groupBy(key).agg(F.max(seq).alias("_last"), F.min(seq).alias("_first"))
    inserted = batch.join(ends.select("_first"), F.col(seq) == F.col("_first"), "left_semi").select(key, F.col(keep).alias("_inserted"))
    latest = batch.join(ends.select("_last"), F.col(seq) == F.col("_last"), "left_semi").select(key, *columns).join(inserted, key)
    known = current.select(key, F.col(keep).alias("_known"), F.lit(True).alias("_exists")).join(
        batch.select(key).distinct(), key, "left_semi"
    )
    changed = latest.join(known, key, "left").select(
        key, F.when(F.col("_exists"), F.col("_known")).otherwise(F.col("_inserted")).alias(keep), *columns
    )
    untouched = current.join(batch.select(key).distinct(), key, "left_anti")
    return untouched.unionByName(changed.select(*current.columns))


def latest_version(spark: SparkSession, root: str, below: int | None = None) -> int | None:
    """Highest finished snapshot under `root`, optionally below a version."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(root)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return None
    versions = []
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("version=") and files.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            versions.append(int(name.split("=")[1]))
    return max((v for v in versions if below is None or v < below), default=None)


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


MANIFEST = "bucket int, version int, buckets int, ddl string"
#: Bucket number of the manifest row that describes the table and names no files.
TABLE_ROW = -1


def read_manifest(spark: SparkSession, root: str, below: int | None = None) -> tuple[int, list] | None:
    """(version, rows) of the latest finished manifest of a keyed table: for every bucket the version that wrote its files."""
    version = latest_version(spark, f"{root}/manifest", below)
    if version is None:
        return None
    return version, spark.read.schema(MANIFEST).parquet(f"{root}/manifest/version={version}").collect()  # one row per bucket


def bucket_paths(root: str, rows: list, only: set[int] | None = None) -> list[str]:
    return [f"{root}/data/version={r.version}/_bucket={r.bucket}" for r in rows if r.bucket != TABLE_ROW and (only is None or r.bucket in only)]


def upsert_snapshot(
    root: str, batch: DataFrame, version: int | None = None, key="hash_sha256", seq="seq", keep="pmid", buckets: int = 64,
) -> str:
    """Bring a keyed table up to date with `batch` and return its folder.

    The table is hash-bucketed by key, and a manifest says which version wrote the files of each bucket. Only the buckets that
    the batch touches are read and written anew, under the new version; the manifest that points to them is written last and counts
    once it is finished. A run that ends between the two leaves files that no manifest names, and writing the same version again
    overwrites them, so a replay gives the same table. Earlier versions stay readable. `buckets` holds for a new table; a table
    keeps its number.
    """
    spark = batch.sparkSession
    found = read_manifest(spark, root, version)
    previous, rows = found if found is not None else (-1, [])
    version = previous + 1 if version is None else version
    buckets = rows[0].buckets if rows else buckets
    columns = [c for c in batch.columns if c != seq]
    batch = stage(batch, "batch")
    schema = batch.select(*columns).schema
    touched = {r[0] for r in batch.select(bucket_of(key, buckets)).distinct().collect()}  # `buckets` rows at most
    paths = bucket_paths(root, rows, touched)
    current = spark.read.schema(schema).parquet(*paths) if paths else batch.select(*columns).limit(0)
    if touched:
        after = upsert(current, batch, key, seq, keep).withColumn("_bucket", bucket_of(key, buckets)).hint("rebalance", F.col("_bucket"))
        after.write.mode("overwrite").option("compression", "zstd").partitionBy("_bucket").parquet(f"{root}/data/version={version}")
    state = {r.bucket: r.version for r in rows} | dict.fromkeys(touched, version) | {TABLE_ROW: version}
    entries = [(b, v, buckets, schema.toDDL()) for b, v in sorted(state.items())]
    spark.createDataFrame(entries, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/version={version}")
    return root


def read_snapshot(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The keyed table as of its latest version, or of an earlier one."""
    found = read_manifest(spark, root, None if version is None else version + 1)
    if found is None:
        raise FileNotFoundError(f"no finished version under {root}")
    _, rows = found
    paths, schema = bucket_paths(root, rows), rows[0].ddl
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def export_all(
    entries: DataFrame, root: str, name: str, jsonl: bool = True, parquet: bool = True, table: bool = True,
    flatten_json: bool = False,
) -> dict[str, str]:
    """Write every enabled format and return format -> path. Each format has its own folder, so none overwrites another.
    `entries` carries `seq` for the keyed table; the other formats leave it out. The entries are computed once, into a staged table."""
    paths = {}
    entries = stage(entries, "entries")
    columns = [c for c in entries.columns if c != "seq"]
    if jsonl:
        paths["jsonl"] = f"{root}/jsonl/{name}"
        write_jsonl(entries.select(*columns), paths["jsonl"])
    if parquet:
        paths["parquet"] = f"{root}/parquet/{name}"
        write_parquet(entries.select(*columns), paths["parquet"], flatten_json)
    if table:
        paths["table"] = upsert_snapshot(f"{root}/table", entries)
    return paths


def write_by_group(df: DataFrame, root: str, group: str, mode: str = "errorifexists") -> None:
    """JSON lines in one folder per topic or URL list.

    The rebalance hint gathers a group's rows, so that tasks do not each leave a small file in every folder, and lets
    adaptive execution split a group that is too large for one task."""
    grouped = df.withColumn("topic_slug", topic_slug(F.col(group))).hint("rebalance", F.col("topic_slug"))
    grouped.write.mode(mode).partitionBy("topic_slug").json(root)


def write_report(totals: DataFrame, results: DataFrame, root: str) -> None:
    """Run totals and per-topic rows."""
    totals.write.mode("errorifexists").json(f"{root}/stats")
    results.write.mode("errorifexists").json(f"{root}/results")
