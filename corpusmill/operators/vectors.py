"""Embedding vectors: cosine similarity, nearest vectors and the cache keyed by the hash of the text."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    """Cosine in double precision; 0.0 when either norm is zero."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))

    def total(products: Column) -> Column:
        return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)

    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norm_a = F.sqrt(total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))
    norm_b = F.sqrt(total(F.transform(b, lambda x: x.cast("double") * x.cast("double"))))
    return F.when((norm_a == 0) | (norm_b == 0), F.lit(0.0)).otherwise(dot / (norm_a * norm_b))


def mean_vectors(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """Element-wise mean per group as (group, mean). Sums per element are combined on the map side, so a group with a
    third of all vectors moves one row per task and element."""
    sums = (
        vectors.select(group, F.posexplode(vector).alias("pos", "x"))
        .groupBy(group, "pos")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("pos", "x")))
    return sums.groupBy(group).agg(F.transform(ordered, lambda e: e["x"]).alias("mean"))


def text_key(text: Column | str) -> Column:
    return F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 256)


def cache_lookup(requests: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """Requests with `text_sha256`, the cached `embedding` (NULL on a miss) and `hit`. `cache` holds
    (text_sha256, embedding), one row per hash."""
    keyed = requests.withColumn("text_sha256", text_key(text))
    return keyed.join(cache.withColumn("hit", F.lit(True)), "text_sha256", "left").withColumn(
        "hit", F.coalesce("hit", F.lit(False))
    )


def missing_hashes(requests: DataFrame, cache: DataFrame, text: str = "text", row_id: str = "id") -> DataFrame:
    """(text_sha256, row_id): hashes the cache does not hold, each with its smallest request. Only hashes and ids are shuffled; copies
    of a text are merged on the map side."""
    smallest = requests.select(text_key(text).alias("text_sha256"), row_id).groupBy("text_sha256").agg(F.min(row_id).alias(row_id))
    return smallest.join(cache.select("text_sha256"), "text_sha256", "left_anti")


def cache_misses(requests: DataFrame, cache: DataFrame, text: str = "text", row_id: str = "id") -> DataFrame:
    """Distinct texts the cache does not hold: (text_sha256, text), so however often a text occurs it is vectorised once. The misses are
    settled on hashes and staged; then the text of one request per miss is fetched by `row_id`, which is not null and tells requests apart.
    Few misses are broadcast to the requests, which then stay where they are."""
    missing = stage(missing_hashes(requests, cache, text, row_id), "misses")
    return requests.select(row_id, F.col(text).alias("text")).join(missing, row_id).select("text_sha256", "text")


def embed_with_cache(
    requests: DataFrame, cache: DataFrame, embed_fn, text: str = "text", row_id: str = "id"
) -> tuple[DataFrame, DataFrame]:
    """(requests with embeddings, rows to append to the cache). `embed_fn` is the caller's vectorised UDF from text to
    array<float>; it runs on the misses only, whose result is staged so that it is computed once."""
    added = stage(
        cache_misses(requests, cache, text, row_id).select("text_sha256", embed_fn("text").alias("embedding")), "embeddings"
    )
    known = cache.select("text_sha256", "embedding").unionByName(added)
    return cache_lookup(requests, known, text).drop("hit"), added


def best_of(k: int, digits: int, held: int = 1 << 20):
    """Function of a block of queries and a slice of vectors, both (id, v): the `k` best of the slice for each query. At most `held` scores (or
    those of one query) are in memory at a time. The functions are local so that they travel to the workers by value."""

    def unit(values):
        matrix = np.array(values.tolist(), float)
        norms = np.sqrt((matrix**2).sum(axis=1, keepdims=True))
        return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)

    def best(x, y):
        found = []
        if len(x) and len(y):
            ids, table, asked = y["id"].to_numpy(), unit(y["v"]), unit(x["v"])
            part = max(1, held // len(ids))
            for begin in range(0, len(asked), part):
                some = np.round(asked[begin : begin + part] @ table.T, digits)
                for query, scores in zip(x["id"].iloc[begin : begin + part], some):
                    scores[ids == query] = -2.0
                    # All that tie with the k-th best take part in the order.
                    least = np.partition(scores, -min(k, len(scores)))[-min(k, len(scores))]
                    near = np.flatnonzero((scores >= least) & (ids != query))
                    near = near[np.lexsort((ids[near], -scores[near]))][:k]
                    found += [(query, ids[i], scores[i]) for i in near]
        return pd.DataFrame(found, columns=["query_id", "neighbour_id", "similarity"])

    return best


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int, id_column: str = "vec_id", vector: str = "embedding", digits: int = 6,
    block: int = 1024, slice_rows: int = 20_000,
) -> DataFrame:
    """(query_id, rank, neighbour_id, similarity): for every row of `queries` the `k` rows of `vectors` with another id and the highest cosine
    similarity, rounded to `digits`; ties go by id.

    Queries are dealt into blocks and vectors into slices of bounded size. A task holds one block and one slice and keeps the best `k` of
    each query; only those partial lists meet, so no row is made for a pair, and the scores of a few queries at a time lie in memory. A vector of norm zero has similarity zero; rows without a vector
    are left out; ids of queries are distinct."""
    narrow = lambda df: df.where(F.col(vector).isNotNull()).select(F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows, asked = narrow(vectors), narrow(queries)
    blocks, slices = (max(1, -(-df.count() // size)) for df, size in ((asked, block), (rows, slice_rows)))
    dealt = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("*", dealt("query", blocks).alias("b"), every(slices).alias("s"))
    right = rows.select("*", dealt("row", slices).alias("s"), every(blocks).alias("b"))

    partial = left.groupBy("b", "s").cogroup(right.groupBy("b", "s")).applyInPandas(best_of(k, digits), "query_id bigint, neighbour_id bigint, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "neighbour_id")
    ranked = partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "neighbour_id", "similarity")
