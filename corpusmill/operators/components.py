"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import drop_staged, staged


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edge table (a, b) of longs; the label is the smallest node of the component.

    Alternating large-star and small-star steps (Kiveris et al., 2014): every step replaces the neighbours of a node by links
    to the smallest of them, so the number of rounds is logarithmic, whatever the length of a chain. A round is staged, the
    round before it is removed. Minima are hash aggregates with map-side combining; the joins fetch one row per key, so a hub
    is a skewed join that adaptive execution splits.
    """
    spark = edges.sparkSession
    hi, lo = F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")
    table, path = staged(edges.where("a <> b").select(hi, lo).distinct(), "edges")
    seen = None
    while True:
        both = table.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(table.select(F.col("lo"), F.col("hi")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(lowest, "hi").select(
            F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo"))))
        ).select("col.hi", "col.lo").where("hi <> lo").distinct()
        after, after_path = staged(small, "edges")
        now = after.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        drop_staged(spark, path)
        table, path = after, after_path
        if now == seen:
            break
        seen = now
    stars = table.select(F.col("hi").alias("node"), F.col("lo").alias("label"))
    return stars.union(stars.select("label", "label").distinct())
