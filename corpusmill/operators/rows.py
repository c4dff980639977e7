"""Arrays and maps to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def array_rows(df: DataFrame, keys: list[str], array: Column | str, value: str, position: str = "position") -> DataFrame:
    """(keys, position, value), one row per element.

    The optimizer adds a `size(array) > 0` filter to an inner explode and pushes it towards the scan, which would compute
    a costly array twice; the outer form with a test on its output does not attract that filter."""
    return df.select(*keys, F.posexplode_outer(array).alias(position, value)).where(F.col(position).isNotNull())


def map_rows(df: DataFrame, keys: list[str], entries: Column | str, key: str, value: str) -> DataFrame:
    """(keys, key, value), one row per entry; see `array_rows`."""
    return df.select(*keys, F.explode_outer(entries).alias(key, value)).where(F.col(key).isNotNull())
