"""Joins that a hot key does not bring to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more rows than this, and than a 20,000th of all rows, is hot: so at most 20,000 keys are.
HOT_ROWS, HOT_SHARE = 100_000, 20_000


def hot_keys(rows: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """The hot keys of ``rows`` (column ``key``), or None; counted by a map-side combined aggregate."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"))
    top = counts.where(F.col("__n") > hot_rows)
    all_rows, most = counts.agg(F.sum("__n"), F.max("__n")).first()
    limit = max(hot_rows, (all_rows or 0) // HOT_SHARE)
    return top.where(F.col("__n") > limit).select(key) if (most or 0) > limit else None


def join_unique(rows: DataFrame, key: str, table: DataFrame, on: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Left join of ``rows`` with ``table``, whose column ``on`` is unique: hot keys by broadcast of their few rows, the rest by shuffle."""
    return join_hot(rows, key, table, on, hot_keys(rows, key, hot_rows))


def join_hot(rows: DataFrame, key: str, table: DataFrame, on: str, hot: DataFrame | None) -> DataFrame:
    """``join_unique`` with hot keys that are known already."""
    if hot is None:
        return rows.join(table, F.col(key) == F.col(on), "left")
    few = hot.withColumnRenamed(key, "__hot")
    known = few.join(table, F.col("__hot") == F.col(on), "left")
    warm = rows.join(F.broadcast(known), F.col(key) == F.col("__hot")).drop("__hot")
    cold = rows.join(F.broadcast(few), F.col(key) == F.col("__hot"), "left_anti").join(table, F.col(key) == F.col(on), "left")
    return cold.unionByName(warm)
