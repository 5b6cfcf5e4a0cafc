"""Columns that are computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with further columns, each evaluated once per row however often it is used later.

    The optimizer copies a projected expression into every place that uses it,
    filters included; behind a generator it cannot. Worth it where an
    expression holds regular expressions and is used many times.
    """
    packed = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("__once")
    return df.select("*", packed).select(*df.columns, *[F.col(f"__once.{n}").alias(n) for n in columns])
