"""Many filings to one series per entity: observations, disputes, vintages, gaps, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def observations(rows: DataFrame, keys: list[str], value: str, rank: list[str]) -> DataFrame:
    """One row per (keys, value to the cent): how many rows state it, and the best-ranked representative; disputed if a key has several."""
    cents = F.bround(F.col(value).cast("decimal(30,6)"), 2).cast("decimal(20,2)")
    cents = F.when(cents == 0, F.lit(0).cast("decimal(20,2)")).otherwise(cents)
    g = rows.withColumn("cents", cents).where("cents is not null").groupBy(*keys, "cents").agg(F.count("*").alias("n_rows"), F.min(F.struct(*rank)).alias("first"))
    w = Window.partitionBy(*keys)
    return g.withColumn("n_values", F.count("*").over(w)).withColumn("disputed", F.col("n_values") > 1)


def resolved(obs: DataFrame) -> DataFrame:
    """Observations of undisputed keys: an unresolved conflict is left out, never guessed."""
    return obs.where("not disputed")


def conflicts(rows: DataFrame, keys: list[str], facts: list[str]) -> tuple[DataFrame, DataFrame]:
    """Keys whose facts agree (one row each), and keys whose facts differ (with the number of variants); nulls compare equal."""
    g = rows.groupBy(*keys).agg(F.size(F.collect_set(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(c) for c in facts]))).alias("n_variants"), F.min(F.struct(*facts)).alias("f"))
    return g.where("n_variants = 1").select(*keys, "f.*"), g.where("n_variants > 1").select(*keys, "n_variants")


def best_vintage(rows: DataFrame, keys: list[str], year: str, doc_year: str, value: str, order: str) -> DataFrame:
    """Value of the filing for the year itself, else of the latest filing; the first row on ties."""
    rank = F.struct((F.col(doc_year) == F.col(year)).cast("int"), F.coalesce(F.col(doc_year), F.lit(0)), -F.col(order))
    return rows.groupBy(*keys, year).agg(F.max_by(value, rank).alias(value), F.max_by(doc_year, rank).alias(doc_year))


def gaps(rows: DataFrame, keys: list[str], year: str) -> DataFrame:
    """keys, missing year: every year between a key's first and last that has no row."""
    g = rows.groupBy(*keys).agg(F.min(year).alias("lo"), F.max(year).alias("hi"), F.collect_set(year).alias("have"))
    return g.select(*keys, F.explode(F.array_except(F.sequence("lo", "hi"), "have")).alias("missing"))


def coverage(rows: DataFrame, keys: list[str], year: str) -> DataFrame:
    """keys, n_years, span, coverage and confidence 0.9 (complete) or 0.6."""
    g = rows.groupBy(*keys).agg(F.countDistinct(year).alias("n_years"), (F.max(year) - F.min(year) + 1).alias("span"))
    return g.withColumn("coverage", F.round(F.col("n_years") / F.col("span"), 6)).withColumn("confidence", F.when(F.col("n_years") == F.col("span"), 0.9).otherwise(0.6))


def year_columns(year: str, value: str, years: list[int]) -> list[Column]:
    """Aggregates of one column per year, named y<year>."""
    return [F.sum(F.when(F.col(year) == y, F.col(value))).alias(f"y{y}") for y in years]


def wide(rows: DataFrame, keys: list[str], year: str, value: str, years: list[int]) -> DataFrame:
    """One column per year, named y<year>; the years are given, so no pass is needed to find them."""
    return rows.groupBy(*keys).agg(*year_columns(year, value, years))


def long(rows: DataFrame, keys: list[str], years: list[str]) -> DataFrame:
    """The reverse of ``wide``: year columns to rows, nulls left out."""
    return rows.unpivot(keys, years, "year_col", "value").where("value is not null").withColumn("year", F.regexp_extract("year_col", r"(\d{4})", 1).cast("int")).select(*keys, "year", "value")


def last_growth(rows: DataFrame, keys: list[str], year: str, value: str) -> DataFrame:
    """keys, year, prev_year, growth of the last two points of every series, adjacent or not; none after a zero or a single point."""
    points = F.array_sort(F.collect_set(F.struct(F.col(year).alias("y"), F.col(value).alias("v"))))
    p = rows.groupBy(*keys).agg(points.alias("__p")).where(F.size("__p") > 1)
    last, prev = F.element_at("__p", -1), F.element_at("__p", -2)
    return p.select(*keys, last["y"].alias(year), prev["y"].alias("prev_year"), F.when(prev["v"] != 0, (last["v"] - prev["v"]) / F.abs(prev["v"])).alias("growth")).where("growth is not null")


def carry_forward(rows: DataFrame, scope: list[str], order: list[str], column: str) -> DataFrame:
    """``rows`` with section: the last non-null ``column`` at or above each row."""
    w = Window.partitionBy(*scope).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.last(column, ignorenulls=True).over(w))


def first_by_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every key in an explicit order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
