"""Plausibility checks over long facts (key, year, value): joins, lags and aggregates that emit rows to look at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import within_cent


def previous_year(facts: DataFrame, keys: list[str], year: str, columns: list[str]) -> DataFrame:
    """``facts`` with prev_<column> of the year before, null unless that very year is there."""
    w = Window.partitionBy(*keys).orderBy(year)
    adjacent = F.col(year) - F.lag(year).over(w) == 1
    return facts.select("*", *[F.when(adjacent, F.lag(c).over(w)).alias(f"prev_{c}") for c in columns])


def moved(facts: DataFrame, keys: list[str], year: str, value: str, share: float, floor: float) -> DataFrame:
    """Adjacent years whose relative change exceeds ``share`` and whose change reaches ``floor``."""
    d = previous_year(facts, keys, year, [value])
    p, v = F.col(f"prev_{value}"), F.col(value)
    return d.where((p != 0) & (F.abs(v - p) > F.abs(p) * share) & (F.abs(v - p) >= floor))


def ratio_moved(facts: DataFrame, base: DataFrame, keys: list[str], year: str, value: str, step: float) -> DataFrame:
    """Adjacent years whose share of the year's base moves by more than ``step``."""
    j = facts.join(base, year).where("base != 0").withColumn("ratio", F.abs(F.col(value)) / F.abs(F.col("base")))
    d = previous_year(j, keys, year, ["ratio"])
    return d.where(F.abs(F.col("ratio") - F.col("prev_ratio")) > step)


def changed(facts: DataFrame, keys: list[str], year: str, attribute: str) -> DataFrame:
    """Adjacent years with another attribute."""
    return previous_year(facts, keys, year, [attribute]).where(F.col(attribute) != F.col(f"prev_{attribute}"))


def mixed(rows: DataFrame, keys: list[str], unit: str) -> DataFrame:
    """Keys with more than one unit, the units sorted."""
    return rows.where(F.col(unit).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_set(unit)).alias("units")).where(F.size("units") > 1)


def unbalanced(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose two totals (a, b) differ by more than the tolerance."""
    return left.join(right, keys).where(~within_cent(F.col("a"), F.col("b")))


def subtotal_off(parts: DataFrame, keys: list[str], role: str, value: str, formula: dict[str, int], total: str) -> DataFrame:
    """Keys with all components present whose signed sum is not the stated total."""
    pick = lambda r: F.sum(F.when(F.col(role) == r, F.col(value)))
    g = parts.groupBy(*keys).agg(pick(total).alias("stated"), *[pick(r).alias(f"c_{i}") for i, r in enumerate(formula)])
    every = F.col("stated").isNotNull()
    summed: Column = F.lit(0)
    for i, sign in enumerate(formula.values()):
        every = every & F.col(f"c_{i}").isNotNull()
        summed = summed + F.col(f"c_{i}") * sign
    return g.where(every).withColumn("summed", summed).where(~within_cent(F.col("stated").cast("double"), F.col("summed").cast("double"))).select(*keys, "stated", "summed")


def untraced(claims: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """Claims without evidence under the same keys."""
    return claims.join(evidence.select(*keys).distinct(), keys, "left_anti")


def with_problems(rows: DataFrame, tests: list[tuple[Column, str]]) -> DataFrame:
    """``rows`` with problems: the words of every test whose condition holds, so that all are reported at once."""
    return rows.withColumn("problems", F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), words) for bad, words in tests])))


def accepted_whole(rows: DataFrame, group: list[str]) -> DataFrame:
    """Rows of groups none of whose rows has problems: a group is taken as a whole or not at all."""
    bad = rows.groupBy(*group).agg(F.max(F.size("problems")).alias("__n")).where("__n = 0").drop("__n")
    return rows.join(bad, group, "left_semi").drop("problems")


def missing_members(groups: DataFrame, present: DataFrame, key: str, member: str, required: list) -> DataFrame:
    """key, member for every required member a group lacks."""
    want = groups.select(key).distinct().withColumn(member, F.explode(F.array(*[F.lit(x) for x in required])))
    return want.join(present.select(key, member).distinct(), [key, member], "left_anti")
