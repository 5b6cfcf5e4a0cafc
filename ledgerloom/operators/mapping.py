"""Labels to the chart of accounts: exact lookup, guarded mapping, account ranges, bridges, format detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import labels

# Headings that aggregate several positions and must never resolve to one.
UNSAFE_HEADINGS = ("materialaufwand", "personalaufwand", "abschreibungen")
DIMENSION_ROWS = 50_000


def small(dimension: DataFrame) -> DataFrame:
    """A dictionary marked for broadcast only if it has at most ``DIMENSION_ROWS`` rows; larger ones are joined by shuffle."""
    return F.broadcast(dimension) if dimension.limit(DIMENSION_ROWS + 1).count() <= DIMENSION_ROWS else dimension


def synonyms(dictionary: DataFrame, label: str, code: str) -> DataFrame:
    """key, candidates (sorted distinct codes): ambiguity is kept."""
    return dictionary.select(labels.lookup_key(F.col(label)).alias("key"), F.col(code).alias("code")).where("key != '' and code is not null").groupBy("key").agg(F.array_sort(F.collect_set("code")).alias("candidates"))


def exact_lookup(rows: DataFrame, label: str, dictionary: DataFrame) -> DataFrame:
    """``rows`` with key, candidates, match_type (normalized, ambiguous, none)."""
    keyed = rows.withColumn("key", labels.lookup_key(F.col(label)))
    joined = keyed.join(small(dictionary), "key", "left")
    n = F.coalesce(F.size("candidates"), F.lit(0))
    return joined.withColumn("match_type", F.when(F.col("candidates").isNull(), "none").when(n == 1, "normalized").otherwise("ambiguous"))


def guarded_map(rows: DataFrame, label: str, framework: str, method: str, dictionary: DataFrame, aliases: DataFrame, positions: DataFrame) -> DataFrame:
    """``rows`` with std_id and match_type; the first refusal that applies decides.

    ``aliases``: key, std_id. ``positions``: code, statement, is_line.
    """
    clean = labels.display_key(F.col(label))
    keyed = rows.withColumn("key", labels.lookup_key(clean)).withColumn("__fw", F.lower(F.coalesce(F.col(framework), F.lit("unknown")))).withColumn("__m", F.lower(F.coalesce(F.col(method), F.lit("unknown"))))
    d = keyed.join(small(dictionary), "key", "left").join(small(aliases.select("key", F.col("std_id").alias("alias_id"))), "key", "left")
    n = F.coalesce(F.size("candidates"), F.lit(0))
    d = d.withColumn("__code", F.coalesce("alias_id", F.when(n == 1, F.element_at("candidates", 1))))
    d = d.join(small(positions.select(F.col("code").alias("__pc"), "statement", "is_line")), F.col("__code") == F.col("__pc"), "left")
    wanted = F.when(F.col("statement").isin("GKV", "UKV"), F.lower("statement"))
    wrong = F.coalesce(wanted != F.col("__m"), F.lit(False))
    match = (
        F.when(labels.is_davon(F.col(label)), "excluded_davon_note")
        .when(F.col("__fw") == "unknown", "framework_undetermined")
        .when(F.col("__fw") != "hgb", "unsupported_framework")
        .when(F.col("key").isin(*UNSAFE_HEADINGS), "unsafe_aggregate_heading")
        .when(F.col("__code").isNull() & (n > 1), "ambiguous")
        .when(F.col("__code").isNull(), "none")
        .when(F.col("alias_id").isNull() & ~F.coalesce("is_line", F.lit(False)), "non_line")
        .when(wrong & (F.col("__m") == "unknown"), "pnl_method_undetermined")
        .when(wrong, "pnl_method_mismatch")
        .when(F.col("alias_id").isNotNull(), "client_alias_exact")
        .otherwise("normalized")
    )
    d = d.withColumn("match_type", match)
    return d.withColumn("std_id", F.when(F.col("match_type").isin("client_alias_exact", "normalized"), F.col("__code"))).drop("__fw", "__m", "__code", "__pc", "alias_id", "candidates", "statement", "is_line")


def narrowest_range(rows: DataFrame, value: str, variant: str, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with code of the narrowest range (variant, low, high, code) that holds the value; the lower start on ties."""
    r = small(ranges.select(F.col("variant").alias("__v"), "low", "high", "code"))
    hit = rows.join(r, (F.col(variant) == F.col("__v")) & F.col(value).between(F.col("low"), F.col("high")), "left")
    return hit.groupBy(*keys).agg(F.min_by("code", F.struct(F.col("high") - F.col("low"), "low")).alias("code"))


def bridge(pairs: DataFrame, source: str, packed: str) -> DataFrame:
    """source, target of a comma-separated bridge, both ways usable."""
    return pairs.select(F.col(source).alias("source"), F.explode(F.split(packed, r"\s*,\s*")).alias("target")).where("target != ''")


def detect_format(texts: DataFrame, key: str, text: str, words: list[tuple[str, str, float]], ratio: float = 3.0) -> DataFrame:
    """key, score per format, detected: the format whose weighted word hits are ``ratio`` times the other's, else undetermined."""

    def score(kind: str) -> Column:
        out = F.lit(0.0)
        for word, of, weight in words:
            if of == kind:
                out = out + F.when(F.contains(F.lower(F.col(text)), F.lit(word)), weight).otherwise(0.0)
        return out

    d = texts.select(key, score("gkv").alias("gkv_score"), score("ukv").alias("ukv_score"))
    g, u = F.col("gkv_score"), F.col("ukv_score")
    return d.withColumn("detected", F.when((g > 0) & (g >= ratio * u), "gkv").when((u > 0) & (u >= ratio * g), "ukv").otherwise("undetermined"))
