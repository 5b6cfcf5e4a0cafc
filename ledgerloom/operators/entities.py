"""Register entities: merged records, parent walk, children, warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import labels
from ledgerloom.operators.hierarchy import build_hierarchy
from ledgerloom.operators.history import tidy


def merged(records: DataFrame) -> DataFrame:
    """One row per entity: the last loaded values win, name lists are united, former legal names join the list."""
    own = records.where("entity_id is not null").withColumn("name", F.nullif(tidy(F.col("legal_name")), F.lit("")))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("snapshot_date", "loaded_at", "snapshot_id")))
    g = own.groupBy("entity_id").agg(last("name").alias("legal_name"), last("legal_form").alias("legal_form"), last("register_type").alias("register_type"), F.count("*").alias("n_records"))
    names = own.select("entity_id", F.explode(F.array_union(F.coalesce("historical_names", F.array().cast("array<string>")), F.array("name"))).alias("n")).select("entity_id", tidy(F.col("n")).alias("n")).where("n != ''")
    former = names.join(g.select("entity_id", "legal_name"), "entity_id").where("legal_name is null or n != legal_name").groupBy("entity_id").agg(F.array_sort(F.collect_set("n")).alias("former_names"))
    return g.join(former, "entity_id", "left").withColumn("former_names", F.coalesce("former_names", F.array().cast("array<string>")))


def warnings(entities: DataFrame) -> DataFrame:
    """entity_id, warning: register type not the one its legal form calls for."""
    want = labels.expected_register(F.col("legal_form"))
    return entities.where(want.isNotNull() & (want != F.col("register_type"))).select("entity_id", F.concat(F.lit("expected "), want, F.lit(", found "), F.col("register_type")).alias("warning"))


def terminal_parents(links: DataFrame, child: str, parent: str) -> DataFrame:
    """child, terminal parent and steps; cycles come out with a null parent and -1."""
    h = build_hierarchy(links.withColumn("__o", F.col(child)), child, parent, "__o")
    return h.select(F.col("code").alias(child), F.when(~F.col("in_cycle"), F.col("root_code")).alias("terminal"), F.col("depth").alias("steps"))


def ambiguous_parents(links: DataFrame, child: str, parent: str) -> DataFrame:
    """Children with more than one distinct parent."""
    return links.where(F.col(parent).isNotNull()).groupBy(child).agg(F.countDistinct(parent).alias("n_parents")).where("n_parents > 1")


def upsert(store: DataFrame, incoming: DataFrame, key: str, values: list[str], sets: list[str], renamed: dict[str, str] | None = None) -> DataFrame:
    """Store after the batch: incoming values win where not null, set columns are united; of a ``renamed`` value the old text joins its set."""
    s, i = store.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__s_{c}") for c in values + sets]), incoming.select(key, *values, *sets)
    j = i.join(s, F.col(key) == F.col("__k"), "full_outer")
    none = F.array().cast("array<string>")
    return j.select(
        F.coalesce(F.col(key), F.col("__k")).alias(key),
        *[F.coalesce(F.col(c), F.col(f"__s_{c}")).alias(c) for c in values],
        *[F.array_sort(F.array_union(F.array_union(F.coalesce(F.col(c), none), F.coalesce(F.col(f"__s_{c}"), none)), _old(c, renamed, none))).alias(c) for c in sets],
    )


def _old(into: str, renamed: dict[str, str] | None, none: Column) -> Column:
    """The store's text of every value that is renamed into ``into`` by the batch."""
    out = none
    for value, target in (renamed or {}).items():
        if target == into:
            out = F.array_union(out, F.when(F.col(value) != F.col(f"__s_{value}"), F.array(f"__s_{value}")).otherwise(none))
    return out


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of every key: the view of an append-only store."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
