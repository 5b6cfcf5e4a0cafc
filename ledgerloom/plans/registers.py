"""Queries of the entity and store operators, each with the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import labels
from ledgerloom.operators import checks, entities, mapping, series
from ledgerloom.plans.filings import QUERIES, SQL, query
from ledgerloom.session import table


@query("""WITH RECURSIVE l AS (SELECT c_custkey AS id, CASE WHEN c_custkey > 1 THEN c_custkey // 2 END AS parent FROM customer), w AS (SELECT id, id AS here, 0 AS steps FROM l UNION ALL SELECT w.id, l.parent, steps + 1 FROM w JOIN l ON l.id = w.here WHERE l.parent IS NOT NULL)
SELECT CAST(id AS VARCHAR) AS id, CAST(arg_max(here, steps) AS VARCHAR) AS terminal, CAST(max(steps) AS INT) AS steps FROM w GROUP BY 1""")
def entity_walk(spark, sf_dir):
    """Ultimate parent of every customer in a binary tree of keys."""
    l = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.when(F.col("c_custkey") > 1, F.floor(F.col("c_custkey") / 2)).cast("string").alias("parent"))
    return entities.terminal_parents(l, "id", "parent")


@query("""SELECT company_normalized, member_key, count(DISTINCT target_key) AS n_parents FROM row_merges WHERE target_key IS NOT NULL AND member_key IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT target_key) > 1""")
def ambiguous_parents(spark, sf_dir):
    """Member keys with several targets."""
    m = table(spark, sf_dir, "row_merges").where("member_key is not null").withColumn("child", F.struct("company_normalized", "member_key"))
    return entities.ambiguous_parents(m, "child", "target_key").select("child.company_normalized", "child.member_key", "n_parents")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
def children_semi(spark, sf_dir):
    """Customers with an open order."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    return table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_missing(spark, sf_dir):
    """Customers without any order in part."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return checks.untraced(table(spark, sf_dir, "customer").select("c_custkey"), o, ["c_custkey"])


_TIDY = r"regexp_replace(regexp_replace({c}, '\s+', ' ', 'g'), '^ | $', '', 'g')"


@query(f"""WITH e AS (SELECT *, nullif({_TIDY.format(c='legal_name')}, '') AS name FROM entity_records WHERE entity_id IS NOT NULL),
r AS (SELECT entity_id, count(*) AS n_records FROM e GROUP BY 1),
n AS (SELECT entity_id, name FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY snapshot_date DESC NULLS LAST, loaded_at DESC NULLS LAST, snapshot_id DESC) AS k FROM e WHERE name IS NOT NULL) WHERE k = 1),
a AS (SELECT DISTINCT entity_id, {_TIDY.format(c='x')} AS x FROM (SELECT entity_id, name AS x FROM e WHERE name IS NOT NULL UNION ALL SELECT entity_id, unnest(historical_names) FROM e) WHERE {_TIDY.format(c='x')} <> ''),
f AS (SELECT a.entity_id, array_to_string(list_sort(list(x)), ';') AS former FROM a LEFT JOIN n USING (entity_id) WHERE name IS NULL OR x <> name GROUP BY 1)
SELECT r.entity_id, n.name AS legal_name, n_records, coalesce(former, '') AS former_names FROM r LEFT JOIN n USING (entity_id) LEFT JOIN f USING (entity_id)""")
def merge_records(spark, sf_dir):
    """One record per entity with all its former names."""
    return entities.merged(table(spark, sf_dir, "entity_records")).select("entity_id", "legal_name", "n_records", F.array_join("former_names", ";").alias("former_names"))


@query("""SELECT DISTINCT entity_id, legal_form, register_type, w AS expected FROM (SELECT entity_id, legal_form, register_type, CASE WHEN regexp_matches(lower(legal_form), 'kg|ohg|eg') THEN 'HRA' WHEN regexp_matches(lower(legal_form), 'gmbh|ag|se') THEN 'HRB' END AS w FROM entity_records) WHERE w IS NOT NULL AND w <> register_type""")
def register_warnings(spark, sf_dir):
    """Entities in another register than their legal form calls for."""
    e = table(spark, sf_dir, "entity_records").select("entity_id", "legal_form", "register_type", labels.expected_register(F.col("legal_form")).alias("expected"))
    return e.where("expected is not null and expected != register_type").distinct()


@query("""SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, array_to_string(list_sort(list(DISTINCT event_type)), ';') AS seen FROM events GROUP BY 1""")
def upsert_merge(spark, sf_dir):
    """Store of early events after the late ones: latest type, union of types."""
    e = table(spark, sf_dir, "events")
    half = e.withColumn("late", F.col("event_id") % 2 == 1)
    part = lambda c: half.where(c).groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.max(F.struct("ts", "event_id")).alias("at"), F.collect_set("event_type").alias("seen"))
    store, batch = part("not late"), part("late")
    newer = batch.join(store.select("user_id", F.col("at").alias("had")), "user_id", "left").withColumn("event_type", F.when(F.col("had").isNull() | (F.col("at") > F.col("had")), F.col("event_type")))
    return entities.upsert(store, newer, "user_id", ["event_type"], ["seen"]).select("user_id", "event_type", F.array_join("seen", ";").alias("seen"))


@query("""SELECT t.table_id, coalesce(o.new_type, t.table_type) AS table_type FROM extracted_tables t LEFT JOIN (SELECT filing_id, heading, arg_max(table_type, table_id) AS new_type FROM extracted_tables WHERE table_id % 5 = 0 AND filing_id IS NOT NULL AND heading IS NOT NULL GROUP BY 1, 2) o ON o.filing_id = t.filing_id AND o.heading = t.heading""")
def override_left(spark, sf_dir):
    """Table types after overrides, the last override of a heading counting."""
    t = table(spark, sf_dir, "extracted_tables")
    o = entities.latest(t.where("table_id % 5 = 0 and filing_id is not null and heading is not null"), ["filing_id", "heading"], ["table_id"]).select("filing_id", "heading", F.col("table_type").alias("new_type"))
    return t.join(o, ["filing_id", "heading"], "left").select("table_id", F.coalesce("new_type", "table_type").alias("table_type"))


@query("""WITH k AS (SELECT DISTINCT hgb_code FROM hgb_taxonomy WHERE statement = 'UKV') SELECT alias_id, std_id FROM client_aliases WHERE trim(coalesce(std_id, ''), ' ') <> '' AND trim(std_id, ' ') IN (SELECT hgb_code FROM k)""")
def refused_aliases(spark, sf_dir):
    """Confirmed aliases that contradict the register of refusals (here: all codes of the other method)."""
    a = table(spark, sf_dir, "client_aliases").where("trim(coalesce(std_id, '')) != ''").withColumn("hgb_code", F.trim("std_id"))
    return a.join(mapping.small(table(spark, sf_dir, "hgb_taxonomy").where("statement = 'UKV'").select("hgb_code").distinct()), "hgb_code", "left_semi").select("alias_id", "std_id")


@query("""SELECT client, client_label, arg_max(std_id, (entered_at, alias_id)) AS std_id FROM client_aliases WHERE client IS NOT NULL AND client_label IS NOT NULL AND std_id IS NOT NULL GROUP BY 1, 2""")
def alias_last_wins(spark, sf_dir):
    """Append-only alias store read as last write wins."""
    a = table(spark, sf_dir, "client_aliases").where("client is not null and client_label is not null and std_id is not null")
    return entities.latest(a, ["client", "client_label"], ["entered_at", "alias_id"]).select("client", "client_label", "std_id")


@query("""SELECT slot, gate FROM (SELECT slot, 'not assigned' AS gate FROM (VALUES ('A'), ('B'), ('C'), ('D')) AS s(slot) WHERE slot NOT IN (SELECT l_returnflag FROM lineitem) UNION ALL SELECT l_returnflag, 'mixed status' FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linestatus) > 1)""")
def gate_violations(spark, sf_dir):
    """Slots that are empty, and slots whose rows disagree."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("slot"), "l_linestatus")
    slots = spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "slot string")
    empty = checks.untraced(slots, li, ["slot"]).withColumn("gate", F.lit("not assigned"))
    return empty.unionByName(checks.mixed(li, ["slot"], "l_linestatus").select("slot", F.lit("mixed status").alias("gate")))


@query("""SELECT avg(CASE WHEN section IS NULL THEN 1.0 ELSE 0.0 END) AS unknown_rate, CAST(sum(CASE WHEN section IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_unknown FROM documents""")
def unknown_rate(spark, sf_dir):
    """Share of documents without a section; 0 on an empty table."""
    return table(spark, sf_dir, "documents").agg(F.coalesce(F.avg(F.when(F.col("section").isNull(), 1.0).otherwise(0.0)), F.lit(0.0)).alias("unknown_rate"), F.coalesce(F.sum(F.when(F.col("section").isNull(), 1).otherwise(0)), F.lit(0)).alias("n_unknown"))


@query("""SELECT company_normalized, source, n FROM (SELECT company_normalized, source, count(*) AS n, row_number() OVER (PARTITION BY company_normalized ORDER BY count(*) DESC, source) AS k FROM documents WHERE source IS NOT NULL GROUP BY 1, 2) WHERE k = 1""")
def main_source(spark, sf_dir):
    """Most frequent source of every company, ties by name."""
    g = table(spark, sf_dir, "documents").where("source is not null").groupBy("company_normalized", "source").agg(F.count("*").alias("n"))
    return series.first_by_key(g.withColumn("minus_n", -F.col("n")), ["company_normalized"], ["minus_n", "source"]).drop("minus_n")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
