"""Queries of the general data-preparation problems (pN_...), over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import hierarchy, history, packed, units
from ledgerloom.session import Scratch, table

UPDATE_SHARE = 0.9


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The amount of every fact in whole euro cents."""
    return units.to_euro_cents(table(spark, sf_dir, "lagebericht_facts"), table(spark, sf_dir, "sheet_notes"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root, depth, path and number of descendants of every code of the taxonomy."""
    h = hierarchy.build_hierarchy(table(spark, sf_dir, "hgb_taxonomy"), "hgb_code", "parent_code", "node_id")
    path = F.when(F.col("in_cycle"), "").otherwise(F.array_join("path", "/"))
    return h.select(F.col("code").alias("hgb_code"), "root_code", "depth", path.alias("path"), "n_descendants")


def p3_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ancestor of every code outside loops with its distance: the descendant lists."""
    h = hierarchy.build_hierarchy(table(spark, sf_dir, "hgb_taxonomy"), "hgb_code", "parent_code", "node_id")
    return hierarchy.descendant_pairs(h)


def p2_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of unit spellings with estimated scale, agreement and offset."""
    rows = units.prepared(table(spark, sf_dir, "lagebericht_facts"), table(spark, sf_dir, "sheet_notes"))
    pairs, _ = units.scale_graph(Scratch(spark, "units").write(rows, "prepared"))
    return pairs


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods of names, seats, officers and consolidated companies.

    The history is built from what had been loaded by a date, then the later
    loads (late snapshots and corrections among them) are applied as one update
    that rebuilds the touched chains.
    """
    raw = table(spark, sf_dir, "entity_records")
    loaded = F.unix_micros(F.col("loaded_at").cast("timestamp"))
    cut = raw.agg(F.percentile_approx(loaded, UPDATE_SHARE)).first()[0]
    later = F.coalesce(loaded > F.lit(cut), F.lit(False))
    base = Scratch(spark, "history").write(history.build_history(raw.where(~later)), "base")
    return history.rebuild_affected(base, raw, raw.where(later))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single values of the packed field ukv_codes with their position."""
    return packed.split_packed(table(spark, sf_dir, "pnl_format_bridge"), "bridge_id", "company_normalized", "ukv_codes")


def queries() -> dict:
    return {"p2_found": p2_found, "p2_scales": p2_scales, "p3_found": p3_found, "p3_descendants": p3_descendants, "p6_found": p6_found, "p7_found": p7_found}


_BLANK = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
_TREE = rf"""named AS (SELECT node_id AS o, hgb_code AS code, lower(regexp_replace(hgb_code, '{_BLANK}', '', 'g')) AS key, lower(regexp_replace(parent_code, '{_BLANK}', '', 'g')) AS up FROM hgb_taxonomy),
nodes AS (SELECT key, arg_min(code, o) AS code, arg_min(coalesce(up, ''), o) AS up FROM named WHERE key <> '' GROUP BY 1),
linked AS (SELECT n.key, n.code, p.key AS up FROM nodes n LEFT JOIN nodes p ON p.key = n.up),
w AS (SELECT key, code AS root_code, 0 AS depth, code AS path, [code] AS above FROM linked WHERE up IS NULL UNION ALL SELECT l.key, w.root_code, w.depth + 1, w.path || '/' || l.code, list_append(w.above, l.code) FROM w JOIN linked l ON l.up = w.key)"""
_HISTORY = r"""t AS (SELECT entity_id, snapshot_date, legal_name, seat, historical_names, officer_changes, scope_changes FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, snapshot_date ORDER BY loaded_at DESC, snapshot_id DESC) AS k FROM entity_records WHERE entity_id IS NOT NULL AND snapshot_date IS NOT NULL) WHERE k = 1),
stated AS (SELECT entity_id, 'legal_name' AS attribute, trim(regexp_replace(legal_name, '[\s\p{Z}]+', ' ', 'g'), ' ') AS entry, snapshot_date AS d FROM t UNION ALL SELECT entity_id, 'seat', trim(regexp_replace(seat, '[\s\p{Z}]+', ' ', 'g'), ' '), snapshot_date FROM t),
turns AS (SELECT * FROM (SELECT *, lag(entry) OVER (PARTITION BY entity_id, attribute ORDER BY d) AS was FROM stated WHERE entry <> '') WHERE was IS NULL OR was <> entry),
versions AS (SELECT entity_id, attribute, entry, CAST(d AS VARCHAR) AS valid_from, coalesce(CAST(lead(d) OVER (PARTITION BY entity_id, attribute ORDER BY d) AS VARCHAR), '') AS valid_to FROM turns),
listed AS (SELECT entity_id, trim(regexp_replace(n, '[\s\p{Z}]+', ' ', 'g'), ' ') AS entry, snapshot_date AS d FROM (SELECT entity_id, snapshot_date, unnest(historical_names) AS n FROM t)),
former AS (SELECT entity_id, 'legal_name' AS attribute, entry, '' AS valid_from, CAST(min(d) AS VARCHAR) AS valid_to FROM listed l WHERE entry <> '' AND NOT EXISTS (SELECT 1 FROM stated s WHERE s.attribute = 'legal_name' AND s.entity_id = l.entity_id AND s.entry = l.entry) GROUP BY 1, 3),
c AS (SELECT entity_id, unnest(officer_changes) AS c FROM t), s AS (SELECT entity_id, unnest(scope_changes) AS c FROM t),
told AS (SELECT entity_id, 'officer' AS attribute, unnest(c.officers_removed) AS n, c.effective_date AS d, 0 AS enters FROM c UNION ALL SELECT entity_id, 'officer', unnest(c.officers_added), c.effective_date, 1 FROM c
  UNION ALL SELECT entity_id, 'scope', c.entity, c.effective_date, CASE lower(trim(c.change_kind, ' ')) WHEN 'left' THEN 0 WHEN 'entered' THEN 1 END FROM s),
events AS (SELECT DISTINCT entity_id, attribute, trim(regexp_replace(n, '[\s\p{Z}]+', ' ', 'g'), ' ') AS entry, d, enters FROM told WHERE d IS NOT NULL AND enters IS NOT NULL),
changes AS (SELECT * FROM (SELECT *, lag(enters) OVER (PARTITION BY entity_id, attribute, entry ORDER BY d, enters) AS was FROM events WHERE entry <> '') WHERE was IS NULL OR was <> enters),
ended AS (SELECT *, lead(d) OVER (PARTITION BY entity_id, attribute, entry ORDER BY d, enters) AS next FROM changes),
terms AS (SELECT entity_id, attribute, entry, CASE WHEN enters = 1 THEN CAST(d AS VARCHAR) ELSE '' END AS valid_from, coalesce(CAST(CASE WHEN enters = 1 THEN next ELSE d END AS VARCHAR), '') AS valid_to FROM ended WHERE enters = 1 OR was IS NULL)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": f"""WITH RECURSIVE {_TREE}, below AS (SELECT a AS code, count(*) - 1 AS n FROM (SELECT unnest(above) AS a FROM w) GROUP BY 1)
SELECT l.code AS hgb_code, coalesce(w.root_code, 'CYCLE') AS root_code, coalesce(w.depth, -1) AS depth, coalesce(w.path, '') AS path, CAST(CASE WHEN w.key IS NULL THEN -1 ELSE b.n END AS INT) AS n_descendants FROM linked l LEFT JOIN w ON w.key = l.key LEFT JOIN below b ON b.code = l.code""",
        "p3_descendants": f"""WITH RECURSIVE {_TREE} SELECT above[i] AS ancestor, above[len(above)] AS descendant, CAST(len(above) - i AS INT) AS distance FROM (SELECT above, unnest(range(1, len(above))) AS i FROM w)""",
        "p6_found": f"WITH {_HISTORY} SELECT * FROM versions UNION ALL SELECT * FROM former UNION ALL SELECT * FROM terms",
    }
