"""Queries of the filing operators on the project's tables, each with the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import labels, numbers, text
from ledgerloom.operators import checks, mapping, packed, segments, series, tables
from ledgerloom.session import table
from ledgerloom.sources import readers, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# Numbers, years, units ------------------------------------------------------------------------------------------------

_CELLS = """cells AS (
  SELECT table_id, ri - 1 AS row_no, ci - 1 AS col_no, r[ci] AS text FROM (
    SELECT table_id, ri, r, unnest(range(1, len(r) + 1)) AS ci FROM (
      SELECT table_id, ri, rows[ri] AS r FROM (SELECT table_id, rows, unnest(range(1, len(rows) + 1)) AS ri FROM extracted_tables))))"""
_PARSE = r"""CASE
  WHEN regexp_full_match(body, '[0-9]{1,3}(\.[0-9]{3})+(,[0-9]*)?') THEN CAST(replace(replace(body, '.', ''), ',', '.') AS DOUBLE)
  WHEN regexp_full_match(body, '[0-9]+\.[0-9]{3,}') THEN CAST(body AS DOUBLE)
  WHEN regexp_full_match(body, '[0-9]+(,[0-9]*)?') THEN CAST(replace(body, ',', '.') AS DOUBLE)
  WHEN regexp_full_match(body, '[0-9]{1,3}(,[0-9]{3})+(\.[0-9]*)?') THEN CAST(replace(body, ',', '') AS DOUBLE) END"""
_NUMERIC = rf"""numeric AS (SELECT *, CASE WHEN starts_with(trim(text), '-') THEN -1 ELSE 1 END * {_PARSE} AS value
  FROM (SELECT *, trim(regexp_replace(trim(text), '^-+', '')) AS body FROM cells))"""


def _cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = table(spark, sf_dir, "extracted_tables")
    return t, tables.cells(t)


@query(f"WITH {_CELLS} SELECT table_id, row_no, col_no, text FROM cells")
def table_cells(spark, sf_dir):
    """Grids in long form."""
    return _cells(spark, sf_dir)[1]


@query(rf"""WITH {_CELLS}, {_NUMERIC}
SELECT table_id, row_no, col_no, CAST(round(value * 100) AS BIGINT) AS cents FROM numeric WHERE value IS NOT NULL""")
def parse_cells(spark, sf_dir):
    """Every cell that reads as a number, in cents."""
    c = _cells(spark, sf_dir)[1].withColumn("value", numbers.parse_cell(F.col("text"))).where("value is not null")
    return c.select("table_id", "row_no", "col_no", F.round(F.col("value") * 100).cast("bigint").alias("cents"))


@query(r"""WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS x,
  regexp_replace(regexp_replace(regexp_replace(printf('%.2f', l_extendedprice), '\.', ','), '([0-9])([0-9]{3}),', '\1.\2,'), '([0-9])([0-9]{3})\.', '\1.\2.') AS printed FROM lineitem)
SELECT count(*) AS n, sum(CASE WHEN abs(CAST(replace(replace(printed, '.', ''), ',', '.') AS DOUBLE) - x) < 0.006 THEN 1 ELSE 0 END) AS n_back FROM p""")
def parse_german_number(spark, sf_dir):
    """Prices printed the German way and read back."""
    p = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("x"), F.regexp_replace(F.regexp_replace(F.regexp_replace(F.format_string("%.2f", "l_extendedprice"), r"\.", ","), r"(\d)(\d{3}),", "$1.$2,"), r"(\d)(\d{3})\.", "$1.$2.").alias("printed"))
    back = numbers.parse_cell(F.col("printed"))
    return p.agg(F.count("*").alias("n"), F.sum((F.abs(back - F.col("x")) < 0.006).cast("int")).alias("n_back"))


@query(r"""SELECT table_id, list_max(list_transform(regexp_extract_all(heading, '(19|20)[0-9][0-9]'), lambda y: CAST(y AS INT))) AS fiscal_year FROM extracted_tables
WHERE regexp_matches(heading, '(19|20)[0-9][0-9]')""")
def heading_years(spark, sf_dir):
    """Fiscal year of every heading."""
    return table(spark, sf_dir, "extracted_tables").select("table_id", numbers.max_year(F.col("heading")).alias("fiscal_year")).where("fiscal_year is not null")


@query(rf"""WITH {_CELLS}
SELECT t.table_id, CASE WHEN regexp_matches(lower(coalesce(heading, '')), 't(eur|euro|sd\.?)|t€') OR coalesce(h.hit, false) THEN 1000.0 ELSE 1.0 END AS multiplier
FROM extracted_tables t LEFT JOIN (SELECT table_id, bool_or(regexp_matches(lower(coalesce(text, '')), 't(eur|euro|sd\.?)|t€')) AS hit FROM cells WHERE row_no < 10 GROUP BY 1) h USING (table_id)""")
def unit_multiplier(spark, sf_dir):
    """Thousands or single euros, per table."""
    return tables.unit_multipliers(table(spark, sf_dir, "extracted_tables"))


@query(r"""SELECT source_unit, CASE WHEN regexp_matches(lower(source_unit), 't€|teur|teuro|t euro') THEN 'TEUR' WHEN regexp_matches(lower(source_unit), '€|eur') THEN 'EUR' END AS unit, count(*) AS n
FROM lagebericht_facts WHERE source_unit IS NOT NULL GROUP BY 1, 2""")
def source_units(spark, sf_dir):
    """Unit tokens of the facts."""
    f = table(spark, sf_dir, "lagebericht_facts").where("source_unit is not null")
    return f.groupBy("source_unit", numbers.source_unit(F.col("source_unit")).alias("unit")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CASE WHEN s IS NULL THEN NULL ELSE greatest(0, date_diff('day', CAST(o_orderdate AS DATE), CAST(s AS DATE))) END AS days FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def days_late(spark, sf_dir):
    """Days from order to first shipment, null where nothing was shipped."""
    first = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("s"))
    o = table(spark, sf_dir, "orders").join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select("o_orderkey", numbers.days_late(F.col("s").cast("date"), F.col("o_orderdate").cast("date")).alias("days"))


# Labels ---------------------------------------------------------------------------------------------------------------

_KEY = r"""regexp_replace(replace(replace(replace(replace(lower(regexp_replace(regexp_replace(regexp_replace(trim({c}, ' '), '-\s*\r?\n\s*', '', 'g'), '(?i)\s*\((gkv|ukv)\)\s*$', ''),
  '^([0-9]+[A-Za-z]?\.\s+|[a-z]\)\s+|[IVXLCDM]+\.\s+|[A-Z]\.\s+)', '')), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '[^\p{{L}}\p{{N}}]', '', 'g')"""


@query(f"SELECT original_label, hgb_code, {_KEY.format(c='original_label')} AS key FROM label_synonyms")
def label_normalize(spark, sf_dir):
    """Lookup key of every reference label."""
    return table(spark, sf_dir, "label_synonyms").select("original_label", "hgb_code", labels.lookup_key(F.col("original_label")).alias("key"))


@query(f"""WITH d AS (SELECT {_KEY.format(c='original_label')} AS key, list_sort(list(DISTINCT hgb_code)) AS candidates FROM label_synonyms GROUP BY 1),
a AS (SELECT alias_id, {_KEY.format(c='client_label')} AS key FROM client_aliases WHERE client_label IS NOT NULL)
SELECT alias_id, a.key, array_to_string(candidates, ';') AS candidates, CASE WHEN candidates IS NULL THEN 'none' WHEN len(candidates) = 1 THEN 'normalized' ELSE 'ambiguous' END AS match_type
FROM a LEFT JOIN d USING (key)""")
def exact_lookup(spark, sf_dir):
    """Client labels that are reference labels, exactly."""
    d = mapping.synonyms(table(spark, sf_dir, "label_synonyms"), "original_label", "hgb_code")
    a = table(spark, sf_dir, "client_aliases").where("client_label is not null").select("alias_id", "client_label")
    return mapping.exact_lookup(a, "client_label", d).select("alias_id", "key", F.array_join("candidates", ";").alias("candidates"), "match_type")


_DISPLAY = r"regexp_replace(regexp_replace(trim({c}, ' '), '^\s*([a-z]\)|[IVXLM]+[.)]|[0-9]+[a-z]?[.)])\s*', ''), '(?i)\s*\((gkv|ukv)\)\s*$', '')"


@query(rf"""WITH {_CELLS},
l AS (SELECT c.table_id, c.row_no, c.text AS label, lower(coalesce(t.framework, 'unknown')) AS fw, lower(coalesce(t.pnl_method, 'unknown')) AS m FROM cells c JOIN extracted_tables t USING (table_id) WHERE c.col_no = 0 AND c.row_no > 0 AND trim(coalesce(c.text, ''), ' ') <> ''),
k AS (SELECT *, {_KEY.format(c=_DISPLAY.format(c='label'))} AS key FROM l),
d AS (SELECT {_KEY.format(c='original_label')} AS key, list_sort(list(DISTINCT hgb_code)) AS cand FROM label_synonyms GROUP BY 1),
al AS (SELECT key, min(std_id) AS alias_id FROM (SELECT {_KEY.format(c=_DISPLAY.format(c='client_label'))} AS key, trim(std_id, ' ') AS std_id FROM client_aliases WHERE client_label IS NOT NULL AND trim(coalesce(std_id, ''), ' ') <> '') WHERE key <> '' GROUP BY key HAVING count(DISTINCT std_id) = 1),
p AS (SELECT hgb_code AS pc, min(statement) AS statement FROM hgb_taxonomy GROUP BY 1),
j AS (SELECT k.*, cand, alias_id, coalesce(alias_id, CASE WHEN len(cand) = 1 THEN cand[1] END) AS code FROM k LEFT JOIN d USING (key) LEFT JOIN al USING (key)),
r AS (SELECT j.*, statement, coalesce(CASE WHEN statement IN ('GKV', 'UKV') THEN lower(statement) END <> m, false) AS wrong FROM j LEFT JOIN p ON pc = code),
v AS (SELECT *, CASE WHEN regexp_matches(lower(label), '^\s*-\s*davon\b') THEN 'excluded_davon_note' WHEN fw = 'unknown' THEN 'framework_undetermined' WHEN fw <> 'hgb' THEN 'unsupported_framework'
  WHEN key IN ('materialaufwand', 'personalaufwand', 'abschreibungen') THEN 'unsafe_aggregate_heading' WHEN code IS NULL AND coalesce(len(cand), 0) > 1 THEN 'ambiguous' WHEN code IS NULL THEN 'none'
  WHEN alias_id IS NULL AND statement IS NULL THEN 'non_line' WHEN wrong AND m = 'unknown' THEN 'pnl_method_undetermined' WHEN wrong THEN 'pnl_method_mismatch' WHEN alias_id IS NOT NULL THEN 'client_alias_exact' ELSE 'normalized' END AS match_type FROM r)
SELECT table_id, row_no, match_type, CASE WHEN match_type IN ('client_alias_exact', 'normalized') THEN code END AS std_id FROM v""")
def guarded_map(spark, sf_dir):
    """Table rows to codes, with the first refusal that applies."""
    t, c = _cells(spark, sf_dir)
    rows = c.where((F.col("col_no") == 0) & (F.col("row_no") > 0) & (F.trim(F.coalesce("text", F.lit(""))) != "")).join(t.select("table_id", "framework", "pnl_method"), "table_id").withColumnRenamed("text", "label")
    d = mapping.synonyms(table(spark, sf_dir, "label_synonyms"), "original_label", "hgb_code")
    confirmed = table(spark, sf_dir, "client_aliases").where("client_label is not null and trim(coalesce(std_id, '')) != ''")
    al = confirmed.select(labels.lookup_key(labels.display_key(F.col("client_label"))).alias("key"), F.trim("std_id").alias("std_id")).where("key != ''").groupBy("key").agg(F.min("std_id").alias("std_id"), F.countDistinct("std_id").alias("n")).where("n = 1")
    p = table(spark, sf_dir, "hgb_taxonomy").groupBy(F.col("hgb_code").alias("code")).agg(F.min("statement").alias("statement")).withColumn("is_line", F.lit(True))
    return mapping.guarded_map(rows, "label", "framework", "pnl_method", d, al, p).select("table_id", "row_no", "match_type", "std_id")


_RANGES = [("A", 1, 50, "X1"), ("A", 1, 10, "X2"), ("A", 5, 9, "X3"), ("A", 20, 24, "X4"), ("B", 1, 30, "Y1"), ("B", 15, 45, "Y2")]
_RANGE_SQL = "(VALUES " + ", ".join(f"('{v}', {lo}, {hi}, '{c}')" for v, lo, hi, c in _RANGES) + ") AS r(variant, low, high, code)"


@query(f"""SELECT p_partkey, p_size, variant, code FROM (SELECT p_partkey, p_size, p.variant, r.code, row_number() OVER (PARTITION BY p_partkey ORDER BY high - low, low) AS n
FROM (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'B' END AS variant FROM part) p LEFT JOIN {_RANGE_SQL} ON r.variant = p.variant AND p_size BETWEEN low AND high) WHERE n = 1""")
def range_lookup(spark, sf_dir):
    """Narrowest account range that holds a number."""
    ranges = spark.createDataFrame(_RANGES, "variant string, low int, high int, code string")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.when(F.col("p_partkey") % 2 == 0, "A").otherwise("B").alias("variant"))
    return mapping.narrowest_range(p, "p_size", "variant", ranges, ["p_partkey", "p_size", "variant"])


def _sources_of_targets(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("target").agg(F.countDistinct("source").alias("n_sources"), F.min("source").alias("first_source"))


@query(r"""WITH b AS (SELECT bridge_id, gkv_code, unnest(regexp_split_to_array(trim(ukv_codes, ' '), '\s*,\s*')) AS target FROM pnl_format_bridge WHERE regexp_full_match(ukv_codes, '[A-Z]+-[A-Z]\.[0-9](\s*,\s*[A-Z]+-[A-Z]\.[0-9])*'))
SELECT target, count(DISTINCT gkv_code) AS n_sources, min(gkv_code) AS first_source FROM b WHERE target <> '' GROUP BY 1""")
def bridge_reverse(spark, sf_dir):
    """Bridge read backwards, on fields that are plain comma lists."""
    b = table(spark, sf_dir, "pnl_format_bridge").where(F.col("ukv_codes").rlike(r"^[A-Z]+-[A-Z]\.[0-9](\s*,\s*[A-Z]+-[A-Z]\.[0-9])*\z")).withColumn("t", F.trim("ukv_codes"))
    return _sources_of_targets(mapping.bridge(b, "gkv_code", "t"))


@query()
def bridge_reverse_all(spark, sf_dir):
    """Bridge read backwards, on the single values of every field (the SQL of ``bridge_reverse`` holds plain comma lists only)."""
    b = table(spark, sf_dir, "pnl_format_bridge")
    items = packed.split_packed(b, "bridge_id", "company_normalized", "ukv_codes")
    return _sources_of_targets(items.join(b.select("bridge_id", F.col("gkv_code").alias("source")), "bridge_id").withColumnRenamed("item", "target"))


_WORDS = [("materialaufwand", "gkv", 3.0), ("bestand", "gkv", 1.0), ("umsatz", "ukv", 1.0), ("segment", "ukv", 2.0), ("rückstellung", "gkv", 1.0)]


def _score_sql(kind: str) -> str:
    return " + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN {x} ELSE 0.0 END" for w, k, x in _WORDS if k == kind)


@query(f"""SELECT doc_id, CAST(g AS DOUBLE) AS gkv_score, CAST(u AS DOUBLE) AS ukv_score, CASE WHEN g > 0 AND g >= 3 * u THEN 'gkv' WHEN u > 0 AND u >= 3 * g THEN 'ukv' ELSE 'undetermined' END AS detected
FROM (SELECT doc_id, {_score_sql('gkv')} AS g, {_score_sql('ukv')} AS u FROM documents WHERE text IS NOT NULL)""")
def format_detection(spark, sf_dir):
    """Statement format by weighted words."""
    return mapping.detect_format(table(spark, sf_dir, "documents").where("text is not null"), "doc_id", "text", _WORDS)


@query(rf"""WITH {_CELLS} SELECT table_id, row_no, CASE WHEN regexp_matches(lower(t), '^\s*-\s*davon\b') THEN 4 WHEN regexp_matches(t, '^[IVX]+\.\s') THEN 1 WHEN regexp_matches(t, '^[A-Z]\.\s') THEN 0
 WHEN regexp_matches(t, '^[0-9]+[a-z]?\.\s') THEN 2 WHEN regexp_matches(t, '^[a-z]\)\s') THEN 3 ELSE 0 END AS indent, regexp_matches(lower(t), '^\s*-\s*davon\b') AS is_davon
FROM (SELECT table_id, row_no, trim(text, ' ') AS t FROM cells WHERE col_no = 0 AND text IS NOT NULL)""")
def row_styles(spark, sf_dir):
    """Indentation and davon notes of table rows."""
    c = _cells(spark, sf_dir)[1].where("col_no = 0 and text is not null")
    return c.select("table_id", "row_no", labels.indent_level(F.col("text")).alias("indent"), labels.is_davon(F.trim("text")).alias("is_davon"))


# Tables ---------------------------------------------------------------------------------------------------------------

_BLOCKS = r"""hits AS (SELECT table_id, row_no, col_no, list_max(list_transform(regexp_extract_all(text, '(19|20)[0-9][0-9]'), lambda y: CAST(y AS INT))) AS year FROM cells WHERE row_no < 10 AND col_no > 0 AND regexp_full_match(trim(text, ' '), '(19|20)[0-9][0-9]')),
header AS (SELECT table_id, min(row_no) AS header_row FROM hits GROUP BY 1),
wide AS (SELECT c.table_id, header_row, max(col_no) - max(CASE WHEN lower(trim(coalesce(text, ''), ' ')) = 'pdf page' AND col_no = w.last THEN 1 ELSE 0 END) AS last FROM cells c JOIN header h ON h.table_id = c.table_id AND row_no = header_row
  JOIN (SELECT table_id, row_no, max(col_no) AS last FROM cells GROUP BY 1, 2) w ON w.table_id = c.table_id AND w.row_no = c.row_no GROUP BY 1, 2),
starts AS (SELECT h.table_id, header_row, year, col_no, sum(CASE WHEN prev = year THEN 0 ELSE 1 END) OVER (PARTITION BY h.table_id ORDER BY col_no) AS island FROM (
  SELECT hits.*, header_row, lag(year) OVER (PARTITION BY hits.table_id ORDER BY col_no) AS prev FROM hits JOIN header ON header.table_id = hits.table_id AND row_no = header_row) h),
blocks0 AS (SELECT s.table_id, s.header_row, island, year, min(col_no) AS start_col, last FROM starts s JOIN wide w ON w.table_id = s.table_id GROUP BY 1, 2, 3, 4, 6),
blocks AS (SELECT table_id, header_row, year, start_col, coalesce(lead(start_col) OVER (PARTITION BY table_id ORDER BY start_col) - 1, last) AS end_col, row_number() OVER (PARTITION BY table_id ORDER BY start_col) - 1 AS block FROM blocks0)"""
_VALUES = rf"""mult AS (SELECT t.table_id, CASE WHEN regexp_matches(lower(coalesce(heading, '')), 't(eur|euro|sd\.?)|t€') OR coalesce(h.hit, false) THEN 1000.0 ELSE 1.0 END AS multiplier
  FROM extracted_tables t LEFT JOIN (SELECT table_id, bool_or(regexp_matches(lower(coalesce(text, '')), 't(eur|euro|sd\.?)|t€')) AS hit FROM cells WHERE row_no < 10 GROUP BY 1) h USING (table_id)),
valued AS (SELECT n.table_id, n.row_no, b.year, b.block, arg_min(n.value * m.multiplier, n.col_no) AS value FROM numeric n JOIN blocks b ON b.table_id = n.table_id AND n.row_no > b.header_row AND n.col_no BETWEEN b.start_col AND b.end_col
  JOIN mult m ON m.table_id = n.table_id WHERE n.value IS NOT NULL GROUP BY 1, 2, 3, 4),
facts AS (SELECT v.table_id, v.row_no, trim(coalesce(l.text, ''), ' ') AS label, v.year, v.value, CASE WHEN v.block = 0 THEN 0 ELSE 1 END AS priority FROM valued v JOIN cells l ON l.table_id = v.table_id AND l.row_no = v.row_no AND l.col_no = 0
  WHERE NOT regexp_matches(lower(trim(coalesce(l.text, ''), ' ')), '^\s*-\s*davon\b'))"""


@query(f"WITH {_CELLS}, {_BLOCKS} SELECT table_id, header_row, year, start_col, end_col, block FROM blocks")
def year_blocks(spark, sf_dir):
    """Column blocks of fiscal years."""
    return tables.year_blocks(table(spark, sf_dir, "extracted_tables"))


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.block_values(table(spark, sf_dir, "extracted_tables"))


@query(f"WITH {_CELLS}, {_NUMERIC}, {_BLOCKS}, {_VALUES} SELECT table_id, row_no, label, year, CAST(round(value * 100) AS BIGINT) AS cents, priority FROM facts")
def block_values(spark, sf_dir):
    """First readable amount of every row in every block, in euro cents."""
    return _facts(spark, sf_dir).select("table_id", "row_no", "label", "year", F.round(F.col("value") * 100).cast("bigint").alias("cents"), "priority")


_CODED = f"""dict AS (SELECT {_KEY.format(c='original_label')} AS key, min(hgb_code) AS std_id FROM label_synonyms GROUP BY 1 HAVING count(DISTINCT hgb_code) = 1),
coded AS (SELECT f.*, std_id FROM facts f JOIN dict ON {_KEY.format(c='f.label')} = key)"""


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mapping.synonyms(table(spark, sf_dir, "label_synonyms"), "original_label", "hgb_code")
    found = mapping.exact_lookup(_facts(spark, sf_dir), "label", d).where("match_type = 'normalized'")
    return found.select("table_id", "row_no", "label", "year", "value", "priority", F.element_at("candidates", 1).alias("std_id"))


@query(f"""WITH {_CELLS}, {_NUMERIC}, {_BLOCKS}, {_VALUES}, {_CODED}
SELECT table_id, year, std_id, count(DISTINCT label) AS n_labels FROM coded GROUP BY 1, 2, 3 HAVING count(DISTINCT label) > 1""")
def collision_drop(spark, sf_dir):
    """Codes two labels of one table compete for: neither is kept."""
    return tables.within_table(_coded(spark, sf_dir))[1]


@query(f"""WITH {_CELLS}, {_NUMERIC}, {_BLOCKS}, {_VALUES}, {_CODED},
kept AS (SELECT table_id, year, std_id, arg_min(label, row_no) AS label, arg_min(value, row_no) AS value, min(row_no) AS row_no, arg_min(priority, row_no) AS priority FROM coded GROUP BY 1, 2, 3 HAVING count(DISTINCT label) = 1),
named AS (SELECT k.*, t.company_normalized AS company FROM kept k JOIN extracted_tables t USING (table_id)),
best AS (SELECT * FROM (SELECT *, min(priority) OVER (PARTITION BY company, year, std_id) AS top FROM named) WHERE priority = top),
g AS (SELECT company, year, std_id, count(DISTINCT label) AS nl, count(DISTINCT table_id) AS nt, count(*) AS n, arg_min(value, table_id) AS value, arg_min(label, table_id) AS label, min(value) AS lo, max(value) AS hi FROM best GROUP BY 1, 2, 3)
SELECT company, year, std_id, label, CAST(round(value * 100) AS BIGINT) AS cents FROM g WHERE nl = 1 OR (nt = n AND abs(lo - hi) <= greatest(1e-9 * greatest(abs(lo), abs(hi)), 0.01))""")
def consolidated_actuals(spark, sf_dir):
    """One amount per company, year and code over all tables."""
    kept, _ = tables.within_table(_coded(spark, sf_dir))
    t = table(spark, sf_dir, "extracted_tables").select("table_id", F.col("company_normalized").alias("company"))
    ok, _ = tables.across_tables(kept.join(t, "table_id"), ["company"])
    return ok.select("company", "year", "std_id", "label", F.round(F.col("value") * 100).cast("bigint").alias("cents"))


@query()
def subtotal_scan(spark, sf_dir):
    """Unlabelled rows that are, or are not, the sum of the lines above them (window depends on earlier matches: no SQL form)."""
    t, c = _cells(spark, sf_dir)
    blocks = tables.year_blocks(t)
    valued = tables.block_values(t)
    every = c.where("col_no = 0").join(blocks.select("table_id", "header_row").distinct(), "table_id").where("row_no > header_row").select("table_id", "row_no", F.trim(F.coalesce("text", F.lit(""))).alias("label"))
    every = every.where(~labels.is_davon(F.col("label")))
    lines = every.join(valued.select("table_id", "row_no", "year", "value"), ["table_id", "row_no"], "left").withColumn("closing", F.lit(True)).select("table_id", "row_no", "label", F.coalesce("year", F.lit(0)).alias("year"), F.coalesce("value", F.lit(float("nan"))).alias("value"), "closing")
    return tables.subtotals(lines)


@query(rf"""WITH {_CELLS} SELECT DISTINCT table_id FROM (SELECT table_id, col_no, count(*) AS n FROM cells WHERE col_no > 0 AND row_no > 0 AND regexp_full_match(trim(coalesce(text, ''), ' '), '-?[0-9]{{1,3}}(\.[0-9]{{3}})*(,[0-9]+)?') GROUP BY 1, 2) WHERE n >= 5""")
def financial_content(spark, sf_dir):
    """Tables with a column of numbers."""
    return tables.financial_content(_cells(spark, sf_dir)[1])


@query("""SELECT company_normalized, table_type, table_id, n_rows FROM (SELECT company_normalized, table_type, table_id, len(rows) AS n_rows, row_number() OVER (PARTITION BY company_normalized, table_type ORDER BY len(rows) DESC, table_id) AS n FROM extracted_tables WHERE rows IS NOT NULL) WHERE n = 1""")
def primary_tables(spark, sf_dir):
    """Largest table of each company and type."""
    t = table(spark, sf_dir, "extracted_tables").where("rows is not null").select("company_normalized", "table_type", "table_id", F.size("rows").alias("n_rows"))
    return tables.primary_per_class(t, ["company_normalized", "table_type"], "n_rows", "table_id")


@query("""WITH o AS (SELECT filing_id, table_id, page_start, page_end, heading, lag(page_end) OVER w AS pe FROM extracted_tables WHERE filing_id IS NOT NULL WINDOW w AS (PARTITION BY filing_id ORDER BY page_start, table_id))
SELECT filing_id, table_id, sum(CASE WHEN page_start - pe BETWEEN 0 AND 1 THEN 0 ELSE 1 END) OVER (PARTITION BY filing_id ORDER BY page_start, table_id ROWS UNBOUNDED PRECEDING) AS stitched_id FROM o""")
def stitch_islands(spark, sf_dir):
    """Tables of a filing on consecutive pages share an island."""
    from pyspark.sql import Window

    t = table(spark, sf_dir, "extracted_tables").where("filing_id is not null").withColumn("place", F.struct("page_start", "table_id"))
    joins = (F.col("page_start") - F.lag("page_end").over(Window.partitionBy("filing_id").orderBy("place"))).between(0, 1)
    return tables.stitch(t, ["filing_id"], "place", joins).select("filing_id", "table_id", "stitched_id")


@query("""SELECT company_normalized, framework, pnl_method FROM (SELECT company_normalized, min(CASE WHEN lower(framework) <> 'unknown' THEN lower(framework) END) AS framework, count(DISTINCT CASE WHEN lower(framework) <> 'unknown' THEN lower(framework) END) AS nf,
 min(CASE WHEN lower(pnl_method) <> 'unknown' THEN lower(pnl_method) END) AS pnl_method, count(DISTINCT CASE WHEN lower(pnl_method) <> 'unknown' THEN lower(pnl_method) END) AS nm FROM extracted_tables GROUP BY 1) WHERE nf = 1 AND nm = 1""")
def basis_detect(spark, sf_dir):
    """Framework and method of companies whose signals agree."""
    signal = lambda c: F.when(F.lower(c) != "unknown", F.lower(c))
    g = table(spark, sf_dir, "extracted_tables").groupBy("company_normalized").agg(F.min(signal("framework")).alias("framework"), F.countDistinct(signal("framework")).alias("nf"), F.min(signal("pnl_method")).alias("pnl_method"), F.countDistinct(signal("pnl_method")).alias("nm"))
    return g.where("nf = 1 and nm = 1").select("company_normalized", "framework", "pnl_method")


@query("SELECT table_type, doc_label, count(*) AS n FROM extracted_tables GROUP BY GROUPING SETS ((table_type, doc_label), (table_type))")
def type_counts(spark, sf_dir):
    """Tables per type and document, with type totals."""
    return table(spark, sf_dir, "extracted_tables").groupingSets([["table_type", "doc_label"], ["table_type"]], "table_type", "doc_label").agg(F.count("*").alias("n"))


# Prose ----------------------------------------------------------------------------------------------------------------


def _kind_sql() -> str:
    def proof(words: tuple[str, ...]) -> str:
        return "(" + " AND ".join(f"contains(t, '{w}')" for w in words) + ")"

    return "CASE " + " ".join(f"WHEN {' OR '.join(map(proof, proofs))} THEN '{kind}'" for kind, proofs in text.SHEET_KINDS) + " ELSE 'unknown' END"


@query(f"SELECT doc_id, {_kind_sql()} AS kind FROM (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL)")
def sheet_classify(spark, sf_dir):
    """Kind of every text by its words."""
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.sheet_kind(F.col("text")).alias("kind"))


_SENTENCES = r"""sent AS (SELECT doc_id, trim(s, ' ') AS sentence, source_text FROM (SELECT doc_id, text AS source_text, unnest(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+')) AS s FROM documents WHERE text IS NOT NULL) WHERE trim(s, ' ') <> '')"""


@query(f"WITH {_SENTENCES} SELECT doc_id, count(*) AS n_sentences, CAST(sum(length(sentence)) AS BIGINT) AS n_chars FROM sent GROUP BY 1")
def sentence_split(spark, sf_dir):
    """Sentences per text."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.explode(text.sentences(F.col("text"))).alias("s"))
    return d.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.sum(F.length("s")).alias("n_chars"))


def _trigger_sql() -> str:
    parts = [f"SELECT doc_id, sentence, '{k}' AS kind FROM sent WHERE regexp_matches(lower(sentence), '{p}')" for k, p in text.TRIGGERS.items()]
    parts.append(f"SELECT doc_id, sentence, 'movement' AS kind FROM sent WHERE regexp_matches(lower(sentence), '{text.MOVES}') AND regexp_matches(lower(sentence), '{text.CAUSE}') AND regexp_matches(lower(sentence), '{text.PART}')")
    return " UNION ALL ".join(parts)


@query(rf"""WITH {_SENTENCES}, f AS ({_trigger_sql()})
SELECT kind, CASE WHEN regexp_matches(lower(sentence), '[−–-]\s*[0-9]') THEN 'expense' WHEN regexp_matches(lower(sentence), 'aufwendungen|belastung|verlust|kosten') THEN 'expense' WHEN regexp_matches(lower(sentence), 'erträge|ertraege|gewinn|entlastung') THEN 'income' ELSE 'unknown' END AS direction,
 CASE WHEN regexp_matches(lower(sentence), 'umsatz|erlös|erloes') THEN 'revenue' WHEN regexp_matches(lower(sentence), 'kosten|aufwand|material|personal') THEN 'cost' ELSE 'unknown' END AS metric,
 CASE WHEN regexp_matches(lower(sentence), 'entkonsolid|aus dem konsolidierungskreis') THEN 'left' WHEN regexp_matches(lower(sentence), 'erstkonsolid|in den konsolidierungskreis') THEN 'entered' ELSE 'mentioned' END AS change,
 count(*) AS n, CAST(sum(len(regexp_extract_all(sentence, '{numbers.DATE.replace("(?iu)", "(?i)")}'))) AS BIGINT) AS n_dates FROM f GROUP BY 1, 2, 3, 4""")
def sentence_facts(spark, sf_dir):
    """Facts stated in prose, by kind, direction, metric and scope change."""
    d = table(spark, sf_dir, "documents").where("text is not null").withColumn("sheet", F.concat(F.lit("FY"), F.coalesce(F.col("fiscal_year").cast("string"), F.lit(""))))
    f = segments.fact_sentences(d, ["doc_id"], "text", "sheet")
    return f.groupBy("kind", "direction", "metric", "change").agg(F.count("*").alias("n"), F.sum(F.size("dates")).alias("n_dates"))


@query(r"""SELECT sheet, CAST(nullif(regexp_extract(sheet, '(?i)FY\s*(20[0-9][0-9])', 1), '') AS INT) AS fy, split_part(sheet, '_', 1) AS doc, count(*) AS n FROM lagebericht_facts GROUP BY 1""")
def sheet_provenance(spark, sf_dir):
    """Fiscal year and document a sheet title names."""
    return table(spark, sf_dir, "lagebericht_facts").groupBy("sheet").agg(F.count("*").alias("n")).select("sheet", numbers.sheet_year(F.col("sheet")).alias("fy"), F.split_part("sheet", F.lit("_"), F.lit(1)).alias("doc"), "n")


def _lines_under_headings(documents: DataFrame) -> DataFrame:
    d = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("row_no", "line"))
    head = F.when(F.length("line").between(3, 40) & ~F.col("line").rlike("[.:,;]"), F.col("line"))
    return series.carry_forward(d.withColumn("head", head), ["doc_id"], ["row_no"], "head").select("doc_id", "row_no", "line", "section")


@query(r"""SELECT doc_id, row_no, line, last_value(CASE WHEN length(line) BETWEEN 3 AND 40 AND NOT regexp_matches(line, '[.:,;]') THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY row_no ROWS UNBOUNDED PRECEDING) AS section
FROM (SELECT doc_id, i - 1 AS row_no, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL AND n_chars < 2000)))""")
def carry_forward(spark, sf_dir):
    """Heading under which every line of the shorter texts stands: the SQL's share of ``carry_forward_all``."""
    return _lines_under_headings(table(spark, sf_dir, "documents").where("text is not null and n_chars < 2000"))


@query()
def carry_forward_all(spark, sf_dir):
    """Heading under which every line of every text stands (the SQL of ``carry_forward`` holds the shorter texts only)."""
    return _lines_under_headings(table(spark, sf_dir, "documents").where("text is not null"))


@query(r"""WITH x AS (SELECT doc_id, '<html><head><style>p {x}</style></head><body><h1>' || coalesce(section, 'x') || '</h1><script>var a = "' || coalesce(source, '') || '";</script><p>' || replace(coalesce(text, ''), '<', '&lt;') || '</p></body></html>' AS html FROM documents)
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'), ' ') AS visible FROM x""")
def html_visible_text(spark, sf_dir):
    """Text that a page around every whole text shows."""
    html = F.concat(F.lit("<html><head><style>p {x}</style></head><body><h1>"), F.coalesce("section", F.lit("x")), F.lit('</h1><script>var a = "'), F.coalesce("source", F.lit("")), F.lit('";</script><p>'), F.replace(F.coalesce("text", F.lit("")), F.lit("<"), F.lit("&lt;")), F.lit("</p></body></html>"))
    return table(spark, sf_dir, "documents").select("doc_id", text.visible_text(html).alias("visible"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def json_fields(spark, sf_dir):
    """One field of the events' JSON."""
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")).where("k is not null")


_URLS = ["https://a.de/", "https://a.de/karriere/offene-stellen?x=1", "https://a.de/impressum#top", "http://b.com/news/2024", "https://b.com/company/about/", "https://c.fr/produits", "https://c.fr/produkte/tisch", "https://d.de/standorte", "https://d.de", "https://e.de/blog/1", "https://f.de/nachhaltigkeit/bericht", "https://f.de/de/aktuelles"]


@query(f"""SELECT url, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS clean, CASE {' '.join(f"WHEN regexp_matches(p, '{tokens}') THEN '{name}'" for name, tokens in labels.PAGE_CLASSES)} END AS page_class
FROM (SELECT url, lower(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)) AS p FROM (VALUES {', '.join(f"('{u}')" for u in _URLS)}) AS v(url))""")
def url_classify(spark, sf_dir):
    """Page classes by path."""
    u = spark.createDataFrame([(x,) for x in _URLS], "url string")
    return u.select("url", labels.clean_url(F.col("url")).alias("clean"), labels.url_class(F.col("url")).alias("page_class"))


# Copies and fingerprints ----------------------------------------------------------------------------------------------


@query("""WITH h AS (SELECT doc_id, sha256(text) AS sha FROM documents WHERE text IS NOT NULL) SELECT doc_id, sha, min(doc_id) OVER (PARTITION BY sha) AS kept, count(*) OVER (PARTITION BY sha) AS n_copies FROM h""")
def exact_dedup(spark, sf_dir):
    """Class of exact copies of every text."""
    return segments.exact_copies(table(spark, sf_dir, "documents").where("text is not null"), "doc_id", "text")


_PRINTS = """v AS (SELECT vec_id, embedding FROM embeddings UNION ALL SELECT vec_id + 1000000, list_transform(embedding, lambda x, i: CASE WHEN i <= vec_id % 9 THEN -x ELSE x END) FROM embeddings WHERE vec_id % 3 = 0),
p AS (SELECT vec_id, array_to_string(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0 THEN '1' ELSE '0' END), '')::BIT AS bits FROM v), r AS (SELECT bits, min(vec_id) AS k FROM p GROUP BY 1)"""


def _prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign fingerprints of all vectors, and of copies of every third one with up to eight of its components turned round."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    copies = e.where("vec_id % 3 = 0").select((F.col("vec_id") + 1_000_000).alias("vec_id"), F.expr("transform(embedding, (x, i) -> if(i < vec_id % 9, -x, x))").alias("embedding"))
    return e.unionByName(copies).select("vec_id", F.expr(segments.sign_bits("embedding", 64)).alias("bits"))


@query(f"""WITH {_PRINTS} SELECT x.k AS a, y.k AS b, CAST(bit_count(xor(x.bits, y.bits)) AS INT) AS distance FROM r x JOIN r y ON x.k < y.k WHERE bit_count(xor(x.bits, y.bits)) <= 7""")
def near_dup_hamming(spark, sf_dir):
    """Pairs of sign fingerprints of all 64 components within seven bits, complete by banding; near copies are planted."""
    return segments.near_fingerprints(_prints(spark, sf_dir), "vec_id", "bits", 7, 8, 64).withColumn("distance", F.col("distance").cast("int"))


@query()
def near_dup_kept(spark, sf_dir):
    """Prints that are kept when each is dropped that lies within seven bits of an earlier kept one (order-dependent: tested against plain Python)."""
    return segments.kept_of_near(_prints(spark, sf_dir), "vec_id", "bits", 7, 8, 64)


# Series ---------------------------------------------------------------------------------------------------------------


def _unique_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lagebericht_facts").where("value is not null and company_normalized is not null")


@query("""WITH o AS (SELECT company_normalized, fiscal_year, kind, CAST(round_even(CAST(value AS DECIMAL(30,6)), 2) AS DECIMAL(20,2)) AS cents, fact_id FROM lagebericht_facts WHERE value IS NOT NULL AND company_normalized IS NOT NULL),
g AS (SELECT company_normalized, fiscal_year, kind, cents, count(*) AS n_rows, min(fact_id) AS first_fact FROM o GROUP BY 1, 2, 3, 4)
SELECT *, count(*) OVER (PARTITION BY company_normalized, fiscal_year, kind) AS n_values FROM g""")
def reconcile_observations(spark, sf_dir):
    """Observations to the cent per company, year and kind."""
    keys = ["company_normalized", "fiscal_year", "kind"]
    o = series.observations(_unique_values(spark, sf_dir), keys, "value", ["fact_id"])
    return o.select(*keys, "cents", "n_rows", F.col("first.fact_id").alias("first_fact"), "n_values")


@query("""SELECT company_normalized, fiscal_year, kind, sheet, min(CAST(round_even(CAST(value AS DECIMAL(30,6)), 2) AS DECIMAL(20,2))) AS cents FROM lagebericht_facts WHERE value IS NOT NULL AND company_normalized IS NOT NULL
GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT CAST(round_even(CAST(value AS DECIMAL(30,6)), 2) AS DECIMAL(20,2))) = 1""")
def resolve_or_omit(spark, sf_dir):
    """Amounts of sheets without a dispute."""
    keys = ["company_normalized", "fiscal_year", "kind", "sheet"]
    return series.resolved(series.observations(_unique_values(spark, sf_dir), keys, "value", ["fact_id"])).select(*keys, "cents")


@query("""SELECT company_normalized, sheet, row_no, count(DISTINCT (coalesce(CAST(CAST(value AS DECIMAL(30,4)) AS VARCHAR), '-'), coalesce(unit, '-'), coalesce(source_unit, '-'))) AS n_variants FROM lagebericht_facts GROUP BY 1, 2, 3
HAVING count(DISTINCT (coalesce(CAST(CAST(value AS DECIMAL(30,4)) AS VARCHAR), '-'), coalesce(unit, '-'), coalesce(source_unit, '-'))) > 1""")
def conflicting_statements(spark, sf_dir):
    """Rows of a sheet extracted with different amounts or units."""
    f = table(spark, sf_dir, "lagebericht_facts").withColumn("v", F.col("value").cast("decimal(30,4)"))
    return series.conflicts(f, ["company_normalized", "sheet", "row_no"], ["v", "unit", "source_unit"])[1]


@query("""WITH f AS (SELECT company_normalized, kind, fiscal_year, year(extracted_at) AS doc_year, CAST(value AS DECIMAL(30,4)) AS value, fact_id FROM lagebericht_facts WHERE value IS NOT NULL)
SELECT company_normalized, kind, fiscal_year, value, doc_year FROM (SELECT *, row_number() OVER (PARTITION BY company_normalized, kind, fiscal_year ORDER BY CASE WHEN doc_year = fiscal_year THEN 1 ELSE 0 END DESC, coalesce(doc_year, 0) DESC, fact_id) AS n FROM f) WHERE n = 1""")
def best_vintage(spark, sf_dir):
    """The figure of the year's own filing, else of the latest."""
    f = table(spark, sf_dir, "lagebericht_facts").where("value is not null").select("company_normalized", "kind", "fiscal_year", F.year("extracted_at").alias("doc_year"), F.col("value").cast("decimal(30,4)").alias("value"), "fact_id")
    return series.best_vintage(f, ["company_normalized", "kind"], "fiscal_year", "doc_year", "value", "fact_id")


def _order_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("y"), F.col("o_totalprice").cast("decimal(20,2)").alias("v"))


@query("""WITH y AS (SELECT DISTINCT o_custkey, year(o_orderdate) AS y FROM orders), r AS (SELECT o_custkey, min(y) AS lo, max(y) AS hi FROM y GROUP BY 1), e AS (SELECT o_custkey, unnest(range(lo, hi + 1)) AS missing FROM r)
SELECT e.o_custkey, CAST(missing AS INT) AS missing FROM e LEFT JOIN y ON y.o_custkey = e.o_custkey AND y.y = missing WHERE y.y IS NULL""")
def year_gaps(spark, sf_dir):
    """Years without orders between a customer's first and last."""
    return series.gaps(_order_years(spark, sf_dir), ["o_custkey"], "y")


@query("""SELECT o_custkey, n_years, span, round(n_years / span, 6) AS coverage, CASE WHEN n_years = span THEN 0.9 ELSE 0.6 END AS confidence FROM (SELECT o_custkey, count(DISTINCT year(o_orderdate)) AS n_years, max(year(o_orderdate)) - min(year(o_orderdate)) + 1 AS span FROM orders GROUP BY 1)""")
def coverage_confidence(spark, sf_dir):
    """Completeness of every customer's years."""
    return series.coverage(_order_years(spark, sf_dir), ["o_custkey"], "y").withColumn("confidence", F.col("confidence").cast("decimal(2,1)"))


_YEARS = list(range(1992, 2006))


@query("SELECT o_custkey, " + ", ".join(f"sum(CASE WHEN year(o_orderdate) = {y} THEN CAST(o_totalprice AS DECIMAL(20,2)) END) AS y{y}" for y in _YEARS) + f", sum(CASE WHEN year(o_orderdate) NOT BETWEEN {_YEARS[0]} AND {_YEARS[-1]} THEN CAST(o_totalprice AS DECIMAL(20,2)) END) AS other_years FROM orders GROUP BY 1")
def pivot_grid(spark, sf_dir):
    """Years as columns, and what lies in other years, so that nothing is lost."""
    years = _order_years(spark, sf_dir)
    grid = years.groupBy("o_custkey").agg(*series.year_columns("y", "v", _YEARS), F.sum(F.when(~F.col("y").between(_YEARS[0], _YEARS[-1]), F.col("v"))).alias("other_years"))
    return grid


@query("""SELECT o_custkey, CAST(year(o_orderdate) AS INT) AS year, sum(CAST(o_totalprice AS DECIMAL(20,2))) AS value FROM orders GROUP BY 1, 2""")
def unpivot_years(spark, sf_dir):
    """Year columns back to rows; the columns are all years from the first to the last that occur."""
    rows = _order_years(spark, sf_dir)
    lo, hi = rows.agg(F.min("y"), F.max("y")).first()
    years = list(range(lo, hi + 1)) if lo is not None else [_YEARS[0]]
    return series.long(series.wide(rows, ["o_custkey"], "y", "v", years), ["o_custkey"], [f"y{y}" for y in years])


@query("""SELECT company_normalized, source, lang, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY company_normalized, source, lang ORDER BY published_at, doc_id) AS n FROM documents) WHERE n = 1""")
def queue_dedup(spark, sf_dir):
    """First document of every company, source and language."""
    return series.first_by_key(table(spark, sf_dir, "documents"), ["company_normalized", "source", "lang"], ["published_at", "doc_id"]).select("company_normalized", "source", "lang", "doc_id")


@query("""SELECT c_custkey, c_acctbal, n FROM (SELECT c_custkey, CAST(c_acctbal AS DECIMAL(20,2)) AS c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) WHERE n <= 20""")
def rank_blocks(spark, sf_dir):
    """Top twenty by balance, ties by key."""
    from pyspark.sql import Window

    top = table(spark, sf_dir, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(20)
    return top.select("c_custkey", F.col("c_acctbal").cast("decimal(20,2)").alias("c_acctbal"), F.row_number().over(Window.orderBy(F.desc("c_acctbal"), "c_custkey")).alias("n"))


# Checks ---------------------------------------------------------------------------------------------------------------

_NATION_YEAR = """n AS (SELECT n_name, CAST(year(o_orderdate) AS INT) AS y, CAST(sum(CAST(o_totalprice AS DECIMAL(20,2))) AS DOUBLE) AS v FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2)"""


def _nation_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(F.broadcast(table(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    return o.groupBy("n_name", F.year("o_orderdate").alias("y")).agg(F.sum(F.col("o_totalprice").cast("decimal(20,2)")).cast("double").alias("v"))


@query(f"""WITH {_NATION_YEAR}, l AS (SELECT *, lag(v) OVER (PARTITION BY n_name ORDER BY y) AS p, lag(y) OVER (PARTITION BY n_name ORDER BY y) AS py FROM n)
SELECT n_name, y, CAST(round((v - p) / abs(p) * 1000) AS BIGINT) AS permille FROM l WHERE y - py = 1 AND p <> 0 AND abs(v - p) > abs(p) * 0.15 AND abs(v - p) >= 50000""")
def v5_material_yoy(spark, sf_dir):
    """Revenue per nation that moved materially against the year before."""
    m = checks.moved(_nation_year(spark, sf_dir), ["n_name"], "y", "v", 0.15, 50_000.0)
    return m.select("n_name", "y", F.round((F.col("v") - F.col("prev_v")) / F.abs("prev_v") * 1000).cast("bigint").alias("permille"))


@query("""WITH f AS (SELECT l_returnflag AS k, CAST(year(l_shipdate) AS INT) AS y, CAST(sum(CAST(l_extendedprice AS DECIMAL(20,2))) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2), b AS (SELECT y, sum(v) AS base FROM f GROUP BY 1), r AS (SELECT k, f.y, abs(v) / abs(base) AS ratio FROM f JOIN b ON b.y = f.y WHERE base <> 0),
l AS (SELECT *, lag(ratio) OVER (PARTITION BY k ORDER BY y) AS p, lag(y) OVER (PARTITION BY k ORDER BY y) AS py FROM r) SELECT k, y, CAST(round((ratio - p) * 100000) AS BIGINT) AS step FROM l WHERE y - py = 1 AND abs(ratio - p) > 0.0005""")
def v6_ratio_break(spark, sf_dir):
    """Shares of a year's total that moved."""
    f = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("k"), F.year("l_shipdate").alias("y")).agg(F.sum(F.col("l_extendedprice").cast("decimal(20,2)")).cast("double").alias("v"))
    base = f.groupBy("y").agg(F.sum("v").alias("base"))
    m = checks.ratio_moved(f, base, ["k"], "y", "v", 0.0005)
    return m.select("k", "y", F.round((F.col("ratio") - F.col("prev_ratio")) * 100000).cast("bigint").alias("step"))


@query("""WITH d AS (SELECT user_id, CAST(date_diff('day', DATE '2000-01-01', CAST(ts AS DATE)) AS INT) AS day, arg_min(event_type, event_id) AS t FROM events GROUP BY 1, 2), l AS (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY day) AS p, lag(day) OVER (PARTITION BY user_id ORDER BY day) AS pd FROM d)
SELECT user_id, day, t, p AS prev_t FROM l WHERE day - pd = 1 AND t <> p""")
def v3_v4_attribute_change(spark, sf_dir):
    """First event type of a day that differs from the day before."""
    d = table(spark, sf_dir, "events").groupBy("user_id", F.datediff(F.col("ts").cast("date"), F.lit("2000-01-01").cast("date")).alias("day")).agg(F.min_by("event_type", "event_id").alias("t"))
    return checks.changed(d, ["user_id"], "day", "t").select("user_id", "day", "t", "prev_t")


@query("""SELECT company_normalized, fiscal_year, array_to_string(list_sort(list(DISTINCT unit)), ';') AS units FROM lagebericht_facts WHERE unit IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT unit) > 1""")
def v2_mixed_units(spark, sf_dir):
    """Companies and years whose facts mix unit spellings."""
    return checks.mixed(table(spark, sf_dir, "lagebericht_facts"), ["company_normalized", "fiscal_year"], "unit").select("company_normalized", "fiscal_year", F.array_join("units", ";").alias("units"))


@query("""WITH a AS (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(20,2))) AS DOUBLE) AS a FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey, CAST(sum(CASE WHEN l_linenumber = 1 AND l_orderkey % 7 = 0 THEN 0 ELSE CAST(l_extendedprice AS DECIMAL(20,2)) END) AS DOUBLE) AS b FROM lineitem GROUP BY 1)
SELECT a.l_orderkey, CAST(round((a - b) * 100) AS BIGINT) AS off_cents FROM a JOIN b USING (l_orderkey) WHERE abs(a - b) > greatest(1e-9 * greatest(abs(a), abs(b)), 0.01)""")
def v8_balance(spark, sf_dir):
    """Orders whose two totals do not balance."""
    li = table(spark, sf_dir, "lineitem").withColumn("p", F.col("l_extendedprice").cast("decimal(20,2)"))
    a = li.groupBy("l_orderkey").agg(F.sum("p").cast("double").alias("a"))
    b = li.groupBy("l_orderkey").agg(F.sum(F.when((F.col("l_linenumber") == 1) & (F.col("l_orderkey") % 7 == 0), F.lit(0).cast("decimal(20,2)")).otherwise(F.col("p"))).cast("double").alias("b"))
    return checks.unbalanced(a, b, ["l_orderkey"]).select("l_orderkey", F.round((F.col("a") - F.col("b")) * 100).cast("bigint").alias("off_cents"))


@query("SELECT 'customer' AS party, c_custkey AS key, CAST(c_acctbal AS DECIMAL(20,2)) AS balance FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'supplier', s_suppkey, CAST(s_acctbal AS DECIMAL(20,2)) FROM supplier WHERE s_acctbal < 0")
def v9_negative(spark, sf_dir):
    """Negative balances."""
    c = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.lit("customer").alias("party"), F.col("c_custkey").alias("key"), F.col("c_acctbal").cast("decimal(20,2)").alias("balance"))
    s = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.lit("supplier").alias("party"), F.col("s_suppkey").alias("key"), F.col("s_acctbal").cast("decimal(20,2)").alias("balance"))
    return c.unionByName(s)


@query("""WITH g AS (SELECT l_orderkey, sum(CASE WHEN l_linenumber = 1 THEN CAST(l_quantity AS DECIMAL(20,2)) END) AS stated, sum(CASE WHEN l_linenumber = 2 THEN CAST(l_quantity AS DECIMAL(20,2)) END) AS c0, sum(CASE WHEN l_linenumber = 3 THEN CAST(l_quantity AS DECIMAL(20,2)) END) AS c1 FROM lineitem GROUP BY 1)
SELECT l_orderkey, stated, c0 - c1 AS summed FROM g WHERE stated IS NOT NULL AND c0 IS NOT NULL AND c1 IS NOT NULL AND abs(CAST(stated AS DOUBLE) - CAST(c0 - c1 AS DOUBLE)) > greatest(1e-9 * greatest(abs(CAST(stated AS DOUBLE)), abs(CAST(c0 - c1 AS DOUBLE))), 0.01)""")
def v10_subtotal_tieout(spark, sf_dir):
    """Orders whose first line is not the second minus the third."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("string").alias("role"), F.col("l_quantity").cast("decimal(20,2)").alias("q"))
    return checks.subtotal_off(li, ["l_orderkey"], "role", "q", {"2": 1, "3": -1}, "1")


@query("""WITH f AS (SELECT company_normalized, sheet, row_no, kind FROM lagebericht_facts) SELECT DISTINCT company_normalized, sheet, row_no FROM f WHERE kind = 'one_off' AND NOT EXISTS (SELECT 1 FROM f o WHERE o.kind = 'operating_result' AND o.sheet = f.sheet AND o.company_normalized = f.company_normalized)""")
def v11_material_anti(spark, sf_dir):
    """One-off facts on sheets that state no operating result."""
    f = table(spark, sf_dir, "lagebericht_facts")
    return checks.untraced(f.where("kind = 'one_off'").select("company_normalized", "sheet", "row_no").distinct(), f.where("kind = 'operating_result'"), ["company_normalized", "sheet"]).select("company_normalized", "sheet", "row_no")


@query("""SELECT o.l_orderkey, m AS l_linenumber FROM (SELECT DISTINCT l_orderkey FROM lineitem) o, (VALUES (1), (2), (3)) AS r(m) WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.l_orderkey AND l.l_linenumber = m)""")
def v12_required_children(spark, sf_dir):
    """Line numbers an order lacks."""
    li = table(spark, sf_dir, "lineitem")
    return checks.missing_members(li, li, "l_orderkey", "l_linenumber", [1, 2, 3])


@query("""SELECT sheet, row_no, count(*) AS n FROM lagebericht_facts GROUP BY 1, 2 HAVING count(*) > 1""")
def single_source_check(spark, sf_dir):
    """Statements that more than one row claims."""
    return table(spark, sf_dir, "lagebericht_facts").groupBy("sheet", "row_no").agg(F.count("*").alias("n")).where("n > 1")


@query("""WITH p AS (SELECT fact_id, list_filter([CASE WHEN value IS NULL THEN 'value missing' END, CASE WHEN fiscal_year IS NULL THEN 'year missing' END, CASE WHEN trim(coalesce(company_normalized, '')) = '' THEN 'company missing' END, CASE WHEN unit IS NULL AND source_unit IS NULL THEN 'unit missing' END], lambda x: x IS NOT NULL) AS problems FROM lagebericht_facts)
SELECT fact_id, array_to_string(problems, ';') AS problems FROM p WHERE len(problems) > 0""")
def all_problems(spark, sf_dir):
    """Every problem of every fact: a row is taken only without any."""
    say = lambda cond, words: F.when(cond, words)
    p = F.array_compact(F.array(say(F.col("value").isNull(), "value missing"), say(F.col("fiscal_year").isNull(), "year missing"), say(F.trim(F.coalesce("company_normalized", F.lit(""))) == "", "company missing"), say(F.col("unit").isNull() & F.col("source_unit").isNull(), "unit missing")))
    return table(spark, sf_dir, "lagebericht_facts").select("fact_id", p.alias("p")).where(F.size("p") > 0).select("fact_id", F.array_join("p", ";").alias("problems"))


_SLOTS = [("revenue", "STANDARD"), ("cost", "ECONOMY"), ("profit", "PROMO")]


@query(f"""SELECT s.slot, p_partkey, CASE WHEN p_size IS NULL THEN 'no size' WHEN contains(lower(s.slot), 'revenue') AND p_size % 2 = 0 THEN 'wrong basis' ELSE 'ok' END AS verdict
FROM part JOIN (VALUES {', '.join(f"('{a}', '{b}')" for a, b in _SLOTS)}) AS s(slot, word) ON contains(p_type, s.word)""")
def v1_v7_assigned(spark, sf_dir):
    """Verdict on every part assigned to a slot by a word of its type."""
    slots = F.broadcast(spark.createDataFrame(_SLOTS, "slot string, word string"))
    p = table(spark, sf_dir, "part").join(slots, F.contains("p_type", F.col("word")))
    verdict = F.when(F.col("p_size").isNull(), "no size").when(F.contains(F.lower("slot"), F.lit("revenue")) & (F.col("p_size") % 2 == 0), "wrong basis").otherwise("ok")
    return p.select("slot", "p_partkey", verdict.alias("verdict"))


@query(r"""WITH l AS (SELECT doc_id, i - 1 AS row_no, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, ['A. Segmente', coalesce(section, ''), 'Bruttoumsatz', source, 'B. Absatzmärkte', lang] AS l FROM documents))),
k AS (SELECT *, CASE WHEN regexp_matches(lower(line), '(^|\s)(a|i)\.\s*segmente?([^a-z]|$)') THEN 'product' WHEN regexp_matches(lower(line), '(^|\s)(b|ii)\.\s*absatzm[aä]rkte([^a-z]|$)') THEN 'geography' END AS kind FROM l),
s AS (SELECT *, last_value(kind IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY row_no ROWS UNBOUNDED PRECEDING) AS section FROM k)
SELECT doc_id, row_no, line, section FROM s WHERE kind IS NULL AND section IS NOT NULL AND NOT regexp_matches(lower(line), '(brutto|netto)umsatz') AND trim(line, ' ') <> ''""")
def segment_filter(spark, sf_dir):
    """Lines below a segment or market heading, totals left out."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.array(F.lit("A. Segmente"), F.coalesce("section", F.lit("")), F.lit("Bruttoumsatz"), F.col("source"), F.lit("B. Absatzmärkte"), F.col("lang"))).alias("row_no", "line"))
    return segments.section_rows(d, ["doc_id"], ["row_no"], "line").select("doc_id", "row_no", "line", "section")


@query(r"""WITH x AS (SELECT doc_id, '<a href="/' || coalesce(source, 'none') || '">x</a> <a href="https://h.de/' || coalesce(section, 'n') || '#a">y</a><a href="http://o.com/">z</a>' AS html FROM documents),
l AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(html, '(?i)href\s*=\s*["'']([^"''#]+)', 1)) AS l FROM x)
SELECT doc_id, CASE WHEN starts_with(l, '/') THEN 'https://h.de' || l ELSE l END AS link FROM l WHERE starts_with(l, '/') OR starts_with(l, 'https://h.de')""")
def html_links(spark, sf_dir):
    """Links of a page to its own host."""
    d = table(spark, sf_dir, "documents")
    html = F.concat(F.lit('<a href="/'), F.coalesce("source", F.lit("none")), F.lit('">x</a> <a href="https://h.de/'), F.coalesce("section", F.lit("n")), F.lit('#a">y</a><a href="http://o.com/">z</a>'))
    pages = d.select(F.concat(F.lit("https://h.de/"), F.col("doc_id")).alias("url"), html.alias("html"))
    return readers.links(pages, "url", "html").select(F.regexp_extract("url", r"(\d+)$", 1).cast("bigint").alias("doc_id"), "link")


@query("""SELECT company_normalized, table_type, count(*) AS n_tables, CAST(sum(len(rows)) AS BIGINT) AS n_rows, min(page_start) AS first_page, max(page_end) AS last_page FROM extracted_tables WHERE rows IS NOT NULL GROUP BY 1, 2""")
def table_overview(spark, sf_dir):
    """Tables, rows and pages per company and type."""
    t = table(spark, sf_dir, "extracted_tables").where("rows is not null")
    return t.groupBy("company_normalized", "table_type").agg(F.count("*").alias("n_tables"), F.sum(F.size("rows")).alias("n_rows"), F.min("page_start").alias("first_page"), F.max("page_end").alias("last_page"))


@query(rf"""WITH {_CELLS}, n AS (SELECT *, regexp_full_match(text, '-?[0-9]{{1,3}}(\.[0-9]{{3}})*(,[0-9]+)?') AS num FROM cells),
l AS (SELECT table_id, row_no, trim(coalesce(text, ''), ' ') AS label FROM cells WHERE col_no = 0), t AS (SELECT n.table_id, max(n.row_no) AS last FROM n JOIN l USING (table_id, row_no) WHERE label = '' AND col_no > 0 AND num GROUP BY 1)
SELECT c.table_id, c.row_no, c.col_no, coalesce(c.row_no = t.last, false) AS is_total FROM cells c JOIN l USING (table_id, row_no) LEFT JOIN t ON t.table_id = c.table_id""")
def styled_cells(spark, sf_dir):
    """Grand-total rows of the sheets to be written."""
    return sinks.styled_cells(_cells(spark, sf_dir)[1]).select("table_id", "row_no", "col_no", "is_total")
