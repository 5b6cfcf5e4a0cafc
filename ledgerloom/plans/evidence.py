"""Queries of evidence, reviews, pages and stores on the project's tables, each with the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import labels, numbers, text
from ledgerloom.operators import checks, entities, evidence, mapping
from ledgerloom.plans import filings
from ledgerloom.session import table

QUERIES: dict[str, filings.Query] = {}
SQL: dict[str, str] = {}


def query(sql: str):  # noqa: ANN201
    def add(f: filings.Query) -> filings.Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


# One-offs and footnotes -----------------------------------------------------------------------------------------------

_NOTE = "'FY' || fiscal_year || ' reported EBITDA includes a €' || printf('%.1f', abs(value) / 1000000) || 'm stated one-off (' || coalesce(direction, 'unknown') || '): ' || coalesce(sentence, '')"
_STATED = f"""stated AS (SELECT *, {_NOTE} AS note FROM lagebericht_facts WHERE kind = 'one_off' AND value IS NOT NULL AND regexp_matches(lower(unit), '€|eur') AND trim(doc, ' ') <> '' AND trim(sheet, ' ') <> '' AND row_no IS NOT NULL)"""
_REVENUE = """revenue AS (SELECT company_normalized, fiscal_year, CAST(sum(CAST(value AS DECIMAL(30,2))) AS DOUBLE) AS revenue FROM lagebericht_facts WHERE kind = 'operating_result' AND value IS NOT NULL GROUP BY 1, 2)"""
_MATERIAL = f"""{_STATED}, {_REVENUE}, material AS (SELECT s.* FROM stated s LEFT JOIN revenue r ON r.company_normalized = s.company_normalized AND r.fiscal_year = s.fiscal_year WHERE abs(value) >= greatest(1000000.0, coalesce(abs(revenue), 0) * 0.01))"""


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lagebericht_facts")


def _stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _facts(spark, sf_dir).where("kind = 'one_off'")
    note = evidence.reported_footnote(F.col("fiscal_year"), F.col("value"), F.col("direction"), F.col("sentence"))
    return evidence.stated(f, "value", F.lower("unit").rlike("€|eur"), "doc", "sheet", "row_no").withColumn("note", note)


def _material(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["company_normalized", "fiscal_year"]
    revenue = _facts(spark, sf_dir).where("kind = 'operating_result' and value is not null").groupBy(*keys).agg(F.sum(F.col("value").cast("decimal(30,2)")).cast("double").alias("revenue"))
    return evidence.material(_stated(spark, sf_dir), revenue, keys, "value", 0.01, 1e6)


@query(f"WITH {_STATED} SELECT fact_id, doc, sheet, row_no, note FROM stated")
def one_off_evidence(spark, sf_dir):
    """Stated one-offs with provenance and the footnote they call for."""
    return _stated(spark, sf_dir).select("fact_id", "doc", "sheet", "row_no", "note")


@query(f"WITH {_MATERIAL} SELECT fact_id FROM material")
def material_one_offs(spark, sf_dir):
    """One-offs of a million and of a hundredth of the year's result."""
    return _material(spark, sf_dir).select("fact_id")


@query(f"WITH {_MATERIAL}, have AS (SELECT DISTINCT note FROM stated WHERE fact_id % 2 = 0) SELECT fact_id, note FROM material WHERE note NOT IN (SELECT note FROM have)")
def missing_footnotes(spark, sf_dir):
    """Footnotes of material one-offs that are not among those written (here: of every other fact)."""
    have = _stated(spark, sf_dir).where("fact_id % 2 = 0").select("note")
    return checks.untraced(_material(spark, sf_dir), have, ["note"]).select("fact_id", "note")


@query(f"WITH {_STATED}, adjusted AS (SELECT fact_id, doc, sheet, row_no, CASE WHEN fact_id % 3 = 0 THEN value + 1 ELSE -value END AS amount FROM stated) SELECT fact_id FROM adjusted a WHERE NOT EXISTS (SELECT 1 FROM stated s WHERE s.doc = a.doc AND s.sheet = a.sheet AND s.row_no = a.row_no AND abs(s.value) = abs(a.amount))")
def untraced_adjustments(spark, sf_dir):
    """Adjustments (here: every third changed by a euro) that no stated one-off of the same place and amount covers."""
    s = _stated(spark, sf_dir)
    a = s.withColumn("amount", F.when(F.col("fact_id") % 3 == 0, F.col("value") + 1).otherwise(-F.col("value"))).select("fact_id", "provenance", "amount")
    return evidence.untraced_adjustments(a, s, "amount", "value").select("fact_id")


_REQUIRED = ["one_off", "operating_result"]


@query("""WITH r AS (SELECT DISTINCT company_normalized, fiscal_year, kind, doc FROM lagebericht_facts WHERE value IS NOT NULL AND company_normalized IS NOT NULL), w AS (SELECT company_normalized, fiscal_year, k AS kind FROM (SELECT DISTINCT company_normalized, fiscal_year FROM lagebericht_facts WHERE company_normalized IS NOT NULL AND fiscal_year IS NOT NULL), (VALUES ('one_off'), ('operating_result')) AS v(k)),
l AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.company_normalized = w.company_normalized AND r.fiscal_year = w.fiscal_year AND r.kind = w.kind)), own AS (SELECT company_normalized, kind, min(doc) AS d FROM r GROUP BY 1, 2), y AS (SELECT company_normalized, fiscal_year, min(doc) AS d FROM r GROUP BY 1, 2)
SELECT l.company_normalized, l.fiscal_year, l.kind, 'Confirm ' || l.kind || ' is absent from ' || coalesce(own.d, y.d, 'FY' || l.fiscal_year || ' filing') || ', or map it.' AS note FROM l LEFT JOIN own ON own.company_normalized = l.company_normalized AND own.kind = l.kind LEFT JOIN y ON y.company_normalized = l.company_normalized AND y.fiscal_year = l.fiscal_year""")
def required_by_year(spark, sf_dir):
    """Kinds of fact a company's year lacks, with the note that confirms it."""
    f = _facts(spark, sf_dir).where("company_normalized is not null")
    return evidence.required_by_year(f.where("fiscal_year is not null"), f.where("value is not null"), ["company_normalized"], "fiscal_year", "kind", _REQUIRED, "doc")


# Series and profiles --------------------------------------------------------------------------------------------------

_ROW_PROBLEMS = """g AS (SELECT company_normalized, kind, count(DISTINCT coalesce(direction, chr(0))) AS d, count(*) FILTER (WHERE direction IS NULL) AS m FROM lagebericht_facts WHERE company_normalized IS NOT NULL GROUP BY 1, 2),
v AS (SELECT company_normalized, kind, max(n) AS n FROM (SELECT company_normalized, kind, fiscal_year, count(DISTINCT value) AS n FROM lagebericht_facts WHERE value IS NOT NULL AND company_normalized IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


@query(f"""WITH {_ROW_PROBLEMS} SELECT company_normalized, kind, array_to_string(list_filter([CASE WHEN m > 0 THEN 'direction missing' WHEN d > 1 THEN 'direction differs' END, CASE WHEN n > 1 THEN 'values conflict' END], lambda x: x IS NOT NULL), ';') AS problems FROM g LEFT JOIN v USING (company_normalized, kind) WHERE m > 0 OR d > 1 OR n > 1""")
def refused_merges(spark, sf_dir):
    """Lines whose rows cannot be one series: metadata missing or differing, or two values of a year."""
    f = _facts(spark, sf_dir).where("company_normalized is not null")
    return evidence.merged_rows(f, ["company_normalized", "kind"], "fiscal_year", "value", ["direction"])[1].select("company_normalized", "kind", F.array_join("problems", ";").alias("problems"))


@query("""SELECT r.r_name AS slot, n.n_nationkey AS key, coalesce(CASE WHEN r_regionkey % 2 = 0 THEN r_name END, n_name) AS label, n_regionkey AS region FROM region r JOIN nation n ON n.n_nationkey = r.r_regionkey * 3""")
def assigned_series(spark, sf_dir):
    """Nations that a region's slot names; the slot's label counts before the nation's."""
    a = table(spark, sf_dir, "region").select(F.col("r_name").alias("slot"), (F.col("r_regionkey") * 3).alias("key"), F.when(F.col("r_regionkey") % 2 == 0, F.col("r_name")).alias("label"))
    s = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("label"), F.col("n_regionkey").alias("region"))
    return evidence.assigned(a, s, "key", ["label"])


@query("""WITH s AS (SELECT hgb_code AS series, list_distinct([hgb_code, parent_code]) AS ids FROM (SELECT hgb_code, min(parent_code) AS parent_code FROM hgb_taxonomy WHERE hgb_code IS NOT NULL GROUP BY 1)), e AS (SELECT series, unnest(ids) AS hgb_code FROM s) SELECT series, count(*) AS n_labels FROM e JOIN label_synonyms USING (hgb_code) GROUP BY 1""")
def series_labels(spark, sf_dir):
    """Labels of every series, which is a code and its parent."""
    s = table(spark, sf_dir, "hgb_taxonomy").where("hgb_code is not null").groupBy(F.col("hgb_code").alias("series")).agg(F.min("parent_code").alias("p")).select("series", F.array("series", "p").alias("ids"))
    return evidence.series_rows(s, "ids", table(spark, sf_dir, "label_synonyms"), "hgb_code").groupBy("series").agg(F.count("*").alias("n_labels"))


@query("""WITH p AS (SELECT company_normalized, count(DISTINCT fiscal_year) AS n, max(fiscal_year) - min(fiscal_year) + 1 AS span FROM lagebericht_facts WHERE kind = 'operating_result' AND value IS NOT NULL AND company_normalized IS NOT NULL GROUP BY 1), geo AS (SELECT DISTINCT company_normalized FROM extracted_tables WHERE regexp_matches(lower(heading), 'gliederung')),
b AS (SELECT p.*, round(n / span, 6) AS c, geo.company_normalized IS NOT NULL AS g FROM p LEFT JOIN geo USING (company_normalized))
SELECT company_normalized, 'fin.revenue_series' AS block_id, 'top_right' AS slot, 'chart.column_line' AS kind, c AS coverage, CASE WHEN c >= 0.9 THEN 'high' WHEN c >= 0.6 THEN 'medium' ELSE 'low' END AS confidence, n AS n_points FROM b
UNION ALL SELECT company_normalized, 'bo.business_overview_gap', 'top_left', 'bullets', 0.0, 'low', 0 FROM b UNION ALL SELECT company_normalized, 'prod.product_grid_gap', 'bottom_left', 'bullets', 0.0, 'low', 0 FROM b
UNION ALL SELECT company_normalized, CASE WHEN g THEN 'geo.revenue_split_unimplemented' ELSE 'geo.revenue_split_gap' END, 'bottom_right', 'bullets', 0.0, 'low', 0 FROM b""")
def profile_blocks(spark, sf_dir):
    """Blocks of every company's profile, gaps included."""
    p = _facts(spark, sf_dir).where("kind = 'operating_result' and company_normalized is not null")
    geo = table(spark, sf_dir, "extracted_tables").where(F.lower("heading").rlike("gliederung")).select("company_normalized")
    return evidence.profile_blocks(p, "company_normalized", "fiscal_year", "value", geo)


@query("""WITH k AS (SELECT company_normalized, kind, fiscal_year, CAST(value AS DECIMAL(30,2)) AS v FROM lagebericht_facts WHERE value IS NOT NULL AND company_normalized IS NOT NULL), t AS (SELECT DISTINCT company_normalized, kind FROM (SELECT company_normalized, kind, fiscal_year FROM k GROUP BY 1, 2, 3 HAVING count(*) > 1))
SELECT company_normalized, kind, fiscal_year, CAST(round(CAST(v AS DOUBLE)) AS BIGINT) AS euros FROM k WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.company_normalized = k.company_normalized AND t.kind = k.kind)""")
def chart_points(spark, sf_dir):
    """Points of series whose years are unique."""
    k = _facts(spark, sf_dir).where("value is not null and company_normalized is not null").select("company_normalized", "kind", "fiscal_year", F.col("value").cast("decimal(30,2)").cast("double").alias("v"))
    return evidence.chart_points(k, ["company_normalized", "kind"], "fiscal_year", "v").select("company_normalized", "kind", "fiscal_year", F.round(F.col("millions") * 1_000_000).cast("bigint").alias("euros"))


@query("""SELECT company_normalized, CAST(row_number() OVER (PARTITION BY company_normalized ORDER BY first, sheet) AS INT) AS n, sheet FROM (SELECT company_normalized, trim(sheet, ' ') AS sheet, min((fiscal_year, fact_id)) AS first FROM lagebericht_facts WHERE trim(sheet, ' ') <> '' AND fiscal_year IS NOT NULL AND company_normalized IS NOT NULL GROUP BY 1, 2)""")
def source_lines(spark, sf_dir):
    """Sheets a company's facts come from, once each, in the order of years."""
    f = _facts(spark, sf_dir).where("fiscal_year is not null and company_normalized is not null")
    return evidence.ordered_distinct(f, ["company_normalized"], ["fiscal_year", "fact_id"], "sheet")


@query("""SELECT company_normalized, array_to_string(list_sort(list(DISTINCT CASE WHEN source IN ('website', 'press', 'jobs') THEN 'user_supplied' ELSE 'filing' END)), '+') AS kinds, CASE WHEN count(DISTINCT CASE WHEN source IN ('website', 'press', 'jobs') THEN 1 ELSE 2 END) > 1 THEN 'mixed' WHEN max(CASE WHEN source IN ('website', 'press', 'jobs') THEN 1 ELSE 0 END) = 1 THEN 'user_workbook' ELSE 'filings' END AS source_kind FROM documents WHERE source IS NOT NULL GROUP BY 1""")
def source_kinds(spark, sf_dir):
    """Kind of a company's evidence by the kinds of its sources."""
    kind = F.when(F.col("source").isin("website", "press", "jobs"), "user_supplied").otherwise("filing")
    g = table(spark, sf_dir, "documents").where("source is not null").groupBy("company_normalized").agg(F.array_sort(F.collect_set(kind)).alias("k"))
    return g.select("company_normalized", F.array_join("k", "+").alias("kinds"), F.when(F.size("k") > 1, "mixed").when(F.get("k", F.lit(0)) == "filing", "filings").otherwise("user_workbook").alias("source_kind"))


@query("""SELECT company_normalized, CAST(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END + CASE WHEN unit IS NULL AND source_unit IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS open FROM lagebericht_facts WHERE company_normalized IS NOT NULL GROUP BY 1""")
def open_flags(spark, sf_dir):
    """Open problems per company."""
    flags = F.array_compact(F.array(F.when(F.col("value").isNull(), "value"), F.when(F.col("unit").isNull() & F.col("source_unit").isNull(), "unit")))
    return _facts(spark, sf_dir).where("company_normalized is not null").groupBy("company_normalized").agg(F.sum(F.size(flags)).alias("open"))


@query("""SELECT company_normalized FROM lagebericht_facts WHERE company_normalized IS NOT NULL AND kind IS NOT NULL GROUP BY 1 HAVING list_sort(list(DISTINCT kind)) = ['one_off', 'operating_result']""")
def complete_kinds(spark, sf_dir):
    """Companies whose facts are of exactly the required kinds."""
    g = _facts(spark, sf_dir).where("company_normalized is not null and kind is not null").groupBy("company_normalized").agg(F.collect_set("kind").alias("k"))
    want = F.array(*[F.lit(x) for x in _REQUIRED])
    return g.where((F.size(F.array_except("k", want)) == 0) & (F.size(F.array_except(want, F.col("k"))) == 0)).select("company_normalized")


@query("""SELECT company_normalized, fiscal_year, kind, count(DISTINCT coalesce(pnl_line, chr(0))) AS n_lines, count(DISTINCT coalesce(direction, chr(0))) AS n_directions FROM lagebericht_facts GROUP BY 1, 2, 3 HAVING count(DISTINCT coalesce(pnl_line, chr(0))) > 1 OR count(DISTINCT coalesce(direction, chr(0))) > 1""")
def uneven_metadata(spark, sf_dir):
    """Lines whose rows disagree on their metadata."""
    n = lambda c: F.countDistinct(F.coalesce(F.col(c), F.lit("\0")))
    return _facts(spark, sf_dir).groupBy("company_normalized", "fiscal_year", "kind").agg(n("pnl_line").alias("n_lines"), n("direction").alias("n_directions")).where("n_lines > 1 or n_directions > 1")


@query("""SELECT table_id, CASE WHEN lower(pnl_method) IN ('gkv', 'ukv') THEN upper(pnl_method) END AS method_flag FROM extracted_tables""")
def method_flags(spark, sf_dir):
    """Method of a table as a flag, null unless it is known."""
    return table(spark, sf_dir, "extracted_tables").select("table_id", F.when(F.lower("pnl_method").isin("gkv", "ukv"), F.upper("pnl_method")).alias("method_flag"))


# Reviews and corrections ----------------------------------------------------------------------------------------------


@query(f"""WITH d AS (SELECT {filings._KEY.format(c='original_label')} AS key, count(DISTINCT hgb_code) AS n FROM label_synonyms GROUP BY 1), a AS (SELECT alias_id, client, std_id, {filings._KEY.format(c='client_label')} AS key FROM client_aliases WHERE client_label IS NOT NULL AND client IS NOT NULL),
o AS (SELECT a.* FROM a LEFT JOIN d USING (key) WHERE key <> '' AND coalesce(n, 0) <> 1), r AS (SELECT DISTINCT client, key FROM a WHERE trim(coalesce(std_id, ''), ' ') <> '') SELECT client, key, min(alias_id) AS alias_id, count(*) AS n FROM o WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.client = o.client AND r.key = o.key) GROUP BY 1, 2""")
def open_reviews(spark, sf_dir):
    """Labels with no or several codes that no confirmed alias of the same client resolves."""
    a = table(spark, sf_dir, "client_aliases").where("client_label is not null and client is not null").select("alias_id", "client", "std_id", labels.lookup_key(F.col("client_label")).alias("key"))
    d = mapping.synonyms(table(spark, sf_dir, "label_synonyms"), "original_label", "hgb_code")
    unsure = a.join(mapping.small(d), "key", "left").where("key != '' and coalesce(size(candidates), 0) != 1")
    done = a.where("trim(coalesce(std_id, '')) != ''").select("client", "key")
    return checks.untraced(unsure, done, ["client", "key"]).groupBy("client", "key").agg(F.min("alias_id").alias("alias_id"), F.count("*").alias("n"))


@query("""WITH o AS (SELECT company_normalized, heading, arg_max(table_type, (extracted_at, table_id)) AS t FROM extracted_tables WHERE table_id % 3 = 0 AND heading IS NOT NULL AND company_normalized IS NOT NULL GROUP BY 1, 2) SELECT coalesce(o.t, e.table_type) AS table_type, count(*) AS n, count(o.t) AS n_corrected FROM extracted_tables e LEFT JOIN o ON o.company_normalized = e.company_normalized AND o.heading = e.heading GROUP BY 1""")
def corrected_types(spark, sf_dir):
    """Tables per type after the appended corrections of their company's headings, the last one counting."""
    t = table(spark, sf_dir, "extracted_tables")
    o = entities.latest(t.where("table_id % 3 = 0 and heading is not null and company_normalized is not null"), ["company_normalized", "heading"], ["extracted_at", "table_id"]).select("company_normalized", "heading", F.col("table_type").alias("t"))
    return t.join(o, ["company_normalized", "heading"], "left").groupBy(F.coalesce("t", "table_type").alias("table_type")).agg(F.count("*").alias("n"), F.count("t").alias("n_corrected"))


@query("""WITH e AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS era FROM events), f AS (SELECT user_id, max(era) AS era FROM e GROUP BY 1)
SELECT f.user_id, l.value FROM f LEFT JOIN (SELECT user_id, era, arg_max(value, (ts, event_id)) AS value FROM e WHERE event_type <> 'error' AND value IS NOT NULL GROUP BY 1, 2) l ON l.user_id = f.user_id AND l.era = f.era""")
def folded_log(spark, sf_dir):
    """State of every user after the log: the last value since the last error, which resets."""
    e = table(spark, sf_dir, "events")
    return evidence.folded(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", "value")


@query("""WITH t AS (SELECT table_id, company_normalized, heading, CAST(nullif(regexp_extract(doc_label, '((?:19|20)[0-9][0-9])[^0-9]*$', 1), '') AS INT) AS fy, CASE WHEN regexp_matches(lower(doc_label), 'konzernabschluss') THEN 'Konzern' ELSE 'Jahres' END AS kind, filing_id FROM extracted_tables WHERE doc_label IS NOT NULL AND company_normalized IS NOT NULL AND filing_id IS NOT NULL)
SELECT t.table_id, f.filing_id AS matched FROM t JOIN (SELECT company_normalized, fy, kind, min(filing_id) AS filing_id FROM t GROUP BY 1, 2, 3) f ON f.company_normalized = t.company_normalized AND f.fy = t.fy AND f.kind = t.kind""")
def filing_rematch(spark, sf_dir):
    """First filing of a company's year and kind, for every table."""
    t = table(spark, sf_dir, "extracted_tables").where("doc_label is not null and company_normalized is not null and filing_id is not null")
    t = t.select("table_id", "company_normalized", "filing_id", numbers.end_year(F.col("doc_label")).alias("fy"), labels.document_type(F.regexp_replace("doc_label", "Jahresabschluss", "")).alias("kind"))
    first = t.groupBy("company_normalized", "fy", "kind").agg(F.min("filing_id").alias("matched"))
    return t.join(first, ["company_normalized", "fy", "kind"]).select("table_id", "matched")


@query("""SELECT fact_id, sheet FROM lagebericht_facts WHERE split_part(sheet, '_', 2) IN ('Vermögenslage', 'Finanzlage')""")
def permitted_facts(spark, sf_dir):
    """Facts of sheets whose kind may state them."""
    allowed = spark.createDataFrame([("Vermögenslage",), ("Finanzlage",)], "kind string")
    f = _facts(spark, sf_dir).select("fact_id", "sheet", F.split_part("sheet", F.lit("_"), F.lit(2)).alias("kind"))
    return f.join(F.broadcast(allowed), "kind", "left_semi").select("fact_id", "sheet")


# Pages, pictures, register rows ---------------------------------------------------------------------------------------

_SIGNALS = {
    "erp_migration": r"(^|[^\p{L}\p{N}])(sap\s*)?s/?4(hana)?([^\p{L}\p{N}]|$)|erp[- ]?(migration|einführung)", "procurement": r"(einkauf|procurement).{0,80}(zentral|central|bündel)|(zentral|central|bündel).{0,80}(einkauf|procurement)",
    "finance_rebuild": r"(finance|finanz|controlling).{0,100}(aufbau|transform|neu auf|rebuild)", "restructuring": r"(^|[^\p{L}])(interim|restruktur|turnaround|sanierung)", "new_position": r"neu geschaffenen?r? position",
}


@query("WITH t AS (SELECT doc_id, lower(text) || CASE WHEN source = 'jobs' THEN CASE doc_id % 3 WHEN 0 THEN ' einführung von s/4hana.' WHEN 1 THEN ' eine neu geschaffene position.' ELSE ' einkauf wird zentral geführt.' END ELSE '' END AS t FROM documents WHERE text IS NOT NULL AND source IS NOT NULL) SELECT doc_id, kind FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind FROM t WHERE regexp_matches(t, '{p}')" for k, p in _SIGNALS.items()) + ")")
def job_signals(spark, sf_dir):
    """Signals of change that texts give; job texts get a sentence that holds one."""
    planted = F.when(F.col("source") == "jobs", F.when(F.col("doc_id") % 3 == 0, " einführung von s/4hana.").when(F.col("doc_id") % 3 == 1, " eine neu geschaffene position.").otherwise(" einkauf wird zentral geführt.")).otherwise("")
    t = table(spark, sf_dir, "documents").where("text is not null and source is not null").select("doc_id", F.concat(F.lower("text"), planted).alias("t"))
    return t.select("doc_id", F.explode(F.array_compact(F.array(*[F.when(F.col("t").rlike(p), F.lit(k)) for k, p in _SIGNALS.items()]))).alias("kind"))


@query(r"""WITH s AS (SELECT doc_id, trim(regexp_replace(unnest(regexp_split_to_array(text, '[\n.;]')), '\s+', ' ', 'g'), ' ,:-') AS c FROM documents WHERE text IS NOT NULL) SELECT doc_id, count(DISTINCT c) AS n_candidates, min(c) AS first FROM s WHERE regexp_matches(c, '(^|[^\p{L}])(GmbH|AG|KG|SE|OHG|eG|UG)($|[^\p{L}])') GROUP BY 1""")
def entity_candidates(spark, sf_dir):
    """Fragments of texts that bear a legal form."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.explode(text.entity_candidates(F.col("text"))).alias("c"))
    return d.groupBy("doc_id").agg(F.countDistinct("c").alias("n_candidates"), F.min("c").alias("first"))


@query("""WITH m AS (SELECT vec_id, embedding[1:64] AS e FROM embeddings), b AS (SELECT vec_id, array_to_string(list_transform(e, lambda x: CASE WHEN CAST(x AS DOUBLE) >= list_sum(list_transform(e, lambda y: CAST(y AS DOUBLE))) / 64 THEN '1' ELSE '0' END), '') AS bits FROM m)
SELECT vec_id, lower(array_to_string(list_transform(range(0, 16), lambda i: substr('0123456789abcdef', CAST(CAST(substr(bits, CAST(i * 4 + 1 AS BIGINT), 1) AS INT) * 8 + CAST(substr(bits, CAST(i * 4 + 2 AS BIGINT), 1) AS INT) * 4 + CAST(substr(bits, CAST(i * 4 + 3 AS BIGINT), 1) AS INT) * 2 + CAST(substr(bits, CAST(i * 4 + 4 AS BIGINT), 1) AS INT) + 1 AS BIGINT), 1)), '')) AS hash FROM b""")
def average_hashes(spark, sf_dir):
    """Average hash of every vector read as an eight by eight picture."""
    return table(spark, sf_dir, "embeddings").select("vec_id", evidence.average_hash(F.col("embedding")).alias("hash"))


@query(r"""SELECT original_label, CAST(nullif(regexp_extract(original_label, '^\s*(\d+)', 1), '') AS INT) AS number FROM label_synonyms""")
def leading_numbers(spark, sf_dir):
    """Number a label begins with."""
    return table(spark, sf_dir, "label_synonyms").select("original_label", numbers.leading_number(F.col("original_label")).alias("number"))


@query(r"""SELECT table_id, CASE WHEN regexp_matches(lower(doc_label), 'konzernabschluss') THEN 'Konzern' ELSE 'Jahres' END AS kind, CAST(nullif(regexp_extract(doc_label, '((?:19|20)\d\d)\D*$', 1), '') AS INT) AS fiscal_year FROM extracted_tables WHERE regexp_matches(lower(doc_label), 'abschluss|bericht') AND NOT regexp_matches(lower(heading), 'berichtig|änderung')""")
def register_results(spark, sf_dir):
    """Result rows of the register that are filings: amendments out, fields read from the title."""
    from ledgerloom.sources import readers

    t = table(spark, sf_dir, "extracted_tables")
    return readers.register_results(t, "doc_label", "heading").select("table_id", labels.document_type(F.regexp_replace("doc_label", "Jahresabschluss", "")).alias("kind"), numbers.end_year(F.col("doc_label")).alias("fiscal_year"))


@query(rf"""WITH {filings._CELLS}, w AS (SELECT table_id, CAST(round_even((row_no * 6 + col_no % 2) / 3.0, 0) AS INT) AS line, col_no, text FROM cells WHERE text IS NOT NULL AND text <> ''), g AS (SELECT table_id, line, array_to_string(list(text ORDER BY col_no, text), '|') AS cells, count(*) AS n FROM w GROUP BY 1, 2), p AS (SELECT table_id, count(*) AS lines, max(n) AS widest FROM g GROUP BY 1)
SELECT table_id, line, cells FROM g JOIN p USING (table_id) WHERE lines >= 2 AND widest >= 2""")
def rows_of_words(spark, sf_dir):
    """Lines rebuilt from placed words (here: the cells at heights that differ a little)."""
    from ledgerloom.operators import tables

    w = tables.cells(table(spark, sf_dir, "extracted_tables")).where("text is not null and text != ''").select("table_id", (F.col("row_no") * 6 + F.col("col_no") % 2).cast("double").alias("top"), F.col("col_no").alias("x0"), F.col("text").alias("word"))
    return evidence.rows_of_words(w, "table_id", "top", "x0", "word").select("table_id", "line", F.array_join("cells", "|").alias("cells"))


@query("""SELECT company_normalized, lang, arg_max(doc_id, (published_at, doc_id)) AS doc_id FROM documents WHERE published_at IS NOT NULL GROUP BY 1, 2""")
def unique_last_wins(spark, sf_dir):
    """The last document of every company and language."""
    return entities.latest(table(spark, sf_dir, "documents").where("published_at is not null"), ["company_normalized", "lang"], ["published_at", "doc_id"]).select("company_normalized", "lang", "doc_id")


@query("""WITH p AS (SELECT company_normalized, fiscal_year, fact_id, CASE WHEN coalesce(trim(doc, ' ') = '', true) OR coalesce(kind NOT IN ('one_off', 'operating_result'), true) OR coalesce(value IS NULL, true) OR coalesce(direction NOT IN ('income', 'expense', 'unknown'), false) THEN 1 ELSE 0 END AS bad FROM lagebericht_facts WHERE company_normalized IS NOT NULL AND fiscal_year IS NOT NULL)
SELECT company_normalized, fiscal_year, count(*) AS n FROM p GROUP BY 1, 2 HAVING sum(bad) = 0""")
def accepted_years(spark, sf_dir):
    """Years of a company whose rows are taken, since none has a problem (required field, known kind, number, enumerated direction)."""
    f = _facts(spark, sf_dir).where("company_normalized is not null and fiscal_year is not null")
    tests = [
        (F.trim("doc") == "", "document missing"), (~F.col("kind").isin(*_REQUIRED), "unknown kind"), (F.col("value").isNull(), "no number"),
        (F.coalesce(~F.col("direction").isin("income", "expense", "unknown"), F.lit(False)), "unknown direction"),
    ]
    keys = ["company_normalized", "fiscal_year"]
    return checks.accepted_whole(checks.with_problems(f, tests), keys).groupBy(*keys).agg(F.count("*").alias("n"))


@query("""SELECT sheet, count(*) AS n, string_agg(sheet || ' row ' || row_no || ': ' || note_text, chr(10) ORDER BY row_no, note_id) AS notes FROM sheet_notes WHERE sheet IS NOT NULL AND note_text IS NOT NULL GROUP BY 1""")
def sheet_remarks(spark, sf_dir):
    """Remarks of every sheet as lines of text."""
    n = table(spark, sf_dir, "sheet_notes").where("sheet is not null and note_text is not null")
    line = F.concat("sheet", F.lit(" row "), F.col("row_no").cast("string"), F.lit(": "), "note_text")
    return n.groupBy("sheet").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "note_id", line.alias("l")))), lambda x: x["l"]), "\n").alias("notes"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
