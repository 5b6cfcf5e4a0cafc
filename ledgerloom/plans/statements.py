"""Queries of statements, segments and prose on the project's tables, with the SQL they must equal where SQL has a form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import labels, numbers, text
from ledgerloom.operators import segments, series, statements, tables
from ledgerloom.plans import filings
from ledgerloom.session import table

QUERIES: dict[str, filings.Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f: filings.Query) -> filings.Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# Classes and methods --------------------------------------------------------------------------------------------------

_BODY = "lower(array_to_string(list_transform(flatten(coalesce(rows, [])[1:{n}]), lambda c: coalesce(c, '')), ' '))"
_FIRST = "lower(array_to_string(list_transform(coalesce(rows, [])[{a}:{n}], lambda r: coalesce(r[1], '')), ' '))"


def _class_sql() -> str:
    def test(where: str, pattern: str, unless: str | None) -> str:
        return f"regexp_matches({where}, '{pattern}')" + (f" AND NOT regexp_matches({where}, '{unless}')" if unless else "")

    return "CASE " + " ".join(f"WHEN {test(w, p, u)} THEN {n}" for w, p, u, n in statements.CLASS_RULES) + f" ELSE {statements.OTHER} END"


_CLASSED = f"""classed AS (SELECT table_id, {_class_sql()} AS table_class FROM (SELECT table_id, lower(coalesce(heading, '')) AS heading, {_BODY.format(n=20)} AS body, {_FIRST.format(a=1, n=8)} AS first FROM extracted_tables))"""


@query(f"WITH {_CLASSED} SELECT table_id, table_class FROM classed")
def table_classes(spark, sf_dir):
    """Statement class of every table by its heading and its rows."""
    return statements.table_classes(table(spark, sf_dir, "extracted_tables"), ["table_id"], "heading", "rows")


@query("""WITH n AS (SELECT doc_id, lower(text) AS t, 'x' AS k FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN regexp_matches(t, 'kapitalfluss|cashflow') THEN CASE WHEN regexp_matches(t, 'konzern|konsolidiert') THEN 'Konzern-Kapitalflussrechnung' ELSE 'Kapitalflussrechnung' END
 WHEN regexp_matches(t, 'gewinn|verlust|umsatzerl') THEN CASE WHEN regexp_matches(t, 'konzern|konsolidiert') THEN 'Konzern-Gesamtergebnisrechnung' ELSE 'Gewinn- und Verlustrechnung' END
 WHEN regexp_matches(t, 'bilanz|aktiva|passiva') THEN CASE WHEN regexp_matches(t, 'konzern|konsolidiert') THEN 'Konzernbilanz' ELSE 'Bilanz' END ELSE '' END AS name FROM n""")
def statement_names(spark, sf_dir):
    """Name of the statement a text speaks of, as rows of one cell."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", statements.statement_name(F.array(F.array("text"))).alias("name"))


def _hits(lines: tuple[str, ...]) -> str:
    return " + ".join(f"CASE WHEN contains(labels, '{x}') THEN 1 ELSE 0 END" for x in lines)


_AS_TABLES = """grids AS (SELECT company_normalized, doc_id, list_transform(list_concat(list_prepend('head', string_split(text, '. ')), CASE lang WHEN 'de' THEN ['Materialaufwand', 'Personalaufwand'] WHEN 'en' THEN ['Umsatzkosten', 'Vertriebskosten'] ELSE [] END), lambda s: [s]) AS rows FROM documents WHERE text IS NOT NULL AND company_normalized IS NOT NULL)"""


@query(f"""WITH {_AS_TABLES}, big AS (SELECT company_normalized, doc_id, {_FIRST.format(a=2, n=10_000)} AS labels FROM (SELECT *, row_number() OVER (PARTITION BY company_normalized ORDER BY len(rows) DESC, doc_id) AS k FROM grids) WHERE k = 1),
h AS (SELECT company_normalized, doc_id, {_hits(statements.GKV_LINES)} AS g, {_hits(statements.UKV_LINES)} AS u FROM big)
SELECT company_normalized, doc_id, CASE WHEN g >= 2 AND u < 2 THEN 'gkv' ELSE 'ukv' END AS pnl_method FROM h WHERE (g >= 2 AND u < 2) OR (u >= 2 AND g < 2)""")
def method_signature(spark, sf_dir):
    """Method that the lines of a company's longest text give away, its sentences taken as rows, two lines planted by language."""
    planted = F.when(F.col("lang") == "de", F.array(F.lit("Materialaufwand"), F.lit("Personalaufwand"))).when(F.col("lang") == "en", F.array(F.lit("Umsatzkosten"), F.lit("Vertriebskosten"))).otherwise(F.array().cast("array<string>"))
    d = table(spark, sf_dir, "documents").where("text is not null and company_normalized is not null")
    grids = d.select("company_normalized", "doc_id", F.concat(F.array(F.array(F.lit("head"))), F.transform(F.concat(F.split("text", r"\. "), planted), lambda s: F.array(s))).alias("rows"))
    return statements.method_by_signature(grids, ["company_normalized"], "doc_id", "rows")


@query()
def statement_splits(spark, sf_dir):
    """Parts of tables that hold two statements (the cut depends on what was met before: tested on worked cases)."""
    return statements.split_statements(table(spark, sf_dir, "extracted_tables"), "table_id", "rows")


# Consolidation --------------------------------------------------------------------------------------------------------

_GROUP = ["company", "table_class", "framework", "pnl_method"]


def _grouped_actuals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Kept actuals and dropped ones of every company, class, framework and method."""
    t = table(spark, sf_dir, "extracted_tables").withColumn("framework", F.col("framework"))
    groups = statements.statement_groups(t, F.col("table_type")).select("table_id", F.col("company_normalized").alias("company"), "table_class", "framework", "pnl_method")
    kept, _ = tables.within_table(filings._coded(spark, sf_dir))
    return tables.across_tables(kept.join(groups, "table_id"), _GROUP)


_GROUPED = f"""{filings._CELLS}, {filings._NUMERIC}, {filings._BLOCKS}, {filings._VALUES}, {filings._CODED},
kept AS (SELECT table_id, year, std_id, arg_min(label, row_no) AS label, arg_min(value, row_no) AS value, min(row_no) AS row_no, arg_min(priority, row_no) AS priority FROM coded GROUP BY 1, 2, 3 HAVING count(DISTINCT label) = 1),
named AS (SELECT k.*, t.company_normalized AS company, t.table_type AS table_class, lower(coalesce(t.framework, 'unknown')) AS framework, lower(coalesce(t.pnl_method, 'unknown')) AS pnl_method FROM kept k JOIN extracted_tables t USING (table_id) WHERE t.table_type <> 99),
best AS (SELECT * FROM (SELECT *, min(priority) OVER (PARTITION BY company, table_class, framework, pnl_method, year, std_id) AS top FROM named) WHERE priority = top),
g AS (SELECT company, table_class, framework, pnl_method, year, std_id, count(DISTINCT label) AS nl, count(DISTINCT table_id) AS nt, count(*) AS n, arg_min(value, table_id) AS value, arg_min(label, table_id) AS label, min(value) AS lo, max(value) AS hi FROM best GROUP BY 1, 2, 3, 4, 5, 6),
ok AS (SELECT * FROM g WHERE nl = 1 OR (nt = n AND abs(lo - hi) <= greatest(1e-9 * greatest(abs(lo), abs(hi)), 0.01)))"""


@query(f"""WITH {_GROUPED}, years AS (SELECT company, table_class, framework, pnl_method FROM ok GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT year) >= 2)
SELECT company, table_class, framework, pnl_method, year, std_id, label, CAST(round(value * 100) AS BIGINT) AS cents FROM ok JOIN years USING (company, table_class, framework, pnl_method)""")
def consolidated_groups(spark, sf_dir):
    """One amount per statement group, year and code; groups of a single year and unclassed tables are left out."""
    ok, _ = _grouped_actuals(spark, sf_dir)
    return statements.at_least_years(ok, _GROUP, "year").select(*_GROUP, "year", "std_id", "label", F.round(F.col("value") * 100).cast("bigint").alias("cents"))


@query(f"""WITH {_GROUPED}, s AS (SELECT company, table_class, count(*) FILTER (WHERE starts_with(std_id, 'AKT')) AS a, count(*) FILTER (WHERE starts_with(std_id, 'PAS')) AS b FROM ok GROUP BY 1, 2) SELECT company, table_class, CASE WHEN a > b THEN 'AKT' ELSE 'PAS' END AS side FROM s WHERE a <> b""")
def dominant_sides(spark, sf_dir):
    """Side of the balance sheet most of a company's consolidated codes of a class stand on."""
    return statements.dominant_side(_grouped_actuals(spark, sf_dir)[0], ["company", "table_class"], "std_id", ("AKT", "PAS"))


@query(f"""WITH {_GROUPED} SELECT company, max(year) AS filing_year, count(DISTINCT year) AS n_years FROM ok GROUP BY 1""")
def filing_years(spark, sf_dir):
    """Current fiscal year of a company's consolidated tables."""
    return _grouped_actuals(spark, sf_dir)[0].groupBy("company").agg(F.max("year").alias("filing_year"), F.countDistinct("year").alias("n_years"))


@query(f"""WITH {_GROUPED}, l AS (SELECT company, table_class, framework, pnl_method, std_id, year, value, lag(value) OVER w AS prev, lag(year) OVER w AS prev_year, row_number() OVER (PARTITION BY company, table_class, framework, pnl_method, std_id ORDER BY year DESC) AS k FROM ok WINDOW w AS (PARTITION BY company, table_class, framework, pnl_method, std_id ORDER BY year))
SELECT company, table_class, framework, pnl_method, std_id, year, prev_year, CAST(round((value - prev) / abs(prev) * 10000) AS BIGINT) AS growth_bp FROM l WHERE k = 1 AND prev IS NOT NULL AND prev <> 0""")
def last_two_points(spark, sf_dir):
    """Growth between the last two points of every series, whatever years lie between."""
    return series.last_growth(_grouped_actuals(spark, sf_dir)[0], [*_GROUP, "std_id"], "year", "value").select(*_GROUP, "std_id", "year", "prev_year", F.round(F.col("growth") * 10000).cast("bigint").alias("growth_bp"))


@query(f"""WITH {_GROUPED} SELECT company, year, count(DISTINCT std_id) AS n_codes, count(*) AS n, CAST(round(sum(value)) AS BIGINT) AS total FROM ok GROUP BY CUBE (company, year) HAVING NOT (company IS NULL AND year IS NULL)""")
def actuals_overview(spark, sf_dir):
    """Codes and totals by company, by year and by both."""
    ok, _ = _grouped_actuals(spark, sf_dir)
    g = ok.cube("company", "year").agg(F.countDistinct("std_id").alias("n_codes"), F.count("*").alias("n"), F.round(F.sum("value")).cast("bigint").alias("total"))
    return g.where("not (company is null and year is null)")


@query(f"""WITH {_GROUPED}, d AS (SELECT DISTINCT label, year, company FROM ok) SELECT company, year, count(*) AS n_labels, min(label) AS first_label FROM d GROUP BY 1, 2""")
def audit_rows(spark, sf_dir):
    """Distinct labels per company and year that an audit lists."""
    d = _grouped_actuals(spark, sf_dir)[0].select("label", "year", "company").distinct()
    return d.groupBy("company", "year").agg(F.count("*").alias("n_labels"), F.min("label").alias("first_label"))


@query(f"""WITH {_GROUPED}, t AS (SELECT company_normalized AS company, table_type AS table_class, table_id, lower(coalesce(framework, 'unknown')) AS framework, lower(coalesce(pnl_method, 'unknown')) AS pnl_method, doc_label FROM extracted_tables)
SELECT ok.company, ok.table_class, ok.framework, ok.pnl_method, ok.year, ok.std_id, f.table_id, f.doc_label FROM ok JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company, table_class, framework, pnl_method ORDER BY table_id) AS k FROM t) WHERE k = 1) f USING (company, table_class, framework, pnl_method)""")
def audit_sources(spark, sf_dir):
    """Document of the first table of its group for every consolidated cell."""
    t = table(spark, sf_dir, "extracted_tables")
    sources = statements.statement_groups(t, F.col("table_type")).select(F.col("company_normalized").alias("company"), "table_class", "framework", "pnl_method", "table_id", "doc_label")
    first = series.first_by_key(sources, _GROUP, ["table_id"])
    return _grouped_actuals(spark, sf_dir)[0].drop("table_id").join(first, _GROUP).select(*_GROUP, "year", "std_id", "table_id", "doc_label")


# Prose ----------------------------------------------------------------------------------------------------------------


@query(r"""WITH l AS (SELECT doc_id, i - 1 AS row_no, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))),
c AS (SELECT *, trim(regexp_replace(trim(line, ' '), '\s+', ' ', 'g'), ' ') AS t FROM l), b AS (SELECT *, regexp_replace(lower(t), '^([a-zäöü]\.|\d+(\.\d+)*\.?)\s+', '') AS bare, regexp_matches(lower(t), '^([a-zäöü]\.|\d+(\.\d+)*\.?)\s+\D') AS numbered FROM c)
SELECT doc_id, row_no, CASE WHEN regexp_full_match(bare, 'ertragslage') THEN 'Ertragslage' WHEN regexp_full_match(bare, 'vermögens(lage|-\s+und\s+finanzlage)') THEN 'Vermögenslage' WHEN regexp_full_match(bare, 'nachtragsbericht|ereignisse?\s+nach\s+(dem\s+)?bilanzstichtag') THEN 'Nachtragsbericht'
 WHEN regexp_full_match(bare, 'chancen\s*([-–]\s*und\s*)?risikobericht|risiko\s*([-–]\s*und\s*)?chancenbericht') THEN 'Chancen- und Risikobericht' WHEN numbered AND NOT regexp_matches(t, '\s[-+]?\d[\d.,]*\s*$') AND length(t) <= 100 THEN 'Unknown section: ' || t END AS title
FROM b WHERE title IS NOT NULL""")
def section_titles(spark, sf_dir):
    """Lines that are titles of sections of a report."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("row_no", "line"))
    return d.select("doc_id", "row_no", statements.section_title(F.col("line")).alias("title")).where("title is not null")


@query()
def sectioned_paragraphs(spark, sf_dir):
    """Paragraphs below section titles (tested on worked cases)."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("row_no", "line"))
    return statements.sectioned_lines(d, ["doc_id"], "row_no", "line")


_FACT_UNIT = "CASE WHEN regexp_matches(lower(s), 't€|teur|teuro|t euro') THEN 'TEUR' WHEN regexp_matches(lower(s), '€|eur') THEN 'EUR' END"


@query(rf"""WITH {filings._SENTENCES.replace("doc_id, trim(s, ' ') AS sentence, source_text", "doc_id, trim(s, ' ') AS s, source_text").replace("WHERE trim(s, ' ') <> ''", "WHERE trim(s, ' ') <> ''")},
n AS (SELECT doc_id, s, trim(regexp_replace(regexp_extract(s, '([A-ZÄÖÜ][\p{{L}}\p{{N}}_&.\- ]{{2,}}?(GmbH|AG|KG|SE|Ltd\.))', 1), '^(Die|Der|Das)\s+', ''), ' ') AS entity FROM sent WHERE regexp_matches(lower(s), 'konsolidierungskreis|erstkonsolid|entkonsolid'))
SELECT doc_id, nullif(entity, '') AS entity, count(*) AS n FROM n GROUP BY 1, 2""")
def scope_entities(spark, sf_dir):
    """Companies that sentences about the scope of consolidation name."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.explode(text.sentences(F.col("text"))).alias("s"))
    d = d.where(F.lower("s").rlike("konsolidierungskreis|erstkonsolid|entkonsolid"))
    return d.select("doc_id", text.entity(F.col("s")).alias("entity")).groupBy("doc_id", "entity").agg(F.count("*").alias("n"))


@query(rf"""WITH {filings._SENTENCES.replace("doc_id, trim(s, ' ') AS sentence, source_text", "doc_id, trim(s, ' ') AS s, source_text")},
n AS (SELECT doc_id, trim(regexp_extract(s, '(?i)(^|[^\p{{L}}])(segment|sparte|bereich|division|geschäftsfeld|marke)\s+["„]?(.+?)(\s+(ging|stieg|sank|fiel|reduzierte|wuchs|entwickelte|entfielen)($|[^\p{{L}}])|[,.;:()])', 3), ' "„“') AS segment FROM sent)
SELECT segment, count(*) AS n FROM n WHERE segment <> '' GROUP BY 1""")
def stated_segments(spark, sf_dir):
    """Segments and divisions that sentences name."""
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.explode(text.sentences(F.col("text"))).alias("s"))
    return d.select(text.segment(F.col("s")).alias("segment")).where("segment is not null").groupBy("segment").agg(F.count("*").alias("n"))


@query()
def prose_facts(spark, sf_dir):
    """Every fact the sentences of all texts state, with its amounts, unit, direction and line (one row per fact; tested on worked cases)."""
    d = table(spark, sf_dir, "documents").where("text is not null").withColumn("sheet", F.concat(F.lit("FY"), F.coalesce(F.col("fiscal_year").cast("string"), F.lit(""))))
    return segments.fact_sentences(d, ["doc_id"], "text", "sheet")


# Segment sheets -------------------------------------------------------------------------------------------------------


@query()
def segment_figures(spark, sf_dir):
    """Figures of tables that carry segment or market headings, one vintage each, conflicts left out (tested on worked cases)."""
    return segments.segment_figures(table(spark, sf_dir, "extracted_tables"), "table_id", "doc_label", "rows")[0]


@query(rf"""WITH {filings._CELLS}, u AS (SELECT table_id, col_no, lower(string_agg(coalesce(text, ''), ' ' ORDER BY row_no)) AS t FROM cells WHERE row_no < 12 GROUP BY 1, 2)
SELECT table_id, col_no, CASE WHEN regexp_matches(t, '%|prozent') THEN 'PCT' WHEN regexp_matches(t, 't€|teur|teuro|tsd\.') THEN 'EUR' WHEN regexp_matches(t, '€|eur') THEN 'EUR' END AS unit, regexp_matches(t, 't€|teur|teuro|tsd\.') AS thousands FROM u WHERE col_no > 0""")
def column_units(spark, sf_dir):
    """Unit of every value column by the text of its first twelve rows."""
    return segments.column_units(tables.cells(table(spark, sf_dir, "extracted_tables")), ["table_id"]).where("col_no > 0")


@query(rf"""WITH {filings._CELLS}, h AS (SELECT table_id, unnest(regexp_extract_all(text, '(19|20)[0-9][0-9]')) AS y FROM cells WHERE row_no < 10 AND col_no > 0 AND regexp_full_match(trim(text, ' '), '(19|20)[0-9][0-9]'))
SELECT table_id, array_to_string(list_sort(list(DISTINCT CAST(y AS INT))), ',') AS years FROM h GROUP BY 1""")
def header_years(spark, sf_dir):
    """Distinct fiscal years of every table's header."""
    c = tables.cells(table(spark, sf_dir, "extracted_tables")).where("row_no < 10 and col_no > 0")
    y = c.withColumn("y", F.when(F.trim("text").rlike(r"^(19|20)\d\d$"), numbers.max_year(F.col("text")))).where("y is not null")
    return y.groupBy("table_id").agg(F.array_join(F.array_sort(F.collect_set("y")), ",").alias("years"))


# Numbers and labels ---------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, CASE WHEN v < 0 THEN '(' || printf('%.1f', abs(v)) || ')' ELSE printf('%.1f', abs(v)) END AS shown FROM (SELECT o_orderkey, round(CAST(o_totalprice AS DOUBLE) / 1e3 - 100, 1) AS v FROM orders)""")
def shown_amounts(spark, sf_dir):
    """Amounts in thousands as a statement shows them, negative ones in brackets."""
    v = F.round(F.col("o_totalprice").cast("double") / 1e3 - 100, 1)
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.shown(v, 1).alias("shown"))


@query(r"""SELECT table_id, CAST(nullif(regexp_extract(doc_label, '(?:19|20)\d\d'), '') AS INT) AS start_year, CAST(nullif(regexp_extract(doc_label, '((?:19|20)\d\d)\D*$', 1), '') AS INT) AS end_year FROM extracted_tables""")
def fiscal_year_ranges(spark, sf_dir):
    """First and last year a document's label names."""
    t = table(spark, sf_dir, "extracted_tables")
    return t.select("table_id", numbers.start_year(F.col("doc_label")).alias("start_year"), numbers.end_year(F.col("doc_label")).alias("end_year"))


@query(rf"""WITH {filings._CELLS}, l AS (SELECT table_id, row_no, trim(coalesce(max(CASE WHEN col_no = 0 THEN text END), ''), ' ') AS label, count(*) FILTER (WHERE col_no > 0 AND trim(coalesce(text, ''), ' ') <> '') AS n FROM cells GROUP BY 1, 2)
SELECT table_id, row_no, CASE WHEN n = 0 THEN 'section_header' WHEN label = '' OR regexp_matches(lower(label), '^(summe|gesamt|bilanzsumme|zwischensumme)') THEN 'subtotal' ELSE 'line_item' END AS display FROM l""")
def row_display(spark, sf_dir):
    """Subtotal, section header or line item, for every row."""
    c = tables.cells(table(spark, sf_dir, "extracted_tables"))
    filled = (F.col("col_no") > 0) & (F.trim(F.coalesce("text", F.lit(""))) != "")
    g = c.groupBy("table_id", "row_no").agg(F.trim(F.coalesce(F.max(F.when(F.col("col_no") == 0, F.col("text"))), F.lit(""))).alias("label"), F.count_if(filled).alias("n"))
    return g.select("table_id", "row_no", labels.row_display(F.col("label"), F.col("n")).alias("display"))


@query("""SELECT sheet_name, table_id FROM (SELECT table_id, substr(coalesce(nullif(regexp_replace(coalesce(heading, ''), '[\\[\\]:*?/\\\\]', '_', 'g'), ''), 'Table'), 1, 27) || CASE WHEN row_number() OVER w = 1 THEN '' ELSE '_' || row_number() OVER w END AS sheet_name FROM extracted_tables WINDOW w AS (PARTITION BY company_normalized, lower(substr(coalesce(nullif(regexp_replace(coalesce(heading, ''), '[\\[\\]:*?/\\\\]', '_', 'g'), ''), 'Table'), 1, 27)) ORDER BY table_id))""")
def sheet_names(spark, sf_dir):
    """Unique sheet names of a company's workbook, at most 31 characters."""
    from ledgerloom.sources import sinks

    return sinks.sheet_names(table(spark, sf_dir, "extracted_tables"), ["company_normalized"], "heading", "table_id").select("sheet_name", "table_id")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
