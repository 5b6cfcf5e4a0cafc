"""Statements inside tables: classes, names, methods, splits; consolidation groups; sections of prose.

A table stays one row: its text is built by higher-order functions over the
grid, so no cell is exploded to classify it.

Defined results: null grids and cells count as empty text; a table without any
proof is class 99; a null framework or method is ``unknown``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Word borders in a form that both regular expression engines read alike; they take up a character.
_L, _R = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
OTHER, BALANCE, INCOME, CASH = 99, 0, 1, 2
# What proves a class, in order of precedence: where it is looked for, the pattern, an exception, the class.
CLASS_RULES = (
    ("first", rf"(^|\s)(a|i)\.\s*segmente?{_R}|(^|\s)(b|ii)\.\s*absatzm(a|ä)rkte{_R}", None, OTHER),
    ("heading", rf"{_L}eigenkapital(veränder|spiegel|entwickl)", None, OTHER),
    ("heading", rf"{_L}(vermögenslage|finanzlage|ertragslage){_R}", None, OTHER),
    ("heading", rf"kapitalfluss|cashflow|cash\s*flow|{_L}zahlungsstr[öo]me{_R}", None, CASH),
    ("heading", rf"{_L}(konzernbilanz|jahresbilanz|bilanzsumme){_R}", None, BALANCE),
    ("heading", rf"{_L}bilanz{_R}", rf"{_L}erläuterung", BALANCE),
    ("heading", rf"{_L}(gewinn.*verlust|ergebnisrechnung|gesamtergebnisrechnung){_R}", None, INCOME),
    ("body", rf"{_L}(aktiva|passiva|bilanzsumme|anlagevermögen|summe\s+passiva|eigenkapital){_R}", None, BALANCE),
    ("body", rf"kapitalfluss|cashflow|{_L}(finanzmittelfonds|zahlungsmittel|finanzierungstätigkeit|investitionstätigkeit|ertragsteuerzahlung){_R}|{_L}zahlungsunwirksam", None, CASH),
    ("body", rf"{_L}(umsatzerlöse?|umsatzkosten|jahresüberschuss|jahresfehlbetrag|ebitda|ebit|gewinn){_R}|{_L}verlust($|[^\p{{L}}\p{{N}}_\-])", None, INCOME),
)
# The name a statement gets from its rows, and its form in a group's filing.
NAMES = (("kapitalfluss|cashflow", "Kapitalflussrechnung", "Konzern-Kapitalflussrechnung"), ("gewinn|verlust|umsatzerl", "Gewinn- und Verlustrechnung", "Konzern-Gesamtergebnisrechnung"), ("bilanz|aktiva|passiva", "Bilanz", "Konzernbilanz"))
# Lines that only one of the two methods has.
GKV_LINES, UKV_LINES = ("materialaufwand", "personalaufwand", "veränderung des bestands", "andere aktivierte eigenleistungen", "bestandsveränderung"), ("umsatzkosten", "vertriebskosten", "allgemeine verwaltungskosten")
BALANCE_END, STATEMENT_START = r"summe\s+passiva|bilanzsumme", r"umsatzerl|ergebnisrechnung|gewinn.?und.?verlust|gesamtleistung|kapitalfluss|cashflow"
BALANCE_WORDS, INCOME_START = rf"{_L}(aktiva|passiva|anlageverm[öo]gen|umlaufverm[öo]gen|verbindlichkeiten|eigenkapital|bilanzsumme|r[üu]ckstellungen){_R}", rf"{_L}(umsatzerlöse?|ergebnisrechnung|gewinn-?\s*und\s*verlust|gesamtleistung|betriebsertrag|gesamtertrag){_R}"
# Sections of a management report by the title left of numbering.
SECTIONS = (
    ("ertragslage", "Ertragslage"), (r"vermögens(lage|-\s+und\s+finanzlage)", "Vermögenslage"), (r"nachtragsbericht|ereignisse?\s+nach\s+(dem\s+)?bilanzstichtag", "Nachtragsbericht"),
    (r"chancen\s*([-–]\s*und\s*)?risikobericht|risiko\s*([-–]\s*und\s*)?chancenbericht", "Chancen- und Risikobericht"),
)
_NUMBERED = r"^([a-zäöü]\.|\d+(\.\d+)*\.?)\s+"


def body_text(rows: Column, n: int) -> Column:
    """Lower-case text of the first ``n`` rows, all cells joined by blanks."""
    return F.lower(F.array_join(F.transform(F.flatten(F.slice(F.coalesce(rows, F.array().cast("array<array<string>>")), 1, n)), lambda c: F.coalesce(c, F.lit(""))), " "))


def first_cells(rows: Column, n: int) -> Column:
    """Lower-case text of the first cells of the first ``n`` rows."""
    return F.lower(F.array_join(F.transform(F.slice(F.coalesce(rows, F.array().cast("array<array<string>>")), 1, n), lambda r: F.coalesce(F.get(r, F.lit(0)), F.lit(""))), " "))


def table_classes(tables: DataFrame, keys: list[str], heading: str, rows: str) -> DataFrame:
    """``keys``, table_class: 0 balance sheet, 1 income statement, 2 cash flow, 99 anything else; the first rule that applies decides."""
    t = tables.select(*keys, F.lower(F.coalesce(F.col(heading), F.lit(""))).alias("heading"), body_text(F.col(rows), 20).alias("body"), first_cells(F.col(rows), 8).alias("first"))
    out = F.lit(OTHER)
    for where, pattern, unless, number in reversed(CLASS_RULES):
        hit = F.col(where).rlike(pattern) if unless is None else F.col(where).rlike(pattern) & ~F.col(where).rlike(unless)
        out = F.when(hit, number).otherwise(out)
    return t.select(*keys, out.alias("table_class"))


def statement_name(rows: Column) -> Column:
    """Standard name of a statement by its rows, in the group's form if they speak of a group; '' without proof."""
    t = body_text(rows, 20)
    group, out = t.rlike("konzern|konsolidiert"), F.lit("")
    for pattern, single, several in reversed(NAMES):
        out = F.when(t.rlike(pattern), F.when(group, several).otherwise(single)).otherwise(out)
    return out


def method_by_signature(tables: DataFrame, scope: list[str], key: str, rows: str) -> DataFrame:
    """``scope``, pnl_method, ``key`` of the largest table: gkv or ukv where two lines of the one and at most one of the other stand in it."""
    largest = tables.groupBy(*scope).agg(F.max_by(F.struct(key, rows), F.struct(F.size(F.coalesce(F.col(rows), F.array().cast("array<array<string>>"))), -F.col(key))).alias("t"))
    labels = first_cells(F.slice(F.col(f"t.{rows}"), F.lit(2), F.greatest(F.size(f"t.{rows}"), F.lit(1))), 10_000)
    d = largest.select(*scope, F.col(f"t.{key}").alias(key), labels.alias("labels"))
    hits = lambda lines: sum((F.contains("labels", F.lit(x)).cast("int") for x in lines), F.lit(0))
    g, u = hits(GKV_LINES), hits(UKV_LINES)
    return d.select(*scope, key, F.when((g >= 2) & (u < 2), "gkv").when((u >= 2) & (g < 2), "ukv").alias("pnl_method")).where("pnl_method is not null")


def split_statements(tables: DataFrame, key: str, rows: str) -> DataFrame:
    """``key``, part, first_row, n_rows, name: tables that hold two statements are cut where the second begins.

    First by the balance sheet's total, else by the first income line after balance lines, taking blank and header rows
    above along.  The cut depends on what was met before, within one printed table, so it is scanned in pandas.
    """

    def cuts(texts: list[str], valued: list[bool], marks: list[tuple[bool, bool, bool, bool]]) -> list[int]:
        out, end = [], -1
        for i, (closes, starts, _, _) in enumerate(marks):
            if end < 0 and closes:
                end = i
            elif end >= 0 and starts:
                out.append(end + 1)
                end = -1
        if out:
            return out
        seen = False
        for i, (_, _, balance, income) in enumerate(marks):
            if not seen and balance:
                seen = True
            elif seen and income:
                at = i
                while at - 1 > max(0, i - 6) and not valued[at - 1]:
                    at -= 1
                out.append(at)
                seen = False
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for ident, lines in zip(b["id"], b["lines"], strict=True):
                marks = [(x["closes"], x["starts"], x["balance"], x["income"]) for x in lines]
                bounds = [0, *cuts([], [x["valued"] for x in lines], marks), len(lines)]
                parts = [(a, z) for a, z in zip(bounds, bounds[1:], strict=False) if z > a]
                out += [(ident, i, a, z - a) for i, (a, z) in enumerate(parts)]
            yield pd.DataFrame(out, columns=["id", "part", "first_row", "n_rows"])

    text = lambda r: F.trim(F.array_join(F.filter(r, lambda c: F.coalesce(c, F.lit("")) != ""), " "))
    values = lambda r: F.array_join(F.slice(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), F.lit(2), F.greatest(F.size(r), F.lit(1))), " ")

    def line(r: Column) -> Column:
        t = F.lower(text(r))
        return F.struct(t.rlike(BALANCE_END).alias("closes"), t.rlike(STATEMENT_START).alias("starts"), t.rlike(BALANCE_WORDS).alias("balance"), t.rlike(INCOME_START).alias("income"), values(r).rlike(r"\d{1,3}(\.\d{3})+|\d+,\d+").alias("valued"))

    grid = tables.where(F.col(rows).isNotNull()).select(F.col(key).alias("id"), F.col(rows).alias("rows"))
    kind = dict(grid.dtypes)["id"]
    parts = grid.select("id", F.transform("rows", lambda r: line(F.coalesce(r, F.array().cast("array<string>")))).alias("lines")).mapInPandas(run, f"id {kind}, part int, first_row int, n_rows int")
    named = parts.join(grid, "id").withColumn("name", F.when(F.col("part") == 0, "").otherwise(statement_name(F.slice("rows", F.col("first_row") + 1, F.col("n_rows")))))
    return named.select(F.col("id").alias(key), "part", "first_row", "n_rows", "name")


def dominant_side(lines: DataFrame, scope: list[str], code: str, sides: tuple[str, str], neutral: str | None = None) -> DataFrame:
    """``scope``, side: the prefix most of the codes have; none on a tie; ``neutral`` counts for neither."""
    plain = F.lit(True) if neutral is None else F.coalesce(F.col(code) != neutral, F.lit(False))
    n = [F.count_if(F.col(code).startswith(s) & plain) for s in sides]
    g = lines.groupBy(*scope).agg(n[0].alias("__a"), n[1].alias("__b"))
    return g.where("__a != __b").select(*scope, F.when(F.col("__a") > F.col("__b"), sides[0]).otherwise(sides[1]).alias("side"))


def statement_groups(tables: DataFrame, table_class: Column) -> DataFrame:
    """The tables that consolidation reads, with table_class, framework and method in lower case, ``unknown`` where missing."""
    norm = lambda c: F.lower(F.coalesce(F.col(c), F.lit("unknown")))
    return tables.withColumn("table_class", table_class).where(F.coalesce(F.col("table_class"), F.lit(OTHER)) != OTHER).withColumn("framework", norm("framework")).withColumn("pnl_method", norm("pnl_method"))


def at_least_years(actuals: DataFrame, group: list[str], year: str, least: int = 2) -> DataFrame:
    """The rows of groups that have ``least`` different years; the years are counted by a map-side combined aggregate."""
    enough = actuals.groupBy(*group).agg(F.countDistinct(year).alias("__n")).where(F.col("__n") >= least).drop("__n")
    return actuals.join(enough, group, "left_semi")


def section_title(line: Column) -> Column:
    """Section of a management report that a line is the title of; 'Unknown section: ...' for other numbered titles; else null."""
    t = F.regexp_replace(F.trim(line), r"\s+", " ")
    bare = F.lower(F.regexp_replace(F.lower(t), _NUMBERED, ""))
    numbered = F.lower(t).rlike(_NUMBERED + r"\D")
    out = F.when(numbered & ~t.rlike(r"\s[-+]?\d[\d.,]*\s*$") & (F.length(t) <= 100), F.concat(F.lit("Unknown section: "), t))
    for pattern, name in reversed(SECTIONS):
        out = F.when(bare.rlike(f"^({pattern})$"), name).otherwise(out)
    return out


def sectioned_lines(lines: DataFrame, scope: list[str], order: str, line: str, least: int = 40) -> DataFrame:
    """``scope``, section, paragraph_no, text: lines below their title, cut to paragraphs at blank lines; short paragraphs are dropped."""
    w = Window.partitionBy(*scope).orderBy(order)
    title = section_title(F.col(line))
    d = lines.withColumn("__t", title).withColumn("section", F.last("__t", ignorenulls=True).over(w)).withColumn("__no", F.sum(F.when(F.trim(line) == "", 1).otherwise(0) + F.when(F.col("__t").isNotNull(), 1).otherwise(0)).over(w))
    kept = d.where("__t is null and section is not null").where(F.trim(line) != "")
    g = kept.groupBy(*scope, "section", "__no").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.trim(line).alias("l")))).alias("ls"))
    text = F.array_join(F.transform("ls", lambda x: x["l"]), " ")
    return g.select(*scope, "section", F.col("__no").cast("int").alias("paragraph_no"), text.alias("text")).where(F.length("text") >= least)
