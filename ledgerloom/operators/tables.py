"""Extracted tables: cells in long form, year blocks, values, consolidation, subtotals, stitching, content tests."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import labels, numbers
from ledgerloom.functions.once import once

HEADER_ROWS = 10


def cells(tables: DataFrame) -> DataFrame:
    """table_id, row_no, col_no, text: the only form in which a ragged grid can be planned."""
    rows = tables.select("table_id", F.posexplode("rows").alias("row_no", "cells"))
    return rows.select("table_id", "row_no", F.posexplode("cells").alias("col_no", "text"))


def _no_cells() -> Column:
    return F.array().cast("array<string>")


def _header(rows: Column) -> Column:
    """struct(row, years): the first of the first rows with a year right of the first column, and the year of every cell of it; null without one."""
    years = lambda r: F.transform(r, lambda c, i: F.when(i > 0, numbers.max_year(c)))
    heads = F.transform(F.slice(rows, 1, HEADER_ROWS), lambda r, i: F.struct(i.alias("row"), years(F.coalesce(r, _no_cells())).alias("years"), r.alias("cells")))
    return F.get(F.filter(heads, lambda h: F.exists(h["years"], lambda y: y.isNotNull())), F.lit(0))


def _blocks(header: Column) -> Column:
    """array<struct(block, year, start_col, end_col)> of a header row; a closing 'PDF Page' column belongs to no block."""
    n = F.size(header["cells"])
    paged = F.lower(F.trim(F.coalesce(F.element_at(header["cells"], -1), F.lit("")))) == "pdf page"
    last = n - 1 - paged.cast("int")
    found = F.filter(F.transform(header["years"], lambda y, i: F.struct(i.alias("col"), y.alias("year"))), lambda x: x["year"].isNotNull())
    # Adjacent columns of one year make one block: a column opens one if the year before it is another.
    opens = F.filter(found, lambda x, i: (i == 0) | (F.get(found, i - 1)["year"] != x["year"]))
    return F.transform(opens, lambda x, i: F.struct(i.alias("block"), x["year"].alias("year"), x["col"].alias("start_col"), F.coalesce(F.get(opens, i + 1)["col"] - 1, last).alias("end_col")))


def _gridded(tables: DataFrame) -> DataFrame:
    """table_id, rows, header, blocks of the tables with a header; every step is evaluated once, and no cell leaves its row."""
    d = once(tables.select("table_id", "heading", "rows"), header=_header(F.col("rows"))).where("header is not null")
    return once(d, blocks=_blocks(F.col("header")))


def year_blocks(tables: DataFrame) -> DataFrame:
    """table_id, header_row, year, start_col, end_col, block: adjacent columns of one year make one block.

    The header is the first of the first rows with a year right of the first
    column; a closing 'PDF Page' column belongs to no block.
    """
    return _gridded(tables).select("table_id", F.col("header.row").alias("header_row"), F.explode("blocks").alias("b")).select("table_id", "header_row", "b.year", "b.start_col", "b.end_col", "b.block")


def multiplier(heading: Column, rows: Column) -> Column:
    """1000 where the heading or one of the first rows says thousands of euros, else 1."""
    texts = F.flatten(F.transform(F.slice(F.coalesce(rows, F.array().cast("array<array<string>>")), 1, HEADER_ROWS), lambda r: F.coalesce(r, _no_cells())))
    hit = F.exists(texts, lambda c: numbers.thousand_euro(F.coalesce(c, F.lit(""))))
    return F.when(numbers.thousand_euro(F.coalesce(heading, F.lit(""))) | hit, 1000.0).otherwise(1.0)


def unit_multipliers(tables: DataFrame) -> DataFrame:
    """table_id, multiplier of every table."""
    return tables.select("table_id", multiplier(F.col("heading"), F.col("rows")).alias("multiplier"))


def block_values(tables: DataFrame) -> DataFrame:
    """table_id, row_no, label, year, value, priority: the first parseable cell of a row in each block; davon notes are left out.

    A table's rows are exploded once, with its blocks and its multiplier beside them; there is no join and no shuffle.
    """
    d = once(_gridded(tables), m=multiplier(F.col("heading"), F.col("rows")))
    lines = d.select("table_id", "header", "blocks", "m", F.posexplode("rows").alias("row_no", "cells")).where("row_no > header.row and cells is not null")
    label = F.trim(F.coalesce(F.get("cells", F.lit(0)), F.lit("")))
    lines = once(lines, label=label).where(~labels.is_davon(F.col("label")))
    each = lines.select("table_id", "row_no", "label", "m", "cells", F.explode("blocks").alias("b"))
    inside = F.slice("cells", F.col("b.start_col") + 1, F.greatest(F.col("b.end_col") - F.col("b.start_col") + 1, F.lit(0)))
    value = F.get(F.filter(F.transform(inside, lambda c: numbers.parse_eur(c, F.lit(1.0))), lambda v: v.isNotNull()), F.lit(0))
    return once(each, v=value).where("v is not null").select("table_id", "row_no", "label", F.col("b.year").alias("year"), (F.col("v") * F.col("m")).alias("value"), F.when(F.col("b.block") == 0, 0).otherwise(1).alias("priority"))


def within_table(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kept rows and collisions per (table, year, std_id): different labels for one id drop both; equal labels keep the first row."""
    g = values.groupBy("table_id", "year", "std_id").agg(F.countDistinct("label").alias("n_labels"), F.min_by(F.struct("label", "value", "row_no", "priority"), "row_no").alias("first"))
    kept = g.where("n_labels = 1").select("table_id", "year", "std_id", "first.*")
    return kept, g.where("n_labels > 1").select("table_id", "year", "std_id", "n_labels")


def across_tables(kept: DataFrame, group: list[str]) -> tuple[DataFrame, DataFrame]:
    """Per (group, year, std_id): the lowest priority counts; within it equal labels keep the first, and different
    labels stand only if they come from different tables with the same amount. Order-independent by design."""
    keys = [*group, "year", "std_id"]
    w = Window.partitionBy(*keys)
    best = kept.withColumn("top", F.min("priority").over(w)).where("priority = top")
    g = best.groupBy(*keys).agg(
        F.countDistinct("label").alias("n_labels"), F.countDistinct("table_id").alias("n_tables"), F.count("*").alias("n"),
        F.min_by(F.struct("table_id", "label", "value"), F.struct("table_id", "row_no")).alias("first"), F.min("value").alias("lo"), F.max("value").alias("hi"),
    )
    ok = (F.col("n_labels") == 1) | ((F.col("n_tables") == F.col("n")) & numbers.within_cent(F.col("lo"), F.col("hi")))
    return g.where(ok).select(*keys, "first.*"), g.where(~ok).select(*keys, "n_labels")


_HEADING = re.compile(r"\d+[.)]\s*\S")


def _scan(rows: list[tuple[int, str, dict[int, float]]], closing: bool) -> Iterator[tuple[int, str, str, list[str], str]]:
    """row_no, verdict, heading, components, values of every unlabelled valued row of one table, top to bottom."""

    def ties(window: list[tuple[str, dict[int, float]]], target: dict[int, float]) -> bool:
        return bool(window) and all(all(y in v for _, v in window) and abs(sum(v[y] for _, v in window) - x) <= 0.01 for y, x in target.items())

    run: list[tuple[str, dict[int, float]]] = []
    whole: list[tuple[str, dict[int, float]]] = []
    heading, since = "", 0
    last = rows[-1][0] if rows else -1
    for row_no, label, values in rows:
        if label:
            if values:
                if _HEADING.match(label):
                    heading = ""
                run.append((label, values))
                whole.append((label, values))
            elif _HEADING.match(label):
                heading, since = label, len(run)
            continue
        if not values:
            continue
        if heading and ties(run[since:], values):
            yield row_no, "heading", heading, [x for x, _ in run[since:]], ""
            heading = ""
        elif ties(run, values):
            yield row_no, "run", "", [x for x, _ in run], ""
            run, since, heading = [], 0, ""
        elif closing and row_no == last and ties(whole, values):
            yield row_no, "table", "", [x for x, _ in whole], ""
            run, since, heading = [], 0, ""
        else:
            yield row_no, "unverified", "", [], ""


def subtotals(lines: DataFrame) -> DataFrame:
    """table_id, row_no, verdict, heading, components of unlabelled rows; ``lines`` has table_id, row_no, label, year, value, closing.

    The window depends on earlier matches, which no frame expresses; a table is
    a bounded group (a printed page's rows), so it is scanned whole in pandas.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(int(no), str(g["label"].iloc[0]), {int(y): float(v) for y, v in zip(g["year"], g["value"], strict=True) if v == v}) for no, g in pdf.groupby("row_no", sort=True)]
        out = [(pdf["table_id"].iloc[0], *r[:4]) for r in _scan(rows, bool(pdf["closing"].iloc[0]))]
        return pd.DataFrame(out, columns=["table_id", "row_no", "verdict", "heading", "components"])

    return lines.groupBy("table_id").applyInPandas(run, "table_id long, row_no int, verdict string, heading string, components array<string>")


def financial_content(grid: DataFrame, least: int = 5) -> DataFrame:
    """table_id of tables with a column of at least ``least`` German numbers right of the first, header skipped."""
    number = F.trim(F.coalesce("text", F.lit(""))).rlike(r"^-?\d{1,3}(\.\d{3})*(,\d+)?$")
    return grid.where((F.col("col_no") > 0) & (F.col("row_no") > 0) & number).groupBy("table_id", "col_no").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("table_id").distinct()


def stitch(fragments: DataFrame, scope: list[str], order: str, joins: Column) -> DataFrame:
    """``fragments`` with stitched_id: consecutive fragments of a scope for which ``joins`` (over lag columns) holds share one id."""
    w = Window.partitionBy(*scope).orderBy(order)
    return fragments.withColumn("stitched_id", F.sum((~F.coalesce(joins, F.lit(False))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def primary_per_class(tables: DataFrame, by: list[str], size: str, order: str) -> DataFrame:
    """The largest table of each class, the first on ties."""
    w = Window.partitionBy(*by).orderBy(F.desc(size), order)
    return tables.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
