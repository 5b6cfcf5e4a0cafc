"""Statements, sections, segment sheets and prose on worked cases."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import labels, numbers, text
from ledgerloom.operators import segments, series, statements

GRID = "table_id long, heading string, rows array<array<string>>"


@pytest.mark.parametrize(
    ("heading", "rows", "want"),
    [
        ("Konzernbilanz zum 31.12.", [], 0), ("Erläuterung zur Bilanz", [["Umsatzerlöse", "1"]], 1), ("Gewinn und Verlust 2020", [], 1), ("Ergebnisrechnung", [], 1), ("Kapitalflussrechnung", [["Jahresüberschuss", "1"]], 2), ("Eigenkapitalspiegel", [["Eigenkapital", "5"]], 99),
        (None, [["Aktiva", "1"], [None, None]], 0), ("", [["Jahresüberschuss", "1"], ["Finanzierungstätigkeit", "2"]], 2), ("", [["Verlustvortrag", "1"]], 99), ("", [["Verlust- und Zinsvorträge", "1"]], 99), ("", [["Verlust", "1"]], 1),
        ("Umsatzerlöse", [["A. Segmente", ""], ["Umsatzerlöse Inland", "1"]], 99), ("Ertragslage", [["Umsatzerlöse", "1"]], 99), (None, None, 99), ("", [["Eigenkapitalveränderungsrechnung", ""]], 99),
    ],
)
def test_table_class(spark, heading, rows, want):
    d = spark.createDataFrame([(1, heading, rows)], GRID)
    assert statements.table_classes(d, ["table_id"], "heading", "rows").first().table_class == want


def test_splits(spark):
    two = [["Aktiva", "1,0"], ["Summe Passiva", "2,0"], ["", ""], ["Umsatzerlöse", "3,0"], ["Materialaufwand", "1,0"]]
    untitled = [["Aktiva", "1.000"], ["Rückstellungen", "1.000"], ["", "2.000"], ["Gewinn- und Verlust", "2020"], ["", "TEUR"], ["Umsatzerlöse", "3.000"]]
    one = [["Aktiva", "1"], [None, None]]
    d = spark.createDataFrame([(1, None, two), (2, None, untitled), (3, None, one), (4, None, None), (5, None, [])], GRID)
    got = sorted(map(tuple, statements.split_statements(d, "table_id", "rows").collect()))
    assert got == [(1, 0, 0, 2, ""), (1, 1, 2, 3, "Gewinn- und Verlustrechnung"), (2, 0, 0, 3, ""), (2, 1, 3, 3, "Gewinn- und Verlustrechnung"), (3, 0, 0, 2, "")]


def test_method_signature(spark):
    rows = [(1, "c", [["x"], ["Materialaufwand"], ["Personalaufwand"]]), (2, "c", [["x"]]), (3, "d", [["x"], ["Umsatzkosten"], ["Vertriebskosten"]]), (4, "e", [["x"], ["Materialaufwand"]]), (5, "f", None)]
    d = spark.createDataFrame(rows, "table_id long, company string, rows array<array<string>>")
    assert sorted(map(tuple, statements.method_by_signature(d, ["company"], "table_id", "rows").collect())) == [("c", 1, "gkv"), ("d", 3, "ukv")]


def test_sections(spark):
    lines = ["Vorwort ohne Titel", "2. Ertragslage", "Der Umsatz stieg im Berichtsjahr deutlich", "um fünf Prozent gegenüber dem Vorjahr.", "", "kurz", "3.1 Chancen- und Risikobericht", "Risiken bestehen vor allem aus den Märkten im Ausland.", "4. Personal", "Zum Stichtag waren fünfzig Personen beschäftigt worden.", "1. Umsatzerlöse 1.200,5"]
    d = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "doc long, no int, line string")
    got = [(r.section, r.text) for r in statements.sectioned_lines(d, ["doc"], "no", "line").orderBy("paragraph_no").collect()]
    assert got == [
        ("Ertragslage", "Der Umsatz stieg im Berichtsjahr deutlich um fünf Prozent gegenüber dem Vorjahr."), ("Chancen- und Risikobericht", "Risiken bestehen vor allem aus den Märkten im Ausland."),
        ("Unknown section: 4. Personal", "Zum Stichtag waren fünfzig Personen beschäftigt worden. 1. Umsatzerlöse 1.200,5"),
    ]


SHEET = [["Umsatzsplit"], ["", "2021", "2020", "2021"], ["", "T€", "T€", "%"], ["A. Segmente"], ["1. Hemden", "1.234,5", "1.000", "60,0"], ["Blusen", "500", None, "40,0"], ["Bruttoumsatz", "1.734,5", "1.000", ""], ["B. Absatzmärkte"], ["Inland", "900", "800", ""]]


def test_segment_figures(spark):
    newer = [["", "2020"], ["", "T€"], ["A. Segmente"], ["Hemden", "1.000"], ["Bruttoumsatz", "1.000"]]
    other = [["", "2021"], ["", "T€"], ["A. Segmente"], ["Blusen", "501"], ["Bruttoumsatz", "1.000"]]
    d = spark.createDataFrame([(1, "FY2021", SHEET), (2, "FY2020", newer), (3, "FY2022", other), (4, "FY2020", [["x"]])], "id long, title string, rows array<array<string>>")
    figures, reviews = segments.segment_figures(d, "id", "title", "rows")
    got = {(r.segment_name, r.segment_type, r.fiscal_year, r.metric): (r.value, r.unit, r.basis, r.id) for r in figures.collect()}
    assert got[("Hemden", "product", 2020, "revenue")] == (1_000.0, "EUR", "bruttoumsatzerloese", 2)
    assert got[("Hemden", "product", 2021, "revenue")] == (1_234_500.0, "EUR", "bruttoumsatzerloese", 1)
    assert got[("Hemden", "product", 2021, "revenue_share")] == (60.0, "PCT", "bruttoumsatzerloese", 1)
    assert got[("Inland", "geography", 2020, "revenue")] == (800_000.0, "EUR", None, 1)
    assert ("Blusen", "product", 2021, "revenue") not in got
    reasons = {r.reason for r in reviews.collect()}
    assert any("conflicting duplicate disclosure for Blusen FY2021" in x for x in reasons) and "geography table has no explicit gross/net revenue basis" in reasons


def test_prose_parts(spark):
    s = "Jahresergebnis (vor Steuern) der Die Muster Handel GmbH stieg zum 31. Dezember 2020 auf 1.234 TEUR; Sparte Objekt ging zurück."
    r = spark.createDataFrame([(s,)], "s string").select(
        text.fact_kinds(F.col("s")).alias("k"), text.dates(F.col("s")).alias("d"), numbers.prose_amounts(F.col("s"), F.lit("TEUR")).alias("a"), text.segment(F.col("s")).alias("g"), text.entity(F.lit("Die Muster Handel GmbH schied aus.")).alias("e"),
    ).first()
    assert (r.k, r.d, r.a, r.g, r.e) == (["operating_result"], ["zum 31. Dezember 2020"], [1_234_000.0], "Objekt", "Muster Handel GmbH")


def test_small_expressions(spark):
    r = spark.range(1).select(
        numbers.shown(F.lit(-1234.56), 1).alias("a"), numbers.millions(F.lit(1_250_000.0)).alias("b"), numbers.export_number(F.lit("1.234,5")).alias("c"), numbers.export_number(F.lit("12.50")).alias("d"), numbers.start_year(F.lit("01.07.2019 bis zum 30.06.2020")).alias("e"), numbers.end_year(F.lit("01.07.2019 bis zum 30.06.2020")).alias("f"),
        labels.document_type(F.lit("Konzern AG: Jahresabschluss")).alias("g"), labels.is_readable(F.lit("□□□a")).alias("h"), labels.override_key(F.lit(" Bilanz  (Konzern) ")).alias("i"), labels.row_class(F.lit("Jahresfehlbetrag")).alias("j"),
    ).first()
    assert tuple(r) == ("(1234.6)", "1.3", 1234.5, 12.5, 2019, 2020, "Jahres", False, "bilanz konzern", "jahresergebnis")


def test_growth_and_years(spark):
    d = spark.createDataFrame([("a", 2018, 1.0), ("a", 2020, 3.0), ("b", 2020, 1.0), ("c", 2019, 0.0), ("c", 2020, 1.0)], "k string, y int, v double")
    assert [tuple(r) for r in series.last_growth(d, ["k"], "y", "v").collect()] == [("a", 2020, 2018, 2.0)]
    assert {r.k for r in statements.at_least_years(d, ["k"], "y").collect()} == {"a", "c"}
