"""Printed numbers, labels and prose, case by case."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import labels, numbers, text
from ledgerloom.functions.once import once


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    ("cell", "value"),
    [
        ("166.825", 166825.0), ("4.8", None), ("12.3", None), ("1.2345", 1.2345), ("87.0596", 87.0596), ("-", None), ("–", None), ("", None), (None, None),
        ("1.234.567,89", 1234567.89), ("-1.234,5", -1234.5), ("10,696,470.77", 10696470.77), ("10.696.470,77", 10696470.77), ("1,5", 1.5), ("7", 7.0), ("abc", None), ("1,2,3", None), ("--5", -5.0),
    ],
)
def test_parse_cell(spark, cell, value):
    assert one(spark, cell, numbers.parse_cell) == value


@pytest.mark.parametrize(("cell", "value"), [("(1.234,50)", -1234.5), ("+ 1.914.645,32", 1914645.32), ("—", None), ("(abc)", None), ("3", 3.0)])
def test_parse_eur(spark, cell, value):
    assert one(spark, cell, lambda c: numbers.parse_eur(c, F.lit(1.0))) == value


@pytest.mark.parametrize(("t", "prose", "segment"), [("1.234", 1234.0, 1.234), ("1.234,5", 1234.5, 1234.5), ("1.234.567", 1234567.0, 1234567.0), ("12.5", 12.5, 12.5), ("−3", -3.0, None), ("12,5 %", None, 12.5)])
def test_prose_and_segment_numbers_differ(spark, t, prose, segment):
    assert one(spark, t, numbers.prose_number) == prose
    assert one(spark, t, numbers.segment_number) == segment


@pytest.mark.parametrize(("t", "year"), [("2024/2025", 2025), ("31.12.1999", 1999), ("120245", None), ("", None), (None, None)])
def test_max_year(spark, t, year):
    assert one(spark, t, numbers.max_year) == year


@pytest.mark.parametrize(("t", "unit"), [("in TEUR", "TEUR"), ("T€", "TEUR"), ("5 €", "EUR"), ("Stück", None), (None, None)])
def test_source_unit(spark, t, unit):
    assert one(spark, t, numbers.source_unit) == unit


@pytest.mark.parametrize(
    ("label", "key"),
    [
        ("1. Umsatzerlöse", "umsatzerloese"), ("a) Löhne und Gehälter", "loehneundgehaelter"), ("IV. Rücklagen", "ruecklagen"), ("A. Anlagevermögen", "anlagevermoegen"), ("3D-Druck", "3ddruck"),
        ("Umsatzer-\nlöse", "umsatzerloese"), ("Ergebnis (GKV)", "ergebnis"), ("1. 2. Doppelt", "2doppelt"), ("Maß", "mass"), ("", ""), (None, None), ("1.Umsatz", "1umsatz"),
    ],
)
def test_lookup_key(spark, label, key):
    assert one(spark, label, labels.lookup_key) == key


@pytest.mark.parametrize(("label", "level"), [("A. Anlagen", 0), ("I. Immaterielle", 1), ("2. Sachanlagen", 2), ("a) Grundstücke", 3), ("- davon aus Steuern", 4), ("Summe", 0)])
def test_indent(spark, label, level):
    assert one(spark, label, labels.indent_level) == level


@pytest.mark.parametrize(("form", "register"), [("GmbH & Co. KG", "HRA"), ("eG", "HRA"), ("GmbH", "HRB"), ("SE", "HRB"), ("e.K.", None)])
def test_register(spark, form, register):
    assert one(spark, form, labels.expected_register) == register


@pytest.mark.parametrize(("title", "kind"), [("Konzernabschluss und Jahresabschluss", "Both"), ("Konzernabschluss", "Konzern"), ("Jahresabschluss", "Jahres"), ("x", "Jahres")])
def test_document_type(spark, title, kind):
    assert one(spark, title, labels.document_type) == kind


@pytest.mark.parametrize(("label", "key"), [("Jahresfehlbetrag", "jahresergebnis"), ("Summe  Aktiva", "bilanzsumme"), ("Ergebnis vor Steuern", "ergebnis vor ertragsteuern"), ("Umsatz", "umsatz"), (None, "")])
def test_row_class(spark, label, key):
    assert one(spark, label, labels.row_class) == key


def test_sentences_and_kinds(spark):
    body = "Das Betriebsergebnis sank. Sondereffekte von 5 TEUR fielen an.\nDas Segment Nord wuchs wegen höherer Erlöse."
    parts = one(spark, body, text.sentences)
    assert len(parts) == 3
    assert [one(spark, s, text.fact_kinds) for s in parts] == [["operating_result"], ["one_off"], ["movement"]]
    assert one(spark, "", text.sentences) == []
    assert one(spark, "Aufwendungen von - 5", text.direction) == "expense"
    assert one(spark, "Erträge", text.direction) == "income"


@pytest.mark.parametrize(("body", "kind"), [("Summe Aktiva und Summe Passiva", "bilanz"), ("Kapitalflussrechnung", "kapitalflussrechnung"), ("Gewinn- und Verlustrechnung", "guv"), ("Konsolidierungskreis, Gewinn- und Verlustrechnung", "anhang_konsolidierungskreis"), ("Vermögenslage", "lagebericht_vermoegenslage"), ("nichts", "unknown")])
def test_sheet_kind(spark, body, kind):
    assert one(spark, body, text.sheet_kind) == kind


def test_visible_text(spark):
    assert one(spark, "<p>a<script>x = '<b>'</script><b>b</b>\n c</p>", text.visible_text) == "a b c"


def test_once_keeps_rows_and_values(spark):
    d = once(spark.createDataFrame([(1, None), (2, "b")], "k int, v string"), w=F.upper("v"))
    assert sorted(map(tuple, d.collect())) == [(1, None, None), (2, "b", "B")]
