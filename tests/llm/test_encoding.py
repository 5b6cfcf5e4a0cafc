"""Encoding repair: round trips through every chain, and clean text of many scripts left alone."""

import pytest

from ledgerloom.llm import encoding as E
from ledgerloom.session import Scratch, table

TABLE = "table_id long, heading string, rows array<array<string>>"


@pytest.fixture(scope="module")
def fitted(spark, sf):
    d = table(spark, sf.replace("0.001", "0.01"), "extracted_tables")
    return E.fit(E.cells_of(d), Scratch(spark, "test-encoding"))


@pytest.mark.parametrize("text", ["Aufstellung über Vorräte und Anlagen", "Gliederung nach Zweigläden und Größen 2014", "KONZERN-ÜBERSICHT DER ERLÖSE"])
def test_round_trip(fitted, text):
    model, margin = fitted
    done = 0
    for _, _, garble in E.CHAINS:
        bad = garble(text)
        if bad and bad != text and not any(E.LOST in x for x in bad):
            got = E.restored_text(bad, model, margin, {})
            done += got == text
            assert got in (text, None), bad
    assert done >= 15


@pytest.mark.parametrize("text", ["Торговый дом Вельта", "Café ‹Zur Spule›", "Bühne ├ links ┤", "Σ Zwischensumme", "½ Anteil Färberei", "SÃO BENTO Têxtil Lda.", "plain", "Müller-Garn® ©", "Größe „S“ – „XL“"])
def test_clean_text_stays(fitted, text):
    model, margin = fitted
    assert E.restored_text(text, model, margin, {}) is None


def test_partly_garbled_and_lost(fitted):
    model, margin = fitted
    assert E.restored_text("Vertriebliche Ausgaben fÃ¼r Stromverträge", model, margin, {}) == "Vertriebliche Ausgaben für Stromverträge"
    assert E.restored_text("R�ckhalt fÃ¼r", model, margin, {}) == ""


def test_table_cases(spark):
    rows = [(1, None, [["a", None], None, []]), (2, "", None), (3, "x�y", [["", "b"]])]
    got = [tuple(r) for r in E.restore(spark.createDataFrame(rows, TABLE)).collect()]
    assert got == [(3, -1, -1, "")]
    assert E.restore(spark.createDataFrame([], TABLE)).count() == 0


def test_no_gram_and_no_clean_word_is_left_out(spark, sf, fitted, monkeypatch):
    """A model that is not held whole restores as one that is, and all clean words set the margin."""
    d = table(spark, sf.replace("0.001", "0.01"), "extracted_tables")
    near = sorted(map(tuple, E.restore(d).collect()))
    for bound, value in {"MOST_GRAMS": 100, "VALIDATION_WORDS": 3, "MOST_GAINS": 100, "WORDS_SCORED": 50, "WORDS_GARBLED": 7}.items():
        monkeypatch.setattr(E, bound, value, raising=False)
    far = sorted(map(tuple, E.restore(d).collect()))
    assert near and far == near
    scratch = Scratch(spark, "test-encoding-far")
    model, margin = E.fit(E.cells_of(d), scratch)
    assert margin == fitted[1]
    for word in ("fÃ¼r", "für", "plain"):
        assert model.best(word) == fitted[0].best(word)
    clean = [r["word"] for r in spark.read.parquet(f"{scratch.root}/clean").collect()]
    gains = [fitted[0].best(w)[1] for w in clean]
    back = sorted(got[1] for w in clean for _, _, garble in E.CHAINS if (bad := garble(w)) and bad != w and (got := fitted[0].best(bad))[0] == w)
    assert len(clean) > 3 and margin == pytest.approx(max(E.FIRST_MARGIN, (max(gains) + back[len(back) // 200]) / 2))


def test_table_cases_of_a_large_model(spark, monkeypatch):
    monkeypatch.setattr(E, "MOST_GRAMS", 0)
    test_table_cases(spark)


def test_smallest_gain(spark, monkeypatch):
    values = [((i * 37) % 211) ** 2 / 7 - 50 for i in range(1000)] + [3.5] * 40
    gains = spark.createDataFrame([(x,) for x in values], "gain double")
    for bound in (5, 10_000):
        monkeypatch.setattr(E, "MOST_GAINS", bound)
        assert [E._smallest(gains, k) for k in (0, 5, 517, 1039)] == [sorted(values)[k] for k in (0, 5, 517, 1039)]
