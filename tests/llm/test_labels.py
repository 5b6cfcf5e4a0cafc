"""Label matching: worked cases, confirmed codes as held-out truth, and the automaton against plain edit distance."""

import random

import pytest

from ledgerloom.llm import labels as L
from ledgerloom.llm.queries import p1_found
from ledgerloom.session import table

LIST = [
    ("1. Erlöse aus Umzügen", "R.1"), ("Umsatz mit Umzügen", "R.1"), ("Erlöse aus Webstühlen", "R.2"), ("Umsatz mit Webstühlen", "R.2"), ("Minderung des Werts von Webstühlen", "D.1"), ("Wertverzehr von Webstühlen", "D.1"),
    ("Rückhalt für Webstühle", "B.1"), ("Nutzungsrechte an Webstühlen", "N.1"), ("Administrative Ausgaben für Altersbezüge", "A.1"), ("Rückhalt für Altersbezüge", "B.2"),
]


@pytest.fixture(scope="module")
def reference():
    return L.Reference(LIST)


@pytest.mark.parametrize(
    ("label", "code"),
    [
        ("Erlöse aus Umzügen", "R.1"), ("ERLÖSE AUS UMZÜGEN *", "R.1"), ("Nr. 9 erloese aus umzuegen (Vj. 417)", "R.1"), ("Umzügen, Erlöse aus", "R.1"), ("Umzüge (Umsatz)", "R.1"), ("Er1öse v0n Umzügen", "R.1"), ("Erl­öse aus Umz-\nügen", "R.1"),
        ("Erlsöe aus Umzgüen", "R.1"), ("Umsatz_mit_Webstühlen", "R.2"), ("Webst. - Erlöse", "R.2"), ("Minderung des Werts v. Webstuhlen", "D.1"), ("Webstühlenutzungsrechte", "N.1"), ("Nutz.-Rechte an Webstühlen", "N.1"),
        ("Admin. Ausg. f. Altersbezüge", "A.1"), ("Altersbezüge, Admin. Ausg. f.", "A.1"), ("Rückhalt für Umzüge", L.UNMATCHED), ("Leihgaben an Webstühlen", L.UNMATCHED), ("Erlöse aus Segelbooten", L.UNMATCHED), ("???", L.UNMATCHED), ("Erlöse", L.UNMATCHED),
        ("x" * 5000, L.UNMATCHED),
    ],
)
def test_cases(reference, label, code):
    assert reference.code_of(label) == code


def osa(a, b):
    d = [[i + j if 0 in (i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_against_edit_distance():
    rnd = random.Random(1)
    words = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randrange(3, 9))) for _ in range(40)})
    trie = L.Trie([((w,), i) for i, w in enumerate(words)])
    for _ in range(300):
        text = "".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 10)))
        got = {i: d for (i, end), d in trie.search(text, 0, frozenset(), 3).items() if end == len(text)}
        want = {}
        for i, w in enumerate(words):
            d = osa(w, text)
            if d == 0 or d <= min(3, L.distance_for(min(len(w), len(text)))):
                want[i] = d
        assert got == want, text


def test_confirmed_codes_are_found(spark, sf):
    d = sf.replace("0.001", "0.01")
    ref = L.Reference([(r[0], r[1]) for r in table(spark, d, "label_synonyms").select("original_label", "hgb_code").collect()])
    known = table(spark, d, "client_aliases").where("trim(coalesce(std_id, '')) != '' and trim(coalesce(client_label, '')) != ''").select("client_label", "std_id").collect()
    right = sum(ref.code_of(r[0]) == r[1].strip() for r in known)
    assert right / len(known) > 0.98


def test_query_rows(spark, sf):
    a = table(spark, sf, "client_aliases")
    want = a.where(r"(std_id is null or trim(std_id) = '') and client_label rlike '[^\\s\\p{Z}]'").count()
    got = p1_found(spark, sf)
    assert got.columns == ["alias_id", "hgb_code"]
    assert got.count() == want == got.select("alias_id").distinct().count()


def test_empty_and_clashing(spark):
    ref = spark.createDataFrame(LIST, "original_label string, hgb_code string")
    none = spark.createDataFrame([], "alias_id long, client_label string, key string, label string, code string")
    assert L.match_labels(none, ref, "alias_id", "client_label", "original_label", "hgb_code").count() == 0
    some = spark.createDataFrame([(1, "Erlöse aus Umzügen", "k", "l", "c"), (2, None, "k", "l", "c"), (3, "  ", "k", "l", "c")], none.schema)
    assert [tuple(r) for r in L.match_labels(some, ref, "alias_id", "client_label", "original_label", "hgb_code").collect()] == [(1, "R.1")]


CITIES = [("Berlin", "B"), ("Hamburg", "HH"), ("San Francisco", "SF"), ("New York", "NY"), ("Frankfurt am Main", "F"), ("X", "X"), ("Netto", "N"), ("Position", "P")]
JOBS = [("Accountant", "J1"), ("Head of Sales", "J2"), ("Software Engineer", "J3"), ("Net Position Manager", "J4"), ("Engineer", "J5")]


@pytest.mark.parametrize(
    ("entries", "label", "code"),
    [
        (CITIES, "Berlim", "B"), (CITIES, "Hambrug", "HH"), (CITIES, "San Fransisco", "SF"), (CITIES, "sanfrancisco", "SF"), (CITIES, "York, New", "NY"), (CITIES, "Frankfurt a. Main", "F"), (CITIES, "Netto", "N"), (CITIES, "Position", "P"), (CITIES, "X", "X"), (CITIES, "Paris", L.UNMATCHED),
        (CITIES, "1. Berlin", "B"), (JOBS, "Acountant", "J1"), (JOBS, "Head Sales", "J2"), (JOBS, "Head fo Sales", "J2"), (JOBS, "Sofware Enginer", "J3"), (JOBS, "Engineer", "J5"), (JOBS, "Net Postion Manager", "J4"), (JOBS, "Sales", L.UNMATCHED),
    ],
)
def test_lists_of_other_fields(entries, label, code):
    assert L.Reference(entries).code_of(label) == code


def test_all_entries_within_the_distance(spark):
    ref = spark.createDataFrame([("Marlin", "m"), ("Martin", "t"), ("Berlin", "b"), (None, "n"), (" ", "n"), ("Marta", None)], "entry string, code string")
    d = spark.createDataFrame([(1, "Marlin"), (2, "Matin"), (3, None), (4, "Quux")], "k int, label string")
    got = [tuple(r) for r in L.entries_within(d, ref, "k", "label", "entry", "code").collect()]
    assert sorted(got) == [(1, "Berlin", "b", 2), (1, "Marlin", "m", 0), (1, "Martin", "t", 1), (2, "Martin", "t", 1)]


def test_a_label_of_a_third_of_all_rows(spark):
    ref = spark.createDataFrame(LIST, "entry string, code string")
    d = spark.range(60).selectExpr("id as k", "if(id % 3 = 0, 'erlöse aus umzügen', concat('Label ', id)) as label")
    got = dict(map(tuple, L.match_labels(d, ref, "k", "label", "entry", "code", hot_rows=5).collect()))
    assert got == {i: "R.1" if i % 3 == 0 else L.UNMATCHED for i in range(60)}
