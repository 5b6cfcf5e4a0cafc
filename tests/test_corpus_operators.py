"""Hierarchies, histories and units on small fixtures and against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import hierarchy, history, units
from ledgerloom.plans import corpus
from ledgerloom.session import Scratch, table


def plain_hierarchy(rows):
    up, name = {}, {}
    for order, code, parent in sorted(rows):
        k = (code or "").strip().lower()
        if k and k not in up:
            up[k], name[k] = (parent or "").strip().lower(), code
    up = {k: p if p in up else None for k, p in up.items()}
    out, below = {}, dict.fromkeys(up, 0)
    for k in up:
        chain, x = [], k
        while x is not None and x not in chain:
            chain.append(x)
            x = up[x]
        if x is not None:
            out[k] = ("CYCLE", -1, [])
            continue
        out[k] = (name[chain[-1]], len(chain) - 1, [name[c] for c in reversed(chain)])
        for a in chain[1:]:
            below[a] += 1
    return {name[k]: (*v, below[k] if v[1] >= 0 else -1) for k, v in out.items()}


def got_hierarchy(spark, rows, core, hot=100_000):
    d = spark.createDataFrame(rows, "o int, code string, parent string")
    return {r.code: (r.root_code, r.depth, r.path or [], r.n_descendants) for r in hierarchy.build_hierarchy(d, "code", "parent", "o", core, hot).collect()}


@pytest.mark.parametrize(("core", "hot"), [(0, 100_000), (0, 4), (5, 100_000), (200_000, 4)])
def test_hierarchy_against_plain_python(spark, core, hot):
    rnd = random.Random(7)
    rows = [(i, f"N{i}", f" n{rnd.randrange(i)}\t" if i and rnd.random() < 0.9 else None) for i in range(60)]
    rows += [(100 + i, f"C{i}", f"c{(i + 1) % 3}") for i in range(3)] + [(110, "below", "C0"), (111, "self", "SELF"), (112, "lost", "nowhere"), (113, "N5", "lost"), (114, None, "N1"), (115, " ", "N1")]
    rows += [(200 + i, f"D{i}", f"D{i + 1}") for i in range(30)]
    rows += [(300 + i, f"L{i}", "N3") for i in range(12)] + [(400, "under", "below")]
    assert got_hierarchy(spark, rows, core, hot) == plain_hierarchy(rows)


def test_a_long_chain_in_the_core(spark):
    n = 3_000
    rows = [(i, f"K{i}", f"K{i + 1}" if i + 1 < n else None) for i in range(n)]
    d = spark.createDataFrame(rows, "o int, code string, parent string")
    r = hierarchy.build_hierarchy(d, "code", "parent", "o").agg(F.max("depth"), F.max("n_descendants"), F.sum(F.size("path"))).first()
    assert tuple(r) == (n - 1, n - 1, n * (n + 1) // 2)


def test_hierarchy_of_nothing(spark):
    assert got_hierarchy(spark, [], 10) == {}


def test_descendant_pairs(spark):
    d = spark.createDataFrame([(1, "a", None), (2, "b", "a"), (3, "c", "b"), (4, "x", "x")], "o int, code string, parent string")
    pairs = hierarchy.descendant_pairs(hierarchy.build_hierarchy(d, "code", "parent", "o"))
    assert sorted(map(tuple, pairs.collect())) == [("a", "b", 1), ("a", "c", 2), ("b", "c", 1)]


RECORD = "snapshot_id long, entity_id string, legal_name string, seat string, historical_names array<string>, officer_changes array<struct<effective_date:date,officers_added:array<string>,officers_removed:array<string>,source:string>>, scope_changes array<struct<effective_date:date,entity:string,change_kind:string,source:string>>, snapshot_date date, loaded_at timestamp"


def record(i, entity, name, seat, day, loaded=1, names=None, officers=None, scope=None):
    return (i, entity, name, seat, names, officers, scope, dt.date(2020, 1, day) if day else None, dt.datetime(2020, 2, loaded))


def day(n):
    return dt.date(2020, 1, n)


def test_history_cases(spark):
    rows = [
        record(1, "e", " A  B ", None, 1, names=["Old", "A B", " "]),
        record(2, "e", "wrong", "X", 2, loaded=1),
        record(3, "e", "A B", " ", 2, loaded=2),
        record(4, "e", "C", "Y", 3, officers=[(day(5), ["P"], ["P"], ""), (None, ["Q"], [], "")], scope=[(day(1), "S", "left", ""), (day(2), "S", "mentioned", ""), (day(4), "S", "entered", "")]),
        record(5, "e", "A B", "Y", 4, officers=[(day(9), [], ["P"], ""), (day(9), [], ["P"], ""), (day(7), ["P"], None, "")]),
        record(6, None, "N", "N", 4), record(7, "e", "N", "N", None),
    ]
    got = {tuple(r) for r in history.build_history(spark.createDataFrame(rows, RECORD)).collect()}
    d = lambda n: f"2020-01-{n:02d}"
    assert got == {
        ("e", "legal_name", "A B", d(1), d(3)), ("e", "legal_name", "C", d(3), d(4)), ("e", "legal_name", "A B", d(4), ""), ("e", "legal_name", "Old", "", d(1)),
        ("e", "seat", "Y", d(3), ""), ("e", "officer", "P", "", d(5)), ("e", "officer", "P", d(5), d(9)), ("e", "scope", "S", "", d(1)), ("e", "scope", "S", d(4), ""),
    }
    assert history.build_history(spark.createDataFrame([], RECORD)).count() == 0


def test_late_batches_give_the_same_history_and_publish_at_once(spark, tmp_path):
    rnd = random.Random(3)
    rows = [record(i, f"e{rnd.randrange(4)}", rnd.choice("ABC"), rnd.choice(["X", "Y", None]), rnd.randrange(1, 20), rnd.randrange(1, 20)) for i in range(80)]
    raw = spark.createDataFrame(rows, RECORD)
    want = sorted(map(tuple, history.build_history(raw).collect()))
    early, late = raw.where("snapshot_id < 60"), raw.where("snapshot_id >= 60")
    store = history.HistoryStore(spark, f"file://{tmp_path}/h")
    assert store.current() is None
    store.update(early, early)
    before = sorted(map(tuple, store.current().collect()))
    assert before == sorted(map(tuple, history.build_history(early).collect()))
    store.update(raw, late)
    assert sorted(map(tuple, store.current().collect())) == want


def cents(spark, facts, notes=()):
    f = spark.createDataFrame([(i, 2020, v, u, s, t, "FY2020_x") for i, (v, u, s, t) in enumerate(facts)], "fact_id int, fiscal_year int, value double, unit string, source_unit string, sentence string, sheet string")
    n = spark.createDataFrame([(i, "FY2020_x", i, t) for i, t in enumerate(notes)], "note_id int, sheet string, row_no int, note_text string")
    return {r.fact_id: r.eur_cents for r in units.to_euro_cents(f, n).collect()}


def test_units_by_precedence(spark):
    got = cents(
        spark,
        [
            (1.0, "EUR", "TEUR", "Das Ergebnis betrug 1.247 Tausend Euro (Vorjahr: 34 T€)."),
            (1.5, None, "Mio. €", None), (2.5, "Euro", "TEUR", "ohne"), (3.0, None, None, "Werte (in TEUR)"), (4.0, None, None, "nichts"), (5.0, None, "Stück", "nichts"), (None, None, "TEUR", "nichts"), (float("nan"), None, "TEUR", ""),
            (None, None, None, "Nach T€ 309'156 im Vorjahr belief sich das Betriebsergebnis auf -2.944.608,5 EUR."),
            (None, None, None, "Following €13,263k in the prior year, exceptional items totalled EUR 292,023 thousand."),
            (None, None, None, "Das Ergebnis lag bei minus zwölf Millionen Euro."), (7.0, " ", " ", "Im Jahr 2020 k€ 44 erzielt, 3,3 % mehr."), (0.005, None, "EUR", None),
        ],
        ["Anteile in %", "Beträge in Mio. €"],
    )
    assert got == {0: 124700000, 1: 150000000, 2: 250, 3: 300000, 4: 400000000, 8: -294460850, 9: 29202300000, 10: -1200000000, 11: 4400000, 12: 1}


def test_units_without_notes_or_facts(spark):
    assert cents(spark, [(4.0, None, None, "nichts")]) == {}
    assert cents(spark, []) == {}


def test_scales_are_learned_from_links():
    said = [("eur", "xeur", -3, 190), ("eur", "xeur", None, 10), ("xeur", "yeur", 0, 50), ("stück", "eur", 0, 3), ("eur", "zeur", -6, 2), ("zeur", "weur", 0, 2), ("weur", "xeur", 3, 1), ("eur", "veur", -3, 2), ("xeur", "veur", -3, 1)]
    s = units.propagate(said)
    assert (s["xeur"], s["yeur"], s["zeur"], s["weur"]) == (1e3, 1e3, 1e6, 1e6)
    assert "stück" not in s and "veur" not in s


def test_many_wrong_pairs_are_outvoted():
    # Three of nine links of a spelling the dictionary does not know were read as single euros.
    said = [("qeur", "eur", 0, 2), ("qeur", "eur", 3, 1), ("qeur", "keur", 0, 3), ("qeur", "teur", 0, 1), ("qeur", "eurk", 0, 2), ("keur", "eur", 3, 20), ("teur", "eur", 3, 20), ("eurk", "teur", 0, 9)]
    assert units.propagate(said, defined=lambda name: None)["qeur"] == 1e3


def test_the_links_alone_carry_the_scales(spark, sf, monkeypatch):
    d = sf.replace("0.001", "0.1")
    facts, notes = table(spark, d, "lagebericht_facts"), table(spark, d, "sheet_notes")
    rows = units.prepared(facts, notes).persist()
    with_words = {r.name: r.scale for r in units.scale_graph(rows)[1].collect()}
    links = rows.where("own is not null and value is not null").select(F.col("own.unit").alias("a"), F.coalesce("u", "su").alias("b"), F.col("own.number").cast("double").alias("x"), F.col("value").alias("y"))
    said = [tuple(r) for r in units.votes(links).collect()]
    rows.unpersist()
    assert {k: int(v) for k, v in units.propagate(said, defined=lambda name: None).items()} == with_words
    assert len(with_words) > 20


def test_queries_run_on_whole_tables(spark, sf):
    for name, f in corpus.queries().items():
        assert f(spark, sf).count() > 0, name


def test_scratch_round_trip(spark):
    s = Scratch(spark, "test")
    d = s.write(spark.range(5).select(F.col("id").alias("a b")), "t")
    assert d.count() == 5
    s.drop("t")
