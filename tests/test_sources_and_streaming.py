"""Readers, sinks and the streaming path on small files."""

import json

from pyspark.sql import functions as F

from ledgerloom.operators import entities, history, mapping, segments, series, tables
from ledgerloom.sources import readers, sinks
from ledgerloom.streaming import incremental
from tests.test_corpus_operators import RECORD, record


def test_extracted_tables_json(spark, tmp_path):
    item = {"index": 1, "heading": "Bilanz 2024", "type": 0, "rows": [["", "2024", None], ["A", 1.5, "2"]]}
    (tmp_path / "a.json").write_text("﻿" + json.dumps([item, {**item, "index": 2}]), encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps({"tables": [item]}, indent=1))
    (tmp_path / "c.json").write_text("{broken")
    d = readers.extracted_tables(spark, str(tmp_path))
    assert sorted((r.filing_id, r["index"]) for r in d.where("heading is not null").collect()) == [("a", 1), ("a", 2), ("b", 1)]
    assert [r.filing_id for r in d.where("heading is null").collect()] == ["c"]
    assert d.select("table_id").where("heading is not null").distinct().count() == 3
    assert tables.cells(d.where("filing_id = 'b'")).where("text is not null").count() == 5


def test_layers_and_stores(spark, tmp_path):
    (tmp_path / "a.csv").write_text("key,std_id\nx,1\ny,2\nx,3\n")
    (tmp_path / "b.csv").write_text("key,std_id\ny,9\n")
    d = readers.layered_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], "key")
    assert sorted(map(tuple, d.select("key", "std_id").collect())) == [("x", "3"), ("y", "9")]
    s = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("j", 1, "c")], "k string, n int, v string")
    assert sorted(r.v for r in readers.store_view(s, ["k"], "n").collect()) == ["b", "c"]


def test_pages(spark):
    html = '<a href="/jobs">x</a><a href="https://a.de/x#t">y</a><a href="http://b.com">z</a><script type="application/ld+json">{"@type":"JobPosting","title":" Lead ","datePosted":"2024-05-06T00:00"}</script><script type="application/ld+json">[{"@type":"Thing"},{"@type":"JobPosting","title":"Dev","datePosted":"bad"}]</script><script type="application/ld+json">{oops</script>'
    d = spark.createDataFrame([("https://a.de/home", html), ("https://c.de", None)], "url string, html string")
    assert sorted((r.title, str(r.date_posted)) for r in readers.job_postings(d, "url", "html").collect()) == [("Dev", "None"), ("Lead", "2024-05-06")]
    assert sorted(r.link for r in readers.links(d, "url", "html").collect()) == ["https://a.de/jobs", "https://a.de/x"]


def test_pictures(spark, tmp_path):
    for name, body in (("b.png", b"1"), ("a.jpg", b"1"), ("n.txt", b"1")):
        (tmp_path / name).write_bytes(body)
    rows = readers.pictures(spark, str(tmp_path)).collect()
    assert [r.path.rpartition("/")[2] for r in rows] == ["a.jpg", "b.png"]
    assert len({r.sha for r in rows}) == 1


def test_sinks(spark, tmp_path):
    cells = spark.createDataFrame([(1, 0, 0, ""), (1, 0, 1, "2024"), (1, 1, 0, 'a,"b"'), (1, 1, 1, None), (1, 2, 0, ""), (1, 2, 1, "3,5")], "table_id int, row_no int, col_no int, text string")
    sinks.csv_per_table(cells, str(tmp_path / "csv"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "csv/table_id=1")).collect()]
    assert lines == [",2024", '"a,""b""",', ',"3,5"']
    assert sinks.styled_cells(cells).where("is_total").select("row_no").distinct().collect()[0][0] == 2
    q = spark.createDataFrame([("k", 2, "later"), ("k", 1, "first"), ("j", 3, "x")], "key string, seq int, raw string")
    sinks.review_queue(q, str(tmp_path / "q"), "key", "seq")
    assert sorted(r.raw for r in spark.read.option("header", True).csv(str(tmp_path / "q")).collect()) == ["first", "x"]
    sinks.canonical_json(q, str(tmp_path / "j"), ["key"])
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    m = spark.createDataFrame([("c", "a", "b"), ("c", "x", "a"), ("c", "x", "y"), ("d", "a", "b"), ("c", None, "y")], "company_normalized string, member_key string, target_key string")
    assert sinks.cleared(m, "c", "a").count() == 3
    name = spark.range(1).select(sinks.snapshot_name(F.lit("Müller & Co")).alias("n")).first()[0]
    assert name.startswith("müller_co__") and name.endswith(".json")
    t, refused = sinks.filled_template(spark.createDataFrame([("l", "s", "EUR", 2023, 1.0), ("l", "s", "EUR", 2024, 2.0), ("m", "t", "EUR", 2024, 1.0), ("m", "t", "PCT", 2023, 1.0), ("n", "u", "EUR", 2024, 1.0), ("n", "u", "EUR", 2024, 3.0)], "label string, std_id string, unit string, fy int, value double"), [2023, 2024])
    assert sorted(map(tuple, refused.collect())) == [("m", "t", 2, 1), ("n", "u", 1, 2)]
    assert [tuple(r) for r in t.collect()] == [("l", "s", "EUR", 1.0, 2.0)]


def test_subtotal_windows(spark):
    rows = [(1, "1. Aufwand", 0, None), (2, "a) x", 2024, 1.0), (3, "b) y", 2024, 2.0), (4, "", 2024, 3.0), (5, "c", 2024, 4.0), (6, "", 2024, 7.0), (7, "d", 2024, 1.0), (8, "", 2024, 9.0), (9, "", 2024, 8.0)]
    d = spark.createDataFrame([(1, n, label, y, float("nan") if v is None else v, True) for n, label, y, v in rows], "table_id long, row_no int, label string, year int, value double, closing boolean")
    got = [(r.row_no, r.verdict, r.heading, r.components) for r in tables.subtotals(d).orderBy("row_no").collect()]
    assert got == [(4, "heading", "1. Aufwand", ["a) x", "b) y"]), (6, "run", "", ["a) x", "b) y", "c"]), (8, "unverified", "", []), (9, "table", "", ["a) x", "b) y", "c", "d"])]


def test_series_and_mapping_cases(spark):
    o = spark.createDataFrame([("k", 0.125, 1), ("k", 0.12, 2), ("k", -0.001, 3), ("j", None, 4)], "k string, v double, i int")
    got = {(r.k, str(r.cents)): (r.n_rows, r.disputed) for r in series.observations(o, ["k"], "v", ["i"]).collect()}
    assert got == {("k", "0.12"): (2, True), ("k", "0.00"): (1, True)}
    w = entities.warnings(spark.createDataFrame([("e", "GmbH", "HRA"), ("f", "KG", "HRA"), ("g", None, "HRB")], "entity_id string, legal_form string, register_type string"))
    assert [tuple(r) for r in w.collect()] == [("e", "expected HRB, found HRA")]
    u = entities.upsert(spark.createDataFrame([("k", "old", ["a"])], "k string, v string, s array<string>"), spark.createDataFrame([("k", None, ["b"]), ("n", "new", None)], "k string, v string, s array<string>"), "k", ["v"], ["s"])
    assert sorted(map(tuple, u.collect())) == [("k", "old", ["a", "b"]), ("n", "new", [])]
    r = mapping.narrowest_range(spark.createDataFrame([(1, 5, "A"), (2, 99, "A")], "id int, x int, variant string"), "x", "variant", spark.createDataFrame([("A", 1, 9, "wide"), ("A", 4, 6, "narrow")], "variant string, low int, high int, code string"), ["id"])
    assert sorted(map(tuple, r.collect())) == [(1, "narrow"), (2, None)]


def test_near_fingerprints_are_complete(spark):
    import random

    rnd = random.Random(2)
    base = [rnd.getrandbits(63) for _ in range(30)]
    prints = base + [b ^ (1 << rnd.randrange(63)) ^ (1 << rnd.randrange(63)) for b in base] + base[:3]
    d = spark.createDataFrame(list(enumerate(prints)), "k int, bits long")
    got = {(r.a, r.b) for r in segments.near_fingerprints(d, "k", "bits", 3, 4).collect()}
    reps = {}
    for i, p in enumerate(prints):
        reps.setdefault(p, i)
    want = {(min(i, j), max(i, j)) for p, i in reps.items() for q, j in reps.items() if i != j and (p ^ q).bit_count() <= 3}
    assert got == want


def test_history_from_a_stream(spark, tmp_path):
    src, raw = str(tmp_path / "in"), str(tmp_path / "raw")
    a = spark.createDataFrame([record(1, "e", "A", "X", 1), record(2, "f", "B", "X", 1)], RECORD)
    b = spark.createDataFrame([record(3, "e", "C", "X", 3, 3), record(4, "e", "B", "X", 2, 4)], RECORD)
    store = history.HistoryStore(spark, f"file://{tmp_path}/h")
    for part in (a, b):
        part.coalesce(1).write.mode("append").parquet(src)
        q = incremental.keep_history(incremental.read_stream(spark, src, RECORD), store, lambda: spark.read.schema(RECORD).parquet(raw), lambda x: x.write.mode("append").parquet(raw), str(tmp_path / "cp"))
        q.awaitTermination()
    assert sorted(map(tuple, store.current().collect())) == sorted(map(tuple, history.build_history(a.unionByName(b)).collect()))


def test_windowed_counts_stream(spark, tmp_path):
    d = spark.createDataFrame([("2024-01-01 00:00:10", "a"), ("2024-01-01 00:00:50", "a"), ("2024-01-01 00:05:00", "b")], "t string, kind string").select(F.col("t").cast("timestamp").alias("ts"), "kind")
    d.coalesce(1).write.parquet(str(tmp_path / "e"))
    s = incremental.windowed_counts(incremental.read_stream(spark, str(tmp_path / "e"), "ts timestamp, kind string"), "ts", "kind", "1 minute", "1 minute")
    q = s.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.kind, r.n) for r in spark.table("counts").collect()) == [("a", 2), ("b", 1)]


def test_reconcile_touched(spark):
    raw = spark.createDataFrame([("c", 2020, "k", 1.0, 1), ("c", 2020, "k", 2.0, 2), ("d", 2020, "k", 1.0, 3)], "company_normalized string, fiscal_year int, kind string, value double, fact_id int")
    out = incremental.reconcile_touched(raw, raw.where("fact_id = 2")).collect()
    assert len(out) == 2 and all(r.disputed for r in out)


def test_more_sources(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"version": 1, "records": [{"id": "a", "n": 1}, {"id": "b"}]}, indent=2))
    (tmp_path / "t.json").write_text("{broken")
    assert sorted(map(tuple, readers.entity_store(spark, str(tmp_path / "*.json"), "id:string,n:int").collect())) == [("a", 1), ("b", None)]
    q = spark.createDataFrame([(" HTTPS://A.de// ",), ("x",)], "q string")
    a = spark.createDataFrame([("https://a.de/", 7)], "q string, answer int")
    assert sorted((r.q, r.answer) for r in readers.lookups(q, a, "q").collect()) == [(" HTTPS://A.de// ", 7), ("x", None)]
    r = spark.createDataFrame([(1, "Konzernabschluss 2020", "x"), (2, "Jahresabschluss 2020", "Berichtigung"), (3, "Einladung", "x"), (4, "Jahresabschluss 2021", None)], "i int, title string, note string")
    assert [x.i for x in readers.register_results(r, "title", "note").collect()] == [1]
    pages = spark.createDataFrame([(1, "https://a.de/impressum"), (2, "https://a.de/imprint"), (3, "https://a.de/blog"), (4, "https://A.de/esg")], "n int, url string")
    kept, skipped = readers.pages_by_class(pages, "url", "n")
    assert sorted((x.page_class, x.url) for x in kept.collect()) == [("imprint", "https://a.de/impressum"), ("sustainability", "https://A.de/esg")]
    assert sorted(x.url for x in skipped.collect()) == ["https://a.de/blog", "https://a.de/imprint"]
    evil = spark.createDataFrame([("https://h.de/x", '<a href="https://h.de.evil.com/y">a</a><a href="//h.de/z">b</a><a href="HTTPS://H.DE/w">c</a>')], "url string, html string")
    assert sorted(x.link for x in readers.links(evil, "url", "html").collect()) == ["HTTPS://H.DE/w", "https://h.de/z"]


def test_more_sinks(spark, tmp_path):
    p = lambda n: str(tmp_path / n)
    d = spark.createDataFrame([("s", "b"), ("s", "a")], "sheet string, reason string")
    sinks.csv_with_mark(d.coalesce(1), p("bom"))
    assert next((tmp_path / "bom").glob("*.csv")).read_bytes().startswith(b"\xef\xbb\xbfsheet,")
    sinks.segment_queue(d, p("queue"))
    assert [r.reason for r in spark.read.option("header", True).csv(p("queue")).collect()] == ["a", "b"]
    for _ in range(2):
        sinks.feedback_manifest(spark.createDataFrame([(1, "x", "why")], "id int, body string, note string"), "id", "note", p("manifest"))
    rows = spark.read.json(p("manifest")).collect()
    assert len(rows) == 2 and len({r.sha for r in rows}) == 1
    sinks.asset_manifest(spark.createDataFrame([("b.png", "ff", 3), ("a.png", "ff", 3)], "path string, sha string, length long"), p("assets"))
    assert [(r.path, r.n_copies) for r in spark.read.json(p("assets")).collect()] == [("a.png", 2)]
    sinks.audit_companion(spark.createDataFrame([("c", "s2", "d"), ("c", "s1", "d"), ("c", "s1", "d")], "company string, slot string, doc string"), ["company"], p("audit"))
    assert [e.slot for e in spark.read.json(p("audit")).first().entries] == ["s1", "s2"]
    for n in (1, 2):
        sinks.replace_json(spark, spark.range(n), "file://" + p("store"))
        assert spark.read.json(p("store")).count() == n
    assert not (tmp_path / "store.new").exists() and not (tmp_path / "store.old").exists()
    t = spark.createDataFrame([("c", 1, "A/B"), ("c", 2, "a:b"), ("c", 3, None), ("d", 4, "x" * 40)], "company string, table_id int, heading string")
    a = spark.createDataFrame([("c", "k", 2020, "L", 1.0), ("c", "k", 2021, "M", 2.0)], "company string, std_id string, year int, label string, value double")
    book = sinks.audit_workbook(a, t, ["company"])
    assert sorted(r.sheet_name for r in book["raw"].collect()) == ["A_B", "Table", "a_b_2", "x" * 27]
    assert book["audit"].first().labels == ["L", "M"] and book["overview"].first()["values"] == {2020: 1.0, 2021: 2.0}


def test_jobs_from_cards_where_no_posting_is_structured(spark):
    cards = '<ul><li class="job-item"><h3>Lead <b>Tax</b></h3><span class="location">Ulm</span></li><li class="job-item"><p>none</p></li><li class="x"><h3>No</h3></li><li class="job-item"><h3>LEAD TAX</h3></li></ul>'
    both = '<script type="application/ld+json">{"@type":"JobPosting","title":"Dev"}</script>' + cards
    d = spark.createDataFrame([("https://a.de", cards), ("https://b.de", both), ("https://c.de", None)], "url string, html string")
    assert sorted((r.url, r.title, r.location) for r in readers.card_jobs(d.where("url like '%a.de'"), "url", "html").collect()) == [("https://a.de", "LEAD TAX", None), ("https://a.de", "Lead Tax", "Ulm")]
    assert sorted(map(tuple, readers.jobs_of_pages(d, "url", "html").select("url", "title").collect())) == [("https://a.de", "LEAD TAX"), ("https://b.de", "Dev")]


def test_a_renamed_entity_keeps_its_former_name(spark):
    rows = "id string, name string, former array<string>"
    store = spark.createDataFrame([("a", "Old", ["Older"]), ("b", "Same", None), ("c", "Kept", [])], rows)
    new = spark.createDataFrame([("a", "New", None), ("b", "Same", ["X"]), ("d", None, None)], rows)
    got = {r.id: (r.name, r.former) for r in entities.upsert(store, new, "id", ["name"], ["former"], {"name": "former"}).collect()}
    assert got == {"a": ("New", ["Old", "Older"]), "b": ("Same", ["X"]), "c": ("Kept", []), "d": (None, [])}
