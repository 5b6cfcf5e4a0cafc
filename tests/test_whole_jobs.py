"""Queries over the whole of their tables, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import segments, units
from ledgerloom.plans import filings, registers


def test_carry_forward_reads_long_texts(spark, tmp_path):
    long = "Lagebericht\n" + "\n".join(f"Satz {i}, der kein Titel ist." for i in range(200)) + "\nAusblick\nEnde gut.\n"
    texts = [(1, "Kurz\nEin Satz.", 14), (2, long, len(long)), (3, None, None), (4, "ohne, Titel", None)]
    assert len(long) > 2000
    spark.createDataFrame(texts, "doc_id int, text string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for doc, text, _ in texts:
        section = None
        for i, line in enumerate(text.split("\n") if text is not None else []):
            if 3 <= len(line) <= 40 and not any(c in line for c in ".:,;"):
                section = line
            want.append((doc, i, line, section))
    got = registers.queries()["carry_forward_all"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == want


def test_bridge_reverse_reads_every_field(spark, tmp_path):
    fields = [
        ("G-1", "U-A.1, U-A.2"), ("G-2", "U-A.1; U-A.12"), ("G-3", "U-A.1\tU-A.2"), ("G-4", "U-A.2 und U-A.1"), ("G-5", '"U-A.1, Inland" / U-A.2'), ("G-6", "[U-A.1, U-A.3]"),
        ("G-7", "U-A.1 (a, b); U-A.3"), ("G-0", None), ("G-0", " "), ("G-1", "U-A.1"), (None, "U-A.3, U-A.4"),
    ]
    rows = [(i, "c", g, f) for i, (g, f) in enumerate(fields)]
    spark.createDataFrame(rows, "bridge_id long, company_normalized string, gkv_code string, ukv_codes string").write.parquet(f"{tmp_path}/pnl_format_bridge.parquet")
    got = {r.target: (r.n_sources, r.first_source) for r in registers.queries()["bridge_reverse_all"](spark, str(tmp_path)).collect()}
    assert got == {
        "U-A.1": (5, "G-1"), "U-A.2": (4, "G-1"), "U-A.12": (1, "G-2"), "U-A.1, Inland": (1, "G-5"), "U-A.3": (2, "G-6"), "U-A.1 (a, b)": (1, "G-7"), "U-A.4": (0, None),
    }


def test_near_dup_hamming_reads_all_components(spark, tmp_path):
    rnd = random.Random(5)
    base = [[rnd.choice((-1.0, 1.0)) for _ in range(64)] for _ in range(20)]
    flip = lambda v, at: [-x if i in at else x for i, x in enumerate(v)]
    vectors = base + [flip(v, range(48, 64)) for v in base[:5]] + [flip(v, rnd.sample(range(64), 7)) for v in base[5:10]] + [flip(v, range(56, 64)) for v in base[10:12]] + base[:2]
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    reps = {}
    for i, v in enumerate(vectors):
        reps.setdefault(tuple(v), i)
    far = lambda p, q: sum(x != y for x, y in zip(p, q, strict=True))
    want = {(i, j, far(p, q)) for p, i in reps.items() for q, j in reps.items() if i < j and far(p, q) <= 7}
    got = segments.near_fingerprints(filings._prints(spark, str(tmp_path)).where("vec_id < 1000000"), "vec_id", "bits", 7, 8).collect()
    assert {(r.a, r.b, r.distance) for r in got} == want and len(got) == len(want) >= 5
    assert registers.queries()["near_dup_hamming"](spark, str(tmp_path)).count() > len(want)


@pytest.mark.parametrize("seed", range(2))
def test_kept_of_near_is_greedy_by_key(spark, seed):
    rnd = random.Random(seed)
    prints = [rnd.getrandbits(16) & 0x0FFF for _ in range(80)]
    d = spark.createDataFrame(list(enumerate(prints)), "k int, bits long")
    kept = []
    for i, p in enumerate(prints):
        if all((p ^ prints[j]).bit_count() > 2 for j in kept):
            kept.append(i)
    assert sorted(r.k for r in segments.kept_of_near(d, "k", "bits", 2, 3, 16).where("kept").collect()) == kept


@pytest.mark.parametrize(("n_bits", "distance", "bands"), [(48, 7, 8), (64, 8, 9), (10, 4, 7), (64, 0, 1), (5, 4, 5)])
def test_near_fingerprints_for_any_width(spark, n_bits, distance, bands):
    rnd = random.Random(n_bits)
    prints = list({rnd.getrandbits(n_bits) for _ in range(40)})
    prints = list(dict.fromkeys(prints + [p ^ (1 << rnd.randrange(n_bits)) ^ (1 << rnd.randrange(n_bits)) for p in prints[:20]]))
    d = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)], "k int, bits long")
    near = segments.near_fingerprints(d, "k", "bits", distance, bands, n_bits)
    want = {(i, j) for j, q in enumerate(prints) for i, p in enumerate(prints[:j]) if (p ^ q).bit_count() <= distance}
    assert {(r.a, r.b) for r in near.collect()} == want


def test_no_band_of_a_fingerprint_is_constant(spark, monkeypatch):
    # 48-bit prints that share no band hold no candidates: none may come from a band above the 48th bit.
    prints = [int("0" * 48, 2), int("1" * 48, 2), int("01" * 24, 2)]
    joined = []
    d = spark.createDataFrame(list(enumerate(prints)), "k int, bits long")
    join = type(d).join
    monkeypatch.setattr(type(d), "join", lambda self, *a, **k: joined.append(join(self, *a, **k)) or joined[-1])
    segments.near_fingerprints(d, "k", "bits", 7, 8, 48).collect()
    assert joined[0].where("a < b").count() == 0


def test_a_rare_unit_spelling_keeps_its_definition_and_its_links(spark):
    facts = "fact_id long, fiscal_year int, value double, unit string, source_unit string, sentence string, sheet string"
    # 120,000 mentions of the common spelling; one fact in a spelling met once, and six links, under a 10,000th of all, that give "zeur" its scale.
    many = spark.range(120_000).selectExpr("id as fact_id", "2020 as fiscal_year", "cast(id + 1 as double) as value", "'TEUR' as unit", "cast(null as string) as source_unit", "concat('Es waren EUR ', id + 1, '000.') as sentence", "'s' as sheet")
    rare = [(200_000, 2020, 2.0, "Mrd. Euro", None, None, "s")]
    rare += [(200_001 + i, 2020, float(i + 1), "Z EUR", None, f"Es waren EUR {i + 1}000000.", "s") for i in range(6)] + [(200_010, 2020, 3.0, "Z EUR", None, None, "s")]
    notes = spark.createDataFrame([], "note_id int, sheet string, row_no int, note_text string")
    got = {r.fact_id: r.eur_cents for r in units.to_euro_cents(many.unionByName(spark.createDataFrame(rare, facts)), notes).where("fact_id in (4, 200000, 200010)").collect()}
    assert got == {4: 5 * 1000 * 100, 200_000: 2 * 10**9 * 100, 200_010: 3 * 10**6 * 100}


def test_defined_scale_as_a_column(spark):
    names = ["eur", "teur", "eurmio", "tsdeurt", "mrdeurmrd", "stück", "xeur", "eurt eur", "'000eur", "t", "", None]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", units.defined(F.col("n")).alias("s")).collect()
    assert [r.s for r in got] == [None if n is None else units.defined_scale(n) for n in names]
