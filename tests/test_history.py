"""Histories against plain Python on the whole table, and the bucketed store."""

from collections import defaultdict

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from ledgerloom.operators import history
from ledgerloom.plans import corpus
from tests.test_corpus_operators import RECORD, record


def plain_history(rows):
    tidy = lambda s: " ".join((s or "").split())
    newest = {}
    for r in rows:
        if r.entity_id is not None and r.snapshot_date is not None:
            k = (r.entity_id, r.snapshot_date)
            if k not in newest or (r.loaded_at, r.snapshot_id) > (newest[k].loaded_at, newest[k].snapshot_id):
                newest[k] = r
    per = defaultdict(list)
    for (e, _), r in sorted(newest.items()):
        per[e].append(r)
    out = set()
    for e, shots in per.items():
        for attribute in ("legal_name", "seat"):
            last, since = None, None
            for r in shots:
                v = tidy(getattr(r, attribute))
                if v and v != last:
                    if last:
                        out.add((e, attribute, last, str(since), str(r.snapshot_date)))
                    last, since = v, r.snapshot_date
            if last:
                out.add((e, attribute, last, str(since), ""))
        held, former, events = {tidy(r.legal_name) for r in shots}, {}, defaultdict(set)
        for r in shots:
            for n in r.historical_names or []:
                if tidy(n) and tidy(n) not in held:
                    former.setdefault(tidy(n), r.snapshot_date)
            for c in r.officer_changes or []:
                if c.effective_date:
                    for n in c.officers_removed or []:
                        events[("officer", tidy(n))].add((c.effective_date, 0))
                    for n in c.officers_added or []:
                        events[("officer", tidy(n))].add((c.effective_date, 1))
            for c in r.scope_changes or []:
                if c.effective_date and (c.change_kind or "").strip().lower() in ("entered", "left"):
                    events[("scope", tidy(c.entity))].add((c.effective_date, int(c.change_kind.strip().lower() == "entered")))
        out |= {(e, "legal_name", n, "", str(d)) for n, d in former.items()}
        for (attribute, entry), dated in events.items():
            since = None
            for i, (on, enters) in enumerate(sorted(dated)):
                if enters and since is None:
                    since = on
                elif not enters and since is not None:
                    out.add((e, attribute, entry, str(since), str(on)))
                    since = None
                elif not enters and i == 0:
                    out.add((e, attribute, entry, "", str(on)))
            if since is not None:
                out.add((e, attribute, entry, str(since), ""))
    return {r for r in out if r[2]}


@pytest.mark.parametrize("union_partitioning", ["true", "false"])
def test_p6_found_against_plain_python(spark, sf, union_partitioning):
    want = plain_history(spark.read.parquet(f"{sf}/entity_records.parquet").collect())
    spark.conf.set("spark.sql.unionOutputPartitioning", union_partitioning)
    got = [tuple(r) for r in corpus.p6_found(spark, sf).collect()]
    spark.conf.unset("spark.sql.unionOutputPartitioning")
    assert len(got) == len(set(got))
    assert set(got) == want


def test_many_touched_entities_are_met_on_a_salted_key(spark, monkeypatch):
    rows = [record(i, f"e{i % 7}", "ABC"[i % 3], "X", 1 + i % 25, 1 + i % 5) for i in range(70)]
    raw = spark.createDataFrame(rows, RECORD).repartition(8)
    want = sorted(map(tuple, history.build_history(raw.where("entity_id in ('e1', 'e2')")).collect()))
    monkeypatch.setattr(history.mapping, "small", lambda d: d)
    touched = spark.createDataFrame([("e1",), ("e2",)], "entity_id string")
    assert sorted(map(tuple, history.build_history(history._of(raw, touched, "snapshot_id")).collect())) == want


def test_store_rewrites_touched_buckets_only_and_loses_no_update(spark, tmp_path):
    raw = spark.createDataFrame([record(i, f"e{i}", "A", "X", 1) for i in range(40)], RECORD)
    store = history.HistoryStore(spark, f"file://{tmp_path}/h", buckets=8)
    store.update(raw, raw)
    first = store._folders(1)
    late = spark.createDataFrame([record(100, "e3", "B", "X", 5), record(101, None, "B", "X", 5)], RECORD)
    store.update(raw.unionByName(late), late)
    second = store._folders(2)
    assert sum(first[b] != second[b] for b in first) == 1
    assert sorted(map(tuple, store.current().collect())) == sorted(map(tuple, history.build_history(raw.unionByName(late)).collect()))
    # A writer that started from version 1 finds version 2 taken.
    with pytest.raises(Py4JJavaError):
        store._publish(first, 2)
    assert store._folders(2) == second
    store.vacuum()
    assert store.versions() == [2]
    assert store.current().where(F.col("entity_id") == "e3").count() == 3
    store.update(raw.unionByName(late), late.where("entity_id is null"))
    assert store._folders(3) == second
