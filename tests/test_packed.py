"""Packed fields against a plain character loop, and the cases the docstring defines."""

import re

from ledgerloom.operators.packed import cut_fields, separators, split_packed
from ledgerloom.session import table

CLOSE = {'"': '"', "'": "'", "(": ")"}


def brute(field):
    s = (field or "").strip()
    if re.fullmatch(r"\[[^\[\]]*\]", s, re.S):
        s = s[1:-1]
    out, cur, i = [], "", 0
    while i < len(s):
        c = s[i]
        if c in CLOSE:
            j = i + 1
            while j < len(s) and not (s[j] == CLOSE[c] and (c == "(" or s[j + 1 : j + 2] != c)):
                j += 2 if c != "(" and s[j] == c and s[j + 1 : j + 2] == c else 1
            if j < len(s):
                cur += s[i : j + 1]
                i = j + 1
                continue
        if m := re.match(r"(?<= )(?:und|sowie|u\.)(?= )", s[i:]) if i and s[i - 1] == " " and False else (re.compile(r"(?:und|sowie|u\.) ").match(s, i) if i and s[i - 1] == " " else None):
            out.append(cur)
            cur = ""
            i = m.end() - 1
            continue
        if not (c.isalnum() or c in " .-_()[]{}\"'"):
            out.append(cur)
            cur = ""
        else:
            cur += c
        i += 1
    out.append(cur)

    def bare(x):
        x = x.strip()
        for q in "\"'":
            if re.fullmatch(f"{q}(?:[^{q}]|{q}{q})*{q}", x, re.S):
                x = x[1:-1].replace(q * 2, q)
        return x.strip()

    return [v for v in map(bare, out) if v]


def test_against_brute_force(spark, sf):
    d = table(spark, sf.replace("0.001", "0.01"), "pnl_format_bridge")
    got = {}
    for k, no, item in split_packed(d, "bridge_id", "company_normalized", "ukv_codes").collect():
        got.setdefault(k, {})[no] = item
    for k, field in d.select("bridge_id", "ukv_codes").collect():
        want = brute(field)
        mine = got.get(k, {})
        assert [mine[i] for i in sorted(mine)] == want, field
        assert sorted(mine) == list(range(1, len(want) + 1))


def rows(spark, fields, source="s"):
    d = spark.createDataFrame([(i, source, f) for i, f in enumerate(fields)], "k int, src string, f string")
    return d, {i: [r.item for r in sorted(split_packed(d, "k", "src", "f").where(f"k = {i}").collect(), key=lambda r: r.item_no)] for i in range(len(fields))}


def test_defined_cases(spark):
    _, got = rows(spark, ['A-1; "x;y" und A-2', None, "", "  ", ";;", '"A-1 ""b"""', "A-1 (a, b), A-2", '["A-1", "A-1"]', "A-1", "A-1\r\nA-2", 'A-1 "offen, A-2'])
    assert got[0] == ["A-1", "x;y", "A-2"]
    assert got[1] == got[2] == got[3] == got[4] == []
    assert got[5] == ['A-1 "b"']
    assert got[6] == ["A-1 (a, b)", "A-2"]
    assert got[7] == ["A-1", "A-1"]
    assert got[8] == ["A-1"]
    assert got[9] == ["A-1", "A-2"]
    assert len(got[10]) == 2


def test_null_source_and_empty_table(spark):
    _, got = rows(spark, ["A-1, A-2"], None)
    assert got[0] == ["A-1", "A-2"]
    d = spark.createDataFrame([], "k int, src string, f string")
    assert split_packed(d, "k", "src", "f").count() == 0


def test_a_mark_inside_pieces_is_no_separator(spark):
    fields = [f"A-{i}, B-{i}" for i in range(100)] + [f"A-{i}, §x§y§ B-{i}" for i in range(2)]
    d = spark.createDataFrame([(i, "s", f) for i, f in enumerate(fields)], "k int, src string, f string")
    score = {r.sep: r.accepted for r in separators(cut_fields(d, "k", "src", "f")).collect()}
    assert score[","] and not score["§"]


def test_clashing_columns(spark):
    d = spark.createDataFrame([(1, "s", "A-1; A-2", "x", "y")], "k int, src string, f string, item string, source string")
    assert [r.item for r in split_packed(d, "k", "src", "f").orderBy("item_no").collect()] == ["A-1", "A-2"]


def test_a_source_may_have_a_shape_of_its_own(spark):
    # The corpus's pieces look like A-1; one source, a fiftieth of all rows, writes #7#a and separates by "~".
    rows = [(i, "many", f"A-{i}; B-{i}") for i in range(2_000)] + [(10_000 + i, "own", f"7 {i} x~8 {i} y") for i in range(40)]
    d = spark.createDataFrame(rows, "k int, src string, f string")
    got = {(r.k, r.item_no): r.item for r in split_packed(d, "k", "src", "f").where("k >= 10000").collect()}
    assert len(got) == 80 and got[(10_003, 2)] == "8 3 y"


def test_a_source_of_most_rows_is_hot(spark, monkeypatch):
    from ledgerloom.operators import skew

    d = spark.createDataFrame([(i, "big" if i % 3 else "small", f"A-{i}, B-{i}") for i in range(90)], "k int, src string, f string")
    want = sorted(map(tuple, split_packed(d, "k", "src", "f").collect()))
    monkeypatch.setattr(skew.hot_keys, "__defaults__", (5,))
    assert sorted(map(tuple, split_packed(d, "k", "src", "f").collect())) == want and len(want) == 180
