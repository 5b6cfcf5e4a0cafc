"""Match groups against union-find."""

import random

import pytest

from ledgerloom.llm.components import match_groups


def brute(pairs):
    up = {}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for s, a, b in pairs:
        a, b = (" ".join((x or "").split()).lower() for x in (a, b))
        if a and b and a != b:
            for x in ((s, a), (s, b)):
                up.setdefault(x, x)
            x, y = find((s, a)), find((s, b))
            if x != y:
                up[max(x, y, key=str)] = min(x, y, key=str)
    groups = {}
    for x in up:
        groups.setdefault(find(x), []).append(x)
    return {(s, k, min(m[1] for m in members)) for members in groups.values() for s, k in members}


def graph():
    rnd = random.Random(5)
    chain = [("c", f"n{i}", f"n{i + 1}") for i in range(200)]
    star = [("c", "hub", f"leaf {i}") for i in range(150)]
    dense = [("d", f"k{rnd.randrange(20)}", f"K{rnd.randrange(20)} ") for _ in range(200)]
    cycle = [("e", f"z{i}", f"z{(i + 1) % 9}") for i in range(9)]
    odd = [("c", None, "x"), ("c", " ", "x"), ("c", "same", " SAME"), (None, "p", "q"), ("c", "a  b", "A\tb c"), ("e", "n0", "n1"), ("c", "n1", "n0"), ("c", "é", "z")]
    return chain + star + dense + cycle + odd + chain[:20]


@pytest.mark.parametrize(("core", "hot"), [(0, 100_000), (0, 3), (40, 20), (1_000_000, 5)])
def test_against_union_find(spark, core, hot):
    pairs = graph()
    d = spark.createDataFrame(pairs, "scope string, a string, b string")
    got = [tuple(r) for r in match_groups(d, "scope", "a", "b", core, hot).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(pairs)


def test_nothing_and_clashing_columns(spark):
    d = spark.createDataFrame([], "scope string, a string, b string")
    assert match_groups(d, "scope", "a", "b").count() == 0
    d = spark.createDataFrame([("s", "x", "y", 1, "r")], "scope string, a string, b string, id int, root string")
    assert sorted(map(tuple, match_groups(d, "scope", "a", "b").collect())) == [("s", "x", "x"), ("s", "y", "x")]


def test_a_repeated_pair_and_a_hub_are_hot(spark):
    pairs = [("s", "a", "b")] * 60 + [("s", "hub", f"l{i:02d}") for i in range(40)] + [("s", f"l{i:02d}", f"m{i:02d}") for i in range(0, 40, 3)] + [("t", "a", "B")]
    d = spark.createDataFrame(pairs, "scope string, a string, b string")
    got = [tuple(r) for r in match_groups(d, "scope", "a", "b", 1_000_000, 10).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(pairs)


@pytest.mark.parametrize("seed", range(3))
def test_random_forests(spark, seed):
    rnd = random.Random(seed)
    pairs = [("s", f"v{i}", f"v{rnd.randrange(max(0, i - 30), i)}") for i in range(1, 400) if rnd.random() < 0.9] + [("s", f"v{rnd.randrange(400)}", f"v{rnd.randrange(400)}") for _ in range(8)]
    d = spark.createDataFrame(pairs, "scope string, a string, b string")
    assert {tuple(r) for r in match_groups(d, "scope", "a", "b", 20, 4).collect()} == brute(pairs)
