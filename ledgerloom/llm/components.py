"""Pairwise matches to groups: strip leaves, compress chains, solve the core, restore labels.

The graph is a table of edges between 64-bit row ids.

* Round 0 works on the pairs as they come, repeated ones included.  A vertex
  whose smallest and largest neighbour are one is a leaf: all leaves go at
  once.  Two leaves that are each other's neighbour are a group of two, told
  by the two marks their edge gets.
* Every later round removes the vertices of degree one or two that have the
  smallest random priority among their neighbours.  No two neighbours leave in
  one round (the independent-set step of list ranking), so a chain of any
  length loses a third of its vertices a round.  The two neighbours of a
  removed chain vertex are joined by a new edge; the vertex is remembered with
  one of them.

Removal is a grouped aggregate on the edge itself (a removed edge arrives once
more with a mark), never a join on a vertex.  Rounds go on while they shrink
the graph and it has more than ``core_edges`` edges.  The reduced core is
solved in one bounded task, or, if it is larger, by alternating large-star and
small-star rounds.  Labels then go back to the removed vertices, last round
first, and from ids to the keys.

Skew: a vertex, a key or a group with more than ``hot`` rows (at least 1/20,000
of all rows, so 40,000 such vertices exist at most) is joined by broadcast and
reduced by map-side combined aggregates; only colder ones meet in one task.
Ids of two keys may collide (likely only beyond some 10^9 keys); that is seen
when the labels meet the keys, and another seed is taken.

Defined results: keys compare in lower case, trimmed, white space collapsed;
pairs with a null or blank key or two equal keys are void; a null company is a
company of its own; repeated pairs and both directions count once; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ledgerloom.session import Scratch, release_shuffles

CORE_EDGES = 1_000_000
LEAST_ROUNDS = 2
#: The keys are labelled in so many (a power of two) slices of companies, so that only a slice of them is in shuffle files at once.
SLICES = 4
LEAST_SHRINK = 0.95
HOT_ROWS, HOT_SHARE = 100_000, 20_000
ID_COLUMNS = {"x", "y", "a", "b", "u", "v", "id", "root", "m"}
# The white space characters of Unicode besides the blank.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def untidy(left: Column, right: Column) -> Column:
    """Whether either key may hold other white space than single blanks inside; null if a key is null."""
    both = F.concat(F.lit("  "), left, F.lit("  "), right, F.lit("  ")).cast("binary")
    # A blank beside a key's end makes three in a row; the multi-byte blanks are met by their first bytes.
    inside = F.concat(left, F.lit("|"), right).cast("binary")
    marks = {c.encode()[: 2 if c >= "\u2000" else 3] for c in BLANKS}
    return reduce(Column.__or__, [F.contains(both, F.lit(b"   ")), F.contains(inside, F.lit(b"  ")), *(F.contains(inside, F.lit(m)) for m in sorted(marks))])


def tidy(c: Column, flag: Column) -> Column:
    """Lower case; where ``flag`` says so, trimmed and white space collapsed to one blank."""
    return F.lower(F.when(flag, F.trim(F.regexp_replace(F.translate(c, BLANKS, " " * len(BLANKS)), " +", " "))).otherwise(c))


def valid_pairs(pairs: DataFrame, scope: str, left: str, right: str) -> DataFrame:
    """scope, slice, l, r: tidied keys of the pairs that are not void.

    The optimizer copies a plain expression into the filter and into every use; behind explode each is evaluated once.
    """
    sides = pairs.select(F.col(scope).alias("scope"), F.col(left).alias("a"), F.col(right).alias("b")).where("a is not null and b is not null")
    d = sides.select("scope", "a", "b", F.explode(F.array(untidy(F.col("a"), F.col("b")))).alias("f"))
    d = d.select("scope", F.explode(F.array(F.struct(tidy(F.col("a"), F.col("f")).alias("l"), tidy(F.col("b"), F.col("f")).alias("r")))).alias("p"))
    return d.select("scope", F.pmod(F.xxhash64("scope"), F.lit(SLICES)).cast("int").alias("slice"), "p.*").where("l != '' and r != '' and l != r")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y")), F.struct(F.col("v").alias("x"), F.col("u").alias("y")))).alias("e")).select("e.*")


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Minimum labels with pointer jumping over one bounded set of edges."""
    parts = [b for b in batches if len(b)]
    if not parts:
        return
    edges = pd.concat(parts, ignore_index=True)
    ids, flat = np.unique(edges[["u", "v"]].to_numpy().ravel(), return_inverse=True)
    a, b = flat.reshape(-1, 2).T
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    yield pd.DataFrame({"id": ids, "root": ids[label]})


class _Rounds:
    """The written tables of one run and the size from which a vertex is hot."""

    def __init__(self, scratch: Scratch, hot: int):
        self.scratch, self.hot = scratch, hot

    def write(self, df: DataFrame, name: str, **seen: Column) -> tuple[DataFrame, dict]:
        """The written table and aggregates observed while it was written."""
        if not seen:
            return self.scratch.write(df, name, ID_COLUMNS & {*df.columns}), {}
        watch = Observation()
        table = self.scratch.write(df.observe(watch, *[c.alias(n) for n, c in seen.items()]), name, ID_COLUMNS & {*df.columns})
        return table, watch.get

    def labelled(self, rows: DataFrame, key: str, table: DataFrame, hot: DataFrame | None) -> DataFrame:
        """``rows`` with ``table``'s root where its id is ``key``; the ids of ``hot`` (bounded) are joined by broadcast."""
        meet = lambda d: d.join(table, F.col(key) == F.col("id"), "left").drop("id")
        if hot is None:
            return meet(rows)
        few = hot.select(F.col("x").alias("h"))
        known = few.join(table, F.col("h") == F.col("id"), "left").select("h", "root")
        warm = rows.join(F.broadcast(known), F.col(key) == F.col("h")).drop("h")
        return meet(rows.join(F.broadcast(few), F.col(key) == F.col("h"), "left_anti")).unionByName(warm)

    def stars(self, edges: DataFrame) -> DataFrame:
        """Alternating large-star and small-star rounds; id, root."""
        now = edges.select(F.col("v").alias("x"), F.col("u").alias("y"))
        seen, n = None, 0
        while True:
            both = now.unionByName(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
            large, _ = self.write(self._least(both, f"low{n}").where("y > x").select(F.col("y").alias("x"), F.col("root").alias("y")).where("x != y").distinct(), f"large{n}")
            met = self._least(large, f"lower{n}")
            low = self.scratch.spark.read.parquet(f"{self.scratch.root}/lower{n}").select("x", F.col("m").alias("y"))
            small = met.where("y != root").select(F.col("y").alias("x"), F.col("root").alias("y")).unionByName(low)
            small, mark = self.write(small.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).where("x != y").distinct(), f"small{n}", n=F.count("*"), s=F.sum(F.xxhash64("x", "y").cast("decimal(38,0)")))
            if mark == seen:
                roots = small.select(F.col("x").alias("id"), F.col("y").alias("root"))
                return roots.unionByName(small.select(F.col("y").alias("id"), F.col("y").alias("root")).distinct())
            for old in (f"low{n}", f"lower{n}", *([f"large{n - 1}", f"small{n - 1}"] if n else [])):
                self.scratch.drop(old)
            now, seen, n = small, mark, n + 1

    def _least(self, ends: DataFrame, name: str) -> DataFrame:
        """x, y, root: every directed edge with the smallest of its x and that vertex's neighbours."""
        low, top = self.write(ends.groupBy("x").agg(F.min("y").alias("m"), F.count("*").alias("n")).select("x", F.least("x", "m").alias("m"), "n"), name, most=F.max("n"))
        hot = low.where(F.col("n") > self.hot) if (top["most"] or 0) > self.hot else None
        return self.labelled(ends, "x", low.select(F.col("x").alias("id"), F.col("m").alias("root")), hot)


def _leaves(edges: DataFrame) -> DataFrame:
    """x, a, b (null), leaf, n of all leaves of a graph with repeated edges, and of its other vertices by their n."""
    around = _ends(edges).groupBy("x").agg(F.min("y").alias("a"), F.max("y").alias("b"), F.count("*").alias("n"))
    return around.select("x", "a", F.lit(None).cast("long").alias("b"), (F.col("a") == F.col("b")).alias("leaves"), "n")


def _removable(edges: DataFrame, round_no: int) -> DataFrame:
    """x, a, b (null for a leaf), leaves, n: the vertices of degree at most two with the smallest priority around them leave."""
    around = _ends(edges).groupBy("x").agg(F.min("y").alias("a"), F.max("y").alias("b"), F.count("*").alias("n"))
    rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(round_no)), F.col(c))
    least = (rank("x") < rank("a")) & (rank("x") < rank("b"))
    return around.select("x", "a", F.when(F.col("n") == 2, F.col("b")).alias("b"), ((F.col("n") <= 2) & least).alias("leaves"), "n")


def _reduced(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """u, v, marks of every edge, the new ones between the neighbours of chain vertices included."""
    marked = gone.select(F.explode(F.expr("filter(array(struct(least(x, a) AS u, greatest(x, a) AS v, 1L AS dead), struct(least(x, b) AS u, greatest(x, b) AS v, 1L AS dead), struct(least(a, b) AS u, greatest(a, b) AS v, 0L AS dead)), (e, i) -> i = 0 OR b IS NOT NULL)")).alias("e")).select("e.*")
    return edges.withColumn("dead", F.lit(0).cast("long")).unionByName(marked).groupBy("u", "v").agg(F.sum("dead").alias("dead"))


def connected(edges: DataFrame, rows: int, scratch: Scratch, core_edges: int = CORE_EDGES, hot: int = HOT_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """id, root for every vertex that is not its own root's only bearer (a missing vertex is its own root), and the vertices of more than ``hot`` edges.

    ``edges`` is a written table of ``rows`` rows (u, v) of bigint with u < v, which may repeat.
    """
    run = _Rounds(scratch, hot)
    left, gone, hubs, twins, r = rows, [], [], None, 0
    while left and (r < LEAST_ROUNDS or left > core_edges):
        found = _removable(edges, r) if r else _leaves(edges)
        table, top = run.write(found.where(F.col("leaves") | (F.col("n") > hot)), f"gone{r}", most=F.max("n"))
        hubs.append(table.where(F.col("n") > hot).select("x") if (top["most"] or 0) > hot else None)
        gone.append(table.where("leaves").select("x", "a", "b"))
        # In round 0 an edge with two marks is a group of two; later a leaf or chain vertex and its neighbour never both leave.
        reduced, count = run.write(_reduced(edges, gone[r]).where("dead != 1" if r == 0 else "dead = 0"), f"edges{r + 1}", n=F.count_if(F.col("dead") == 0))
        if r == 0:
            twins = reduced.where("dead > 1").select(F.explode(F.array("u", "v")).alias("id"), F.col("u").alias("root"))
        edges = reduced.where("dead = 0").select("u", "v")
        if r > 1:  # edges1 holds the groups of two
            scratch.drop(f"edges{r}")
        release_shuffles(scratch.spark)
        now, r = count["n"], r + 1
        shrunk, left = now <= LEAST_SHRINK * left, now
        if not shrunk:
            break
    known = [run.write(edges.coalesce(1).mapInPandas(_solve, "id long, root long") if left <= core_edges else run.stars(edges), "core")[0]]
    for i in reversed(range(r)):
        above = _union([*known, twins] if i == 0 else known)
        back = run.labelled(gone[i], "a", above, hubs[i])
        known.append(run.write(back.select(F.col("x").alias("id"), F.coalesce("root", "a").alias("root")), f"back{i}")[0])
        if i == 0 and hubs[0] is not None:
            hubs[0] = run.write(hubs[0], "hubs")[0]
        scratch.drop(f"gone{i}")
    for name in {f"edges{r}", "edges1"}:
        scratch.drop(name)
    return _union(known), hubs[0] if hubs else None


def match_groups(pairs: DataFrame, scope: str, left: str, right: str, core_edges: int = CORE_EDGES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per key in a valid pair: ``scope``, row_key, group_key (the group's smallest key by code points)."""
    spark = pairs.sparkSession
    valid = valid_pairs(pairs, scope, left, right)
    for seed in range(8):
        scratch = Scratch(spark, "components")
        # An id leaves its slice's number when divided by SLICES, so a slice's labels are found without its keys.
        row_id = lambda c: F.xxhash64(F.col("scope"), F.lit(seed), F.col(c)).bitwiseAND(F.lit(~(SLICES - 1))) + F.col("slice")  # noqa: B023, E731
        watch = Observation()
        named = scratch.write(valid.select("*", row_id("l").alias("li"), row_id("r").alias("ri")).observe(watch, F.count("*").alias("n")), "named", ["li", "ri"])
        edges = named.select(F.least("li", "ri").alias("u"), F.greatest("li", "ri").alias("v")).where("u != v")
        hot = max(hot_rows, watch.get["n"] // HOT_SHARE)
        labels, hubs = connected(edges, watch.get["n"], scratch, core_edges, hot)
        sizes, top = _Rounds(scratch, hot).write(labels.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > hot), "sizes", n=F.count("*"))
        giants = sizes.select(F.col("root").alias("giant")) if top["n"] else None
        parts, clash = [], 0
        for i in range(SLICES):
            side = lambda at, key: F.struct(F.col(at).alias("id"), "scope", F.col(key).alias("key"))
            ends = named.where(F.col("slice") == i).select(F.explode(F.array(side("li", "l"), side("ri", "r"))).alias("s")).select("s.*")
            if hubs is not None:
                few = F.broadcast(hubs.select(F.col("x").alias("h")))
                ends = ends.join(few, F.col("id") == F.col("h"), "left_anti").unionByName(ends.join(few, F.col("id") == F.col("h"), "left_semi").distinct())
            same = F.hash("scope", "key")
            rows = ends.repartition("id").groupBy("id").agg(F.first(F.struct("scope", "key")).alias("s"), (F.min(same) != F.max(same)).alias("clash"))
            own = labels.where(F.pmod(F.col("id"), F.lit(SLICES)) == i).withColumnRenamed("id", "lid")
            joined = rows.join(own, F.col("id") == F.col("lid"), "left").select("s.scope", "s.key", F.coalesce("root", "id").alias("root"), "clash")
            watch = Observation()
            parts.append(scratch.write(joined.observe(watch, F.count_if("clash").alias("n")), f"labelled{i}").drop("clash"))
            clash += watch.get["n"]
            release_shuffles(spark)
        if not clash:
            break
        scratch.drop("")
    else:
        raise RuntimeError("no collision-free row id found")
    for name in ("named", "core", "hubs", *(f"back{r}" for r in range(64))):
        scratch.drop(name)
    labelled = _union(parts)
    cold = labelled
    if giants is not None:
        cold = labelled.join(F.broadcast(giants), F.col("root") == F.col("giant"), "left_anti")
    out = cold.withColumn("group_key", F.min("key").over(Window.partitionBy("root")))
    if giants is not None:
        large = labelled.join(F.broadcast(giants), F.col("root") == F.col("giant")).drop("giant")
        least = large.groupBy("root").agg(F.min("key").alias("group_key")).withColumnRenamed("root", "giant")
        out = out.unionByName(large.join(F.broadcast(least), F.col("root") == F.col("giant")).drop("giant"))
    return out.select(F.col("scope").alias(scope), F.col("key").alias("row_key"), "group_key")
