"""Parent-child rows to full hierarchies by bottom-up leaf peeling.

Round r removes every node without a living child and sends one combined
message to each parent: how many children left, and the size of their
subtrees.  Messages are pre-aggregated before the shuffle, so a parent of a
third of all rows costs one row per task.  Once the living rest is small
(``core_rows``, counted from the written table's footers) its remaining rounds
run in one task; as long as it is not, distributed rounds go on, so no size
breaks the operator (a tree takes as many rounds as it is high, and no tree is
higher than its paths, which are part of the result, are long).  What cannot be
peeled contains the cycles.  The rounds are then taken back in reverse order:
every node gets its path, depth and root from its parent.  A code below a cycle
inherits the cycle mark the same way.  Children of a parent with more than
``skew.HOT_ROWS`` of them meet it by broadcast.

Defined results: codes and parents compare trimmed and without case; a null or
blank code is no node; of several rows for one code the one with the smallest
order key counts; a null, blank or unknown parent makes a root; a node that
names itself is a cycle.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ledgerloom.operators import skew
from ledgerloom.session import Scratch

CORE_ROWS = 200_000
ROUNDS_BEFORE_CORE = 4
OUT = "key string, up string, code string, size long, path array<string>"
CHUNK = 200_000


def tidy_key(c: Column) -> Column:
    """Without surrounding white space (any Unicode blank) and case."""
    return F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def _solve_core(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Peel the rest and walk it back; a null path marks a node in or below a cycle."""
    parts = [b for b in batches if len(b)]
    if not parts:
        return
    rest = pd.concat(parts, ignore_index=True)
    n = len(rest)
    ids = pd.Series(np.arange(n), index=rest["key"].to_numpy())
    up = ids.reindex(rest["up"].to_numpy()).fillna(-1).to_numpy().astype(np.int64)
    size = rest["size"].to_numpy().astype(np.int64).copy()
    pending = np.bincount(up[up >= 0], minlength=n)
    order: list[int] = []
    wave = np.flatnonzero(pending == 0)
    while len(wave):
        order.extend(wave.tolist())
        told = wave[up[wave] >= 0]
        np.add.at(size, up[told], size[told] + 1)
        np.subtract.at(pending, up[told], 1)
        heads = np.unique(up[told])
        wave = heads[pending[heads] == 0]
    code = rest["code"].tolist()
    children: dict[int, list[int]] = defaultdict(list)
    peeled = np.zeros(n, dtype=bool)
    peeled[order] = True
    for i in np.flatnonzero(peeled & (up >= 0)).tolist():
        children[int(up[i])].append(i)
    rows: list[tuple[int, list[str] | None]] = [(i, None) for i in np.flatnonzero(~peeled).tolist()]
    # What hangs below a cycle is in it; the trees are walked depth first with one path, given out in chunks of bounded length.
    lost = [i for i, _ in rows]
    while lost:
        below = children.pop(lost.pop(), [])
        rows += [(i, None) for i in below]
        lost += below
    used = 0

    def chunk() -> pd.DataFrame:
        at = [i for i, _ in rows]
        return pd.DataFrame({"key": rest["key"].iloc[at].to_numpy(), "up": rest["up"].iloc[at].to_numpy(), "code": rest["code"].iloc[at].to_numpy(), "size": size[at], "path": [p for _, p in rows]})

    path: list[str] = []
    stack = [(int(i), 0) for i in np.flatnonzero(peeled & (up < 0))]
    code = rest["code"].tolist()
    while stack:
        i, depth = stack.pop()
        del path[depth:]
        path.append(code[i])
        rows.append((i, list(path)))
        used += depth + 1
        stack += [(x, depth + 1) for x in children.get(i, [])]
        if used > CHUNK:
            yield chunk()
            rows, used = [], 0
    if rows:
        yield chunk()


def build_hierarchy(df: DataFrame, code: str, parent: str, order: str, core_rows: int = CORE_ROWS, hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """One row per node: key, code, root_code, depth, path (array), n_descendants, in_cycle."""
    scratch = Scratch(df.sparkSession, "hierarchy")
    named = df.select(F.col(code).alias("code"), tidy_key(F.col(code)).alias("key"), tidy_key(F.col(parent)).alias("up"), F.col(order).alias("o")).where(F.col("key") != "")
    nodes = named.groupBy("key").agg(F.min(F.struct("o", "code", "up")).alias("v")).select("key", "v.code", "v.up")
    nodes = scratch.write(nodes, "nodes")
    linked = skew.join_unique(nodes, "up", nodes.select(F.col("key").alias("known")), "known", hot_rows).select("key", "code", F.col("known").alias("up"))
    linked = scratch.write(linked, "linked")
    kids = linked.where("up is not null").groupBy(F.col("up").alias("k")).agg(F.count("*").alias("pending"))
    alive = linked.join(kids, F.col("key") == F.col("k"), "left").select("key", "up", "code", F.lit(0).cast("long").alias("size"), F.coalesce("pending", F.lit(0)).alias("pending"))
    watch = Observation()
    alive = scratch.write(alive.observe(watch, F.max("pending").alias("most"), F.count("*").alias("n")), "alive0")
    limit = max(hot_rows, watch.get["n"] // skew.HOT_SHARE)
    # A parent of many children is hot in whatever round they leave.
    hot = alive.where(F.col("pending") > limit).select(F.col("key").alias("up")) if (watch.get["most"] or 0) > limit else None
    left, peeled, stuck, r = alive.count(), [], False, 0
    while left and not stuck and (r < ROUNDS_BEFORE_CORE or left > core_rows):
        leaves = alive.where("pending = 0")
        told = leaves.where("up is not null").groupBy(F.col("up").alias("k")).agg(F.count("*").alias("gone"), F.sum(F.col("size") + 1).alias("more"))
        rest = alive.where("pending > 0").join(told, F.col("key") == F.col("k"), "left").select(
            "key", "up", "code", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"), (F.col("pending") - F.coalesce("gone", F.lit(0))).alias("pending")
        )
        after = scratch.write(rest, f"alive{r + 1}")
        now = after.count()
        stuck = now == left
        if not stuck:
            peeled.append(leaves)
        alive, left, r = after, now, r + 1
    if stuck or not left:
        done = alive.select("key", "up", "code", "size", F.lit(None).cast("array<string>").alias("path"))
    else:
        done = alive.select("key", "up", "code", "size").coalesce(1).mapInPandas(_solve_core, OUT)
    done = scratch.write(done, "core")
    finished = [done]
    for i, leaves in reversed(list(enumerate(peeled))):
        above = finished[0]
        for other in finished[1:]:
            above = above.unionByName(other)
        heads = above.select(F.col("key").alias("k"), F.col("path").alias("head"))
        placed = skew.join_hot(leaves, "up", heads, "k", hot).select(
            "key", "up", "code", "size",
            F.when(F.col("up").isNull(), F.array("code")).otherwise(F.concat("head", F.array("code"))).alias("path"),
        )
        finished.append(scratch.write(placed, f"placed{i}"))
    whole = finished[0]
    for other in finished[1:]:
        whole = whole.unionByName(other)
    loop = F.col("path").isNull()
    return whole.select(
        "key", "code",
        F.when(loop, "CYCLE").otherwise(F.element_at("path", 1)).alias("root_code"),
        F.when(loop, -1).otherwise(F.size("path") - 1).cast("int").alias("depth"),
        "path",
        F.when(loop, -1).otherwise(F.col("size")).cast("int").alias("n_descendants"),
        loop.alias("in_cycle"),
    )


def descendant_pairs(hierarchy: DataFrame) -> DataFrame:
    """ancestor, descendant, distance of every node outside cycles: the descendant lists in relational form."""
    up = hierarchy.where("not in_cycle").select("code", "path", F.posexplode("path").alias("level", "ancestor"))
    return up.where(F.col("level") < F.size("path") - 1).select("ancestor", F.col("code").alias("descendant"), (F.size("path") - 1 - F.col("level")).cast("int").alias("distance"))
