"""Filling containers of fixed capacity, with the mixture of sources held in every window.

Sizes are tokens.  A text longer than the capacity is split into full pieces
and a rest; nothing else is ever split.  Each source is a queue in a fixed
order.  Deficit round-robin gives a source ``share * window`` tokens of every
window and carries what a whole item overdraws or leaves into the next window.
Summed up, the item whose tokens begin at position p of its queue is served at
time p / share; by that time all queues together have served
``V(t) = sum(min(share * t, tokens))``, a queue that runs dry leaving its part of
every later window to the others, and the window is ``floor(V / window)``.  That
closed form needs only a running sum per queue, which is computed in two levels
(sums of hash blocks, then within a block), so deficits carry across windows and
partitions without any task holding a queue.

Target proportions are given per source; sources without one share what is left
by their tokens, and without any the mixture is the sources' natural one.

A window has a bounded number of tokens, so its items are packed best-fit
decreasing in one group of bounded size.  Containers are numbered by window.

Defined results: null and empty texts have no tokens and take no space: they
come out with container -1; a null source is a source of its own; ties are
broken by key; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import Scratch

CAPACITY = 2_048
WINDOW = 256
BLOCK_BITS, BLOCK_ITEMS = 10, 50_000


def pieces(sized: DataFrame, key: str, source: str, capacity: int = CAPACITY) -> DataFrame:
    """key, source, piece_no, first_token, n_tokens: items of at most one capacity."""
    n = F.col("n_tokens")
    count = F.greatest(F.lit(1), F.ceil(n / capacity)).cast("int")
    cut = sized.select(F.col(key).alias("key"), F.col(source).alias("source"), n.alias("n"), F.explode(F.sequence(F.lit(0), count - 1)).alias("piece_no"))
    return cut.select("key", "source", "piece_no", (F.col("piece_no") * capacity).alias("first_token"), F.least(F.lit(capacity), F.col("n") - F.col("piece_no") * capacity).alias("n_tokens"))


def mixture_shares(totals: DataFrame, target: dict[str | None, float] | None) -> DataFrame:
    """source, tokens, share: the target's share of a source, or its part, by tokens, of what the target leaves (of all, if it leaves nothing)."""
    named = {k: v for k, v in (target or {}).items() if v > 0}
    left = max(0.0, 1.0 - sum(named.values())) or 1.0
    rows = [(k, v) for k, v in named.items()]
    wanted = totals.sparkSession.createDataFrame(rows, f"s {dict(totals.dtypes)['source']}, wanted double") if rows else None
    t = totals.join(F.broadcast(wanted), F.col("source").eqNullSafe(F.col("s")), "left").drop("s") if rows else totals.withColumn("wanted", F.lit(None).cast("double"))
    rest = t.agg(F.sum(F.when(F.col("wanted").isNull(), F.col("tokens"))).alias("rest"))
    return t.crossJoin(F.broadcast(rest)).select("source", "tokens", F.coalesce("wanted", F.lit(left) * F.col("tokens") / F.col("rest")).alias("share"), F.col("wanted").isNotNull().alias("named"))


def mixture_windows(items: DataFrame, shares: DataFrame, window_tokens: int, block_bits: int = BLOCK_BITS) -> DataFrame:
    """``items`` with window_no, by deficit round-robin over the source queues. ``shares``: source, tokens, share, named."""
    spread = items.withColumn("order_key", F.xxhash64("key", "piece_no"))
    # Blocks split each queue by the order key's range, so no task ever holds a queue.
    blocks = F.shiftrightunsigned("order_key", 64 - block_bits).cast("int")
    b = spread.withColumn("block", blocks)
    sums = b.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens"))
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(F.col("source").alias("s"), F.col("block").alias("k"), before.alias("offset"))
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("source", "block").orderBy(F.shiftleft("order_key", block_bits), "key", "piece_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = b.withColumn("inside", inside).join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("k"))).drop("s", "k")
    given = placed.join(shares.select(F.col("source").alias("s"), "share"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # The sources without a target run dry together, so they are one queue here: as many queues as targets, and one.
    queues = shares.groupBy(F.when(F.col("named"), F.xxhash64("source")).alias("q")).agg(F.sum("share").alias("share"), F.sum("tokens").cast("double").alias("tokens"))
    all_queues = queues.agg(F.collect_list(F.struct("share", "tokens")).alias("queues"))
    served = F.aggregate("queues", F.lit(0.0), lambda v, q: v + F.least(q["share"] * F.col("time"), q["tokens"]))
    timed = given.withColumn("time", (F.col("offset") + F.col("inside")) / F.col("share")).crossJoin(F.broadcast(all_queues))
    return timed.withColumn("window_no", F.floor(served / window_tokens).cast("long")).drop("order_key", "block", "offset", "inside", "share", "time", "queues")


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """Container number of each size: largest first, each into the fullest container that still takes it."""
    where = [0] * len(sizes)
    room: list[tuple[int, int]] = []
    made = 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect.bisect_left(room, (sizes[i], -1))
        free, box = room.pop(at) if at < len(room) else (capacity, made)
        made += box == made
        where[i] = box
        if free > sizes[i]:
            bisect.insort(room, (free - sizes[i], box))
    return where


def pack(sized: DataFrame, key: str, source: str, capacity: int = CAPACITY, window: int = WINDOW, share: dict[str | None, float] | None = None) -> DataFrame:
    """container_id, window_no, ``key``, ``source``, piece_no, first_token, n_tokens.

    ``sized`` has ``key``, ``source`` and n_tokens. ``share`` holds target
    proportions of sources (None for the natural ones); a window holds ``window`` capacities.
    """
    scratch = Scratch(sized.sparkSession, "packing")
    items = scratch.write(pieces(sized, key, source, capacity), "items")
    full = items.where("n_tokens > 0")
    shares = scratch.write(mixture_shares(full.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), share), "shares")
    # Blocks grow in number with the queues: a few ten thousand items each, whatever their total.
    bits = max(BLOCK_BITS, math.ceil(math.log2(max(1, items.count()) / BLOCK_ITEMS)))
    windows = mixture_windows(full, shares, capacity * window, bits)

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "key", "piece_no"], ascending=[False, True, True], ignore_index=True)
        pdf["box"] = best_fit(pdf["n_tokens"].tolist(), capacity)
        return pdf[["window_no", "box", "key", "source", "piece_no", "first_token", "n_tokens"]]

    types = dict(items.dtypes)
    out = f"window_no long, box int, key {types['key']}, source {types['source']}, piece_no int, first_token int, n_tokens int"
    boxed = windows.select("window_no", "key", "source", "piece_no", F.col("first_token").cast("int"), F.col("n_tokens").cast("int")).groupBy("window_no").applyInPandas(fill, out)
    packed = boxed.withColumn("container_id", F.col("window_no") * F.lit(4 * window) + F.col("box"))
    empty = items.where("n_tokens <= 0").select(F.lit(-1).cast("long").alias("container_id"), F.lit(-1).cast("long").alias("window_no"), "key", "source", "piece_no", F.col("first_token").cast("int"), F.col("n_tokens").cast("int"))
    cols = ["container_id", "window_no", "key", "source", "piece_no", "first_token", "n_tokens"]
    return packed.select(*cols).unionByName(empty.select(*cols)).withColumnRenamed("key", key).withColumnRenamed("source", source)
