"""Quantities recorded in different units, brought to euros.

A *source* here is a spelling of a unit: every spelling met in a unit column,
in a sentence or in a sheet's remark is one node.  Rows that state one quantity
under two spellings (the value column beside the amount its own sentence gives)
link two nodes.  ``pair_scales`` estimates a pair robustly (median log ratio,
the share of links that agree, the median offset left after scaling).  For the
propagation every link is a vote: its ratio, snapped to the known conversions,
says what one spelling is worth in the other, and a link that is none of them,
or that leaves an offset beyond the tolerance, votes against.  From the anchor
``eur`` on, a spelling is accepted by the votes of all its accepted neighbours
together, the clearest first; so many weak pairs add up, and a few wrong
statements are outvoted.  A spelling composed of known unit words has some
votes of the anchor more, its definition, so spellings too rare for statistics
are still reached.  Spellings that no path joins to the anchor (one that names
no currency needs many votes that all but agree; pieces, heads, per cent, square
metres) have no scale, and their rows no amount.

All work but the propagation is JVM-side and aggregated.  Every link counts,
however rare its spellings: the votes, one row per pair and ratio, are
propagated in one task, whose memory grows with them, and the scale table goes
back to the rows by a join on the spelling.  A spelling in no such pair has its
definition, read off the spelling itself in its row.  Nothing reaches the driver.

Defined results: an amount marked as the prior year's or the plan's is not the
fact's own; a null or blank unit is no unit; null sentences state nothing; a
value that is null or not finite is missing; half cents round away from zero.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.once import once
from ledgerloom.operators import mapping
from ledgerloom.session import Scratch

# The words units are made of, and the conversions a scale may snap to.
CURRENCY = "EUROS?|EUR|€"
SCALE_WORDS = {
    "tsd": 1e3, "tausend": 1e3, "thousand": 1e3, "thousands": 1e3, "t": 1e3, "k": 1e3, "'000": 1e3, "000": 1e3,
    "mio": 1e6, "mill": 1e6, "million": 1e6, "millionen": 1e6, "millions": 1e6, "m": 1e6, "mn": 1e6,
    "mrd": 1e9, "milliarde": 1e9, "milliarden": 1e9, "billion": 1e9, "billions": 1e9, "bn": 1e9,
}
NUMBER_WORDS = {
    "null": 0, "ein": 1, "eine": 1, "einer": 1, "einen": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9, "zehn": 10, "elf": 11, "zwölf": 12,
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12,
}
CONVERSIONS = (1.0, 1e3, 1e6, 1e9)
DEFINITION_WEIGHT = 5
AGREEMENT, STRICT_AGREEMENT = 0.6, 0.95
LEAST_LINKS = 5
TOLERANCE = 0.02

_WORDS = "Tsd|Tausend|thousands?|Mio|Mill|Millionen|millions?|Mrd|Milliarden?|billions?|bn|mn|T|k|m"
_SPELLED = r"(?:minus )?(?:" + "|".join(NUMBER_WORDS) + r")(?=[ \x{A0}])"
_NUM = r"[-–−]?(?:\d{1,3}(?:[.,'’\x{A0}\x{202F}\x{2009}]\d{3})+(?:[.,]\d{1,2})?(?!\d)|\d+(?:[.,]\d+)?)"
_BEFORE = rf"(?<![\p{{L}}\d])((?:(?:{_WORDS})\.?[- \x{{A0}}]?)?(?:{CURRENCY}))(?!\p{{L}})[ \x{{A0}}]?({_NUM})(?:[ \x{{A0}}]?({_WORDS})\.?(?![\p{{L}}\d]))?"
_AFTER = rf"(?<![\p{{L}}\d.,])({_NUM}|{_SPELLED})[ \x{{A0}}]?((?:(?:{_WORDS})\.?[- \x{{A0}}]?)?(?:{CURRENCY})(?:[ \x{{A0}}](?:{_WORDS})(?!\p{{L}}))?)(?!\p{{L}})(?![ \x{{A0}}]?[-–−]?\d)"
AMOUNT = rf"(?iu:{_BEFORE}|{_AFTER})"
NAMED = rf"(?iu)(?<![\p{{L}}\d])((?:(?:{_WORDS})\.?[- \x{{A0}}]?)?(?:{CURRENCY})(?: ?'000| (?:{_WORDS})(?!\p{{L}}))?)(?!\p{{L}})"
# Words that mark an amount as the prior year's, the plan's or another comparison, right before or right after it.
PRIOR_BEFORE = r"(?iu)(?:\b(?:vj|vorjahr|vorjahres|vorjahreswert|prior year|previous year|compared with|compared to|after|following|nach|gegenüber|statt|versus|vs|noch|up from|down from|from|geplant|geplante|planned|plan|budget|instead of)\b[.:]?\s*(?:von|of|mit|war|was|waren|were|only|nur)?\s*[(:]?\s*)$"
PRIOR_AFTER = r"(?iu)^\s*(?:im vorjahr|im jahr zuvor|im vorjahreszeitraum|in the prior year|in the previous year|a year earlier|the year before|last year|\(vorjahr\)|\(vj\.?\)|laut plan|as planned)"
ENGLISH = r"(?iu)\b(?:the|of|were|was|operating|charges|items|and|with)\b"
MARK, PART = "\u0003", "\u0004"


def spelling(unit: Column) -> Column:
    """Node name of a unit: lower case, without blanks, dots, hyphens and introductory words."""
    bare = F.regexp_replace(F.lower(unit), r"(?iu)\b(?:in|vollen|ganzen|full|werte|angabe|angaben|beträge)\b", " ")
    return F.nullif(F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"[\s\p{Z}.:\-]+", ""), "€", "eur"), "euros?|eur(?=o)", "eur"), F.lit(""))


def bare_digits(text: Column) -> Column:
    """A printed number without its sign and without marks that only group; number words as digits."""
    spelled = F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in (kv[0], str(kv[1]))])
    plain = F.regexp_replace(text, r"[-–−'’\x{A0}\x{202F}\x{2009}]", "")
    return F.when(text.rlike(r"\d"), plain).otherwise(spelled[F.regexp_replace(F.lower(text), "^minus ", "")])


def number(t: Column, minus: Column, english: Column) -> Column:
    """Decimal of bare digits; a lone mark before exactly three digits groups thousands in its own language only."""
    dots, commas = F.length(t) - F.length(F.replace(t, F.lit("."), F.lit(""))), F.length(t) - F.length(F.replace(t, F.lit(","), F.lit("")))
    no_dot, no_comma, comma_decimal = F.replace(t, F.lit("."), F.lit("")), F.replace(t, F.lit(","), F.lit("")), F.translate(t, ",.", ".")
    grouped = t.rlike(r"^[1-9]\d{0,2}[.,]\d{3}$")
    plain = (
        F.when((dots > 0) & (commas > 0), F.when(F.instr(F.reverse(t), ",") < F.instr(F.reverse(t), "."), comma_decimal).otherwise(no_comma))
        .when(dots > 1, no_dot)
        .when(commas > 1, no_comma)
        .when((dots == 1) & ~english & grouped, no_dot)
        .when((commas == 1) & english & grouped, no_comma)
        .when(commas == 1, comma_decimal)
        .otherwise(t)
    )
    return plain.try_cast("decimal(30,6)") * F.when(minus, -1).otherwise(1).cast("decimal(1,0)")


def stated_amounts(df: DataFrame, sentence: str, fiscal_year: str) -> DataFrame:
    """``df`` with own (struct number, unit: the first amount that is the fact's own) and named (a unit the sentence names)."""
    parts = F.split(F.regexp_replace(F.col(sentence), AMOUNT, f"{MARK}$1{PART}$2{PART}$3{PART}$4{PART}$5{MARK}"), MARK)
    d = once(df, __a=parts, __en=F.col(sentence).rlike(ENGLISH))
    at = F.when(F.size("__a") > 1, F.sequence(F.lit(1), F.size("__a") - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
    d = once(d, __f=F.transform(at, lambda i: F.struct(F.element_at("__a", i).alias("before"), F.split(F.element_at("__a", i + 1), PART).alias("f"), F.element_at("__a", i + 2).alias("after"))))
    prior_year = (F.col(fiscal_year) - 1).cast("string")

    def read(x: Column) -> Column:
        f, after = x["f"], x["after"]
        digits = F.when(f[1] != "", f[1]).otherwise(f[3])
        earlier = F.coalesce(F.regexp_extract(after, r"(?iu)^\s*(?:in|im jahr|for|für|\()\s*((?:19|20)\d\d)\b", 1) == prior_year, F.lit(False))
        prior = x["before"].rlike(PRIOR_BEFORE) | after.rlike(PRIOR_AFTER) | earlier
        return F.struct(bare_digits(digits).alias("t"), digits.rlike("(?i)^(?:[-–−]|minus )").alias("minus"), spelling(F.concat(f[0], f[2], f[4])).alias("unit"), prior.alias("prior"))

    rest = F.array_join(F.filter("__a", lambda x, i: i % 2 == 0), " ")
    d = once(d, __m=F.transform("__f", read), __n=spelling(F.regexp_extract(rest, NAMED, 1)))
    own = F.filter(F.transform("__m", lambda x: F.struct(number(x["t"], x["minus"], F.col("__en")).alias("number"), x["unit"].alias("unit"), x["prior"].alias("prior"))), lambda x: ~x["prior"] & x["number"].isNotNull())
    named = F.coalesce("__n", F.get(F.col("__m"), F.lit(0))["unit"])
    return once(d, own=F.get(own, F.lit(0)), named=named).drop("__a", "__en", "__f", "__m", "__n")


def pair_scales(links: DataFrame) -> DataFrame:
    """a, b, n, scale (value in b = scale * value in a), agreement, offset from links (a, b, x, y)."""
    exponent = F.log10(F.abs(F.col("y")) / F.abs(F.col("x")))
    use = links.where("x != 0 and y != 0 and a is not null and b is not null and a != b").withColumn("e", exponent)
    middle = use.groupBy("a", "b").agg(F.percentile_approx("e", 0.5, 1000).alias("median"), F.count("*").alias("n"))
    known = F.array(*[F.lit(math.log10(p / q)) for p in CONVERSIONS for q in CONVERSIONS])
    snapped = F.element_at(F.array_sort(F.transform(known, lambda k: F.struct(F.abs(k - F.col("median")).alias("d"), k.alias("k")))), 1)["k"]
    m = middle.withColumn("k", snapped)
    back = use.join(m.select(F.col("a").alias("a2"), F.col("b").alias("b2"), "k"), (F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2")))
    scaled = F.col("x") * F.pow(F.lit(10.0), F.col("k"))
    near = F.abs(F.col("e") - F.col("k")) <= TOLERANCE
    return back.groupBy("a", "b").agg(
        F.count("*").alias("n"), F.first(F.pow(F.lit(10.0), F.col("k"))).alias("scale"), F.avg(near.cast("double")).alias("agreement"),
        F.percentile_approx(F.when(near, F.col("y") - scaled), 0.5, 1000).alias("offset"),
    )


def defined_scale(name: str) -> float | None:
    """Scale of a spelling that is a currency with known unit words around it, else None."""
    if "eur" not in name:
        return None
    words = name.replace("eur", " ").split()
    scale = 1.0
    for w in words:
        if w not in SCALE_WORDS:
            return None
        scale *= SCALE_WORDS[w]
    return scale if scale in CONVERSIONS else None


def defined(name: Column) -> Column:
    """``defined_scale`` of a column."""
    known = F.create_map(*[F.lit(x) for kv in SCALE_WORDS.items() for x in kv])
    words = F.filter(F.split(F.replace(name, F.lit("eur"), F.lit(" ")), r"[\s\p{Z}]+"), lambda w: w != "")
    scale = F.aggregate(words, F.lit(1.0), lambda product, w: product * F.try_element_at(known, w))
    return F.when(F.contains(name, F.lit("eur")) & scale.isin(*CONVERSIONS), scale.cast("int"))


def votes(links: DataFrame) -> DataFrame:
    """a, b, k, n: links by pair and by the power of ten they say b's value is of a's; k is null where no conversion fits."""
    use = links.where("x != 0 and y != 0 and a is not null and b is not null and a != b")
    exponent = F.log10(F.abs(F.col("y")) / F.abs(F.col("x")))
    k = F.round(exponent / 3).cast("int") * 3
    fits = (F.abs(exponent - k) <= TOLERANCE) & (F.abs(k) <= 9)
    return use.groupBy("a", "b", F.when(fits, k).alias("k")).agg(F.count("*").alias("n"))


def propagate(said: list[tuple[str, str, int | None, int]], anchor: str = "eur", defined: Callable[[str], float | None] = defined_scale) -> dict[str, float]:
    """Scale to the anchor of every spelling that the votes (a, b, k, n) of its accepted neighbours carry, the clearest first.

    A currency's spelling needs ``LEAST_LINKS`` votes, ``AGREEMENT`` of them for one scale, or, when nothing else is left,
    two that all agree; another spelling ten times as many, and ``STRICT_AGREEMENT``.
    """
    near: dict[str, list[tuple[str, int | None, int]]] = defaultdict(list)
    for a, b, k, n in said:
        near[a].append((b, k, n))
        near[b].append((a, None if k is None else -k, n))
    known = [int(math.log10(c)) for c in CONVERSIONS]
    pool: dict[str, Counter] = defaultdict(Counter)
    for name in near:
        if name != anchor and (c := defined(name)) is not None:
            pool[name][int(math.log10(c))] += DEFINITION_WEIGHT
    found: dict[str, int] = {}
    heap: list[tuple[float, str, int]] = []

    def offer(name: str) -> None:
        """What the votes so far make of a spelling: weight (0 to 1 for a last resort) and power of ten."""
        total = sum(pool[name].values())
        best, n = max(((k, n) for k, n in pool[name].items() if k in known), key=lambda x: (x[1], -x[0]), default=(0, 0))
        money = "eur" in name
        if n and total >= (LEAST_LINKS if money else 10 * LEAST_LINKS) and n >= (AGREEMENT if money else STRICT_AGREEMENT) * total:
            heapq.heappush(heap, (-float(2 * n - total), name, best))
        elif money and n >= 2 and n == total:
            heapq.heappush(heap, (-1 / (LEAST_LINKS - n + 1), name, best))

    def accept(name: str, power: int) -> None:
        found[name] = power
        for other, k, n in near[name]:
            if other not in found:
                # ``other`` holds 10**k times the number that ``name`` holds, so one of it is worth 10**-k of that.
                pool[other][None if k is None else power - k] += n
                offer(other)

    for name in pool:
        offer(name)
    accept(anchor, 0)
    while heap:
        weight, name, power = heapq.heappop(heap)
        if name in found:
            continue
        before = len(heap)
        offer(name)  # votes that came later may have changed the mind
        if len(heap) == before:
            continue
        now = max((x for x in heap if x[1] == name), key=lambda x: -x[0])
        if now[0] > weight or now[2] != power:
            continue
        accept(name, power)
    return {name: 10.0**power for name, power in found.items()}


def sheet_units(notes: DataFrame) -> DataFrame:
    """sheet, declared: the money unit a sheet's remarks declare, the topmost such remark if there are several."""
    named = notes.select("sheet", "row_no", "note_id", spelling(F.regexp_extract("note_text", NAMED, 1)).alias("u")).where("u is not null and sheet is not null")
    return named.groupBy("sheet").agg(F.min_by("u", F.struct("row_no", "note_id")).alias("declared"))


def prepared(facts: DataFrame, notes: DataFrame) -> DataFrame:
    """One row per fact: own amount, value, the spelling the value is in (by precedence)."""
    d = stated_amounts(facts.select("fact_id", "fiscal_year", "value", "unit", "source_unit", "sentence", "sheet"), "sentence", "fiscal_year")
    d = d.join(sheet_units(notes).withColumnRenamed("sheet", "s"), F.col("sheet") == F.col("s"), "left")
    blank = lambda c: F.nullif(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), F.lit(""))
    unit, source = blank(F.col("unit")), blank(F.col("source_unit"))
    value = F.when(~F.isnan("value") & (F.abs("value") < 1e24), F.col("value"))
    d = once(d, u=spelling(unit), su=spelling(source))
    return d.select("fact_id", "own", value.alias("value"), "u", "su", "named", "declared", F.coalesce("u", "su", "named", "declared").alias("value_unit"))


def scale_graph(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The estimated pairs, and the scales propagated from the anchor to the spellings in pairs (name, scale)."""
    links = rows.where("own is not null and value is not null").select(F.col("own.unit").alias("a"), F.coalesce("u", "su").alias("b"), F.col("own.number").cast("double").alias("x"), F.col("value").alias("y"))
    # The value is worth scale(b) each, the amount scale(a) each: the same quantity, so y * scale(b) = x * scale(a).
    pairs = pair_scales(links)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        said = [(r.a, r.b, None if r.k != r.k else int(r.k), int(r.n)) for b in batches for r in b.itertuples(index=False)]
        found = propagate(said)
        yield pd.DataFrame({"name": list(found), "scale": [int(v) for v in found.values()]})

    return pairs, votes(links).repartition(1).mapInPandas(run, "name string, scale int")


def to_euro_cents(facts: DataFrame, notes: DataFrame) -> DataFrame:
    """fact_id, eur_cents: one row per fact with a money amount whose unit is known."""
    scratch = Scratch(facts.sparkSession, "units")
    rows = scratch.write(prepared(facts, notes), "prepared")
    return apply_scales(rows, scratch.write(scale_graph(rows)[1], "scales"))


def apply_scales(rows: DataFrame, scales: DataFrame) -> DataFrame:
    """The fact's own amount decides; else the value in the unit of precedence. scales: name, scale of the spellings in pairs."""
    scales = mapping.small(scales)
    d = rows.withColumn("own_unit", F.col("own.unit")).join(scales.toDF("own_unit", "own_scale"), "own_unit", "left").join(scales.toDF("value_unit", "held_scale"), "value_unit", "left")
    own, held = F.coalesce("own_scale", defined(F.col("own_unit"))), F.coalesce("held_scale", defined(F.col("value_unit")))
    cents = lambda x, s: F.round(x.cast("decimal(30,6)") * s.cast("decimal(10,0)") * F.lit(100).cast("decimal(3,0)"), 0).try_cast("bigint")
    amount = F.when(F.col("own").isNotNull() & own.isNotNull(), cents(F.col("own.number"), own)).when(F.col("value").isNotNull() & held.isNotNull(), cents(F.col("value"), held))
    return d.select("fact_id", amount.alias("eur_cents")).where("eur_cents is not null")
