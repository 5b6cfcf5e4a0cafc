"""Evidence behind figures: provenance, stated one-offs, footnotes, profiles as relational projections.

Every check emits the rows to look at; an empty result means that all is well.

Defined results: provenance without document, sheet or row is none; a null
amount states nothing; ties go to the smallest key; empty inputs give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def provenance_key(doc: Column, sheet: Column, row: Column) -> Column:
    """struct(doc, sheet, row) of a usable provenance, else null."""
    return F.when((F.trim(doc) != "") & (F.trim(sheet) != "") & row.isNotNull(), F.struct(doc.alias("doc"), sheet.alias("sheet"), row.alias("row")))


def normal_label(label: Column) -> Column:
    """Lower case, trimmed, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), r"\s+", " "))


def is_revenue(label: Column) -> Column:
    return F.contains(normal_label(label), F.lit("revenue"))


def is_ebitda(label: Column) -> Column:
    return F.contains(normal_label(label), F.lit("ebitda"))


def is_cost(label: Column) -> Column:
    """Whether a label names a cost by one of its usual words."""
    return normal_label(label).rlike("aufwendung|kosten|abschreibung|material|personal|steuer|zinsen")


def first_filled(*columns: Column) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in columns])


def reported_footnote(year: Column, value: Column, direction: Column, text: Column) -> Column:
    """The footnote that must stand under reported earnings that hold a stated one-off."""
    amount = F.format_string("%.1f", F.abs(value) / 1_000_000)
    return F.concat(F.lit("FY"), year.cast("string"), F.lit(" reported EBITDA includes a €"), amount, F.lit("m stated one-off ("), F.coalesce(direction, F.lit("unknown")), F.lit("): "), F.coalesce(text, F.lit("")))


def stated(facts: DataFrame, value: str, unit: Column, doc: str, sheet: str, row: str) -> DataFrame:
    """Facts with an amount in euros and usable provenance, with provenance."""
    return facts.where(F.col(value).isNotNull() & unit).withColumn("provenance", provenance_key(F.col(doc), F.col(sheet), F.col(row))).where("provenance is not null")


def material(facts: DataFrame, revenue: DataFrame, keys: list[str], value: str, share: float, floor: float) -> DataFrame:
    """Facts that reach ``floor``, and ``share`` of their key's revenue (none counts as zero)."""
    r = revenue.select(*keys, F.col("revenue"))
    return facts.join(r, keys, "left").where(F.abs(value) >= F.greatest(F.lit(floor), F.coalesce(F.abs("revenue"), F.lit(0.0)) * share)).drop("revenue")


def untraced_adjustments(adjustments: DataFrame, one_offs: DataFrame, amount: str, value: str) -> DataFrame:
    """Adjustments without a stated one-off of the same provenance and the same absolute amount."""
    a = adjustments.withColumn("__amount", F.abs(amount))
    o = one_offs.select("provenance", F.abs(value).alias("__amount")).distinct()
    return a.join(o, ["provenance", "__amount"], "left_anti").drop("__amount")


def required_by_year(years: DataFrame, rows: DataFrame, scope: list[str], year: str, code: str, required: list[str], document: str) -> DataFrame:
    """scope, year, missing code and the note that confirms it: the document is the code's own of another year, else the year's, else named by the year."""
    want = years.select(*scope, year).distinct().withColumn(code, F.explode(F.array(*[F.lit(x) for x in required])))
    lacking = want.join(rows.select(*scope, year, code).distinct(), [*scope, year, code], "left_anti")
    own = rows.groupBy(*scope, code).agg(F.min(document).alias("__own"))
    of_year = rows.groupBy(*scope, year).agg(F.min(document).alias("__year"))
    d = lacking.join(own, [*scope, code], "left").join(of_year, [*scope, year], "left")
    doc = F.coalesce("__own", "__year", F.concat(F.lit("FY"), F.col(year).cast("string"), F.lit(" filing")))
    return d.select(*scope, year, code, F.concat(F.lit("Confirm "), F.col(code), F.lit(" is absent from "), doc, F.lit(", or map it.")).alias("note"))


def merged_rows(rows: DataFrame, keys: list[str], year: str, value: str, metadata: list[str]) -> tuple[DataFrame, DataFrame]:
    """One row per key with its years' values as a map, and the keys refused: metadata that differs or is missing, or two values of a year."""
    per_year = rows.where(F.col(value).isNotNull()).groupBy(*keys, year).agg(F.countDistinct(value).alias("__n"), F.min(value).alias("__v"))
    values = per_year.groupBy(*keys).agg(F.max("__n").alias("__n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(year), F.col("__v"))))).alias("values"))
    seen = rows.groupBy(*keys).agg(*[F.countDistinct(F.coalesce(F.col(m).cast("string"), F.lit("\0"))).alias(f"__d_{m}") for m in metadata], *[F.count_if(F.col(m).isNull()).alias(f"__m_{m}") for m in metadata], *[F.min(m).alias(m) for m in metadata])
    problem = F.array_compact(F.array(*[F.when(F.col(f"__m_{m}") > 0, f"{m} missing").when(F.col(f"__d_{m}") > 1, f"{m} differs") for m in metadata], F.when(F.col("__n") > 1, "values conflict")))
    d = seen.join(values, keys, "left").withColumn("problems", problem)
    return d.where(F.size("problems") == 0).select(*keys, *metadata, "values"), d.where(F.size("problems") > 0).select(*keys, "problems")


def series_rows(series: DataFrame, ids: str, rows: DataFrame, code: str) -> DataFrame:
    """Rows of every series by its list of codes."""
    return series.withColumn(code, F.explode(F.array_distinct(ids))).drop(ids).join(rows, code)


def assigned(assignments: DataFrame, series: DataFrame, key: str, overrides: list[str]) -> DataFrame:
    """Series that a slot names; fields of the assignment count before those of the series; unknown ids drop out."""
    s = series.select(F.col(key).alias("__id"), *[F.col(c).alias(f"__{c}") for c in series.columns if c != key])
    rest = [c for c in series.columns if c != key and c not in overrides]
    return assignments.join(s, F.col(key) == F.col("__id")).select("slot", key, *[F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) for c in overrides], *[F.col(f"__{c}").alias(c) for c in rest])


def ordered_distinct(rows: DataFrame, scope: list[str], order: list[str], text: str) -> DataFrame:
    """scope, n, text: trimmed non-empty texts once each, in the order they are first met."""
    t = rows.withColumn("__t", F.trim(text)).where("__t != ''")
    first = t.groupBy(*scope, "__t").agg(F.min(F.struct(*order)).alias("__o"))
    return first.select(*scope, F.row_number().over(Window.partitionBy(*scope).orderBy("__o", "__t")).alias("n"), F.col("__t").alias(text))


def chart_points(rows: DataFrame, keys: list[str], year: str, value: str) -> DataFrame:
    """keys, year, millions of series whose years are unique; a series with a year twice is left out."""
    twice = rows.groupBy(*keys, year).agg(F.count("*").alias("__n")).where(F.col("__n") > 1).select(*keys).distinct()
    return rows.join(twice, keys, "left_anti").select(*keys, year, (F.col(value) / 1_000_000).alias("millions"))


def profile_blocks(points: DataFrame, company: str, year: str, value: str, geography: DataFrame) -> DataFrame:
    """company, block_id, slot, kind, coverage, confidence, n_points: the revenue series, and a gap block for everything without evidence."""
    g = points.where(F.col(value).isNotNull()).groupBy(company).agg(F.countDistinct(year).alias("n"), (F.max(year) - F.min(year) + 1).alias("span"))
    cover = F.round(F.col("n") / F.col("span"), 6)
    g = g.join(geography.select(company).distinct().withColumn("__geo", F.lit(True)), company, "left")
    row = lambda block, slot, kind, coverage, confidence, n: F.struct(F.lit(block).alias("block_id") if isinstance(block, str) else block.alias("block_id"), F.lit(slot).alias("slot"), F.lit(kind).alias("kind"), coverage.alias("coverage"), confidence.alias("confidence"), n.alias("n_points"))
    none, low = F.lit(0.0), F.lit("low")
    geo = F.when(F.coalesce("__geo", F.lit(False)), "geo.revenue_split_unimplemented").otherwise("geo.revenue_split_gap")
    sure = F.when(cover >= 0.9, "high").when(cover >= 0.6, "medium").otherwise("low")
    zero = F.lit(0).cast("bigint")
    blocks = F.array(
        row("fin.revenue_series", "top_right", "chart.column_line", cover, sure, F.col("n")), row("bo.business_overview_gap", "top_left", "bullets", none, low, zero),
        row("prod.product_grid_gap", "bottom_left", "bullets", none, low, zero), row(geo, "bottom_right", "bullets", none, low, zero),
    )
    return g.select(company, F.explode(blocks).alias("b")).select(company, "b.*")


def folded(log: DataFrame, scope: list[str], order: list[str], reset: Column, value: str) -> DataFrame:
    """scope, value: state after an ordered log of actions, the last value since the last reset."""
    w = Window.partitionBy(*scope).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = log.withColumn("__era", F.sum(F.when(reset, 1).otherwise(0)).over(w))
    last = d.where(~reset & F.col(value).isNotNull()).groupBy(*scope, "__era").agg(F.max_by(value, F.struct(*order)).alias(value))
    final = d.groupBy(*scope).agg(F.max("__era").alias("__era"))
    return final.join(last, [*scope, "__era"], "left").select(*scope, value)


def rows_of_words(words: DataFrame, page: str, top: str, left: str, word: str, bucket: float = 3.0) -> DataFrame:
    """page, line, cells: words on one height (in buckets) from left to right, pages with two such lines of which one has two words."""
    line = F.bround(F.col(top) / bucket).cast("int")
    g = words.groupBy(page, line.alias("line")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(left).alias("x"), F.col(word).alias("w")))), lambda s: s["w"]).alias("cells"))
    w = Window.partitionBy(page)
    return g.withColumn("__n", F.count("*").over(w)).withColumn("__w", F.max(F.size("cells")).over(w)).where("__n >= 2 and __w >= 2").drop("__n", "__w")


def average_hash(pixels: Column, n: int = 64) -> Column:
    """Hexadecimal fingerprint of ``n`` grey values: a bit is set where a value reaches their mean."""
    mean = F.aggregate(F.slice(pixels, 1, n), F.lit(0.0), lambda a, x: a + x.cast("double")) / n
    bit = lambda x: F.when(x.cast("double") >= mean, "1").otherwise("0")
    bits = F.array_join(F.transform(F.slice(pixels, 1, n), bit), "")
    return F.lower(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n // 4 - 1)), lambda i: F.conv(F.substring(bits, i * 4 + 1, F.lit(4)), 2, 16)), ""))
