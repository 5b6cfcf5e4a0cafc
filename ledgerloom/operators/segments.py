"""Segment sheets, fact sentences, image fingerprints, slots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import numbers, text
from ledgerloom.functions.once import once
from ledgerloom.operators.series import carry_forward
from ledgerloom.session import Scratch


def section_rows(rows: DataFrame, scope: list[str], order: list[str], label: str) -> DataFrame:
    """``rows`` with section (product, geography) carried down, headings, totals and blank labels left out."""
    t = F.lower(F.col(label))
    kind = F.when(t.rlike(r"(?:^|\s)(?:a|i)\.\s*segmente?(?:[^a-z]|$)"), "product").when(t.rlike(r"(?:^|\s)(?:b|ii)\.\s*absatzm[aä]rkte(?:[^a-z]|$)"), "geography")
    d = carry_forward(rows.withColumn("__kind", kind), scope, order, "__kind")
    total = t.rlike("(?:brutto|netto)umsatz")
    return d.where(F.col("__kind").isNull() & F.col("section").isNotNull() & ~total & (F.trim(F.col(label)) != "")).drop("__kind")


def fact_sentences(rows: DataFrame, keys: list[str], body: str, sheet: str) -> DataFrame:
    """One row per fact a sentence states: keys, sentence_no, kind, fiscal_year, unit, amounts, direction, metric, pnl_line, dates.

    The unit of the sentence counts, else the one its text as a whole names.
    """
    s = rows.select(*keys, F.col(sheet).alias("__sheet"), F.col(body).alias("__body"), F.posexplode(text.sentences(F.col(body))).alias("sentence_no", "sentence"))
    # Few sentences state a fact: the others are left out before anything else is read from them.
    s = once(s, kinds=text.fact_kinds(F.col("sentence"))).where(F.size("kinds") > 0)
    s = once(s, __unit=F.coalesce(numbers.source_unit(F.col("sentence")), numbers.source_unit(F.col("__body"))))
    s = once(s, amounts=numbers.prose_amounts(F.col("sentence"), F.col("__unit"))).drop("__body")
    f = s.select(*keys, "sentence_no", "sentence", numbers.sheet_year(F.col("__sheet")).alias("fiscal_year"), "amounts", F.when(F.size("amounts") > 0, F.col("__unit")).alias("source_unit"), F.explode("kinds").alias("kind"))
    c = F.col("sentence")
    return f.select(
        *keys, "sentence_no", "kind", "fiscal_year", F.get("amounts", F.lit(0)).alias("value"), F.get("amounts", F.lit(1)).alias("prior_year_value"), "source_unit",
        text.direction(c).alias("direction"), text.metric(c).alias("metric"), text.pnl_line(c).alias("pnl_line"), text.scope_change(c).alias("change"), text.dates(c).alias("dates"), "sentence",
    )


def column_units(cells: DataFrame, scope: list[str], first: int = 12) -> DataFrame:
    """scope, col_no, unit (PCT, EUR or null), thousands: what the first rows of a column say."""
    t = F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), " "))
    thousands = F.col("t").rlike(r"t€|teur|teuro|tsd\.")
    unit = F.when(F.col("t").rlike("%|prozent"), "PCT").when(thousands | F.col("t").rlike("€|eur"), "EUR")
    return cells.where(F.col("row_no") < first).groupBy(*scope, "col_no").agg(t.alias("t")).select(*scope, "col_no", unit.alias("unit"), thousands.alias("thousands"))


def segment_figures(sheets: DataFrame, key: str, title: str, rows: str) -> tuple[DataFrame, DataFrame]:
    """Figures of segment sheets (segment_name, segment_type, fiscal_year, metric, value, unit, basis, ``key``, row_no), and reviews (``key``, reason).

    Columns count if one of the first twelve rows names a year and no change against another, and a unit is stated.
    Only the first section of a type counts; gross beats net as its basis, and none is a review.  Of one figure in
    several sheets the one filed for its own year counts, else the newest; differing ones are left out and reviewed.
    """
    grid = sheets.select(key, title, F.posexplode(rows).alias("row_no", "r")).select(key, title, "row_no", F.posexplode("r").alias("col_no", "text"))
    label = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "\n", " "))
    lines = grid.where("col_no = 0").select(key, "row_no", label.alias("label"))
    t = F.lower("label")
    kind = F.when(t.rlike(r"(?:^|\s)(?:a|i)\.\s*segmente?(?:[^a-z]|$)"), "product").when(t.rlike(r"(?:^|\s)(?:b|ii)\.\s*absatzm[aä]rkte(?:[^a-z]|$)"), "geography")
    w = Window.partitionBy(key).orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    d = lines.withColumn("kind", kind).withColumn("segment_type", F.last("kind", ignorenulls=True).over(w)).withColumn("section_no", F.sum(F.col("kind").isNotNull().cast("int")).over(w))
    firsts = d.where("kind is not null").groupBy(key, "segment_type").agg(F.min("section_no").alias("section_no"))
    body = d.where("kind is null and segment_type is not null").join(firsts, [key, "segment_type", "section_no"])
    basis = body.groupBy(key, "segment_type").agg(F.max(F.contains(t, F.lit("bruttoumsatz")).cast("int")).alias("g"), F.max(F.contains(t, F.lit("nettoumsatz")).cast("int")).alias("n"))
    basis = basis.select(key, "segment_type", F.when(F.col("g") == 1, "bruttoumsatzerloese").when(F.col("n") == 1, "nettoumsatzerloese").alias("basis"))
    head = grid.where("row_no < 12 and col_no > 0")
    moved = F.lower(F.concat_ws(" ", "text", F.lead("text", 1).over(Window.partitionBy(key, "col_no").orderBy("row_no")), F.lead("text", 2).over(Window.partitionBy(key, "col_no").orderBy("row_no")))).rlike("veränderung|veraenderung|zum vorjahr")
    years = head.withColumn("year", numbers.max_year(F.col("text"))).withColumn("moved", moved).where("year is not null and not moved").join(column_units(grid, [key]).where("unit is not null"), [key, "col_no"])
    top = years.groupBy(key).agg(F.min("row_no").alias("row_no"))
    columns = years.join(top, [key, "row_no"]).select(key, "col_no", "year", "unit", "thousands")
    name = F.trim(F.regexp_replace("label", r"^\s*(?:\d+[.)]|[a-z]\))\s*", ""))
    named = body.where((F.col("label") != "") & ~t.rlike("(?:brutto|netto)umsatz|erlösschmäler|erloesschmaeler|^summe|^gesamt")).withColumn("segment_name", name).where("segment_name != ''")
    values = grid.join(columns, [key, "col_no"]).join(named.select(key, "row_no", "segment_type", "segment_name"), [key, "row_no"]).withColumn("v", numbers.segment_number(F.col("text"))).where("v is not null")
    figures = values.join(basis, [key, "segment_type"], "left").select(
        "segment_name", "segment_type", F.col("year").alias("fiscal_year"), F.when(F.col("unit") == "PCT", "revenue_share").otherwise("revenue").alias("metric"),
        F.when((F.col("unit") == "EUR") & F.col("thousands"), F.col("v") * 1000).otherwise(F.col("v")).alias("value"), "unit", "basis", numbers.max_year(F.col(title)).alias("doc_year"), key, "row_no",
    )
    ids = [F.lower("segment_name").alias("k"), "segment_type", "fiscal_year", "metric"]
    variants = F.size(F.collect_set(F.struct(F.col("value"), F.col("unit"), F.coalesce("basis", F.lit("-")))))
    best = F.max_by(F.struct("segment_name", "value", "unit", "basis", key, "row_no"), F.struct((F.col("doc_year") == F.col("fiscal_year")).cast("int"), F.coalesce("doc_year", F.lit(0)), -F.col(key), -F.col("row_no")))
    g = figures.groupBy(*ids).agg(variants.alias("n"), best.alias("b"))
    kept = g.where("n = 1").select("b.segment_name", "segment_type", "fiscal_year", "metric", "b.value", "b.unit", "b.basis", f"b.{key}", "b.row_no")
    clash = g.where("n > 1").select(F.col(f"b.{key}").alias(key), F.concat(F.lit("conflicting duplicate disclosure for "), F.col("b.segment_name"), F.lit(" FY"), F.col("fiscal_year")).alias("reason"))
    unstated = basis.where("basis is null").select(key, F.concat("segment_type", F.lit(" table has no explicit gross/net revenue basis")).alias("reason"))
    return kept, clash.unionByName(unstated)


def exact_copies(rows: DataFrame, key: str, content: str) -> DataFrame:
    """key, content hash, kept: the smallest key of every distinct content."""
    h = rows.select(key, F.sha2(F.col(content), 256).alias("sha"))
    first = h.groupBy("sha").agg(F.min(key).alias("kept"), F.count("*").alias("n_copies"))
    return first.join(h, "sha").select(key, "sha", "kept", "n_copies")


def sign_bits(vector: str, n: int = 64) -> str:
    """SQL of a 64-bit fingerprint: bit i is set where component i is positive."""
    bits = " | ".join(f"shiftleft(CAST(IF({vector}[{i}] > 0, 1, 0) AS BIGINT), {i})" for i in range(n))
    return f"({bits})"


def near_fingerprints(prints: DataFrame, key: str, bits: str, distance: int, bands: int, n_bits: int = 64) -> DataFrame:
    """a, b, distance of all fingerprint pairs within ``distance`` bits, between representatives of equal fingerprints.

    By the pigeonhole principle two prints within d < bands bits agree in a whole band, so candidates come from an equi-join on
    (band, bits of the band); more bands than errors make it complete.  The lowest ``n_bits`` bits, the only ones a print uses,
    are dealt to the bands evenly, so that every band has some.
    """
    if bands <= distance:
        raise ValueError("completeness needs more bands than errors")
    if not bands <= n_bits <= 64:
        raise ValueError("every band needs a bit, and a fingerprint has 64 at most")
    starts = [b * n_bits // bands for b in range(bands + 1)]
    reps = prints.groupBy(bits).agg(F.min(key).alias("k"))
    parts = [F.shiftrightunsigned(bits, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1 if hi - lo < 64 else -1)) for lo, hi in zip(starts, starts[1:], strict=False)]
    cut = reps.select("k", F.col(bits).alias("h"), F.explode(F.array(*[F.struct(F.lit(b).alias("band"), part.cast("bigint").alias("part")) for b, part in enumerate(parts)])).alias("x")).select("k", "h", "x.*")
    a, b = cut.toDF("a", "ha", "band", "part"), cut.toDF("b", "hb", "band", "part")
    near = F.bit_count(F.col("ha").bitwiseXOR(F.col("hb")))
    return a.join(b, ["band", "part"]).where(F.col("a") < F.col("b")).select("a", "b", near.alias("distance")).where(F.col("distance") <= distance).distinct()


def kept_of_near(prints: DataFrame, key: str, bits: str, distance: int, bands: int, n_bits: int = 64) -> DataFrame:
    """``key``, kept: going by key, a print is kept unless it equals, or lies within ``distance`` bits of, an earlier kept one.

    Each round decides every print whose earlier neighbours are all decided; only undecided pairs are read again.
    """
    scratch = Scratch(prints.sparkSession, "near")
    pairs = scratch.write(near_fingerprints(prints, key, bits, distance, bands, n_bits).select("a", "b"), "pairs")
    left, decided, n = pairs, None, 0
    while left.limit(1).count():
        waiting = left.select(F.col("b").alias("w")).distinct()
        # A print that waits for nobody is kept; what lies near it is dropped.
        kept = left.select("a").distinct().join(waiting, F.col("a") == F.col("w"), "left_anti")
        dropped = left.join(kept.withColumnRenamed("a", "k"), F.col("a") == F.col("k"), "left_semi").select(F.col("b").alias("a")).distinct()
        new = scratch.write(dropped, f"dropped{n}")
        decided = new if decided is None else decided.unionByName(new)
        gone = new.withColumnRenamed("a", "g")
        rest = left.join(gone, F.col("b") == F.col("g"), "left_anti").join(gone, F.col("a") == F.col("g"), "left_anti")
        left, n = scratch.write(rest, f"left{n + 1}"), n + 1
    reps = prints.groupBy(bits).agg(F.min(key).alias("__rep"))
    out = prints.join(reps, bits).select(F.col(key).alias("__k"), (F.col(key) == F.col("__rep")).alias("__first"))
    if decided is not None:
        out = out.join(decided.withColumn("__near", F.lit(True)), F.col("__k") == F.col("a"), "left").drop("a")
    near = F.coalesce(F.col("__near"), F.lit(False)) if decided is not None else F.lit(False)
    return out.select(F.col("__k").alias(key), (F.col("__first") & ~near).alias("kept"))
