"""Sinks: canonical JSON, CSV per table, review queue, library snapshots, styled cells, templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import labels


def canonical_json(actuals: DataFrame, path: str, by: list[str]) -> None:
    """One JSON line per group, its rows as an array in year and code order."""
    rest = [c for c in actuals.columns if c not in by]
    actuals.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("rows")).write.mode("overwrite").json(path)


def csv_per_table(cells: DataFrame, path: str) -> None:
    """Cells to one folder of CSV per table, rows in order, without header."""
    lines = cells.groupBy("table_id", "row_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_no", F.coalesce("text", F.lit("")).alias("text")))), lambda x: quoted(x["text"])).alias("c"))
    lines.select("table_id", "row_no", F.array_join("c", ",").alias("value")).repartition("table_id").sortWithinPartitions("table_id", "row_no").drop("row_no").write.mode("overwrite").partitionBy("table_id").text(path)


def quoted(text: Column) -> Column:
    """A CSV field: quoted where it holds a comma, quote or line break."""
    return F.when(text.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_with_mark(rows: DataFrame, path: str) -> None:
    """Rows to CSV that spreadsheet programs read as UTF-8: every file begins with a byte order mark, in the header's first name."""
    first, *rest = rows.columns
    rows.select(F.col(first).alias("\ufeff" + first), *rest).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def append_rows(rows: DataFrame, path: str, order: str = "at") -> None:
    """Rows to an append-only store; readers take the last row of a key by ``order``."""
    rows.withColumn(order, F.current_timestamp()).write.mode("append").json(path)


def segment_queue(reviews: DataFrame, path: str) -> None:
    """Review rows (sheet, reason) of segment sheets, rewritten by every run."""
    reviews.select("sheet", "reason").orderBy("sheet", "reason").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def feedback_manifest(tables: DataFrame, key: str, note: str, path: str) -> None:
    """One manifest row per reported table (key, content hash, note), appended."""
    body = F.to_json(F.struct(*[c for c in tables.columns if c != note]))
    append_rows(tables.select(F.col(key).cast("string").alias("key"), F.sha2(body, 256).alias("sha"), F.col(note).alias("note")), path)


def asset_manifest(pictures: DataFrame, path: str) -> None:
    """Pictures kept once per content: id and place of the first, number of copies, as JSON lines in id order."""
    g = pictures.groupBy("sha").agg(F.min("path").alias("path"), F.min("length").alias("length"), F.count("*").alias("n_copies"))
    g.select(F.concat(F.lit("asset-"), F.substring("sha", 1, 12)).alias("id"), "sha", "path", "length", "n_copies").orderBy("id").coalesce(1).write.mode("overwrite").json(path)


def audit_companion(entries: DataFrame, by: list[str], path: str) -> None:
    """Audit entries as one JSON line per group, in order of slot and document."""
    rest = [c for c in entries.columns if c not in by]
    entries.groupBy(*by).agg(F.array_sort(F.collect_set(F.struct(*rest))).alias("entries")).write.mode("overwrite").json(path)


def replace_json(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Rewrite a JSON store in one step: written beside it, then swapped by renames; a reader never sees a part."""
    fs, jvm = _files(spark, path), spark.sparkContext._jvm.org.apache.hadoop.fs
    fresh, old = f"{path}.new", f"{path}.old"
    rows.write.mode("overwrite").json(fresh)
    fs.delete(jvm.Path(old), True)
    if fs.exists(jvm.Path(path)):
        fs.rename(jvm.Path(path), jvm.Path(old))
    fs.rename(jvm.Path(fresh), jvm.Path(path))
    fs.delete(jvm.Path(old), True)


def _files(spark: SparkSession, path: str):  # noqa: ANN202
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def audit_workbook(actuals: DataFrame, tables: DataFrame, scope: list[str]) -> dict[str, DataFrame]:
    """The sheets of an audit workbook as tables: overview (codes by year), raw sheets with unique names, mapping audit (labels by code)."""
    overview = actuals.groupBy(*scope, "std_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("year", "value")))).alias("values"))
    raw = sheet_names(tables, scope, "heading", "table_id").select(*scope, "table_id", "sheet_name")
    audit = actuals.groupBy(*scope, "std_id").agg(F.array_sort(F.collect_set("label")).alias("labels"), F.countDistinct("year").alias("n_years"))
    return {"overview": overview, "raw": raw, "audit": audit}


def review_queue(entries: DataFrame, path: str, key: str, order: str) -> None:
    """Distinct unresolved labels, the first seen of each; the queue is rewritten by every run."""
    w = Window.partitionBy(key).orderBy(order)
    entries.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n").write.mode("overwrite").option("header", True).csv(path)


def cleared(merges: DataFrame, company: str, label: str) -> DataFrame:
    """Row merges without those of a company in which a label is member or target."""
    hit = (F.col("company_normalized") == company) & ((F.col("member_key") == label) | (F.col("target_key") == label))
    return merges.where(~F.coalesce(hit, F.lit(False)))


def snapshot_name(company: Column) -> Column:
    """File name of a library snapshot: safe name, two underscores, eight digits of the name's SHA-1."""
    return F.concat(labels.file_safe(F.lower(company)), F.lit("__"), F.substring(F.sha1(company), 1, 8), F.lit(".json"))


def library_index(files: DataFrame, index: DataFrame) -> DataFrame:
    """Index after a scan: entries without a file are gone, files without an entry are added; sorted by lower-case name."""
    j = files.select("file", F.col("company").alias("scanned")).join(index.select(F.col("file").alias("known"), "company"), F.col("file") == F.col("known"), "left")
    return j.select("file", F.coalesce("company", "scanned").alias("company")).orderBy(F.lower("company"), "file")


def styled_cells(cells: DataFrame) -> DataFrame:
    """Cells with indent, bold, is_total: the last unlabelled numeric row of a table is its grand total."""
    label = cells.where("col_no = 0").select(F.col("table_id").alias("t"), F.col("row_no").alias("r"), F.trim(F.coalesce("text", F.lit(""))).alias("label"))
    j = cells.join(label, (F.col("table_id") == F.col("t")) & (F.col("row_no") == F.col("r")))
    numeric = F.coalesce(F.col("text").rlike(r"^-?\d{1,3}(\.\d{3})*(,\d+)?$"), F.lit(False))
    last = F.max(F.when((F.col("label") == "") & (F.col("col_no") > 0) & numeric, F.col("row_no"))).over(Window.partitionBy("table_id"))
    indent = labels.indent_level(F.col("label"))
    return j.select("table_id", "row_no", "col_no", "text", indent.alias("indent"), (F.col("label").rlike(r"^[A-Z]\.\s|^(?i:summe|gesamt)")).alias("bold"), F.coalesce(F.col("row_no") == last, F.lit(False)).alias("is_total"))


def sheet_names(tables: DataFrame, scope: list[str], heading: str, order: str, most: int = 31) -> DataFrame:
    """``tables`` with sheet_name: the heading without characters a workbook forbids, cut so that a number that makes it unique still fits."""
    base = F.regexp_replace(F.coalesce(heading, F.lit("")), r"[\[\]:*?/\\]", "_")
    base = F.substring(F.when(base == "", "Table").otherwise(base), 1, most - 4)
    n = F.row_number().over(Window.partitionBy(*scope, F.lower(base)).orderBy(order))
    return tables.withColumn("sheet_name", F.concat(base, F.when(n == 1, "").otherwise(F.concat(F.lit("_"), n.cast("string")))))


def filled_template(series: DataFrame, years: list[int]) -> tuple[DataFrame, DataFrame]:
    """Long series (label, std_id, unit, fy, value) as the template's year columns, and the lines refused: several units, or several values of a year."""
    per_year = series.groupBy("label", "std_id", "fy").agg(F.countDistinct("value").alias("n"), F.max("value").alias("v"), F.collect_set("unit").alias("u"))
    g = per_year.groupBy("label", "std_id").agg(F.array_distinct(F.flatten(F.collect_list("u"))).alias("units"), F.max("n").cast("int").alias("n_values"), *[F.max(F.when(F.col("fy") == y, F.col("v"))).alias(str(y)) for y in years])
    d = g.withColumn("n_units", F.size("units")).withColumn("unit", F.array_min("units")).drop("units")
    ok = (F.col("n_units") <= 1) & (F.col("n_values") <= 1)
    years_of = [str(y) for y in years]
    return d.where(ok).select("label", "std_id", "unit", *years_of), d.where(~ok).select("label", "std_id", "n_units", "n_values")
