"""Readers: extracted-table JSON, sheet cells, dictionaries, append-only stores, pages, pictures, library folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import labels
from ledgerloom.functions.text import visible_text

TABLE_JSON = "array<struct<index:int,heading:string,type:int,framework:string,pnl_method:string,doc_label:string,page_start:int,page_end:int,rows:array<array<string>>>>"


def extracted_tables(spark: SparkSession, path: str) -> DataFrame:
    """Files with a JSON list of tables, or an object that holds one under 'tables'; a byte order mark is ignored.

    One row per table: filing_id (file name), table_id (hash of file and index), and the fields of the list.
    Files that are no such JSON come out as one row with null fields, so that they can be counted.
    """
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.json)?$", 1).alias("filing_id"), F.regexp_replace("value", "^\\x{FEFF}", "").alias("body"))
    items = F.when(F.col("body").rlike(r"^\s*\["), F.from_json("body", TABLE_JSON)).otherwise(F.from_json("body", f"struct<tables:{TABLE_JSON}>")["tables"])
    each = files.select("filing_id", F.explode_outer(items).alias("t"))
    return each.select("filing_id", F.xxhash64("filing_id", "t.index").alias("table_id"), "t.*")


def layered_csv(spark: SparkSession, paths: list[str], key: str, encoding: str = "UTF-8") -> DataFrame:
    """Dictionaries with a header line; of several rows for a key the one in the last file counts, and in it the last row (by place in the file, however it is split)."""
    out = None
    for i, path in enumerate(paths):
        d = spark.read.option("header", True).option("encoding", encoding).csv(path).select("*", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("n")).alias("__row")).withColumn("__layer", F.lit(i))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.desc("__layer"), F.desc("__row"))
    return out.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__layer", "__row")


def store_view(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last-write-wins view of an append-only store."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def sheet_cells(spark: SparkSession, path: str) -> DataFrame:
    """Worksheets delivered as JSON lines: sheet, row_no, col_no, text, num."""
    return spark.read.schema("sheet string, row_no int, col_no int, text string, num double").json(path)


def year_columns(cells: DataFrame) -> DataFrame:
    """sheet, row_no, column, value: line items of a filled template, its columns named by the header row; years are four digits."""
    head = cells.where("row_no = 0").select(F.col("sheet").alias("s"), F.col("col_no").alias("c"), F.trim("text").alias("column"))
    return cells.where("row_no > 0").join(head, (F.col("sheet") == F.col("s")) & (F.col("col_no") == F.col("c"))).select("sheet", "row_no", "column", F.coalesce("text", F.col("num").cast("string")).alias("value"), F.when(F.col("column").rlike(r"^\d{4}$"), F.col("column").cast("int")).alias("year"))


def pictures(spark: SparkSession, path: str) -> DataFrame:
    """path, sha, length of pictures below a folder, in path order."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,jpeg,png,webp,JPG,JPEG,PNG,WEBP}").option("recursiveFileLookup", True).load(path)
    return raw.select("path", F.sha2("content", 256).alias("sha"), "length").orderBy("path")


def job_postings(pages: DataFrame, url: str, html: str) -> DataFrame:
    """url, title, date_posted of JSON-LD JobPosting blocks; broken JSON is passed over, lists and single objects both count."""
    blocks = F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>'), F.lit(1))
    item = "struct<`@type`:string,title:string,datePosted:string>"
    b = pages.select(F.col(url).alias("url"), F.explode(blocks).alias("j"))
    parsed = F.when(F.col("j").rlike(r"^\s*\["), F.from_json("j", f"array<{item}>")).otherwise(F.array(F.from_json("j", item)))
    each = b.select("url", F.explode(parsed).alias("p")).where("p.`@type` = 'JobPosting' and p.title is not null")
    first = each.select("url", F.trim("p.title").alias("title"), F.substring("p.datePosted", 1, 10).try_cast("date").alias("date_posted"))
    return first.dropDuplicates(["url", "title"])


def card_jobs(pages: DataFrame, url: str, html: str) -> DataFrame:
    """url, title, location of cards in HTML: list items, articles or divisions of a job class that hold a heading, without further ones inside."""
    card = r"(?is)<(?:article|li|div)\b[^>]*class\s*=\s*[\"'][^\"']*(?:job|stelle|career)[^\"']*[\"'][^>]*>((?:(?!<(?:article|li|div)\b).)*?)</(?:article|li|div)>"
    c = pages.select(F.col(url).alias("url"), F.explode(F.regexp_extract_all(html, F.lit(card), F.lit(1))).alias("card"))
    title = visible_text(F.regexp_extract("card", r"(?is)<h[1-4]\b[^>]*>(.*?)</h[1-4]>", 1))
    place = F.nullif(visible_text(F.regexp_extract("card", r"(?is)<[a-z]+\b[^>]*class\s*=\s*[\"'][^\"']*location[^\"']*[\"'][^>]*>(.*?)</", 1)), F.lit(""))
    return c.select("url", title.alias("title"), place.alias("location")).where("title != ''").dropDuplicates(["url", "title"])


def jobs_of_pages(pages: DataFrame, url: str, html: str) -> DataFrame:
    """url, title: structured postings of a page, or, if it has none, its cards; one per title whatever its case."""
    structured = job_postings(pages, url, html).select("url", "title")
    cards = card_jobs(pages, url, html).select("url", "title").join(structured.select("url").distinct(), "url", "left_anti")
    return structured.unionByName(cards).groupBy("url", F.lower("title").alias("__t")).agg(F.min("title").alias("title")).drop("__t")


def entity_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON stores, each an object with a list under 'records'; broken files give no record."""
    body = spark.read.text(path, wholetext=True)
    return body.select(F.explode(F.from_json("value", f"struct<records:array<struct<{schema}>>>")["records"]).alias("r")).select("r.*")


def lookup_key(query: Column) -> Column:
    """Key of a delivered lookup: trimmed, lower case, without closing slashes."""
    return F.regexp_replace(F.lower(F.trim(query)), "/+$", "")


def lookups(queries: DataFrame, answers: DataFrame, query: str) -> DataFrame:
    """``queries`` with the delivered answer of the same key; both have ``query``."""
    a = answers.withColumn("__key", lookup_key(F.col(query))).drop(query)
    return queries.withColumn("__key", lookup_key(F.col(query))).join(a, "__key", "left").drop("__key")


def register_results(rows: DataFrame, title: str, note: str) -> DataFrame:
    """Result rows that are financial filings; amendments and corrections are left out."""
    amended = F.coalesce(F.lower(note).rlike("berichtig|änderung"), F.lit(True))
    return rows.where(F.lower(title).rlike("abschluss|bericht") & ~amended)


def pages_by_class(pages: DataFrame, url: str, order: str) -> tuple[DataFrame, DataFrame]:
    """The first page of every class a host has (host, page_class, url), and the pages skipped."""
    host = F.lower(F.regexp_extract(url, r"(?i)^[a-z]+://([^/?#]+)", 1))
    d = pages.select(host.alias("host"), labels.url_class(F.col(url)).alias("page_class"), F.col(url).alias("url"), F.col(order).alias("__o"))
    n = F.row_number().over(Window.partitionBy("host", "page_class").orderBy("__o"))
    d = d.withColumn("__n", F.when(F.col("page_class").isNotNull(), n))
    return d.where("__n = 1").select("host", "page_class", "url"), d.where("__n is null or __n > 1").select("host", "url")


def links(pages: DataFrame, url: str, html: str) -> DataFrame:
    """url, link: distinct links of a page to its own host, relative ones made absolute; the host must be equal, not only begin alike."""
    origin = r"(?i)^([a-z]+://[^/?#]+)"
    found = pages.select(F.col(url).alias("url"), F.lower(F.regexp_extract(url, origin, 1)).alias("host"), F.explode(F.array_distinct(F.regexp_extract_all(html, F.lit(r'(?i)href\s*=\s*["\']([^"\'#]+)'), F.lit(1)))).alias("l"))
    full = F.when(F.col("l").startswith("//"), F.concat(F.regexp_extract("host", r"^([a-z]+:)", 1), F.col("l"))).when(F.col("l").startswith("/"), F.concat("host", "l")).otherwise(F.col("l"))
    return found.withColumn("link", full).where(F.lower(F.regexp_extract("link", origin, 1)) == F.col("host")).select("url", "link")
