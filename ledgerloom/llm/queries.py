"""Queries of the corpus problems tagged llm (pN_...), over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import components, encoding, labels, packing, residue, tokens
from ledgerloom.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code of the reference list that each unconfirmed client label means, or UNMATCHED."""
    open_ones = table(spark, sf_dir, "client_aliases").where(~F.coalesce(F.col("std_id").rlike(r"[^\s\p{Z}]"), F.lit(False)))
    return labels.match_labels(open_ones, table(spark, sf_dir, "label_synonyms"), "alias_id", "client_label", "original_label", "hgb_code")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of every row key linked directly or indirectly within its company."""
    return components.match_groups(table(spark, sf_dir, "row_merges"), "company_normalized", "member_key", "target_key")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled cells and headings of the extracted tables with their original text."""
    return encoding.restore(table(spark, sf_dir, "extracted_tables"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container of every document or piece of a document."""
    sized = tokens.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", ["source"])
    return packing.pack(sized, "doc_id", "source")


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and unused share of p9_containers: one row."""
    boxes = p9_containers(spark, sf_dir).where("container_id >= 0").groupBy("container_id").agg(F.sum("n_tokens").alias("t"))
    return boxes.agg(F.count("*").alias("n_containers"), F.sum("t").alias("n_tokens"), (1 - F.sum("t") / (F.count("*") * packing.CAPACITY)).alias("unused_share"), F.max("t").alias("fullest"))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of every source in every window when reports are to make up half of each and notes a fifth."""
    sized = tokens.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", ["source"])
    rows = packing.pack(sized, "doc_id", "source", share={"lagebericht": 0.5, "anhang": 0.2}).where("container_id >= 0")
    return rows.groupBy("window_no", "source").agg(F.sum("n_tokens").alias("n_tokens"), F.countDistinct("container_id").alias("n_containers"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are, or hold, template residue, filler, error pages or script demands."""
    documents = tokens.spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return residue.find_residue(documents, "doc_id", "text").select("doc_id")


def queries() -> dict:
    return {"p1_found": p1_found, "p4_found": p4_found, "p5_found": p5_found, "p8_ids": p8_ids, "p9_containers": p9_containers, "p9_fill": p9_fill, "p9_mixture": p9_mixture, "p10_found": p10_found}


_KEY = r"lower(trim(regexp_replace({c}, '[\s\x1c-\x1f\x85\p{Z}]+', ' ', 'g'), ' '))"
_GROUPS = f"""p AS (SELECT coalesce(company_normalized, chr(0)) AS c, {_KEY.replace('{c}', 'member_key')} AS l, {_KEY.replace('{c}', 'target_key')} AS r FROM row_merges),
v AS (SELECT * FROM p WHERE l <> '' AND r <> '' AND l <> r), e AS (SELECT c, l AS a, r AS b FROM v UNION SELECT c, r, l FROM v),
reach AS (SELECT c, a, a AS b FROM e UNION SELECT reach.c, reach.a, e.b FROM reach JOIN e ON e.c = reach.c AND e.a = reach.b)"""


def oracle_sql() -> dict[str, str]:
    return {"p4_found": f"WITH RECURSIVE {_GROUPS} SELECT nullif(c, chr(0)) AS company_normalized, a AS row_key, min(b) AS group_key FROM reach GROUP BY c, a"}
