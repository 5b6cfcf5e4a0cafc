"""Filings as a stream: observations are appended and only the touched keys are reconciled again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.operators import history, series

KEYS = ["company_normalized", "fiscal_year", "kind"]


def read_stream(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """New parquet files of a folder, a bounded number at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def windowed_counts(events: DataFrame, time: str, kind: str, width: str, lateness: str) -> DataFrame:
    """Events per window and kind; a window is final once the watermark has passed it, later events are dropped."""
    t = events.withWatermark(time, lateness)
    return t.groupBy(F.window(time, width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def reconcile_touched(raw: DataFrame, batch: DataFrame) -> DataFrame:
    """Observations of the keys a batch touches, from all their rows."""
    touched = batch.select(*KEYS).distinct()
    return series.observations(raw.join(touched, KEYS, "left_semi").where("value is not null"), KEYS, "value", ["fact_id"])


def keep_history(stream: DataFrame, store: history.HistoryStore, raw: Callable[[], DataFrame], land: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Every batch lands in the raw table first, then the chains it touches are rebuilt and published at once.

    Running a batch twice gives the same history: counted snapshots do not change by repeated rows.
    """

    def step(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        land(batch)
        store.update(raw(), batch)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
