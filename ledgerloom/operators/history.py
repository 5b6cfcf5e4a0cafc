"""History of changing entity attributes from periodic snapshots.

``build_history`` turns counted snapshots into periods; ``rebuild_affected``
is the update path: only the entities a late or corrected batch touches have
their raw changes fetched and all their intervals rebuilt, and the rebuilt
chains replace the old ones in one step.  ``HistoryStore`` does that step on
disk, for the buckets of entities that are touched.

All four attributes go through one explode, one distinct and one window: a
chain is an attribute of an entity (names, seats) or one entry of it (officers,
companies, former names), and a row counts where its state differs from the row
before.  No branches are united before a grouping.

Skew: the first step keeps one row per entity and snapshot date by a map-side
combined aggregate, so an entity with a third of all rows shrinks to its
calendar days before any window sees it; chains are windowed on distinct dated
rows; the touched entities are met in the raw rows on a salted key.

Defined results: rows without entity or snapshot date do not count; blank
names, seats and entries state nothing; null arrays are empty arrays; an
empty table gives an empty history; further columns are ignored.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.operators import mapping

COLUMNS = ["entity_id", "attribute", "entry", "valid_from", "valid_to"]
SCHEMA = ", ".join(f"{c} string" for c in COLUMNS)
SALTS = 16


def tidy(c: Column) -> Column:
    """Trimmed, white space collapsed."""
    return F.regexp_replace(F.regexp_replace(c, r"[\s\p{Z}]+", " "), r"^ | $", "")


def counted(records: DataFrame) -> DataFrame:
    """Of several rows for an entity and snapshot date the one loaded last."""
    kept = ["legal_name", "seat", "historical_names", "officer_changes", "scope_changes"]
    best = F.max_by(F.struct(*kept), F.struct("loaded_at", "snapshot_id")).alias("v")
    ok = records.where(F.col("entity_id").isNotNull() & F.col("snapshot_date").isNotNull())
    return ok.groupBy("entity_id", "snapshot_date").agg(best).select("entity_id", "snapshot_date", "v.*")


def _stated(snapshots: DataFrame) -> DataFrame:
    """entity_id, attribute, chain, entry, on, state: everything the counted snapshots state, once each."""
    none = F.array().cast("array<string>")
    kind = "array<struct<attribute:string,entry:string,on:date,state:string>>"
    row = lambda attribute, entry, on, state: F.struct(F.lit(attribute).alias("attribute"), tidy(entry).alias("entry"), on.alias("on"), state.alias("state"))
    name, day, never, plain = F.col("legal_name"), F.col("snapshot_date"), F.lit(None).cast("date"), F.lit(None).cast("string")
    # A former name's chain opens before all dates if a snapshot holds the name.
    held = F.array(row("legal_name", name, day, plain), row("seat", F.col("seat"), day, plain), row("former", name, never, F.lit("held")))
    listed = F.transform(F.coalesce("historical_names", none), lambda n: row("former", n, day, F.lit("listed")))

    def officers(change: Column) -> Column:
        gone = F.transform(F.coalesce(change["officers_removed"], none), lambda n: row("officer", n, change["effective_date"], F.lit("0")))
        come = F.transform(F.coalesce(change["officers_added"], none), lambda n: row("officer", n, change["effective_date"], F.lit("1")))
        return F.concat(gone, come)

    def scope(change: Column) -> Column:
        what = F.lower(F.trim(change["change_kind"]))
        return row("scope", change["entity"], change["effective_date"], F.when(what == "left", "0").when(what == "entered", "1"))

    told = F.concat(
        held.cast(kind), listed.cast(kind),
        F.coalesce(F.flatten(F.transform("officer_changes", officers)).cast(kind), F.array().cast(kind)),
        F.coalesce(F.transform("scope_changes", scope).cast(kind), F.array().cast(kind)),
    )
    rows = snapshots.select("entity_id", F.explode(told).alias("t")).select("entity_id", "t.*")
    version = F.col("attribute").isin("legal_name", "seat")
    stated = (F.col("entry") != "") & (version | F.col("state").isNotNull()) & (F.col("on").isNotNull() | (F.col("attribute") == "former"))
    # A version's state is its text, and all of an entity's names, or seats, are one chain.
    chain, state = F.when(version, "").otherwise(F.col("entry")), F.coalesce("state", "entry")
    return rows.where(stated).distinct().select("entity_id", "attribute", chain.alias("chain"), "entry", "on", state.alias("state"))


def build_history(records: DataFrame) -> DataFrame:
    """entity_id, attribute, entry, valid_from, valid_to; dates as ISO text, '' where unknown or open."""
    # On one day a removal ('0') comes before an addition ('1'); nulls (a held name) come first.
    w = Window.partitionBy("entity_id", "attribute", "chain").orderBy("on", "state")
    former, term = F.col("attribute") == "former", F.col("attribute").isin("officer", "scope")
    turns = _stated(counted(records)).withColumn("before", F.lag("state").over(w)).where(F.col("before").isNull() | ((F.col("before") != F.col("state")) & ~former))
    turns = turns.withColumn("next", F.lead("on").over(w))
    # A former name counts if no snapshot holds it, a term if it opens, a removal if it is the first change of all.
    counts = F.when(former, F.col("state") == "listed").when(term, (F.col("state") == "1") | F.col("before").isNull()).otherwise(True)
    removal = term & (F.col("state") == "0")
    since = F.when(~former & ~removal, F.col("on"))
    until = F.when(former | removal, F.col("on")).otherwise(F.col("next"))
    iso = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(""))
    attribute = F.when(former, "legal_name").otherwise(F.col("attribute"))
    return turns.where(counts).select("entity_id", attribute.alias("attribute"), "entry", iso(since).alias("valid_from"), iso(until).alias("valid_to"))


def _of(rows: DataFrame, entities: DataFrame, salt: str) -> DataFrame:
    """The ``rows`` of the distinct ``entities``: by broadcast if they are few, else on a key salted with ``salt``."""
    few = mapping.small(entities)
    if few is not entities:
        return rows.join(few, "entity_id", "left_semi")
    many = entities.select(F.col("entity_id").alias("__e"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__s"))
    return rows.join(many, (F.col("entity_id") == F.col("__e")) & (F.pmod(F.xxhash64(salt), F.lit(SALTS)) == F.col("__s")), "left_semi")


def rebuild_affected(history: DataFrame, raw: DataFrame, batch: DataFrame) -> DataFrame:
    """``history`` after ``batch`` (already part of ``raw``): touched chains rebuilt from their raw changes, others kept."""
    touched = batch.select("entity_id").where("entity_id is not null").distinct()
    return history.join(touched, "entity_id", "left_anti").select(*COLUMNS).unionByName(build_history(_of(raw, touched, "snapshot_id")))


class HistoryStore:
    """Versioned history on shared storage, in buckets of entities; readers see either all of an update or nothing of it.

    Version N is a file that names a folder per bucket.  An update writes new folders for the touched buckets only and
    publishes version N+1 by renaming its file to a name that must not exist: of two writers that started from one
    version the second fails and starts again, so no update is lost.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._hadoop.Path(self.root))

    def versions(self) -> list[int]:
        """The published versions, oldest first."""
        names = [f.getPath().getName() for f in self._fs.listStatus(self._hadoop.Path(self.root))]
        return sorted(int(n[8:]) for n in names if n.startswith("VERSION-"))

    def _folders(self, version: int | None) -> dict[int, str]:
        if version is None:
            return {}
        text = self.spark.read.text(f"{self.root}/VERSION-{version}", wholetext=True).first()[0]
        return {int(k): v for k, v in json.loads(text).items()}

    def _read(self, folders: dict[int, str]) -> DataFrame | None:
        paths = [f"{self.root}/{folder}/bucket={bucket}" for bucket, folder in sorted(folders.items())]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else None

    def current(self) -> DataFrame | None:
        """The newest version, or None before the first one."""
        versions = self.versions()
        return self._read(self._folders(versions[-1])) if versions else None

    def _publish(self, folders: dict[int, str], version: int) -> None:
        fresh = self._hadoop.Path(f"{self.root}/.fresh-{uuid.uuid4().hex[:12]}")
        out = self._fs.create(fresh, True)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        files = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        files.rename(fresh, self._hadoop.Path(f"{self.root}/VERSION-{version}"), self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0))

    def update(self, raw: DataFrame, batch: DataFrame, attempts: int = 5) -> None:
        """Rebuild the chains that ``batch`` touches and publish their buckets in one step."""
        bucket = F.pmod(F.xxhash64("entity_id"), F.lit(self.buckets)).cast("int").alias("bucket")
        touched = {r[0] for r in batch.where("entity_id is not null").select(bucket).distinct().collect()}
        for attempt in range(attempts):
            versions = self.versions()
            folders = self._folders(versions[-1] if versions else None)
            now = self._read({b: f for b, f in folders.items() if b in touched})
            whole = build_history(raw) if not versions else build_history(_of(raw, batch.select("entity_id").where("entity_id is not null").distinct(), "snapshot_id")) if now is None else rebuild_affected(now, raw, batch)
            folder = f"f-{uuid.uuid4().hex[:12]}"
            rows = whole.select("*", bucket)
            rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
            written = {int(f.getPath().getName()[7:]) for f in self._fs.listStatus(self._hadoop.Path(f"{self.root}/{folder}")) if f.getPath().getName().startswith("bucket=")}
            kept = {b: f for b, f in folders.items() if b not in touched} if versions else {}
            try:
                return self._publish(kept | dict.fromkeys(sorted(written), folder), (versions[-1] if versions else 0) + 1)
            except Py4JJavaError as e:
                self._fs.delete(self._hadoop.Path(f"{self.root}/{folder}"), True)
                if "FileAlreadyExists" not in str(e) or attempt + 1 == attempts:
                    raise

    def vacuum(self, keep: int = 1) -> None:
        """Delete all but the newest ``keep`` versions and the folders only they name; readers of a deleted version must be done."""
        versions = self.versions()
        live = {folder for v in versions[-keep:] for folder in self._folders(v).values()}
        for v in versions[:-keep]:
            for folder in {*self._folders(v).values()} - live:
                self._fs.delete(self._hadoop.Path(f"{self.root}/{folder}"), True)
            self._fs.delete(self._hadoop.Path(f"{self.root}/VERSION-{v}"), False)
