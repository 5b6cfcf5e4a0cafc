"""Session set-up and durable intermediate tables.

Iterative operators cut their lineage by writing a table to the shared folder
that the cluster names in ``spark.checkpoint.dir``.  A written table survives
the loss of any executor, can be counted from its footers, and is compressed.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

SHARED_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benches; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ledgerloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is named and the master is local."""
    named = spark.sparkContext.getConf().get(SHARED_KEY, None) or spark.conf.get(SHARED_KEY, None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{SHARED_KEY} must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
    spark.conf.set(SHARED_KEY, made)
    return made


class Scratch:
    """Written intermediate tables of one operator run, below one folder of the shared directory.

    A result may still read its tables when the operator returns, so the folder is deleted when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        path = self._path(self.root)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)

    def _path(self, name: str):  # noqa: ANN202
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)

    def write(self, df: DataFrame, name: str, hashes: Iterable[str] = ()) -> DataFrame:
        """Write ``df`` once and return the table that reads it back; the columns ``hashes`` are written without a dictionary, which shortens none."""
        path, hashes = f"{self.root}/{name}", list(hashes)
        out = df.write.mode("overwrite").option("compression", "lz4_raw" if set(hashes) == set(df.columns) else "zstd")
        for column in hashes:
            out = out.option(f"parquet.enable.dictionary#{column}", "false")
        out.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def below(self, name: str) -> Scratch:
        """A folder of its own inside this one."""
        inner = object.__new__(Scratch)
        inner.spark, inner.root = self.spark, f"{self.root}/{name}"
        return inner

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        path = self._path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let the cleaner delete shuffle files of finished steps now: it acts when the driver collects its garbage,
    which an iterating driver with little garbage of its own may not do for half an hour."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the project's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
