"""Small copies of all tables with awkward rows."""

import os

from pyspark.sql import functions as F


def awkward_tables(spark, sf, path, rows):
    """A few rows, rows that are null in every column, and repeated rows of every table; none at all for ``rows`` 0."""
    for name in os.listdir(sf):
        t = spark.read.parquet(f"{sf}/{name}")
        nothing = t.limit(min(rows, 3)).select(*[F.lit(None).cast(x.dataType).alias(x.name) for x in t.schema])
        t.limit(rows).unionByName(nothing).unionByName(t.limit(min(rows, 2))).coalesce(1).write.parquet(f"{path}/{name}")
    return str(path)
