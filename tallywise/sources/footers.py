"""First and last values of stored columns from Parquet footers, without reading rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def bounds(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """One row with first_<column> and last_<column> of whole numbers, dates or doubles of a Parquet table.

    The smallest and largest values of every row group stand in the footers of the files; the scan is
    asked for them instead of rows. It is the newer kind of scan that can do so, which a session of
    its own is set to; all else about the caller's session stays as it is. Partition columns and texts
    have no such values and are read from the rows.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    found = []
    for c in columns:
        found += [F.min(f"`{c}`").alias(f"first_{c}"), F.max(f"`{c}`").alias(f"last_{c}")]
    return own.read.parquet(path).agg(*found)
