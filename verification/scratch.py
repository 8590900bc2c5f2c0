"""Where queries that read files put the files they read."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallywise.sources.written import shared_folder as scratch_folder


def as_delimited(df: DataFrame, sep: str) -> str:
    """Write a whole table as delimited files with headers; the folder they are in."""
    folder = scratch_folder(df.sparkSession)
    writer = df.write.option("header", True).option("sep", sep).option("escape", '"')
    writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    writer.csv(folder)
    return folder
