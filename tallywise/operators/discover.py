"""Which tables belong together, and which one to analyse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallywise.fixed_values import (
    DATE_NAME_WORDS,
    IDENTIFIER_SUFFIXES,
    MONEY_NAME_WORDS,
    SHARED_IDENTIFIER_NOTE,
)
from tallywise.operators.profile import is_numeric, union_all


def _nothing(schema: str) -> DataFrame:
    return SparkSession.active().createDataFrame([], schema)


def candidate_join_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """Identifier-like column names found in more than one table that has rows.

    Names come from the schemas; ``limit(1)`` only tells empty tables apart. Nothing
    is joined: two tables with an ``id`` need not have anything to do with each other.
    """
    named = []
    for ordinal, (table, df) in enumerate(tables.items()):
        keys = [
            F.struct(
                F.lit(name.strip().lower()).alias("column_name"),
                F.lit(ordinal).alias("ordinal"),
                F.lit(position).alias("position"),
                F.lit(table).alias("table_name"),
            )
            for position, name in enumerate(df.columns)
            if name.strip().lower().endswith(IDENTIFIER_SUFFIXES)
        ]
        if keys:
            named.append(df.limit(1).select(F.inline(F.array(*keys))))
    if not named:
        return _nothing("column_name string, tables string, note string")
    owners = F.array_sort(F.collect_list(F.struct("ordinal", "position", "table_name")))
    return (
        union_all(named)
        .groupBy("column_name")
        .agg(owners.alias("owners"))
        .filter(F.size("owners") > 1)
        .orderBy(F.col("owners")[0])
        .select(
            "column_name",
            F.array_join(F.col("owners.table_name"), ", ").alias("tables"),
            F.lit(SHARED_IDENTIFIER_NOTE).alias("note"),
        )
    )


def table_scores(tables: dict[str, DataFrame]) -> DataFrame:
    """Per table: is there money, is there a date, how many rows."""

    def named_like(name: str, words) -> bool:
        return any(word in name.lower() for word in words)

    scored = []
    for ordinal, (table, df) in enumerate(tables.items()):
        has_money = any(
            named_like(f.name, MONEY_NAME_WORDS) and is_numeric(f.dataType) for f in df.schema.fields
        )
        has_date = any(named_like(c, DATE_NAME_WORDS) for c in df.columns)
        scored.append(
            df.agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(ordinal).alias("ordinal"),
                F.lit(table).alias("table_name"),
                F.lit(has_money).alias("has_money"),
                F.lit(has_date).alias("has_date"),
                "row_count",
            )
        )
    if not scored:
        return _nothing("ordinal int, table_name string, has_money boolean, has_date boolean, row_count bigint")
    return union_all(scored).filter("row_count > 0")


def primary_table(tables: dict[str, DataFrame]) -> DataFrame:
    """The most useful table: money first, then dates, then size; the first one on a tie."""
    return (
        table_scores(tables)
        .orderBy(F.desc("has_money"), F.desc("has_date"), F.desc("row_count"), F.asc("ordinal"))
        .limit(1)
        .select("table_name", "has_money", "has_date", "row_count")
    )
