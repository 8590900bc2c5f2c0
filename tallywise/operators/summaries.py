"""Sums and distinct counts side by side, without sending the rows anywhere.

Whole-number ids are counted by bitmaps: rows are combined where they are read, per group and range of
32,768 ids, into sums and one bitmap, and only these travel. Ids of other types are counted from the
distinct pairs of group and id, which carry no amounts; where groups are many, pairs hardly ever repeat and
are sorted, as a hash table would hold nearly every row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tallywise.functions.numbers import money

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def money_sums() -> dict[str, Column]:
    return {"revenue": money("revenue"), "gross_profit": money("gross_profit")}


def as_numbers() -> dict[str, Column]:
    """The totals of ``money_sums`` as doubles, 0 where there was nothing to add."""
    return {c: F.coalesce(c, F.lit(0)).cast("double") for c in money_sums()}


def _totals(df: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(e).alias(a) for a, e in sums.items()])


def _bitmaps(df: DataFrame, keys: list[str], sums: dict[str, Column], distinct: dict[str, str]) -> DataFrame:
    """Per group and range of ids: sums, and how many ids of the range there are. One row leaves a task for each.

    Ids of several columns are stacked as they are read; the amounts stand beside the first.
    """
    stacked = []
    for alias, column in distinct.items():
        ids, first = F.col(column).cast("bigint"), not stacked
        amounts = [F.when(F.lit(first), e).alias(a) for a, e in sums.items()]
        places = F.bitmap_bucket_number(ids).alias("_range"), F.bitmap_bit_position(ids).alias("_place")
        stacked.append(F.struct(F.lit(alias).alias("_of"), *places, *amounts))
    ranged = df.select(*keys, F.inline(F.array(*stacked)))
    held = F.bitmap_count(F.bitmap_construct_agg("_place")).alias("_ids")
    found = ranged.groupBy(*keys, "_of", "_range").agg(*[F.sum(a).alias(a) for a in sums], held)
    return found.select(*keys, *sums, *[F.when(F.col("_of") == a, F.col("_ids")).alias(a) for a in distinct])


def _pairs(df: DataFrame, keys: list[str], column: str, alias: str, few: bool) -> DataFrame:
    """Per group: how many distinct ids there are, from pairs of group and id."""
    pairs = df.where(F.col(column).isNotNull()).select(*keys, column)
    if few:
        pairs = pairs.distinct()
    else:
        equal = Window.partitionBy(column, *keys).orderBy(column)
        pairs = pairs.withColumn("_nth", F.row_number().over(equal)).where("_nth = 1")
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias(alias))


def sums_and_distinct(
    df: DataFrame, keys: list[str], sums: dict[str, Column], distinct: dict[str, str], few: bool = True
) -> DataFrame:
    """Group totals ``{alias: expression}`` plus an exact distinct count per ``{alias: column}``.

    Whole-number columns are counted by bitmaps on the pass that adds up the totals, so the table is read
    once. Columns that are not whole numbers, and all columns if there are not ``few`` groups (a bitmap
    would hold few ids then), take a pass over their own values and the keys. Totals and counts meet as
    groups. Sums of decimals and whole numbers are exact in any order; a total without values is null.
    Null ids are not counted.
    """
    dense = {a: c for a, c in distinct.items() if few and isinstance(df.schema[c].dataType, _WHOLE)}
    parts = [_bitmaps(df, keys, sums, dense) if dense else _totals(df, keys, sums)]
    parts += [_pairs(df, keys, c, a, few) for a, c in distinct.items() if a not in dense]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    counts = [F.coalesce(F.sum(a), F.lit(0)).cast("bigint").alias(a) for a in distinct]
    return stacked.groupBy(*keys).agg(*[F.sum(a).alias(a) for a in sums], *counts)
