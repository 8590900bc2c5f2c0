"""Data-quality checks; every check is a row (check_name, violations)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from tallywise.functions.texts import is_true_text
from tallywise.operators.profile import union_all

all_checks = union_all


def _named(name: str, counted: DataFrame) -> DataFrame:
    return counted.select(F.lit(name).alias("check_name"), "violations")


def unique_key(df: DataFrame, *keys: str, name: str) -> DataFrame:
    """Rows beyond the first of every key."""
    copies = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return _named(name, copies.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations")))


def has_parent(
    child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, *, name: str
) -> DataFrame:
    """Child rows whose key (or missing key) has no parent row.

    Children are counted per key before the anti-join, so a key that fills a large
    part of the child table crosses the join as one row.
    """
    counted = child.groupBy(F.col(child_key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    parents = parent.select(F.col(parent_key).alias("key"))
    orphans = counted.join(parents, "key", "left_anti")
    return _named(name, orphans.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations")))


def exactly_one_child(
    parent: DataFrame, parent_key: str, child: DataFrame, child_key: str, *, name: str
) -> DataFrame:
    """Two checks: parents without a child, and child rows beyond the first per parent."""
    return union_all(
        [
            has_parent(parent, parent_key, child, child_key, name=f"{name}: missing"),
            unique_key(child, child_key, name=f"{name}: repeated"),
        ]
    )


def value_checks(df: DataFrame, violations: dict[str, Column]) -> DataFrame:
    """Any number of row conditions that must not hold, counted in one pass."""
    counted = [
        F.struct(F.lit(name).alias("check_name"), F.count_if(bad).alias("violations"))
        for name, bad in violations.items()
    ]
    return df.agg(F.array(*counted).alias("checks")).select(F.inline("checks"))


def observed_checks(df: DataFrame, violations: dict[str, Column], name: str) -> tuple[DataFrame, Observation]:
    """The same counts as ``value_checks``, taken while something else reads the table.

    Gives back the table and an observation. Whatever action is run on the table fills the observation;
    ``observed_rows`` then has the checks, without a scan of their own. The action has to read the
    whole table: a limit or a filter above it would leave rows out.
    """
    counts = [F.count_if(bad).alias(check) for check, bad in violations.items()]
    observation = Observation(name)
    return df.observe(observation, *counts), observation


def observed_rows(spark: SparkSession, observation: Observation) -> DataFrame:
    """(check_name, violations) of an observation that an action has filled; one row per check."""
    return spark.createDataFrame(list(observation.get.items()), "check_name string, violations bigint")


def positive(column: str) -> Column:
    return F.col(column) <= 0


def not_negative(column: str) -> Column:
    return F.col(column) < 0


def within(column: str, low, high) -> Column:
    return (F.col(column) < low) | (F.col(column) > high)


def at_most(column: str, other: str) -> Column:
    return F.col(column) > F.col(other)


def flag_consistency(df: DataFrame, flag: str, expected: Column, *, name: str) -> DataFrame:
    """A stored flag against the condition it describes, both directions."""
    flagged, holds = is_true_text(flag), F.coalesce(expected, F.lit(False))
    return value_checks(
        df,
        {f"{name}: flagged without cause": flagged & ~holds, f"{name}: not flagged": ~flagged & holds},
    )
