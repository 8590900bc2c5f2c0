"""Data-quality checks on small tables with known faults."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallywise.operators import checks


@pytest.fixture(scope="module")
def children(spark):
    return spark.createDataFrame(
        [("a", 1, 0.5), ("a", 2, 1.5), ("b", 0, 0.0), (None, -1, -0.1), ("zz", 5, None)],
        "parent string, quantity int, share double",
    )


@pytest.fixture(scope="module")
def parents(spark):
    return spark.createDataFrame([("a",), ("b",), ("c",)], "key string")


def violations(df):
    return {r.check_name: r.violations for r in df.collect()}


def test_keys_and_references(children, parents):
    got = violations(
        checks.all_checks(
            [
                checks.unique_key(children, "parent", name="unique"),
                checks.unique_key(children, "parent", "quantity", name="pair"),
                checks.has_parent(children, "parent", parents, "key", name="orphans"),
                checks.exactly_one_child(parents, "key", children, "parent", name="one"),
                checks.unique_key(children.limit(0), "parent", name="empty"),
            ]
        )
    )
    assert got == {
        "unique": 1, "pair": 0, "orphans": 2, "one: missing": 1, "one: repeated": 1, "empty": 0,
    }


def test_values(children):
    got = violations(
        checks.value_checks(
            children,
            {
                "positive": checks.positive("quantity"),
                "not negative": checks.not_negative("quantity"),
                "fraction": checks.within("share", 0, 1),
                "at most": checks.at_most("share", "quantity"),
            },
        )
    )
    assert got == {"positive": 2, "not negative": 1, "fraction": 2, "at most": 1}


def test_flags(spark):
    df = spark.createDataFrame(
        [("True", 0), ("TRUE", 3), ("false", 0), ("False", 2), (None, 0), ("true", None)],
        "flag string, closing int",
    )
    got = violations(checks.flag_consistency(df, "flag", F.col("closing") == 0, name="out"))
    assert got == {"out: flagged without cause": 2, "out: not flagged": 2}
