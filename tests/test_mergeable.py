"""Profiles from sketches, tables in buckets, bounds from footers, checks on the way, names by postings."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tallywise.operators import checks, grounding, profile, sketches, targets
from tallywise.sources.bucketed import BY_ORDER, bucketed_by_order
from tallywise.sources.footers import bounds
from verification import views

DATA = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_two_batches_merge_into_the_profile_of_the_whole(spark):
    df = views.table(spark, DATA, "lineitem").withColumns(
        {
            "gaps": F.when(F.col("l_orderkey") % 3 != 0, F.col("l_tax")),
            "day": F.date_format("l_shipdate", "MM/dd/yyyy"),
            "nothing": F.lit(None).cast("double"),
            "nan": F.when(F.col("l_linenumber") == 1, F.lit(float("nan"))).otherwise(F.col("l_quantity")),
        }
    )
    halves = [sketches.sketched(df.where(F.col("l_orderkey") % 2 == i)) for i in (0, 1)]
    empty = sketches.sketched(df.where("false"))
    got = {r.column_name: r for r in sketches.sketched_profile(sketches.merged(*halves, empty)).collect()}
    want = {r.column_name: r for r in profile.column_profile(df).collect()}
    assert set(got) == set(want)
    n = df.count()
    for name, w in want.items():
        g = got[name]
        exact = ("row_count", "missing_count", "missing_pct", "is_numeric", "is_measure", "is_datelike", "data_type")
        assert [g[c] for c in exact] == [w[c] for c in exact], name
        assert g.distinct_count == pytest.approx(w.distinct_count, rel=0.04), name
    for name in ("l_quantity", "l_extendedprice", "gaps"):
        g = got[name]
        filled = df.where(F.col(name).isNotNull()).count()
        low, high = df.agg(F.min(name), F.max(name)).first()
        assert (g.smallest, g.largest) == (low, high)
        for share in (25, 50, 75):
            value = g[f"quantile_{share}"]
            below = df.where(F.col(name) < value).count() / filled
            upto = df.where(F.col(name) <= value).count() / filled
            assert below - 0.02 <= share / 100 <= upto + 0.02
    assert got["nothing"].quantile_50 is None and got["nothing"].missing_count == n


def test_sketches_shuffle_no_values(spark):
    df = views.table(spark, DATA, "orders")
    text = plan(sketches.sketched(df))
    assert re.findall(r"Exchange (\w+)", text) == ["SinglePartition"] and "partial_hll_sketch_agg" in text


@pytest.fixture(scope="module")
def bucketed(spark):
    tables = views.retail(spark, DATA)
    prefix = f"b{random.randrange(10**9)}_"
    yield bucketed_by_order(tables, prefix, 4)
    for name in BY_ORDER:
        spark.sql(f"DROP TABLE IF EXISTS {prefix}{name}")


def test_joins_and_checks_by_order_need_no_shuffle(spark, bucketed):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (
            checks.unique_key(bucketed.sales, "order_id", name="unique"),
            checks.exactly_one_child(bucketed.sales, "order_id", bucketed.deliveries, "order_id", name="one"),
            checks.has_parent(bucketed.returns, "order_id", bucketed.sales, "order_id", name="parent"),
        ):
            assert "hashpartitioning" not in plan(df)
        month = plan(targets.target_vs_actual(bucketed, "2001-07"))
        assert not [d for d in re.findall(r"hashpartitioning\(([^)]*)", month) if "order_id" in d]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plain = views.retail(spark, DATA)
    for build in (
        lambda t: checks.has_parent(t.returns, "order_id", t.sales, "order_id", name="parent"),
        lambda t: targets.target_vs_actual(t, "2001-07"),
    ):
        assert [tuple(r) for r in build(bucketed).collect()] == [tuple(r) for r in build(plain).collect()]


def test_bounds_come_from_footers(spark, tmp_path):
    sales = views.retail(spark, DATA).sales.select("order_date", "order_id")
    sales.repartition(3).write.parquet(str(tmp_path / "sales"))
    df = bounds(spark, str(tmp_path / "sales"), "order_date", "order_id")
    text = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert re.search(r"PushedAggregation: \[MIN\(order_date\), MAX\(order_date\)", text)
    want = sales.agg(F.min("order_date"), F.max("order_date"), F.min("order_id"), F.max("order_id")).first()
    assert tuple(df.first()) == tuple(want)
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_observed_checks_count_what_range_checks_count(spark):
    lines = views.table(spark, DATA, "lineitem")
    rules = {"tax": checks.within("l_tax", 0, 0.03), "quantity": checks.positive("l_quantity"), "none": F.lit(None).cast("boolean")}
    seen, observation = checks.observed_checks(lines, rules, "rules")
    assert seen.groupBy("l_returnflag").count().count() == 3  # the action that reads the table anyway
    got = {tuple(r) for r in checks.observed_rows(spark, observation).collect()}
    assert got == {tuple(r) for r in checks.value_checks(lines, rules).collect()}


def test_names_are_found_wherever_they_stand(spark):
    """Names by their beginnings against a plain search, long and short, inside words and repeated."""
    chance = random.Random(2)
    names = ["A", "Bo", "Cal", "Dana", "Elements", "Elementary", "North West", "North", "é", "tail-end", "x y z w v u t", ""]
    said = {i: " ".join(chance.choices([*names, "Canada", "ElementaryX", "orth West", "tail"], k=chance.randrange(6))) for i in range(60)}
    texts = spark.createDataFrame([*said.items(), (100, None), (101, "")], "id long, text string")
    pairs = [(i, n) for i in [*said, 100, 101] for n in names if n]
    found = grounding._mentioned(spark.createDataFrame(pairs, "id long, entity string"), texts, "id", "text")
    assert {(r.id, r.entity) for r in found.collect()} == {(i, n) for i, n in pairs if n in (said.get(i) or "")}


def test_one_text_with_many_records_is_spread(spark):
    """All records belong to one text: the join by beginnings deals them out, few meet the text."""
    names = spark.range(5000).select(F.lit(1).alias("id"), F.concat(F.lit("n"), F.col("id") * 7919 % 100_000).alias("entity"))
    texts = spark.createDataFrame([(1, "n7919 and n15838 x")], "id int, text string")
    found = grounding._mentioned(names, texts, "id", "text")
    assert sorted(r.entity for r in found.collect()) == sorted(
        n for n in {f"n{i * 7919 % 100_000}" for i in range(5000)} if n in "n7919 and n15838 x"
    )
