"""Shape of the plans: what must not appear at any data size, and what must be pushed down."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tallywise.operators import breakdown, kpi, lattice, targets
from tallywise.operators.summaries import money_sums, sums_and_distinct
from tallywise.plans import findings, questions
from verification import views
from verification.oracle import ORACLE_SQL
from verification.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def pushed(df) -> set[str]:
    """Filters handed to the file scans, subqueries without their numbers."""
    lists = re.findall(r"PushedFilters: \[([^\]]*)\]", formatted(df))
    return {re.sub(r"#\d+", "", f) for found in lists for f in found.split(", ")}


@pytest.fixture(scope="module")
def plans(spark):
    return {name: plan(build(spark, DATA)) for name, build in QUERIES.items()}


def test_no_cross_joins_and_no_python_per_row(plans):
    unwanted = (
        "CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "BatchEvalPython",
    )
    assert {n: w for n, text in plans.items() for w in unwanted if w in text} == {}


def test_windows_over_facts_are_partitioned(plans):
    """Only aggregated series (period_change) and a top-k may be ordered in one task."""
    windowed = {name for name, text in plans.items() if re.search(r"\bWindow \[", text)}
    assert windowed == {"period_change", "value_spread"}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Sales and their dates as real columns of a stored table."""
    tables, tmp_path = views.retail(spark, DATA), tmp_path_factory.mktemp("stored")
    for name in ("sales", "returns", "deliveries"):
        getattr(tables, name).write.parquet(str(tmp_path / name))
    kept = tables.present() | {
        n: spark.read.parquet(str(tmp_path / n)) for n in ("sales", "returns", "deliveries")
    }
    return type(tables)(**kept)


def test_date_filters_reach_the_scan(spark, stored):
    window = pushed(kpi.kpi_for_window(stored, "2000-01-01", "2000-12-31"))
    assert {"GreaterThanOrEqual(order_date,2000-01-01)", "LessThanOrEqual(return_date,2000-12-31)"} <= window
    month = pushed(targets.target_vs_actual(stored, "2001-07"))
    assert {"GreaterThanOrEqual(order_date,2001-07-01)", "LessThan(return_date,2001-08-01)"} <= month
    latest = pushed(targets.target_vs_actual(stored))
    assert "GreaterThanOrEqual(order_date,ScalarSubquery)" in latest
    compared = pushed(kpi.period_comparison(stored))
    assert {"GreaterThanOrEqual(order_date,ScalarSubquery)", "GreaterThanOrEqual(return_date,ScalarSubquery)"} <= compared


def test_scans_read_only_needed_columns(spark, stored):
    text = formatted(breakdown.breakdown_by(stored, "channel"))
    read = set(re.findall(r"ReadSchema: struct<([^>]*)>", text))
    columns = {c for schema in read for c in re.findall(r"(\w+):", schema)}
    assert columns == {"channel", "order_id", "revenue", "gross_profit", "quantity"}


def test_large_dimensions_are_not_broadcast(spark, stored):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = breakdown.breakdown_by(stored, "category")
        assert "BroadcastHashJoin" not in plan(df)
        shuffled = {tuple(r) for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert shuffled == {tuple(r) for r in breakdown.breakdown_by(stored, "category").collect()}


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_one_hot_key_gives_the_same_result(spark, stored):
    """A third of all sales with one product and one order: same sums as by hand."""
    sales = stored.sales
    hot = sales.withColumn("hot", F.expr("pmod(hash(order_id, product_id), 3) = 0")).selectExpr(
        "* except (hot, product_id, order_id)",
        "if(hot, 1, product_id) as product_id",
        "if(hot, 1, order_id) as order_id",
    )
    tables = type(stored)(**(stored.present() | {"sales": hot}))
    got = {r.category: (r.revenue, r.orders) for r in breakdown.breakdown_by(tables, "category").collect()}
    joined = hot.join(stored.products.select("product_id", "category"), "product_id", "left")
    want = {
        r.category: (round(float(r.s), 2), r.n)
        for r in joined.groupBy("category").agg(F.sum("revenue").alias("s"), F.count_distinct("order_id").alias("n")).collect()
    }
    assert {k: (pytest.approx(v[0], abs=0.011), v[1]) for k, v in want.items()} == got


def scans(df, table: str) -> int:
    """How many scans of a table a plan holds, before equal subqueries are run only once."""
    return len(re.findall(rf"Scan parquet[^\n]*\n(?:[^\n]+\n)*?Location:[^\n]*/{table}\.parquet", formatted(df)))


@pytest.mark.parametrize(
    ("name", "most"),
    [("breakdown_brand", 1), ("breakdown_region", 1), ("segment_value", 1), ("store_team_performance", 1), ("monthly_trend", 1), ("kpi_window", 2), ("period_comparison", 4)],
)
def test_the_sales_fact_is_read_once(spark, name, most):
    """Returns are a view of the same table; the last day is looked up for sales and for returns."""
    assert scans(QUERIES[name](spark, DATA), "lineitem") <= most


@pytest.mark.parametrize(
    "build",
    [
        lambda t: kpi.kpi_for_window(t, "2000-01-01", "2000-12-31"),
        lambda t: kpi.period_comparison(t, 365),
        kpi.monthly_trend,
        breakdown.segment_value,
        breakdown.store_team_performance,
        lambda t: breakdown.breakdown_by(t, "category"),
        lambda t: breakdown.breakdown_by(t, "region"),
    ],
)
def test_orders_are_counted_without_a_shuffle_by_order(stored, build):
    """Rows are combined where they are read: only group, range of ids, sums and bitmaps are dealt out."""
    dealt = re.findall(r"Exchange hashpartitioning\(([^\n]*)", plan(build(stored)))
    assert dealt and not [d for d in dealt if "order_id" in d]


def test_counts_of_texts_carry_no_amounts(spark, stored):
    """Ids that are no numbers, and groups too many for bitmaps, are counted from pairs of group and id."""
    texts = stored.sales.withColumn("order_id", F.concat(F.lit("o"), "order_id"))
    for df, few in ((texts, True), (stored.sales, False), (stored.sales, True)):
        found = sums_and_distinct(df, ["store_id"], money_sums(), {"orders": "order_id", "customers": "customer_id"}, few)
        got = {r.store_id: (r.revenue, r.orders, r.customers) for r in found.collect()}
        want = df.groupBy("store_id").agg(
            F.sum("revenue").alias("s"), F.count_distinct("order_id").alias("o"), F.count_distinct("customer_id").alias("c")
        )
        assert got == {r.store_id: (r.s, r.o, r.c) for r in want.collect()}
    pairs = re.findall(r"HashAggregate\(keys=\[store_id#\d+L?, order_id[^\n]*", plan(sums_and_distinct(texts, ["store_id"], money_sums(), {"orders": "order_id"})))
    assert pairs and not [p for p in pairs if "sum" in p]


def test_pairs_of_many_groups_are_sorted_and_not_held(spark, stored):
    """Products and orders hardly ever meet twice: no hash table holds their pairs, and each is still counted once."""
    top = breakdown.breakdown_by(stored, "product")
    assert "order_id" in plan(top) and not re.findall(r"HashAggregate\(keys=\[[^\]]*order_id", plan(top))
    pairs = [("a", "x"), ("a", "x"), ("a", "y"), ("a", None), ("b", None), (None, "x"), (None, "x"), ("b", "")]
    df = spark.createDataFrame(pairs, "g string, id string").repartition(3)
    found = sums_and_distinct(df, ["g"], {"n": F.lit(1)}, {"ids": "id"}, few=False)
    assert {tuple(r) for r in found.collect()} == {("a", 4, 2), ("b", 2, 1), (None, 2, 1)}


def test_bitmaps_count_all_kinds_of_whole_numbers(spark):
    ids = [None, 0, 1, -1, 32767, 32768, 32769, -32767, -32768, 2**62, -(2**62), 7, 7, None]
    df = spark.createDataFrame([(i, "a") for i in ids] + [(None, "b"), (1, None)], "id long, g string")
    found = sums_and_distinct(df, ["g"], {"n": F.lit(1)}, {"ids": "id"})
    assert {(r.g, r.n, r.ids) for r in found.collect()} == {("a", 14, 11), ("b", 1, 0), (None, 1, 1)}
    nothing = sums_and_distinct(df.where("false"), [], {"n": F.lit(1)}, {"ids": "id"}).collect()
    assert [tuple(r) for r in nothing] == [(None, 0)]


def test_findings_and_answers_read_sales_and_returns_once(spark):
    tables = views.retail(spark, DATA)
    assert scans(lattice.sales_pass(tables), "lineitem") == 1
    assert scans(lattice.returns_pass(tables), "lineitem") == 1
    summed = lattice.lattice(tables)
    for df in (
        findings.findings(tables, summed=summed),
        findings.findings_evidence(tables, summed=summed),
        questions.answer_questions(tables, views.questions(spark, DATA), summed=summed),
    ):
        assert scans(df, "lineitem") == 0


def test_the_lattice_rolls_up_to_the_tables(spark, stored):
    summed = lattice.lattice(stored)
    for by in (lambda t: kpi.growth_gap(t, 365), breakdown.segment_value, lambda t: targets.target_vs_actual(t, "2001-07")):
        assert [tuple(r) for r in by(summed.by_order).collect()] == [tuple(r) for r in by(stored).collect()]
    category = [tuple(r) for r in breakdown.breakdown_by(summed.by_product, "category", orders=False).collect()]
    assert category == [tuple(r) for r in breakdown.breakdown_by(stored, "category", orders=False).collect()]
