"""Profiles, mappings and analyses of tables with an unknown schema."""

from __future__ import annotations

import random
import statistics
from decimal import Decimal

import numpy as np
import pytest

from tallywise import fixed_values as fixed
from tallywise.operators import generic, mapping, profile, stats
from tallywise.plans import user_tables
from tallywise.sources.files import read_csv

RETAIL = """transaction_date,sales_amount,cost,product_name,customer_id,region
2026-01-01,100.00,60.00,Widget A,C001,North
2026-01-02,150.00,90.00,Widget B,C002,South
2026-01-15,200.00,80.00,Widget A,C001,North
2026-02-01,120.00,70.00,Widget C,C003,East
2026-02-10,300.00,150.00,Widget B,C002,South
"""
STAFF = """employee_name,department,salary,performance_score
Alice,Engineering,90000,4.2
Bob,Sales,70000,3.8
Carol,Engineering,95000,4.6
"""


@pytest.fixture(scope="module")
def load(spark, tmp_path_factory):
    def read(text):
        path = tmp_path_factory.mktemp("t") / "t.csv"
        path.write_text(text)
        return read_csv(spark, str(path))

    return read


def mapped(df):
    facts = mapping.column_facts({"t": df})["t"]
    return mapping.suggest_mapping(facts)


@pytest.fixture(scope="module")
def retail(load):
    df = load(RETAIL)
    return df, mapping.canonical_frame(df, mapped(df))


def test_profile(load, rows):
    got = {r["column_name"]: r for r in rows(profile.column_profile(load(RETAIL)))}
    assert got["transaction_date"]["is_datelike"] and not got["transaction_date"]["is_numeric"]
    assert got["sales_amount"]["is_numeric"] and not got["product_name"]["is_numeric"]
    assert got["product_name"]["distinct_count"] == 3 and got["region"]["row_count"] == 5


@pytest.mark.parametrize("distinct", ["exact", "approx", None])
def test_profile_counts_missing_nan_and_long_texts(spark, rows, distinct):
    long = "x" * 200
    df = spark.createDataFrame(
        [(1.0, long, True), (float("nan"), long, None), (None, long + "y", True), (-0.0, None, False), (0.0, "z", True)],
        "x double, s string, b boolean",
    )
    got = {r["column_name"]: r for r in rows(profile.column_profile(df, distinct))}
    assert [got[c]["missing_count"] for c in "xsb"] == [2, 1, 1]
    assert got["x"]["missing_pct"] == 40.0 and got["b"]["is_numeric"]
    if distinct:
        assert [got[c]["distinct_count"] for c in "xsb"] == [2, 3, 2]


def test_date_likeness_needs_most_values(spark, rows):
    df = spark.createDataFrame(
        [("2026-01-05", "2026-01-05", "a")] * 4 + [("soon", "soon", "b"), (None, "later", "c")],
        "mostly string, too_few string, never string",
    )
    got = {r["column_name"]: r["is_datelike"] for r in rows(profile.column_profile(df))}
    assert got == {"mostly": True, "too_few": False, "never": False}


def test_mapping_of_a_retail_table(load):
    got = mapped(load(RETAIL))
    assert {c: n for c, n in got.items() if n} == {
        "date": "transaction_date", "revenue": "sales_amount", "cost": "cost",
        "product": "product_name", "customer": "customer_id", "region": "region",
    }


def test_mapping_never_takes_text_for_numbers(load):
    got = mapped(load(STAFF))
    assert got["revenue"] is None and got["cost"] is None and got["employee"] == "employee_name"


def test_mapping_rules():
    def suggest(*columns):
        return mapping.suggest_mapping([mapping.ColumnFacts(*c) for c in columns])

    # an exact synonym beats an earlier column that only contains one
    assert suggest(("my_revenue_x", True, False), ("Sales", True, False))["revenue"] == "Sales"
    # the winner has the wrong type: the runner-up is not tried, the column stays free
    got = suggest(("amount", False, False), ("total_amount_2", True, False))
    assert got["revenue"] is None
    # names that collide after normalisation: the last one counts
    assert suggest(("Unit Cost", True, False), ("unit_cost", True, False))["cost"] == "unit_cost"
    # a column is used once
    got = suggest(("product_category", False, False))
    assert (got["product"], got["category"]) == ("product_category", None)


def test_candidate_columns(load, rows):
    def options(df):
        found = {}
        for r in rows(mapping.candidate_columns(profile.column_profile(df))):
            found.setdefault(r["concept"], []).append(r["column_name"])
        return found

    got = options(load(RETAIL))
    assert got["date"] == ["transaction_date"]
    assert set(got["revenue"]) == {"sales_amount", "cost"}
    assert "transaction_date" not in got["product"] and "product_name" in got["product"]
    flags = options(load("id,returned,note\n1,yes,a\n2,no,b\n3,yes,c\n4,no,d\n"))
    assert flags["return_flag"] == ["returned"]


def test_canonical_frame(retail):
    df, frame = retail
    assert "employee" not in frame.columns and "profit" in frame.columns
    assert dict(frame.dtypes)["date"] == "timestamp_ntz"
    assert frame.count() == df.count()


def test_canonical_values_that_do_not_convert(spark, rows):
    df = spark.createDataFrame(
        [("01/31/2026", "12.5", "yes"), ("never", "x", "NO"), (None, None, None), ("2026-02-01", " 7 ", "1")],
        "d string, m string, f string",
    )
    frame = mapping.canonical_frame(df, {"date": "d", "revenue": "m", "return_flag": "f", "cost": "gone"})
    got = rows(frame)
    assert [str(r["date"])[:10] for r in got] == ["2026-01-31", "None", "None", "2026-02-01"]
    assert [r["revenue"] for r in got] == [12.5, None, None, 7.0]
    assert rows(generic.returns_summary(frame)) == [
        {"total_records": 4, "returned_records": 2, "return_rate_pct": 50.0}
    ]


def test_capabilities(spark, retail, load, rows):
    able = mapping.capabilities(retail[1].columns)
    assert able["Revenue trend over time"] and able["Profitability"] and able["Regional / store performance"]
    assert not able["Employee performance"] and not able["Returns analysis"]
    staff = load(STAFF)
    frame = mapping.canonical_frame(staff, mapped(staff))
    assert not any(mapping.capabilities(frame.columns).values())
    assert mapping.missing_requirements("Profitability", ["date"]) == ["revenue", "profit or cost"]
    assert mapping.missing_requirements("Regional / store performance", ["revenue"]) == ["region or store"]
    matrix = rows(mapping.capability_matrix(spark, {"revenue", "cost"}))
    assert [r["analysis"] for r in matrix if r["supported"]] == ["Profitability"]


def test_sums_windows_and_breakdowns(retail, rows):
    frame = retail[1]
    kpi = rows(generic.kpi_summary(frame))[0]
    assert (kpi["revenue"], kpi["profit"], kpi["records"]) == (870.0, 420.0, 5)
    window = rows(generic.date_window(frame))[0]
    assert (str(window["start_date"])[:10], str(window["end_date"])[:10]) == ("2026-01-01", "2026-02-10")
    top = rows(generic.breakdown(frame, "product", 5))
    assert [(r["product"], r["revenue"]) for r in top] == [
        ("Widget B", 450.0), ("Widget A", 300.0), ("Widget C", 120.0),
    ]
    assert generic.breakdown(frame, "employee") is None
    growth = rows(generic.growth_comparison(frame))[0]
    assert (growth["latest_revenue"], growth["previous_revenue"]) == (620.0, 250.0)
    assert growth["revenue_pct_change"] == 148.0
    assert growth["growth_gap_pp"] == round(148.0 - growth["profit_pct_change"], 2)
    assert rows(generic.growth_comparison(frame.limit(0))) == []
    trend = generic.revenue_trend(frame)
    assert [r["revenue"] for r in rows(trend)] == [450.0, 420.0]
    assert [r["change_pct"] for r in rows(stats.period_change(trend))] == [-6.7]
    assert [r["margin_pct"] for r in rows(stats.margin_trend(trend))] == [48.89, 47.62]


def test_analyses_without_their_concepts(spark):
    frame = spark.createDataFrame([(1,)], "category int")
    for analysis in (
        generic.date_window, generic.kpi_summary, generic.revenue_trend, generic.growth_comparison,
        generic.returns_summary, generic.composition, generic.value_spread, generic.margin_trade_off,
    ):
        assert analysis(frame) is None
    assert user_tables.user_findings(frame) is None


def test_composition(spark, rows):
    frame = spark.createDataFrame(
        [("a", "x", 1.0), ("a", "x", 2.0), ("a", "y", 4.0), ("b", "x", None), (None, "x", 9.0), ("b", None, 9.0)],
        "category string, product string, revenue double",
    )
    got = [(r["category"], r["product"], r["is_total"], r["revenue"]) for r in rows(generic.composition(frame))]
    assert got == [
        ("a", None, True, 7.0), ("a", "x", False, 3.0), ("a", "y", False, 4.0),
        ("b", None, True, 0.0), ("b", "x", False, 0.0),
    ]


def test_histogram(spark, rows):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 3, 30, 30]] + [(None,)], "v double")
    got = rows(stats.histogram(df, "v", 30))
    assert len(got) == 30 and sum(r["records"] for r in got) == 6
    assert got[0]["records"] == 1 and got[29]["records"] == 2
    flat = rows(stats.histogram(df.filter("v = 30"), "v", 4))
    assert [r["records"] for r in flat] == [2, 0, 0, 0]
    assert rows(stats.histogram(df.limit(0), "v")) == []


@pytest.mark.parametrize("few_groups", [True, False])
def test_quartiles_are_exact_whatever_the_slices(spark, rows, few_groups):
    rng = random.Random(7)
    data = {
        "one": [5.0],
        "two": [1.0, 2.0],
        "same": [3.0] * 500,
        "skewed": [1.0] * 300 + [rng.expovariate(0.001) for _ in range(200)],
        "wide": [round(rng.uniform(-1e6, 1e6), 2) for _ in range(1000)],
        None: [rng.choice([1.0, 2.0, 10.0]) for _ in range(77)],
    }
    df = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs], "g string, v double")
    for slices in (2, 7, 64):
        got = {r["g"]: r for r in rows(stats.quartiles(df, "g", "v", slices, few_groups))}
        assert set(got) == set(data)
        for g, values in data.items():
            want = np.percentile(values, [0, 25, 50, 75, 100])
            have = [got[g][k] for k in ("minimum", "q1", "median", "q3", "maximum")]
            assert have == pytest.approx(list(want)), (g, slices)
            assert got[g]["records"] == len(values)


def test_value_spread_needs_more_than_two_products(spark, rows):
    frame = spark.createDataFrame(
        [(p, float(v)) for p in "abcdefgh" for v in range(ord(p) - 96)], "product string, revenue double"
    )
    got = rows(generic.value_spread(frame))
    assert [r["product"] for r in got] == list("cdefgh")
    assert got[0]["median"] == statistics.median(range(3))
    assert rows(generic.value_spread(frame.filter("product in ('a', 'b')"))) == []


def test_quality(load, spark, rows):
    got = rows(profile.data_quality_score(load("a,b\n1,2\n1,2\n,4\n")))[0]
    assert got["duplicate_pct"] == 33.33 and got["avg_missing_pct"] == 16.66
    assert got["score"] == 100 - 25 - 20 and len(got["notes"]) == 2
    assert rows(profile.dataset_profile(load("a,b\n1,2\n1,2\n,4\n,4\n")))[0]["duplicate_rows"] == 2
    clean = rows(profile.data_quality_score(spark.range(3)))[0]
    assert clean["score"] == 100 and clean["notes"] == ["No major data quality issues detected."]


def test_findings_and_answers(spark, retail, rows):
    from tallywise.operators.grounding import numbers_grounded

    frame = retail[1]
    found = rows(user_tables.user_findings(frame))
    assert [r["finding_id"] for r in found] == ["user_growth_gap", "user_top_product", "user_top_customer"]
    assert found[1]["summary"] == "Widget B generates the most revenue at 450.00 (46.7% margin)."
    asked = spark.createDataFrame(
        [("What is our total revenue?",), ("Which delivery partner performs worst?",),
         ("Which employees perform best?",), ("What can I ask?",), ("Is profit keeping up?",),
         ("Which products sell?",)],
        "question string",
    )
    got = {r["question"]: r for r in rows(user_tables.answer_user_questions(frame, asked))}
    assert got["What is our total revenue?"]["answer"] == (
        "Total revenue is 870.00 across 5 records. Profit is 420.00 (48.3% margin)."
    )
    unknown = got["Which delivery partner performs worst?"]
    assert not unknown["supported"] and unknown["answer"].startswith(fixed.USER_FALLBACK_HEAD)
    assert "delivery" not in unknown["answer"].lower()
    refused = got["Which employees perform best?"]
    assert not refused["supported"] and "cannot answer" in refused["answer"] and "employee" in refused["answer"]
    assert "- What is our margin?" in got["What can I ask?"]["answer"]
    assert got["Is profit keeping up?"]["intent"] == "profitability"
    assert got["Which products sell?"]["intent"] == "breakdown_product"
    growth = generic.growth_comparison(frame).selectExpr("'user_growth_gap' as finding_id", "*")
    summary = user_tables.user_findings(frame).filter("finding_id = 'user_growth_gap'")
    assert rows(numbers_grounded(summary, growth, "finding_id", "summary"))[0]["numbers_grounded"]


def test_answers_without_dates_or_revenue(spark, rows):
    asked = spark.createDataFrame([("What is our margin?",), ("What is our revenue?",)], "question string")
    undated = spark.createDataFrame([(10.0, 4.0)], "revenue double, profit double")
    got = {r["question"]: r for r in rows(user_tables.answer_user_questions(undated, asked))}
    assert got["What is our margin?"]["answer"].startswith("Not enough dated records")
    empty_dates = spark.createDataFrame([(None, 10.0, 4.0)], "date timestamp, revenue double, profit double")
    got = {r["question"]: r for r in rows(user_tables.answer_user_questions(empty_dates, asked))}
    assert got["What is our margin?"]["answer"].startswith("Not enough dated records")
    nothing = spark.createDataFrame([("Alice",)], "employee string")
    got = {r["question"]: r for r in rows(user_tables.answer_user_questions(nothing, asked))}
    assert not got["What is our revenue?"]["supported"]


def test_exact_sums_stay_exact(spark, rows):
    frame = spark.createDataFrame([(Decimal("0.10"),)] * 3, "revenue decimal(18,2)")
    assert rows(generic.kpi_summary(frame))[0]["revenue"] == 0.3
