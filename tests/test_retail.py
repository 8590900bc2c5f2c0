"""Retail analyses on a small shop, against sums done by hand in plain Python."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest
from pyspark.errors import AnalysisException

from tallywise import RetailTables, load_retail_tables
from tallywise.operators import breakdown, delivery, enrich, inventory, kpi, marketing, returns, stats, targets
from tallywise.plans import findings as plans
from tallywise.sources.retail import SCHEMAS

# order, day, customer, product, store, channel, units, revenue, cost
SALES = [
    ("O1", date(2026, 1, 1), "C1", "P1", "S1", "web", 1, 100.0, 60.0),
    ("O2", date(2026, 1, 20), "C2", "P2", "S2", "web", 2, 200.0, 150.0),
    ("O2", date(2026, 1, 20), "C2", "P1", "S2", "web", 1, 50.0, 30.0),
    ("O3", date(2026, 2, 10), "C1", "P3", "S1", "shop", 4, 400.0, 380.0),
    ("O4", date(2026, 2, 19), "C9", "P9", None, "shop", 5, 0.0, 0.0),
    ("O5", date(2026, 2, 19), None, "P2", "S2", None, 1, 100.0, 80.0),
]
RETURNS = [
    ("R1", "O2", date(2026, 2, 1), "P2", 1, "Damaged", 100.0),
    ("R2", "O3", date(2026, 2, 15), "P3", 1, "Late", 100.0),
    ("R3", "O3", date(2026, 2, 16), "P3", 1, "Damaged", 90.0),
    ("R4", "O4", date(2026, 2, 19), "P9", 1, None, 10.0),
]
DELIVERIES = [
    ("O1", date(2026, 1, 1), "S1", "D1", 3, 5, "Delayed", 2.0),
    ("O2", date(2026, 1, 20), "S2", "D1", 3, 3, "On Time", 4.0),
    ("O3", date(2026, 2, 10), "S1", "D2", 3, 3, "On Time", 5.0),
    ("O5", date(2026, 2, 19), "S2", "D2", 3, 2, "On Time", 4.0),
    ("O4", date(2026, 2, 19), "S1", None, 3, 9, "Delayed", 1.0),
]
STOCK = [
    (date(2026, 2, 1), "S1", "P1", "True", "False"),
    (date(2026, 2, 2), "S1", "P1", "true", "FALSE"),
    (date(2026, 2, 1), "S2", "P3", "TRUE", "false"),
    (date(2026, 2, 1), "S1", "P3", "False", "True"),
    (date(2026, 2, 1), "S1", "P9", "True", "False"),
    (date(2026, 2, 1), None, "P1", "True", "True"),
]


@pytest.fixture(scope="module")
def shop(spark):
    def df(rows, schema):
        return spark.createDataFrame(rows, schema)

    sales = [(*r, r[7] - r[8]) for r in SALES]
    return RetailTables(
        sales=df(
            sales,
            "order_id string, order_date date, customer_id string, product_id string, store_id string,"
            " channel string, quantity int, revenue double, cost double, gross_profit double",
        ).selectExpr("*", "'stale' as category"),
        products=df(
            [("P1", "Widget", "Tools", "A"), ("P2", "Lamp", "Light", "B"), ("P3", "Saw", "Tools", "B")],
            "product_id string, product_name string, category string, brand string",
        ),
        stores=df([("S1", "North Store", "North"), ("S2", "South Store", "South")],
                  "store_id string, store_name string, region string"),
        customers=df([("C1", "Retail"), ("C2", "Wholesale")], "customer_id string, segment string"),
        employees=df(
            [("E1", "S1", "Store Manager"), ("E2", "S1", "Sales Associate"), ("E3", None, "Store Manager")],
            "employee_id string, store_id string, role string",
        ),
        returns=df(
            RETURNS,
            "return_id string, order_id string, return_date date, product_id string, quantity int,"
            " return_reason string, refund_amount double",
        ),
        deliveries=df(
            DELIVERIES,
            "order_id string, order_date date, store_id string, delivery_partner_id string,"
            " promised_days int, actual_days int, delivery_status string, delivery_rating double",
        ),
        delivery_partners=df([("D1", "Swift"), ("D2", "Parcel")],
                             "delivery_partner_id string, partner_name string"),
        marketing=df(
            [("M1", "Spring", 100.0, 300.0, 2.0), ("M2", "Summer", 50.0, 300.0, 5.0),
             ("M3", "Autumn", 50.0, 300.0, 5.0), ("M4", "Winter", 10.0, 10.0, None)],
            "campaign_id string, campaign_name string, spend double, attributed_revenue double, roi double",
        ),
        inventory_daily=df(
            STOCK,
            "snapshot_date date, store_id string, product_id string, stockout_flag string,"
            " excess_stock_flag string",
        ),
        targets=df(
            [("2026-02", "S1", 500.0, 100.0, 90.0, 5.0), ("2026-02", "S2", 50.0, 10.0, 90.0, 5.0),
             ("2026-02", "S3", 10.0, 10.0, 90.0, 5.0), ("2026-01", "S1", 1.0, 1.0, 90.0, 5.0)],
            "month string, store_id string, revenue_target double, gross_profit_target double,"
            " on_time_delivery_target_pct double, return_rate_target_pct double",
        ),
    )


def emptied(shop):
    return RetailTables(**{name: df.limit(0) for name, df in shop.present().items()})


def test_one_window(shop, rows):
    got = rows(kpi.kpi_for_window(shop, "2026-01-01", "2026-02-10"))
    assert got == [
        {"revenue": 750.0, "gross_profit": 130.0, "margin_pct": 17.33, "orders": 3, "units": 8,
         "avg_order_value": 250.0, "return_value": 100.0, "net_revenue": 650.0}
    ]
    nothing = rows(kpi.kpi_for_window(shop, "2030-01-01", "2030-01-02"))[0]
    assert nothing["revenue"] == nothing["margin_pct"] == nothing["avg_order_value"] == 0.0
    assert nothing["orders"] == 0 and nothing["units"] == 0


def test_two_adjacent_windows(shop, rows):
    got = rows(kpi.growth_gap(shop, 30))[0]
    assert (got["latest_start"], got["latest_end"]) == (date(2026, 1, 21), date(2026, 2, 19))
    assert (got["previous_start"], got["previous_end"]) == (date(2025, 12, 22), date(2026, 1, 20))
    assert (got["latest_revenue"], got["previous_revenue"]) == (500.0, 350.0)
    assert (got["latest_orders"], got["previous_orders"]) == (3, 2)
    assert got["latest_return_value"] == 300.0 and got["previous_return_value"] == 0.0
    assert got["revenue_pct"] == pytest.approx(150 / 350 * 100)
    assert got["gross_profit_pct"] == pytest.approx((40 - 110) / 110 * 100)
    assert got["margin_pp"] == round(40 / 500 * 100 - 110 / 350 * 100, 2)
    assert got["growth_gap_pp"] == round(150 / 350 * 100 + 70 / 110 * 100, 2)
    assert got["margin_pressure"] is True


def test_window_longer_than_the_data_has_no_change(shop, rows):
    got = rows(kpi.growth_gap(shop, 400))[0]
    assert got["previous_revenue"] == 0.0 and got["revenue_pct"] is None and got["orders_pct"] is None
    assert got["growth_gap_pp"] == 0.0 and got["margin_pressure"] is False
    summary = rows(plans.profitability_finding(shop, 400))[0]["summary"]
    assert summary.startswith("Revenue changed n/a% and gross profit changed n/a%")


def test_breakdown_keeps_unknown_values_and_sums_to_the_total(shop, rows):
    got = rows(breakdown.breakdown_by(shop, "category"))
    assert [(r["category"], r["revenue"], r["orders"], r["units"]) for r in got] == [
        ("Tools", 550.0, 3, 6), ("Light", 300.0, 2, 3), (None, 0.0, 1, 5),
    ]
    assert got[0]["margin_pct"] == round(80 / 550 * 100, 2) and got[2]["margin_pct"] == 0.0
    for name in breakdown.DIMENSION_COLUMNS:
        assert sum(r["revenue"] for r in rows(breakdown.breakdown_by(shop, name))) == 850.0, name
    late = rows(breakdown.breakdown_by(shop, "region", "2026-02-01", "2026-02-28"))
    assert [(r["region"], r["revenue"]) for r in late] == [("North", 400.0), ("South", 100.0), (None, 0.0)]
    assert len(rows(breakdown.breakdown_by(shop, "product", top_n=2))) == 2
    assert len(rows(breakdown.breakdown_by(shop, "product", top_n=0))) == 4
    with pytest.raises(ValueError, match="Unknown dimension"):
        breakdown.breakdown_by(shop, "colour")


def test_enriched_category_comes_from_the_product(shop, rows):
    got = rows(enrich.sales_enriched(shop))
    assert len(got) == len(SALES)
    assert {r["category"] for r in got} == {"Tools", "Light", None}


def test_store_teams(shop, rows):
    got = rows(breakdown.store_team_performance(shop))
    assert [r["store_id"] for r in got] == ["S1", "S2", None]
    first = got[0]
    assert (first["headcount"], first["managers"], first["revenue_per_employee"]) == (2, 1, 250.0)
    assert got[1]["headcount"] is None and got[1]["revenue_per_employee"] is None


def test_segments(shop, rows):
    got = {r["customer_segment"]: r for r in rows(breakdown.segment_value(shop))}
    assert (got["Retail"]["revenue"], got["Retail"]["customers"], got["Retail"]["orders"]) == (500.0, 1, 2)
    unknown = got[None]
    assert (unknown["revenue"], unknown["customers"], unknown["orders"]) == (100.0, 1, 2)


def test_monthly_trend(shop, rows):
    got = rows(kpi.monthly_trend(shop))
    assert [(str(r["month"]), r["revenue"], r["orders"]) for r in got] == [
        ("2026-01-01", 350.0, 2), ("2026-02-01", 500.0, 3),
    ]


def test_returns_by_category_and_reason(shop, rows):
    got = rows(returns.return_analysis(shop))
    assert [(r["category"], r["returned_units"], r["units_sold"], r["return_rate_pct"]) for r in got] == [
        ("Light", 1, 3, 33.33), ("Tools", 2, 6, 33.33), (None, 1, 5, 20.0),
    ]
    reasons = rows(returns.return_reasons(shop, "Tools"))
    assert [(r["return_reason"], r["events"], r["refund_value"]) for r in reasons] == [
        ("Damaged", 1, 90.0), ("Late", 1, 100.0),
    ]


def test_delivery(shop, rows):
    got = rows(delivery.delivery_performance(shop))
    assert [(r["delivery_partner_id"], r["total_deliveries"], r["delayed"], r["delayed_rate_pct"], r["avg_rating"])
            for r in got] == [("D1", 2, 1, 50.0, 3.0), ("D2", 2, 0, 0.0, 4.5)]
    weeks = rows(delivery.delivery_trend(shop, "D1"))
    assert [str(r["period"]) for r in weeks] == ["2025-12-29", "2026-01-19"]
    months = rows(delivery.delivery_trend(shop, "D1", "M"))
    assert [(str(r["period"]), r["total"]) for r in months] == [("2026-01-01", 2)]


def test_campaigns(shop, rows):
    assert [r["campaign_id"] for r in rows(marketing.campaign_roi(shop))] == ["M2", "M3", "M1", "M4"]
    ends = rows(marketing.best_and_worst_campaign(shop))[0]
    assert (ends["best_campaign"], ends["worst_campaign"], ends["worst_roi"]) == ("Summer", "Winter", None)


def test_stock(shop, rows):
    got = rows(inventory.stockout_hotspots(shop))
    assert [(r["store_id"], r["product_id"], r["stockout_days"], r["category"]) for r in got] == [
        ("S1", "P1", 2, "Tools"), ("S1", "P9", 1, None), ("S2", "P3", 1, "Tools"),
    ]
    assert len(rows(inventory.stockout_hotspots(shop, 1))) == 1
    assert rows(inventory.inventory_imbalance(shop)) == [
        {"top_stockout_category": "Tools", "top_stockout_category_days": 3, "top_excess_category": "Tools",
         "top_excess_category_days": 1, "affected_store_product_pairs_stockout": 3,
         "affected_store_product_pairs_excess": 1}
    ]


def test_targets_of_the_latest_month(shop, rows):
    got = {r["store_id"]: r for r in rows(targets.target_vs_actual(shop))}
    assert set(got) == {"S1", "S2", "S3"}
    s1, s2, s3 = got["S1"], got["S2"], got["S3"]
    assert (s1["actual_revenue"], s1["revenue_attainment_pct"], s1["on_time_pct"]) == (400.0, 80.0, 50.0)
    # refunds of the month belong to the store that sold the order: O3 at S1, O2 at S2
    assert s1["return_rate_pct"] == 47.5 and s2["return_rate_pct"] == 100.0
    assert s1["return_rate_gap_pp"] == 42.5 and s1["on_time_gap_pp"] == -40.0
    assert (s3["actual_revenue"], s3["on_time_pct"], s3["on_time_gap_pp"]) == (0.0, None, -90.0)
    assert [r["store_id"] for r in rows(targets.target_vs_actual(shop))] == ["S3", "S1", "S2"]
    assert rows(targets.target_vs_actual(shop, "2026-01"))[0]["actual_revenue"] == 100.0
    assert rows(targets.target_vs_actual(shop, "1999-01")) == []


def test_outliers(spark, rows):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0), ("d", 9.0), ("e", None)], "k string, v double")
    got = rows(stats.zscore_outliers(df, "v", 1.5, "k"))
    assert [(r["k"], r["zscore"], r["is_outlier"]) for r in got] == [
        ("d", 1.73, True), ("a", -0.58, False), ("b", -0.58, False), ("c", -0.58, False), ("e", None, False),
    ]
    same = rows(stats.zscore_outliers(df.filter("v = 1"), "v"))
    assert all(r["zscore"] == 0.0 and not r["is_outlier"] for r in same)


def test_findings_are_ranked_and_grounded(spark, shop, rows):
    from tallywise.operators.grounding import numbers_grounded

    found = plans.findings(shop)
    got = rows(found)
    assert len(got) == 6
    order = [plans.fixed.SEVERITY_RANK[r["severity"]] for r in got]
    assert order == sorted(order)
    evidence = plans.findings_evidence(shop).select("finding_id", "numbers", "entity")
    checked = rows(numbers_grounded(found, evidence, "finding_id", "summary"))
    assert {r["finding_id"] for r in checked if r["numbers_grounded"]} == {r["finding_id"] for r in got}


def test_findings_without_data(shop, rows):
    got = rows(plans.findings(emptied(shop)))
    assert [r["category"] for r in got] == ["inventory"]
    assert got[0]["summary"] == "No material stockout or excess-inventory imbalance detected."


def test_catalog_reads_csv_by_header_name_and_parquet(spark, tmp_path, rows):
    (tmp_path / "stores.csv").write_text(" store_name ,store_id,region,extra\nNorth Store,S1,North,x\n")
    (tmp_path / "targets.csv").write_text(
        "month,store_id,revenue_target,gross_profit_target,on_time_delivery_target_pct,return_rate_target_pct\n"
        "2026-01,S001,335025,89869,92.0,6.0\n"
    )
    loaded = load_retail_tables(spark, str(tmp_path), "csv", only=("stores", "targets"))
    assert rows(loaded.stores) == [
        {"store_name": "North Store", "store_id": "S1", "region": "North", "extra": "x"}
    ]
    assert rows(loaded.targets)[0]["revenue_target"] == Decimal("335025.0000")
    loaded.stores.write.parquet(str(tmp_path / "out" / "stores.parquet"))
    again = load_retail_tables(spark, str(tmp_path / "out"), only=("stores",))
    assert set(again.present()) == {"stores"} and rows(again.stores) == rows(loaded.stores)
    again.register("t_")
    assert spark.sql("select count(*) as n from t_stores").first().n == 1
    again.cache("stores")
    assert again.stores.is_cached
    again.clear_cache()
    assert not again.stores.is_cached
    with pytest.raises(AnalysisException):
        load_retail_tables(spark, str(tmp_path), only=("sales",))
    assert len(SCHEMAS) == 12
