"""Key figures of a window, of two adjacent windows, and by month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallywise.fixed_values import GROWTH_GAP_LIMIT_PP, WINDOW_DAYS
from tallywise.functions.numbers import (
    change_pct,
    money,
    percent,
    percent_or_zero,
    ratio,
    round_to,
    total,
)
from tallywise.operators.summaries import as_numbers, money_sums, sums_and_distinct
from tallywise.sources.retail import RetailTables

_PERIODS = ("latest", "previous")


def _sales_sums() -> dict[str, Column]:
    return money_sums() | {"units": F.col("quantity")}


def _totals() -> dict[str, Column]:
    return as_numbers() | {"units": F.coalesce("units", F.lit(0)).cast("bigint")}


def date_range(sales: DataFrame, date_col: str = "order_date") -> DataFrame:
    """First and last date; one row, nulls when there are no rows."""
    return sales.agg(F.min(date_col).alias("start_date"), F.max(date_col).alias("end_date"))


def kpi_for_window(tables: RetailTables, start, end, date_col: str = "order_date") -> DataFrame:
    """One row of key figures for start <= date <= end; refunds count by return date."""
    inside = tables.sales.filter(F.col(date_col).between(start, end))
    sold = sums_and_distinct(inside, [], _sales_sums(), {"orders": "order_id"}).withColumns(_totals())
    refunds = (
        tables.returns.filter(F.col("return_date").between(start, end))
        .agg(total(money("refund_amount")).alias("return_value"))
        .scalar()
    )
    return sold.withColumn("return_value", refunds).select(
        round_to("revenue").alias("revenue"),
        round_to("gross_profit").alias("gross_profit"),
        round_to(percent_or_zero("gross_profit", "revenue")).alias("margin_pct"),
        "orders",
        "units",
        round_to(F.coalesce(ratio("revenue", "orders"), F.lit(0.0))).alias("avg_order_value"),
        round_to("return_value").alias("return_value"),
        round_to(F.col("revenue") - F.col("return_value")).alias("net_revenue"),
    )


def period_comparison(tables: RetailTables, window_days: int = WINDOW_DAYS) -> DataFrame:
    """The last ``window_days`` against the same number of days before; one row.

    The first day of the earlier window is a scalar subquery compared directly with
    the date columns, so it reaches the file scan and both windows come from scans
    that skip everything older. Rows are grouped by period before the two periods are
    put side by side, so both share one distinct count.
    """
    start = F.date_sub(F.max(F.to_date("order_date")), 2 * window_days - 1)
    first_day = tables.sales.agg(start.alias("first_day")).scalar()

    def inside(df: DataFrame, date_col: str) -> DataFrame:
        day, first = F.to_date(date_col), F.col("first_day")
        is_latest = day >= F.date_add(first, window_days)
        return (
            df.withColumn("first_day", first_day)
            .filter((day >= first) & (day < F.date_add(first, 2 * window_days)))
            .withColumn("period", F.when(is_latest, F.lit("latest")).otherwise(F.lit("previous")))
        )

    sold = sums_and_distinct(
        inside(tables.sales, "order_date"),
        ["period", "first_day"],  # the day is the same in all rows
        _sales_sums(),
        {"orders": "order_id"},
    ).withColumns(_totals())
    refunded = (
        inside(tables.returns, "return_date")
        .groupBy("period")
        .agg(total(money("refund_amount")).alias("return_value"))
    )
    both = sold.unionByName(refunded, allowMissingColumns=True)
    measures = ("revenue", "gross_profit", "orders", "units", "return_value")
    wide = both.agg(
        F.max("first_day").alias("first_day"),
        *[
            F.coalesce(F.max(F.when(F.col("period") == p, F.col(m))), F.lit(0)).alias(f"{p}_{m}")
            for p in _PERIODS
            for m in measures
        ]
    )
    for p in _PERIODS:
        wide = wide.withColumn(f"{p}_margin", percent_or_zero(f"{p}_gross_profit", f"{p}_revenue"))

    def figures(p: str) -> list[Column]:
        return [
            round_to(f"{p}_revenue").alias(f"{p}_revenue"),
            round_to(f"{p}_gross_profit").alias(f"{p}_gross_profit"),
            round_to(f"{p}_margin").alias(f"{p}_margin_pct"),
            F.col(f"{p}_orders").cast("bigint").alias(f"{p}_orders"),
            F.col(f"{p}_units").cast("bigint").alias(f"{p}_units"),
            round_to(F.coalesce(ratio(f"{p}_revenue", f"{p}_orders"), F.lit(0.0))).alias(
                f"{p}_avg_order_value"
            ),
            round_to(f"{p}_return_value").alias(f"{p}_return_value"),
            round_to(F.col(f"{p}_revenue") - F.col(f"{p}_return_value")).alias(f"{p}_net_revenue"),
        ]

    def day(number: int) -> Column:
        return F.date_add("first_day", number)

    return wide.select(
        F.lit(window_days).alias("window_days"),
        day(window_days).alias("latest_start"),
        day(2 * window_days - 1).alias("latest_end"),
        *figures("latest"),
        day(0).alias("previous_start"),
        day(window_days - 1).alias("previous_end"),
        *figures("previous"),
        change_pct("latest_revenue", "previous_revenue").alias("revenue_pct"),
        change_pct("latest_gross_profit", "previous_gross_profit").alias("gross_profit_pct"),
        round_to(F.col("latest_margin") - F.col("previous_margin")).alias("margin_pp"),
        change_pct("latest_orders", "previous_orders").alias("orders_pct"),
    )


def growth_gap(tables: RetailTables, window_days: int = WINDOW_DAYS) -> DataFrame:
    """Period comparison plus: is revenue growing faster than profit?"""
    gap = F.coalesce("revenue_pct", F.lit(0.0)) - F.coalesce("gross_profit_pct", F.lit(0.0))
    return period_comparison(tables, window_days).withColumns(
        {
            "growth_gap_pp": round_to(gap),
            "margin_pressure": (gap > GROWTH_GAP_LIMIT_PP) & (F.col("margin_pp") < 0),
        }
    )


def monthly_trend(tables: RetailTables) -> DataFrame:
    """Revenue, profit, orders and margin by month, oldest first."""
    sales = tables.sales.filter(F.col("order_date").isNotNull()).withColumn(
        "month", F.to_date(F.date_trunc("month", "order_date"))
    )
    return (
        sums_and_distinct(sales, ["month"], money_sums(), {"orders": "order_id"})
        .withColumns(as_numbers())
        .select(
            "month",
            round_to("revenue").alias("revenue"),
            round_to("gross_profit").alias("gross_profit"),
            "orders",
            round_to(percent("gross_profit", "revenue")).alias("margin_pct"),
        )
        .orderBy("month")
    )
