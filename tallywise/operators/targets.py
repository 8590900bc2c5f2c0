"""Monthly store targets against what happened."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallywise.fixed_values import ON_TIME_STATUS
from tallywise.functions.numbers import money, percent, round_to
from tallywise.functions.texts import month_key
from tallywise.operators.enrich import dimension
from tallywise.sources.retail import RetailTables


def target_vs_actual(tables: RetailTables, month: str | None = None) -> DataFrame:
    """Attainment and gaps per store for a month ``yyyy-MM``; default: the latest one.

    Sales, deliveries and refunds of the month are each summed per store and stacked,
    so one small grouping replaces a chain of joins. A refund belongs to the store
    that sold the order: refunds are summed per order first, so a much-returned order
    is one row in the join with the sales, and returns are read once.
    """
    first_day = F.to_date(F.concat(F.lit(month) if month else F.max("month"), F.lit("-01")))
    if month is None:
        first_day = tables.targets.agg(first_day.alias("first_day")).scalar()
    next_month = F.add_months(first_day, 1)

    def in_month(df: DataFrame, date_col: str) -> DataFrame:
        return df.filter((F.col(date_col) >= first_day) & (F.col(date_col) < next_month))

    sold = (
        in_month(tables.sales, "order_date")
        .groupBy("store_id")
        .agg(
            F.sum(money("revenue")).alias("revenue"),
            F.sum(money("gross_profit")).alias("gross_profit"),
        )
    )
    delivered = (
        in_month(tables.deliveries, "order_date")
        .groupBy("store_id")
        .agg(
            F.count_if(F.col("delivery_status") == ON_TIME_STATUS).alias("on_time"),
            F.count(F.lit(1)).alias("deliveries"),
        )
    )
    refunds = (
        in_month(tables.returns, "return_date")
        .groupBy("order_id")
        .agg(F.sum(money("refund_amount")).alias("refund"))
    )
    # one row per refunded order meets that order's sales; the grouping needs no shuffle of its own
    order_store = refunds.join(tables.sales.select("order_id", "store_id"), "order_id")
    order_store = order_store.groupBy("order_id").agg(
        F.min("store_id").alias("store_id"), F.max("refund").alias("refund")
    )
    refunded = order_store.groupBy("store_id").agg(F.sum("refund").alias("refund"))
    stacked = sold.unionByName(delivered, allowMissingColumns=True).unionByName(
        refunded, allowMissingColumns=True
    )
    actual = (
        stacked.filter(F.col("store_id").isNotNull())
        .groupBy("store_id")
        .agg(
            F.sum("revenue").cast("double").alias("revenue"),
            F.sum("gross_profit").cast("double").alias("gross_profit"),
            F.sum("on_time").alias("on_time"),
            F.sum("deliveries").alias("deliveries"),
            F.sum("refund").cast("double").alias("refund"),
        )
        .select(
            "store_id",
            "revenue",
            "gross_profit",
            percent("on_time", "deliveries").alias("on_time_pct"),
            percent("refund", "revenue").alias("return_rate_pct"),
        )
    )
    stores = dimension(tables, "stores").select("store_id", "store_name", "region")
    zero = F.lit(0.0)
    return (
        tables.targets.filter(F.col("month") == month_key(first_day))
        .join(actual, "store_id", "left")
        .join(stores, "store_id", "left")
        .withColumn("actual_revenue", F.coalesce("revenue", zero))
        .withColumn("actual_gross_profit", F.coalesce("gross_profit", zero))
        .select(
            "month",
            "store_id",
            "store_name",
            "region",
            F.col("revenue_target").cast("double").alias("revenue_target"),
            F.col("gross_profit_target").cast("double").alias("gross_profit_target"),
            "on_time_delivery_target_pct",
            "return_rate_target_pct",
            round_to("actual_revenue").alias("actual_revenue"),
            round_to("actual_gross_profit").alias("actual_gross_profit"),
            round_to("on_time_pct").alias("on_time_pct"),
            round_to("return_rate_pct").alias("return_rate_pct"),
            round_to(percent("actual_revenue", "revenue_target")).alias("revenue_attainment_pct"),
            round_to(percent("actual_gross_profit", "gross_profit_target")).alias(
                "profit_attainment_pct"
            ),
            round_to(
                F.coalesce("on_time_pct", zero) - F.col("on_time_delivery_target_pct")
            ).alias("on_time_gap_pp"),
            round_to(F.coalesce("return_rate_pct", zero) - F.col("return_rate_target_pct")).alias(
                "return_rate_gap_pp"
            ),
        )
        .orderBy(F.asc_nulls_last("revenue_attainment_pct"), F.asc_nulls_last("store_id"))
    )
