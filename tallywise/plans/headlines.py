"""The one row per topic that findings and answers are written from.

Each headline is an aggregate of an already aggregated table, so the winner, the
number of rivals and the averages come out of one pass without subqueries. A topic
without data gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallywise.fixed_values import FINDING_OUTLIER_THRESHOLD, WINDOW_DAYS
from tallywise.functions.numbers import money, ratio, round_to
from tallywise.operators.breakdown import breakdown_by, segment_value, store_team_performance
from tallywise.operators.delivery import delivery_performance
from tallywise.operators.inventory import inventory_imbalance
from tallywise.operators.kpi import growth_gap
from tallywise.operators.marketing import best_and_worst_campaign
from tallywise.operators.returns import return_analysis
from tallywise.operators.targets import target_vs_actual
from tallywise.sources.retail import RetailTables


def _row_first_by(df: DataFrame, *order: Column) -> Column:
    """The whole first row in an order; null when there are no rows."""
    return F.min_by(F.struct(*df.columns), F.struct(*order))


def _highest(df: DataFrame, rate: str, key: str) -> DataFrame:
    """Row with the highest rate, its z-score, and the count and sum of all rates."""
    value = F.col(rate)
    return (
        df.agg(
            F.count(F.lit(1)).alias("rivals"),
            F.sum(money(rate)).cast("double").alias("rate_sum"),
            F.avg(value).alias("mean"),
            F.stddev_pop(value).alias("std"),
            _row_first_by(df, value.isNull(), -value, F.col(key).isNull(), F.col(key)).alias("top"),
        )
        .filter("rivals > 0")
        .select("rivals", "rate_sum", "mean", "std", "top.*")
        .withColumn(
            "zscore",
            F.when(F.col("std").isNull() | (F.col("std") == 0), F.lit(0.0)).otherwise(
                round_to((value - F.col("mean")) / F.col("std"))
            ),
        )
        .withColumn(
            "is_outlier", F.coalesce(F.abs("zscore") >= FINDING_OUTLIER_THRESHOLD, F.lit(False))
        )
    )


def profitability(tables: RetailTables, window_days: int = WINDOW_DAYS) -> DataFrame:
    return growth_gap(tables, window_days).filter(F.col("latest_end").isNotNull())


def worst_category(tables: RetailTables) -> DataFrame:
    """The category with the highest return rate; refunds are not read for it."""
    rates = return_analysis(tables).select("category", "return_rate_pct")
    return _highest(rates, "return_rate_pct", "category")


def returns(tables: RetailTables) -> DataFrame:
    """Worst category and the most frequent reason in it."""
    return _highest(return_analysis(tables, top_reason=True), "return_rate_pct", "category")


def delivery(tables: RetailTables) -> DataFrame:
    """Most delayed partner and the mean delay rate of the others."""
    worst = _highest(delivery_performance(tables), "delayed_rate_pct", "delivery_partner_id")
    others = ratio(F.col("rate_sum") - F.col("delayed_rate_pct"), F.col("rivals") - 1)
    return worst.withColumn("others_avg", others)


def inventory(tables: RetailTables) -> DataFrame:
    both = F.col("top_stockout_category").isNotNull() & F.col("top_excess_category").isNotNull()
    return inventory_imbalance(tables).withColumn("has_signal", both)


def marketing(tables: RetailTables) -> DataFrame:
    return best_and_worst_campaign(tables)


def targets(tables: RetailTables, month: str | None = None) -> DataFrame:
    """Store furthest below its target, and how many are below."""
    stores = target_vs_actual(tables, month)
    attained = F.col("revenue_attainment_pct")
    return (
        stores.agg(
            F.count(F.lit(1)).alias("stores"),
            F.count_if(attained < 100).alias("below"),
            _row_first_by(stores, attained.isNull(), attained, F.col("store_id")).alias("worst"),
        )
        .filter("stores > 0")
        .select("stores", "below", "worst.*")
    )


def store_team(tables: RetailTables) -> DataFrame:
    return store_team_performance(tables, orders=False).limit(1)


def segment(tables: RetailTables) -> DataFrame:
    return segment_value(tables, orders=False).limit(1)


def leader(tables: RetailTables, dimension_name: str) -> DataFrame:
    return breakdown_by(tables, dimension_name, top_n=1, orders=False).withColumnRenamed(dimension_name, "leader")
