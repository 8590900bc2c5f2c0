"""Delivery partners: punctuality and rating, overall and over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallywise.fixed_values import DELAYED_STATUS, PERIOD_UNITS
from tallywise.functions.numbers import mean, percent, round_to
from tallywise.sources.retail import RetailTables


def _is_delayed():
    return F.col("delivery_status") == DELAYED_STATUS


def delivery_performance(tables: RetailTables) -> DataFrame:
    """Deliveries, delays, mean rating and days per partner, most delayed first."""
    stats = (
        tables.deliveries.filter(F.col("delivery_partner_id").isNotNull())
        .groupBy("delivery_partner_id")
        .agg(
            F.count("order_id").alias("total_deliveries"),
            F.count_if(_is_delayed()).alias("delayed"),
            round_to(mean("delivery_rating")).alias("avg_rating"),
            round_to(mean("promised_days")).alias("avg_promised_days"),
            round_to(mean("actual_days")).alias("avg_actual_days"),
        )
        .withColumn("delayed_rate_pct", round_to(percent("delayed", "total_deliveries")))
    )
    return stats.join(tables.delivery_partners, "delivery_partner_id", "left").orderBy(
        F.desc_nulls_last("delayed_rate_pct"), F.asc("delivery_partner_id")
    )


def delivery_trend(tables: RetailTables, partner_id, freq: str = "W") -> DataFrame:
    """One partner's deliveries, delays and rating per period (weeks start on Monday)."""
    return (
        tables.deliveries.filter(
            (F.col("delivery_partner_id") == partner_id) & F.col("order_date").isNotNull()
        )
        .groupBy(F.to_date(F.date_trunc(PERIOD_UNITS[freq], "order_date")).alias("period"))
        .agg(
            F.count("order_id").alias("total"),
            F.count_if(_is_delayed()).alias("delayed"),
            round_to(mean("delivery_rating")).alias("avg_rating"),
        )
        .withColumn("delayed_rate_pct", round_to(percent("delayed", "total")))
        .orderBy("period")
    )
