"""Campaigns by return on investment."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallywise.sources.retail import RetailTables


def campaign_roi(tables: RetailTables) -> DataFrame:
    """All campaigns, best stored return on investment first."""
    return tables.marketing.orderBy(F.desc_nulls_last("roi"), F.asc("campaign_id"))


def best_and_worst_campaign(tables: RetailTables) -> DataFrame:
    """First and last campaign of that ranking in one row; no row without campaigns.

    Both ends come out of one aggregation instead of a sort of the whole table.
    """
    shown = F.struct("campaign_name", "roi", "spend", "attributed_revenue")
    place = F.struct(F.col("roi").isNull(), -F.col("roi"), "campaign_id")
    return (
        tables.marketing.agg(
            F.count(F.lit(1)).alias("campaigns"),
            F.min_by(shown, place).alias("best"),
            F.max_by(shown, place).alias("worst"),
        )
        .filter("campaigns > 0")
        .select(
            "campaigns",
            F.col("best.campaign_name").alias("best_campaign"),
            F.col("best.roi").alias("best_roi"),
            F.col("best.spend").cast("double").alias("best_spend"),
            F.col("best.attributed_revenue").cast("double").alias("best_revenue"),
            F.col("worst.campaign_name").alias("worst_campaign"),
            F.col("worst.roi").alias("worst_roi"),
        )
    )
