"""Which categories come back, and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallywise.functions.numbers import money, percent, round_to, total
from tallywise.operators.enrich import dimension
from tallywise.operators.lattice import RETURN_EVENTS
from tallywise.sources.retail import RetailTables


def _events(returns: DataFrame) -> Column:
    """How many returns there are, in the table of returns or in a summary that has counted them."""
    if RETURN_EVENTS in returns.columns:
        return F.coalesce(F.sum(RETURN_EVENTS), F.lit(0)).cast("bigint")
    return F.count("return_id")


def return_analysis(tables: RetailTables, top_reason: bool = False) -> DataFrame:
    """Returned units, refunds, events and return rate per category, worst first.

    Returns and sales are first summed per product, so the join with products sees
    one row per product and side however many records a product has. With
    ``top_reason`` returns are summed per product and reason in the same pass, and a
    known category also gets its most frequent reason, of equal ones the first by name.
    """
    keys = ["product_id", "return_reason"] if top_reason else ["product_id"]
    returned = tables.returns.groupBy(*keys).agg(
        F.sum("quantity").alias("returned_units"),
        F.sum(money("refund_amount")).alias("refund_value"),
        _events(tables.returns).alias("return_events"),
        F.lit(True).alias("was_returned"),
    )
    sold = tables.sales.groupBy("product_id").agg(F.sum("quantity").alias("units_sold"))
    by_product = returned.unionByName(sold, allowMissingColumns=True)
    categories = dimension(tables, "products").select("product_id", "category")
    described = by_product.join(categories, "product_id", "left")
    reasons = []
    if top_reason:
        sums = ("returned_units", "refund_value", "return_events", "units_sold")
        described = described.groupBy("category", "return_reason").agg(
            *[F.sum(c).alias(c) for c in sums], F.max("was_returned").alias("was_returned")
        )
        named = F.col("category").isNotNull() & F.col("return_reason").isNotNull()
        place = F.when(named & F.col("was_returned"), F.struct(-F.col("return_events"), "return_reason"))
        reasons = [F.min_by("return_reason", place).alias("top_reason")]
    return (
        described.groupBy("category")
        .agg(
            F.coalesce(F.sum("returned_units"), F.lit(0)).cast("bigint").alias("returned_units"),
            total("refund_value").alias("refund_value"),
            F.coalesce(F.sum("return_events"), F.lit(0)).alias("return_events"),
            F.sum("units_sold").cast("bigint").alias("units_sold"),
            F.max("was_returned").alias("was_returned"),
            *reasons,
        )
        .filter("was_returned")
        .select(
            "category",
            "returned_units",
            round_to("refund_value").alias("refund_value"),
            "return_events",
            "units_sold",
            round_to(percent("returned_units", "units_sold")).alias("return_rate_pct"),
            *(["top_reason"] if top_reason else []),
        )
        .orderBy(F.desc_nulls_last("return_rate_pct"), F.asc_nulls_last("category"))
    )


def return_reasons(tables: RetailTables, category: str | Column) -> DataFrame:
    """Events, units and refunds per reason for one category, most frequent first.

    ``category`` may be a value or a column such as a scalar subquery.
    """
    by_product = (
        tables.returns.filter(F.col("return_reason").isNotNull())
        .groupBy("product_id", "return_reason")
        .agg(
            _events(tables.returns).alias("events"),
            F.sum("quantity").alias("units"),
            F.sum(money("refund_amount")).alias("refund_value"),
        )
    )
    products = (
        dimension(tables, "products").filter(F.col("category") == category).select("product_id")
    )
    return (
        by_product.join(products, "product_id")
        .groupBy("return_reason")
        .agg(
            F.sum("events").alias("events"),
            F.coalesce(F.sum("units"), F.lit(0)).cast("bigint").alias("units"),
            round_to(total("refund_value")).alias("refund_value"),
        )
        .orderBy(F.desc("events"), F.asc("return_reason"))
    )
