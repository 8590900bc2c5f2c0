"""Stock-outs and excess stock, counted in flagged days."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallywise.fixed_values import HOTSPOT_ROWS
from tallywise.functions.texts import is_true_text
from tallywise.operators.enrich import dimension
from tallywise.sources.retail import RetailTables


def _hotspots(tables: RetailTables, flag: str, days: str, top_n: int | None) -> DataFrame:
    pairs = (
        tables.inventory_daily.filter(is_true_text(flag))
        .filter(F.col("store_id").isNotNull() & F.col("product_id").isNotNull())
        .groupBy("store_id", "product_id")
        .agg(F.count(F.lit(1)).alias(days))
    )
    order = [F.desc(days), F.asc("store_id"), F.asc("product_id")]
    if top_n is not None:
        # Names are looked up for the rows that remain, not for every pair.
        pairs = pairs.orderBy(*order).limit(top_n)
    products = dimension(tables, "products").select("product_id", "product_name", "category")
    stores = dimension(tables, "stores").select("store_id", "store_name", "region")
    return pairs.join(products, "product_id", "left").join(stores, "store_id", "left").orderBy(*order)


def stockout_hotspots(tables: RetailTables, top_n: int | None = HOTSPOT_ROWS) -> DataFrame:
    """Store/product pairs by days without stock."""
    return _hotspots(tables, "stockout_flag", "stockout_days", top_n)


def excess_hotspots(tables: RetailTables, top_n: int | None = HOTSPOT_ROWS) -> DataFrame:
    """Store/product pairs by days with too much stock."""
    return _hotspots(tables, "excess_stock_flag", "excess_days", top_n)


def inventory_imbalance(tables: RetailTables) -> DataFrame:
    """The category worst hit on each side and how many pairs are affected; one row.

    One scan counts both flags per pair; pairs fold into products and products into
    categories, so only product rows meet the product table. No pair is left out.
    """
    pairs = (
        tables.inventory_daily.select(
            "store_id",
            "product_id",
            is_true_text("stockout_flag").cast("bigint").alias("stockout"),
            is_true_text("excess_stock_flag").cast("bigint").alias("excess"),
        )
        .filter(F.col("store_id").isNotNull() & F.col("product_id").isNotNull())
        .filter((F.col("stockout") + F.col("excess")) > 0)
        .groupBy("store_id", "product_id")
        .agg(F.sum("stockout").alias("stockout_days"), F.sum("excess").alias("excess_days"))
    )
    products = pairs.groupBy("product_id").agg(
        F.sum("stockout_days").alias("stockout_days"),
        F.sum("excess_days").alias("excess_days"),
        F.count_if(F.col("stockout_days") > 0).alias("stockout_pairs"),
        F.count_if(F.col("excess_days") > 0).alias("excess_pairs"),
    )
    categories = (
        products.join(dimension(tables, "products").select("product_id", "category"), "product_id", "left")
        .groupBy("category")
        .agg(*[F.sum(c).alias(c) for c in products.columns if c != "product_id"])
    )

    def worst(days: str):
        counted = F.col("category").isNotNull() & (F.col(days) > 0)
        return F.min(F.when(counted, F.struct((-F.col(days)).alias("rank"), "category", days)))

    return categories.agg(
        worst("stockout_days").alias("out"),
        worst("excess_days").alias("over"),
        F.coalesce(F.sum("stockout_pairs"), F.lit(0)).alias("out_pairs"),
        F.coalesce(F.sum("excess_pairs"), F.lit(0)).alias("over_pairs"),
    ).select(
        F.col("out.category").alias("top_stockout_category"),
        F.coalesce("out.stockout_days", F.lit(0)).alias("top_stockout_category_days"),
        F.col("over.category").alias("top_excess_category"),
        F.coalesce("over.excess_days", F.lit(0)).alias("top_excess_category_days"),
        F.col("out_pairs").alias("affected_store_product_pairs_stockout"),
        F.col("over_pairs").alias("affected_store_product_pairs_excess"),
    )
