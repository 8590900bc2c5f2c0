"""Analyses of a canonical frame: they need concepts, not a fixed schema.

An analysis whose concepts are missing returns None, as there is nothing to plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallywise.fixed_values import (
    PERIOD_UNITS,
    SPREAD_PRODUCTS,
    TRADE_OFF_ROWS,
    USER_BREAKDOWN_ROWS,
    WINDOW_DAYS,
)
from tallywise.functions.numbers import change_pct, percent, percent_or_zero, round_to, total
from tallywise.functions.texts import is_return_flag
from tallywise.operators.stats import quartiles


def _has(frame: DataFrame, *concepts: str) -> bool:
    return set(concepts) <= set(frame.columns)


def date_window(frame: DataFrame) -> DataFrame | None:
    """First and last date of the data; nulls when no date is known."""
    if not _has(frame, "date"):
        return None
    return frame.agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"))


def kpi_summary(frame: DataFrame) -> DataFrame | None:
    """Revenue and record count, plus profit, margin and units where mapped; one row."""
    if not _has(frame, "revenue"):
        return None
    sums = [total("revenue").alias("revenue"), F.count(F.lit(1)).alias("records")]
    if _has(frame, "profit"):
        sums.append(total("profit").alias("profit"))
    if _has(frame, "quantity"):
        sums.append(total("quantity").alias("units"))
    summed = frame.agg(*sums)
    if _has(frame, "profit"):
        summed = summed.withColumn("margin_pct", round_to(percent_or_zero("profit", "revenue")))
        summed = summed.withColumn("profit", round_to("profit"))
    return summed.withColumn("revenue", round_to("revenue"))


def revenue_trend(frame: DataFrame, freq: str = "M") -> DataFrame | None:
    """Revenue (and profit) per period, oldest first; undated rows do not count."""
    if not _has(frame, "date", "revenue"):
        return None
    measures = [c for c in ("revenue", "profit") if c in frame.columns]
    return (
        frame.filter(F.col("date").isNotNull())
        .groupBy(F.date_trunc(PERIOD_UNITS[freq], "date").cast("timestamp_ntz").alias("period"))
        .agg(*[total(c).alias(c) for c in measures])
        .orderBy("period")
    )


def growth_comparison(frame: DataFrame, window_days: int = WINDOW_DAYS) -> DataFrame | None:
    """Last days against the days before, from rounded sums; no row without dates.

    Both windows are summed in one pass over the rows they cover.
    """
    if not _has(frame, "date", "revenue"):
        return None
    start = F.date_sub(F.max(F.to_date("date")), 2 * window_days - 1).cast("timestamp_ntz")
    first_day = frame.agg(start.alias("first_day")).scalar()
    measures = [c for c in ("revenue", "profit") if c in frame.columns]
    first = F.col("first_day")
    is_latest = F.to_date("date") >= F.date_add(first, window_days)
    summed = (
        frame.withColumn("first_day", first_day)
        .filter(F.col("date") >= first)
        .agg(
            F.max(first).alias("first_day"),
            *[round_to(total(F.when(is_latest, F.col(c)))).alias(f"latest_{c}") for c in measures],
            *[round_to(total(F.when(~is_latest, F.col(c)))).alias(f"previous_{c}") for c in measures],
        )
        .filter(first.isNotNull())
    )

    def day(number: int) -> Column:
        return F.date_add(first, number)

    changes = {f"{c}_pct_change": round_to(change_pct(f"latest_{c}", f"previous_{c}")) for c in measures}
    compared = summed.select(
        F.lit(window_days).alias("window_days"),
        day(window_days).alias("latest_start"),
        day(2 * window_days - 1).alias("latest_end"),
        *[f"latest_{c}" for c in measures],
        day(0).alias("previous_start"),
        day(window_days - 1).alias("previous_end"),
        *[f"previous_{c}" for c in measures],
        *[change.alias(name) for name, change in changes.items()],
    )
    if "profit" in measures:
        compared = compared.withColumn(
            "growth_gap_pp", round_to(F.col("revenue_pct_change") - F.col("profit_pct_change"))
        )
    return compared


def breakdown(frame: DataFrame, dimension: str, top_n: int = USER_BREAKDOWN_ROWS) -> DataFrame | None:
    """Best values of a dimension by revenue, margin from the rounded sums."""
    if not _has(frame, dimension, "revenue"):
        return None
    measures = [c for c in ("revenue", "profit", "quantity") if c in frame.columns]
    top = (
        frame.groupBy(dimension)
        .agg(*[total(c).alias(c) for c in measures])
        .orderBy(F.desc_nulls_last("revenue"), F.asc_nulls_last(dimension))
        .limit(top_n)
        .select(dimension, *[round_to(c).alias(c) for c in measures])
    )
    if "profit" in measures:
        margin = F.when(F.col("revenue") > 0, round_to(percent("profit", "revenue"))).otherwise(0.0)
        top = top.withColumn("margin_pct", margin)
    return top


def margin_trade_off(frame: DataFrame, top_n: int = TRADE_OFF_ROWS) -> DataFrame | None:
    """Revenue against margin of the leading products."""
    return breakdown(frame, "product", top_n) if _has(frame, "product", "profit") else None


def returns_summary(frame: DataFrame) -> DataFrame | None:
    """Share of records marked as returned; one row."""
    if not _has(frame, "return_flag"):
        return None
    return frame.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(is_return_flag("return_flag")).alias("returned_records"),
    ).withColumn("return_rate_pct", round_to(percent_or_zero("returned_records", "total_records")))


def composition(frame: DataFrame) -> DataFrame | None:
    """Revenue per category and product, with a total row (null product) per category.

    Totals are rolled up from the per-product sums, not from the records.
    """
    if not _has(frame, "category", "product", "revenue"):
        return None
    per_product = (
        frame.filter(F.col("category").isNotNull() & F.col("product").isNotNull())
        .groupBy("category", "product")
        .agg(F.coalesce(F.sum("revenue"), F.lit(0)).alias("revenue"))
    )
    return (
        per_product.rollup("category", "product")
        .agg(F.sum("revenue").cast("double").alias("revenue"), F.grouping("product").alias("is_total"))
        .filter(F.col("category").isNotNull())
        .select("category", "product", F.col("is_total") == 1, "revenue")
        .toDF("category", "product", "is_total", "revenue")
        .orderBy("category", F.desc("is_total"), "product")
    )


def value_spread(frame: DataFrame, products: int = SPREAD_PRODUCTS) -> DataFrame | None:
    """Quartiles of revenue per record for the leading products.

    Empty when there are no more than two different products. The join carries at
    most ``products`` keys, so broadcasting them is safe at any data size.
    """
    if not _has(frame, "product", "revenue"):
        return None
    leaders = breakdown(frame, "product", products).select(F.col("product").alias("leader"))
    # A handful of rows: counting them over one window costs nothing.
    several = F.count("leader").over(Window.partitionBy()) > 2
    leaders = leaders.withColumn("several", several).filter("several")
    records = frame.select("product", "revenue").join(
        F.broadcast(leaders), F.col("product").eqNullSafe(F.col("leader")), "left_semi"
    )
    spread = quartiles(records, "product", "revenue", few_groups=True)
    return spread.orderBy(F.asc_nulls_last("product"))
