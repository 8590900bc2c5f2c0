"""Sales by a business dimension, by store team and by customer segment."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallywise.fixed_values import DIMENSION_COLUMNS, MANAGER_ROLE
from tallywise.functions.numbers import percent, ratio, round_to
from tallywise.operators.enrich import described, dimension, key_of
from tallywise.operators.summaries import as_numbers, money_sums, sums_and_distinct
from tallywise.sources.retail import RetailTables

MANY_VALUES = ("product_name", "product_id", "customer_id")
_COUNTED = {"orders": "order_id"}


def _by_dimension(tables: RetailTables, sales: DataFrame, column: str, sums: dict, counted: dict) -> DataFrame:
    """Totals and counts per value of a column of the sales or of one dimension table.

    What is known about products or customers is joined to the sales as they are read, narrowed to the
    key, the amounts and the ids: without a shuffle if the dimension is small enough to be sent along,
    else by its key. From there on rows are combined per value. Values that are keys of their own, like
    products, are too many for bitmaps.
    """
    narrow = dict.fromkeys([key_of(column), "revenue", "gross_profit", "quantity", *counted.values()])
    rows = described(sales.select(*narrow), tables, column)
    return sums_and_distinct(rows, [column], sums, counted, few=column not in MANY_VALUES)


def breakdown_by(
    tables: RetailTables, dimension_name: str, start=None, end=None, top_n: int | None = None, orders: bool = True
) -> DataFrame:
    """Revenue, profit, units, distinct orders and margin per value, best first.

    Only the one table that holds the dimension is joined; the date filter sits below the join.
    Without ``orders`` they are not counted, and sales need no order_id.
    """
    if dimension_name not in DIMENSION_COLUMNS:
        raise ValueError(f"Unknown dimension '{dimension_name}'. Options: {list(DIMENSION_COLUMNS)}")
    column = DIMENSION_COLUMNS[dimension_name]
    sales = tables.sales
    if start is not None and end is not None:
        sales = sales.filter(F.col("order_date").between(start, end))
    ranked = (
        _by_dimension(tables, sales, column, money_sums() | {"units": F.col("quantity")}, _COUNTED if orders else {})
        .withColumns(as_numbers() | {"units": F.coalesce("units", F.lit(0)).cast("bigint")})
        .withColumnRenamed(column, dimension_name)
        .withColumn(
            "margin_pct",
            F.when(F.col("revenue") > 0, percent("gross_profit", "revenue")).otherwise(0.0),
        )
        .orderBy(F.desc_nulls_last("revenue"), F.asc_nulls_last(dimension_name))
    )
    if top_n:
        ranked = ranked.limit(top_n)
    return ranked.withColumns({c: round_to(c) for c in ("revenue", "gross_profit", "margin_pct")})


def store_team_performance(tables: RetailTables, orders: bool = True) -> DataFrame:
    """Store results per head; sales are known per store, not per employee.

    Sales and staff are both summed per store before anything is joined. Without ``orders`` they are
    not counted.
    """
    counted = _COUNTED if orders else {}
    sold = sums_and_distinct(tables.sales, ["store_id"], money_sums(), counted).withColumns(as_numbers())
    staff = (
        tables.employees.filter(F.col("store_id").isNotNull())
        .groupBy("store_id")
        .agg(
            F.count("employee_id").alias("headcount"),
            F.count_if(F.col("role") == MANAGER_ROLE).alias("managers"),
        )
    )
    stores = dimension(tables, "stores").select("store_id", "store_name", "region")
    return (
        sold.join(stores, "store_id", "left")
        .join(staff, "store_id", "left")
        .select(
            "store_id",
            "store_name",
            "region",
            round_to("revenue").alias("revenue"),
            round_to("gross_profit").alias("gross_profit"),
            *counted,
            round_to(percent("gross_profit", "revenue")).alias("margin_pct"),
            "headcount",
            "managers",
            round_to(ratio("revenue", "headcount")).alias("revenue_per_employee"),
            round_to(ratio("gross_profit", "headcount")).alias("profit_per_employee"),
        )
        .orderBy(F.desc_nulls_last("revenue_per_employee"), F.asc_nulls_last("store_id"))
    )


def segment_value(tables: RetailTables, orders: bool = True) -> DataFrame:
    """Revenue, orders and customers per customer segment, best first. Without ``orders`` they are not counted."""
    counted = (_COUNTED if orders else {}) | {"customers": "customer_id"}
    return (
        _by_dimension(tables, tables.sales, "customer_segment", money_sums(), counted)
        .withColumns(as_numbers())
        .orderBy(F.desc_nulls_last("revenue"), F.asc_nulls_last("customer_segment"))
        .select(
            "customer_segment",
            round_to("revenue").alias("revenue"),
            round_to("gross_profit").alias("gross_profit"),
            *counted,
            round_to(percent("gross_profit", "revenue")).alias("margin_pct"),
            round_to(ratio("revenue", "customers")).alias("revenue_per_customer"),
        )
    )
