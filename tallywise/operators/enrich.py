"""Sales joined with what is known about the product, the store and the customer.

Joins carry no broadcast hints: Spark broadcasts a dimension only when its size
estimate is below ``spark.sql.autoBroadcastJoinThreshold`` and otherwise sorts and
merges, where adaptive execution splits partitions made large by a hot key.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from tallywise.sources.retail import RetailTables

# dimension table -> (key, columns it adds to a sale)
_ADDED = {
    "products": ("product_id", ["product_name", "category", "brand"]),
    "stores": ("store_id", ["store_name", "region", "city", "store_type"]),
    "customers": ("customer_id", ["customer_segment", "acquisition_channel"]),
}


def dimension(tables: RetailTables, name: str) -> DataFrame:
    """Key and descriptive columns of one dimension table."""
    key, added = _ADDED[name]
    df = getattr(tables, name)
    if name == "customers":
        df = df.withColumnRenamed("segment", "customer_segment")
    return df.select(key, *[c for c in added if c in df.columns])


def add_dimensions(df: DataFrame, tables: RetailTables, names: Iterable[str]) -> DataFrame:
    """Left-join the named dimension tables."""
    for name in names:
        df = df.join(dimension(tables, name), _ADDED[name][0], "left")
    return df


def sales_enriched(tables: RetailTables) -> DataFrame:
    """Every sale with its product, store and customer columns.

    The category always comes from the product, never from a copy kept in sales.
    """
    return add_dimensions(tables.sales.drop("category"), tables, _ADDED)


def dimension_owning(column: str) -> str | None:
    """The dimension table a column comes from; None when sales has it itself."""
    return next((name for name, (_, added) in _ADDED.items() if column in added), None)


def key_of(column: str) -> str:
    """The column of a sale that leads to a descriptive column, itself if sales has it."""
    owner = dimension_owning(column)
    return _ADDED[owner][0] if owner else column


def described(df: DataFrame, tables: RetailTables, column: str) -> DataFrame:
    """Rows with the key of a dimension and the one descriptive column asked for."""
    owner = dimension_owning(column)
    return df.join(dimension(tables, owner).select(_ADDED[owner][0], column), _ADDED[owner][0], "left") if owner else df


def sales_with(tables: RetailTables, column: str) -> DataFrame:
    """Sales with one descriptive column, joining only the table that has it."""
    owner = dimension_owning(column)
    return add_dimensions(tables.sales.drop("category"), tables, [owner] if owner else [])
