"""The fixed retail star schema as a catalog of lazy tables."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark import StorageLevel
from pyspark.sql import DataFrame, DataFrameReader, SparkSession, functions as F

from tallywise.fixed_values import MISSING_TEXTS, MONEY_TYPE

# Columns and types of every table.
SCHEMAS: dict[str, dict[str, str]] = {
    "sales": {
        "order_id": "string", "order_date": "date", "customer_id": "string", "product_id": "string",
        "store_id": "string", "channel": "string", "quantity": "bigint", "payment_method": "string",
        "unit_cost": MONEY_TYPE, "list_price": MONEY_TYPE, "discount_pct": "double",
        "unit_price": MONEY_TYPE, "revenue": MONEY_TYPE, "cost": MONEY_TYPE,
        "gross_profit": MONEY_TYPE, "gross_margin_pct": "double", "category": "string",
    },
    "products": {
        "product_id": "string", "product_name": "string", "category": "string", "brand": "string",
        "unit_cost": MONEY_TYPE, "list_price": MONEY_TYPE, "target_margin_pct": "double",
    },
    "stores": {
        "store_id": "string", "store_name": "string", "region": "string", "city": "string",
        "store_type": "string",
    },
    "customers": {
        "customer_id": "string", "segment": "string", "region": "string",
        "acquisition_channel": "string",
    },
    "employees": {
        "employee_id": "string", "employee_name": "string", "store_id": "string", "role": "string",
    },
    "returns": {
        "return_id": "string", "order_id": "string", "return_date": "date", "product_id": "string",
        "quantity": "bigint", "return_reason": "string", "refund_amount": MONEY_TYPE,
    },
    "deliveries": {
        "order_id": "string", "order_date": "date", "store_id": "string",
        "delivery_partner_id": "string", "promised_days": "bigint", "actual_days": "bigint",
        "delivery_status": "string", "delivery_rating": "double",
    },
    "delivery_partners": {
        "delivery_partner_id": "string", "partner_name": "string", "base_delay_prob": "double",
    },
    "marketing": {
        "campaign_id": "string", "campaign_name": "string", "channel": "string",
        "spend": MONEY_TYPE, "target_segment": "string", "period": "string",
        "attributed_revenue": MONEY_TYPE, "conversions": "bigint", "roi": "double",
    },
    "inventory_daily": {
        "snapshot_date": "date", "store_id": "string", "product_id": "string",
        "opening_stock": "bigint", "units_sold": "bigint", "closing_stock": "bigint",
        "stockout_flag": "string", "excess_stock_flag": "string",
    },
    "targets": {
        "month": "string", "store_id": "string", "revenue_target": MONEY_TYPE,
        "gross_profit_target": MONEY_TYPE, "on_time_delivery_target_pct": "double",
        "return_rate_target_pct": "double",
    },
    "hubs": {"hub_id": "string", "hub_name": "string", "region": "string"},
}


@dataclass
class RetailTables:
    """One DataFrame per table; a table nobody needs may be left out."""

    sales: DataFrame | None = None
    products: DataFrame | None = None
    stores: DataFrame | None = None
    customers: DataFrame | None = None
    employees: DataFrame | None = None
    returns: DataFrame | None = None
    deliveries: DataFrame | None = None
    delivery_partners: DataFrame | None = None
    marketing: DataFrame | None = None
    inventory_daily: DataFrame | None = None
    targets: DataFrame | None = None
    hubs: DataFrame | None = None

    def present(self) -> dict[str, DataFrame]:
        """The tables that were loaded, by name."""
        found = {f.name: getattr(self, f.name) for f in fields(self)}
        return {name: df for name, df in found.items() if df is not None}

    def register(self, prefix: str = "") -> None:
        """Make every table available to ``spark.sql`` under its name."""
        for name, df in self.present().items():
            df.createOrReplaceTempView(prefix + name)

    def cache(self, *names: str) -> None:
        """Keep the named tables (spilling to disk) for repeated analyses."""
        for name in names:
            getattr(self, name).persist(StorageLevel.MEMORY_AND_DISK)

    def clear_cache(self) -> None:
        """Forget everything kept by ``cache``."""
        for df in self.present().values():
            df.unpersist()


def strip_names(df: DataFrame) -> DataFrame:
    """Remove blanks around column names."""
    return df.toDF(*[c.strip() for c in df.columns])


def delimited_reader(spark: SparkSession, sep: str, multi_line: bool = True) -> DataFrameReader:
    """A reader of delimited text with quotes doubled inside quotes, and line breaks kept there.

    Without ``multi_line`` a file is split among tasks, and a row of another number of
    cells than the header, as a broken quoted line leaves, is an error.
    """
    reader = spark.read.option("header", True).option("sep", sep).option("escape", '"').option("multiLine", multi_line)
    return reader if multi_line else reader.option("mode", "FAILFAST").option("columnPruning", False)


def cleared(texts: DataFrame) -> DataFrame:
    """Text columns without the texts that mean "no value"."""
    kept = [F.when(~F.col(f"`{c}`").isin(*MISSING_TEXTS), F.col(f"`{c}`")).alias(c) for c in texts.columns]
    return texts.select(*kept)


def read_table(spark: SparkSession, directory: str, name: str, fmt: str = "parquet") -> DataFrame:
    """One table with its declared types; a missing path raises PATH_NOT_FOUND.

    CSV columns are matched by header name, whatever their order in the file.
    """
    path = f"{directory.rstrip('/')}/{name}.{fmt}"
    if fmt == "csv":
        df = cleared(strip_names(delimited_reader(spark, ",").csv(path)))
    else:
        df = strip_names(spark.read.format(fmt).load(path))
    types = SCHEMAS[name]
    return df.select(
        *[F.col(f"`{c}`").cast(types[c]).alias(c) if c in types else F.col(f"`{c}`") for c in df.columns]
    )


def load_retail_tables(
    spark: SparkSession, directory: str, fmt: str = "parquet", only: tuple[str, ...] = ()
) -> RetailTables:
    """All (or only the named) tables of a directory, one file or folder per table."""
    names = only or tuple(SCHEMAS)
    return RetailTables(**{name: read_table(spark, directory, name, fmt) for name in names})
