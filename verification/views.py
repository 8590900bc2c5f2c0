"""The retail tables, a mapped table, questions and statements, derived from the test tables.

Everything is derived by Spark from whole tables, so work grows with them.
"""

from __future__ import annotations

from decimal import Decimal
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallywise import RetailTables
from tallywise.fixed_values import MONEY_TYPE
from tallywise.functions.texts import month_key
from tallywise.operators.mapping import canonical_frame

TEST_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# A table of lineitem joined with part, and the concepts its columns stand for.
USER_MAPPING = {
    "date": "l_shipdate",
    "revenue": "amount",
    "cost": "amount_cost",
    "quantity": "l_quantity",
    "product": "l_partkey",
    "category": "p_type",
    "store": "l_suppkey",
    "return_flag": "is_returned",
}

# The columns that the retail views have.
CATALOG_COLUMNS = {
    "products": ("product_id", "product_name", "category", "brand"),
    "stores": ("store_id", "store_name", "region"),
    "customers": ("customer_id", "segment", "store_id"),
    "employees": ("employee_id", "store_id", "role"),
    "sales": (
        "order_id", "order_date", "customer_id", "product_id", "store_id", "channel", "quantity", "revenue", "cost",
        "gross_profit",
    ),
    "returns": (
        "return_id", "order_id", "return_date", "product_id", "store_id", "quantity", "return_reason", "refund_amount",
    ),
    "deliveries": (
        "order_id", "order_date", "store_id", "delivery_partner_id", "promised_days", "actual_days", "delivery_status",
        "delivery_rating",
    ),
    "delivery_partners": ("delivery_partner_id", "partner_name"),
    "inventory_daily": ("snapshot_date", "store_id", "product_id", "stockout_flag", "excess_stock_flag"),
    "marketing": ("campaign_id", "campaign_name", "spend", "attributed_revenue", "conversions", "roi"),
    "targets": (
        "month", "store_id", "revenue_target", "gross_profit_target", "on_time_delivery_target_pct",
        "return_rate_target_pct",
    ),
    "hubs": ("hub_id", "hub_name", "region"),
}

QUESTION_FORMS = (
    "Which delivery partner has the highest delay rate for",
    "Which category has the highest return rate among",
    "Which marketing campaign has the best ROI for",
    "What is the most valuable customer segment near",
    "Which store misses its target the most in",
    "Which category generates the most revenue for",
    "Which employees perform best with",
    "Which products have stockout issues for",
    "Which region generates the most profit from",
    "Is revenue growth leading to stronger profitability for",
    "Are we making more money with",
    "Is our profit keeping pace with revenue at",
    "Why did our margin decline for",
    "Which stores are top revenue sellers to",
    "What is the meaning of life for",
    "What's the weather like today for",
    "What can I ask about",
    "What is our total revenue from",
    "Which clients bring the most to",
    "Which sku sells best to",
    "What is our refund share for",
    "How much did we sell to",
    "Sales dey go up, profit dey follow for",
    "Which branch serves",
)


@cache
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def test_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: table(spark, sf_dir, name) for name in TEST_TABLES}


def _dec(c: str) -> Column:
    return F.col(c).cast("decimal(12,2)")


def _hundredths(c: str) -> Column:
    """A non-negative amount with two places as a whole number."""
    return F.floor(F.col(c) * 100 + 0.5)


def _from_ten_thousandths(c: Column) -> Column:
    """Whole ten-thousandths as money: whole-number arithmetic, one decimal at the end."""
    return (c.cast("decimal(18,0)") * F.lit(Decimal("0.0001"))).cast(MONEY_TYPE)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    )


@cache
def retail(spark: SparkSession, sf_dir: str) -> RetailTables:
    """The twelve retail tables as views over the test tables."""
    part, nation, region = (table(spark, sf_dir, t) for t in ("part", "nation", "region"))
    customer, orders, events = (table(spark, sf_dir, t) for t in ("customer", "orders", "events"))
    lines = _lines(spark, sf_dir)
    price = _hundredths("l_extendedprice")
    paid, spent = price * (100 - _hundredths("l_discount")), price * 70
    revenue, cost = _from_ten_thousandths(paid), _from_ten_thousandths(spent)
    order_key = F.col("o_orderkey")
    placed = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    first, last = (
        orders.agg(f(F.date_trunc("month", "o_orderdate").cast("date")).alias("m")).scalar()
        for f in (F.min, F.max)
    )
    spread = (F.col("n_nationkey").cast("bigint") * 7919) % 400000
    profit_spread = (F.col("n_nationkey").cast("bigint") * 7919) % 100000
    by_type = events.groupBy("event_type").agg(
        (F.count(F.lit(1)) * 10).cast("decimal(18,2)").alias("spend"),
        F.sum(_dec("value")).cast("decimal(18,2)").alias("attributed_revenue"),
        F.count_distinct("user_id").alias("conversions"),
    )
    gained = F.col("attributed_revenue").cast("double") - F.col("spend").cast("double")
    return RetailTables(
        products=part.select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_name").alias("product_name"),
            F.col("p_type").alias("category"),
            F.col("p_brand").alias("brand"),
        ),
        stores=nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
            F.col("n_nationkey").alias("store_id"),
            F.col("n_name").alias("store_name"),
            F.col("r_name").alias("region"),
        ),
        customers=customer.select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_mktsegment").alias("segment"),
            F.col("c_nationkey").alias("store_id"),
        ),
        sales=lines.select(
            order_key.alias("order_id"),
            F.to_date("o_orderdate").alias("order_date"),
            F.col("o_custkey").alias("customer_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("c_nationkey").alias("store_id"),
            F.col("o_orderpriority").alias("channel"),
            F.col("l_quantity").cast("bigint").alias("quantity"),
            revenue.alias("revenue"),
            cost.alias("cost"),
            _from_ten_thousandths(paid - spent).alias("gross_profit"),
        ),
        returns=lines.filter("l_returnflag = 'R'").select(
            F.concat_ws("-", "l_orderkey", "l_linenumber").alias("return_id"),
            order_key.alias("order_id"),
            F.to_date("l_shipdate").alias("return_date"),
            F.col("l_partkey").alias("product_id"),
            F.col("c_nationkey").alias("store_id"),
            F.col("l_quantity").cast("bigint").alias("quantity"),
            F.concat_ws("-", "l_linestatus", "o_orderstatus").alias("return_reason"),
            revenue.alias("refund_amount"),
        ),
        deliveries=placed.select(
            order_key.alias("order_id"),
            F.to_date("o_orderdate").alias("order_date"),
            F.col("c_nationkey").alias("store_id"),
            F.col("o_orderpriority").alias("delivery_partner_id"),
            F.lit(5).cast("bigint").alias("promised_days"),
            (2 + order_key % 7).alias("actual_days"),
            F.when(order_key % 7 > 3, "Delayed").otherwise("On Time").alias("delivery_status"),
            (1 + order_key % 5).cast("double").alias("delivery_rating"),
        ),
        delivery_partners=orders.select(
            F.col("o_orderpriority").alias("delivery_partner_id")
        ).distinct().withColumn("partner_name", F.col("delivery_partner_id")),
        employees=table(spark, sf_dir, "supplier").select(
            F.col("s_suppkey").alias("employee_id"),
            F.col("s_nationkey").alias("store_id"),
            F.when(F.col("s_suppkey") % 10 == 0, "Store Manager")
            .otherwise("Sales Associate")
            .alias("role"),
        ),
        inventory_daily=events.select(
            F.to_date("ts").alias("snapshot_date"),
            (F.col("user_id") % 25).alias("store_id"),
            (F.col("event_id") % 200).alias("product_id"),
            F.when(F.col("event_type") == "error", "True").otherwise("False").alias("stockout_flag"),
            F.when(F.col("event_type") == "view", "true").otherwise("false").alias("excess_stock_flag"),
        ),
        marketing=by_type.select(
            F.col("event_type").alias("campaign_id"),
            F.col("event_type").alias("campaign_name"),
            "spend",
            "attributed_revenue",
            "conversions",
            (F.rint(gained / F.col("spend").cast("double") * 100) / 100).alias("roi"),
        ),
        targets=nation.select(
            "n_nationkey",
            F.explode(F.sequence(first, last, F.expr("interval 1 month"))).alias("first_day"),
        ).select(
            month_key("first_day").alias("month"),
            F.col("n_nationkey").alias("store_id"),
            (200000 + spread).cast(MONEY_TYPE).alias("revenue_target"),
            (50000 + profit_spread).cast(MONEY_TYPE).alias("gross_profit_target"),
            F.lit(60.0).alias("on_time_delivery_target_pct"),
            F.lit(6.0).alias("return_rate_target_pct"),
        ),
    )


def hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one table of the catalog that no analysis reads: a hub per region."""
    return table(spark, sf_dir, "region").select(
        F.concat(F.lit("H"), F.col("r_regionkey")).alias("hub_id"), F.col("r_name").alias("hub_name"), F.col("r_name").alias("region")
    )


def uploaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table nobody knows the schema of: line items with their part type."""
    price = _hundredths("l_extendedprice")
    return (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            "l_shipdate",
            _from_ten_thousandths(price * 100).alias("amount"),
            _from_ten_thousandths(price * 70).alias("amount_cost"),
            "l_quantity",
            "l_partkey",
            "p_type",
            "l_suppkey",
            (F.col("l_returnflag") == "R").alias("is_returned"),
        )
    )


@cache
def user_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_frame(uploaded(spark, sf_dir), USER_MAPPING)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per customer, and everything users said in conversations."""
    forms = F.array(*[F.lit(q) for q in QUESTION_FORMS])
    form = F.element_at(forms, (F.col("c_custkey") % len(QUESTION_FORMS) + 1).cast("int"))
    asked = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey")).alias("question_id"),
        F.concat(form, F.lit(" "), F.col("c_name"), F.lit("?")).alias("question"),
    )
    said = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("t"), F.col("conv_id"), F.lit("-"), F.col("turn")).alias("question_id"),
        F.col("text").alias("question"),
    )
    return asked.unionByName(said)


def _per_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("partner_name"))
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.sum(_dec("o_totalprice")).cast("double").alias("spent"),
        )
    )


def statement_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known about a customer: one record per order priority."""
    return _per_priority(spark, sf_dir)


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement per customer; some of them credit the wrong priority or invent a number."""
    best = F.struct(-F.col("spent"), "partner_name")
    summed = _per_priority(spark, sf_dir).groupBy("id").agg(
        F.min_by("partner_name", best).alias("top"),
        F.max("spent").alias("most"),
        F.min("spent").alias("least"),
        F.sum("orders").alias("orders"),
    )
    claimed = F.when(F.col("id") % 3 == 1, F.col("least")).otherwise(F.col("most"))
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    extra = F.when(
        F.col("id") % 4 == 2,
        F.concat(F.lit(" The balance is "), F.format_string("%.2f", "c_acctbal"), F.lit(".")),
    ).otherwise("")
    return summed.join(customer, "id").select(
        "id",
        F.concat(
            F.col("top"), F.lit(" brought "), F.format_string("%,.2f", claimed), F.lit(" from "),
            F.col("orders").cast("string"), F.lit(" orders."), extra,
        ).alias("text"),
        F.concat(F.col("top"), F.lit(" brought the most.")).alias("template"),
    )
