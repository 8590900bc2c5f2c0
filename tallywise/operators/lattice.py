"""Sales and returns added up once, for every analysis that asks for less detail.

One pass over the sales gives two summaries: a row for each order, with its day, store and customer,
and a row for each product. One pass over the returns gives a row for each order and day, and one for
each product and reason. Both passes are GROUPING SETS, written once; all topics roll up from them, as
their sums are sums of sums and every order, customer and product is still there to be counted. Rows
are combined where they are read, so a hot product or a much-returned order leaves a task as one row.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from tallywise.functions.numbers import money
from tallywise.sources.retail import RetailTables
from tallywise.sources.written import written

ORDER = ("order_id", "order_date", "store_id", "customer_id")
RETURN_EVENTS = "return_events"


@dataclass(frozen=True)
class Lattice:
    """The retail tables with summaries in the place of sales and returns, in two degrees of detail."""

    by_order: RetailTables
    by_product: RetailTables


def _two_sets(df: DataFrame, first: tuple[str, ...], second: tuple[str, ...], sums: dict) -> DataFrame:
    """Totals by either set of columns; `detail` tells which."""
    columns = list(dict.fromkeys([*first, *second]))
    alone = next(c for c in second if c not in first)
    detail = F.when(F.grouping(alone) == 1, "first").otherwise("second").alias("detail")
    return df.groupingSets([list(first), list(second)], *columns).agg(
        detail, *[e.alias(a) for a, e in sums.items()]
    )


def sales_pass(tables: RetailTables) -> DataFrame:
    sums = {c: F.sum(money(c)) for c in ("revenue", "gross_profit")} | {"quantity": F.sum("quantity")}
    return _two_sets(tables.sales, ORDER, ("product_id",), sums)


def returns_pass(tables: RetailTables) -> DataFrame:
    sums = {
        "refund_amount": F.sum(money("refund_amount")),
        "quantity": F.sum("quantity"),
        RETURN_EVENTS: F.count("return_id"),
    }
    return _two_sets(tables.returns, ("order_id", "return_date"), ("product_id", "return_reason"), sums)


def lattice(tables: RetailTables) -> Lattice:
    """Reads sales and returns once each, now, and writes what all analyses roll up from."""
    sold, returned = (written(p(tables), "detail") for p in (sales_pass, returns_pass))

    def with_detail(which: str) -> RetailTables:
        chosen = [df.where(F.col("detail") == which).drop("detail") for df in (sold, returned)]
        return replace(tables, sales=chosen[0], returns=chosen[1])

    return Lattice(with_detail("first"), with_detail("second"))
