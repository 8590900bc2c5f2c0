"""Retail facts laid out by their order, so that joins and checks by order need no shuffle."""

from __future__ import annotations

from dataclasses import replace

from tallywise.sources.retail import RetailTables

BY_ORDER = ("sales", "returns", "deliveries")


def bucketed_by_order(tables: RetailTables, prefix: str, buckets: int = 200) -> RetailTables:
    """The facts written as tables ``<prefix>sales`` etc. of the session's catalog, in buckets sorted by order_id.

    What joins or groups them by order afterwards reads bucket next to bucket. ``buckets`` is the number of
    tasks such a join has: take one for each few hundred megabytes of the largest fact. Rows are dealt
    to their bucket before writing, so that each bucket is one file.
    """
    found = {}
    for name in BY_ORDER:
        df = getattr(tables, name)
        if df is None:
            continue
        table = f"{prefix}{name}"
        dealt = df.repartition(buckets, "order_id")
        dealt.write.bucketBy(buckets, "order_id").sortBy("order_id").mode("overwrite").saveAsTable(table)
        found[name] = df.sparkSession.table(table)
    return replace(tables, **found)
