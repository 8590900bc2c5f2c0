"""Business tables in, checked answers out: lazy Spark plans for retail-style data."""

from tallywise.sources.retail import RetailTables, load_retail_tables

__all__ = ["RetailTables", "load_retail_tables"]
