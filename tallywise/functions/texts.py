"""Column helpers for text: flags, phrase tests, labels, numbers inside text."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from tallywise.fixed_values import NUMBER_PATTERN, RETURN_FLAG_WORDS
from tallywise.functions.numbers import as_column, round_as_printed


def is_true_text(c: Column | str) -> Column:
    """True for a flag stored as the text ``true`` in any letter case (or a boolean)."""
    return F.coalesce(F.lower(as_column(c).cast("string")) == "true", F.lit(False))


def is_return_flag(c: Column | str) -> Column:
    """True when a yes/no style value says the record was returned."""
    return F.coalesce(F.lower(as_column(c).cast("string")).isin(*RETURN_FLAG_WORDS), F.lit(False))


def mentions(c: Column | str, phrases: Sequence[str]) -> Column:
    """True when the (already lower-cased) text contains any of the phrases."""
    text = as_column(c)
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in phrases])


def shorten(c: Column | str, limit: int = 18) -> Column:
    """First ``limit`` characters, with an ellipsis when something was cut."""
    text = as_column(c).cast("string")
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)


def month_key(c: Column | str) -> Column:
    return F.date_format(as_column(c), "yyyy-MM")


def numbers_in(c: Column | str) -> Column:
    """Distinct numbers written in a text, rounded to one decimal place.

    A minus sign right after a digit separates (2026-06); it does not negate.
    """
    tokens = F.regexp_extract_all(as_column(c), F.lit(NUMBER_PATTERN), F.lit(0))
    parsed = F.transform(tokens, lambda t: F.regexp_replace(t, ",", "").try_cast("double"))
    return F.array_distinct(
        F.transform(F.filter(parsed, lambda n: n.isNotNull()), lambda n: round_as_printed(n, 1))
    )
