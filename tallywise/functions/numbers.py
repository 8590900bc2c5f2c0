"""Column helpers for money, ratios and rounding.

Everything here returns a lazy ``Column`` built from JVM-side functions, so the
expressions stay inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tallywise.fixed_values import MONEY_TYPE

# Doubles from here on have no fractional part left to round.
_WHOLE_FROM = 2.0**52


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: Column | str) -> Column:
    """A fixed-point amount. Sums of it do not depend on the row order."""
    return as_column(c).cast(MONEY_TYPE)


def total(c: Column | str) -> Column:
    """Sum as a double, 0 instead of null when there is nothing to add."""
    return F.coalesce(F.sum(as_column(c)), F.lit(0)).cast("double")


def mean(c: Column | str) -> Column:
    """Average over an exact fixed-point sum, null when there are no values."""
    return F.try_divide(F.sum(as_column(c).cast("decimal(28,10)")).cast("double"), F.count(as_column(c)).cast("double"))


def ratio(num: Column | str, den: Column | str) -> Column:
    """num / den as doubles; null when den is 0 or null."""
    return F.try_divide(as_column(num).cast("double"), as_column(den).cast("double"))


def percent(num: Column | str, den: Column | str) -> Column:
    """num / den * 100; null when den is 0 or null."""
    return ratio(num, den) * 100


def percent_or_zero(num: Column | str, den: Column | str) -> Column:
    """num / den * 100; 0 when den is 0 (or null)."""
    return F.coalesce(percent(num, den), F.lit(0.0))


def change_pct(new: Column | str, old: Column | str) -> Column:
    """Relative change in percent; null when the old value is 0 or null."""
    new, old = as_column(new).cast("double"), as_column(old).cast("double")
    return F.try_divide(new - old, old) * 100


def round_to(c: Column | str, places: int = 2) -> Column:
    """Round a double, halves to even, the way column-wise rounding of floats does."""
    scale = float(10**places)
    return F.rint(as_column(c) * scale) / scale


def _printed(c: Column, places: int) -> Column:
    """Number with grouped thousands, rounded by its exact binary value, halves to even."""
    return F.format_number(c, places)


def round_as_printed(c: Column | str, places: int) -> Column:
    """The value a number has when it is printed with that many places.

    ``round_to`` multiplies first, and that product may land on a half that the number
    itself does not hold (0.35 * 10 is exactly 3.5, but 0.35 is stored slightly below).
    A small negative number becomes 0, not -0, which ``array_distinct`` would keep beside 0.
    """
    x = as_column(c)
    printed = F.replace(_printed(x, places), F.lit(","), F.lit("")).try_cast("double")
    return F.when(F.abs(x) < _WHOLE_FROM, printed + F.lit(0.0)).otherwise(x)


def show(c: Column | str, places: int, signed: bool = False, grouped: bool = False) -> Column:
    """Number as text with fixed places; ``n/a`` when it is null."""
    value = as_column(c).cast("double")
    shown = _printed(value, places)
    if not grouped:
        shown = F.replace(shown, F.lit(","), F.lit(""))
    if signed:
        shown = F.when(F.startswith(shown, F.lit("-")), shown).otherwise(F.concat(F.lit("+"), shown))
    return F.coalesce(shown, F.lit("n/a"))


def show_count(c: Column | str, grouped: bool = False) -> Column:
    """Whole number as text; ``n/a`` when it is null."""
    value = as_column(c).cast("bigint")
    shown = F.format_number(value, 0) if grouped else value.cast("string")
    return F.coalesce(shown, F.lit("n/a"))
