"""Dates written as text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tallywise.fixed_values import DATE_FORMATS, ISO_DATE_SHAPE, WEEKDAY_PREFIX
from tallywise.functions.numbers import as_column

# No accepted form is longer, with fractions of a second and the name of a time zone.
_LONGEST = 80
_ANY_SHAPE = "|".join(f"(?:{shape})" for shape in (ISO_DATE_SHAPE, *(shape for shape, _ in DATE_FORMATS)))


def parse_date(c: Column | str) -> Column:
    """Timestamp of a text in any accepted form, null when it is none of them.

    A long text is no date, and one test of all shapes together settles most others. A form is only tried
    on texts that look like it: failing to parse is what costs. The text is prepared once, as the one element
    of a list, and all forms share it; that also keeps the code small that Spark compiles for a column.
    """
    trimmed = F.trim(as_column(c))
    text = F.regexp_replace(F.when(F.length(trimmed) <= _LONGEST, trimmed), WEEKDAY_PREFIX, "")

    def read(t: Column) -> Column:
        tried = [F.when(t.rlike(ISO_DATE_SHAPE), t.try_cast("timestamp_ntz"))]
        for shape, layout in DATE_FORMATS:
            parsed = F.try_to_timestamp(t, F.lit(layout)).cast("timestamp_ntz")
            tried.append(F.when(t.rlike(shape), parsed))
        return F.coalesce(*tried)

    dates = F.transform(F.filter(F.array(text), lambda t: t.rlike(_ANY_SHAPE)), read)
    return F.get(dates, F.lit(0))
