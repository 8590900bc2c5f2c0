"""Sentences filled from columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

_SLOT = re.compile(r"\{(\w+)\}")


def sentence(pattern: str, **slots: Column | str) -> Column:
    """Fill ``{name}`` slots of a fixed pattern; plain strings are literals.

    A null slot becomes empty text instead of making the whole sentence null.
    """
    parts, end = [], 0
    for slot in _SLOT.finditer(pattern):
        if slot.start() > end:
            parts.append(F.lit(pattern[end : slot.start()]))
        value = slots[slot.group(1)]
        value = F.lit(value) if isinstance(value, str) else value.cast("string")
        parts.append(F.coalesce(value, F.lit("")))
        end = slot.end()
    if end < len(pattern):
        parts.append(F.lit(pattern[end:]))
    return F.concat(*parts)
