"""What readers raise."""

from __future__ import annotations


class DatasetError(ValueError):
    """A file that holds no table that could be analysed."""
