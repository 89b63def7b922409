"""Dates that arrive in several text formats."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

# The date formats found in the case tables, tried in this order.
DATE_FORMATS = ("yyyy-MM-dd", "M/d/yy", "MM-dd-yyyy")


def parse_date_any(text: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """The first format that fits; NULL if none does."""
    return F.coalesce(*[F.try_to_date(text, f) for f in formats])


