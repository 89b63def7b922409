"""Vectors stored as text, and wide score or feature columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rounded direction cosines (row x, y, z, column x, y, z) that name a scan plane,
# tried in this order. Only the listed positions are compared.
SCAN_PLANES = [
    ("axial", {0: 1, 4: 1}),
    ("sagittal", {1: 1, 5: -1}),
    ("coronal", {0: 1, 5: -1}),
]


def evaluate_once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed a single time.

    A column used in several branches is otherwise recomputed in each of them.
    """
    return F.get(F.transform(F.array(value), then), F.lit(0))


def parse_vector(text: Column) -> Column:
    """``"[1, 0]"`` or ``"(1.0, 0.5)"`` to an array of doubles; anything else to NULL."""
    numbers = F.split(F.translate(text, "[]()", ""), ",").try_cast("array<double>")
    return evaluate_once(
        numbers, lambda v: F.when(~F.exists(v, lambda x: x.isNull()), v)
    )


def ct_orientation(text: Column) -> Column:
    """Name the scan plane of a six-number direction vector kept as text.

    Numbers are rounded half to even before the comparison. A missing vector stays ``missing``.
    """

    def name_of(vector: Column) -> Column:
        named = F.when(vector.isNull(), F.lit("unknown"))
        for name, signature in SCAN_PLANES:
            test = F.lit(True)
            for position, expected in signature.items():
                test = test & (F.bround(F.get(vector, F.lit(position)), 0) == expected)
            named = named.when(test, F.lit(name))
        return named.otherwise(F.lit("unknown"))

    return F.when(text.isNull() | (text == "missing"), F.lit("missing")).otherwise(
        evaluate_once(parse_vector(text), name_of)
    )


def columns_with_prefix(df: DataFrame, prefix: str) -> list[str]:
    """Columns named ``<prefix><number>``, in numeric order."""
    found = [c for c in df.columns if c.startswith(prefix) and c[len(prefix):].isdigit()]
    return sorted(found, key=lambda c: int(c[len(prefix):]))


def pack_array(columns: Sequence[str]) -> Column:
    """Wide columns to one array column."""
    return F.array(*[F.col(c) for c in columns])


def unpack_array(array: Column, prefix: str, width: int) -> list[Column]:
    """One array column to ``width`` columns ``<prefix>0 ..``; short arrays give NULLs."""
    return [F.get(array, i).alias(f"{prefix}{i}") for i in range(width)]
