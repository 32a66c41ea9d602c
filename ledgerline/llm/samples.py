"""Bounded samples by hash that don't run empty, however many rows there are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGE = 1 << 62


def threshold(rows: int, most: int) -> int:
    """The part of RANGE that holds about ``most`` of ``rows`` hashes (all of it, if there are no more rows)."""
    return RANGE if rows <= most else max(1, most * RANGE // rows)


def picked(mark: Column, rows: int, most: int) -> Column:
    """Whether a row with the 64-bit hash ``mark`` is in a sample of about ``most`` of ``rows`` rows."""
    return F.pmod(mark, F.lit(RANGE)) < F.lit(threshold(rows, most))
