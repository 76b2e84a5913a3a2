"""Sums of whole numbers of which a long may not hold the total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.storage import materialize

WIDE = "decimal(38,0)"
LONG_MAX = (1 << 63) - 1


def wide_sum(c: str | Column) -> Column:
    """The sum of longs as a decimal of 38 digits, which no number of rows overflows."""
    return F.sum((F.col(c) if isinstance(c, str) else c).cast(WIDE))


def as_longs(sums: DataFrame, *columns: str) -> DataFrame:
    """``sums`` with those columns, wide sums, as longs; a column of which any value doesn't fit stays a decimal, and whole.

    The table, the result of an aggregation, is written once to look at it.
    """
    sums = materialize(sums, "sums")
    most = sums.agg(*[F.max(F.abs(c)).alias(c) for c in columns]).first()
    return sums.withColumns({c: F.col(c).cast("long") for c in columns if (most[c] or 0) <= LONG_MAX})
