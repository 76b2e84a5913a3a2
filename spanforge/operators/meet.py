"""Joins of intervals that overlap, in cells of several widths.

An interval belongs to the class of its length, and the cells of a class are as
wide as its longest: an interval takes two cells of its own class at most, and
two of each wider class that the other side has. Two intervals meet in the cells
of the longer one. So one that lasts for a whole run takes two rows beside
millions of short ones, and short ones don't meet each other in wide cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.operators.ordered import same

#: Cells of class c are 2 to the power of LEAST_BITS + CLASS_BITS * c wide.
LEAST_BITS, CLASS_BITS = 10, 2


def _class(t0: str, t1: str) -> Column:
    bits = F.log2((F.greatest(F.lit(0), F.col(t1) - F.col(t0)) + 1).cast("double"))
    return F.greatest(F.lit(0), F.ceil((bits - LEAST_BITS) / CLASS_BITS)).cast("int")


def _cell(t: Column, c: Column) -> Column:
    return F.call_function("shiftright", t, LEAST_BITS + CLASS_BITS * c)


def _in_cells(df: DataFrame, at: tuple[str, str], name: str, classes: Column) -> DataFrame:
    """``df`` once for each cell of each of its classes: with at_class and cell."""
    df = df.withColumn("at_class", F.explode(classes))
    lo, hi = (_cell(F.col(t).cast("long"), F.col("at_class")) for t in at)
    return df.withColumn("cell", F.explode(F.sequence(lo, hi))).alias(name)


def overlapping(a: DataFrame, b: DataFrame, keys: Sequence[str], a_at: tuple[str, str] = ("ts_ns", "end_ns"), b_at: tuple[str, str] = ("t0", "t1")) -> DataFrame:
    """All pairs of rows of a and b with equal ``keys`` whose closed intervals overlap, once each: the columns of a, and those of b but for the keys.

    Null keys are equal. Both sides are read twice, so write what is costly; no
    other name may be in both. The classes that a side has are collected, at most
    some thirty numbers.
    """
    a, b = a.withColumn("own_class", _class(*a_at)), b.withColumn("own_class", _class(*b_at))
    has = lambda t: sorted(r[0] for r in t.select("own_class").distinct().collect() if r[0] is not None)
    listed = lambda cs: F.array(*[F.lit(c) for c in cs]) if cs else F.array().cast("array<int>")
    of_a, of_b = has(a), has(b)
    own = F.array("own_class")
    kept = [*[F.col(f"a.{c}") for c in a.columns if c != "own_class"], *[F.col(f"b.{c}") for c in b.columns if c not in (*keys, "own_class")]]
    a0, a1, b0, b1 = F.col(f"a.{a_at[0]}"), F.col(f"a.{a_at[1]}"), F.col(f"b.{b_at[0]}"), F.col(f"b.{b_at[1]}")
    out = None
    # the longer one in a, or both of one class; the longer one in b
    for x, y in ((own, F.filter(listed(of_a), lambda c: c >= F.col("own_class"))), (F.filter(listed(of_b), lambda c: c > F.col("own_class")), own)):
        left, right = _in_cells(a, a_at, "a", x), _in_cells(b, b_at, "b", y)
        met = left.join(right, same("a", "b", [*keys, "at_class", "cell"]) & (a0 <= b1) & (b0 <= a1))
        met = met.filter(F.col("a.cell") == _cell(F.greatest(a0, b0).cast("long"), F.col("a.at_class"))).select(*kept)
        out = met if out is None else out.unionByName(met)
    return out
