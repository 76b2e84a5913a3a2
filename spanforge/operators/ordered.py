"""Running values over groups of any size: groups are cut by the quantiles of their own rows.

A window over a group puts all its rows into one task. Where a group may be
large, its rows are cut at quantiles of the order's first column, so that every
part has about ``ROWS`` rows wherever they are dense. A table with a row for each
part carries what precedes it, and rows are ordered within parts only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.storage import broadcast_small, materialize

#: Rows of a part, about; bytes of a table, by Spark's estimate, up to which nothing is counted or cut.
ROWS, SMALL_BYTES = 1_000_000, 1 << 28


def same(a: str, b: str, keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def cut(df: DataFrame, by: Sequence[str], t: str, name: str = "bucket") -> tuple[DataFrame, bool]:
    """``df`` with a column of that name, the part of its group that each row is in, and whether any group is cut.

    Parts are numbered in the order of ``t``; rows of equal t are in one part.
    """
    rows, small = ROWS, SMALL_BYTES
    if estimated_bytes(df) <= small:
        return df.withColumn(name, F.lit(0)), False
    large = materialize(df.groupBy(*by).agg(F.count("*").alias("n")).filter(F.col("n") > rows), "ordered-large")
    most = large.agg(F.max("n")).first()[0]
    if not most:
        return df.withColumn(name, F.lit(0)), False
    k = math.ceil(most / rows)
    # a group of n rows takes every (most / n)-th of the quantiles of the largest
    mine = df.select(*by, t).alias("d").join(broadcast_small(large).alias("l"), same("d", "l", by)).select(*[F.col(f"d.{c}").alias(c) for c in by], F.col(f"d.{t}").alias("t"), "l.n")
    marks = F.percentile_approx("t", F.array(*[F.lit(i / k) for i in range(1, k)]) if k > 1 else F.array(F.lit(0.5)), F.lit(max(10_000, 20 * k)))
    marks = mine.groupBy(*by).agg(marks.alias("marks"), F.max("n").alias("n"))
    step = F.greatest(F.lit(1), F.floor(F.lit(most) / F.col("n"))).cast("int")
    marks = marks.select(*by, F.array_distinct(F.filter("marks", lambda _, i: (i + 1) % step == 0)).alias("marks"))
    marks = materialize(marks, "ordered-marks")
    j = df.alias("s").join(broadcast_small(marks).alias("m"), same("s", "m", by), "left")
    at = F.coalesce(F.size(F.filter("m.marks", lambda x: x <= F.col(f"s.{t}"))), F.lit(0))
    return j.select("s.*", F.when(F.col("m.marks").isNull(), 0).otherwise(at).alias(name)), True


def running(df: DataFrame, by: Sequence[str], value: Column, how: str, order: Sequence[Column], name: str, bucket: str | None = "bucket", upto: int = 0, descending: bool = False) -> DataFrame:
    """``df`` with the running "max", "min" or "sum" of ``value`` in ``order`` within ``by``, up to the row itself or (-1) the one before.

    ``bucket`` is a column of parts in the same order (or against it, if that is
    ``descending``), or None where groups aren't cut. A sum of nothing is null.
    """
    f = getattr(F, how)
    keys = [*by, bucket] if bucket else [*by]
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, upto)
    df = df.withColumn(name, value)
    if not bucket:
        return df.withColumn(name, f(name).over(w))
    parts = df.groupBy(*keys).agg(f(name).alias("own"))
    direction = F.col(bucket).desc() if descending else F.col(bucket).asc()
    before = Window.partitionBy(*by).orderBy(direction).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("carry", f("own").over(before)).drop("own")
    j = df.alias("s").join(parts.alias("c"), same("s", "c", keys)).select("s.*", F.col("c.carry").alias("carried_in"))
    here, carry = f(name).over(w), F.col("carried_in")
    if how == "sum":
        both = F.when(here.isNull(), carry).otherwise(here + F.coalesce(carry, F.lit(0)))
    else:
        both = (F.greatest if how == "max" else F.least)(here, carry)
    return j.withColumn(name, both).drop("carried_in")
