"""Interval analytics: unions, islands, concurrency and shared time.

``by`` names the columns of a group. Groups of any size are put in order: large
ones are cut by the quantiles of their own rows (``operators.ordered``), or, if
``bucket_ns`` is given, by that width of time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.operators.ordered import cut, running, same


def parted(spans: DataFrame, by: Sequence[str], bucket_ns: int | None) -> tuple[DataFrame, str | None]:
    """``spans`` with a column ``bucket``, and its name if it parts any group: by a width of time, or by the groups' own quantiles."""
    if bucket_ns is not None:
        return spans.withColumn("bucket", F.floor(F.col("ts_ns") / F.lit(bucket_ns))), "bucket"
    s, any_cut = cut(spans, by, "ts_ns")
    return s, "bucket" if any_cut else None


def with_reach(spans: DataFrame, by: Sequence[str], bucket_ns: int | None = None) -> DataFrame:
    """Adds ``reach``: the latest end of the group's earlier rows by (ts_ns, seq); null for the first."""
    s, bucket = parted(spans, by, bucket_ns)
    return running(s, by, F.col("end_ns"), "max", [F.col("ts_ns"), F.col("seq")], "reach", bucket, -1).drop("bucket")


def islands(spans: DataFrame, by: Sequence[str], bucket_ns: int | None = None) -> DataFrame:
    """adds ``island``, numbered from 1 in each group; intervals that touch are in one."""
    s, bucket = parted(spans, by, bucket_ns)
    order = [F.col("ts_ns"), F.col("seq")]
    s = running(s, by, F.col("end_ns"), "max", order, "reach", bucket, -1)
    opens = (F.col("reach").isNull() | (F.col("ts_ns") > F.col("reach"))).cast("long")
    return running(s, by, opens, "sum", order, "island", bucket).drop("reach", "bucket")


def island_bounds(spans: DataFrame, by: Sequence[str], bucket_ns: int | None = None) -> DataFrame:
    """(by, island, ts_ns, end_ns, n_spans)."""
    out = islands(spans, by, bucket_ns).groupBy(*by, "island")
    return out.agg(F.min("ts_ns").alias("ts_ns"), F.max("end_ns").alias("end_ns"), F.count("*").alias("n_spans"))


def union_length(spans: DataFrame, by: Sequence[str], bucket_ns: int | None = None, name: str = "busy_ns") -> DataFrame:
    """(by, busy_ns): time covered by at least one span of the group."""
    s = with_reach(spans, by, bucket_ns)
    new = F.greatest(F.lit(0), F.col("end_ns") - F.greatest("ts_ns", F.coalesce("reach", "ts_ns")))
    return s.groupBy(*by).agg(F.sum(new).cast("long").alias(name))


def peak_concurrency(spans: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, peak): the most spans of positive length that run at once."""
    ends = F.explode(F.array(F.struct(F.col("ts_ns").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end_ns").alias("t"), F.lit(-1).alias("d"))))
    e = spans.filter("dur_ns > 0").select(*by, ends.alias("e")).select(*by, "e.*")
    e = e.groupBy(*by, "t").agg(F.sum("d").alias("d"))
    # at one instant ends come before starts
    e, any_cut = cut(e, by, "t")
    e = running(e, by, F.col("d"), "sum", [F.col("t")], "k", "bucket" if any_cut else None)
    return e.groupBy(*by).agg(F.max("k").cast("long").alias("peak"))


def running_max_dur(spans: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds ``max_dur_ns``: the longest span so far in the group."""
    s, bucket = parted(spans, by, None)
    return running(s, by, F.col("dur_ns"), "max", [F.col("ts_ns"), F.col("seq")], "max_dur_ns", bucket).drop("bucket")


def shared_time(spans: DataFrame, scopes: Sequence[str] = ("rank",), key: str = "name", bucket_ns: int | None = None) -> DataFrame:
    """F8: (key, shared_ns): each instant split equally over the distinct names active in its scope, summed over scopes.

    With W(t) the integral of 1/k over the time up to t, k names being active, a
    merged stretch of one name has W(end) - W(start). One order of the endpoints
    of each scope gives W at every endpoint. The shares add up to the busy time.
    """
    runs = island_bounds(spans.filter("dur_ns > 0"), [*scopes, key], bucket_ns)
    start = runs.groupBy(*scopes).agg(F.min("ts_ns").alias("t0"))
    both = F.explode(F.array(F.struct(F.col("ts_ns").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end_ns").alias("t"), F.lit(-1).alias("d"))))
    p = runs.alias("r").join(start.alias("o"), same("r", "o", scopes)).select("r.*", "o.t0").select(*scopes, key, "t0", both.alias("e"))
    p = p.select(*scopes, key, (F.col("e.t") - F.col("t0")).alias("t"), F.col("e.d").alias("d"))
    if bucket_ns is None:
        p, any_cut = cut(p, scopes, "t")
        bucket = "bucket" if any_cut else None
    else:
        p, bucket = p.withColumn("bucket", F.floor(F.col("t") / F.lit(bucket_ns))), "bucket"
    order = [F.col("t"), F.col("d"), F.col(key)]
    p = running(p, scopes, F.col("d"), "sum", order, "k", bucket, -1)
    p = running(p, scopes, F.col("t"), "max", order, "last", bucket, -1)  # the endpoint before
    step = F.when(F.col("k") > 0, (F.col("t") - F.col("last")) / F.col("k")).otherwise(0.0)
    p = running(p, scopes, step, "sum", order, "w", bucket)
    return p.groupBy(key).agg(F.sum(-F.col("d") * F.col("w")).alias("shared_ns"))
