"""Idle gaps of the device and what explains them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanforge.operators import ordered
from spanforge.operators.intervals import islands, union_length
from spanforge.operators.meet import overlapping
from spanforge.operators.sums import WIDE, as_longs, wide_sum
from spanforge.schema import is_gpu_busy, is_gpu_work, scope
from spanforge.storage import materialize

MIN_GAP_NS = 1000
TOP = 500
#: Gaps up to which all are broadcast: three numbers each.
SMALL = 500_000
CPU_WORK = ("cpu_op", "runtime", "cuda_runtime", "cuda_driver")
RUNTIME = ("runtime", "cuda_runtime", "cuda_driver")


def busy_islands(spans: DataFrame, bucket_ns: int | None = None) -> DataFrame:
    """(scope, island, ts_ns, end_ns, opened_by, closed_by): merged busy time, and the names at its ends.

    closed_by is the span that first, by start then end then seq, reached the latest end.
    """
    busy = spans.filter(is_gpu_busy()).select(scope().alias("scope"), "ts_ns", "end_ns", "seq", "name")
    i = islands(busy, ["scope"], bucket_ns)
    last = F.max_by("name", F.struct(F.col("end_ns"), -F.col("ts_ns"), -F.col("seq")))
    first = F.min_by("name", F.struct("ts_ns", "end_ns", "seq"))
    return i.groupBy("scope", "island").agg(F.min("ts_ns").alias("ts_ns"), F.max("end_ns").alias("end_ns"), first.alias("opened_by"), last.alias("closed_by"))


def all_gaps(spans: DataFrame, min_ns: int = MIN_GAP_NS, scopes: list[int] | None = None, bucket_ns: int | None = None) -> DataFrame:
    """(scope, t0, t1, gap_ns, prev_name, next_name) between neighbouring islands.

    An island's follower is its number plus one: an equi-join, without another order.
    """
    if scopes is not None:
        spans = spans.filter(scope().isin(scopes)) if scopes else spans.filter(F.lit(False))
    i = busy_islands(spans, bucket_ns)
    if bucket_ns is None and ordered.estimated_bytes(spans) <= ordered.SMALL_BYTES:
        w = Window.partitionBy("scope").orderBy("island")
        g = i.select("scope", F.col("end_ns").alias("t0"), F.lead("ts_ns").over(w).alias("t1"), F.col("closed_by").alias("prev_name"), F.lead("opened_by").over(w).alias("next_name"))
    else:
        after = i.select("scope", (F.col("island") - 1).alias("island"), F.col("ts_ns").alias("t1"), F.col("opened_by").alias("next_name"))
        g = i.join(after, ["scope", "island"]).select("scope", F.col("end_ns").alias("t0"), "t1", F.col("closed_by").alias("prev_name"), "next_name")
    g = g.withColumn("gap_ns", F.col("t1") - F.col("t0"))
    return g.filter(F.col("gap_ns") >= min_ns).select("scope", "t0", "t1", "gap_ns", "prev_name", "next_name")


def idle_gaps(spans: DataFrame, w: tuple[int, int] | None = None, scopes: list[int] | None = None, top: int = TOP, min_ns: int = MIN_GAP_NS, bucket_ns: int | None = None) -> DataFrame:
    """the longest gaps: of the scopes, clipped to the window, at least min_ns after that; an empty list of scopes has none."""
    g = all_gaps(spans, min_ns, scopes, bucket_ns)
    if w is not None:
        g = g.withColumns({"t0": F.greatest("t0", F.lit(w[0])), "t1": F.least("t1", F.lit(w[1]))})
        g = g.withColumn("gap_ns", F.col("t1") - F.col("t0")).filter(F.col("gap_ns") >= min_ns)
    return g.orderBy(F.col("gap_ns").desc(), "scope", "t0").limit(top)


def explain_gaps(gaps: DataFrame, spans: DataFrame) -> DataFrame:
    """gaps with what the scope's CPU tracks did in them.

    cpu_busy_frac and runtime_frac are covered shares of the gap; cpu_top are the
    three names that cover most of it, as array of (name, launches, covered_ns);
    cause is one of "no CPU data", "starved", "runtime-bound", "host-bound".
    Gaps that are few, as the result of a top-n is, are broadcast: spans stay put.
    Others meet the spans in cells of several widths.
    """
    gaps = materialize(gaps, "gaps")  # counted, joined, and read for the result
    g = gaps.select("scope", "t0", "t1").distinct()
    cpu = spans.filter(~F.col("gpu"))
    has = cpu.select(scope().alias("scope")).distinct().withColumn("has_cpu", F.lit(True))
    work = cpu.filter(F.col("cat").isin(*CPU_WORK)).select(scope().alias("scope"), "ts_ns", "end_ns", "seq", "name", "cat")
    if g.limit(SMALL + 1).count() <= SMALL:
        g = F.broadcast(g)
        hit = work.join(g, (work["scope"] == g["scope"]) & (F.col("ts_ns") < F.col("t1")) & (F.col("end_ns") > F.col("t0"))).drop(g["scope"])
    else:
        hit = overlapping(work, g, ["scope"])
    hit = hit.withColumns({"ts_ns": F.greatest("ts_ns", "t0"), "end_ns": F.least("end_ns", "t1")}).filter("end_ns > ts_ns")
    hit = materialize(hit, "gap-hits")  # four sums read it
    key = ["scope", "t0", "t1"]
    busy = union_length(hit, key, name="cpu_ns")
    runtime = union_length(hit.filter(F.col("cat").isin(*RUNTIME)), key, name="runtime_ns")
    per = union_length(hit, [*key, "name"], name="covered_ns").join(hit.groupBy(*key, "name").agg(F.count("*").alias("launches")), [*key, "name"])
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("covered_ns").desc(), "name"))
    per = per.withColumn("rn", rank).filter("rn <= 3").groupBy(*key)
    per = per.agg(F.sort_array(F.collect_list(F.struct("rn", "name", "launches", "covered_ns"))).alias("top"))
    per = per.withColumn("cpu_top", F.transform("top", lambda x: F.struct(x["name"].alias("name"), x["launches"].alias("launches"), x["covered_ns"].alias("covered_ns")))).drop("top")
    out = gaps.join(busy, key, "left").join(runtime, key, "left").join(per, key, "left").join(has, "scope", "left")
    share = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.col("gap_ns")
    out = out.withColumns({"cpu_busy_frac": share("cpu_ns"), "runtime_frac": share("runtime_ns"), "has_cpu": F.coalesce("has_cpu", F.lit(False))})
    return out.withColumn("cause", cause()).drop("cpu_ns", "runtime_ns")


def cause():
    """F5."""
    return (
        F.when(~F.col("has_cpu"), "no CPU data")
        .when(F.col("cpu_busy_frac") < 0.2, "starved")
        .when(F.col("runtime_frac") >= 0.5 * F.col("cpu_busy_frac"), "runtime-bound")
        .otherwise("host-bound")
    )


def gap_totals(gaps: DataFrame) -> DataFrame:
    """F6."""
    return as_longs(gaps.agg(F.count("*").alias("gaps"), F.coalesce(wide_sum("gap_ns"), F.lit(0).cast(WIDE)).alias("idle_ns")), "idle_ns")


def idle_summary(sel: DataFrame, w: tuple[int, int]) -> DataFrame:
    """(scope, t0, t1, busy_ns, idle_ns, idle_pct) of a selection's GPU work, clipped to the window."""
    s = sel.filter(is_gpu_busy() & is_gpu_work()).withColumns({"ts_ns": F.greatest("ts_ns", F.lit(w[0])), "end_ns": F.least("end_ns", F.lit(w[1])), "scope": scope()})
    s = s.filter("end_ns > ts_ns")
    out = s.groupBy("scope").agg(F.min("ts_ns").alias("t0"), F.max("end_ns").alias("t1")).join(union_length(s, ["scope"]), "scope")
    out = out.withColumn("idle_ns", F.col("t1") - F.col("t0") - F.col("busy_ns"))
    return out.withColumn("idle_pct", F.when(F.col("t1") > F.col("t0"), 100.0 * F.col("idle_ns") / (F.col("t1") - F.col("t0"))).otherwise(0.0))
