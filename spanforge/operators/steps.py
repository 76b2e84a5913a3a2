"""Scheduler steps from their annotations."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions.steps import step_batch
from spanforge.functions.text import coordinate
from spanforge.operators.intervals import union_length
from spanforge.operators.meet import overlapping
from spanforge.operators.select import is_exec_context
from spanforge.operators.tracks import with_tracks
from spanforge.storage import broadcast_small, materialize

#: Steps up to which every task gets all of them; spans searched at once.
FEW_STEPS, SEARCHED = 200_000, 10_000
BATCH = ("total_tokens", "n_ctx", "n_gen", "ctx_tokens", "ctx_kv", "gen_tokens", "gen_kv")


def step_batches(names: DataFrame) -> DataFrame:
    """G1: (name, batch) of the distinct step names."""
    n = names.select("name").distinct().filter(is_exec_context())
    return n.withColumn("batch", step_batch(F.col("name")))


def step_spans(spans: DataFrame, tracks: DataFrame) -> DataFrame:
    """The step annotations of the device, or those of the host where there are none."""
    s = spans.filter(is_exec_context() & F.col("cat").isin("gpu_user_annotation", "user_annotation"))
    some = s.agg(F.coalesce(F.bool_or(F.col("cat") == "gpu_user_annotation"), F.lit(False)).alias("device"))
    s = s.crossJoin(F.broadcast(some))  # one row
    s = s.filter(F.col("cat") == F.when(F.col("device"), "gpu_user_annotation").otherwise("user_annotation")).drop("device")
    return with_tracks(s, tracks, "track_idx")


def reference_track(steps: DataFrame) -> DataFrame:
    """One row: the track with most step spans, then the longest, then the first."""
    t = steps.groupBy("run", "rank", "pid", "tid", "track_idx").agg(F.count("*").alias("n"), F.sum("dur_ns").cast("long").alias("total_ns"))
    return t.orderBy(F.col("n").desc(), F.col("total_ns").desc(), "track_idx").limit(1)


def reference_steps(steps: DataFrame) -> DataFrame:
    """(step, r0, r1, ref_name): the spans of the reference track in time order."""
    ref = steps.join(F.broadcast(reference_track(steps).select("track_idx")), "track_idx")  # one row
    w = Window.orderBy("ts_ns", "seq")  # one track's annotations
    return ref.select((F.row_number().over(w) - 1).alias("step"), F.col("ts_ns").alias("r0"), F.col("end_ns").alias("r1"), F.col("name").alias("ref_name"))


def _width(steps: DataFrame, t0: str, t1: str) -> int:
    """A width of time buckets: the mean distance of steps."""
    r = steps.agg(F.max(t1) - F.min(t0), F.count("*")).first()
    return max(1, (r[0] or 0) // max(1, r[1]))


def _buckets(t0: str, t1: str, width: int):
    return F.explode(F.sequence(F.floor(F.col(t0) / F.lit(width)), F.floor(F.col(t1) / F.lit(width))))


def assign_steps(steps: DataFrame, ref: DataFrame) -> DataFrame:
    """Step spans with the step that they overlap most, the earliest of equals; without overlap, the nearest.

    Nearest is by the sum of the distances of both ends. Steps are the
    annotations of one track: where they are few, every task searches all of
    them. Others meet the spans in cells of several widths, with the same result. A step that ends by a span's start, or starts at its end, is as
    far as the sums of both their ends are apart; so the nearest step before a
    span is the one of the largest sum, and after it the one of the smallest.
    """
    if ref.limit(FEW_STEPS + 1).count() <= FEW_STEPS:
        return steps.join(_searched(steps, ref), "span_id")
    width = _width(ref, "r0", "r1")
    met = overlapping(steps.select("span_id", "ts_ns", "end_ns"), ref, [], b_at=("r0", "r1")).filter((F.col("ts_ns") < F.col("r1")) & (F.col("end_ns") > F.col("r0")))
    shared = F.least("end_ns", "r1") - F.greatest("ts_ns", "r0")
    best = met.groupBy("span_id").agg(F.max(F.struct(shared.alias("shared"), (-F.col("step")).alias("neg"))).alias("m"))
    best = best.filter("m.shared > 0").select("span_id", (-F.col("m.neg")).alias("step"))
    lone = steps.select("span_id", "ts_ns", "end_ns").join(best, "span_id", "left_anti")
    both, own = F.col("r0") + F.col("r1"), F.col("ts_ns") + F.col("end_ns")
    steps_at = lambda t, sign: ref.select((sign * F.col(t)).alias("t"), F.struct((sign * both).alias("sum"), (-F.col("step")).alias("neg")).alias("v"))
    spans_at = lambda t, sign: lone.select("span_id", (sign * F.col(t)).alias("t"), (sign * own).alias("own"))
    ends = [best_before(steps_at("r1", 1), spans_at("ts_ns", 1), width), best_before(steps_at("r0", -1), spans_at("end_ns", -1), width)]
    at = [e.select("span_id", (F.col("own") - F.col("v.sum")).alias("far"), (-F.col("v.neg")).alias("step")) for e in ends]
    # a span or step of no length inside the other meets it without overlap
    inside = F.abs(F.col("r0") - F.col("ts_ns")) + F.abs(F.col("r1") - F.col("end_ns"))
    at.append(met.filter(shared <= 0).select("span_id", inside.alias("far"), "step"))
    near = reduce(DataFrame.unionByName, at).join(lone.select("span_id"), "span_id", "left_semi")
    near = near.groupBy("span_id").agg(F.min(F.struct("far", "step"))["step"].alias("step"))
    return steps.join(best.unionByName(near), "span_id")


def _searched(steps: DataFrame, ref: DataFrame) -> DataFrame:
    """(span_id, step) as ``assign_steps`` has them, by search in the sorted steps, of which there are ``FEW_STEPS`` at most."""
    rows = sorted((r["r0"], r["r1"], r["step"]) for r in ref.select("r0", "r1", "step").collect())
    r0, r1, number = (np.array([r[i] for r in rows], np.int64) for i in range(3))
    latest = np.maximum.accumulate(r1) if len(rows) else r1
    n = len(rows)
    # of steps that end by a time the one of the largest sum, of those that start from a time on the one of the smallest
    by_end = np.lexsort((r0, r1))
    order = np.lexsort((number, -(r0 + r1)))  # best first
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    before = order[np.minimum.accumulate(rank[by_end])] if n else by_end
    order = np.lexsort((number, r0 + r1))
    rank[order] = np.arange(n)
    after = order[np.minimum.accumulate(rank[::-1])[::-1]] if n else order

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b) or not n:
                continue
            ids, ts, end = (b[c].to_numpy(np.int64) for c in ("span_id", "ts_ns", "end_ns"))
            for at in range(0, len(ids), SEARCHED):
                yield pd.DataFrame(dict(zip(("span_id", "step"), one(ids[at : at + SEARCHED], ts[at : at + SEARCHED], end[at : at + SEARCHED]), strict=True)))

    def one(ids: np.ndarray, ts: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = len(ids)
        lo, hi = np.searchsorted(latest, ts, "right"), np.searchsorted(r0, end, "left")  # r1 > ts, r0 < end
        per = np.maximum(0, hi - lo)
        who = np.repeat(np.arange(m), per)
        k = np.arange(per.sum()) + np.repeat(lo - (np.cumsum(per) - per), per)
        meets = r1[k] > ts[who]
        who, k = who[meets], k[meets]
        shared = np.minimum(end[who], r1[k]) - np.maximum(ts[who], r0[k])
        s = np.lexsort((number[k], -shared, who))
        who, k, shared = who[s], k[s], shared[s]
        first = np.r_[True, who[1:] != who[:-1]] if len(who) else np.zeros(0, bool)
        step = np.full(m, -1, np.int64)
        good = first & (shared > 0)
        step[who[good]] = number[k[good]]
        # the others: the nearest before, after, or met without overlap
        lone = step < 0
        found = []
        e = np.searchsorted(r1[by_end], ts, "right")
        x = np.flatnonzero(lone & (e > 0))
        p = before[e[x] - 1]
        found.append((x, ts[x] + end[x] - r0[p] - r1[p], number[p]))
        e = np.searchsorted(r0, end, "left")
        x = np.flatnonzero(lone & (e < n))
        p = after[e[x]]
        found.append((x, r0[p] + r1[p] - ts[x] - end[x], number[p]))
        inside = lone[who]
        x, p = who[inside], k[inside]
        found.append((x, np.abs(r0[p] - ts[x]) + np.abs(r1[p] - end[x]), number[p]))
        x, far, at = (np.concatenate(c) for c in zip(*found, strict=True))
        s = np.lexsort((at, far, x))
        x, at = x[s], at[s]
        first = np.r_[True, x[1:] != x[:-1]] if len(x) else np.zeros(0, bool)
        step[x[first]] = at[first]
        some = step >= 0
        return ids[some], step[some]

    return steps.select("span_id", "ts_ns", "end_ns").mapInPandas(run, f"span_id long, step {ref.schema['step'].dataType.simpleString()}")


def best_before(values: DataFrame, points: DataFrame, width: int) -> DataFrame:
    """Points (span_id, t, own) with v, the largest of the values (t, v) whose t isn't after theirs; those without any are left out.

    Both are put in order within buckets of time; what precedes a bucket comes
    from a table with one row for each.
    """
    bucket = F.floor(F.col("t") / F.lit(width))
    v = values.withColumn("b", bucket)
    edge = v.groupBy("b").agg(F.max("v").alias("last")).unionByName(points.select(bucket.alias("b")).distinct().withColumn("last", F.lit(None).cast(v.schema["v"].dataType)))
    edge = edge.groupBy("b").agg(F.max("last").alias("last"))
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # one row for each bucket, of about a step
    edge = edge.select("b", F.max("last").over(before).alias("carry"))
    rows = v.select("b", "t", "v", F.lit(None).cast("long").alias("span_id"), F.lit(None).cast("long").alias("own"))
    rows = rows.unionByName(points.select(bucket.alias("b"), "t", F.lit(None).cast(v.schema["v"].dataType).alias("v"), "span_id", "own"))
    upto = Window.partitionBy("b").orderBy("t", F.col("span_id").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("upto", F.max("v").over(upto)).filter("span_id is not null").join(edge, "b")
    return found.select("span_id", "own", F.greatest("upto", "carry").alias("v")).filter("v is not null")


def steps(spans: DataFrame, tracks: DataFrame, runs: DataFrame) -> DataFrame:
    """One row for each step in the order of the reference track.

    (step, t0, t1, n_ranks, idle_before_ns, gpu_ns, kernel_count, batch, group_batches).
    A track without a rank counts as a rank of its own. gpu_ns is the median over
    ranks of each rank's covered time. kernel_count is of kernels on GPU tracks
    that start in [t0, t1). With dp groups known, the first span of each (step,
    group) gives the group's batch, and the batches are summed; kv sums are null
    where any part is. Otherwise the batch is that of the reference span.
    """
    found = materialize(step_spans(spans, tracks), "step-spans")
    ref = materialize(reference_steps(found), "step-reference")
    a = materialize(assign_steps(found, ref), "step-assigned")
    who = F.coalesce(F.col("rank").cast("long"), F.col("track_idx").cast("long"))
    a = a.withColumn("who", who)
    bounds = a.groupBy("step").agg(F.min("ts_ns").alias("t0"), F.max("end_ns").alias("t1"), F.count_distinct("who").cast("int").alias("n_ranks")).filter("t1 > t0")
    line = Window.orderBy("step")  # one row for each step
    bounds = bounds.withColumn("idle_before_ns", F.coalesce(F.greatest(F.lit(0), F.col("t0") - F.lag("t1").over(line)), F.lit(0)))
    gpu = union_length(a, ["step", "who"], name="ns").groupBy("step").agg(F.percentile("ns", F.lit(0.5)).alias("gpu_ns"))
    kernels = spans.filter(F.col("gpu") & (F.col("cat") == "kernel")).select(F.col("ts_ns").alias("k"))
    bounds = materialize(bounds, "step-bounds")
    width = _width(bounds, "t0", "t1")
    cells = broadcast_small(bounds.select("step", "t0", "t1", _buckets("t0", "t1", width).alias("b")))
    counts = kernels.withColumn("b", F.floor(F.col("k") / F.lit(width))).join(cells, "b").filter((F.col("k") >= F.col("t0")) & (F.col("k") < F.col("t1")))
    counts = counts.groupBy("step").agg(F.count("*").alias("kernel_count"))
    dp = runs.select(F.col("run"), F.col("rank"), coordinate(F.col("path"), "dp").alias("dp")).filter("dp is not null and rank is not null")
    grouped = a.join(dp, ["run", "rank"])
    first = grouped.groupBy("step", "dp").agg(F.min_by("name", F.struct("track_idx", "ts_ns", "seq")).alias("name"))
    first = first.withColumn("b", step_batch(F.col("name")))
    kv = lambda c: F.when(F.count(F.when(F.col("b").isNotNull(), F.col(f"b.{c}"))) == F.count("b"), F.sum(f"b.{c}"))
    summed = [(kv(c) if c.endswith("kv") else F.sum(f"b.{c}")).cast("long").alias(c) for c in BATCH]
    total = first.groupBy("step").agg(F.count("b").alias("parsed"), F.struct(*summed).alias("sum"), F.sort_array(F.collect_list(F.when(F.col("b").isNotNull(), F.struct("dp", "b")))).alias("group_batches"))
    own = ref.select("step", step_batch(F.col("ref_name")).alias("own"))
    out = bounds.join(gpu, "step").join(counts, "step", "left").join(total, "step", "left").join(own, "step")
    batch = F.when(F.col("parsed").isNull(), F.col("own")).when(F.col("parsed") > 0, F.col("sum"))
    return out.select("step", "t0", "t1", "n_ranks", "idle_before_ns", "gpu_ns", F.coalesce("kernel_count", F.lit(0)).alias("kernel_count"), batch.alias("batch"), "group_batches")


def with_coords(spans: DataFrame, runs: DataFrame) -> DataFrame:
    """H9: spans with the coordinates of their rank's file."""
    c = runs.select("run", "rank", *[coordinate(F.col("path"), n).alias(n) for n in ("dp", "tp", "pp", "ep")])
    return spans.join(c, ["run", "rank"], "left")


