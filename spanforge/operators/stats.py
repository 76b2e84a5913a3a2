"""Aggregations over spans (D1-D14, H10) and the enrichment jobs built on them (K1-K6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions.text import build_ref, coordinate, kernel_base_name, kernel_family, mesh_text, occupancy_limit, rank_of_label
from spanforge.operators import ordered
from spanforge.operators.intervals import shared_time
from spanforge.operators.sums import WIDE, as_longs, wide_sum
from spanforge.schema import is_gpu_work
from spanforge.storage import broadcast_small, materialize


def _cell() -> Column:
    """The cell of a duration's logarithm, of a few thousand, in the order of durations."""
    return F.when(F.col("dur_ns").isNotNull(), F.floor(F.log2(F.greatest("dur_ns", F.lit(1)).cast("double")) * 64))


def _middles(spans: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, count, total_ns, max_ns, min_ns, first_ns, lower_ns, upper_ns): the last two are the middle durations of each group.

    No task holds a group. Equal durations of a group are counted first, in
    tasks by group and duration; cells of their logarithms tell which cell has
    the middles, and only the distinct durations of that cell, of one part in
    ninety of its length, are put in order.
    """
    d = spans.groupBy(*by, "dur_ns").agg(F.count("*").alias("n"), F.min("ts_ns").alias("first")).withColumn("cell", _cell())
    d = materialize(d, "durations")
    whole = [F.sum("n").alias("n"), wide_sum(F.col("dur_ns").cast(WIDE) * F.col("n")).alias("total"), F.max("dur_ns").alias("top"), F.min("dur_ns").alias("low"), F.min("first").alias("first")]
    cells = materialize(d.groupBy(*by, "cell").agg(*whole), "duration-cells")
    stats = cells.groupBy(*by).agg(F.sum("n").alias("count"), F.sum("total").alias("total_ns"), F.max("top").alias("max_ns"), F.min("low").alias("min_ns"), F.min("first").alias("first_ns"))

    everything = Window.partitionBy(*by)
    upto = everything.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    ranks = cells.filter("cell IS NOT NULL").select(*by, "cell", (F.sum("n").over(upto) - F.col("n")).alias("below"), F.sum("n").over(upto).alias("upto"), F.sum("n").over(everything).alias("total"))
    picks = F.expr("array(named_struct('which', 'lower', 'at', (total - 1) div 2), named_struct('which', 'upper', 'at', total div 2))")
    held = ranks.withColumn("p", F.explode(picks)).filter("p.at >= below AND p.at < upto").select(*by, "cell", "below", "p.which", "p.at")
    held = materialize(held, "duration-middles")  # two rows a group

    inside = d.alias("d").join(broadcast_small(held).alias("h"), ordered.same("d", "h", [*by, "cell"])).select("d.*", "h.below", "h.which", "h.at")
    run = Window.partitionBy(*by, "which").orderBy("dur_ns").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("upto", F.col("below") + F.sum("n").over(run)).filter("upto > at")
    found = inside.groupBy(*by).agg(*[F.min(F.when(F.col("which") == k, F.col("dur_ns"))).alias(f"{k}_ns") for k in ("lower", "upper")])
    return stats.alias("s").join(found.alias("f"), ordered.same("s", "f", by), "left").select("s.*", "f.lower_ns", "f.upper_ns")


def _groups(spans: DataFrame, by: Sequence[str], approximate: bool = False) -> DataFrame:
    """(by, count, total_ns, median_ns, max_ns, min_ns, first_ns, upper_ns); total_ns is a wide sum.

    Small inputs, by Spark's estimate, and approximate medians take one
    aggregation; larger ones give the same rows by ``_middles``.
    """
    if not approximate and ordered.estimated_bytes(spans) > ordered.SMALL_BYTES:
        s = _middles(spans, by).withColumn("median_ns", 0.5 * F.col("lower_ns") + 0.5 * F.col("upper_ns"))
    else:
        median = F.percentile_approx("dur_ns", 0.5, 10_000).cast("double") if approximate else F.percentile("dur_ns", F.lit(0.5))
        upper = F.percentile_approx("dur_ns", 0.5, 10_000) if approximate else F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY dur_ns DESC)")
        s = spans.groupBy(*by).agg(
            F.count("*").alias("count"),
            wide_sum("dur_ns").alias("total_ns"),
            median.alias("median_ns"),
            F.max("dur_ns").alias("max_ns"),
            F.min("dur_ns").alias("min_ns"),
            F.min("ts_ns").alias("first_ns"),
            upper.alias("upper_ns"),
        )  # of these, only what is selected is computed
    return s.select(*by, "count", F.col("total_ns").cast(WIDE).alias("total_ns"), "median_ns", F.greatest("max_ns", F.lit(0)).alias("max_ns"), "min_ns", "first_ns", F.col("upper_ns").cast("long").alias("upper_ns"))


def kernel_stats(spans: DataFrame, by: Sequence[str] = ("name",), approximate: bool = False) -> DataFrame:
    """(by, count, total_ns, median_ns, max_ns, min_ns); the median averages the two middles.

    It is exact, for groups of any size; ``approximate`` takes a sketch instead.
    total_ns is a long, or a decimal where one doesn't hold all totals.
    """
    return as_longs(_groups(spans, by, approximate).drop("first_ns", "upper_ns"), "total_ns")


def selection_stats(sel: DataFrame, overlap: bool = False) -> DataFrame:
    """``kernel_stats`` of a selection with first start, mean, and share of the total in percent.

    With ``overlap``, total_ns and the share are of shared time; the mean keeps the plain total.
    """
    s = _groups(sel, ["name"]).drop("upper_ns")
    s = s.withColumn("mean_ns", F.col("total_ns").cast("double") / F.col("count"))
    if overlap:
        s = s.drop("total_ns").join(shared_time(sel).select("name", F.col("shared_ns").alias("total_ns")), "name", "left").fillna(0.0, ["total_ns"])
    else:
        s = as_longs(s, "total_ns")
    total = s.agg((F.sum("total_ns") if overlap else wide_sum("total_ns")).cast("double").alias("all_ns"))
    s = s.crossJoin(F.broadcast(total))  # one row
    return s.withColumn("share_pct", F.when(F.col("all_ns") > 0, 100.0 * F.col("total_ns").cast("double") / F.col("all_ns")).otherwise(0.0)).drop("all_ns")


def grand_median(sel: DataFrame) -> DataFrame:
    """One row: the median of the whole selection, 0 if it is empty."""
    return _groups(sel, []).select(F.coalesce("median_ns", F.lit(0.0)).alias("median_ns"))


def sorted_stats(stats: DataFrame, column: str = "total_ns", ascending: bool = False, n: int | None = None) -> DataFrame:
    """The table by one column, ties by name."""
    out = stats.orderBy(F.col(column).asc() if ascending else F.col(column).desc(), "name")
    return out if n is None else out.limit(n)


def selection_rows(sel: DataFrame) -> DataFrame:
    """One row for each span."""
    return sel.select("span_id", "name", "ts_ns", "dur_ns")


def proportional_bar(stats: DataFrame) -> DataFrame:
    """(name, share, start): where each name lies on a bar of length 1, the largest first.

    The table of names is ordered in one task; it is the result of an aggregation by name.
    """
    w = Window.orderBy(F.col("total_ns").desc(), "name").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.greatest(F.lit(1.0), wide_sum("total_ns").over(everything).cast("double"))
    before = (wide_sum("total_ns").over(w) - F.col("total_ns")).cast("double")
    return stats.select("name", (F.col("total_ns").cast("double") / total).alias("share"), (before / total).alias("start"))


def duration_histogram(spans: DataFrame, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, bin, n, lo_ns, hi_ns): equal bins over [min, max], all of them; a zero range fills bin 0."""
    d = spans.select(*by, "dur_ns")
    edge = d.groupBy(*by).agg(F.min("dur_ns").alias("lo"), F.max("dur_ns").alias("hi"))
    j = d.join(edge, list(by)) if by else d.crossJoin(F.broadcast(edge))  # one row
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("dur_ns") - F.col("lo")) * F.lit(bins) / (F.col("hi") - F.col("lo"))), F.lit(bins - 1))).otherwise(0)
    n = j.groupBy(*by, b.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    width = (F.col("hi") - F.col("lo")) / F.lit(bins)
    every = edge.filter("lo is not null").withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    every = every.select(*by, "bin", (F.col("lo") + width * F.col("bin")).alias("lo_ns"), (F.col("lo") + width * (F.col("bin") + 1)).alias("hi_ns"))
    return every.join(n, [*by, "bin"], "left").select(*by, "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "lo_ns", "hi_ns")


def histogram_header(spans: DataFrame, by: Sequence[str] = ("name",)) -> DataFrame:
    """(by, count, mean_ns, upper_median_ns) for groups of two calls or more."""
    out = _groups(spans, by).select(*by, "count", (F.col("total_ns").cast("double") / F.col("count")).alias("mean_ns"), F.col("upper_ns").alias("upper_median_ns"))
    return out.filter("count >= 2")


def duration_percentile(histogram: DataFrame, dur_ns: int) -> DataFrame:
    """One row: about which percentile a duration is at, from the bins below and a fraction of its own."""
    d = F.lit(dur_ns).cast("double")
    width = F.col("hi_ns") - F.col("lo_ns")
    part = F.when(width > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (d - F.col("lo_ns")) / width))).otherwise((d >= F.col("lo_ns")).cast("double"))
    return histogram.agg((100.0 * F.sum(F.col("n") * part) / F.sum("n")).alias("percentile"))



def gpu_durations(spans: DataFrame) -> DataFrame:
    return spans.filter(F.col("gpu") & (F.col("dur_ns") > 0) & is_gpu_work())


def exact_ranks(spans: DataFrame, shares: dict[str, float], of: str) -> DataFrame:
    """(which, dur_ns): durations at index floor(share * (n or n - 1)) of the sorted ones, exactly.

    Durations are counted by cells of their logarithm, a few thousand, which tell
    the cell that holds each rank; only the distinct durations of that cell are
    put in order.
    """
    d = spans.groupBy("dur_ns").agg(F.count("*").alias("n"))
    d = d.withColumn("cell", _cell())
    cells = d.groupBy("cell").agg(F.sum("n").alias("n"))
    w = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cells = cells.select("cell", (F.sum("n").over(w) - F.col("n")).alias("below"), F.sum("n").over(w).alias("upto"), F.sum("n").over(everything).alias("total"))
    total = F.col("total") - (1 if of == "n-1" else 0)
    picks = [F.struct(F.lit(k).alias("which"), F.floor(F.lit(s) * total).alias("at")) for k, s in shares.items()]
    held = cells.select("cell", "below", "upto", F.explode(F.array(*picks)).alias("p")).filter((F.col("p.at") >= F.col("below")) & (F.col("p.at") < F.col("upto")))
    held = held.select("cell", "below", F.col("p.which").alias("which"), F.col("p.at").alias("at"))
    inside = d.join(F.broadcast(held), "cell")  # one row for each pick
    run = Window.partitionBy("which").orderBy("dur_ns").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("upto", F.col("below") + F.sum("n").over(run)).filter(F.col("upto") > F.col("at"))
    return inside.groupBy("which").agg(F.min("dur_ns").alias("dur_ns"))


def heat_bounds(spans: DataFrame, approximate: bool = False) -> DataFrame:
    """One row (lo, hi): log10 of the duration in microseconds at 5 % and at most, of GPU work.

    lo is 0 at least; hi is lo + 1 where it would not be above; (0, 1) without rows.
    """
    d = gpu_durations(spans)
    log = lambda c: F.log10(c / F.lit(1000.0))
    if approximate:
        lo = d.agg(F.percentile_approx("dur_ns", 0.05, 100_000).alias("low"))
    else:
        lo = exact_ranks(d, {"p5": 0.05}, "n").agg(F.max("dur_ns").alias("low"))
    b = d.agg(F.max("dur_ns").alias("top")).crossJoin(F.broadcast(lo))  # one row each
    b = b.select(F.coalesce(F.greatest(F.lit(0.0), log(F.col("low"))), F.lit(0.0)).alias("lo"), log(F.col("top")).alias("top"))
    return b.select("lo", F.when(F.col("top") > F.col("lo"), F.col("top")).otherwise(F.col("lo") + 1).alias("hi"))


def heat_score(spans: DataFrame) -> DataFrame:
    """(span_id, heat): where each GPU span is on the heat scale, from 0 to 1."""
    d = gpu_durations(spans).select("span_id", "dur_ns").crossJoin(F.broadcast(heat_bounds(spans)))  # one row
    x = (F.log10(F.col("dur_ns") / F.lit(1000.0)) - F.col("lo")) / (F.col("hi") - F.col("lo"))
    return d.select("span_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)).alias("heat"))


def duration_quantiles(spans: DataFrame, ps: Sequence[float] = (0.05, 0.5, 0.95, 0.99, 0.999)) -> DataFrame:
    """(which, dur_ns) of GPU work at index floor((n - 1) p)."""
    return exact_ranks(gpu_durations(spans), {f"p{100 * p:g}": p for p in ps}, "n-1")


def slowest(spans: DataFrame, n: int = 25) -> DataFrame:
    """The n slowest spans on GPU tracks."""
    return spans.filter("gpu").orderBy(F.col("dur_ns").desc(), "span_id").limit(n).select("span_id", "name", "dur_ns")


def overview(spans: DataFrame) -> DataFrame:
    """One row: spans, tracks, ranks and the last end. Tracks are counted from their own aggregation."""
    t = spans.groupBy("run", "rank", "pid", "tid").agg(F.count("*").alias("n"), F.max("end_ns").alias("last"))
    r = t.groupBy("rank").agg(F.sum("n").alias("n"), F.count("*").alias("tracks"), F.max("last").alias("last"))
    return r.agg(F.sum("n").cast("long").alias("events"), F.sum("tracks").cast("long").alias("tracks"), F.count("rank").alias("ranks"), F.max("last").alias("max_ns"))


def compare_stats(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per-name totals of two selections side by side, and the change in percent where a has any."""
    x = kernel_stats(a).select("name", F.col("count").alias("count_a"), F.col("total_ns").alias("total_a"))
    y = kernel_stats(b).select("name", F.col("count").alias("count_b"), F.col("total_ns").alias("total_b"))
    j = x.join(y, "name", "full").fillna(0, ["count_a", "total_a", "count_b", "total_b"])
    return j.withColumn("delta_pct", F.when(F.col("total_a") > 0, 100.0 * (F.col("total_b") - F.col("total_a")) / F.col("total_a")))


def enrich_scope(spans: DataFrame, tracks: DataFrame) -> DataFrame:
    """K1: spans with the rank that their track's label names."""
    labels = tracks.select("run", "pid", "tid", "track").distinct().withColumn("label_rank", rank_of_label(F.col("track")))
    return spans.join(labels.select("run", "track", "label_rank").distinct(), ["run", "track"])


def runs_dimension(runs: DataFrame) -> DataFrame:
    """K2: runs with dp, tp, pp, ep, dcp and the mesh summary of their path."""
    c = {n: coordinate(F.col("path"), n) for n in ("dp", "tp", "pp", "ep", "dcp")}
    return runs.withColumns(c | {"mesh": mesh_text(F.col("dist_rank"), F.col("dist_world"), F.col("path"))})


def occupancy_breakdown(spans: DataFrame) -> DataFrame:
    """K3: launches and time by kernel and limiting factor."""
    o = spans.withColumn("o", occupancy_limit(F.col("args"))).filter("o.limit is not null")
    return as_longs(o.groupBy("name", F.col("o.limit").alias("limit"), F.col("o.suspect").alias("suspect")).agg(F.count("*").alias("launches"), wide_sum("dur_ns").alias("total_ns")), "total_ns")


def args_profile(spans: DataFrame) -> DataFrame:
    """K4: (key, value, n): how often each argument has each value; nested values stay text."""
    m = F.from_json("args", "map<string,string>")
    return spans.select(F.explode(m).alias("key", "value")).groupBy("key", "value").agg(F.count("*").alias("n"))


def time_by_family(spans: DataFrame) -> DataFrame:
    """K5: (base, family, count, total_ns)."""
    s = spans.groupBy("name").agg(F.count("*").alias("count"), wide_sum("dur_ns").alias("total_ns"))
    s = s.groupBy(kernel_base_name(F.col("name")).alias("base"), kernel_family(F.col("name")).alias("family"))
    return as_longs(s.agg(F.sum("count").cast("long").alias("count"), wide_sum("total_ns").alias("total_ns")), "total_ns")


def build_refs(runs: DataFrame) -> DataFrame:
    """K6: runs with what their version says about the build."""
    return runs.withColumn("build", build_ref(F.col("version")))
