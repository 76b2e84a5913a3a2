"""Assembly of the timeline: normalised times, tracks, their labels and order, merged ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanforge.schema import TRACK, Bundle
from spanforge.storage import broadcast_small


def normalise(spans: DataFrame) -> DataFrame:
    """B1: times from the first span of each run."""
    start = spans.groupBy("run").agg(F.min("ts_ns").alias("t0"))
    out = spans.join(broadcast_small(start), "run")  # one row for each run
    return out.withColumns({"ts_ns": F.col("ts_ns") - F.col("t0"), "end_ns": F.col("end_ns") - F.col("t0")}).select(*spans.columns)


def classify_tracks(spans: DataFrame) -> DataFrame:
    """(run, rank, pid, tid, gpu, n_events, track_idx).

    A track is of the GPU if more than half of its spans (rounded down) are
    kernels or have a ``gpu_`` category, annotations included. GPU tracks come
    first, then the ones with more spans.
    """
    c = F.col("cat")
    on_gpu = F.count_if((c == "kernel") | c.startswith("gpu_"))
    t = spans.groupBy(*TRACK).agg(F.count("*").alias("n_events"), (on_gpu > F.floor(F.count("*") / 2)).alias("gpu"))
    # the tracks of a run are few beside its spans
    order = Window.partitionBy("run").orderBy(F.col("gpu").desc(), F.col("n_events").desc(), "rank", "pid", "tid")
    return t.withColumn("track_idx", F.row_number().over(order) - 1)


def label_tracks(tracks: DataFrame, thread_names: DataFrame) -> DataFrame:
    """The last thread name by seq, else "GPU tid" or "Thread tid"."""
    key = [F.col(c) for c in TRACK]
    last = thread_names.groupBy(*key).agg(F.max_by("label", "seq").alias("label"))
    t, n = tracks.alias("t"), last.alias("n")
    same = reduce(lambda a, b: a & b, [F.col(f"t.{c}").eqNullSafe(F.col(f"n.{c}")) for c in TRACK])
    plain = F.concat(F.when(F.col("t.gpu"), "GPU ").otherwise("Thread "), F.col("t.tid"))
    return t.join(n, same, "left").select("t.*", F.coalesce("n.label", plain).alias("track"))


def with_tracks(spans: DataFrame, tracks: DataFrame, *columns: str) -> DataFrame:
    """Spans with columns of their track."""
    s, t = spans.drop(*columns).alias("s"), tracks.select(*TRACK, *columns).alias("t")
    same = reduce(lambda a, b: a & b, [F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}")) for c in TRACK])
    return s.join(t, same).select("s.*", *[F.col(f"t.{c}") for c in columns])


def merge_ranks(bundles: list[tuple[int, Bundle]], run: str = "merged") -> Bundle:
    """One timeline of many ranks: from the first start of all, labels with "Rank N", tracks by rank."""

    def put(df: DataFrame, rank: int) -> DataFrame:
        return df.withColumn("rank", F.lit(rank).cast("int")).withColumn("run", F.lit(run))

    def every(get) -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b), [put(get(b), r) for r, b in bundles])

    spans, tracks, flows, runs = (every(lambda b, n=n: getattr(b, n)) for n in ("spans", "tracks", "flows", "runs"))
    named = F.concat(F.lit("Rank "), F.col("rank").cast("string"), F.lit(" "), F.col("track"))
    start = spans.agg(F.min("ts_ns").alias("t0"))
    spans = spans.withColumn("track", named).crossJoin(F.broadcast(start))  # one row
    spans = spans.withColumns({"ts_ns": F.col("ts_ns") - F.col("t0"), "end_ns": F.col("end_ns") - F.col("t0")}).drop("t0")
    flows = flows.crossJoin(F.broadcast(start)).withColumn("ts_ns", F.col("ts_ns") - F.col("t0")).drop("t0")
    return Bundle(spans, tracks.withColumn("track", named), flows, runs)


def merged_header(runs: DataFrame) -> DataFrame:
    """One row: the first device and version that aren't empty, by rank, and the first world size above 0."""
    first = lambda c, ok: F.min_by(F.when(ok, F.col(c)), F.when(ok, F.col("rank")))
    return runs.agg(
        first("device", F.length("device") > 0).alias("device"),
        first("version", F.length("version") > 0).alias("version"),
        first("dist_world", F.col("dist_world") > 0).alias("dist_world"),
        F.count("*").alias("n_ranks"),
    )
