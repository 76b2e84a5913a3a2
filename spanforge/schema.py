"""Tables of the library: spans, tracks, flows and runs, as plain DataFrames.

Times are whole nanoseconds, so sums don't depend on the order of the rows.
A track is (run, rank, pid, tid); a scope is a rank, and all rows without a rank
share one scope.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPANS = (
    "run string, rank int, pid string, tid string, track string, gpu boolean, seq long, span_id long, name string, cat string, ts_ns long, dur_ns long, end_ns long, args string"
)
TRACKS = "run string, rank int, pid string, tid string, n_events long, gpu boolean, track_idx int, track string"
FLOWS = "run string, rank int, flow_id long, pid string, tid string, ts_ns long, is_start boolean"
RUNS = "run string, rank int, path string, device string, version string, dist_rank int, dist_world int, dp int, tp int, pp int, ep int, dcp int, min_ts_ns long"
SPAN_COLUMNS = tuple(c.split()[0] for c in SPANS.split(", "))
TRACK = ("run", "rank", "pid", "tid")
NS_PER_US = 1000


@dataclass(frozen=True)
class Bundle:
    """What reading traces gives."""

    spans: DataFrame
    tracks: DataFrame
    flows: DataFrame
    runs: DataFrame
    bad_files: DataFrame | None = None


def scope(rank: str = "rank") -> Column:
    return F.coalesce(F.col(rank), F.lit(-1))


def is_gpu_work(cat: str = "cat") -> Column:
    """Work of the device: kernels, copies and the like, but no annotations."""
    c = F.col(cat)
    return F.coalesce((c == "kernel") | (c.startswith("gpu_") & (c != "gpu_user_annotation")), F.lit(False))


def is_gpu_busy() -> Column:
    """Rows of a spans table that keep the device busy."""
    return F.col("gpu") & (F.col("dur_ns") > 0) & is_gpu_work()


def overlaps(w: tuple[int, int] | None) -> Column:
    """Closed overlap with a window of times."""
    if w is None:
        return F.lit(True)
    return (F.col("end_ns") >= F.lit(w[0])) & (F.col("ts_ns") <= F.lit(w[1]))
