"""Aligning the clocks of ranks on a marker."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.functions.text import coordinate
from spanforge.schema import Bundle

#: A fixed value: part of the name of a call that every rank reaches early.
MARKER = "deep_ep::elastic::combine_impl"


def clock_shifts(spans: DataFrame, runs: DataFrame, marker: str = MARKER, check: bool = True) -> DataFrame:
    """(rank, dp, shift_ns) of the ranks that have the marker.

    A rank's time is the end of its first span whose name has the marker in it.
    Ranks are grouped by the dp of their file, those without by themselves; a
    group's time is that of its lowest tp, missing as 0, then lowest rank. Every
    group moves to the latest one, so that no shift is negative.
    """
    first = spans.filter(F.col("name").contains(marker) & F.col("rank").isNotNull()).groupBy("rank").agg(F.min_by("end_ns", F.struct("ts_ns", "seq")).alias("at"))
    if check and first.isEmpty():
        raise ValueError(f"no rank has a span whose name contains {marker!r}")
    r = runs.select("rank", coordinate(F.col("path"), "dp").alias("dp"), F.coalesce(coordinate(F.col("path"), "tp"), F.lit(0)).alias("tp"))
    m = first.join(r, "rank")
    m = m.withColumn("grp", F.coalesce(F.concat(F.lit("dp"), F.col("dp").cast("string")), F.concat(F.lit("rank"), F.col("rank").cast("string"))))
    g = m.groupBy("grp").agg(F.min_by("at", F.struct("tp", "rank")).alias("ref"))
    g = g.crossJoin(F.broadcast(g.agg(F.max("ref").alias("latest"))))  # one row
    return m.join(g, "grp").select("rank", "dp", (F.col("latest") - F.col("ref")).alias("shift_ns"))


def _moved(df: DataFrame, shifts: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    s = F.coalesce("shift_ns", F.lit(0))
    return df.join(shifts.select("rank", "shift_ns"), "rank", "left").withColumns({c: F.col(c) + s for c in columns}).select(*df.columns)


def apply_shifts(bundle: Bundle, shifts: DataFrame) -> Bundle:
    """Spans and flows moved by the shift of their rank."""
    return replace(bundle, spans=_moved(bundle.spans, shifts, ("ts_ns", "end_ns")), flows=_moved(bundle.flows, shifts, ("ts_ns",)))


def shift_spans(spans: DataFrame, shifts: DataFrame) -> DataFrame:
    return _moved(spans, shifts, ("ts_ns", "end_ns"))


def shift_summary(shifts: DataFrame) -> DataFrame:
    """(grp, shift_ns, n_ranks); ranks without a dp are "solo"."""
    grp = F.coalesce(F.concat(F.lit("dp"), F.col("dp").cast("string")), F.lit("solo"))
    return shifts.groupBy(grp.alias("grp"), "shift_ns").agg(F.count("*").alias("n_ranks"))
