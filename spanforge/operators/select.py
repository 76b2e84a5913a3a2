"""Projection, filter and search over spans (C1-C10), downsampling (B11) and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions.text import duration_text
from spanforge.schema import overlaps, scope

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def is_exec_context(name: str = "name") -> Column:
    """Names of scheduler steps; a fresh load hides them."""
    c = F.col(name)
    return c.startswith("execute_") & c.contains("_context_") & c.contains("_generation_")


def select(
    spans: DataFrame,
    w: tuple[int, int] | None = None,
    tracks: list[str] | None = None,
    lanes: tuple[int, int] | None = None,
    gpu_only: bool = True,
    hidden: DataFrame | None = None,
    name: str | None = None,
    merged: bool = False,
) -> DataFrame:
    """Spans of a region.

    A span is in if it overlaps the closed window, lies on one of the tracks and
    in the closed range of lanes. On merged rows, a span fully inside the window
    is in whatever its lane. ``hidden`` is a table of names to leave out; it does
    not apply when one name is asked for.
    """
    out = spans.filter(overlaps(w))
    if gpu_only:
        out = out.filter("gpu")
    if tracks is not None:
        out = out.filter(F.col("track").isin(tracks))
    if lanes is not None:
        ok = F.col("lane").between(*lanes)
        if merged and w is not None:
            ok = ok | ((F.col("ts_ns") >= w[0]) & (F.col("end_ns") <= w[1]))
        out = out.filter(ok)
    if name is not None:
        return out.filter(F.col("name") == name)
    return out.join(hidden.select("name").distinct(), "name", "left_anti").select(*spans.columns) if hidden is not None else out


def matching_names(spans: DataFrame, query: str) -> DataFrame:
    """C4: distinct names with the trimmed query in them, A-Z ignoring case; an empty query matches none."""
    q = query.strip().translate(str.maketrans(UPPER, LOWER))
    names = spans.select("name").distinct()
    return names.filter(F.translate("name", UPPER, LOWER).contains(q)) if q else names.filter(F.lit(False))


def search(spans: DataFrame, query: str) -> DataFrame:
    """(span_id, name, ts_ns, seq, previous, following) of every match, neighbours by time.

    The names are matched once each; the rows follow by a semi-join. Neighbours
    are looked up within buckets of time, the bucket's edge rows by a table of
    buckets, so that a frequent name stays distributed.
    """
    hits = spans.join(matching_names(spans, query), "name", "left_semi").select("span_id", "name", "ts_ns", "seq")
    width = hits.agg(F.greatest(F.lit(1), F.floor((F.max("ts_ns") - F.min("ts_ns")) / F.greatest(F.lit(1), F.floor(F.count("*") / 10_000)))).alias("width"))
    h = hits.crossJoin(F.broadcast(width)).withColumn("bucket", F.floor(F.col("ts_ns") / F.col("width"))).drop("width")
    at = F.struct("ts_ns", "seq", "span_id")
    edge = h.groupBy("bucket").agg(F.min(at)["span_id"].alias("first"), F.max(at)["span_id"].alias("last"))
    line = Window.orderBy("bucket")  # one row for about 10,000 matches
    edge = edge.select("bucket", F.lag("last").over(line).alias("before"), F.lead("first").over(line).alias("after"))
    w = Window.partitionBy("bucket").orderBy("ts_ns", "seq")
    h = h.join(edge, "bucket")
    return h.select(
        "span_id", "name", "ts_ns", "seq", F.coalesce(F.lag("span_id").over(w), F.col("before")).alias("previous"), F.coalesce(F.lead("span_id").over(w), F.col("after")).alias("following")
    )


def match_count(stats: DataFrame, query: str) -> DataFrame:
    """How many spans match, from the per-name counts of ``kernel_stats``."""
    return stats.join(matching_names(stats, query), "name", "left_semi").agg(F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("matches"))


def scopes(spans: DataFrame) -> DataFrame:
    """The scopes that a selection crosses."""
    return spans.select(scope().alias("scope")).distinct()


def sequence(spans: DataFrame) -> DataFrame:
    """(name, dur_ns) in time order."""
    return spans.orderBy("ts_ns", "seq").select("seq", "name", "dur_ns")


def export_lines(spans: DataFrame) -> DataFrame:
    """A7: "name (duration)", with what orders it."""
    return spans.select("ts_ns", "seq", F.concat("name", F.lit(" ("), duration_text(F.col("dur_ns")), F.lit(")")).alias("line"))


def export_selection(spans: DataFrame, path: str) -> None:
    export_lines(spans).orderBy("ts_ns", "seq").select("line").write.mode("overwrite").text(path)


def downsample(spans: DataFrame, w: tuple[int, int], pixels: int, row: list[str], mode: str = "left") -> DataFrame:
    """Spans at least a pixel wide, and of narrower ones the first on each pixel of its row and lane.

    The pixel is that of the left edge, or of the middle with ``mode="centre"``.
    """
    t0, t1 = w
    s = spans.filter(overlaps(w))
    at = F.col("ts_ns") if mode == "left" else F.col("ts_ns") + F.floor(F.col("dur_ns") / 2)
    px = F.floor((at - F.lit(t0)) * F.lit(pixels) / F.lit(t1 - t0))
    wide = F.col("dur_ns") * F.lit(pixels) >= F.lit(t1 - t0)
    s = s.withColumn("px", px)
    first = s.filter(~wide).groupBy(*row, "px").agg(F.min(F.struct("ts_ns", "seq", *[c for c in s.columns if c not in {"ts_ns", "seq", "px", *row}])).alias("r"))
    first = first.select(*row, "px", "r.*")
    return s.filter(wide).unionByName(first.select(*s.columns))
