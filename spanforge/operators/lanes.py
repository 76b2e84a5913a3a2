"""Lanes: first-fit packing of overlapping spans, and merged rank rows.

At the start of an island every lane is free, so packing starts afresh there:
islands are packed independently and dealt over all tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.operators.intervals import islands
from spanforge.schema import TRACK
from spanforge.storage import materialize


class FirstFit:
    """Lanes of intervals that come in start order: each gets the lowest that is free; a lane is free from its end on."""

    def __init__(self) -> None:
        self.free: list[int] = []
        self.running: list[tuple[int, int]] = []
        self.lanes = 0

    def place(self, start: int, end: int) -> int:
        while self.running and self.running[0][0] <= start:
            heapq.heappush(self.free, heapq.heappop(self.running)[1])
        if self.free:
            lane = heapq.heappop(self.free)
        else:
            lane, self.lanes = self.lanes, self.lanes + 1
        heapq.heappush(self.running, (end, lane))
        return lane


def _by_island(spans: DataFrame, by: Sequence[str], ascending: bool = True) -> DataFrame:
    """Rows dealt by island and in time order or against it, with ``group``: one number for each island of the task."""
    order = [F.col(c).asc() if ascending else F.col(c).desc() for c in ("ts_ns", "seq")]
    s = spans.repartition(*by, "island").sortWithinPartitions(*by, "island", *order)
    return s.select(F.xxhash64(*by, "island").alias("group"), "span_id", "ts_ns", "end_ns", *[c for c in ("lane",) if c in spans.columns])


def _larger_islands(islanded: DataFrame, by: Sequence[str], condition: str) -> DataFrame:
    """Rows of the islands of which a condition on n, the number of rows, and deep, the deepest lane, holds."""
    deep = F.max("lane") if "lane" in islanded.columns else F.lit(0)
    keys = [*by, "island"]
    n = islanded.groupBy(*keys).agg(F.count("*").alias("n"), deep.alias("deep")).filter(condition)
    same = F.lit(True)
    for c in keys:
        same = same & F.col(f"s.{c}").eqNullSafe(F.col(f"n.{c}"))
    return islanded.alias("s").join(n.alias("n"), same, "left_semi")


def lanes(spans: DataFrame, by: Sequence[str] = TRACK, bucket_ns: int | None = None) -> DataFrame:
    """Adds ``lane``, by first fit in (ts_ns, seq) order within ``by``.

    Spans alone in their island, most of them in practice, are in lane 0 and skip
    the packing. A task reads its islands one after the other and keeps only the
    lanes that are in use.
    """
    s = islands(spans, by, bucket_ns)  # touching spans share an island, which only makes islands larger
    many = _larger_islands(s.select(*by, "island", "span_id", "ts_ns", "end_ns", "seq"), by, "n > 1")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fit, group = FirstFit(), None
        for b in batches:
            out = []
            for g, ts, end in zip(b["group"].tolist(), b["ts_ns"].tolist(), b["end_ns"].tolist(), strict=True):
                if g != group:
                    fit, group = FirstFit(), g
                out.append(fit.place(ts, end))
            yield pd.DataFrame({"span_id": b["span_id"], "lane": out})

    packed = _by_island(many, by).mapInPandas(pack, "span_id long, lane int")
    return spans.join(packed, "span_id", "left").select(*spans.columns, F.coalesce("lane", F.lit(0)).alias("lane"))


def wrappers(laned: DataFrame, bucket_ns: int | None = None) -> DataFrame:
    """(span_id) of grandparents: spans with a later one of their track that starts by their end, two lanes or more below.

    Islands are read from their end, and of what follows only the next start in
    each lane or below is kept. Islands less than three lanes deep have none and
    are left out.
    """
    s = islands(laned, TRACK, bucket_ns).select(*TRACK, "island", "span_id", "ts_ns", "end_ns", "seq", "lane")

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, following = None, []
        for b in batches:
            out = []
            for g, span_id, ts, end, lane in zip(*(b[c].tolist() for c in ("group", "span_id", "ts_ns", "end_ns", "lane")), strict=True):
                if g != group:
                    group, following = g, []
                if lane + 2 < len(following) and following[lane + 2] <= end:
                    out.append(span_id)
                following[: lane + 1] = [ts] * (lane + 1)
            yield pd.DataFrame({"span_id": pd.Series(out, dtype="int64")})

    return _by_island(_larger_islands(s, TRACK, "deep >= 2"), TRACK, ascending=False).mapInPandas(find, "span_id long")


def merged_rows(spans: DataFrame, hidden: DataFrame | None = None, bucket_ns: int | None = None) -> DataFrame:
    """The GPU spans of each rank on one row: without hidden names and grandparents, packed anew.

    Columns: row_rank, span_id, ts_ns, end_ns, dur_ns, seq, name, lane.
    """
    gpu = materialize(lanes(spans.filter("gpu"), bucket_ns=bucket_ns), "lanes")  # both the rows and what finds grandparents
    kept = gpu.join(wrappers(gpu, bucket_ns), "span_id", "left_anti")
    if hidden is not None:
        kept = kept.join(hidden.select("name").distinct(), "name", "left_anti")
    kept = kept.select(F.col("rank").alias("row_rank"), "span_id", "ts_ns", "end_ns", "dur_ns", "seq", "name")
    return lanes(kept, ["row_rank"], bucket_ns)


def parents(laned: DataFrame, bucket_ns: int | None = None) -> DataFrame:
    """(span_id, parent_id): the span in the lane above that encloses each, where there is one.

    Islands are read in time order, and of each lane only the last span is kept:
    spans of a lane don't overlap, so none before it can enclose.
    """
    s = islands(laned, TRACK, bucket_ns).select(*TRACK, "island", "span_id", "ts_ns", "end_ns", "seq", "lane")

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, last = None, {}
        for b in batches:
            ids, above = [], []
            for g, span_id, end, lane in zip(*(b[c].tolist() for c in ("group", "span_id", "end_ns", "lane")), strict=True):
                if g != group:
                    group, last = g, {}
                if lane - 1 in last and last[lane - 1][0] >= end:
                    ids.append(span_id)
                    above.append(last[lane - 1][1])
                last[lane] = end, span_id
            yield pd.DataFrame({"span_id": pd.Series(ids, dtype="int64"), "parent_id": pd.Series(above, dtype="int64")})

    return _by_island(_larger_islands(s, TRACK, "deep >= 1"), TRACK).mapInPandas(find, "span_id long, parent_id long")
