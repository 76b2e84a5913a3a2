"""Alignment of two sequences of (name, duration)."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanforge.operators.ordered import cut, running

#: How far ahead an equal name is looked for: up to this many places less one.
REACH = 200


class Side:
    """One sequence as it comes in: what has come and isn't consumed yet, and where each name is in it."""

    def __init__(self) -> None:
        self.lines: deque[tuple[str, int]] = deque()
        self.where: dict[str, deque[int]] = {}
        self.at = self.come = 0
        self.ended = False

    def push(self, name: str, dur: int) -> None:
        self.lines.append((name, dur))
        self.where.setdefault(name, deque()).append(self.come)
        self.come += 1

    def pop(self) -> tuple[str, int]:
        name, dur = self.lines.popleft()
        places = self.where[name]
        places.popleft()
        if not places:
            del self.where[name]
        self.at += 1
        return name, dur

    def ahead(self, name: str, reach: int) -> int | None:
        """How far off the name comes next, if that is less than ``reach``."""
        places = self.where.get(name)
        return places[0] - self.at if places and places[0] - self.at < reach else None

    def ready(self, reach: int) -> bool:
        return self.ended or len(self.lines) >= reach


class Aligner:
    """Greedy alignment of two sequences that come in together; of two skips the shorter, and at a draw the one in b.

    No more of a sequence is held than ``reach`` lines and what it is ahead of
    the other.
    """

    def __init__(self, reach: int = REACH) -> None:
        self.a, self.b, self.reach = Side(), Side(), reach
        self.rows: list[tuple[str, str, int | None, int | None]] = []

    def _added(self) -> None:
        name, dur = self.b.pop()
        self.rows.append(("added", name, None, dur))

    def _removed(self) -> None:
        name, dur = self.a.pop()
        self.rows.append(("removed", name, dur, None))

    def run(self) -> None:
        """Aligns as far as what has come allows."""
        a, b, reach = self.a, self.b, self.reach
        while a.lines and b.lines and a.ready(reach) and b.ready(reach):
            x, y = a.lines[0][0], b.lines[0][0]
            if x == y:
                (name, da), (_, db) = a.pop(), b.pop()
                self.rows.append(("same", name, da, db))
                continue
            skip_b, skip_a = b.ahead(x, reach), a.ahead(y, reach)
            if skip_a is None and skip_b is None:
                self._removed()
                self._added()
            elif skip_a is None or (skip_b is not None and skip_b <= skip_a):
                for _ in range(skip_b):
                    self._added()
            else:
                for _ in range(skip_a):
                    self._removed()
        while a.lines and b.ended and not b.lines:
            self._removed()
        while b.lines and a.ended and not a.lines:
            self._added()


def align(a: Sequence[str], b: Sequence[str], reach: int = REACH) -> Iterator[tuple[str, int | None, int | None]]:
    """(kind, index in a, index in b) of two lists of names."""
    aligner = Aligner(reach)
    for side, names in ((aligner.a, a), (aligner.b, b)):
        for i, name in enumerate(names):
            side.push(name, i)
        side.ended = True
    aligner.run()
    yield from ((kind, i, j) for kind, _, i, j in aligner.rows)


def sequence_diff(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, line, kind, name, dur_a, dur_b) of the sequences of each key in (ts_ns, seq) order.

    Sequential within a key, which is one selection or one step of a rank, and
    parallel over keys. Both sequences of a key are read as one stream, ordered
    by place, so that a task holds a few hundred lines and what one side is ahead
    of the other.
    """
    # aliases tell the sides apart where both come from one table
    cols = [F.col(c).alias(c) for c in (*key, "ts_ns", "seq", "name", "dur_ns")]
    types = dict(a.dtypes)
    both = a.select(*cols, F.lit(0).alias("side")).unionByName(b.select(*cols, F.lit(1).alias("side")))
    both, any_cut = cut(both, [*key, "side"], "ts_ns")
    both = running(both, [*key, "side"], F.lit(1).cast("long"), "sum", [F.col("ts_ns"), F.col("seq")], "place", "bucket" if any_cut else None)
    names = [*key, "line", "kind", "name", "dur_a", "dur_b"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, aligner, line = None, None, 0
        out: list[tuple] = []

        def emit() -> None:
            nonlocal line
            for row in aligner.rows:
                out.append((*now, line, *row))
                line += 1
            aligner.rows = []

        def end() -> None:
            aligner.a.ended = aligner.b.ended = True
            aligner.run()
            emit()

        def frame() -> pd.DataFrame:
            found = pd.DataFrame(out, columns=names).astype({"dur_a": "Int64", "dur_b": "Int64"})
            out.clear()
            return found

        for batch in batches:
            keys = zip(*(batch[c].astype(object).where(batch[c].notna(), None).tolist() for c in key), strict=True) if key else ((),) * len(batch)
            for k, side, place, name, dur in zip(keys, batch["side"].tolist(), batch["place"].tolist(), batch["name"].tolist(), batch["dur_ns"].tolist(), strict=True):
                if k != now or aligner is None:
                    if aligner is not None:
                        end()
                    now, aligner, line = k, Aligner(), 0
                mine, other = (aligner.b, aligner.a) if side else (aligner.a, aligner.b)
                mine.push(name, dur)
                # the other side has had its turn at each place before this one
                other.ended = other.come < place - 1
                if place % REACH == 0 or other.ended:
                    aligner.run()
                    emit()
            if len(out) > 10_000:
                yield frame()
        if aligner is not None:
            end()
        yield frame()

    schema = ", ".join([*(f"{k} {types[k]}" for k in key), "line long", "kind string", "name string", "dur_a long", "dur_b long"])
    dealt = both.select(*key, "side", "place", "name", "dur_ns")
    dealt = dealt.repartition(*key).sortWithinPartitions(*key, "place", "side") if key else dealt.coalesce(1).sortWithinPartitions("place", "side")
    return dealt.mapInPandas(run, schema)


def diff_totals(diff: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """Counts and sums of both sides, and the change in percent where a has any."""
    s = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    t = diff.groupBy(*key).agg(F.count("dur_a").alias("count_a"), F.count("dur_b").alias("count_b"), s("dur_a").alias("total_a"), s("dur_b").alias("total_b"))
    return t.withColumn("delta_pct", F.when(F.col("total_a") > 0, 100.0 * (F.col("total_b") - F.col("total_a")) / F.col("total_a")))


def diff_segments(diff: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, segment, kind, n, dur_a, dur_b, budget): each same line alone, each run of changes as one."""
    w = Window.partitionBy(*key).orderBy("line")
    starts = ((F.col("kind") == "same") | (F.lag("kind").over(w) == "same") | F.lag("kind").over(w).isNull()).cast("long")
    d = diff.withColumn("starts", starts).withColumn("segment", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    out = d.groupBy(*key, "segment").agg(F.when(F.max(F.col("kind") == "same"), "same").otherwise("changed").alias("kind"), F.count("*").alias("n"), s("dur_a").alias("dur_a"), s("dur_b").alias("dur_b"))
    return out.withColumn("budget", F.greatest("dur_a", "dur_b"))
