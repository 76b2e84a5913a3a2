"""Cutting JSON traces into events, many tasks to a file.

Spark's text reader cuts a file at every ``{``, and a large file into splits of
which each is read by a task of its own; gzip streams are inflated as they are
read, all their members, up to any damage. What a split begins with is not known
to it: it may be inside a string, an event, or the header. So large files are
read twice.

1. ``split_states``: each split tells how it changes the state. Quotes change
   whether one is inside a string, and brackets outside strings change the depth;
   as it isn't known yet which are outside, the change of depth is told for both
   cases. Sums over the splits before give each split's state: a row for each
   split is all that is moved.
2. ``cut``: each split, knowing its state, gives the objects that stand in the
   arrays of the document, and what else there is of it. An object that crosses
   the border of two splits comes in parts, which are put together by file.

Files of one split begin at the beginning, and are read once.

A file may hold many documents as a JSON text sequence (RFC 7464): each is preceded
by the byte 0x1E, which can't stand in JSON. So a document that is cut ends where the
next one begins, and many small traces need no file each. Documents are told by the
byte at which they begin, ``doc``; of a file with only one that is 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.storage import broadcast_small, materialize

#: Objects stand in an array of the document: this deep.
LEVEL = 2
#: Bytes inflated at once.
BUFFER = 4096
KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*\[$')
EVENTS = b"traceEvents"
#: Precedes each document of a sequence.
SEPARATOR = b"\x1e"
DOCUMENT, SPLIT = ("path", "doc"), ("path", "start")
#: Added to the depth of a split that ends inside a string.
QUOTED = 1_000_000
PARTS = "path string, doc long, start long, size long, seq long, kind string, key string, inside boolean, text binary, depth int"


def _signs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the quotes that aren't escaped, and of all brackets, and the brackets' change of depth."""
    quotes = np.flatnonzero(data == 34)
    after = quotes[(quotes > 0) & (data[quotes - 1] == 92)]
    escaped = []
    for q in after.tolist():
        n = 1
        while n < q and data[q - 1 - n] == 92:
            n += 1
        if n % 2:
            escaped.append(q)
    if escaped:
        quotes = np.setdiff1d(quotes, escaped, assume_unique=True)
    opens, closes = (data == 123) | (data == 91), (data == 125) | (data == 93)
    at = np.flatnonzero(opens | closes)
    return quotes, at, np.where(opens[at], 1, -1)


def _fragments(spark: SparkSession, paths: list[str], buffer: int = 1 << 16) -> DataFrame:
    """(path, start, size, value): what stands between two ``{``, in order within (path, start).

    Of a damaged gzip stream, what is inflated in the buffer with the damage is lost.
    """
    text = spark.read.option("lineSep", "{").option("ignoreCorruptFiles", "true").option("io.file.buffer.size", buffer).text(paths)
    path = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    return text.select(path.alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bool, bytes, dict]]:
    """(split, whether it begins here, bytes, first row) of rows that follow each other in one split; every ``{`` is put back but before the file's first byte."""
    last = None
    for b in batches:
        paths, starts = b.column("path"), np.asarray(b.column("start"), np.int64)
        if not len(starts):
            continue
        codes = np.asarray(paths.dictionary_encode().indices)
        cuts = [0, *(np.flatnonzero((codes[1:] != codes[:-1]) | (starts[1:] != starts[:-1])) + 1).tolist(), len(starts)]
        values = b.column("value")
        for i, j in zip(cuts, cuts[1:], strict=False):
            split = (paths[i].as_py(), int(starts[i]))
            row = {n: b.column(n)[i].as_py() for n in b.schema.names if n != "value"}
            data = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), values.slice(i, j - i)), b"{")[0].as_py()
            begins = split != last
            yield split, begins, data if begins and split[1] == 0 else b"{" + data, row
            last = split


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, start, bytes, doc, odd, outside, inside): how a split changes the state, if it begins outside or inside a string.

    doc is where in the split its last document begins, null if none does; the change is then that document's alone.
    """
    out: list[list] = []
    for split, begins, data, _ in _runs(batches):
        if begins:
            out.append([*split, 0, None, 0, 0, 0])
        s, last = out[-1], data.rfind(SEPARATOR) + 1
        if last:
            s[3:] = [s[2] + last, 0, 0, 0]
        quotes, at, step = _signs(np.frombuffer(data, np.uint8)[last:])
        even = (np.searchsorted(quotes, at) + s[4]) % 2 == 0
        s[2] += len(data)
        s[4] = (s[4] + len(quotes)) % 2
        s[5] += int(step[even].sum())
        s[6] += int(step[~even].sum())
    columns = list(zip(*out, strict=True)) or [[]] * 7
    types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["path", "start", "bytes", "doc", "odd", "outside", "inside"])


def split_states(fragments: DataFrame) -> DataFrame:
    """(path, start, at, doc, quoted, depth): where in the file each split begins, in which document, and in what state."""
    each = materialize(fragments.mapInArrow(_summaries, "path string, start long, bytes long, doc long, odd int, outside long, inside long"), "splits")
    splits = Window.partitionBy("path").orderBy("start")  # a row for each split of a file
    before, upto = splits.rowsBetween(Window.unboundedPreceding, -1), splits.rowsBetween(Window.unboundedPreceding, 0)
    begun = Window.partitionBy("path", "n").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    left = lambda c: F.coalesce(F.lag(c).over(splits), F.lit(0))
    each = each.withColumns({"at": F.coalesce(F.sum("bytes").over(before), F.lit(0)), "n": F.count("doc").over(upto)})
    each = each.withColumns({"latest": F.max(F.col("at") + F.col("doc")).over(upto), "odd": (F.sum("odd").over(begun) % 2).cast("int")})
    each = each.withColumn("quoted", left("odd"))
    turn = F.when(F.col("doc").isNotNull() | (F.col("quoted") == 0), F.col("outside")).otherwise(F.col("inside"))
    each = each.withColumn("turn", turn).withColumn("turn", F.sum("turn").over(begun).cast("int"))
    return each.select("path", "start", "at", left("latest").alias("doc"), "quoted", left("turn").alias("depth"))


class _Cutter:
    """One split: takes its bytes in order and gives rows of ``PARTS`` but for path, start and size."""

    def __init__(self, at: int, quoted: int, depth: int, doc: int):
        self.rows: list[tuple] = []
        self._begin(at, quoted, depth, doc)

    def _begin(self, at: int, quoted: int, depth: int, doc: int) -> None:
        self.at, self.quoted, self.depth, self.doc = at, quoted, depth, doc
        self.head = depth > LEVEL  # until the object that was open at the border is closed
        self.key: bytes | None = None
        self.known = depth < LEVEL
        self.open: list[bytes] = []
        self.open_at = at
        self.outer: list[bytes] = []
        self.outer_at = at
        self.inside = depth >= LEVEL
        self.blank = True

    def _outside(self, data: bytes, at: int) -> None:
        if not self.outer:
            self.outer_at = at
        self.outer.append(data)

    def _flush_outer(self) -> None:
        data, self.outer = b"".join(self.outer), []
        of_events = self.inside and (self.key == EVENTS if self.known else not data.strip(b" \t\r\n,"))
        if data and not of_events:
            self.rows.append((self.doc, self.outer_at, "outer", self.key if self.known else None, self.inside, data, None))

    def _flush_object(self, kind: str) -> None:
        data, self.open = b"".join(self.open), []
        self.rows.append((self.doc, self.open_at, kind, self.key if self.known else None, True, data, None))

    def take(self, data: bytes) -> None:
        *ended, last = data.split(SEPARATOR)
        for d in ended:
            self._take(d)
            self.close(False)
            self._begin(self.at + 1, 0, 0, self.at + 1)
        self._take(last)

    def _take(self, data: bytes) -> None:
        self.blank = self.blank and not data.strip()
        quotes, at, step = _signs(np.frombuffer(data, np.uint8))
        real = (np.searchsorted(quotes, at) + self.quoted) % 2 == 0
        at, depth = at[real], self.depth + np.cumsum(step[real])
        up = step[real] > 0
        # an object or array of the document's arrays begins or ends; an array of the document begins or ends
        here = np.flatnonzero((up & (depth <= LEVEL + 1)) | (~up & (depth <= LEVEL)))
        end = 0
        for i, d, opens in zip(at[here].tolist(), depth[here].tolist(), up[here].tolist(), strict=True):
            if opens and d == LEVEL + 1:
                self._outside(data[end:i], self.at + end) if i > end else None
                self._flush_outer()
                end, self.open, self.open_at = i, [], self.at + i
            elif not opens and d == LEVEL:
                self.open.append(data[end : i + 1])
                self._flush_object("head" if self.head else "object")
                self.head, end = False, i + 1
            else:  # an array or object of the document itself
                self._outside(data[end : i + 1], self.at + end)
                if opens and d == LEVEL:
                    m = KEY.search(b"".join(self.outer))
                    self._flush_outer()
                    self.key, self.known, self.inside = m[1] if m else b"", True, True
                elif not opens and d == LEVEL - 1:
                    closing, self.outer = self.outer[-1], self.outer[:-1]
                    self.outer.append(closing[:-1])
                    self._flush_outer()
                    self.inside, self.known, self.key = False, True, b""
                    self._outside(b"]" if data[i : i + 1] == b"]" else b"}", self.at + i)
                end = i + 1
        depth_now = int(depth[-1]) if len(depth) else self.depth
        if end < len(data):
            if depth_now > LEVEL:
                self.open.append(data[end:])
            else:
                self._outside(data[end:], self.at + end)
        self.quoted, self.depth = (self.quoted + len(quotes)) % 2, depth_now
        self.at += len(data)

    def close(self, last: bool = True) -> None:
        """The end of the document, or of its part in this split, and in what state that is; what is between documents, or before the first, is none."""
        if self.depth > LEVEL:
            self._flush_object("middle" if self.head else "tail")
        self._flush_outer()
        if not self.blank or (last and self.doc == 0):
            self.rows.append((self.doc, self.at, "end", self.key if self.known else None, False, None, self.depth + QUOTED * self.quoted))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    split, cutter, size = None, None, 0

    def batch() -> pa.RecordBatch:
        rows, cutter.rows = cutter.rows, []
        doc, at, kind, key, inside, text, depth = zip(*rows, strict=True)
        n = len(rows)
        return pa.RecordBatch.from_arrays(
            [pa.array([split[0]] * n, pa.string()), pa.array(doc, pa.int64()), pa.array([split[1]] * n, pa.int64()), pa.array([size] * n, pa.int64()), pa.array(at, pa.int64()), pa.array(kind, pa.string()),
             pa.array([k if k is None else k.decode("utf-8", "replace") for k in key], pa.string()), pa.array(inside, pa.bool_()), pa.array(text, pa.binary()), pa.array(depth, pa.int32())],
            names=[c.split()[0] for c in PARTS.split(", ")],
        )

    for now, begins, data, row in _runs(batches):
        if begins:
            if cutter is not None:
                cutter.close()
                if cutter.rows:
                    yield batch()
            split, size = now, row["size"]
            cutter = _Cutter(*(row.get(c) or 0 for c in ("at", "quoted", "depth", "doc")))
        cutter.take(data)
        if cutter.rows:
            yield batch()
    if cutter is not None:
        cutter.close()
        if cutter.rows:
            yield batch()


def _bytes(text: str) -> int:
    m = re.fullmatch(r"(\d+)([kmgt]?)b?", text.strip().lower())
    return int(m[1]) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[m[2]]


def parts(spark: SparkSession, files: DataFrame) -> DataFrame:
    """``PARTS`` of the files (path, length), written once: small ones are never cut by Spark, large ones into splits."""
    least = min(_bytes(spark.conf.get(f"spark.sql.files.{k}")) for k in ("openCostInBytes", "maxPartitionBytes"))
    large = (F.col("length") > least) & ~F.col("path").endswith(".gz")
    named = lambda t: [r["path"] for r in t.select("path").collect()]  # noqa: E731  as Spark's own list of files
    found = None
    if small := named(files.filter(~large)):
        found = _fragments(spark, small, BUFFER).mapInArrow(_cut, PARTS)
    if cut := named(files.filter(large)):
        states = materialize(split_states(_fragments(spark, cut)), "split-states")
        told = _fragments(spark, cut).join(broadcast_small(states), list(SPLIT), "left")
        missing = F.raise_error(F.lit("the files are cut otherwise than a moment ago: read them again")).cast("long")
        told = told.withColumn("at", F.coalesce("at", missing)).mapInArrow(_cut, PARTS)
        found = told if found is None else found.unionByName(told)
    return materialize(spark.createDataFrame([], PARTS) if found is None else found, "parts")


def objects(parts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(path, doc, seq, key, text) of the objects in the arrays of each document; (path, doc, text) of the rest; (path, doc, complete).

    seq is the byte of the file, after inflation, where the object begins.
    """
    ends = parts.filter("kind = 'end'")
    before = Window.partitionBy(*DOCUMENT).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*DOCUMENT, "start", F.last("key", ignorenulls=True).over(before).alias("carried")).filter("start > 0 and carried is not null")
    carried = materialize(carried, "split-keys")
    p = parts.filter("kind <> 'end'").join(broadcast_small(carried), [*DOCUMENT, "start"], "left")
    p = p.withColumn("key", F.when(F.col("inside"), F.coalesce("key", "carried"))).drop("carried")
    # objects that cross borders: a tail, what is in between, and a head
    crossing = p.filter("kind in ('tail', 'middle', 'head')")
    begun = F.last(F.when(F.col("kind") == "tail", F.col("seq")), ignorenulls=True).over(Window.partitionBy(*DOCUMENT).orderBy("start", "seq"))
    crossing = crossing.withColumn("begun", begun).groupBy(*DOCUMENT, "begun").agg(F.sort_array(F.collect_list(F.struct("start", "seq", "kind", "text"))).alias("l"), F.first("key", ignorenulls=True).alias("key"))
    crossing = crossing.filter(F.element_at("l", -1)["kind"] == "head").filter("begun is not null")
    whole = F.array_join(F.transform("l", lambda x: x["text"].cast("string")), "")
    found = p.filter("kind = 'object'").select(*DOCUMENT, "seq", "key", F.col("text").cast("string").alias("text"))
    found = found.unionByName(crossing.select(*DOCUMENT, F.col("begun").alias("seq"), "key", whole.alias("text")))
    other = ~F.col("key").eqNullSafe(F.lit(EVENTS.decode()))
    rest = p.filter("kind = 'outer'").filter(other).select(*DOCUMENT, "seq", F.lit(False).alias("object"), F.col("text").cast("string").alias("text"))
    rest = rest.unionByName(found.filter(other).select(*DOCUMENT, "seq", F.lit(True).alias("object"), "text"))
    rest = rest.groupBy(*DOCUMENT).agg(F.sort_array(F.collect_list(F.struct("seq", "object", "text"))).alias("l"))
    empty = F.struct(F.lit("").alias("text"), F.lit(False).alias("object"))
    # commas between objects at a border are left out by what reads them
    text = F.aggregate("l", empty, lambda a, x: F.struct(F.concat(a["text"], F.when(a["object"] & x["object"], ",").otherwise(""), x["text"]).alias("text"), x["object"].alias("object")))["text"]
    depth = ends.groupBy(*DOCUMENT).agg(F.max_by("depth", "start").alias("depth"))
    rest = rest.select(*DOCUMENT, text.alias("text")).join(depth, list(DOCUMENT))
    # of a document that is cut, what came before is closed
    inner = F.when(F.regexp_extract("text", r"([\[{])[^\[{\]}]*$", 1) == "[", "]}").otherwise("}}")
    closing = F.when(F.col("depth") > 1, inner).when(F.col("depth") == 1, "}").otherwise("")
    text = F.when(F.col("depth") > 0, F.concat(F.regexp_replace("text", r"[,\s]+$", ""), closing)).otherwise(F.col("text"))
    return found, rest.select(*DOCUMENT, text.alias("text")), depth.select(*DOCUMENT, (F.col("depth") <= 0).alias("complete"))
