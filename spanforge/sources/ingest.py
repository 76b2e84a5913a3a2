"""Reading traces (A1-A4, A6): Chrome and kineto JSON files to spans, tracks, flows and runs.

``sources.pieces`` cuts files into events, large ones by many tasks; Spark's JSON
functions parse each event with a fixed schema.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.functions.text import coordinate
from spanforge.operators.tracks import classify_tracks, label_tracks, with_tracks
from spanforge.schema import SPAN_COLUMNS, Bundle
from spanforge.sources import pieces
from spanforge.storage import broadcast_small, materialize

#: Times are decimals: a double of microseconds since 1970 has no whole nanoseconds.
EVENT = "ph string, pid string, tid string, name string, cat string, ts decimal(26,6), dur decimal(26,6), id string, args string"
HEADER = "deviceProperties array<struct<name: string>>, vllm_version string, distributedInfo struct<rank: int, world_size: int>"
#: Bytes of a file that discovery looks at, and files at once.
PROBED, PROBES = 1 << 20, 16


def file_name(path: str = "path"):
    return F.regexp_extract(path, r"([^/]*)$", 1)


def rank_key(path: str = "path"):
    """struct(prefix, rank) of a rank's file: "<prefix>-rank-<n>.", else an "ep<n>" part in group "ep-group", else null."""
    f = file_name(path)
    dashed = F.regexp_extract(f, r"^(.*?)-rank-(\d+)\.", 2)
    part = F.regexp_extract(f, r"(?:^|_)ep(\d+)(?:_|$)", 1)
    prefix = F.when(dashed != "", F.regexp_extract(f, r"^(.*?)-rank-(\d+)\.", 1)).when(part != "", "ep-group")
    rank = F.when(dashed != "", dashed).when(part != "", part).try_cast("int")
    return F.when(prefix.isNotNull() & rank.isNotNull(), F.struct(prefix.alias("prefix"), rank.alias("rank")))


def rank_groups(paths: DataFrame) -> DataFrame:
    """(source_dir, path, group, rank): files with a rank, grouped by directory argument and prefix; groups of one stand alone, with nulls."""
    p = paths.withColumn("k", rank_key())
    n = F.count("*").over(Window.partitionBy("source_dir", "k.prefix"))
    p = p.withColumn("many", F.col("k").isNotNull() & (n > 1))
    own = lambda c: F.when(F.col("many"), F.col(f"k.{c}"))
    return p.select("source_dir", "path", own("prefix").alias("group"), own("rank").alias("rank"))


def begins_with(spark: SparkSession, paths: list[str], word: bytes, size: int = PROBED) -> list[str]:
    """The files that have ``word`` in their first ``size`` bytes; no more of any is read, however large it is.

    Spark has no reader of a part of a file, so the driver asks the file system
    that Spark uses, for many files at once.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def probe(path: str) -> bool:
        p = jvm.org.apache.hadoop.fs.Path(path)
        stream = p.getFileSystem(conf).open(p)
        try:
            return word in bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, size)))
        finally:
            stream.close()

    with ThreadPoolExecutor(PROBES) as pool:
        return [p for p, ok in zip(paths, pool.map(probe, paths), strict=True) if ok]


def discover(spark: SparkSession, dirs: list[str], known: DataFrame | None = None) -> DataFrame:
    """A3: (source_dir, path, length) of the trace files below each directory.

    ``.json.gz`` files, ``.json`` files with "trace" in their name or
    "traceEvents" in their first MiB, and ``.txt`` files that begin as sequences of
    documents do (``discover_documents`` looks into these); files whose path is in
    ``known`` are left out, and not looked into.
    """
    out = None
    for d in dirs:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(d).select(F.lit(d).alias("source_dir"), "path", "length")
        files = files.filter(F.col("path").endswith(".json.gz") | F.col("path").endswith(".json") | F.col("path").endswith(".txt"))
        out = files if out is None else out.unionByName(files)
    out = materialize(out if known is None else out.join(known.select("path").distinct(), "path", "left_anti").select("source_dir", "path", "length"), "found")
    text = F.col("path").endswith(".txt")
    named = ~text & (F.col("path").endswith(".json.gz") | file_name().contains("trace"))
    listed = lambda which: [r["path"] for r in out.filter(which).select("path").distinct().collect()]
    paths = begins_with(spark, listed(~named & ~text), b"traceEvents") + begins_with(spark, listed(text), pieces.SEPARATOR, 1)
    found = spark.createDataFrame([(p,) for p in paths], "path string")
    return out.filter(named).unionByName(out.filter(~named).join(broadcast_small(found), "path", "left_semi").select("source_dir", "path", "length"))


def discover_documents(spark: SparkSession, dirs: list[str], known: DataFrame | None = None) -> DataFrame:
    """A3: (path, doc, rank, n_events) of the documents with events in the files that ``discover`` finds; a sequence is read whole, as only that tells what is in it."""
    docs, _ = read_documents(spark, discover(spark, dirs, known).select("path", "length").distinct())
    return docs.filter("n_events > 0").select("path", "doc", told_rank().alias("rank"), "n_events")


def trace_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, length) of all files of the paths; contents aren't read."""
    return spark.read.format("binaryFile").load(paths).select("path", "length")


def read_documents(spark: SparkSession, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Headers and events of the files (path, length).

    documents: (path, doc, length, deviceProperties, vllm_version, distributedInfo,
    n_events, complete), a row for each document; length is the file's. events:
    (path, doc, seq, and the fields of an event), seq being where in the file it
    begins. Every document is read up to its damage, if it has any: complete tells
    whether it is closed. Files
    are cut into events by many tasks (``sources.pieces``), and these parsed and
    written to the shared folder once, so that what uses the result parses nothing again.
    """
    files = materialize(files, "files")
    p = pieces.parts(spark, files)
    found, rest, complete = pieces.objects(p)
    events = found.filter(F.col("key") == "traceEvents").select("path", "doc", "seq", F.from_json("text", EVENT).alias("e")).select("path", "doc", "seq", "e.*")
    events = materialize(events, "events")
    heads = rest.select("path", "doc", F.from_json("text", HEADER).alias("h")).select("path", "doc", "h.*")
    n = events.groupBy("path", "doc").agg(F.count("*").alias("n_events"))
    plain = lambda t: t.withColumn("p", F.regexp_replace("path", "^file:/*", "/"))
    docs = plain(files).join(plain(complete).drop("path"), "p", "left").withColumn("doc", F.coalesce("doc", F.lit(0).cast("long")))
    for t in (heads, n):
        docs = docs.join(plain(t).drop("path"), ["p", "doc"], "left")
    docs = docs.withColumns({"n_events": F.coalesce("n_events", F.lit(0).cast("long")), "complete": F.coalesce("complete", F.lit(False))}).drop("p")
    return materialize(docs, "documents"), events


def bad_files(docs: DataFrame) -> DataFrame:
    """A2: (path, doc, rank, length, n_events, problem) of the documents that are damaged, or have no events: what was read of them is kept."""
    problem = F.when(~F.col("complete"), "damaged").when(F.col("n_events") == 0, "no events")
    return docs.withColumn("problem", problem).filter("problem is not null").select("path", "doc", told_rank().alias("rank"), "length", "n_events", "problem")


def told_rank() -> Column:
    """The rank of a document: what it tells, else what the name of its file does."""
    return F.coalesce(F.col("distributedInfo.rank"), rank_key()["rank"])


def run_name(run: str, rank: Column) -> Column:
    """A document without a rank is a trace of its own, named by its file and, in a sequence, where it begins."""
    at = F.when(F.col("doc") > 0, F.concat(F.lit("@"), F.col("doc").cast("string"))).otherwise("")
    return F.when(rank.isNull(), F.concat(F.lit(f"{run}:"), file_name(), at)).otherwise(F.lit(run))


def headers(docs: DataFrame, run: str) -> DataFrame:
    """A4: (run, rank, path, device, version, dist_rank, dist_world, dp, tp, pp, ep, dcp)."""
    rank = told_rank()
    h = docs.select(
        run_name(run, rank).alias("run"),
        rank.alias("rank"),
        "path",
        F.get("deviceProperties", F.lit(0))["name"].alias("device"),
        F.col("vllm_version").alias("version"),
        F.col("distributedInfo.rank").alias("dist_rank"),
        F.col("distributedInfo.world_size").alias("dist_world"),
    )
    return h.withColumns({n: coordinate(F.col("path"), n) for n in ("dp", "tp", "pp", "ep", "dcp")})


def placed(events: DataFrame, docs: DataFrame, run: str) -> DataFrame:
    """Every event with the run, rank and file of its document."""
    rank = told_rank()
    d = docs.select(F.regexp_replace("path", "^file:/*", "/").alias("p"), "doc", run_name(run, rank).alias("run"), rank.alias("rank"), F.xxhash64("path").alias("file"))
    e = events.withColumn("p", F.regexp_replace("path", "^file:/*", "/"))
    return e.join(broadcast_small(d), ["p", "doc"]).drop("p", "doc", "path")


def _ns(c: str):
    return F.round(F.col(c) * 1000).cast("long")


def assemble(events: DataFrame, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Spans, tracks and flows of events: complete events with a duration, thread names, flow ends. Spans and flows keep the columns of ``carry``."""
    x = events.filter((F.col("ph") == "X") & F.col("dur").isNotNull() & F.col("ts").isNotNull())
    spans = x.select(
        "run", "rank", "pid", "tid", "seq", F.xxhash64("file", "run", "rank", "seq").alias("span_id"), F.coalesce("name", F.lit("")).alias("name"), F.coalesce("cat", F.lit("")).alias("cat"),
        _ns("ts").alias("ts_ns"), _ns("dur").alias("dur_ns"), (_ns("ts") + _ns("dur")).alias("end_ns"), "args", *carry,
    )
    names = events.filter((F.col("ph") == "M") & (F.col("name") == "thread_name"))
    names = names.select("run", "rank", "pid", "tid", "seq", F.get_json_object("args", "$.name").alias("label")).filter("label is not null")
    tracks = label_tracks(classify_tracks(spans), names)
    spans = with_tracks(spans, tracks, "track", "gpu").select(*SPAN_COLUMNS, *carry)
    flows = events.filter(F.col("ph").isin("s", "f")).select("run", "rank", F.col("id").try_cast("long").alias("flow_id"), "pid", "tid", _ns("ts").alias("ts_ns"), (F.col("ph") == "s").alias("is_start"), *carry)
    return spans, tracks, flows


def assembled(docs: DataFrame, events: DataFrame, run: str, carry: tuple[str, ...] = ()) -> Bundle:
    """The tables of what ``read_documents`` gives."""
    spans, tracks, flows = assemble(placed(events, docs, run), carry)
    start = spans.groupBy("run", "rank").agg(F.min("ts_ns").alias("min_ts_ns"))
    h = headers(docs, run).alias("h")
    runs = h.join(start.alias("s"), (F.col("h.run") == F.col("s.run")) & F.col("h.rank").eqNullSafe(F.col("s.rank")), "left").select("h.*", "s.min_ts_ns")
    return Bundle(spans, tracks, flows, runs, bad_files(docs))


def read_traces(spark: SparkSession, paths: list[str], run: str) -> Bundle:
    """A1: all files with a rank as one run, each other file as a run of its own, times as recorded; ``operators.tracks`` normalises and merges.

    Damaged files, and documents of a sequence, give the events before the damage,
    and are listed in ``bad_files`` of the result. A file that is a rank's second one keeps its
    spans apart by their identifiers.
    """
    return assembled(*read_documents(spark, trace_files(spark, paths)), run)
