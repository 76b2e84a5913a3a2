"""A live view of a growing directory of traces (L1-L3)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanforge.operators.gaps import all_gaps
from spanforge.operators.sums import wide_sum
from spanforge.schema import SPAN_COLUMNS, SPANS, scope
from spanforge.sources.ingest import assembled, read_documents
from spanforge.sources.store import read_store, write_store
from spanforge.storage import broadcast_small, materialize

INTERVAL = "2 seconds"
FILES = "path string, modificationTime timestamp, length long"


def watch_traces(spark: SparkSession, directory: str, store: str, checkpoint: str, run: str = "live", once: bool = False, on_batch=None, glob: str = "*.json*") -> StreamingQuery:
    """L1: the files of the directory that are new or rewritten since the last trigger, parsed and added to the store.

    A stream of ticks, as a stream of files never reads a path again. With each
    tick the directory is listed, and files whose path, time of change and length
    aren't in the store's table of files are read. ``on_batch(n)`` runs after each
    batch that had any. A batch that is repeated after a failure is written again
    to the same folders, so that files count once: each table has one folder for
    each batch. Of a file that was rewritten, ``read_spans`` gives the last version.
    """
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()

    def append(_: DataFrame, n: int) -> None:
        listed = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(directory).select(*[c.split()[0] for c in FILES.split(", ")])
        if (seen := _files(spark, store)) is not None:
            known = seen.filter(F.col("batch") != n).select("path", "modificationTime", "length")
            listed = listed.join(known, ["path", "modificationTime", "length"], "left_anti")
        listed = materialize(listed, "listed")
        if listed.isEmpty():
            return
        b = assembled(*read_documents(spark, listed.select("path", "length")), run, ("file",))
        write_store(replace(b, runs=b.runs.withColumn("min_ts_ns", F.lit(None).cast("long"))), store, mode="overwrite", batch=n)
        listed.write.mode("overwrite").parquet(f"{store}/files/batch={n}")
        if on_batch:
            on_batch(n)

    w = ticks.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=INTERVAL)).start()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _files(spark: SparkSession, store: str) -> DataFrame | None:
    """The versions of files that a watched store has read: ``FILES`` and batch; None where it has no such table."""
    return spark.read.schema(f"{FILES}, batch int").parquet(f"{store}/files") if _exists(spark, f"{store}/files") else None


def _versions(spark: SparkSession, store: str) -> tuple[DataFrame, DataFrame] | None:
    """All spans of a watched store with batch and file, and (file, batch) of the last version of each file."""
    if (files := _files(spark, store)) is None:
        return None
    last = files.groupBy(F.xxhash64("path").alias("file")).agg(F.max("batch").alias("batch"))
    return spark.read.schema(f"{SPANS}, batch int, file long").parquet(f"{store}/spans"), last


def read_spans(spark: SparkSession, store: str) -> DataFrame:
    """The spans of a watched store: of each file its last version, or of all batches where the store has no table of files."""
    if (found := _versions(spark, store)) is None:
        return read_store(spark, store).spans
    spans, last = found
    return spans.join(broadcast_small(last), ["file", "batch"], "left_semi").select(*SPAN_COLUMNS)


def stream_spans(spark: SparkSession, path: str) -> DataFrame:
    """A stream of spans from Parquet files as they appear."""
    return spark.readStream.schema(SPANS).option("recursiveFileLookup", "true").parquet(path)


def live_stats(stream: DataFrame) -> DataFrame:
    """L2: running per-name count, total, max and min of all that was ever read; an exact median, and rewritten files, take the store.

    total_ns is a decimal: the type of a stream is fixed before its sums are known.
    """
    return stream.groupBy("name").agg(
        F.count("*").alias("count"),
        wide_sum("dur_ns").alias("total_ns"),
        F.greatest(F.max("dur_ns"), F.lit(0)).alias("max_ns"),
        F.min("dur_ns").alias("min_ns"),
        F.percentile_approx("dur_ns", 0.5).alias("median_approx_ns"),
    )


def live_gaps(spark: SparkSession, store: str, out: str):
    """L3: a function for ``on_batch``: all gaps of the ranks that the batch touched, from the whole store, written by batch.

    A rank that a rewritten file had before, and has no more, is touched as well.
    """

    def refresh(n: int) -> None:
        if (found := _versions(spark, store)) is None:
            touched = read_store(spark, store, batch=n).spans
        else:
            files = found[1].filter(F.col("batch") == n).select("file")
            touched = found[0].join(broadcast_small(files), "file", "left_semi")
        touched = materialize(touched.select(scope().alias("scope")).distinct(), "touched")
        spans = read_spans(spark, store).withColumn("scope", scope()).join(broadcast_small(touched), "scope", "left_semi").drop("scope")
        all_gaps(spans).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return refresh
