"""The span tables as views over the ``events`` table of the test data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.operators.tracks import classify_tracks


def spans_of_events(spark: SparkSession, sf_dir: str, exec_names: bool = False, few_ranks: bool = False, shorter: int = 1) -> DataFrame:
    """Spans: one for each event; ``exec_names`` names annotations as scheduler steps, ``few_ranks`` makes two large ranks, ``shorter`` divides durations."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    start = e.agg(F.min(us).alias("t0"))
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    cat = (
        F.when(kind == "click", "kernel")
        .when(kind == "view", "gpu_memcpy")
        .when(kind == "purchase", "gpu_user_annotation")
        .when(kind == "error", "cuda_runtime")
        .otherwise(F.when(k < 20, "python_function").otherwise("cpu_op"))
    )
    plain = F.concat(kind, F.lit("_"), (k % 5).cast("string"))
    name = plain
    if exec_names:
        step = F.format_string("execute_context_%d(%d)_generation_%d(%d)", k % 3, k, k % 5, k % 7)
        name = F.when(kind == "purchase", step).otherwise(plain)
    rank = (F.col("user_id") % 2 if few_ranks else F.col("user_id")).cast("int")
    s = e.crossJoin(F.broadcast(start)).select(  # one row
        F.lit("run").alias("run"),
        rank.alias("rank"),
        F.lit("0").alias("pid"),
        (F.when(kind.isin("click", "view", "purchase"), F.col("event_id") % 2).otherwise(2 + F.col("event_id") % 2)).cast("string").alias("tid"),
        F.col("event_id").alias("seq"),
        F.col("event_id").alias("span_id"),
        name.alias("name"),
        cat.alias("cat"),
        ((us - F.col("t0")) * 1000).alias("ts_ns"),
        (F.round(F.col("value") * 100).cast("long") * (12_000_000_000 // shorter)).alias("dur_ns"),
        F.to_json(F.struct((k % 10).alias("correlation"), k.alias("k"))).alias("args"),
        (k % 10).alias("correlation"),
    )
    s = s.withColumn("end_ns", F.col("ts_ns") + F.col("dur_ns"))
    s = s.withColumn("gpu", F.col("tid").isin("0", "1"))
    return s.withColumn("track", F.concat(F.lit("Rank "), F.col("rank").cast("string"), F.when(F.col("gpu"), " GPU ").otherwise(" Thread "), F.col("tid")))


def tracks_of(spans: DataFrame) -> DataFrame:
    return classify_tracks(spans)


def runs_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, rank, path): a file name for each rank."""
    u = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("int").alias("rank")).distinct()
    path = F.format_string("dp%d_pp0_tp%d_dcp0_ep%d_rank%d.json", F.col("rank") % 4, F.floor(F.col("rank") / 4).cast("int") % 4, F.col("rank"), F.col("rank"))
    return u.select(F.lit("run").alias("run"), "rank", path.alias("path"))
