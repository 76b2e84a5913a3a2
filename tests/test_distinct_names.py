"""Text is matched on distinct names, not on the rows that have them."""

from pyspark.sql import functions as F

from spanforge.operators import attribution, links
from spanforge.storage import materialize


def test_attribution_matches_each_name_once(spark, monkeypatch):
    plans = {}

    def written(df, name, codec="zstd"):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return materialize(df, name, codec)

    monkeypatch.setattr(attribution, "materialize", written)
    monkeypatch.setattr(links, "materialize", written)
    i = F.col("id")
    gpu = i % 2 == 0
    args = F.when(i % 7 == 0, '{"CallFrom": "pkg/ops.py:2"}').otherwise(F.format_string('{"correlation": %d, "External id": %d}', F.floor(i / 2), F.floor(i / 2)))
    spans = spark.range(400).select(
        F.lit("r").alias("run"), F.lit(0).alias("rank"), F.lit("0").alias("pid"), F.when(gpu, "1").otherwise("2").alias("tid"), gpu.cast("int").alias("track_idx"), gpu.alias("gpu"), i.alias("seq"), i.alias("span_id"),
        F.when(gpu, F.concat(F.lit("op"), (i % 5).cast("string"))).otherwise("pkg/ops.py(1): op1").alias("name"), F.when(gpu, "kernel").when(i % 4 == 1, "python_function").otherwise("cuda_runtime").alias("cat"),
        (1000 - i).alias("ts_ns"), F.lit(5).cast("long").alias("dur_ns"), (1005 - i).alias("end_ns"), args.alias("args"),
    )
    index = attribution.index_texts(spark.createDataFrame([("pkg/ops.py", "def op1(a):\ndef op2(a):")], "path string, value string"))
    got = {r.span_id: (r.via, r.line) for r in attribution.attribute(spans, index).collect()}
    assert got[6] == ("name", 1) and got[2] == ("name", 2) and got[14] == ("call site", 2) and len(got) == 400
    assert {"places", "op-places", "sites", "source-names"} <= plans.keys()
    for name in ("places", "op-places", "sites", "source-names"):
        assert "Range (" not in plans[name], name
    assert "regexp" not in plans["distinct-name"] and "regexp" not in plans["frame-names"]
