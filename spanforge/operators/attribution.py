"""From kernels to source lines (H5-H8): a text index of a source tree, and joins to it by name."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.functions.text import kernel_base_name, kernel_family
from spanforge.operators.links import launch_frames, launch_links
from spanforge.storage import broadcast_small, materialize

# fixed values: directories never searched, languages by suffix, and words that open a C declaration
SKIPPED = (".git", "build", "node_modules", ".venv", "venv", "__pycache__", ".mypy_cache", ".pytest_cache", "target", "cmake-build-debug")
PY_SUFFIXES = ("py", "pyi")
C_SUFFIXES = ("c", "cc", "cpp", "cxx", "h", "hh", "hpp", "hxx", "inl", "cu", "cuh")
DECLARES = ("void", "static", "inline", "extern", "auto", "const", "template", "struct", "class", "__global__", "__device__", "__host__", "__forceinline__", "CUTLASS_DEVICE")
MOST_HITS = 16
FLAT_PREFIX = "kernel_cutlass_kernel_"


@dataclass(frozen=True)
class SourceIndex:
    """files: path, flat. lines: path, line, text. names: name, path, line, rank, kind ("def" or "call")."""

    files: DataFrame
    lines: DataFrame
    names: DataFrame


def index_sources(spark: SparkSession, root: str) -> SourceIndex:
    """The index of a source tree, read once."""
    text = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("full"), "value")
    base = root.rstrip("/").removeprefix("file:")
    path = F.substring(F.regexp_replace("full", r"^file:/*", "/"), len(base) + 2, 1 << 20)  # relative to the root
    return index_texts(text.select(path.alias("path"), "value"))


def index_texts(texts: DataFrame) -> SourceIndex:
    """The index of files (path, value): every identifier before a bracket becomes a row, so that lookups are joins.

    rank orders hits: Python definitions 0; in C files declarations before calls,
    and CUDA sources before others. Sources are read and searched once.
    """
    suffix = F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)
    t = texts.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, SKIPPED))))
    t = t.withColumn("py", suffix.isin(*PY_SUFFIXES)).filter(F.col("py") | suffix.isin(*C_SUFFIXES))
    inner = F.when(F.col("path").rlike("^deps/[^/]+/"), F.regexp_replace("path", "^deps/[^/]+/", "")).otherwise(F.col("path"))
    t = materialize(t.select("path", "py", "value", inner.alias("inner")), "sources")
    files = t.select("path", "py", F.replace(F.regexp_replace("inner", r"\.[^./]*$", ""), F.lit("/"), F.lit("")).alias("flat"))
    lines = t.select("path", "py", F.posexplode(F.split("value", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
    called = lines.withColumn("name", F.explode(F.regexp_extract_all("text", F.lit(r"(?<![0-9A-Za-z_])([A-Za-z_~][0-9A-Za-z_]*)\("), F.lit(1))))
    is_def = F.col("py") & F.regexp_like("text", F.concat(F.lit(r"(?<![0-9A-Za-z_])def "), F.col("name"), F.lit(r"\(")))
    declares = F.col("text").rlike(r"^\S") | F.col("text").rlike(r"^\s+(" + "|".join(DECLARES) + r")(?![0-9A-Za-z_])(?=.)")
    cuda = F.col("path").rlike(r"\.cuh?$")
    rank = F.when(F.col("py"), 0).otherwise(F.when(declares, 0).otherwise(2) + F.when(cuda, 0).otherwise(1))
    names = called.select("name", "path", "line", rank.alias("rank"), "py", F.when(is_def | ~F.col("py"), "def").otherwise("call").alias("kind")).distinct()
    return SourceIndex(files, lines, materialize(names, "source-names"))


def _distinct(df: DataFrame, column: str) -> DataFrame:
    """The values of a column once each, written: Spark would move what is matched on them to before they are counted, to every row."""
    return materialize(df.select(column).distinct(), f"distinct-{column}")


def _candidates(names: DataFrame) -> DataFrame:
    """(name, attempt, base): the base name, then up to two times without a last part of digits and d."""
    b = names.withColumn("b0", kernel_base_name(F.col("name"))).filter("b0 != ''")
    cut = lambda c: F.when(F.col(c).rlike(r"^.*_[0-9d]+$"), F.regexp_replace(c, r"_[0-9d]+$", ""))
    b = b.withColumn("b1", cut("b0")).withColumn("b2", cut("b1"))
    return b.select("name", F.posexplode(F.array("b0", "b1", "b2")).alias("attempt", "base")).filter("base is not null and base != ''")


def resolve_names(names: DataFrame, index: SourceIndex) -> DataFrame:
    """H5, H6: (name, n, path, line): up to 16 places of each name, the best first.

    Names of flattened modules are found by the longest flattened path that they
    begin with: every prefix of the name is joined to the paths.
    """
    n = _distinct(names, "name")
    flat = n.filter(F.col("name").startswith(FLAT_PREFIX))
    plain = n.filter(~F.col("name").startswith(FLAT_PREFIX))
    hit = _candidates(plain).join(index.names.filter("kind = 'def'").select(F.col("name").alias("base"), "path", "line", "rank", "py"), "base")
    first = hit.groupBy("name").agg(F.min("attempt").alias("attempt"))
    hit = hit.join(first, ["name", "attempt"]).select("name", F.struct((~F.col("py")).alias("c"), "rank", "path", "line").alias("at"))

    f = flat.withColumn("rest", F.regexp_replace(F.substring("name", len(FLAT_PREFIX) + 1, 1 << 20), "_object_at_.*$", "")).filter("rest != ''")
    f = f.withColumn("k", F.explode(F.expr("sequence(1, length(rest))"))).withColumn("flat", F.expr("substring(rest, 1, k)"))
    f = f.join(index.files.filter("flat != ''"), "flat")
    longest = f.groupBy("name").agg(F.max("k").alias("k"))
    f = f.join(longest, ["name", "k"]).select("name", "path", "py", F.expr("substring(rest, k + 1)").alias("symbol"))
    called = index.names.groupBy("path", F.col("name").alias("symbol")).agg(F.min("line").alias("at"))
    f = f.join(called, ["path", "symbol"], "left")
    said = f.filter("at is null").join(index.lines.select("path", "line", "text"), "path").filter(F.col("text").contains(F.col("symbol")))
    said = said.groupBy("name", "path").agg(F.min("line").alias("said"))
    f = f.join(said, ["name", "path"], "left")
    f = f.select("name", F.struct((~F.col("py")).alias("c"), F.lit(0).alias("rank"), "path", F.coalesce("at", "said", F.lit(1)).alias("line")).alias("at"))
    both = hit.unionByName(f).withColumn("n", F.row_number().over(Window.partitionBy("name").orderBy("at")))
    return both.filter(F.col("n") <= MOST_HITS).select("name", "n", "at.path", "at.line")


def resolve_callfrom(sites: DataFrame, files: DataFrame) -> DataFrame:
    """H7: (site, path, line) of "file:line" strings whose file is in the tree; absolute paths and ".." are refused."""
    s = _distinct(sites, "site")
    s = s.select("site", F.regexp_extract("site", r"^(.*):(\d+)$", 1).alias("path"), F.nullif(F.regexp_extract("site", r"^(.*):(\d+)$", 2), F.lit("")).try_cast("int").alias("line"))
    s = s.filter(F.col("line").isNotNull() & ~F.col("path").startswith("/") & ~F.arrays_overlap(F.split("path", "/"), F.array(F.lit(".."))))
    return s.join(files.select("path").distinct(), "path", "left_semi").select("site", "path", "line")


def attribute(spans: DataFrame, index: SourceIndex) -> DataFrame:
    """H8: (span_id, via, outcome, n_hits, path, line): where each span's source is.

    In turn: the recorded call site; the name; for device spans the name of the
    launching op; the Python frame around the launch. via tells which. outcome is
    "open" for one place, "list" for several (the best is given), "note" for
    kernels of captured graphs, of which only the replay is known, else "error".
    """
    site = F.get_json_object("args", "$.CallFrom")
    device = F.col("gpu") | (F.col("cat") == "kernel")
    s = materialize(spans.select("span_id", "name", site.alias("site"), device.alias("device"), "cat"), "attributed")
    by_site = broadcast_small(materialize(resolve_callfrom(s.filter("site is not null"), index.files).withColumnsRenamed({"path": "p1", "line": "l1"}), "sites"))
    ok = F.col("site").isNull() & (F.col("device") | (F.col("cat") == "cpu_op"))
    named = _distinct(s.filter(ok), "name").filter(~kernel_family(F.col("name")).isin("torch", "generic"))
    places = resolve_names(named, index)
    best = materialize(places.groupBy("name").agg(F.count("*").alias("hits"), F.min_by(F.struct("path", "line"), "n").alias("place")), "places")
    out = s.join(by_site, "site", "left")
    b = best.withColumnsRenamed({"name": "n2", "hits": "h2", "place": "p2"})
    out = out.join(broadcast_small(b), ok & (F.col("name") == F.col("n2")), "left")
    open_ = out.filter("device and site is null and p2 is null").select("span_id")
    link = materialize(launch_links(spans, open_), "launch-links")
    ops = _distinct(link.filter("op is not null").withColumnRenamed("op", "name"), "name").filter(kernel_family(F.col("name")) != "torch")
    o = resolve_names(ops, index).groupBy("name").agg(F.count("*").alias("h3"), F.min_by(F.struct("path", "line"), "n").alias("p3")).withColumnRenamed("name", "op")
    o = broadcast_small(materialize(o, "op-places"))
    frames = launch_frames(link.filter("at_id is not null"), spans, index.files).select("kernel_id", F.struct(F.col("file").alias("path"), "line").alias("p4"))
    link = link.join(o, "op", "left").join(frames, "kernel_id", "left").withColumnRenamed("kernel_id", "k")
    out = out.join(link, F.col("span_id") == F.col("k"), "left")
    replay = F.col("p3").isNull() & F.coalesce("graph", F.lit(False))
    via = (
        F.when(F.col("p1").isNotNull(), "call site").when(F.col("p2").isNotNull(), "name").when(F.col("p3").isNotNull(), "op").when(replay, "replay").when(F.col("p4").isNotNull(), "launch frame")
    )
    place = F.when(F.col("p1").isNotNull(), F.struct(F.col("p1").alias("path"), F.col("l1").alias("line"))).otherwise(F.coalesce("p2", "p3", F.when(~replay, F.col("p4"))))
    hits = F.when(via == "call site", 1).when(via == "name", F.col("h2")).when(via == "op", F.col("h3")).when(via == "launch frame", 1).otherwise(0)
    outcome = F.when(via == "replay", "note").when(hits == 1, "open").when(hits > 1, "list").otherwise("error")
    return out.select("span_id", via.alias("via"), outcome.alias("outcome"), hits.cast("int").alias("n_hits"), place["path"].alias("path"), place["line"].alias("line"))
