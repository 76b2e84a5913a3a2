import gzip
import json
import zlib

from spanforge.operators.attribution import attribute, index_sources, resolve_callfrom, resolve_names
from spanforge.operators.gaps import all_gaps
from spanforge.operators.stats import kernel_stats
from spanforge.operators.tracks import with_tracks
from spanforge.schema import FLOWS, RUNS, SPANS, TRACKS, Bundle
from spanforge.sources import pieces
from spanforge.sources.ingest import begins_with, discover, rank_groups, read_documents, read_traces, trace_files
from spanforge.sources.store import read_store, write_store
from spanforge.streaming import live

EVENTS = [
    {"ph": "X", "pid": 0, "tid": 2, "name": "matmul", "cat": "kernel", "ts": 1700000000000000.25, "dur": 10.5, "args": {"op": "mm"}},
    {"ph": "X", "pid": "host", "tid": "w", "name": "run", "cat": "cpu_op", "ts": 1700000000000001, "dur": 3},
    {"ph": "X", "pid": 0, "tid": 2, "name": "open", "cat": "kernel", "ts": 1700000000000009},
    {"ph": "M", "pid": "host", "tid": "w", "name": "thread_name", "args": {"name": "Worker 1"}},
    {"ph": "s", "pid": "host", "tid": "w", "id": 5, "ts": 1700000000000001},
    {"ph": "f", "pid": 0, "tid": 2, "id": 5, "ts": 1700000000000002},
    {"ph": "i", "pid": 0, "tid": 2, "name": "instant", "ts": 1700000000000003},
]
DOC = {"traceEvents": EVENTS, "deviceProperties": [{"name": "Device X"}], "vllm_version": "1.2.0", "distributedInfo": {"rank": 3, "world_size": 8}}


def write_ranks(d):
    for r in range(4):
        text = json.dumps(DOC | {"distributedInfo": {"rank": r, "world_size": 4}})
        if r % 2:
            (d / f"run-rank-{r}.trace.json.gz").write_bytes(gzip.compress(text.encode()))
        else:
            (d / f"run-rank-{r}.json").write_text(text)
    (d / "manifest.json").write_text('{"files": 4}')


def test_one_document(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps(DOC).replace("1700000000000000.2,", "1700000000000000.250,"))
    b = read_traces(spark, [str(tmp_path / "t.json")], "r")
    got = {r.name: r for r in b.spans.collect()}
    assert set(got) == {"matmul", "run"}
    assert (got["matmul"].ts_ns, got["matmul"].dur_ns, json.loads(got["matmul"].args), got["matmul"].gpu) == (1700000000000000250, 10500, {"op": "mm"}, True)
    assert {(r.track, r.gpu) for r in b.tracks.collect()} == {("GPU 2", True), ("Worker 1", False)}
    assert b.flows.count() == 2 and {r.flow_id for r in b.flows.collect()} == {5}
    h = b.runs.first()
    assert (h.device, h.version, h.dist_rank, h.dist_world, h["rank"]) == ("Device X", "1.2.0", 3, 8, 3)


def test_directory_store_and_damage(spark, tmp_path):
    d = tmp_path / "in" / "deep"
    d.mkdir(parents=True)
    write_ranks(d)
    found = discover(spark, [str(tmp_path / "in")])
    paths = sorted(r.path for r in found.collect())
    assert len(paths) == 4
    known = found.filter(found.path.contains("rank-0")).select("path")
    assert discover(spark, [str(tmp_path / "in")], known).count() == 3
    assert {(r.group, r["rank"]) for r in rank_groups(found).collect()} == {("run", r) for r in range(4)}
    (d / "run-rank-1.trace.json.gz").write_bytes(b"\x1f\x8b damaged from the start")
    b = read_traces(spark, paths, "r")
    assert b.spans.count() == 6 and [r.path.split("/")[-1] for r in b.bad_files.collect()] == ["run-rank-1.trace.json.gz"]
    write_store(b, str(tmp_path / "store"))
    s = read_store(spark, str(tmp_path / "store"), ["r"])
    assert s.spans.count() == 6 and {r["rank"] for r in s.runs.collect()} >= {0, 2, 3}
    assert read_store(spark, str(tmp_path / "store"), ["other"]).spans.count() == 0


def test_rank_keys(spark):
    paths = [("d", f"/a/trace-rank-{i}.json") for i in range(3)] + [("d", "/a/plain.json"), ("e", "/b/x_ep0_y.json"), ("e", "/b/x_ep1_y.json"), ("f", "/c/x_ep2_y.json")]
    got = {r.path: (r.group, r["rank"]) for r in rank_groups(spark.createDataFrame(paths, "source_dir string, path string")).collect()}
    assert got["/a/trace-rank-2.json"] == ("trace", 2) and got["/a/plain.json"] == (None, None)
    assert got["/b/x_ep1_y.json"] == ("ep-group", 1) and got["/c/x_ep2_y.json"] == (None, None)


def tree(d):
    for path, text in {
        "pkg/ops.py": "import x\n\ndef fused_op(a):\n    return fused_op_helper(a)\n",
        "csrc/launch.hpp": "  x = my_kernel(config);\n",
        "csrc/body.cuh": "template <int N>\nvoid my_kernel(const int* a) {}\n",
        "csrc/decoy.cpp": "not_my_kernel(1);\n",
        "build/gen.py": "def fused_op(a): pass\n",
        "pkg/gemm/dense.py": "class Dense:\n    pass\n",
    }.items():
        (d / path).parent.mkdir(parents=True, exist_ok=True)
        (d / path).write_text(text)


def test_source_index(spark, tmp_path):
    tree(tmp_path)
    i = index_sources(spark, str(tmp_path))
    names = spark.createDataFrame([("void ns::my_kernel<float>(int)",), ("fused_op_0d1d2",), ("absent",), ("kernel_cutlass_kernel_pkggemmdenseDense_object_at_1",)], "name string")
    got = {}
    for r in resolve_names(names, i).orderBy("name", "n").collect():
        got.setdefault(r.name, []).append((r.path, r.line))
    assert got["void ns::my_kernel<float>(int)"] == [("csrc/body.cuh", 2), ("csrc/launch.hpp", 1)]
    assert got["fused_op_0d1d2"] == [("pkg/ops.py", 3)]
    assert got["kernel_cutlass_kernel_pkggemmdenseDense_object_at_1"] == [("pkg/gemm/dense.py", 1)] and "absent" not in got
    sites = spark.createDataFrame([("pkg/ops.py:4",), ("/pkg/ops.py:4",), ("pkg/../pkg/ops.py:4",), ("none.py:1",)], "site string")
    assert [tuple(r) for r in resolve_callfrom(sites, i.files).collect()] == [("pkg/ops.py:4", "pkg/ops.py", 4)]


def test_attribution(spark, tmp_path):
    from tests.test_operators import table

    from spanforge.operators.tracks import classify_tracks

    tree(tmp_path)
    rows = [
        (0, "1", True, [(100, 5, "my_kernel", "kernel"), (110, 5, "Kernel", "kernel", '{"correlation": 1}'), (120, 5, "aten::x", "kernel", '{"External id": 9}'), (130, 5, "Kernel", "kernel", '{"correlation": 2}'), (140, 5, "nothing", "kernel"), (150, 5, "y", "kernel", '{"CallFrom": "pkg/ops.py:4"}')]),
        (0, "8", False, [(10, 1, "launch", "cuda_runtime", '{"correlation": 1}'), (0, 20, "pkg/ops.py(3): fused_op", "python_function"), (30, 1, "fused_op", "cpu_op", '{"External id": 9}'), (40, 1, "cudaGraphLaunch", "cuda_runtime", '{"correlation": 2}')]),
    ]
    s = table(spark, rows)
    s = with_tracks(s, classify_tracks(s), "track_idx")
    got = {r.span_id: (r.via, r.outcome, r.path, r.line) for r in attribute(s, index_sources(spark, str(tmp_path))).collect()}
    assert got[0] == ("name", "list", "csrc/body.cuh", 2)
    assert got[1] == ("launch frame", "open", "pkg/ops.py", 3)
    assert got[2] == ("op", "open", "pkg/ops.py", 3)
    assert got[3][:2] == ("replay", "note") and got[4][:2] == (None, "error")
    assert got[5] == ("call site", "open", "pkg/ops.py", 4)
    assert got[8] == ("name", "open", "pkg/ops.py", 3) and got[6][1] == "error"


def test_watching(spark, tmp_path):
    src, store, out = tmp_path / "src", str(tmp_path / "store"), str(tmp_path / "gaps")
    src.mkdir()
    write_ranks(src)
    (src / "manifest.json").unlink()
    q = live.watch_traces(spark, str(src), store, str(tmp_path / "ck"), once=True, on_batch=live.live_gaps(spark, store, out))
    q.awaitTermination()
    spans = live.read_spans(spark, store)
    assert spans.count() == 8 and spark.read.parquet(out).count() == 0
    s = live.live_stats(live.stream_spans(spark, f"{store}/spans"))
    q = s.writeStream.format("memory").queryName("live_stats").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.name: (r["count"], r.total_ns, r.max_ns, r.min_ns) for r in spark.table("live_stats").collect()}
    assert got == {r.name: (r["count"], r.total_ns, r.max_ns, r.min_ns) for r in kernel_stats(spans).collect()}


def test_rewritten_files_replace_their_spans(spark, tmp_path):
    src, store, out, check = tmp_path / "src", str(tmp_path / "store"), str(tmp_path / "gaps"), str(tmp_path / "ck")
    src.mkdir()

    def write(name, rank, starts):
        events = [dict(EVENTS[0], ts=1000 + t, dur=1, name=f"{name}{t}") for t in starts]
        (src / name).write_text(json.dumps({"traceEvents": events, "distributedInfo": {"rank": rank, "world_size": 4}}))

    def run():
        live.watch_traces(spark, str(src), store, check, once=True, on_batch=live.live_gaps(spark, store, out)).awaitTermination()
        return {(r["rank"], r.name) for r in live.read_spans(spark, store).collect()}

    write("a.json", 0, [0, 10])
    write("b.json", 1, [0, 30])
    first = run()
    assert first == {(0, "a.json0"), (0, "a.json10"), (1, "b.json0"), (1, "b.json30")}
    assert run() == first
    n = spark.read.parquet(f"{store}/files").select("batch").distinct().count()
    assert n == 1  # nothing new, nothing written
    write("a.json", 0, [0, 10, 50])
    write("c.json", 0, [90])
    assert run() == {(0, "a.json0"), (0, "a.json10"), (0, "a.json50"), (0, "c.json90"), (1, "b.json0"), (1, "b.json30")}
    batch = spark.read.parquet(f"{store}/files").agg({"batch": "max"}).first()[0]
    gaps_ = spark.read.parquet(f"{out}/batch={batch}").collect()
    assert sorted((r.scope, r.gap_ns) for r in gaps_) == [(0, 9000), (0, 39000), (0, 39000)]
    write("a.json", 2, [7])  # another rank: what it had before goes
    assert run() == {(2, "a.json7"), (0, "c.json90"), (1, "b.json0"), (1, "b.json30")}


def test_live_gaps_has_all_gaps(spark, tmp_path):
    store, out = str(tmp_path / "store"), str(tmp_path / "gaps")
    rows = [("r", rank, "0", "1", "t", True, i, 1000 * rank + i, f"k{i}", "kernel", i * step, 1000, i * step + 1000, None) for rank, step in ((0, 9_000), (1, 3_000)) for i in range(601)]
    spans = spark.createDataFrame(rows, SPANS)
    _, tracks, flows = (spark.createDataFrame([], x) for x in (SPANS, TRACKS, FLOWS))
    write_store(Bundle(spans, tracks, flows, spark.createDataFrame([], RUNS)), store, batch=0)
    live.live_gaps(spark, store, out)(0)
    got = spark.read.parquet(f"{out}/batch=0")
    assert {(r.scope, r["count"]) for r in got.groupBy("scope").count().collect()} == {(0, 600), (1, 600)}
    assert sorted(got.collect()) == sorted(all_gaps(spans).collect())


def names_of(spark, path):
    b = read_traces(spark, [str(path)], "r")
    got = {}
    for r in b.spans.orderBy("seq").collect():
        got.setdefault(r["rank"], []).append(r.name)
    return got, {r.path.split("/")[-1]: (r.n_events, r.problem) for r in b.bad_files.collect()}


def events_before(data):
    """Names of the events that are whole in the longest readable beginning of a document."""
    text, out, at = data.decode("utf-8", "ignore"), [], 0
    at = text.index("[") + 1 if "[" in text else len(text)
    while True:
        try:
            e, at = json.JSONDecoder().raw_decode(text, at)
        except ValueError:
            return out
        out.append(e["name"])
        while text[at : at + 1] in (",", " ", "\n"):
            at += 1


def inflated(data):
    """What zlib gives of a gzip stream before its damage, over all members."""
    out = b""
    while data:
        z = zlib.decompressobj(31)
        for i in range(len(data)):
            try:
                out += z.decompress(data[i : i + 1])
            except zlib.error:
                return out
            if z.eof:
                break
        data = z.unused_data + data[i + 1 :] if z.eof else b""
    return out


def test_damaged_files_are_reported_and_salvaged(spark, tmp_path):
    many = [dict(EVENTS[0], name=f"k{i}", ts=1700000000000000 + i) for i in range(400)]
    whole = json.dumps({"traceEvents": many}).encode()
    zipped = gzip.compress(whole)
    flipped = bytearray(zipped)
    flipped[len(zipped) // 2] ^= 0x55
    files = {
        "x-rank-1.json.gz": zipped[: len(zipped) * 2 // 3],
        "x-rank-2.json": whole[:5000],
        "x-rank-3.json": json.dumps({"traceEvents": many[:7]}).encode(),
        "x-rank-4.json": b'{"traceEvents": [',
        "x-rank-5.json.gz": bytes(flipped),
        "x-rank-6.json.gz": gzip.compress(whole[:20_000]) + gzip.compress(whole[20_000:]),
        "x-rank-7.json.gz": gzip.compress(whole[:20_000]) + gzip.compress(whole[20_000:])[:-300],
        "x-rank-8.json.gz": gzip.compress(whole[:5001]),
        "x-rank-9.json": b"",  # Spark doesn't list empty files
        "x-rank-10.json": b'{"other": [{"a": 1}]}',
        "x-rank-11.json": whole[: whole.index(b'"dur": 10.5', 3000) + 8],
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got, bad = names_of(spark, tmp_path)
    for name, data in files.items():
        rank = int(name.split("-")[-1].split(".")[0])
        want = events_before(inflated(data) if name.endswith(".gz") else data) if rank not in (4, 9, 10) else []
        if rank == 5:  # a changed bit may show late, as other text, and takes a buffer with it
            assert got[5][: len(want) - 40] == want[:-40] and len(want) > 40
        else:
            assert got.get(rank, []) == want, name
    assert 20 < len(got[1]) < 400 and len(got[6]) == 400 and 200 < len(got[7]) < 400
    assert {n: p for n, (_, p) in bad.items()} == {f"x-rank-{i}.json{z}": "damaged" for i, z in ((1, ".gz"), (2, ""), (4, ""), (5, ".gz"), (7, ".gz"), (8, ".gz"), (11, ""))} | {"x-rank-10.json": "no events"}
    assert bad["x-rank-2.json"][0] == len(got[2])


def test_headers_of_damaged_files(spark, tmp_path):
    doc = json.dumps({"distributedInfo": {"rank": 1, "world_size": 4}, "deviceProperties": [{"name": "D"}], "traceEvents": EVENTS, "vllm_version": "1"})
    cuts = {"events": doc.index('"open"'), "between": doc.index(', "vllm'), "devices": doc.index('{"name": "D"'), "rank": doc.index('"world_size"')}
    for name, at in cuts.items():
        (tmp_path / f"{name}.json").write_text(doc[:at])
    docs, _ = read_documents(spark, trace_files(spark, [str(tmp_path)]))
    got = {r.path.split("/")[-1].split(".")[0]: (r.distributedInfo and r.distributedInfo["rank"], r.deviceProperties and [x.name for x in r.deviceProperties], r.complete) for r in docs.collect()}
    assert got == {"events": (1, ["D"], False), "between": (1, ["D"], False), "devices": (1, [], False), "rank": (1, None, False)}


def awkward_document(n):
    """Events with brackets, quotes and backslashes in strings, nested args, and a header before and after."""
    texts = ["}{", '"', "\\", '\\"{', "[[", "], {", 'a":[', "é😀", "traceEvents\": [{", "\\\\"]
    events = [dict(EVENTS[0], name=f"k{i}", ts=1700000000000000 + i, args={"t": texts[i % len(texts)] * (1 + i % 3), "n": {"d": [[{"x": texts[(i * 7) % len(texts)]}], {}]}}) for i in range(n)]
    return {"deviceProperties": [{"name": "D{1}", "l": [1, {"m": []}]}, {"name": "E"}], "otherData": {"a": {"b": 1}, "traceName": "}"}, "traceEvents": events, "vllm_version": "9]", "distributedInfo": {"rank": 5, "world_size": 6}}


def test_one_file_over_many_tasks(spark, tmp_path):
    doc = awkward_document(120)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a b+c.json").write_text(json.dumps(doc, ensure_ascii=False))
    (tmp_path / "small.json").write_text(json.dumps(doc, ensure_ascii=False, indent=1))
    want = [(e["name"], e["args"]) for e in doc["traceEvents"]]
    for size, path in (("400b", tmp_path / "in"), ("1700b", tmp_path / "in"), ("128m", tmp_path / "small.json")):
        before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
        try:
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b")
            n = pieces._fragments(spark, [str(path)]).rdd.getNumPartitions()
            docs, events = read_documents(spark, trace_files(spark, [str(path)]))
        finally:
            for k, v in before.items():
                spark.conf.set(k, v)
        got = [(r.name, json.loads(r.args)) for r in events.orderBy("seq").collect()]
        assert got == want, (size, n)
        assert n == 1 if size == "128m" else n > 3
        d = docs.first()
        assert (d.deviceProperties[0].name, d.vllm_version, d.distributedInfo.asDict(), d.n_events, d.complete) == ("D{1}", "9]", {"rank": 5, "world_size": 6}, 120, True), size


def test_discovery_reads_a_mebibyte(spark, tmp_path):
    (tmp_path / "early.json").write_text('{"x": 1, "traceEvents": []}' + " " * (3 << 20))
    (tmp_path / "late.json").write_text('{"x": "' + "y" * (2 << 20) + '", "traceEvents": []}')
    with open(tmp_path / "huge.json", "wb") as f:
        f.write(b'{"traceEvents": [')
        f.truncate(3 << 30)  # more than one row of a binary file can hold
    paths = [str(tmp_path / n) for n in ("early.json", "late.json", "huge.json")]
    assert begins_with(spark, paths, b"traceEvents") == [paths[0], paths[2]]
    assert {r.path.split("/")[-1] for r in discover(spark, [str(tmp_path)]).collect()} == {"early.json", "huge.json"}


def test_files_without_a_rank_stay_apart(spark, tmp_path):
    for name in ("a.json", "b.json"):
        (tmp_path / name).write_text(json.dumps({"traceEvents": EVENTS}))
    b = read_traces(spark, [str(tmp_path)], "r")
    assert b.spans.select("span_id").distinct().count() == 4 and {r.run for r in b.runs.collect()} == {"r:a.json", "r:b.json"}
    assert b.tracks.count() == 4 and {r.n_events for r in b.tracks.collect()} == {1}
