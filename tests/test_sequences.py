"""Sequences of documents in one file, and stores of many ranks."""

import gzip
import json

import pytest
from tests.test_sources import EVENTS, awkward_document

from spanforge.plans import queries
from spanforge.schema import FLOWS, RUNS, SPANS, TRACKS, Bundle
from spanforge.sources import pieces
from spanforge.sources.ingest import discover, discover_documents, read_documents, read_traces, trace_files
from spanforge.sources.store import read_store, write_store
from spanforge.streaming import live

RS = "\x1e"


def document(rank, n):
    return awkward_document(n) | {"distributedInfo": {"rank": rank, "world_size": 9}}


def sequence():
    """Text of a sequence: whole documents, ones cut in a string, in an array and between events, blank ones, one without events; and what is to be read: (rank, names, problem)."""
    text = lambda r, n: json.dumps(document(r, n), ensure_ascii=False)
    head = json.dumps({"distributedInfo": {"rank": 3, "world_size": 9}})[:-1]
    cut = head + ', "traceEvents": [' + json.dumps(EVENTS[0] | {"name": "k0"}) + ', {"name": "in a st}[{ring'
    deep = head.replace("3", "4") + ', "traceEvents": [' + json.dumps(EVENTS[0] | {"name": "k0"}) + ', {"args": {"a": [[{'
    between = head.replace("3", "6") + ', "traceEvents": [' + json.dumps(EVENTS[0] | {"name": "k0"}) + ","
    texts = [text(1, 9), "", cut, text(2, 5), " \n", deep, between, head.replace("3", "7") + ', "other": [{"a": 1}]}', text(8, 2)]
    want = {1: (9, None), 3: (1, "damaged"), 2: (5, None), 4: (1, "damaged"), 6: (1, "damaged"), 7: (0, "no events"), 8: (2, None)}
    return "".join(RS + t + "\n" for t in texts), want


@pytest.mark.parametrize("size", ["150b", "1700b", "128m", "gz"])
def test_sequences_of_documents(spark, tmp_path, size):
    text, want = sequence()
    path = tmp_path / ("s.txt.gz" if size == "gz" else "s.txt")
    path.write_bytes(gzip.compress(text.encode()) if size == "gz" else text.encode())
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        if size != "gz":
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        docs, events = read_documents(spark, trace_files(spark, [str(path)]))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    docs = {r.distributedInfo["rank"]: r for r in docs.collect()}
    assert {k: (r.n_events, "damaged" if not r.complete else None if r.n_events else "no events") for k, r in docs.items()} == want
    assert all(text.encode()[r.doc - 1 : r.doc + 1] == b"\x1e{" for r in docs.values())
    got = {}
    for r in events.orderBy("seq").collect():
        got.setdefault(r.doc, []).append((r.name, json.loads(r.args)))
        assert text.encode()[r.seq : r.seq + 1] == b"{"
    for k, n in ((1, 9), (2, 5), (8, 2)):
        assert got[docs[k].doc] == [(e["name"], e["args"]) for e in document(k, n)["traceEvents"]]
        assert docs[k].vllm_version == "9]" and docs[k].deviceProperties[0].name == "D{1}"


def test_traces_of_a_sequence(spark, tmp_path):
    text, want = sequence()
    (tmp_path / "s.txt").write_text(text + RS + json.dumps({"traceEvents": EVENTS}) + RS + json.dumps({"traceEvents": EVENTS}))
    (tmp_path / "other.txt").write_text('{"traceEvents": []}')
    b = read_traces(spark, [str(tmp_path / "s.txt")], "r")
    assert {r["rank"]: r.problem for r in b.bad_files.collect()} == {k: p for k, (_, p) in want.items() if p}
    spans = b.spans.collect()
    assert len({r.span_id for r in spans}) == len(spans) == 19 + 2 * 2
    assert len({r.run for r in spans}) == 3  # documents without a rank stay apart
    assert [r.path.split("/")[-1] for r in discover(spark, [str(tmp_path)]).collect()] == ["s.txt"]
    found = discover_documents(spark, [str(tmp_path)]).collect()
    assert {r["rank"] for r in found} == {1, 2, 3, 4, 6, 8, None} and len(found) == 8
    q = live.watch_traces(spark, str(tmp_path), str(tmp_path / "store"), str(tmp_path / "ck"), run="r", once=True, glob="s.txt")
    q.awaitTermination()
    assert {r.span_id for r in live.read_spans(spark, str(tmp_path / "store")).collect()} == {r.span_id for r in spans}


def test_files_do_not_grow_with_ranks(spark, tmp_path):
    rows = [("r", rank, "0", "1", "t", True, i, 1000 * (rank or 99) + i, f"k{i}", "kernel", i, 1, i + 1, None) for rank in [*range(60), None] for i in range(3)]
    spans = spark.createDataFrame(rows, SPANS)
    tracks, flows, runs = (spark.createDataFrame([], x) for x in (TRACKS, FLOWS, RUNS))
    for batch in (None, 2):
        store = tmp_path / f"store-{batch}"
        write_store(Bundle(spans, tracks, flows, runs), str(store), batch=batch)
        assert len(list(store.rglob("*.parquet"))) < 30
        assert sorted(map(str, read_store(spark, str(store), ["r"], batch).spans.collect())) == sorted(map(str, spans.collect()))
        assert read_store(spark, str(store), ["s"]).spans.isEmpty()


def test_documents_of_many_ranks_take_few_files(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    for cut in (False, True):
        files = trace_files(spark, [queries._documents(spark, sf, cut)])
        docs, events = read_documents(spark, files)
        assert "from_json" not in events._jdf.queryExecution().optimizedPlan().toString()  # parsed once, however often it is used
        assert docs.count() > 2 * files.count() and pieces.SEPARATOR == RS.encode()
