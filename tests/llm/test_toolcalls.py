import json

from spanforge.llm import toolcalls as op

CALLS = "conv_id long, call_id string, turn long, name string, arguments string, after string"
RESULTS = "conv_id long, call_id string, turn long, content string"
TOOLS = {"t": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}, "b": {"type": "array", "items": {"type": "string"}}}}}


def test_links_orders_and_validates(spark):
    calls = [
        (1, "c", 5, "t", '{"b": ["x"], "a": 1}', "b"),
        (1, "b", 3, "t", '{"a": "no"}', "a"),
        (1, "a", 1, "t", '{ "a" : 2 , "é": null}', "gone"),
        (1, "a", 9, "t", '{"a": 3}', None),
        (2, "a", 1, "t", "not json", None),
        (2, "x", 1, "t", '{"a":1}', "y"),
        (2, "y", 2, "t", '{"a":1}', "x"),
        (2, "z", 2, "other", "{}", "y"),
        (3, "q", 1, "t", None, None),
        (None, "q", 1, "t", None, None),
    ]
    results = [(1, "a", 2, "répond"), (1, "c", 6, None), (1, "nobody", 7, "x"), (1, "a", 8, "late"), (4, None, 1, "x")]
    got = {(r.conv_id, r.call_id): r for r in op.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), TOOLS).collect()}
    assert len(got) == 9
    assert [got[1, k].depth for k in "abc"] == [0, 1, 2]
    assert got[1, "a"].json == '{"after":"gone","arguments":{"a":2,"é":null},"id":"a","name":"t","result":"répond"}'
    assert got[1, "c"].status == "ok" and json.loads(got[1, "c"].json)["result"] is None
    assert got[1, "b"].status == "bad arguments" and got[1, "b"].faults == "$.a: not of type integer"
    assert got[1, "nobody"].status == "orphan"
    assert got[2, "a"].faults == "$: not JSON" and got[3, "q"].faults == "$: not JSON"
    assert {got[2, k].status for k in "xyz"} == {"cycle"}


def test_long_chain(spark):
    calls = spark.createDataFrame([(1, f"k{i}", i, "t", '{"a":1}', f"k{i - 1}" if i else None) for i in range(500)], CALLS)
    assert {r.call_id: r.depth for r in op.depths(calls).collect()} == {f"k{i}": i for i in range(500)}


def test_derived_calls(spark):
    turns = [(1, 0, "user", "x" * 30), (1, 1, "assistant", "fine"), (1, 2, "user", "yz"), (1, 3, "system", "s"), (2, 0, "assistant", "hm"), (3, 0, "user", None)]
    conv = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = sorted((r.conv_id, r.turn if r.turn is not None else -9, r.status, r.depth) for r in op.link(*op.calls_of(conv)).collect())
    assert got == [(1, 0, "bad arguments", 0), (1, 2, "unanswered", 1), (2, -9, "orphan", None), (3, 0, "bad arguments", 0)]


def test_empty(spark):
    assert op.link(spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS), TOOLS).count() == 0


def test_schema():
    assert op.violations({"limit": 9, "query": "q" * 20, "z": 1}, op.TOOLS["search"]) == ["$.z: not allowed", "$.limit: above maximum"]
    assert op.violations(True, {"type": "integer"}) and op.violations([1], {"type": "array", "items": {"type": "string"}}) == ["$[0]: not of type string"]


def test_values_without_a_canonical_form(spark):
    bad = ['{"a":"\\ud800"}', '{"a":NaN}', '{"a":-Infinity}', '{"a":1e999}', '{"\\udfff":1}', "[" * 100_000, '{"a":' + "9" * 5000 + "}"]
    good = ['{"a":"\\ud83d\\ude00"}', '{"a":1e3}', '{"a":"' + "x" * 1_000_000 + '"}']
    calls = spark.createDataFrame([(1, f"k{i}", i, "free", t, None) for i, t in enumerate(bad + good)], CALLS)
    got = {r.call_id: r for r in op.link(calls, spark.createDataFrame([(1, "k8", 20, "fine")], RESULTS), {"free": {"type": "object"}}).collect()}
    for i, text in enumerate(bad):
        r = got[f"k{i}"]
        assert r.status == "bad arguments" and json.loads(r.json)["arguments"] == text
    assert [got[f"k{i}"].faults for i in range(len(bad), len(bad) + len(good))] == [""] * 3
    assert got["k7"].json.startswith('{"arguments":{"a":"😀"}') and len(got["k9"].json) > 1_000_000


def test_derived_calls_of_awkward_turns(spark):
    turns = [(None, 0, "user", "lost"), (1, None, "user", "no turn"), (1, 2, None, "no role"), (1, 4, "user", "twice"), (1, 4, "user", "twice"), (1, 5, "assistant", None)]
    conv = spark.createDataFrame([(*t, "extra") for t in turns], "conv_id long, turn long, role string, text string, call_id string")
    got = sorted((r.turn if r.turn is not None else -9, r.status) for r in op.link(*op.calls_of(conv)).collect())
    assert len(got) == 2 and got[1][0] == 4 and op.link(*op.calls_of(conv.limit(0))).count() == 0
