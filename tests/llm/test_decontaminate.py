import hashlib
import re

from tests.llm.fixtures import DOCS, frame, prose, rows

from spanforge.llm import decontaminate as op

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items):
    words = lambda t: WORD.findall((t or "").translate(LOWER))
    windows = [(i, tuple(w[k : k + min(13, len(w))])) for i, t in items if (w := words(t)) for k in range(len(w) - min(13, len(w)) + 1)]
    out = []
    for doc_id, text, *_ in docs:
        w = words(text)
        hit, ids = set(), set()
        for i, g in windows:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit.update(range(k, k + len(g)))
                    ids.add(str(i))
        sha = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(ids), sha, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def items():
    passage = prose(7, 200).split()
    return [
        (1, " ".join(passage[20:60])),
        (2, " ".join(passage[50:70]).upper()),
        (10, " ".join(passage[20:60]) + " tail"),
        (3, "one, TWO!"),
        (4, "é€😀 É mixed"),
        (5, None),
        (6, "..."),
        (7, prose(6, 30)),
        (7, prose(6, 30)),
        (8, "never seen anywhere at all"),
    ]


def test_matches_brute_force(spark):
    bench = spark.createDataFrame(items(), "item_id long, text string")
    got = op.contamination(frame(spark), bench).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows(), items())


def test_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(op, "BROADCAST_ROWS", 0)
    bench = spark.createDataFrame(items(), "item_id long, text string")
    got = op.contamination(frame(spark), bench).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows(), items())


def test_only_native_plan(spark):
    bench = spark.createDataFrame(items(), "item_id long, text string")
    plan = op.contamination(frame(spark), bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_removal(spark):
    bench = spark.createDataFrame([(1, "b c d")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "-A b, C d! e f", "", "", 0), (2, "a b x", "", "", 0), (3, None, "", "", 0)], DOCS)
    assert {r.doc_id: r.text for r in op.decontaminate(docs, bench, "spans").collect()} == {1: "-A e f", 2: "a b x", 3: None}
    assert sorted(r.doc_id for r in op.decontaminate(docs, bench).collect()) == [2, 3]


def test_empty(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert op.contamination(frame(spark, []), bench).count() == 0
    assert op.contamination(frame(spark), bench).filter("contaminated").count() == 0
