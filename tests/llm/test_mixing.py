from collections import Counter, defaultdict

from tests.llm.fixtures import DOCS, frame, rows

from spanforge.llm import mixing as op


def brute_targets(sizes):
    """By rounds: share, cap, reshare the excess by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in full]
        level = (total - sum(full.values())) / max(1e-9, sum(w[s] for s in rest))
        over = [s for s in rest if w[s] * level > 2 * sizes[s] + 1e-9]
        if not over:
            return full | {s: w[s] * level for s in rest}
        full |= {s: 2 * sizes[s] for s in over}


def test_targets_and_shares(spark):
    got = op.plan_mix(frame(spark)).collect()
    sizes, source = defaultdict(int), {}
    for _, text, _, s, _ in rows():
        sizes[s] += len((text or "").split(" ")) if False else len([x for x in (text or "").replace("\n", " ").replace("\t", " ").split(" ") if x])
    want = brute_targets(sizes)
    assert len(got) == len(rows())
    by_id = defaultdict(set)
    for d, _, _, s, _ in rows():
        by_id[d].add(s)
    taken = Counter()
    for r in got:
        (s,) = by_id[r.doc_id]
        assert r.source_size == sizes[s]
        assert abs(r.target - want[s]) < 1e-6
        assert r.taken % max(1, r.size) == 0 and r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in sizes:
        if sizes[s]:
            assert abs(taken[s] - want[s]) <= max(0.25 * want[s], 150)


def test_reruns_agree_and_mix_follows_the_plan(spark):
    a = sorted(map(tuple, op.plan_mix(frame(spark)).collect()), key=str)
    b = sorted(map(tuple, op.plan_mix(frame(spark).repartition(7)).collect()), key=str)
    assert a == b
    copies = Counter(r.doc_id for r in op.mix(frame(spark)).collect())
    planned = Counter()
    for r in a:
        planned[r[0]] += r[4]
    assert copies == +planned


def test_many_documents_come_near(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 9), "en", "s" + str(i % 4), 0) for i in range(4000)], DOCS)
    for r in op.plan_mix(docs, carry=True).groupBy("source").agg({"taken": "sum", "target": "max"}).collect():
        assert abs(r["sum(taken)"] - r["max(target)"]) < 0.01 * r["max(target)"]


def test_empty(spark):
    assert op.plan_mix(frame(spark, [])).count() == 0
    assert op.mix(frame(spark, [(1, None, "en", "a", 0)])).count() == 0


def test_rows_without_ids_are_drawn_by_their_texts(spark):
    docs = spark.createDataFrame([(None, f"w{i} " * (1 + i % 9), "en", "s" + str(i % 4), 0) for i in range(3000)], DOCS)
    for r in op.plan_mix(docs, carry=True).groupBy("source").agg({"taken": "sum", "target": "max"}).collect():
        assert abs(r["sum(taken)"] - r["max(target)"]) < 0.02 * r["max(target)"]
