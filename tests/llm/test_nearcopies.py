import random

import numpy as np
import pandas as pd

from tests.llm.fixtures import DOCS, frame, prose, rows

import corpus_pipeline
from spanforge.llm import nearcopies as op


def brute(docs):
    """The group of each row, by comparing all pairs."""
    def grams(t):
        w = (t or "").split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets = [grams(t) for _, t in docs]
    group = list(range(len(docs)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                group = [group[j] if g == group[i] else g for g in group]
    return group


def planted():
    r = random.Random(4)
    line = prose(5000, 40)
    docs = [(i, (line + " " if i % 3 == 0 else "") + prose(i, r.choice([3, 12, 60, 150]))) for i in range(120)]
    for i in range(120):
        for _ in range(i % 4):
            w = docs[r.randrange(len(docs))][1].split()
            for _ in range(r.randint(0, 5)):
                w[r.randrange(len(w))] = "edit" + str(r.random())
            docs.append((len(docs), " ".join(w[: len(w) - r.randint(0, 2)])))
    return docs


def test_near_copies_match_brute_force(spark):
    docs = planted()
    group = brute(docs)
    want = {min(docs[i][0] for i in range(len(docs)) if group[i] == g) for g in set(group)}
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in docs], DOCS).repartition(3)
    assert len(want) < len(docs) - 60
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == sorted(want)


def test_awkward_rows(spark):
    docs = [(d, (t or "").lower()) for d, t, *_ in rows()]
    assert op.keep_one(frame(spark)).count() == len(set(brute(docs)))
    assert op.keep_one(frame(spark, [])).count() == 0


def test_parities_of_sets_of_any_length(spark):
    r = np.random.default_rng(3)
    pool = r.integers(-(1 << 62), 1 << 62, 9000)
    sets = [np.unique(pool[a:b]) for a, b in ((0, 500), (60, 530), (0, 1100), (0, 1020), (100, 2300), (0, 9000), (200, 8999), (3000, 5200), (5200, 7400), (0, 0))]
    bits = [op.parities(s) for s in sets]
    assert [len(b) for b in bits] == [16, 16, 64, 32, 64, 64, 64, 64, 64, 16]
    for x, s in zip(bits, sets):
        for y, t in zip(bits, sets):
            n = min(len(x), len(y))
            off = np.bitwise_count((op.folded(x, n) ^ op.folded(y, n)).view(np.uint64)).sum()
            assert off <= len(np.setxor1d(s, t))
    own = spark.createDataFrame([(i, len(s), b.tolist()) for i, (s, b) in enumerate(zip(sets, bits))], "k long, n int, bits array<long>")
    pairs = spark.createDataFrame([(i, j) for i in range(len(sets)) for j in range(i)], "a long, b long")
    alike = {(i, j) for i in range(len(sets)) for j in range(i) if 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (len(sets[i]) + len(sets[j]))}
    left = {(p.a, p.b) for p in op._near(pairs, own).collect()}
    assert alike <= left and (8, 7) not in left  # two long sets without a common member
    m = pd.DataFrame({"k": [range(len(sets))], "n": [[len(s) for s in sets]], "i": [[0] * len(sets)], "root": [range(len(sets))], "bits": [bits]})
    met = pd.concat(op._across(iter([m, m])))
    got = set(zip(met["a"], met["b"]))
    assert alike <= got <= left and len(met) == len(got)  # once, though they meet twice


def test_long_texts_that_share_a_passage_are_no_pairs_of_each_of_its_shingles(spark):
    passage = prose(1, 600)
    docs = [(i, passage + " " + prose(10 + i, 2600)) for i in range(12)]
    posted = []
    real = op._meetings
    try:
        op._meetings = lambda posts: posted.append(real(posts)) or posted[-1]
        out = op.groups(spark.createDataFrame(docs, "doc_id long, text string"))
        assert out.select("root").distinct().count() == 12
    finally:
        op._meetings = real
    assert posted[0].count() < 60  # 600 shingles have the same twelve sets, or some of them


def test_closest_copies_are_found_by_fingerprints(spark):
    docs = [(i, prose(i, 300)) for i in range(20)] + [(100 + i, prose(i, 300) + " end") for i in range(20)]
    sets = [op.shingles(t) for _, t in docs]
    own = spark.createDataFrame([(i, op.fingerprint(s)) for i, s in enumerate(sets)], "k long, fp long")
    near = {(p.a, p.b) for p in op._close(own).collect()}
    within = {(i, j) for i in range(40) for j in range(i) if ((op.fingerprint(sets[i]) ^ op.fingerprint(sets[j])) & (1 << 64) - 1).bit_count() <= 2}
    assert near and near <= within and {j for _, j in near} <= set(range(20))
