import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from tests.llm.fixtures import DOCS, frame, prose, rows

from spanforge.llm import lexical as op

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def split(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(lower)


def brute(docs, items, k):
    held = [(d[0], split(d[1])) for d in docs]
    n, total = sum(bool(t) for _, t in held), sum(len(t) for _, t in held)
    df = Counter(w for _, t in held for w in set(t))
    out = []
    for item_id, text in {(i, x) for i, x in items}:
        scored = []
        for doc_id, t in held:
            c, m = Counter(t), 50 + (50 * len(t) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in set(split(text)) if c[w])
            if s > 0:
                scored.append((-s, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def questions():
    texts = [d[1] for d in rows() if d[1]]
    r = random.Random(4)
    out = [(i, " ".join(r.sample(split(texts[i % len(texts)]), min(6, len(split(texts[i % len(texts)])))))) for i in range(20)]
    return out + [(20, None), (21, ""), (22, "?!"), (23, "É mixed ÀB mixed"), (24, "word"), (5, "one two"), (None, "One TWO"), out[3], (25, "absent terms only")]


def items(spark, some):
    return spark.createDataFrame(some, "item_id long, text string").selectExpr("*", "1 as item", "2 as w", "'z' as term")


@pytest.mark.parametrize(("size", "vocabulary"), [(16_384, 1_000_000), (5, 1_000_000), (16_384, 3)])
def test_awkward_rows(spark, size, vocabulary):
    found = op.search(frame(spark), items(spark, questions()), k=4, shard_docs=size, chunk=7, vocabulary=vocabulary)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows(), questions(), 4)


def test_many_documents_in_blocks(spark, monkeypatch):
    docs = [(i, prose(i % 400, 5 + i % 37), "en", "a", 0) for i in range(1500)]
    asked = [(i, prose(i, 12)) for i in range(30)]
    found = op.search(spark.createDataFrame(docs, DOCS), items(spark, asked), k=10, shard_docs=500)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(docs, asked, 10)


def test_ids_that_are_text(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), (None, "x y"), ("c", "z"), ("d", "u v w")], "doc_id string, text string")
    asked = spark.createDataFrame([("q", "x")], "item_id string, text string")
    assert [r.doc_id for r in op.search(docs, asked).orderBy("rank").collect()] == ["a", "b", None]


def test_empty(spark):
    assert op.search(frame(spark, []), items(spark, questions())).count() == 0
    assert op.search(frame(spark), items(spark, questions()).filter("false")).count() == 0


def shard_of(lists, n_docs):
    s = op.Shard.__new__(op.Shard)
    s.ids, s.orders, s.blocks, s.lists, s.opened = list(range(n_docs)), np.arange(n_docs), -(-n_docs // op.BLOCK), lists, {}
    return s


def test_pair_bounds_hold_and_skip_more_than_term_maxima(spark):
    """Two strong terms that never meet in a document: the pair bound is the larger of them, not their sum."""
    n, r = 128 * 40, np.random.default_rng(1)
    lists, pairs = {}, [(0, 1), (2, 3)]
    for t in range(4):
        at = np.arange(t % 2, n, 2) if t < 2 else np.sort(r.choice(n, 900, replace=False))
        lists[t, -1] = at, r.integers(50, 100, len(at))
    full = np.zeros(n, np.int64)
    for t in range(4):
        full[lists[t, -1][0]] += lists[t, -1][1]
    for a, b in pairs:
        both = np.intersect1d(lists[a, -1][0], lists[b, -1][0])
        if len(both):
            joint = np.array([sum(lists[t, -1][1][np.searchsorted(lists[t, -1][0], d)] for t in (a, b)) for d in both])
            block = both // op.BLOCK
            lists[a, b] = np.unique(block), np.array([joint[block == x].max() for x in np.unique(block)])
    paired, single = shard_of(lists, n), shard_of({k: v for k, v in lists.items() if k[1] < 0}, n)
    bound = paired.bound(pairs)
    assert (bound >= full.reshape(-1, op.BLOCK).max(1)).all()
    alone = single.bound([(t, -1) for t in range(4)])
    assert (bound <= alone).all() and bound.sum() < alone.sum()
    docs, scores, opened = paired.search(pairs, 20, 0)
    want = sorted(zip(-full, range(n), strict=True))[:20]
    assert sorted(zip((-scores).tolist(), docs.tolist(), strict=True)) == [(int(s), d) for s, d in want]
    _, _, without = single.search([(t, -1) for t in range(4)], 20, 0)
    assert opened <= without
