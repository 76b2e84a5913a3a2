import math
import zlib
from collections import Counter

import numpy as np
from tests.llm.fixtures import frame, prose, rows

from spanforge.llm import interpolate as op

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + ["</s>"]


def brute(docs):
    train = [words(t) for d, t, *_ in docs if d is None or zlib.crc32(str(d).encode()) % 10]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    out = []
    for d, t, *_ in docs:
        w = words(t)
        held = d is not None and zlib.crc32(str(d).encode()) % 10 == 0
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        out.append((d, held, len(w), sum(c[x] > 0 for x in w), n, base))
    return out


def test_base_matches_brute_force(spark):
    for block in (300, 10**6):
        got = op.score(frame(spark), block).collect()
        want = brute(rows())
        key = lambda r: (str(r[0]), r[2], round(r[5], 6))
        got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
        for g, w in zip(got, want, strict=True):
            assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-6 * abs(w[5])


def test_probabilities_sum_to_one_and_beat_the_base(spark):
    text = [prose(1, 400).split() for _ in range(1)][0]
    docs = [(i, " ".join(text[(13 * i) % 300 : (13 * i) % 300 + 60]), "en", "a", 0) for i in range(300)]
    got = op.score(frame(spark, docs), 2000).collect()
    held = [g for g in got if g.held_out]
    assert len(held) > 10 and sum(g.score for g in held) > 0.7 * sum(g.base_score for g in held)
    # the mixture over all next words after one context, against counts by hand
    train = [words(t) for d, t, *_ in docs if zlib.crc32(str(d).encode()) % 10]
    c = Counter(w for t in train for w in t)
    pairs = Counter(p for t in train for p in zip(["</s>", *t], t, strict=False))
    h = text[50]
    k = op.bucket(np.array([c[h]]))[0]
    lam = op.learn_weights({(int(k), 40, 20): 5, (int(k), 0, 10): 3})[k]
    assert abs(lam.sum() - 1) < 1e-9
    n, v = sum(c.values()), len(c)
    total = sum(lam[0] * pairs[h, w] / c[h] + lam[1] * c[w] / n + lam[2] / (v + 1) for w in c) + lam[2] / (v + 1)
    assert abs(total - 1) < 1e-9


def test_em_prefers_the_order_that_predicts():
    lam = op.learn_weights({(3, 90, 60): 1000, (5, 0, 60): 1000})
    assert lam[3, 0] > 0.9 and lam[5, 1] > 0.9


def test_empty(spark):
    assert op.score(frame(spark, [])).count() == 0
    (r,) = op.score(frame(spark, [(0, None, "", "", 0)])).collect()
    assert r.n_tokens == 1 and math.isfinite(r.score)


def brute_scores(docs, rounds=200):
    """The model by dictionaries, one token at a time, with EM on the left-out probabilities themselves."""
    train = [words(t) for d, t, *_ in docs if d is None or zlib.crc32(str(d).encode()) % 10]
    c, pairs = Counter(w for t in train for w in t), Counter(p for t in train for p in zip(["</s>", *t], t, strict=False))
    n, floor = sum(c.values()), 1 / (len(c) + 1)
    bucket = lambda x: 0 if x < 1 else min(1 + math.ceil(math.log2(x)), op.BUCKETS - 1)
    seen = {}
    for t in train:
        for h, w in zip(["</s>", *t], t, strict=False):
            k = c[h] - 1
            seen.setdefault(bucket(k), []).append(((pairs[h, w] - 1) / k if k else 0.0, (c[w] - 1) / (n - 1), floor))
    lam = {}
    for k in range(op.BUCKETS):
        lam[k] = np.full(3, 1 / 3)
        if k not in seen:
            lam[k] = np.array([0.0, 0.5, 0.5]) if k == 0 else lam[k - 1]
            continue
        p = np.array(seen[k])
        for _ in range(rounds):
            share = p * lam[k]
            got = (share / share.sum(axis=1, keepdims=True)).sum(axis=0) + 0.01
            lam[k] = got / got.sum()
    out = []
    for d, t, *_ in docs:
        w = words(t)
        p = [lam[bucket(c[h])] @ np.array([pairs[h, x] / c[h] if c[h] else 0.0, c[x] / n, floor]) for h, x in zip(["</s>", *w], w, strict=False)]
        out.append((str(d), len(w), float(np.log10(p).sum())))
    return sorted(out)


def test_scores_match_brute_force(spark):
    text = prose(1, 200).split()
    docs = rows() + [(1000 + i, " ".join(text[(13 * i) % 150 : (13 * i) % 150 + 40]), "en", "a", 0) for i in range(120)]
    want = brute_scores(docs)
    for block in (500, 10**6):
        got = sorted((str(r.doc_id), r.n_tokens, r.score) for r in op.score(frame(spark, docs), block).collect())
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert max(abs(g[2] - w[2]) / max(1.0, abs(w[2])) for g, w in zip(got, want, strict=True)) < 0.02


def test_leaves_no_tables(spark):
    before = {t.name for t in spark.catalog.listTables()}
    op.score(frame(spark)).count()
    try:
        op.score(frame(spark).drop("text"))
    except Exception:
        pass
    assert {t.name for t in spark.catalog.listTables()} == before

