import numpy as np
import xxhash
from tests.llm.fixtures import frame, prose, rows

from spanforge.llm import simhash as op

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_print(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius=2):
    left, out = set(range(len(fps))), {}
    while left:
        stack, seen = [left.pop()], []
        while stack:
            i = stack.pop()
            seen.append(i)
            near = [j for j in left if (fps[i] ^ fps[j]).bit_count() <= radius]
            left -= set(near)
            stack += near
        for i in seen:
            out[i] = min(seen)
    return out


def test_fingerprints_and_components(spark):
    docs = rows()
    fps = [brute_print(t) for _, t, *_ in docs]
    comp = brute_components(fps)
    want = []
    for i, (d, *_) in enumerate(docs):
        ids = [docs[j][0] for j in comp if comp[j] == comp[i] and docs[j][0] is not None]
        want.append((d, f"{fps[i]:016x}", min(ids, default=None)))
    got = op.near_duplicates(frame(spark)).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def clustered(seed, n):
    r = np.random.default_rng(seed)
    centres = r.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = centres[r.integers(0, 12, n)]
    for _ in range(4):
        fps = np.where(r.random(n) < 0.6, fps ^ (np.uint64(1) << r.integers(0, 64, n, dtype=np.uint64)), fps)
    return np.unique(fps)


def test_no_link_is_lost(spark):
    # one group of few tiles or many, groups by one block, and by several blocks of few bits
    for tile, group in ((2048, 4096), (8, 4096), (8, 60), (2048, 1e-3), (4, 1e-8)):
        fps = clustered(tile, 700)
        df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
        found = {r.node: r.root for r in op.components(op.links(df, 2, tile, group)).collect()}
        want = brute_components([int(x) for x in fps])
        signed = [int(x) for x in fps.view(np.int64)]
        groups: dict = {}
        for i, c in want.items():
            groups.setdefault(c, set()).add(signed[i])
        got: dict = {}
        for x in signed:
            got.setdefault(found.get(x, x), set()).add(x)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


def test_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.root for r in op.components(edges).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


def test_keeps_one_of_each_group(spark):
    kept = sorted((str(r.doc_id) for r in op.keep_one(frame(spark)).collect()))
    want = {c.component_id for c in op.near_duplicates(frame(spark)).collect()} - {None}
    alone = [r for r in op.near_duplicates(frame(spark)).collect() if r.doc_id is None and r.component_id is None]
    assert kept == sorted([str(x) for x in want] + ["None"] * bool(alone))


def test_empty(spark):
    assert op.near_duplicates(frame(spark, [])).count() == 0
    assert op.keep_one(frame(spark, [])).count() == 0


def test_rows_that_share_an_id_but_not_a_text(spark):
    a, b = prose(31, 80), prose(32, 80)
    near = next(x for i in range(80) if (brute_print(x := " ".join([*b.split()[:i], "edit", *b.split()[i + 1 :]])) ^ brute_print(b)).bit_count() <= 2)
    some = [(3, near, "", "", 0), (5, a, "", "", 0), (5, b, "", "", 0), (7, prose(33, 80), "", "", 0), (7, prose(34, 80), "", "", 0)]
    got = [(r.doc_id, r.text) for r in op.keep_one(frame(spark, some)).collect()]
    assert sorted(got) == sorted([(3, near), (5, a), (7, some[3][1]), (7, some[4][1])])


def test_every_pair_within_the_radius_shares_the_bits_of_a_group():
    r = np.random.default_rng(8)
    for rows, radius in ((100, 2), (10**5, 2), (10**8, 2), (10**12, 2), (10**16, 2), (10**9, 0), (10**9, 5)):
        masks = np.array(op._masks(radius, rows, 4096), np.int64).view(np.uint64)
        a = r.integers(0, 1 << 63, 3000, dtype=np.uint64)
        b = a.copy()
        for _ in range(radius):
            b ^= np.uint64(1) << r.integers(0, 64, len(b), dtype=np.uint64)
        assert ((a[:, None] & masks) == (b[:, None] & masks)).any(axis=1).all()
        assert max(int(m).bit_count() for m in masks) >= min(40, np.log2(rows / 4096)) - 1e-9
