import hashlib
import zlib

from pyspark.sql import functions as F
from tests.llm.fixtures import frame, rows

from spanforge.llm import manifest as op


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    doc_id, text, lang, source, n_chars = row
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(*map(part, (doc_id, source, lang, n_chars, text)))


def rise(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i : i + fanout]) for i in range(0, len(last), fanout)])
    return levels


def steps(levels, at, fanout):
    out = []
    for level in levels[:-1]:
        first = at // fanout * fanout
        out.append(("".join(level[first:at]), "".join(level[at + 1 : first + fanout])))
        at //= fanout
    return out


def brute(table, fanout):
    """(doc_id, leaf, subroot, root, proof, folded_root) of each row, by lists."""
    by = {}
    for r in table:
        by.setdefault(r[3], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[s] = rise([leaf_of(r) for r in by[s]], fanout)
    top = rise([trees[s][-1][0] for s in order], fanout)
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(by[s]):
            path = steps(trees[s], i, fanout) + steps(top, k, fanout)
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and text is not None:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            now = leaf_of((r[0], text, *r[2:]))
            for before, after in path:
                now = h(before, now, after)
            out.append((r[0], leaf_of(r), trees[s][-1][0], top[-1][0], h(*(a + b for a, b in path)), now, now == top[-1][0]))
    return sorted(out, key=str)


def got(df, fanout):
    found = op.manifest(df, op.tampered(df["doc_id"], df["text"]), fanout=fanout)
    return sorted((tuple(r) for r in found.drop("steps").collect()), key=str)


def test_awkward_rows(spark):
    for fanout in (16, 3):
        want = brute(rows(), fanout)
        assert got(frame(spark), fanout) == want
        assert any(not r[-1] for r in want)


def test_levels_of_one_source_and_many_sources(spark):
    one = [(i, f"Text {i}", "en", "s", i) for i in range(70)] + [(None, "x", "en", None, 1)] * 5
    many = [(i % 40, f"Text {i}", None, f"source {i % 33}", i) for i in range(90)]
    for table in (one, many):
        assert got(frame(spark, table), 4) == brute(table, 4)


def test_repeated_rows_are_dealt_over_ranges(spark):
    table = [(1, "same", "en", "s", 4)] * 300
    assert got(frame(spark, table), 16) == brute(table, 16)


def test_steps_prove_leaves(spark):
    df = frame(spark)
    out = op.manifest(df)
    proved = op.fold_up(F.col("leaf"), F.col("steps")) == F.col("root")
    assert out.count() == out.filter(proved & F.col("verified")).count() == len(rows())


def test_empty(spark):
    assert op.manifest(frame(spark, [])).count() == 0
    lone = op.manifest(frame(spark, [(1, None, None, None, None)])).first()
    assert lone.leaf == lone.subroot == lone.root == lone.folded_root and lone.proof_sha256 == h()
