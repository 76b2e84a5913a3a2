import hashlib
import re
import zlib
from collections import Counter

import xxhash
from tests.llm.fixtures import frame, prose, rows

from spanforge.llm import merkle as op


def test_tree():
    a = "\n".join(prose(i, 40) for i in range(6)) + "\n\n" + prose(9, 50)
    b = a.replace("\n", "\nnew words here ", 1)
    assert op.fingerprint(a) == op.fingerprint(str(a)) != op.fingerprint(b)
    assert op.likeness(op.fingerprint(a), op.fingerprint(a)) == 1.0
    assert 0.8 < op.likeness(op.fingerprint(a), op.fingerprint(b)) < 1.0
    assert op.changes(op.fingerprint(a), op.fingerprint(b)) == [("deleted", 0, 1), ("inserted", 0, 1)]
    assert op.likeness(op.fingerprint(""), op.fingerprint(a)) < 0.1
    assert op.fingerprint(None) == op.fingerprint("")
    assert op.fingerprint("a b") != op.fingerprint("a  b") != op.fingerprint("a\nb")


def brute():
    docs = sorted(((d, t or "") for d, t, *_ in rows()), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    out = []
    for i, (d, t) in enumerate(docs):
        following = docs[(i + 1) % len(docs)][1]
        n = len(t) // 2
        new = t[: len(t) - n] + following[:n]
        a, b, c = op.fingerprint(t), op.fingerprint(new), op.fingerprint(following)
        out.append((d, len(t), hashlib.sha256(new.encode()).hexdigest(), a, b, op.likeness(a, b), op.likeness(a, c)))
    return sorted(out, key=str)


def test_edits_match_brute_force(spark):
    for ranges in (1, 3, 8, 40):
        got = [tuple(r)[:7] for r in op.fingerprint_edits(frame(spark), ranges).collect()]
        assert sorted(got, key=str) == brute()


def test_edges(spark):
    assert op.fingerprint_edits(frame(spark, [])).count() == 0
    lone = op.fingerprint_edits(frame(spark, [(5, "abcd", "", "", 0)])).first()
    assert lone.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and lone.near_next == 1.0
    nulls = op.fingerprint_edits(frame(spark, [(None, "abcd", "", "", 0), (None, "xy", "", "", 0)])).collect()
    assert len(nulls) == 2


def test_long_unrelated_texts_are_unlike():
    a, b = ("\n".join(f"{x}{i} {x}{i + 1} {x}{i + 2}" for i in range(0, 200_000, 3)) for x in "ab")
    x, y = op.fingerprint(a), op.fingerprint(b)
    assert op.likeness(x, y) < 0.001
    assert op.likeness(x, op.fingerprint(op.edited(a, b))) < 0.51
    assert len(op.changes(x, y)) == 2 * len(a.split("\n"))


def changed(a, b):
    return op.changes(op.fingerprint(a), op.fingerprint(b))


def test_inserts_deletes_and_moves():
    p = [prose(i, 40) for i in range(9)]
    text = "\n\n".join("\n".join(p[i : i + 3]) for i in (0, 3, 6))
    assert changed(text, text) == []
    assert changed(text, text.replace(p[4], p[4] + "\nnew words")) == [("inserted", 1, 2)]
    assert changed(text, text.replace(p[4] + "\n", "")) == [("deleted", 1, 1)]
    assert changed(text, text.replace(p[0] + "\n" + p[1], p[1] + "\n" + p[0])) == [("moved", 0, 0)]
    assert changed(text, "\n\n".join(reversed(text.split("\n\n")))) in ([("moved", i, -1) for i in k] for k in ((0, 1), (0, 2), (1, 2)))
    assert changed(text, text + "\n\n" + p[0]) == [("inserted", 3, 0)]
    assert changed(text, text.replace("\n\n", "\n \n")) == [("spacing", -1, -1)]
    assert changed("", "a") == [("deleted", 0, 0), ("inserted", 0, 0)]


M = 1 << 64
MIX, BASE = 0x9E3779B97F4A7C15, 0x5851F42D4C957F2D


def mixed(h):
    h = (h ^ (h >> 29)) * MIX % M
    return (h ^ (h >> 32)) * MIX % M


M = 1 << 64
MIX, BASE = 0x9E3779B97F4A7C15, 0x5851F42D4C957F2D


def mixed(h):
    h = (h ^ (h >> 29)) * MIX % M
    return (h ^ (h >> 32)) * MIX % M


def brute_pieces(text):
    """The pieces by section and paragraph, cut by hand."""
    out = []
    for section in re.split(r"\n[ \t\r\x0b\f]*\n", text):
        out.append([])
        for paragraph in section.split("\n"):
            pieces, words = [], paragraph.split(" ")
            while words:
                n = next((k + 1 for k, w in enumerate(words[:8]) if zlib.crc32(w.encode()) % 3 == 0), min(8, len(words)))
                pieces.append(" ".join(words[:n]))
                words = words[n:]
            out[-1].append(pieces)
    return out


def grams(text):
    """The finer level by hand: hashes of every four characters, with three nulls before the text."""
    c = [0] * 3 + [ord(x) + 1 for x in text]
    return [mixed(sum(c[i + k] * pow(BASE, 1 + k, M) for k in range(4)) % M) for i in range(len(text))]


def test_fingerprints_and_likeness_match_a_plain_tree():
    texts = [t or "" for _, t, *_ in rows()] + ["a", "ab cd", "x\ny", "\n", "\n\n\n", "one line of words that is short", "a" * 300, "ab" * 200, "\n".join("ab" * 40 for _ in range(9))]
    h = lambda parts, tag: hashlib.blake2b(b"".join(parts), digest_size=16, person=tag)
    trees = {a: brute_pieces(a) for a in texts}
    prints = {a: op.fingerprint(a) for a in texts}
    for a in texts:
        tree = [[[xxhash.xxh64_digest(x.encode()) for x in p] for p in s] for s in trees[a]]
        sections = [h([h(p, b"paragraph").digest() for p in s], b"section") for s in tree]
        root = h([*(s.digest() for s in sections), hashlib.sha256(a.encode()).digest()], b"root").hexdigest()[:32]
        body = "/".join(n.hexdigest()[:16] + "=" + ".".join(h(p, b"paragraph").hexdigest()[:16] + "-" + "".join(x.hex()[:8] for x in p) for p in s) for n, s in zip(sections, tree, strict=True))
        fine = ";" + "".join(f"{x:016x}"[:8] for x in grams(a)) if len(a) <= 400 else ""
        assert prints[a] == f"{root}:{body}{fine}"
        for b in texts:
            x, y = (grams(t) if max(len(a), len(b)) <= 400 else [x for s in trees[t] for p in s for x in p] for t in (a, b))
            x, y = Counter(x), Counter(y)
            common, most = (x & y).total(), max(x.total(), y.total())
            want = 1.0 if a == b else min(common / most, 0.999999) if x and y else 0.0
            assert op.likeness(prints[a], prints[b]) == want


def test_no_length_at_which_likeness_breaks():
    """A character more, anywhere, changes little, at every length; half of a text is like it."""
    base = prose(3, 200)
    for n in range(20, 900, 7):
        t = base[:n]
        a = op.fingerprint(t)
        for other in (t + ".", "x" + t, t[: n // 2] + "#" + t[n // 2 :]):
            assert op.likeness(a, op.fingerprint(other)) >= 0.7, n
        assert op.likeness(a, op.fingerprint(op.edited(t, prose(4, 200)))) >= 0.3 > op.likeness(a, op.fingerprint(prose(5, 200)[:n])), n


def test_ids_that_are_text(spark):
    docs = [(None if d is None else f"id {d}", t) for d, t, *_ in rows()]
    got = op.fingerprint_edits(spark.createDataFrame(docs, "doc_id string, text string"), 5).collect()
    order = sorted(((d, t or "") for d, t in docs), key=lambda x: (x[0] is not None, x[0] or ""), reverse=True)
    assert sorted((r.doc_id or "", r.n_chars) for r in got) == sorted((d or "", len(t)) for d, t in order)
    following = {d: order[i + 1][1] for i, (d, _) in enumerate(order[:-1]) if sum(x == d for x, _ in order) == 1 and sum(x == order[i + 1][0] for x, _ in order) == 1}
    for r in got:
        if r.doc_id in following:
            t = dict(order)[r.doc_id]
            assert r.edited_sha256 == hashlib.sha256(op.edited(t, following[r.doc_id]).encode()).hexdigest()


def test_half_of_a_short_text_is_like_it():
    for t, n in (("Von.", "Another text"), ("Des enberge die enver.", "x" * 300), ("That it.", "Words"), ("word " * 25, prose(3, 90))):
        a, b, c = op.fingerprint(t), op.fingerprint(op.edited(t, n)), op.fingerprint(n)
        assert op.likeness(a, b) >= 0.4 > op.likeness(a, c)
