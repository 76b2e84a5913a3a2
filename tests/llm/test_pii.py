import itertools
import re

import numpy as np
from tests.llm.fixtures import frame

from spanforge.llm import pii as op


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


TEXTS = [
    "a@b.c@d.e x@y a.b+c@d-e.f.g, @@z@q.w. %@1.2 @.a 😀é@b.cc",
    "1.2.3.4.5.6.7.8 999.1.2.3.4 0255.0.0.001 1.2.3 256.1.1.1.1.1",
    "4539 1488 0343 6467 4539148803436467 4539-1488-0343-6468 12 34  5678",
    "+1 (555) 010-9999 ++49 30 12345678. +1 2 +1((((((( +12345678901234567",
    "9" * 3000 + "." + "a" * 3000 + "@" + "-" * 50,
    "",
]


def test_base_matches_the_patterns():
    for t in TEXTS:
        assert op.base_spans(t) == brute(t), t


def test_long_runs_are_linear():
    for t in ("1" * 400_000, "a" * 400_000 + " 1@", "+1" * 200_000, "1.2." * 100_000, "@a" * 200_000, "1 " * 200_000, "12345678 " * 20_000):
        op.find(t, op.Field({}))


#: A corpus in which phones and addresses occur, and the forms of one mention have one label nearly always.
SEEN = {("shape", "11", 4): 900, ("shape", "10", 4): 400, ("shape", "11", 2): 50, ("shape", "address", 1): 300, ("shape", "16", 0): 200, ("shape", "8", 0): 60, ("unmatched", "", 4): 9, ("link", "same", 1): 400, ("link", "same", 0): 2}
SEEN |= {("link", "tail", 1): 60, ("link", "tail", 0): 1, ("link", "chain", 1): 500, ("link", "chain", 0): 480}


def kinds(text, seen=SEEN):
    base, every = op.find(text, op.Field(seen))
    return [text[a:b] for x in every if x not in base for _, a, b in [x]]


def test_the_field_adds_other_forms_of_a_mention():
    assert kinds("call +1 (555) 010-9999 or later 15550109999 twice 1-555-010-9999.") == ["15550109999", "1-555-010-9999"]
    assert kinds("mail ann.lee@site.org then ann.lee[at]site[dot]org and bob[at]site[dot]org") == ["ann.lee[at]site[dot]org"]


def test_alike_mentions_share_a_potential():
    assert kinds("call +1 (555) 010-9999 or 555-010-9999 here") == ["555-010-9999"]
    assert kinds("call +1 (555) 010-9999 or 555-010-9998 here") == []


def test_counts_decide():
    text = "call +1 (555) 010-9999 or later 15550109999"
    assert kinds(text) == ["15550109999"]
    assert kinds(text, SEEN | {("link", "same", 0): 10**9}) == []
    assert kinds(text, {}) == []
    # no link, but tokens of this shape are nearly always addresses, in whatever form they come
    assert kinds("mail bob[at]site[dot]org", SEEN | {("unmatched", "", 1): 5000}) == ["bob[at]site[dot]org"]


def test_clean_text_is_left_alone():
    assert kinds("build 15550109999 on 2024-01-02 and 4785380592391135") == []
    assert kinds("ann.lee@site.org 12345678 99887766 1234") == []


def exact(local, edges):
    """Marginals by enumeration."""
    p = {x: np.exp(sum(local[i, k] for i, k in enumerate(x)) + sum(w for i, j, w in edges if x[i] == x[j])) for x in itertools.product(range(local.shape[1]), repeat=len(local))}
    out = np.zeros(local.shape)
    for x, v in p.items():
        for i, k in enumerate(x):
            out[i, k] += v
    return np.log(out / sum(p.values()))


def test_message_passing_matches_enumeration():
    r = np.random.default_rng(5)
    same = 0
    for n in (1, 2, 3, 4, 5):
        for _ in range(20):
            local = r.normal(0, 1.5, (n, 5))
            tree = [(int(r.integers(j)), j, float(r.normal(0, 2))) for j in range(1, n)]
            assert np.allclose(op.marginals(local, tree), exact(local, tree), atol=1e-4)
            loopy = [*tree, (0, n - 1, float(abs(r.normal(0, 1.5))))] if n > 2 else tree
            same += (op.marginals(local, loopy).argmax(axis=1) == exact(local, loopy).argmax(axis=1)).mean()
    assert same / 100 > 0.97


def test_potentials_come_from_the_texts(spark):
    repeated = [(i, f"call +1 (555) 01{i % 10}-99{i % 90 + 10} or +1 555 01{i % 10} 99{i % 90 + 10} please", "en", "a", 0) for i in range(200)]
    assert op.find("call +1 (555) 010-9999 or 15550109999", op.learn(frame(spark, repeated)))[1][1:] == [(3, 26, 37)]
    apart = [(i, f"at {i % 9 + 1}.{i % 99 + 100}.188.176 or +{i % 9 + 1}{i % 99 + 100}188176 ", "en", "a", 0) for i in range(200)]
    assert op.learn(frame(spark, apart)).weight["same"] < 0 < op.learn(frame(spark, repeated)).weight["same"]


PLANTED = [
    ("call +49 30 1234 5678 or later 493012345678 at night", (3, 31, 43)),
    ("call +49 30 1234 5678 or 030.1234.5678", (3, 25, 38)),
    ("mail anna.berg@example.com then anna.berg (at) example.com please", (0, 32, 58)),
    ("mail anna.berg@example.com then anna.berg (at) example (dot) com", (0, 32, 64)),
    ("card 4111 1111 1111 1111 then 4111-1111 1111.1111 ok", (2, 30, 49)),
    ("card 4111 1111 1111 1111 then 4111-1111 1111.1112 ok", None),
    ("call +1 (555) 010-9999 or 555-010-9999 here", (3, 26, 38)),
    ("mail bob (at) site.org and 493012345678", None),
]


def test_forms_never_seen_twice_are_found_by_what_the_given_texts_teach(spark):
    # no document here has a mention in a second form: the potentials come from the matched ones, re-spelled
    field = op.learn(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    assert field.weight["same"] > field.weight["tail"] > field.weight["chain"]
    for text, want in PLANTED:
        base, every = op.find(text, field)
        assert [s for s in every if s not in base] == ([want] if want else []), text


def test_a_corpus_that_disagrees_unlabels_them(spark):
    noise = [(1000 + i, f"order {1200000000 + 7919 * i} ready", "en", "a", 0) for i in range(700)]
    agree = [(i, f"call +{i % 9 + 1} {i % 99 + 100} 188 {i + 100} now", "en", "a", 0) for i in range(200)]
    apart = [(i, f"at {i % 9 + 1}.{i % 99 + 100}.188.{i % 99 + 100} or +{i % 9 + 1}{i % 99 + 100}188{i % 99 + 100} ", "en", "a", 0) for i in range(200)]
    text = "ring +1 555 188 9999 or 1555188 9999 ok"
    assert op.find(text, op.learn(frame(spark, agree + noise)))[1] == [(3, 5, 20), (3, 24, 36)]
    assert op.find(text, op.learn(frame(spark, apart + noise)))[1] == [(3, 5, 20)]


def test_learned_marginals_match_enumeration(spark):
    field = op.learn(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    for text, _ in PLANTED:
        nodes = op.mentions(text, op.base_spans(text))
        full = [{m[2] for m in nodes for x in set(m[3].items()) & set(n[3].items()) if m[2] in op.RESPELLED.get(x[0], ())} for n in nodes]
        local = np.array([field.local(m, of) for m, of in zip(nodes, full, strict=True)])
        edges = [(i, j, field.weight[s]) for i, j, s in op.links(nodes)]
        assert (np.exp(exact(local, edges)).argmax(axis=1) == [k for k in field.label(nodes)]).all(), text


def test_numbers_and_signs_in_parts():
    tokens = lambda t: [t[a:b] for a, b in op._tokens(t)]
    assert tokens("see a.b (at) c (dot) d now, x(at)y and z9 (at) w [dot] v") == ["a.b (at) c (dot) d", "x(at)y", "z9 (at) w [dot] v"]
    assert tokens("(at) b") == ["(at) b"] and tokens("b (at)") == ["b (at)"] and tokens("b (at) ") == ["b (at)"]
    assert [m[:2] for m in op.mentions("+1 555 188 9999 or 1 555 188 9999 1 555 188 9999", [(3, 0, 15)])] == [(0, 15), (19, 33), (34, 48)]
    for t in ("+1 555 188 9999 " + "1 " * 100_000, "a (at) " * 50_000, "(at) " * 50_000, "9(dot) " * 50_000):
        op.find(t, op.Field({}))


def test_table(spark):
    some = [(i, t, "en", "a", 0) for i, t in enumerate([*TEXTS, None, "call +1 (555) 010-9999 or 15550109999"])]
    some += [(100 + i, f"call +1 (555) 01{i % 10}-99{i % 90 + 10} or +1 555 01{i % 10} 99{i % 90 + 10} please", "en", "a", 0) for i in range(200)]
    got = {r.doc_id: r for r in op.scan(frame(spark, some)).collect()}
    for i, t, *_ in some:
        want = brute(t or "")
        assert [got[i][f"n_{k}"] for k in op.KINDS] == [sum(x[0] == j for x in want) for j in range(4)]
        assert set(op.joined(want).split(",")) <= set(got[i].spans.split(",")) or not want
    masked = {r.doc_id: r.text for r in op.mask(frame(spark, some)).collect()}
    assert masked[6] is None and masked[5] == "" and masked[7] == "call <PHONE> or <PHONE>"
    assert op.scan(frame(spark, [])).count() == 0
