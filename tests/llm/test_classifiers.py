import collections
import random
import zlib

import numpy as np
from tests.llm.fixtures import DOCS, frame, prose

from spanforge.llm import common, quality, toxicity


def auc(scores, y):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(order))
    ranks[order] = np.arange(len(order))
    y = np.array(y)
    return (ranks[y == 1].mean() - (y.sum() - 1) / 2) / (len(y) - y.sum())


def test_toxicity_held_out(spark):
    r = random.Random(3)
    docs, labels = [], []
    for i in range(900):
        w, y = prose(i, 80).split(), int(i % 6 == 0)
        for _ in range(3 * y):
            w.insert(r.randrange(len(w)), r.choice(["idiot", "vilename", "grubword", "scum"]))
        docs.append((i, " ".join(w), "en", "a", 0))
        labels.append((i, 1, y))
    docs += [(5000, None, "en", "a", 0), (5001, "", "en", "a", 0), (None, "idiot scum", "en", "a", 0)]
    labels += [(None, 1, 1), (7, None, None), (12345, 0, 1)]
    got = toxicity.classify(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(docs)
    y = {a: b for a, _, b in labels[:900]}
    held = [g for g in got if g.held_out and g.doc_id < 900]
    assert all(zlib.crc32(str(g.doc_id).encode()) % 3 == 1 for g in held) and len(held) > 200
    assert auc([g.score for g in held], [y[g.doc_id] for g in held]) > 0.98
    assert np.mean([g.predicted == y[g.doc_id] for g in held]) > 0.97 and all((g.score >= 0.7) == g.predicted for g in got)
    by = {g.doc_id: g for g in got}
    assert by[5000].score == by[5001].score < 0.5 and by[None].predicted == 1


def test_held_out_labels_teach_nothing(spark):
    labels = [(i, 1, int(zlib.crc32(str(i).encode()) % 3 == 1)) for i in range(60)]
    docs = spark.createDataFrame([(i, prose(i, 20), "en", "a", 0) for i in range(60)], DOCS)
    assert {y for _, y in common.labelled_sample(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), "toxic", 3, 1, 100, 10**6)} == {0}


def test_label_model_orders_patterns():
    r = np.random.default_rng(1)
    y = r.random(20000) < 0.1
    fire = (r.random((20000, toxicity.VOTERS)) < np.where(y[:, None], 0.5, 0.001)).astype(int)
    fire[:, 2] = fire[:, 1]  # two voters that always agree
    cast = fire @ (1 << np.arange(toxicity.VOTERS))
    bits, n = np.unique(cast, return_counts=True)
    m = toxicity.LabelModel(bits, n, 0.1, (cast[:1000], y[:1000].astype(int)))
    assert m.of(0) < 0.1 < 0.9 < m.of((1 << toxicity.VOTERS) - 1)
    assert (1, 2) in m.tree or (2, 1) in m.tree
    post = m.posterior(fire)
    assert np.mean((post > 0.5) == y) > 0.97


def test_quality_held_out(spark):
    docs, labels = [], []
    for i in range(500):
        w, y = prose(i, 90), int(i % 5 > 0)
        if not y:
            w = [w.upper().replace(" ", "!! "), " | ".join(w.split()), " ".join(x for x in w.split()[:12] for _ in range(7))][i // 5 % 3]
        docs.append((i, w, "en", "a", 0))
        labels.append((i, y, 0))
    docs += [(5000, None, "en", "a", 0), (5001, "", "en", "a", 0)]
    got = quality.classify(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    y = dict((a, b) for a, b, _ in labels)
    held = [g for g in got if g.held_out and g.doc_id in y]
    assert len(got) == len(docs) and len(held) > 90
    assert auc([g.score for g in held], [y[g.doc_id] for g in held]) > 0.98
    assert np.mean([g.predicted == y[g.doc_id] for g in held]) > 0.95
    by = {g.doc_id: g for g in got}
    assert by[5000].score == by[5001].score


def test_without_labels_and_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for op in (quality, toxicity):
        assert op.classify(frame(spark, []), none).count() == 0
        assert {r.predicted for r in op.classify(frame(spark), none).collect()} == {0}


LABELS = "doc_id long, quality int, toxic int"


def sample(spark, docs, labels, rows=100, chars=10**6):
    return common.labelled_sample(frame(spark, docs), spark.createDataFrame(labels, LABELS), "quality", 4, 2, rows, chars)


def test_a_long_text_drops_only_itself(spark):
    docs = [(i, prose(i, 20) if i % 9 else "long " * 30_000, "en", "a", 0) for i in range(90)]
    got = sample(spark, docs, [(i, int(i % 2 == 0), 0) for i in range(90)], chars=100_000)
    want = sum(zlib.crc32(str(i).encode()) % 4 != 2 and i % 9 > 0 for i in range(90))
    assert len(got) == want and {y for _, y in got} == {0, 1} and max(len(t) for t, _ in got) < 1000


def test_labels_of_other_documents_take_no_places(spark):
    docs = [(i, prose(i, 20), "en", "a", 0) for i in range(60)]
    rare = next(i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2)
    labels = [(i, int(i == rare or i >= 60), 0) for i in range(5000)]
    got = sample(spark, docs, labels, rows=30)
    assert 30 <= len(got) <= 31 and {y for _, y in got} == {0, 1}


def test_quality_stage_keeps_all_without_a_model(spark):
    one = spark.createDataFrame([(i, 1, 0) for i in range(40)], LABELS)
    assert quality.keep(frame(spark), one).count() == frame(spark).count()


def test_word_counts_and_neighbours_cover_every_text(spark):
    texts = [prose(i, 30 + i) for i in range(40)] + ["ab ab ab | cd", None, "", "x"]
    docs = frame(spark, [(i, t, "en", "a", 0) for i, t in enumerate(texts)])
    want = collections.Counter(w for t in texts for w in quality.TOKEN.findall(t or ""))
    assert {r["word"]: r["n"] for r in quality.word_counts(docs).collect()} == want
    vocabulary = quality.Vocabulary([(w, want[w]) for w in sorted(want, key=lambda w: (-want[w], w))[:20]], sum(want.values()))
    at, value = vocabulary.index()
    table = np.zeros((vocabulary.size, quality.DIM), np.int64)
    for t in texts:
        ids = vocabulary.of(t)
        for i, a in enumerate(ids):
            for b in ids[max(0, i - quality.REACH) : i + quality.REACH + 1]:
                np.add.at(table[a], at[b], value[b].astype(np.int64))
            np.subtract.at(table[a], at[a], value[a].astype(np.int64))  # a word is no neighbour of itself
    got = np.zeros_like(table)
    for r in quality.neighbours(docs, vocabulary).collect():
        got[r["word"]] = r[1:]
    assert (got == table).all()


def test_chunks_of_a_long_text_lose_no_neighbours(spark, monkeypatch):
    docs = frame(spark, [(1, prose(3, 500), "en", "a", 0)])
    vocabulary = quality.Vocabulary([(w, 9) for w in prose(3, 500).split()[:50]], 500)
    rows = lambda: sorted(tuple(r) for r in quality.neighbours(docs, vocabulary).collect())
    whole = rows()
    monkeypatch.setattr(quality, "CHUNK", 7)
    assert quality.CHUNK == 7 and rows() == whole


def test_network_matches_a_plain_forward_pass():
    r = np.random.default_rng(2)
    x = r.normal(0, 1, (200, 6))
    y = (x[:, 0] + x[:, 1] > 0).astype(float)
    net = quality.Network(x, y)
    z = np.clip((x - net.mean) / net.scale, -6, 6)
    hidden = np.tanh(z @ net.p[0] + net.p[1])
    want = [1 / (1 + np.exp(-float(h @ net.p[2] + net.p[3][0]) / net.temperature)) for h in hidden]
    assert np.allclose(net.score(x), want) and np.mean((net.score(x) > 0.5) == y) > 0.95


def test_voters_without_labels_know_four_languages():
    v = toxicity.Voters({})
    n = len(toxicity.INSULTS)
    for i, text in enumerate(("you are a moron", "so ein trottel", "quel crétin", "eres un payaso")):
        assert v.vote(text) >> i & 1, text
    for i, text in enumerate(("they are all idiots", "shut up now", "halt die klappe", "tais-toi donc", "cállate ya", "what?!?!")):
        assert v.vote(text) >> (n + toxicity.LISTS + i) & 1, text
    assert v.vote("a quiet word about clothing") == v.vote("") == 0


def test_repeated_beginnings_are_forms():
    assert {"achlic*", "achlic**", "achlic***"} <= toxicity.forms({"achlicha", "achlichb", "achlichc"})
    assert "achlic***" not in toxicity.forms({"achlicha", "achlichb"})
