import pytest
from tests.llm.fixtures import DOCS, frame, prose, rows

import corpus_pipeline
from spanforge.llm import queries


def test_stages_and_queries():
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "pii", "mixing"]
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries()) == list(range(1, 14))


def test_run(spark, tmp_path):
    docs, labels = [], []
    for i in range(200):
        t, y = prose(i, 120), int(i % 4 > 0)
        docs.append((i, t if y else t.upper().replace(" ", "!! "), "en", "ab"[i % 2], 0))
        labels.append((i, y, 0))
    docs += [(300, docs[1][1], "en", "a", 0), (301, prose(900, 30) + " " + prose(77, 20), "en", "a", 0), (302, prose(902, 60) + " mail ann.lee@site.org now", "en", "b", 0)]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(77, 20))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == [c.split()[0] for c in DOCS.split(", ")]
    out = got.collect()
    ids = {r.doc_id for r in out}
    assert 300 not in ids and 301 not in ids and not [i for i in ids if i < 200 and i % 4 == 0]
    assert all("<EMAIL>" in r.text and "@" not in r.text for r in out if r.doc_id == 302)
    d = corpus_pipeline.STAGES
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {r.doc_id for r in d[0][1](spark, df, str(tmp_path)).collect()}
    assert len(kept & {i for i in range(200) if i % 4}) >= 147


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """labels and benchmark beside the awkward rows."""
    path = str(tmp_path_factory.mktemp("tables"))
    docs = [(i, prose(i, 60) if i % 4 else prose(i, 60).upper().replace(" ", "!! "), "en", "a", 0) for i in range(200, 320)]
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i, *_ in docs], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, prose(7, 200)), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs


def test_stages_take_awkward_rows(spark, folder):
    path, docs = folder
    df = frame(spark, rows() + docs)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, path)
        assert out.columns == df.columns, name
        got = {(r.doc_id, r.text) for r in out.collect()}
        if name != "pii":
            assert got <= {(d, t) for d, t, *_ in rows() + docs}, name
        if name in ("decontamination", "pii"):
            assert any(t is None for _, t in got), name
        if name == "decontamination":
            assert all(d != -3 for d, _ in got) and len(got) == len({(d, t) for d, t, *_ in rows() + docs}) - 1
        if name == "near_dedup":
            assert {(10, prose(6, 30)), (None, prose(5, 40))} <= got and out.filter("doc_id = 10").count() == 1
        if name == "quality":
            assert not [d for d, _ in got if d is not None and d >= 200 and d % 4 == 0]
            assert (7, prose(99, 6000)) in got  # a long text is read whole


def test_stages_take_empty_tables(spark, folder):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame(spark, []), folder[0]).count() == 0, name


def test_stages_without_benchmark_and_labels(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = frame(spark)
    for name, stage in corpus_pipeline.STAGES:
        if name in ("quality", "decontamination", "pii"):
            assert stage(spark, df, str(tmp_path)).count() == df.count(), name


def test_clashing_names_keep_their_values(spark, folder):
    """Columns called like results and helpers of the stages come out as they went in."""
    path, docs = folder
    names = ["size", "source_size", "target", "copies", "taken", "plan", "copy", "of_id", "_of_id", "of_text", "found", "th", "spans", "n_words", "n_hit", "contaminated", "score", "predicted", "held_out", "rate", "seed", "__id", "__th", "__found", "k", "root", "h"]
    some = docs[:30] + [r for r in rows() if r[0] is not None and r[0] < 3]
    df = spark.createDataFrame(some, DOCS).selectExpr("*", *[f"concat('{n} ', coalesce(doc_id, -1)) as `{n}`" for n in names])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, path)
        assert out.columns == df.columns, name
        for r in out.collect():
            assert all(r[n] == f"{n} {r.doc_id}" for n in names), name
