import math
import random

import numpy as np
import pyarrow as pa
import pytest

from spanforge.llm import knn as op

SCHEMA = "vec_id long, embedding array<float>, label int, h string, cell string, id string, v string, q int"


def table(spark, found):
    return spark.createDataFrame([(i, e, 1, "x", "y", "z", "w", 2) for i, e in found], SCHEMA).repartition(3)


def whole(e):
    return [math.floor(256 * float(np.float32(x))) for x in e]


def brute(found, every, k):
    ok = [(i, whole(e)) for i, e in found if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for at, (i, a) in enumerate(ok):
        if i is None or i % every:
            continue
        s = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), j is None, j) for n, (j, b) in enumerate(ok) if n != at)
        out += [(i, r + 1, j, -s_) for r, (s_, _, j) in enumerate(s[:k])]
    return sorted(out, key=str)


def got(df, **options):
    return sorted((tuple(r) for r in op.top_products(df, **options).collect()), key=str)


def vectors(n, d, seed, centres=0):
    r = random.Random(seed)
    around = [[r.gauss(0, 1) for _ in range(d)] for _ in range(centres)] or [[0.0] * d]
    return [(i, [float(np.float32(c + r.gauss(0, 0.05 if centres else 0.4))) for c in r.choice(around)]) for i in range(n)]


@pytest.mark.parametrize("centres", [0, 12])
def test_many_blocks_and_groups(spark, centres):
    found = vectors(400, 8, 1 + centres, centres)
    assert got(table(spark, found), every=4, rows=60, queries=20) == brute(found, 4, 5)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    found = vectors(40, 3, 5) + [
        (100, None), (50, []), (150, [1.0, nan, 0.0]), (200, [inf, 0.0, 0.0]), (250, [1.0, None, 0.0]), (300, [0.0, 0.0, 0.0]), (350, [0.5]), (None, [0.25, 0.25, 0.25]),
        (0, [1.0, 0.0, 0.0]), (0, [1.0, 0.0, 0.0]), (400, [1e-3, -1e-3, 0.0]), (450, [1000.0, -1000.0, 3.0]),
    ]
    assert got(table(spark, found), every=50) == brute(found, 50, 5)


def test_copies_of_one_vector(spark):
    found = [(i, [0.5, 0.5]) for i in range(300)] + vectors(60, 2, 9) + [(i, [0.0, 0.0]) for i in range(400, 480)]
    found = [(i, e) for i, e in found]
    assert got(table(spark, found), every=10, rows=50, queries=16) == brute(found, 10, 5)


def test_fewer_than_k_and_none(spark):
    assert got(table(spark, [])) == []
    assert got(table(spark, [(0, [1.0])])) == []
    assert got(table(spark, [(1, [1.0]), (3, [2.0])])) == []
    assert got(table(spark, [(0, [1.0]), (3, [2.0])])) == [(0, 1, 3, 256 * 512)]


def test_vectors_not_needed_are_not_sent(spark):
    found = vectors(600, 6, 3, centres=20)
    data = op.integer_vectors(table(spark, found)).selectExpr("id", "v")
    at = next(i for i, e in found)
    pivots = np.array([whole(found[at][1])])
    least = int((pivots[0] ** 2).sum() * 0.98)
    sent = op._needed(data, pivots, [(0, 0.0, least)], {0: 7}).collect()
    for r in sent:
        assert (r.groups == [7]) == (sum(x * y for x, y in zip(r.v, pivots[0], strict=True)) >= least - 1)
    assert 0 < sum(bool(r.groups) for r in sent) < 300


def test_products_are_exact():
    a = np.array([[2**31, 3], [-(2**31), 2**20]])
    assert op.products(a, a).tolist() == [[2**62 + 9, -(2**62) + 3 * 2**20], [-(2**62) + 3 * 2**20, 2**62 + 2**40]]
    with pytest.raises(OverflowError):
        op.products(a * 4, a)


def test_ties_go_to_lower_columns():
    s = np.array([[5, 7, 7, 7, 1], [0, 0, 0, 0, 0]])
    rows, columns = op.best(s, np.array([-9, -9]), 2)
    assert list(zip(rows.tolist(), columns.tolist(), strict=True)) == [(0, 1), (0, 2), (1, 0), (1, 1)]
    rows, columns = op.best(s, np.array([7, 1]), 4)
    assert columns.tolist() == [1, 2, 3]


def test_short_lists_are_padded():
    lists = pa.array([[1], [], [1, 2]], pa.list_(pa.int64()))
    assert op.matrix(lists, 2).tolist() == [[1, 0], [0, 0], [1, 2]]
    assert op.matrix(lists.slice(1, 2), 2).tolist() == [[0, 0], [1, 2]]
