"""Totals that a long doesn't hold."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from spanforge.operators import gaps, ordered, stats
from spanforge.schema import SPANS
from spanforge.streaming import live

BIG = 1 << 62


@pytest.fixture(scope="module")
def spans(spark):
    rows = [("r", i, "0", "0", "t", True, i, i, "a" if i % 3 else "b", "kernel", i, BIG + i, BIG + 2 * i, '{"occupancy":{"limitingFactors":"WARPS"}}') for i in range(9)]
    return spark.createDataFrame(rows, SPANS).repartition(3)


@pytest.fixture(params=["small", "large"])
def way(request, monkeypatch):
    if request.param == "large":
        monkeypatch.setattr(ordered, "SMALL_BYTES", 0)


def total(k=range(9)):
    return sum(BIG + i for i in k)


def test_statistics_of_large_totals(spans, way):
    a, b = total(i for i in range(9) if i % 3), total(range(0, 9, 3))
    assert {r.name: r.total_ns for r in stats.kernel_stats(spans).collect()} == {"a": Decimal(a), "b": Decimal(b)}
    assert [r.name for r in stats.sorted_stats(stats.kernel_stats(spans)).collect()] == ["a", "b"]
    d2 = {r.name: r for r in stats.selection_stats(spans).collect()}
    assert d2["a"].total_ns == a and d2["a"].mean_ns == pytest.approx(a / 6) and d2["b"].share_pct == pytest.approx(100 * b / (a + b))
    bar = {r.name: r for r in stats.proportional_bar(stats.kernel_stats(spans)).collect()}
    assert bar["b"].start == pytest.approx(a / (a + b)) and bar["b"].share == pytest.approx(b / (a + b))
    assert {r.name: r.mean_ns for r in stats.histogram_header(spans).collect()}["a"] == pytest.approx(a / 6)
    assert sum(r.total_ns for r in stats.time_by_family(spans).collect()) == total()
    assert sum(r.total_ns for r in stats.occupancy_breakdown(spans).collect()) == total()


def test_totals_that_fit_stay_longs(spans, way):
    one = spans.filter("seq = 3")
    for df in (stats.kernel_stats(one), stats.selection_stats(one), stats.time_by_family(one), stats.occupancy_breakdown(one)):
        assert dict(df.dtypes)["total_ns"] == "bigint" and df.first().total_ns == BIG + 3
    # each fits, the sum of all doesn't
    each = spans.withColumn("name", F.col("seq").cast("string"))
    assert dict(stats.selection_stats(each).dtypes)["total_ns"] == "bigint"
    assert sum(r.share_pct for r in stats.selection_stats(each).collect()) == pytest.approx(100)
    assert sum(r.share for r in stats.proportional_bar(stats.kernel_stats(each)).collect()) == pytest.approx(1)


def test_gap_totals(spark):
    g = spark.range(5).select(F.lit(BIG).alias("gap_ns"))
    assert gaps.gap_totals(g).first().asDict() == {"gaps": 5, "idle_ns": Decimal(5 * BIG)}
    few = gaps.gap_totals(g.limit(1))
    assert few.first().idle_ns == BIG and dict(few.dtypes)["idle_ns"] == "bigint"
    assert gaps.gap_totals(g.limit(0)).first().asDict() == {"gaps": 0, "idle_ns": 0}


def test_live_totals(spans):
    assert sum(r.total_ns for r in live.live_stats(spans).collect()) == total()
