"""Hand-made cases of the span operators. Times are in microseconds here, nanoseconds in the tables."""

import math
import random
import statistics

import pytest

from spanforge.functions.steps import step_batch
from spanforge.functions.text import build_ref, duration_text, kernel_base_name, kernel_family, matches_build, mesh_text, occupancy_limit, rank_of_label
from spanforge.operators import clocks, gaps, intervals, lanes, links, ordered, select, seqdiff, stats, steps, tracks
from spanforge.fixtures import spans_of_events
from spanforge.schema import FLOWS, SPANS, Bundle
from spanforge.storage import materialize
from pyspark.sql import functions as F


def table(spark, rows):
    """rows: (rank, tid, gpu, [(ts, dur, name, cat)]) with args as an optional fifth item."""
    out = []
    for rank, tid, gpu, spans in rows:
        for ts, dur, name, cat, *args in spans:
            n = len(out)
            label = (f"Rank {rank} " if rank is not None else "") + ("GPU " if gpu else "Thread ") + tid
            out.append(("r", rank, "0", tid, label, gpu, n, n, name, cat, round(ts * 1000), round(dur * 1000), round((ts + dur) * 1000), args[0] if args else None))
    return spark.createDataFrame(out, SPANS)


def k(*spans):
    return [(a, b - a, name, "kernel") for a, b, name in spans]


def one(spark, spans):
    return table(spark, [(0, "1", True, spans)])


# ---- statistics


def test_kernel_stats(spark):
    (r,) = stats.kernel_stats(one(spark, [(0, 30, "a", "kernel"), (50, 10, "a", "kernel"), (90, 20, "a", "kernel")])).collect()
    assert (r["count"], r.total_ns, r.median_ns, r.max_ns, r.min_ns) == (3, 60_000, 20_000.0, 30_000, 10_000)


@pytest.mark.parametrize(("durs", "want"), [([4, 1, 3, 2], 2500.0), ([5, 5, -1, -1], 2000.0), ([], 0.0)])
def test_median(spark, durs, want):
    assert stats.grand_median(one(spark, [(i, d, "a", "kernel") for i, d in enumerate(durs)])).first().median_ns == want


@pytest.mark.parametrize(("durs", "bins", "want"), [([0, 25, 50, 75, 100], 4, [1, 1, 1, 2]), ([5, 5, 5], 8, [3] + [0] * 7)])
def test_histogram(spark, durs, bins, want):
    h = stats.duration_histogram(one(spark, [(i, d, "a", "kernel") for i, d in enumerate(durs)]), bins)
    assert [r.n for r in h.orderBy("bin").collect()] == want
    assert stats.duration_histogram(one(spark, []), 4).count() == 0


def test_medians_of_large_groups(spark, monkeypatch):
    r = random.Random(3)
    rows = [(i, r.choice([0, 1, r.randint(1, 40), r.randint(900, 1100), r.randint(1, 10**9)]), r.choice("aaab"), "kernel") for i in range(700)]
    rows += [(800, 7, "one", "kernel"), (801, 5, "two", "kernel"), (802, 6, "two", "kernel")]
    s = materialize(one(spark, rows), "spans")
    s = s.withColumn("name", F.when(F.col("name") != "b", F.col("name")))  # a null name is a group
    s = s.unionByName(s.filter("name = 'a'")).withColumn("dur_ns", F.when(F.col("ts_ns") != 802000, F.col("dur_ns")))

    def found():
        return [sorted(map(str, f.collect())) for f in (stats.kernel_stats(s), stats.kernel_stats(s, ["rank", "name"]), stats.selection_stats(s), stats.grand_median(s), stats.grand_median(s.limit(0)), stats.histogram_header(s), stats.kernel_stats(s.limit(0)))]

    plain = found()
    monkeypatch.setattr(ordered, "SMALL_BYTES", -1)
    assert found() == plain
    want = {}
    for x in s.collect():
        want.setdefault(x.name, []).append(x.dur_ns)
    for x in stats.kernel_stats(s).collect():
        known = [d for d in want[x.name] if d is not None]
        assert (x["count"], x.median_ns, x.total_ns) == (len(want[x.name]), statistics.median(known), sum(known))
    top = stats.kernel_stats(s)._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in top


def test_upper_median_and_percentile(spark):
    s = one(spark, [(i, d, "a", "kernel") for i, d in enumerate([1, 2, 3, 4])] + [(9, 1, "b", "kernel")])
    (r,) = stats.histogram_header(s).collect()
    assert (r.name, r.upper_median_ns) == ("a", 3000)
    h = stats.duration_histogram(one(spark, [(i, d, "a", "kernel") for i, d in enumerate([0, 25, 50, 75, 100])]), 4)
    assert stats.duration_percentile(h, 50_000).first().percentile == pytest.approx(40.0)


def test_heat(spark):
    s = one(spark, [(i * 20, 10, "a", "kernel") for i in range(100)] + [(5000, 1e6, "b", "kernel"), (5000, 1e8, "c", "gpu_user_annotation")])
    b = stats.heat_bounds(s).first()
    assert b.lo <= 1 and b.hi == pytest.approx(6)
    assert tuple(stats.heat_bounds(one(spark, [])).first()) == (0.0, 1.0)
    assert tuple(stats.heat_bounds(s, approximate=True).first()) == pytest.approx(tuple(b))
    h = {r.span_id: r.heat for r in stats.heat_score(s).collect()}
    assert h[100] == pytest.approx(1) and h[0] == pytest.approx(0)


def test_selection_stats(spark):
    s = one(spark, k((0, 10, "a"), (5, 10, "b")))
    plain = {r.name: r for r in stats.selection_stats(s).collect()}
    assert plain["a"].share_pct == pytest.approx(100 * 10 / 15) and plain["b"].first_ns == 5000
    shared = {r.name: r.total_ns for r in stats.selection_stats(s, overlap=True).collect()}
    assert shared == {"a": 7500.0, "b": 2500.0}
    bar = stats.proportional_bar(stats.kernel_stats(s)).orderBy("start").collect()
    assert [(r.name, round(r.start, 3)) for r in bar] == [("a", 0.0), ("b", 0.667)]


def test_overview_and_slowest(spark):
    s = table(spark, [(0, "1", True, k((0, 9, "a"))), (1, "1", True, k((0, 5, "a"), (6, 20, "b"))), (None, "3", False, [(1, 1, "c", "cpu_op")])])
    assert tuple(stats.overview(s).first()) == (4, 3, 2, 20_000)
    assert [r.name for r in stats.slowest(s, 2).collect()] == ["b", "a"]


def test_compare(spark):
    a, b = one(spark, k((0, 10, "x"), (20, 30, "y"))), one(spark, k((0, 15, "x"), (20, 30, "z")))
    got = {r.name: (r.total_a, r.total_b, r.delta_pct) for r in stats.compare_stats(a, b).collect()}
    assert got == {"x": (10_000, 15_000, 50.0), "y": (10_000, 0, -100.0), "z": (0, 10_000, None)}


# ---- intervals


def brute_union(iv):
    total, last = 0, -math.inf
    for a, b in sorted(iv):
        total += max(0, b - max(a, last))
        last = max(last, b)
    return total


def some_spans(seed, n, ranks=3, names=4):
    r = random.Random(seed)
    return [(i % ranks, "1", True, [(r.randrange(0, 400), r.randrange(1, 30), f"n{r.randrange(names)}", "kernel") for _ in range(n)]) for i in range(ranks)]


@pytest.mark.parametrize("bucket", [None, 50_000])
def test_union_islands_and_shared_time(spark, bucket):
    rows = some_spans(5, 40)
    s = table(spark, rows)
    want = {rank: brute_union([(round(a * 1000), round((a + d) * 1000)) for a, d, *_ in sp]) for rank, _, _, sp in rows}
    assert {r["rank"]: r.busy_ns for r in intervals.union_length(s, ["rank"], bucket).collect()} == want
    b = intervals.island_bounds(s, ["rank"], bucket).collect()
    assert {k_: sum(r.end_ns - r.ts_ns for r in b if r["rank"] == k_) for k_ in want} == want
    # conservation: the shares add up to the busy time
    shares = {r.name: r.shared_ns for r in intervals.shared_time(s, bucket_ns=bucket).collect()}
    assert sum(shares.values()) == pytest.approx(sum(want.values()))
    sweep = dict.fromkeys(shares, 0.0)
    for _, _, _, sp in rows:
        cuts = sorted({t for a, d, *_ in sp for t in (a, a + d)})
        for x, y in zip(cuts, cuts[1:], strict=False):
            active = {n for a, d, n, _ in sp if a <= x and a + d >= y}
            for n in active:
                sweep[n] += (y - x) * 1000 / len(active)
    assert shares == pytest.approx(sweep)


def test_shared_time_by_hand(spark):
    two = table(spark, [(0, "1", True, k((0, 10, "a"), (0, 20, "b"))), (1, "1", True, k((0, 10, "a")))])
    assert {r.name: r.shared_ns for r in intervals.shared_time(two).collect()} == {"a": 15_000.0, "b": 15_000.0}


def test_peak_and_running_max(spark):
    s = one(spark, k((0, 10, "a"), (5, 15, "b"), (10, 12, "c"), (11, 13, "d")))
    assert intervals.peak_concurrency(s, ["rank"]).first().peak == 3
    assert [r.max_dur_ns for r in intervals.running_max_dur(s, ["rank"]).orderBy("seq").collect()] == [10_000] * 4


# ---- gaps


def found(spark, rows, **kw):
    return [(r.t0 / 1000, r.t1 / 1000, r.prev_name, r.next_name) for r in gaps.idle_gaps(table(spark, rows), **kw).collect()]


def test_gaps(spark):
    assert found(spark, [(0, "1", True, k((0, 10, "a"), (30, 40, "b")))]) == [(10, 30, "a", "b")]
    assert found(spark, [(0, "1", True, k((0, 10, "a"), (10.5, 40, "b")))]) == []
    assert found(spark, [(0, "1", True, k((0, 10, "a"), (30, 40, "b"))), (0, "2", True, k((10, 25, "c")))]) == [(25, 30, "c", "b")]
    hole = k((0, 10, "a"), (30, 40, "b"))
    assert found(spark, [(0, "1", True, [*hole, (5, 30, "note", "gpu_user_annotation")])]) == [(10, 30, "a", "b")]
    assert found(spark, [(0, "1", True, [*hole, (5, 30, "copy", "gpu_memcpy")])]) == []


@pytest.mark.parametrize(("w", "want"), [((20, 35), [(20, 35)]), ((5, 15), [(10, 15)]), ((49.5, 60), []), ((70, 90), [])])
def test_gap_windows(spark, w, want):
    rows = [(0, "1", True, k((0, 10, "a"), (50, 60, "b")))]
    assert [g[:2] for g in found(spark, rows, w=(round(w[0] * 1000), round(w[1] * 1000)))] == want


def test_gap_scopes_and_top(spark):
    rows = [(r, "1", True, k((0, 10, "a"), (50, 60, "b"))) for r in (0, 1)]
    s = table(spark, rows)
    assert gaps.idle_gaps(s, scopes=[1]).count() == 1 and gaps.idle_gaps(s, scopes=[]).count() == 0
    t, spans = 0, [(0, 1, "k", "kernel")]
    for i in range(1, 601):
        t += 1 + i
        spans.append((t, 1, "k", "kernel"))
    g = gaps.idle_gaps(one(spark, spans)).collect()
    assert [r.gap_ns for r in g] == [1000 * i for i in range(600, 100, -1)]
    assert tuple(gaps.gap_totals(gaps.all_gaps(one(spark, spans))).first()) == (600, 1000 * 600 * 601 // 2)
    b = gaps.all_gaps(one(spark, spans), bucket_ns=700_000).collect()
    assert sorted(b) == sorted(gaps.all_gaps(one(spark, spans)).collect())


def test_gap_explanations(spark):
    gpu = (0, "1", True, k((0, 10, "a"), (30, 40, "b")))
    cpu = (0, "7", False, [(5, 27, "outer", "cpu_op"), (12, 4, "inner", "cpu_op"), (20, 5, "launch", "cuda_runtime"), (0, 90, "py", "python_function")])
    s = table(spark, [gpu, cpu])
    r = gaps.explain_gaps(gaps.idle_gaps(s), s).first()
    assert (r.cpu_busy_frac, r.runtime_frac, r.has_cpu, r.cause) == (1.0, 0.25, True, "host-bound")
    assert [(x.name, x.launches, x.covered_ns) for x in r.cpu_top] == [("outer", 1, 20_000), ("launch", 1, 5_000), ("inner", 1, 4_000)]
    s = table(spark, [gpu, (0, "7", False, [(10, 8, "x", "cuda_runtime"), (20, 6, "y", "cuda_driver")])])
    r = gaps.explain_gaps(gaps.idle_gaps(s), s).first()
    assert (r.cpu_busy_frac, r.runtime_frac, r.cause) == (0.7, 0.7, "runtime-bound")
    s = table(spark, [gpu])
    assert gaps.explain_gaps(gaps.idle_gaps(s), s).first().cause == "no CPU data"
    s = table(spark, [gpu, (0, "7", False, [(10, 2, "x", "cpu_op")])])
    assert gaps.explain_gaps(gaps.idle_gaps(s), s).first().cause == "starved"


def test_idle_summary(spark):
    s = table(spark, [(0, "1", True, k((10, 20, "a"), (50, 60, "b"))), (0, "2", True, k((12, 18, "c")))])
    r = gaps.idle_summary(s, (0, 100_000)).first()
    assert (r.t0, r.t1, r.busy_ns, r.idle_ns, r.idle_pct) == (10_000, 60_000, 20_000, 30_000, 60.0)


# ---- lanes


def brute_lanes(iv):
    ends, out = [], []
    for a, b in iv:
        lane = next((i for i, e in enumerate(ends) if e <= a), len(ends))
        if lane == len(ends):
            ends.append(0)
        ends[lane] = b
        out.append(lane)
    return out


@pytest.mark.parametrize("bucket", [None, 60_000])
def test_lanes_equal_first_fit(spark, bucket):
    s = table(spark, some_spans(3, 120, ranks=2))
    got = lanes.lanes(s, bucket_ns=bucket).collect()
    peak = {r["rank"]: r.peak for r in intervals.peak_concurrency(s, ["rank"]).collect()}
    for rank in (0, 1):
        own = sorted((r for r in got if r["rank"] == rank), key=lambda r: (r.ts_ns, r.seq))
        assert [r.lane for r in own] == brute_lanes([(r.ts_ns, r.end_ns) for r in own])
        assert max(r.lane for r in own) + 1 == peak[rank]


def test_merged_rows_leave_out_grandparents(spark):
    nested = k((0, 100, "root"), (10, 90, "child"), (20, 30, "leaf"), (200, 210, "lone"))
    s = table(spark, [(0, "1", True, nested), (0, "2", True, k((5, 50, "other")))])
    got = {r.name: r.lane for r in lanes.merged_rows(s).collect()}
    assert got == {"other": 0, "child": 1, "leaf": 2, "lone": 0}
    hidden = spark.createDataFrame([("other",)], "name string")
    assert {r.name: r.lane for r in lanes.merged_rows(s, hidden).collect()} == {"child": 0, "leaf": 1, "lone": 0}


# ---- selection


def test_select_and_search(spark):
    s = lanes.lanes(table(spark, [(0, "1", True, k((0, 10, "Alpha"), (5, 20, "beta"), (20, 30, "alphabet"))), (0, "9", False, [(0, 5, "cpu alpha", "cpu_op")])]))
    names = lambda df: sorted(r.name for r in df.collect())
    assert names(select.select(s, (10_000, 15_000))) == ["Alpha", "beta"]
    assert names(select.select(s, (10_001, 19_999))) == ["beta"]
    assert names(select.select(s, (0, 25_000), lanes=(1, 1))) == ["beta"]
    assert names(select.select(s, (0, 25_000), lanes=(1, 1), merged=True)) == ["Alpha", "beta"]
    assert names(select.select(s, gpu_only=False, name="cpu alpha")) == ["cpu alpha"]
    assert names(select.select(s, hidden=spark.createDataFrame([("beta",)], "name string"))) == ["Alpha", "alphabet"]
    assert names(select.matching_names(s, "  ALPHA ")) == ["Alpha", "alphabet", "cpu alpha"] and names(select.matching_names(s, " ")) == []
    hits = select.search(s, "alpha").orderBy("ts_ns", "seq").collect()
    assert [(r.previous, r.following) for r in hits] == [(None, hits[1].span_id), (hits[0].span_id, hits[2].span_id), (hits[1].span_id, None)]
    assert select.match_count(stats.kernel_stats(s), "alpha").first().matches == 3
    assert [r.line for r in select.export_lines(s.filter("gpu")).orderBy("ts_ns").collect()] == ["Alpha (10.0us)", "beta (15.0us)", "alphabet (10.0us)"]


def test_downsample(spark):
    s = one(spark, [(0, 500, "wide", "kernel"), (601, 1, "a", "kernel"), (603, 1, "b", "kernel"), (711, 1, "c", "kernel")])
    got = select.downsample(s, (0, 1_000_000), 10, ["rank", "tid"]).collect()
    assert sorted(r.name for r in got) == ["a", "c", "wide"]


# ---- names and labels


def test_text(spark):
    col = lambda f, *xs: [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x string").select(f(F.col("x"))).collect()]
    assert col(rank_of_label, "Rank 12 GPU 3", "  Rank 3 stream", "Rank 3", "GPU 1") == [12, 3, None, None]
    assert col(kernel_base_name, "void a::b::Fused<c10::BFloat16, 0>(args)", "plain_kernel", "ns::f(int)") == ["Fused", "plain_kernel", "f"]
    assert col(kernel_family, "aten::mm", "void at::native::x<1>", "fmhaSm100fKernel_Q", "Kernel", "mine") == ["torch", "torch", "external", "generic", "other"]
    args = ['{"shared memory":1024,"occupancy":{"limitingFactors":"WARPS"}}', '{"shared memory":180000,"occupancy":{"limitingFactors":"SMEM"}}', None]
    assert [tuple(x) for x in col(occupancy_limit, *args)] == [("WARPS", False), ("SMEM", True), (None, False)]
    refs = col(build_ref, "0.26.1rc1.dev528+g1a2b3c4d5e6f", "0.33.0rc1.dev573+llmd.cfee12e985dc6f4f74fd", "0.33.0rc1.dev573", "0.11.0", "0.33.0rc1", "", "unknown")
    assert [r and tuple(r) for r in refs] == [("commit", "1a2b3c4d5e6f", None), ("dev", "0.33.0rc1", 573), ("dev", "0.33.0rc1", 573), ("tag", "v0.11.0", None), ("tag", "v0.33.0rc1", None), None, None]
    assert col(lambda x: matches_build(build_ref(x), F.lit("v0.33.0rc0-573-gcfee12e")), "0.33.0rc1.dev573", "0.11.0") == [True, False]
    ns = spark.createDataFrame([(0,), (500,), (42_700,), (1_500_000,), (2_500_000_000,)], "x long")
    assert [r[0] for r in ns.select(duration_text(F.col("x"))).collect()] == ["0", "500ns", "42.7us", "1.50ms", "2.500s"]
    mesh = spark.createDataFrame([("x/dp0_pp0_tp3_dcp0_ep3_rank3.1.json", 3, 32), ("dp1_dcp2.json", None, None), ("t.json", 1, None)], "p string, r int, w int")
    assert [r[0] for r in mesh.select(mesh_text(F.col("r"), F.col("w"), F.col("p"))).collect()] == ["rank 3/32 · tp3 pp0 dp0 ep3", "dp1 dcp2", "rank 1"]


def test_step_names(spark):
    names = ["execute_context_1(4)_generation_2(3)", "execute_512_context_1(sq512sk600sqsq9sqsk8)_generation_0(sq0sk0)", "execute_0_context_1(sq5)_generation_1(sq2sk7)", "execute_9_context_1(5)_generation_1(2)"]
    bad = ["execute_context_x(4)_generation_1(1)", "execute_context_1(4)_generation_1(1", "other"]
    got = [r[0] and tuple(r[0]) for r in spark.createDataFrame([(x,) for x in names + bad], "x string").select(step_batch(F.col("x"))).collect()]
    assert got == [(7, 1, 2, 4, None, 3, None), (512, 1, 0, 512, 600, 0, 0), (7, 1, 1, 5, None, 2, 7), (9, 1, 1, 5, None, 2, None), None, None, None]


# ---- steps

NAME = "execute_context_0(0)_generation_1({})"


def step_table(spark, rows, runs=()):
    s = table(spark, rows)
    return s, tracks.classify_tracks(s), spark.createDataFrame(list(runs), "run string, rank int, path string")


def ann(*iv, n=1):
    return [(a, b - a, NAME.format(n), "gpu_user_annotation") for a, b in iv]


def test_steps(spark):
    iv = [(0, 10), (20, 30), (40, 50)]
    rows = [(0, "1", True, ann(*iv) + k((1, 3, "k"), (21, 23, "k"))), (1, "1", True, ann(*[(a + 5, b + 5) for a, b in iv]) + k((6, 8, "k")))]
    got = steps.steps(*step_table(spark, rows)).orderBy("step").collect()
    assert [(r.t0, r.t1, r.n_ranks) for r in got] == [(0, 15_000, 2), (20_000, 35_000, 2), (40_000, 55_000, 2)]
    assert [r.kernel_count for r in got] == [2, 1, 0] and [r.idle_before_ns for r in got] == [0, 5_000, 5_000]
    assert got[0].batch.total_tokens == 1 and got[0].group_batches is None


def test_reference_prefers_whole_streams(spark):
    part = [(0, str(i), True, ann((10, 12), (130, 140))) for i in range(2, 8)]
    s, t, runs = step_table(spark, [*part, (0, "9", True, ann((0, 100), (120, 390)))])
    got = steps.steps(s, t, runs).orderBy("step").collect()
    assert [(r.t0, r.t1) for r in got] == [(0, 100_000), (120_000, 390_000)]


def test_gpu_time_is_the_median_of_unions(spark):
    rows = [(r, str(j), True, ann((0, u))) for r, u in ((0, 30), (1, 30), (2, 50)) for j in (1, 2)]
    assert steps.steps(*step_table(spark, rows)).first().gpu_ns == 30_000.0


def test_batches_of_groups_are_summed(spark):
    runs = [("r", r, f"dp{r // 2}_tp{r % 2}.json") for r in range(4)]
    rows = [(r, "1", True, [(0, 10, f"execute_5_context_0(sq0sk0)_generation_1(sq{1 + 2 * (r // 2)}sk{20 + r // 2})", "gpu_user_annotation")]) for r in range(4)]
    r = steps.steps(*step_table(spark, rows, runs)).first()
    assert (r.batch.total_tokens, r.batch.n_gen, r.batch.gen_tokens, r.batch.gen_kv, len(r.group_batches)) == (10, 2, 4, 41, 2)


def test_host_annotations_without_device_ones(spark):
    rows = [(0, "1", False, [(a, 5, NAME.format(1), "user_annotation") for a in (0, 10)])]
    assert steps.steps(*step_table(spark, rows)).count() == 2


# ---- links


def launch_table(spark, rows):
    s = table(spark, rows)
    return tracks.with_tracks(s, tracks.classify_tracks(s), "track_idx")


def test_launches(spark):
    arg = '{"External id": 7, "correlation": 42}'
    rows = [
        (0, "1", True, [(100, 5, "Kernel", "kernel", arg)]),
        (0, "8", False, [(50, 5, "op", "cpu_op", '{"External id": 7}'), (60, 5, "launchKernel", "cuda_runtime", '{"correlation": 42}'), (5, 1, "early", "cuda_runtime", '{"correlation": 42}'), (200, 1, "late", "cuda_runtime", '{"correlation": 42}')]),
        (1, "8", False, [(90, 5, "decoy", "cuda_runtime", '{"correlation": 42}')]),
    ]
    s = launch_table(spark, rows)
    (r,) = links.launch_links(s).collect()
    names = {x.span_id: x.name for x in s.collect()}
    assert (r.op, names[r.at_id], r.graph) == ("op", "launchKernel", False)
    rows[1][3][1] = (60, 5, "cudaGraphLaunch", "cuda_runtime", '{"correlation": 42}')
    assert links.launch_links(launch_table(spark, rows)).first().graph


def test_frames(spark):
    rows = [
        (0, "1", True, [(100, 5, "Kernel", "kernel", '{"correlation": 42}')]),
        (0, "8", False, [(60, 5, "launch", "cuda_runtime", '{"correlation": 42}'), (0, 90, "pkg/outer.py(10): f", "python_function"), (50, 20, "g(pkg/inner.py:20)", "python_function"), (55, 12, "<built-in launch>", "python_function"), (58, 9, "/abs/x.py(3): h", "python_function")]),
    ]
    s = launch_table(spark, rows)
    r = links.launch_frames(links.launch_links(s), s).first()
    assert (r.file, r.line) == ("pkg/inner.py", 20)
    files = spark.createDataFrame([("pkg/outer.py",)], "path string")
    assert links.launch_frames(links.launch_links(s), s, files).first().line == 10


def test_flows(spark):
    flows = spark.createDataFrame([("r", 0, 5, "0", "8", 10_000, True), ("r", 0, 5, "0", "1", 40_000, False), ("r", 0, 5, "0", "1", 40_000, False), ("r", 0, None, "0", "1", 1, True)], "run string, rank int, flow_id long, pid string, tid string, ts_ns long, is_start boolean")
    pairs = links.pair_flows(flows)
    assert sorted((r.src_tid, r.src_ts, r.dst_tid, r.dst_ts) for r in pairs.collect()) == [("1", 40_000, "8", 10_000), ("8", 10_000, "1", 40_000)]
    s = lanes.lanes(table(spark, [(0, "8", False, [(5, 30, "outer", "cpu_op"), (12, 10, "inner", "cpu_op"), (14, 2, "innermost", "cpu_op")]), (0, "1", True, k((40, 50, "kernel")))]))
    got = {r.span_id: (r.at_id, r.dst_id) for r in links.flows_of(s.filter("not gpu"), pairs, s).collect()}
    assert got == {0: (0, 3), 1: (0, 3), 2: (0, 3)}


def test_flows_of_a_deep_nest(spark):
    n = 67
    nest = [(5 + i, 400 - 2 * i, f"f{i}", "cpu_op") for i in range(n)]
    s = lanes.lanes(table(spark, [(0, "8", False, nest)])).coalesce(1).cache()
    flow = spark.createDataFrame([("r", 0, 5, "0", "8", 5_000, "0", "1", 900_000)], "run string, rank int, flow_id long, src_pid string, src_tid string, src_ts long, dst_pid string, dst_tid string, dst_ts long")
    deepest = s.filter(F.col("name") == f"f{n - 1}")
    assert deepest.first().lane == n - 1
    assert [r.at_id for r in links.flows_of(deepest, flow, s).collect()] == [0]


# ---- sequence diff


def lines(a, b):
    return [(kind, a[i] if i is not None else b[j]) for kind, i, j in seqdiff.align(a, b)]


def test_align():
    assert lines(["m", "n"], ["m", "s", "n"]) == [("same", "m"), ("added", "s"), ("same", "n")]
    assert [x[0] for x in lines(list("XYZ"), list("XQYZ"))] == ["same", "added", "same", "same"]
    assert [x[0] for x in lines(list("XQYZ"), list("XYZ"))] == ["same", "removed", "same", "same"]
    assert [x[0] for x in lines(["a"], ["b"])] == ["removed", "added"]
    assert lines([], ["b"]) == [("added", "b")] and lines(["a"], []) == [("removed", "a")]
    far = ["a"] + ["x"] * 198 + ["t"], ["t"] + ["y"] * 200
    assert lines(*far)[0][0] == "removed" and [x[0] for x in lines(["a"] + ["x"] * 199 + ["t"], ["t"])][:2] == ["removed", "added"]


def test_diff_replays_both_sides(spark):
    r = random.Random(4)
    a = [(i * 10, 5, r.choice("abcde"), "kernel") for i in range(60)]
    b = [(i * 10, 7, n, "kernel") for i, (_, _, n, _) in enumerate(x for x in a if r.random() < 0.8)]
    d = seqdiff.sequence_diff(one(spark, a), one(spark, b), ["rank"])
    rows = d.orderBy("line").collect()
    assert [x.name for x in rows if x.dur_a is not None] == [x[2] for x in a] and [x.name for x in rows if x.dur_b is not None] == [x[2] for x in b]
    t = seqdiff.diff_totals(d).first()
    assert (t.count_a, t.count_b, t.total_a) == (60, len(b), 300_000)
    seg = seqdiff.diff_segments(d, ["rank"]).orderBy("segment").collect()
    assert sum(s.n for s in seg) == len(rows) and all(x.kind != "changed" or y.kind != "changed" for x, y in zip(seg, seg[1:], strict=False))


def plain_align(a, b, reach=200):
    """By searching both lists, which are whole."""
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append(("same", i, j))
            i, j = i + 1, j + 1
            continue
        skip_b = next((k for k in range(1, reach) if j + k < len(b) and b[j + k] == a[i]), None)
        skip_a = next((k for k in range(1, reach) if i + k < len(a) and a[i + k] == b[j]), None)
        if skip_a is None and skip_b is None:
            out += [("removed", i, None), ("added", None, j)]
            i, j = i + 1, j + 1
        elif skip_a is None or (skip_b is not None and skip_b <= skip_a):
            out += [("added", None, j + k) for k in range(skip_b)]
            j += skip_b
        else:
            out += [("removed", i + k, None) for k in range(skip_a)]
            i += skip_a
    return out + [("removed", k, None) for k in range(i, len(a))] + [("added", None, k) for k in range(j, len(b))]


def test_streamed_diff_is_that_of_whole_lists(spark):
    r = random.Random(8)
    rows_a, rows_b, want = [], [], {}
    for rank in range(5):
        a = [r.choice("abcdefgh") + str(r.randrange(1 + 40 * (rank % 3))) for _ in range(900)]
        b = [x for x in a if r.random() < 0.9]
        if rank == 1:
            b = b[:100]
        if rank == 2:
            b = [f"new{i}" for i in range(1500)] + b
        if rank == 3:
            a, b = b[:3], a
        want[rank] = [(kind, a[i] if i is not None else b[j], i, j) for kind, i, j in plain_align(a, b)]
        rows_a.append((rank, "1", True, [(i, 0.001 * i, x, "kernel") for i, x in enumerate(a)]))
        rows_b.append((rank, "1", True, [(i, 0.001 * i, x, "kernel") for i, x in enumerate(b)]))
    rows_a.append((7, "1", True, [(0, 0, "only", "kernel")]))
    d = seqdiff.sequence_diff(table(spark, rows_a), table(spark, rows_b), ["rank"])
    got = {}
    for x in d.orderBy("rank", "line").collect():
        got.setdefault(x["rank"], []).append((x.kind, x.name, x.dur_a, x.dur_b))
    assert got.pop(7) == [("removed", "only", 0, None)]
    assert got == want


def test_a_stream_holds_little_of_equal_sequences():
    aligner, most = seqdiff.Aligner(), 0
    for i in range(50_000):
        name = f"k{i % 300}"
        aligner.a.push(name, i)
        if i % 50:
            aligner.b.push(name, i)
        if i % 200 == 0:
            aligner.run()
            aligner.rows = []
        most = max(most, len(aligner.a.lines))
    assert most < 2_000 and aligner.a.at > 48_000


# ---- clocks and assembly


def test_clock_shifts(spark):
    mk = lambda end: [(end - 4, 4, "the marker call", "kernel"), (end + 50, 4, "the marker call", "kernel")]
    rows = [(0, "1", True, mk(100)), (1, "1", True, mk(104)), (2, "1", True, mk(130)), (3, "1", True, [(5, 5, "x", "kernel")])]
    s = table(spark, rows)
    runs = spark.createDataFrame([("r", 0, "dp0_tp0.json"), ("r", 1, "dp0_tp1.json"), ("r", 2, "dp1_tp0.json"), ("r", 3, "dp1_tp1.json")], "run string, rank int, path string")
    sh = clocks.clock_shifts(s, runs, "marker")
    assert {r["rank"]: r.shift_ns for r in sh.collect()} == {0: 30_000, 1: 30_000, 2: 0}
    moved = {(r["rank"], r.ts_ns) for r in clocks.shift_spans(s, sh).collect()}
    assert (0, 126_000) in moved and (3, 5_000) in moved
    assert sorted(tuple(r) for r in clocks.shift_summary(sh).collect()) == [("dp0", 30_000, 2), ("dp1", 0, 1)]
    with pytest.raises(ValueError, match="no rank"):
        clocks.clock_shifts(s, runs, "absent")


def test_classes_labels_and_merge(spark):
    s = table(spark, [(None, "2", True, k((5, 6, "a"), (7, 8, "b"))), (None, "3", False, [(4, 1, "x", "cpu_op"), (6, 1, "y", "kernel")])])
    t = tracks.classify_tracks(s)
    assert sorted((r.tid, r.gpu, r.track_idx) for r in t.collect()) == [("2", True, 0), ("3", False, 1)]
    names = spark.createDataFrame([("r", None, "0", "3", 1, "old"), ("r", None, "0", "3", 2, "Worker 1")], "run string, rank int, pid string, tid string, seq long, label string")
    labelled = tracks.label_tracks(t, names)
    assert sorted(r.track for r in labelled.collect()) == ["GPU 2", "Worker 1"]
    flows = spark.createDataFrame([], "run string, rank int, flow_id long, pid string, tid string, ts_ns long, is_start boolean")
    runs = spark.createDataFrame([("r", None, "p", None, None, 0)], "run string, rank int, path string, device string, version string, dist_world int")
    merged = tracks.merge_ranks([(r, Bundle(s, labelled, flows, runs)) for r in (0, 10, 2)])
    assert merged.spans.count() == 12 and merged.spans.agg({"ts_ns": "min"}).first()[0] == 0
    assert sorted({r.track for r in merged.tracks.collect()})[:2] == ["Rank 0 GPU 2", "Rank 0 Worker 1"]
    assert [r["rank"] for r in merged.tracks.select("rank").distinct().orderBy("rank").collect()] == [0, 2, 10]
    assert tuple(tracks.normalise(s).agg({"ts_ns": "min"}).first()) == (0,)


def test_large_groups_are_cut_by_their_own_quantiles(spark, monkeypatch):
    """Every query over two large ranks gives the same rows when ranks are cut into parts of 40 rows."""
    from tests.oracle import DATA, compare

    from spanforge.operators import ordered
    from spanforge.plans import queries as core

    monkeypatch.setattr(ordered, "ROWS", 40)
    monkeypatch.setattr(ordered, "SMALL_BYTES", 0)
    s = spans_of_events(spark, DATA, few_ranks=True)
    parted, any_cut = ordered.cut(s, ["rank"], "ts_ns")
    sizes = [r["count"] for r in parted.groupBy("rank", "bucket").count().collect()]
    assert any_cut and len(sizes) > 20 and max(sizes) < 80
    for name in [n for n in sorted(core.queries()) if "two_ranks" in n] + ["b6_peak", "b7_running_max", "b5_lanes", "h2_flows_of"]:
        compare(spark, core.queries(), core.oracle_sql(), name)


def test_stack_of_a_thousand(spark, monkeypatch):
    """The deepest of nested spans finds the outermost one's flow in about the logarithm of the depth."""
    n = 1000
    made = [(0, "7", False, [(i, 4 * n - 2 * i, f"f{i}", "cpu_op") for i in range(n)])]
    s = lanes.lanes(table(spark, made)).cache()
    assert s.agg({"lane": "max"}).first()[0] == n - 1
    first = s.select("run", "rank", "pid", "tid").first()
    flows = spark.createDataFrame([(first.run, first["rank"], 5, first.pid, first.tid, 0, True), (first.run, first["rank"], 5, first.pid, first.tid, 10**9, False)], FLOWS)
    rounds = []
    write = links.materialize
    monkeypatch.setattr(links, "materialize", lambda df, name, **o: (rounds.append(name), write(df, name, **o))[1])
    got = links.flows_of(s, links.pair_flows(flows), s).collect()
    assert len(got) == n and len({r.at_id for r in got}) == 1
    assert rounds.count("nearest") <= 12


def test_overlaps_in_cells_of_several_widths(spark, monkeypatch):
    """One interval that lasts for the whole run beside many short ones: all pairs, once each, and few rows."""
    from spanforge.operators import meet

    r = random.Random(5)
    intervals_of = lambda n, most: [(r.randrange(2), t, t + r.choice([0, 1, 900, 1024, 5000, r.randrange(most)])) for t in (r.randrange(3_000_000) for _ in range(n))]
    a, b = intervals_of(400, 70_000) + [(0, -5, 3_100_000)], intervals_of(300, 9_000) + [(0, 0, 4_000_000), (1, 7, 7)]
    x = spark.createDataFrame([(k, i, t0, t1) for i, (k, t0, t1) in enumerate(a)], "k int, i int, ts_ns long, end_ns long")
    y = spark.createDataFrame([(k, j, t0, t1) for j, (k, t0, t1) in enumerate(b)], "k int, j int, t0 long, t1 long")
    got = sorted((q.i, q.j) for q in meet.overlapping(x, y, ["k"]).collect())
    assert got == sorted((i, j) for i, p in enumerate(a) for j, q in enumerate(b) if p[0] == q[0] and p[1] <= q[2] and q[1] <= p[2])
    classes = F.array(*[F.lit(c) for c in range(8)])
    rows = meet._in_cells(x.withColumn("own_class", meet._class("ts_ns", "end_ns")), ("ts_ns", "end_ns"), "a", F.filter(classes, lambda c: c >= F.col("own_class")))
    assert max(q["count"] for q in rows.groupBy("i", "at_class").count().collect()) <= 2


def test_few_and_many_steps_give_the_same(spark, monkeypatch):
    r = random.Random(6)
    ref = [(i, t, t + r.choice([0, 3, 40, 200])) for i, t in enumerate(sorted(r.sample(range(9_000), 60)))]
    found = [(i, t, t + r.choice([0, 0, 1, 30, 700])) for i, t in enumerate(r.sample(range(9_500), 400))]
    ref_df = spark.createDataFrame(ref, "step int, r0 long, r1 long")
    df = spark.createDataFrame(found, "span_id long, ts_ns long, end_ns long")
    few = sorted((q.span_id, q.step) for q in steps.assign_steps(df, ref_df).collect())
    monkeypatch.setattr(steps, "FEW_STEPS", 1)
    assert few == sorted((q.span_id, q.step) for q in steps.assign_steps(df, ref_df).collect())
    want = []
    for i, t, e in found:
        shared = [(-(min(e, r1) - max(t, r0)), s) for s, r0, r1 in ref if t < r1 and e > r0 and min(e, r1) > max(t, r0)]
        want.append((i, min(shared)[1] if shared else min((abs(r0 - t) + abs(r1 - e), s) for s, r0, r1 in ref)[1]))
    assert few == want


def test_gaps_beyond_the_broadcast(spark, monkeypatch):
    from tests.oracle import compare

    from spanforge.plans import queries as core

    monkeypatch.setattr(gaps, "SMALL", 1)
    compare(spark, core.queries(), core.oracle_sql(), "f4_gap_causes")
