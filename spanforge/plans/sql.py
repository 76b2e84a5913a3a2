"""The registered span queries in SQL, for an independent engine."""

from __future__ import annotations

DAY = 86_400 * 10**9
W0, W1 = 3 * DAY, 12 * DAY


def _spans(exec_names: bool = False, few_ranks: bool = False, shorter: int = 1) -> str:
    name = "event_type || '_' || (k % 5)"
    if exec_names:
        step = "'execute_context_' || (k % 3) || '(' || k || ')_generation_' || (k % 5) || '(' || (k % 7) || ')'"
        name = f"CASE WHEN event_type = 'purchase' THEN {step} ELSE {name} END"
    rank = "user_id % 2" if few_ranks else "user_id"
    return f"""e AS (
  SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events
), s0 AS (
  SELECT 'run' AS run, CAST({rank} AS INTEGER) AS rank, event_id AS seq, event_id AS span_id, {name} AS name, k, CAST(k % 10 AS INTEGER) AS correlation,
    CASE event_type WHEN 'click' THEN 'kernel' WHEN 'view' THEN 'gpu_memcpy' WHEN 'purchase' THEN 'gpu_user_annotation' WHEN 'error' THEN 'cuda_runtime'
      ELSE CASE WHEN k < 20 THEN 'python_function' ELSE 'cpu_op' END END AS cat,
    CAST(CASE WHEN event_type IN ('click', 'view', 'purchase') THEN event_id % 2 ELSE 2 + event_id % 2 END AS VARCHAR) AS tid,
    (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) * 1000 AS ts_ns,
    CAST(round(value * 100) AS BIGINT) * {12_000_000_000 // shorter} AS dur_ns
  FROM e
), spans AS (
  SELECT *, ts_ns + dur_ns AS end_ns, tid IN ('0', '1') AS gpu FROM s0
)"""


BASE = "WITH " + _spans()
NAMED = "WITH " + _spans(exec_names=True)
TWO = "WITH " + _spans(few_ranks=True)
SHORT = "WITH " + _spans(few_ranks=True, shorter=1000)
DEEP = "WITH RECURSIVE " + _spans()
GPU = BASE + ", g AS (SELECT * FROM spans WHERE gpu)"
SEL = BASE + f", w AS (SELECT * FROM spans WHERE gpu AND end_ns >= {W0} AND ts_ns <= {W1})"
TRACKS = """, tracks AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY run ORDER BY gpu DESC, n_events DESC, rank, tid) - 1 AS INTEGER) AS track_idx
  FROM (SELECT run, rank, tid, count(*) AS n_events, count(*) FILTER (cat = 'kernel' OR starts_with(cat, 'gpu_')) > count(*) // 2 AS gpu FROM spans GROUP BY ALL)
)"""
PATHS = """, runs AS (
  SELECT DISTINCT CAST(user_id AS INTEGER) AS rank, 'dp' || (user_id % 4) || '_pp0_tp' || ((user_id // 4) % 4) || '_dcp0_ep' || user_id || '_rank' || user_id || '.json' AS path FROM events
)"""
BUSY = ", busy AS (SELECT rank AS scope, ts_ns, end_ns, seq, name FROM spans WHERE gpu AND dur_ns > 0 AND (cat = 'kernel' OR (starts_with(cat, 'gpu_') AND cat <> 'gpu_user_annotation')))"
STATS = "name, count(*) AS count, CAST(sum(dur_ns) AS BIGINT) AS total_ns, quantile_cont(dur_ns, 0.5) AS median_ns, greatest(max(dur_ns), 0) AS max_ns, min(dur_ns) AS min_ns"


def _islands(source: str, by: str, out: str = "isl") -> str:
    """Adds island to the rows of source."""
    return f""", {out}_r AS (
  SELECT *, max(end_ns) OVER (PARTITION BY {by} ORDER BY ts_ns, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source}
), {out} AS (
  SELECT *, CAST(sum(CASE WHEN reach IS NULL OR ts_ns > reach THEN 1 ELSE 0 END) OVER (PARTITION BY {by} ORDER BY ts_ns, seq) AS BIGINT) AS island FROM {out}_r
)"""


def _union(source: str, by: str, out: str, name: str) -> str:
    return f""", {out}_r AS (
  SELECT *, max(end_ns) OVER (PARTITION BY {by} ORDER BY ts_ns, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source}
), {out} AS (
  SELECT {by}, CAST(sum(greatest(0, end_ns - greatest(ts_ns, coalesce(reach, ts_ns)))) AS BIGINT) AS {name} FROM {out}_r GROUP BY {by}
)"""


GAPS = _islands("busy", "scope") + """, ends AS (
  SELECT scope, island, min(ts_ns) AS ts_ns, max(end_ns) AS end_ns, arg_min(name, struct_pack(a := ts_ns, b := end_ns, c := seq)) AS opened_by,
    arg_max(name, struct_pack(a := end_ns, b := -ts_ns, c := -seq)) AS closed_by FROM isl GROUP BY scope, island
), nxt AS (
  SELECT scope, end_ns AS t0, lead(ts_ns) OVER w AS t1, closed_by AS prev_name, lead(opened_by) OVER w AS next_name FROM ends WINDOW w AS (PARTITION BY scope ORDER BY island)
), gaps AS (SELECT scope, t0, t1, t1 - t0 AS gap_ns, prev_name, next_name FROM nxt WHERE t1 - t0 >= 1000)"""


def _shared(source: str) -> str:
    return _islands(source, "rank, name") + """, runs AS (SELECT rank, name, min(ts_ns) AS a, max(end_ns) AS b FROM isl GROUP BY rank, name, island
), org AS (SELECT rank, min(a) AS t0 FROM runs GROUP BY rank
), p AS (
  SELECT r.rank, name, a - t0 AS t, 1 AS d FROM runs r JOIN org o ON r.rank = o.rank UNION ALL SELECT r.rank, name, b - t0, -1 FROM runs r JOIN org o ON r.rank = o.rank
), p2 AS (
  SELECT *, coalesce(sum(d) OVER (PARTITION BY rank ORDER BY t, d, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k, t - lag(t) OVER (PARTITION BY rank ORDER BY t, d, name) AS dt FROM p
), p3 AS (
  SELECT *, sum(CASE WHEN k > 0 THEN CAST(dt AS DOUBLE) / k ELSE 0.0 END) OVER (PARTITION BY rank ORDER BY t, d, name ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS wt FROM p2
), shared AS (SELECT name, sum(-d * wt) AS shared_ns FROM p3 GROUP BY name)"""


def _ranks(shares: dict[str, float], of: str) -> str:
    union = " UNION ALL ".join(f"SELECT '{k}' AS which, CAST({s} AS DOUBLE) AS p" for k, s in shares.items())
    return f""", d AS (SELECT dur_ns, row_number() OVER (ORDER BY dur_ns) - 1 AS rn, count(*) OVER () AS n FROM g WHERE dur_ns > 0 AND (cat = 'kernel' OR (starts_with(cat, 'gpu_') AND cat <> 'gpu_user_annotation'))
), picks AS (SELECT which, dur_ns FROM d, ({union}) WHERE rn = floor(p * ({of})))"""


STEPS = TRACKS + """, found AS (
  SELECT s.*, t.track_idx FROM spans s JOIN tracks t ON s.rank = t.rank AND s.tid = t.tid
  WHERE starts_with(name, 'execute_') AND contains(name, '_context_') AND contains(name, '_generation_') AND cat = 'gpu_user_annotation'
), reft AS (SELECT rank, tid, track_idx, count(*) AS n, CAST(sum(dur_ns) AS BIGINT) AS total_ns FROM found GROUP BY ALL ORDER BY n DESC, total_ns DESC, track_idx LIMIT 1
), ref AS (SELECT CAST(row_number() OVER (ORDER BY ts_ns, seq) - 1 AS INTEGER) AS step, ts_ns AS r0, end_ns AS r1, name AS ref_name FROM found WHERE track_idx = (SELECT track_idx FROM reft)
), pairs AS (
  SELECT f.span_id, r.step, least(f.end_ns, r.r1) - greatest(f.ts_ns, r.r0) AS ov, abs(f.ts_ns - r.r0) + abs(f.end_ns - r.r1) AS far FROM found f, ref r
), pick AS (
  SELECT span_id, CASE WHEN max(ov) > 0 THEN arg_min(step, struct_pack(a := -ov, b := step)) ELSE arg_min(step, struct_pack(a := far, b := step)) END AS step FROM pairs GROUP BY span_id
), asg AS (SELECT f.*, p.step FROM found f JOIN pick p USING (span_id))"""
BATCH = """, parsed AS (
  SELECT name, CAST(c[1] AS BIGINT) AS n_ctx, CAST(c[2] AS BIGINT) AS ctx_tokens, CAST(c[3] AS BIGINT) AS n_gen, CAST(c[4] AS BIGINT) AS gen_tokens
  FROM (SELECT DISTINCT name, [regexp_extract(name, 'context_(\\d+)', 1), regexp_extract(name, 'context_\\d+\\((\\d+)\\)', 1), regexp_extract(name, 'generation_(\\d+)', 1), regexp_extract(name, 'generation_\\d+\\((\\d+)\\)', 1)] AS c
    FROM spans WHERE starts_with(name, 'execute_') AND contains(name, '_context_') AND contains(name, '_generation_'))
)"""
FLOWS = """, flows AS (
  SELECT rank, correlation + 100 * ((seq // 200) % 7) AS flow_id, tid, ts_ns, cat = 'cuda_runtime' AS is_start FROM spans WHERE cat IN ('kernel', 'cuda_runtime')
), there AS (SELECT a.rank, a.flow_id, a.tid AS src_tid, a.ts_ns AS src_ts, b.tid AS dst_tid, b.ts_ns AS dst_ts FROM flows a JOIN flows b ON a.rank = b.rank AND a.flow_id = b.flow_id WHERE a.is_start AND NOT b.is_start
), pairs AS (SELECT rank, flow_id, src_tid, src_ts, dst_tid, dst_ts FROM there UNION SELECT rank, flow_id, dst_tid, dst_ts, src_tid, src_ts FROM there)"""
LINKS = TRACKS + """, st AS (SELECT s.*, t.track_idx FROM spans s JOIN tracks t ON s.rank = t.rank AND s.tid = t.tid
), links AS (
  SELECT k.span_id AS kernel_id, arg_max(c.span_id, struct_pack(a := c.ts_ns, b := c.track_idx, c := c.seq)) AS at_id, false AS graph
  FROM st k JOIN st c ON k.rank = c.rank AND k.correlation = c.correlation AND k.track_idx <> c.track_idx AND c.ts_ns <= k.ts_ns
  WHERE k.gpu AND k.cat = 'kernel' AND c.cat IN ('cpu_op', 'cuda_driver', 'cuda_runtime') GROUP BY k.span_id
)"""
SHIFTS = PATHS + """, mark AS (SELECT rank, arg_min(end_ns, struct_pack(a := ts_ns, b := seq)) AS mk FROM spans WHERE contains(name, 'click_3') GROUP BY rank
), m AS (SELECT mark.rank, mark.rank % 4 AS dp, (mark.rank // 4) % 4 AS tp, mk FROM mark
), grp AS (SELECT dp, arg_min(mk, struct_pack(a := tp, b := rank)) AS ref FROM m GROUP BY dp
), shifts AS (SELECT m.rank, CAST(m.dp AS INTEGER) AS dp, (SELECT max(ref) FROM grp) - ref AS shift_ns FROM m JOIN grp USING (dp))"""
MANGLED = BASE + """, mg AS (
  SELECT * EXCLUDE (name), CASE correlation WHEN 0 THEN 'void at::native::' || name || '<float>(int)' WHEN 1 THEN 'void ns::deep::' || name || '<c10::Half, 0>(args)' WHEN 2 THEN 'fmhaSm100Kernel_' || name
    WHEN 3 THEN ' Kernel ' WHEN 4 THEN 'cub::' || name ELSE name END AS name FROM spans
), nb AS (
  SELECT *, trim(regexp_extract(regexp_extract(regexp_replace(trim(name), '^void ', ''), '^([^<(]*)', 1), '(?:.*::)?(.*)$', 1)) AS base,
    CASE WHEN regexp_matches(trim(name), '^(aten::|c10::|c10d::|void at::|void c10::|at::native::|\\(anonymous namespace\\)::at::|cub::|cutlass)') THEN 'torch'
      WHEN starts_with(trim(name), 'fmhaSm') AND contains(name, 'Kernel_') THEN 'external' WHEN trim(name) IN ('Kernel', 'kernel') THEN 'generic' ELSE 'other' END AS family FROM mg
)"""
TEXT = """CASE WHEN x = 0 THEN '0' WHEN abs(x) < 1000 THEN printf('%dns', x) WHEN abs(x) < 1000000 THEN printf('%.1fus', x / 1e3) WHEN abs(x) < 1000000000 THEN printf('%.2fms', x / 1e6) ELSE printf('%.3fs', x / 1e9) END"""
HISTOGRAM = """, edge AS (SELECT {by} min(dur_ns) AS lo, max(dur_ns) AS hi FROM spans {group}
), cnt AS (
  SELECT {sby} CAST(CASE WHEN hi > lo THEN least(floor(((dur_ns - lo) * 16)::DOUBLE / (hi - lo)), 15) ELSE 0 END AS INTEGER) AS bin, count(*) AS n FROM spans s JOIN edge e ON {on} GROUP BY ALL
), hist AS (
  SELECT {eby} CAST(b AS INTEGER) AS bin, coalesce(n, 0) AS n, lo + (hi - lo) / 16.0 * b AS lo_ns, lo + (hi - lo) / 16.0 * (b + 1) AS hi_ns
  FROM edge e CROSS JOIN range(16) t(b) LEFT JOIN cnt c ON c.bin = b AND {con}
)"""
HIST_NAME = HISTOGRAM.format(by="name,", group="GROUP BY name", sby="s.name,", on="s.name = e.name", eby="e.name,", con="c.name = e.name")
HIST_ALL = HISTOGRAM.format(by="", group="", sby="", on="true", eby="", con="true")



def _lanes(source: str, by: str, out: str) -> str:
    """Adds lane to the rows of source: first fit, one row of every group at a time."""
    same = " AND ".join(f"o.{c} = r.{c}" for c in by.split(", "))
    return f""", {out}_o AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY ts_ns, seq) AS rn FROM {source}
), {out}_r AS (
  SELECT {by}, rn, span_id, [end_ns] AS ends, 0 AS lane FROM {out}_o WHERE rn = 1
  UNION ALL SELECT {by}, rn, span_id, CASE WHEN p = 0 THEN list_append(ends, end_ns) ELSE list_concat(list_slice(ends, 1, p - 1), [end_ns], list_slice(ends, p + 1, len(ends))) END, CAST(CASE WHEN p = 0 THEN len(ends) ELSE p - 1 END AS INTEGER)
  FROM (SELECT o.*, r.ends, coalesce(list_position(list_transform(r.ends, lambda x: x <= o.ts_ns), true), 0) AS p FROM {out}_r r JOIN {out}_o o ON {same} AND o.rn = r.rn + 1)
), {out} AS (SELECT s.*, l.lane FROM {source} s JOIN {out}_r l USING (span_id))"""


#: Gets the state (i, j) of the alignment of every pair forward by one decision.
DIFF = """, g AS (SELECT CAST(rank // 2 AS INTEGER) AS pair, rank % 2 AS side, name, dur_ns, ts_ns, seq FROM spans WHERE gpu
), sa AS (SELECT pair, list(name ORDER BY ts_ns, seq) AS a, list(dur_ns ORDER BY ts_ns, seq) AS da FROM g WHERE side = 0 GROUP BY pair
), sb AS (SELECT pair, list(name ORDER BY ts_ns, seq) AS b, list(dur_ns ORDER BY ts_ns, seq) AS db FROM g WHERE side = 1 GROUP BY pair
), sq AS (SELECT pair, coalesce(a, []) AS a, coalesce(b, []) AS b, da, db FROM sa FULL JOIN sb USING (pair)
), st AS (
  SELECT pair, 1 AS i, 1 AS j, 0 AS line, '' AS kind, 0 AS n, 0 AS i0, 0 AS j0 FROM sq
  UNION ALL SELECT pair, CASE kind WHEN 'added' THEN i ELSE i + n END, CASE kind WHEN 'removed' THEN j ELSE j + n END, line + n_before, kind, n, i, j
  FROM (SELECT *, CASE WHEN i > len(a) THEN len(b) - j + 1 WHEN j > len(b) THEN len(a) - i + 1 WHEN kind IN ('same', 'both') THEN 1 WHEN kind = 'added' THEN kb ELSE ka END AS n
    FROM (SELECT *, CASE WHEN i > len(a) THEN 'added' WHEN j > len(b) THEN 'removed' WHEN a[i] = b[j] THEN 'same' WHEN ka IS NULL AND kb IS NULL THEN 'both' WHEN ka IS NULL OR kb <= ka THEN 'added' ELSE 'removed' END AS kind
      FROM (SELECT st.pair, i, j, line, CASE kind WHEN '' THEN 0 WHEN 'both' THEN 2 ELSE n END AS n_before, a, b, nullif(list_position(list_slice(b, j + 1, j + 199), a[i]), 0) AS kb, nullif(list_position(list_slice(a, i + 1, i + 199), b[j]), 0) AS ka
        FROM st JOIN sq USING (pair) WHERE i <= len(a) OR j <= len(b))))
), ops AS (SELECT pair, line, kind, i0, j0, unnest(range(n)) AS k FROM st WHERE kind <> ''
), diff AS (
  SELECT pair, line + k AS line, kind, CASE kind WHEN 'added' THEN b[j0 + k] ELSE a[i0 + k] END AS name, CASE WHEN kind <> 'added' THEN da[i0 + k] END AS dur_a, CASE WHEN kind <> 'removed' THEN db[j0 + k] END AS dur_b
  FROM (SELECT * FROM ops WHERE kind <> 'both' UNION ALL SELECT pair, line, 'removed', i0, j0, 0 FROM ops WHERE kind = 'both' UNION ALL SELECT pair, line + 1, 'added', i0, j0, 0 FROM ops WHERE kind = 'both') JOIN sq USING (pair)
)"""

SQL: dict[str, str] = {
    "a6_rank_groups": "WITH x AS (SELECT 1)" + PATHS + """, p AS (SELECT CAST(rank % 3 AS VARCHAR) AS source_dir, replace(path, '.json', '_x.json') AS path, rank FROM runs
), n AS (SELECT *, count(*) OVER (PARTITION BY source_dir) AS n FROM p)
SELECT source_dir, path, CASE WHEN n > 1 THEN 'ep-group' END AS "group", CASE WHEN n > 1 THEN rank END AS rank FROM n""",
    "a6_dashed_ranks": "WITH x AS (SELECT 1)" + PATHS + """, p AS (
  SELECT rank, CASE WHEN rank % 5 = 0 THEN 'plain-' || rank || '.json' WHEN rank % 3 = 0 THEN '/d/alone' || rank || '-rank-' || rank || '.json' ELSE '/d/run' || (rank % 4) || '-rank-' || rank || '.trace.json.gz' END AS path,
    CASE WHEN rank % 5 <> 0 AND rank % 3 <> 0 THEN 'run' || (rank % 4) END AS g FROM runs
), n AS (SELECT *, g IS NOT NULL AND count(*) OVER (PARTITION BY g) > 1 AS many FROM p)
SELECT 'd' AS source_dir, path, CASE WHEN many THEN g END AS "group", CASE WHEN many THEN rank END AS rank FROM n""",
    "a7_export": GPU + f" SELECT ts_ns, seq, name || ' (' || {TEXT.replace('x', 'dur_ns').replace('madur_ns', 'max')} || ')' AS line FROM g",
    "a1_read_traces": NAMED + """ SELECT rank, tid, CASE WHEN gpu THEN 'GPU ' ELSE 'Thread ' END || tid AS track, gpu, name, cat, ts_ns, dur_ns, '{"correlation":' || correlation || '}' AS args FROM spans""",
    "l1_watch": NAMED + " SELECT rank, tid, CASE WHEN gpu THEN 'GPU ' ELSE 'Thread ' END || tid AS track, name, cat, ts_ns, dur_ns FROM spans",
    "a2_salvage": NAMED + """, f AS (SELECT rank, seq % 2 AS file, count(*) AS n, sum(dur_ns) AS d FROM spans GROUP BY ALL)
  SELECT rank, CAST(sum(n) AS BIGINT) AS n_spans, CAST(sum(d) AS BIGINT) AS total_ns, CAST(CASE WHEN rank % 3 = 0 THEN 0 ELSE count(*) END AS BIGINT) AS n_bad, CAST(CASE WHEN rank % 3 = 0 THEN 0 ELSE sum(n) + count(*) END AS BIGINT) AS n_kept FROM f GROUP BY rank""",
    "a3_discover": BASE + " SELECT DISTINCT rank FROM spans WHERE rank % 2 = 0",
    "a4_headers": BASE + " SELECT rank, 'dev' || (rank % 3) AS device, '1.2.0' AS version, rank AS dist_rank, 4096 AS dist_world, min(ts_ns) AS min_ts_ns FROM spans GROUP BY rank",
    "a5_store": NAMED + f" SELECT {STATS} FROM spans GROUP BY name",
    "b1_normalise": BASE + " SELECT span_id, ts_ns, end_ns FROM spans",
    "b2_tracks": BASE + TRACKS + " SELECT run, rank, '0' AS pid, tid, n_events, gpu, track_idx FROM tracks",
    "b3_labels": BASE + TRACKS + """, l AS (SELECT rank, tid, arg_max('w' || correlation, seq) AS label FROM spans WHERE cat = 'kernel' AND correlation < 2 GROUP BY ALL)
SELECT t.rank, t.tid, coalesce(label, CASE WHEN gpu THEN 'GPU ' ELSE 'Thread ' END || t.tid) AS track FROM tracks t LEFT JOIN l ON t.rank = l.rank AND t.tid = l.tid""",
    "b5_lanes": DEEP + _lanes("spans", "rank, tid", "ln") + " SELECT span_id, lane FROM ln",
    "b9_merged_rows": DEEP + ", g AS (SELECT * FROM spans WHERE gpu)" + _lanes("g", "rank, tid", "ln") + """, kept AS (
  SELECT * EXCLUDE (lane) FROM ln a WHERE NOT EXISTS (SELECT 1 FROM ln b WHERE b.rank = a.rank AND b.tid = a.tid AND (b.ts_ns > a.ts_ns OR (b.ts_ns = a.ts_ns AND b.seq > a.seq)) AND b.lane >= a.lane + 2 AND b.ts_ns <= a.end_ns)
)""" + _lanes("kept", "rank", "mr") + " SELECT rank AS row_rank, span_id, lane FROM mr",
    "b8_merge": BASE + ", o AS (SELECT min(ts_ns) AS t0 FROM spans) SELECT span_id, CAST(rank % 2 AS INTEGER) AS rank, 'Rank ' || (rank % 2) || ' Rank ' || rank || CASE WHEN gpu THEN ' GPU ' ELSE ' Thread ' END || tid AS track, ts_ns - t0 AS ts_ns, end_ns - t0 AS end_ns FROM spans, o",
    "c7_region": DEEP + _lanes("spans", "rank, tid", "ln") + f" SELECT span_id, lane FROM ln WHERE gpu AND end_ns >= {W0} AND ts_ns <= {W1} AND (lane BETWEEN 1 AND 2 OR (ts_ns >= {W0} AND end_ns <= {W1}))",
    "h2_flows_of": DEEP + FLOWS + _lanes("spans", "rank, tid", "ln") + """, hits AS (
  SELECT h.span_id, h.rank, flow_id, dst_tid, dst_ts FROM ln h JOIN pairs p ON p.rank = h.rank AND p.src_tid = h.tid AND p.src_ts BETWEEN h.ts_ns - 1 AND h.end_ns + 1
), par AS (
  SELECT c.span_id, arg_max(p.span_id, struct_pack(a := p.ts_ns, b := p.span_id)) AS up FROM ln c JOIN ln p ON p.rank = c.rank AND p.tid = c.tid AND p.lane = c.lane - 1 AND p.ts_ns <= c.ts_ns AND p.end_ns >= c.end_ns GROUP BY c.span_id
), walk AS (
  SELECT span_id, span_id AS at_id FROM spans WHERE cat = 'cpu_op'
  UNION ALL SELECT w.span_id, par.up FROM walk w JOIN par ON par.span_id = w.at_id WHERE w.at_id NOT IN (SELECT span_id FROM hits)
), found AS (SELECT DISTINCT w.span_id, at_id, h.rank, flow_id, dst_tid, dst_ts FROM walk w JOIN hits h ON h.span_id = w.at_id)
SELECT f.span_id, at_id, flow_id, arg_min(s.span_id, struct_pack(a := s.ts_ns, b := s.seq)) AS dst_id
FROM found f LEFT JOIN spans s ON s.rank = f.rank AND s.tid = f.dst_tid AND s.ts_ns BETWEEN f.dst_ts - 1 AND f.dst_ts + 1 GROUP BY f.span_id, at_id, flow_id, f.dst_tid, f.dst_ts""",
    "h6_flattened": BASE + """, n AS (SELECT DISTINCT name, regexp_extract(name, '^(.*)_', 1) AS kind FROM spans)
SELECT 'kernel_cutlass_kernel_pkg' || kind || name || '_object_at_0x7f' AS name, 1 AS n, 'pkg/' || kind || '.py' AS path, CAST(row_number() OVER (PARTITION BY kind ORDER BY name) AS INTEGER) AS line FROM n""",
    "i1_diff": DEEP + DIFF + " SELECT pair, line, kind, name, dur_a, dur_b FROM diff",
    "i3_diff_segments": DEEP + DIFF + """, sg AS (
  SELECT *, sum(CASE WHEN kind = 'same' OR prev = 'same' OR prev IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY pair ORDER BY line) AS segment FROM (SELECT *, lag(kind) OVER (PARTITION BY pair ORDER BY line) AS prev FROM diff)
), sums AS (SELECT pair, CAST(segment AS BIGINT) AS segment, CASE WHEN bool_or(kind = 'same') THEN 'same' ELSE 'changed' END AS kind, count(*) AS n, CAST(coalesce(sum(dur_a), 0) AS BIGINT) AS dur_a, CAST(coalesce(sum(dur_b), 0) AS BIGINT) AS dur_b FROM sg GROUP BY pair, segment)
SELECT *, greatest(dur_a, dur_b) AS budget FROM sums""",
    "j2_shifted_flows": BASE + SHIFTS + FLOWS.replace(", pairs AS", ", unused AS") + " SELECT f.rank, flow_id, tid, f.ts_ns + coalesce(shift_ns, 0) AS ts_ns, is_start FROM flows f LEFT JOIN shifts s ON s.rank = f.rank",
    "k6_matches": "WITH x AS (SELECT 1)" + PATHS + " SELECT rank, CASE rank % 4 WHEN 0 THEN rank % 8 = 0 WHEN 1 THEN true WHEN 2 THEN rank % 3 <> 0 END AS matches FROM runs",
    "l3_live_gaps": BASE + BUSY + GAPS + " SELECT * FROM gaps",
    "b6_peak": BASE + """, p AS (SELECT rank, tid, ts_ns AS t, 1 AS d FROM spans WHERE dur_ns > 0 UNION ALL SELECT rank, tid, end_ns, -1 FROM spans WHERE dur_ns > 0
), q AS (SELECT rank, tid, sum(d) OVER (PARTITION BY rank, tid ORDER BY t, d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM p)
SELECT rank, tid, CAST(max(k) AS BIGINT) AS peak FROM q GROUP BY ALL""",
    "b7_running_max": BASE + " SELECT span_id, max(dur_ns) OVER (PARTITION BY rank, tid ORDER BY ts_ns, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS max_dur_ns FROM spans",
    "b8_header": "WITH x AS (SELECT 1)" + PATHS + " SELECT 'dev' || min(rank) FILTER (rank > 2) AS device, CASE WHEN max(rank) > 4 THEN '1.2' END AS version, min(rank) FILTER (rank > 5) * 2 AS dist_world, count(*) AS n_ranks FROM runs",
    "b11_downsample": SEL + f""", x AS (SELECT *, CAST(floor(((ts_ns - {W0}) * 40)::DOUBLE / {W1 - W0}) AS BIGINT) AS px, dur_ns * 40 >= {W1 - W0} AS wide FROM w
), f AS (SELECT *, row_number() OVER (PARTITION BY rank, tid, px ORDER BY ts_ns, seq) AS rn FROM x WHERE NOT wide)
SELECT span_id, px FROM x WHERE wide UNION ALL SELECT span_id, px FROM f WHERE rn = 1""",
    "b11_downsample_lanes": DEEP + _lanes("(SELECT * FROM spans WHERE gpu)", "rank, tid", "ln") + f""", x AS (
  SELECT *, CAST(floor(((ts_ns + dur_ns // 2 - {W0}) * 40)::DOUBLE / {W1 - W0}) AS BIGINT) AS px, dur_ns * 40 >= {W1 - W0} AS wide FROM ln WHERE end_ns >= {W0} AND ts_ns <= {W1}
), f AS (SELECT *, row_number() OVER (PARTITION BY rank, tid, lane, px ORDER BY ts_ns, seq) AS rn FROM x WHERE NOT wide)
SELECT span_id, lane, px FROM x WHERE wide UNION ALL SELECT span_id, lane, px FROM f WHERE rn = 1""",
    "c1_window": SEL + " SELECT span_id, name FROM w",
    "c3_hidden": NAMED + " SELECT span_id, name FROM spans WHERE gpu AND NOT starts_with(name, 'execute_')",
    "c4_search_names": BASE + " SELECT DISTINCT name FROM spans WHERE contains(lower(name), 'click_')",
    "c5_match_count": BASE + " SELECT count(*) AS matches FROM spans WHERE contains(lower(name), 'i')",
    "c6_search": BASE + " SELECT span_id, lag(span_id) OVER (ORDER BY ts_ns, seq) AS previous, lead(span_id) OVER (ORDER BY ts_ns, seq) AS following FROM spans WHERE contains(lower(name), 'k_3')",
    "c8_scopes": BASE + f" SELECT DISTINCT rank AS scope FROM spans WHERE gpu AND end_ns >= 0 AND ts_ns <= {DAY // 4}",
    "c9_one_name": BASE + " SELECT span_id, ts_ns FROM spans WHERE gpu AND name = 'view_2'",
    "c10_sequence": SEL + " SELECT seq, name, dur_ns FROM w",
    "d1_kernel_stats": BASE + f" SELECT {STATS} FROM spans GROUP BY name",
    "d2_selection_stats": GPU + """ SELECT name, count(*) AS count, CAST(sum(dur_ns) AS BIGINT) AS total_ns, quantile_cont(dur_ns, 0.5) AS median_ns, min(ts_ns) AS first_ns, round(sum(dur_ns) / count(*), 3) AS mean_ns,
  round(100.0 * sum(dur_ns) / (SELECT sum(dur_ns) FROM g), 6) AS share_pct FROM g GROUP BY name""",
    "d2_grand_median": GPU + " SELECT quantile_cont(dur_ns, 0.5) AS median_ns FROM g",
    "d3_overlap_stats": GPU + _shared("(SELECT * FROM g WHERE dur_ns > 0)") + " SELECT name, round(shared_ns / 1e9, 3) AS total_s, round(100 * shared_ns / (SELECT sum(shared_ns) FROM shared), 4) AS share_pct FROM shared",
    "d4_rows": SEL + " SELECT span_id, name, ts_ns, dur_ns FROM w",
    "d5_sorted": BASE + f" SELECT {STATS} FROM spans GROUP BY name ORDER BY max_ns DESC, name LIMIT 10",
    "d6_bar": GPU + """, t AS (SELECT name, CAST(sum(dur_ns) AS BIGINT) AS total FROM g GROUP BY name)
SELECT name, round(total::DOUBLE / (SELECT sum(total) FROM t)::DOUBLE, 9) AS share, round((sum(total) OVER (ORDER BY total DESC, name ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - total)::DOUBLE / (SELECT sum(total) FROM t)::DOUBLE, 9) AS start FROM t""",
    "d7_histogram": BASE + HIST_NAME + " SELECT name, bin, n FROM hist",
    "d8_histogram_header": BASE + """, r AS (SELECT name, dur_ns, row_number() OVER (PARTITION BY name ORDER BY dur_ns) - 1 AS rn, count(*) OVER (PARTITION BY name) AS n FROM spans)
SELECT name, count(*) AS count, round(sum(dur_ns) / count(*), 3) AS mean_ns, max(dur_ns) FILTER (rn = n // 2) AS upper_median_ns FROM r GROUP BY name HAVING count(*) >= 2""",
    "d9_percentile": BASE + HIST_ALL + " SELECT round(100.0 * sum(n * greatest(0.0, least(1.0, (1200000000000 - lo_ns) / (hi_ns - lo_ns)))) / sum(n), 6) AS percentile FROM hist",
    "d10_heat_bounds": GPU + _ranks({"p5": 0.05}, "n") + """, b AS (SELECT greatest(0.0, log10((SELECT dur_ns FROM picks) / 1000.0)) AS lo, log10(max(dur_ns) / 1000.0) AS top FROM d)
SELECT round(lo, 9) AS lo, round(CASE WHEN top > lo THEN top ELSE lo + 1 END, 9) AS hi FROM b""",
    "d11_heat": GPU + _ranks({"p5": 0.05}, "n") + """, b AS (SELECT greatest(0.0, log10((SELECT dur_ns FROM picks) / 1000.0)) AS lo, log10(max(dur_ns) / 1000.0) AS top FROM d
), c AS (SELECT lo, CASE WHEN top > lo THEN top ELSE lo + 1 END AS hi FROM b)
SELECT span_id, round(greatest(0.0, least(1.0, (log10(dur_ns / 1000.0) - lo) / (hi - lo))), 9) AS heat FROM g, c WHERE dur_ns > 0 AND (cat = 'kernel' OR (starts_with(cat, 'gpu_') AND cat <> 'gpu_user_annotation'))""",
    "d12_quantiles": GPU + _ranks({"p5": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p99.9": 0.999}, "n - 1") + " SELECT which, dur_ns FROM picks",
    "d13_slowest": GPU + " SELECT span_id, name, dur_ns FROM g ORDER BY dur_ns DESC, span_id LIMIT 25",
    "d14_overview": BASE + " SELECT count(*) AS events, count(DISTINCT rank || ':' || tid) AS tracks, count(DISTINCT rank) AS ranks, max(end_ns) AS max_ns FROM spans",
    "f1_islands": GPU + _islands("g", "rank") + " SELECT rank, island, min(ts_ns) AS ts_ns, max(end_ns) AS end_ns, count(*) AS n_spans FROM isl GROUP BY rank, island",
    "f1_union": GPU + _union("g", "rank", "u", "busy_ns") + " SELECT rank, busy_ns FROM u",
    "f1_islands_two_ranks": TWO + ", g AS (SELECT * FROM spans WHERE gpu)" + _islands("g", "rank") + " SELECT rank, island, min(ts_ns) AS ts_ns, max(end_ns) AS end_ns, count(*) AS n_spans FROM isl GROUP BY rank, island",
    "f2_gaps": BASE + BUSY + GAPS + " SELECT * FROM gaps",
    "f3_top_gaps": BASE + BUSY + GAPS + f", c AS (SELECT scope, greatest(t0, {W0}) AS t0, least(t1, {W1}) AS t1, prev_name, next_name FROM gaps) SELECT scope, t0, t1, t1 - t0 AS gap_ns, prev_name, next_name FROM c WHERE t1 - t0 >= 1000 ORDER BY gap_ns DESC, scope, t0 LIMIT 500",
    "f3_gaps_two_ranks": SHORT + BUSY + GAPS + " SELECT * FROM gaps",
    "f4_gap_causes": BASE + BUSY + GAPS + """, top AS (SELECT * FROM gaps ORDER BY gap_ns DESC, scope, t0 LIMIT 500
), hit AS (
  SELECT scope, t0, t1, greatest(ts_ns, t0) AS ts_ns, least(end_ns, t1) AS end_ns, seq, name, cat FROM top JOIN spans ON rank = scope AND ts_ns < t1 AND end_ns > t0
  WHERE NOT gpu AND cat IN ('cpu_op', 'runtime', 'cuda_runtime', 'cuda_driver') AND least(end_ns, t1) > greatest(ts_ns, t0)
), rt AS (SELECT * FROM hit WHERE cat <> 'cpu_op')""" + _union("hit", "scope, t0, t1", "cu", "cpu_ns") + _union("rt", "scope, t0, t1", "ru", "runtime_ns") + _union("hit", "scope, t0, t1, name", "nu", "covered_ns") + """, per AS (
  SELECT n.*, launches, row_number() OVER (PARTITION BY n.scope, n.t0, n.t1 ORDER BY covered_ns DESC, n.name) AS rn FROM nu n JOIN (SELECT scope, t0, t1, name, count(*) AS launches FROM hit GROUP BY ALL) l USING (scope, t0, t1, name)
), tp AS (SELECT scope, t0, t1, string_agg(name || ':' || launches || ':' || covered_ns, ',' ORDER BY rn) AS cpu_top FROM per WHERE rn <= 3 GROUP BY ALL
), has AS (SELECT DISTINCT rank AS scope FROM spans WHERE NOT gpu
), j AS (
  SELECT g.*, coalesce(cpu_ns, 0)::DOUBLE / gap_ns AS cb, coalesce(runtime_ns, 0)::DOUBLE / gap_ns AS rb, has.scope IS NOT NULL AS has_cpu, coalesce(cpu_top, '') AS cpu_top
  FROM top g LEFT JOIN cu USING (scope, t0, t1) LEFT JOIN ru USING (scope, t0, t1) LEFT JOIN tp USING (scope, t0, t1) LEFT JOIN has ON has.scope = g.scope
)
SELECT scope, t0, t1, gap_ns, prev_name, next_name, round(cb, 9) AS cpu_busy_frac, round(rb, 9) AS runtime_frac, has_cpu,
  CASE WHEN NOT has_cpu THEN 'no CPU data' WHEN cb < 0.2 THEN 'starved' WHEN rb >= 0.5 * cb THEN 'runtime-bound' ELSE 'host-bound' END AS cause, cpu_top FROM j""",
    "f6_gap_totals": BASE + BUSY + GAPS + " SELECT count(*) AS gaps, CAST(coalesce(sum(gap_ns), 0) AS BIGINT) AS idle_ns FROM gaps",
    "f7_idle_summary": BASE + BUSY + f", c AS (SELECT scope, greatest(ts_ns, {W0}) AS ts_ns, least(end_ns, {W1}) AS end_ns, seq FROM busy WHERE least(end_ns, {W1}) > greatest(ts_ns, {W0}))" + _union("c", "scope", "u", "busy_ns") + """
SELECT scope, t0, t1, busy_ns, t1 - t0 - busy_ns AS idle_ns, round(CASE WHEN t1 > t0 THEN 100.0 * (t1 - t0 - busy_ns) / (t1 - t0) ELSE 0 END, 6) AS idle_pct
FROM (SELECT scope, min(ts_ns) AS t0, max(end_ns) AS t1 FROM c GROUP BY scope) JOIN u USING (scope)""",
    "f8_shared_time": GPU + _shared("(SELECT * FROM g WHERE dur_ns > 0)") + " SELECT name, round(shared_ns / 1e9, 3) AS shared_s FROM shared",
    "f8_shared_two_ranks": TWO + ", g AS (SELECT * FROM spans WHERE gpu)" + _shared("(SELECT * FROM g WHERE dur_ns > 0)") + " SELECT name, round(shared_ns / 1e9, 2) AS shared_s FROM shared",
    "g1_detailed_names": BASE + """, n AS (
  SELECT DISTINCT k, 'execute_' || CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN '0_' ELSE (3 * k + 1) || '_' END || 'context_' || (k % 5) || '(sq' || k || CASE WHEN k % 4 = 0 THEN '' ELSE 'sk' || (7 * k) END
    || ')_generation_' || (k % 7) || '(sq' || (k % 11) || 'sk' || k || ')' || CASE WHEN k % 13 = 5 THEN 'x' ELSE '' END AS name, k % 13 <> 5 AS ok FROM spans)
SELECT name, CASE WHEN ok THEN CAST(CASE WHEN k % 3 = 2 THEN 3 * k + 1 ELSE k + k % 11 END AS BIGINT) END AS total_tokens, CASE WHEN ok THEN CAST(k % 5 AS BIGINT) END AS n_ctx, CASE WHEN ok THEN CAST(k AS BIGINT) END AS ctx_tokens,
  CASE WHEN ok AND k % 4 <> 0 THEN CAST(7 * k AS BIGINT) END AS ctx_kv, CASE WHEN ok THEN CAST(k % 7 AS BIGINT) END AS n_gen, CASE WHEN ok THEN CAST(k % 11 AS BIGINT) END AS gen_tokens, CASE WHEN ok THEN CAST(k AS BIGINT) END AS gen_kv FROM n""",
    "g1_step_names": NAMED + BATCH + " SELECT name, ctx_tokens + gen_tokens AS total_tokens, n_ctx, n_gen, ctx_tokens, CAST(NULL AS BIGINT) AS ctx_kv, gen_tokens, CAST(NULL AS BIGINT) AS gen_kv FROM parsed",
    "g3_reference_track": NAMED + STEPS + " SELECT rank, tid, n, total_ns FROM reft",
    "g4_assign": NAMED + STEPS + " SELECT span_id, step FROM pick",
    "g5_steps": NAMED + STEPS + BATCH + """, bnd AS (SELECT step, min(ts_ns) AS t0, max(end_ns) AS t1, CAST(count(DISTINCT rank) AS INTEGER) AS n_ranks FROM asg GROUP BY step HAVING max(end_ns) > min(ts_ns)
), bd AS (SELECT *, coalesce(greatest(0, t0 - lag(t1) OVER (ORDER BY step)), 0) AS idle_before_ns FROM bnd)""" + _union("asg", "step, rank", "u", "ns") + """, gpu AS (SELECT step, quantile_cont(ns, 0.5) AS gpu_ns FROM u GROUP BY step
), kc AS (SELECT step, count(*) AS kernel_count FROM bd JOIN spans ON gpu AND cat = 'kernel' AND ts_ns >= t0 AND ts_ns < t1 GROUP BY step
), fst AS (SELECT step, rank % 4 AS dp, arg_min(name, struct_pack(a := track_idx, b := ts_ns, c := seq)) AS name FROM asg GROUP BY ALL
), tot AS (SELECT step, CAST(sum(ctx_tokens + gen_tokens) AS BIGINT) AS total_tokens, CAST(sum(n_ctx) AS BIGINT) AS n_ctx, CAST(sum(n_gen) AS BIGINT) AS n_gen, CAST(sum(ctx_tokens) AS BIGINT) AS ctx_tokens, CAST(sum(gen_tokens) AS BIGINT) AS gen_tokens, CAST(count(*) AS INTEGER) AS n_groups FROM fst JOIN parsed USING (name) GROUP BY step)
SELECT step, t0, t1, n_ranks, idle_before_ns, gpu_ns, coalesce(kernel_count, 0) AS kernel_count, total_tokens, n_ctx, n_gen, ctx_tokens, CAST(NULL AS BIGINT) AS ctx_kv, gen_tokens, CAST(NULL AS BIGINT) AS gen_kv, n_groups
FROM bd JOIN gpu USING (step) LEFT JOIN kc USING (step) LEFT JOIN tot USING (step)""",
    "h1_flows": BASE + FLOWS + " SELECT * FROM pairs",
    "h3_launch_links": BASE + LINKS + " SELECT * FROM links",
    "h3_external_ids": BASE + """, st AS (
  SELECT span_id, CASE WHEN seq % 41 <> 0 THEN rank END AS rank, rank * 4 + CAST(tid AS INTEGER) AS track_idx, ts_ns, seq, gpu, cat, CASE WHEN cat = 'cuda_runtime' AND correlation = 3 THEN 'cudaGraphLaunch' ELSE name END AS name,
    CASE WHEN seq % 3 <> 0 THEN correlation END AS corr, CASE WHEN seq % 3 <> 1 THEN correlation END AS ext FROM spans
), p AS (
  SELECT k.span_id AS kernel_id, c.span_id AS id, c.ts_ns, c.track_idx, c.seq, c.name, coalesce(k.corr = c.corr, false) AS by_corr, coalesce(k.ext = c.ext, false) AS by_ext
  FROM st k JOIN st c ON (k.rank = c.rank OR k.rank IS NULL OR c.rank IS NULL) AND k.track_idx <> c.track_idx AND c.ts_ns <= k.ts_ns AND (k.corr = c.corr OR k.ext = c.ext)
  WHERE k.gpu AND k.cat = 'kernel' AND c.cat IN ('cpu_op', 'cuda_driver', 'cuda_runtime')
), b AS (
  SELECT kernel_id, arg_max(struct_pack(id := id, g := contains(name, 'GraphLaunch')), struct_pack(a := ts_ns, b := track_idx, c := seq)) FILTER (by_corr) AS l,
    arg_min(struct_pack(id := id, name := name), struct_pack(a := track_idx, b := ts_ns, c := seq)) FILTER (by_ext) AS f FROM p GROUP BY kernel_id)
SELECT kernel_id, f.name AS op, coalesce(l.id, f.id) AS at_id, coalesce(l.g, false) AS graph FROM b""",
    "h4_launch_frames": BASE + LINKS + """, l AS (SELECT kernel_id, rank, ts_ns AS t FROM links JOIN spans ON span_id = at_id
), f AS (SELECT span_id, rank, ts_ns, end_ns, dur_ns, seq, correlation FROM spans WHERE cat = 'python_function')
SELECT kernel_id, arg_min(f.span_id, struct_pack(a := dur_ns, b := ts_ns, c := seq)) AS frame_id, arg_min('pkg/mod' || correlation || '.py', struct_pack(a := dur_ns, b := ts_ns, c := seq)) AS file, arg_min(correlation + 10, struct_pack(a := dur_ns, b := ts_ns, c := seq)) AS line
FROM l JOIN f ON l.rank = f.rank AND f.ts_ns <= t AND t <= f.end_ns GROUP BY kernel_id""",
    "h5_resolve_names": BASE + """, n AS (SELECT DISTINCT name, regexp_extract(name, '^(.*)_', 1) AS kind FROM spans)
SELECT 'void ns::' || name || '_0d1d2<int>(x)' AS name, 1 AS n, 'pkg/' || kind || '.py' AS path, CAST(row_number() OVER (PARTITION BY kind ORDER BY name) AS INTEGER) AS line FROM n""",
    "h8_attribution": BASE + TRACKS + """, ix AS (
  SELECT name, 'pkg/' || kind || '.py' AS path, CAST(row_number() OVER (PARTITION BY kind ORDER BY 'def ' || name || '(a):') AS INTEGER) AS line FROM (SELECT DISTINCT name, regexp_extract(name, '^(.*)_', 1) AS kind FROM spans)
), st AS (SELECT s.*, t.track_idx FROM spans s JOIN tracks t ON s.rank = t.rank AND s.tid = t.tid
), how AS (SELECT *, CASE WHEN correlation = 4 THEN 'call site' WHEN gpu AND correlation IN (1, 2, 3) THEN 'op' WHEN gpu OR cat = 'cpu_op' THEN 'name' END AS how FROM st
), op AS (
  SELECT k.span_id, arg_min(c.name, struct_pack(a := c.track_idx, b := c.ts_ns, c := c.seq)) AS op FROM how k JOIN st c ON k.rank = c.rank AND k.correlation = c.correlation AND k.track_idx <> c.track_idx AND c.ts_ns <= k.ts_ns
  WHERE k.how = 'op' AND c.cat IN ('cpu_op', 'cuda_driver', 'cuda_runtime') GROUP BY k.span_id
), r AS (SELECT h.span_id, CASE WHEN how <> 'op' OR op IS NOT NULL THEN how END AS via, CASE how WHEN 'name' THEN h.name WHEN 'op' THEN op END AS found FROM how h LEFT JOIN op ON h.span_id = op.span_id)
SELECT span_id, via, CASE WHEN via IS NULL THEN 'error' ELSE 'open' END AS outcome, CAST(CASE WHEN via IS NULL THEN 0 ELSE 1 END AS INTEGER) AS n_hits,
  CASE WHEN via = 'call site' THEN 'pkg/view.py' ELSE ix.path END AS path, CASE WHEN via = 'call site' THEN 3 ELSE ix.line END AS line
FROM r LEFT JOIN ix ON ix.name = r.found""",
    "h7_call_sites": BASE + """ SELECT DISTINCT 'pkg/' || regexp_extract(name, '^(.*)_', 1) || '.py:' || correlation AS site, 'pkg/' || regexp_extract(name, '^(.*)_', 1) || '.py' AS path, correlation AS line FROM spans WHERE correlation > 0""",
    "h9_coords": BASE + " SELECT span_id, rank % 4 AS dp, CAST((rank // 4) % 4 AS INTEGER) AS tp, 0 AS pp, rank AS ep FROM spans",
    "h10_compare": GPU + """, a AS (SELECT name, count(*) AS n, CAST(sum(dur_ns) AS BIGINT) AS t FROM g WHERE rank % 2 = 0 AND name <> 'view_1' GROUP BY name
), b AS (SELECT name, count(*) AS n, CAST(sum(dur_ns) AS BIGINT) AS t FROM g WHERE rank % 2 = 1 AND name <> 'click_1' GROUP BY name)
SELECT coalesce(a.name, b.name) AS name, coalesce(a.n, 0) AS count_a, coalesce(a.t, 0) AS total_a, coalesce(b.n, 0) AS count_b, coalesce(b.t, 0) AS total_b,
  round(CASE WHEN coalesce(a.t, 0) > 0 THEN 100.0 * (coalesce(b.t, 0) - a.t) / a.t END, 6) AS delta_pct FROM a FULL JOIN b ON a.name = b.name""",
    "i2_diff_totals": GPU + """, x AS (SELECT CAST(rank // 2 AS INTEGER) AS pair, CAST(count(*) FILTER (rank % 2 = 0) AS BIGINT) AS count_a, count(*) FILTER (rank % 2 = 1) AS count_b, CAST(coalesce(sum(dur_ns) FILTER (rank % 2 = 0), 0) AS BIGINT) AS total_a, CAST(coalesce(sum(dur_ns) FILTER (rank % 2 = 1), 0) AS BIGINT) AS total_b FROM g GROUP BY ALL)
SELECT *, round(CASE WHEN total_a > 0 THEN 100.0 * (total_b - total_a) / total_a END, 6) AS delta_pct FROM x""",
    "j1_clock_shifts": BASE + SHIFTS + " SELECT * FROM shifts",
    "j2_shifted": BASE + SHIFTS + " SELECT span_id, ts_ns + coalesce(shift_ns, 0) AS ts_ns, end_ns + coalesce(shift_ns, 0) AS end_ns FROM spans LEFT JOIN shifts ON spans.rank = shifts.rank",
    "j3_shift_summary": BASE + SHIFTS + " SELECT 'dp' || dp AS grp, shift_ns, count(*) AS n_ranks FROM shifts GROUP BY ALL",
    "k1_scope": BASE + " SELECT span_id, rank AS label_rank FROM spans",
    "k2_runs": "WITH x AS (SELECT 1)" + PATHS + " SELECT rank, rank % 4 AS dp, CAST((rank // 4) % 4 AS INTEGER) AS tp, 0 AS pp, rank AS ep, 0 AS dcp, 'rank ' || rank || '/2048 · tp' || ((rank // 4) % 4) || ' pp0 dp' || (rank % 4) || ' ep' || rank AS mesh FROM runs",
    "k3_occupancy": GPU + """, o AS (SELECT name, dur_ns, CASE WHEN correlation < 3 THEN 'SMEM' WHEN correlation < 6 THEN 'REGS|BLOCKS' WHEN correlation < 9 THEN 'WARPS' END AS "limit", correlation < 3 AND correlation * 20000 > 49152 AS suspect FROM g)
SELECT name, "limit", suspect, count(*) AS launches, CAST(sum(dur_ns) AS BIGINT) AS total_ns FROM o WHERE "limit" IS NOT NULL GROUP BY ALL""",
    "k4_args": BASE + """ SELECT 'correlation' AS key, CAST(correlation AS VARCHAR) AS value, count(*) AS n FROM spans GROUP BY ALL UNION ALL SELECT 'k', CAST(k AS VARCHAR), count(*) FROM spans GROUP BY ALL""",
    "k5_families": MANGLED + " SELECT base, family, count(*) AS count, CAST(sum(dur_ns) AS BIGINT) AS total_ns FROM nb GROUP BY ALL",
    "k5_base_names": MANGLED + " SELECT DISTINCT name, base FROM nb",
    "k6_builds": "WITH x AS (SELECT 1)" + PATHS + """, v AS (SELECT rank, CASE rank % 4 WHEN 0 THEN '0.26.1rc1.dev' || rank || '+g1a2b3c4d' WHEN 1 THEN '0.33.0rc1.dev' || rank || '+stamp.cfee12e' WHEN 2 THEN '0.' || rank || '.0' ELSE 'unknown' END AS version FROM runs)
SELECT rank, version, CASE rank % 4 WHEN 0 THEN 'commit' WHEN 1 THEN 'dev' WHEN 2 THEN 'tag' END AS kind, CASE rank % 4 WHEN 0 THEN regexp_extract(version, 'g([0-9a-f]+)$', 1) WHEN 1 THEN regexp_extract(version, '^(.*)\\.dev', 1) WHEN 2 THEN 'v' || version END AS value,
  CASE WHEN rank % 4 = 1 THEN CAST(regexp_extract(version, 'dev(\\d+)', 1) AS INTEGER) END AS dist FROM v""",
    "l2_live_stats": BASE + " SELECT name, count(*) AS count, CAST(sum(dur_ns) AS BIGINT) AS total_ns, greatest(max(dur_ns), 0) AS max_ns, min(dur_ns) AS min_ns FROM spans GROUP BY name",
    "k7_durations": BASE + f", t AS (SELECT span_id, CAST(trunc(dur_ns / pow(10, span_id % 4 * 3)) AS BIGINT) AS x FROM spans) SELECT span_id, {TEXT} AS text FROM t",
}
