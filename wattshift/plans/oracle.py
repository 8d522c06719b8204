"""The registered queries in SQL, written from the definitions and independent of Spark."""

from __future__ import annotations

import re

from wattshift.plans.testbed import BLOCK, PARAMS

W1, W2, P, EPS = PARAMS.w1, PARAMS.w2, PARAMS.partition, PARAMS.eps
LOCALITY = f"{1.0}::DOUBLE - {PARAMS.temp_eps}::DOUBLE"
CURRENT = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"

SIGNAL = f"""samples AS (
  SELECT 0::BIGINT AS stream_id, event_id AS i, value AS voltage, {CURRENT} AS current FROM events)"""
GAPPY = f"""samples AS (
  SELECT 0::BIGINT AS stream_id, event_id + event_id // 7 + (event_id // 1000) * {3 * W1} AS i, value AS voltage,
    {CURRENT} AS current FROM events)"""
MULTI = f"""samples AS (
  SELECT user_id % 4 AS stream_id,
    CAST(row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS BIGINT) AS i,
    value AS voltage, {CURRENT} AS current FROM events)"""

POWER = f"""power AS (
  SELECT stream_id, window_no, n, p, s, sqrt(s * s - p * p) AS q FROM (
    SELECT stream_id, i // {W1} AS window_no, count(*) AS n, avg(voltage * current) AS p,
      sqrt(avg(voltage * voltage)) * sqrt(avg(current * current)) AS s
    FROM samples GROUP BY ALL))"""


def ln(x: str) -> str:
    return (
        f"CASE WHEN {x} > 0 THEN ln({x}) WHEN {x} = 0 THEN '-infinity'::DOUBLE"
        f" WHEN {x} IS NOT NULL THEN 'nan'::DOUBLE END"
    )


FEATURES = f"""features AS (
  SELECT stream_id, window_no, n AS size, {ln('p')} AS f1, {ln('q')} AS f2,
    CAST(row_number() OVER (PARTITION BY stream_id ORDER BY window_no) - 1 AS BIGINT) AS idx
  FROM power)"""

# Short windows take the latest reading of every slot up to their own window.
LOCF = f"""placed AS (
  SELECT *, i // {W1} AS window_no, i % {W1} AS slot FROM samples),
counted AS (
  SELECT stream_id, window_no, count(*) AS n,
    CAST(row_number() OVER (PARTITION BY stream_id ORDER BY window_no) - 1 AS BIGINT) AS idx
  FROM placed GROUP BY stream_id, window_no),
used AS (
  SELECT c.stream_id, c.window_no, p.voltage, p.current FROM counted c JOIN placed p
    ON p.stream_id = c.stream_id AND p.window_no = c.window_no
  WHERE c.n >= {W1} OR c.idx = 0
  UNION ALL
  SELECT stream_id, window_no, r.voltage, r.current FROM (
    SELECT c.stream_id, c.window_no, p.slot,
      arg_max({{'voltage': p.voltage, 'current': p.current}}, p.i) AS r
    FROM counted c JOIN placed p ON p.stream_id = c.stream_id AND p.window_no <= c.window_no
    WHERE c.n < {W1} AND c.idx > 0 GROUP BY c.stream_id, c.window_no, p.slot)),
power AS (
  SELECT stream_id, window_no, n, p, s, sqrt(s * s - p * p) AS q FROM (
    SELECT stream_id, window_no, count(*) AS n, avg(voltage * current) AS p,
      sqrt(avg(voltage * voltage)) * sqrt(avg(current * current)) AS s
    FROM used GROUP BY ALL))"""

DISTANCE = "sqrt((a.f1-b.f1)*(a.f1-b.f1) + (a.f2-b.f2)*(a.f2-b.f2))"

BLOCKS = f"""points AS MATERIALIZED (
  SELECT stream_id, idx // {BLOCK} AS window_id, CAST(idx % {BLOCK} AS INTEGER) AS pos, f1, f2
  FROM features)"""
CUTS = """points AS MATERIALIZED (
  SELECT stream_id, window_id, CAST(c AS INTEGER) AS cut, pos, f1, f2
  FROM whole_points, LATERAL (SELECT unnest(range(0, pos + 1)) AS c))"""


def clusters(keys: str) -> str:
    """Components by reachability inside each window of ``points``."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    a_keys = ", ".join(f"a.{k}" for k in keys.split(", "))
    return f"""near AS MATERIALIZED (
  SELECT {a_keys}, a.pos AS a, b.pos AS b, {DISTANCE} AS dist
  FROM points a JOIN points b ON {on} AND a.pos <> b.pos WHERE {DISTANCE} <= {EPS}),
reach AS (
  SELECT {keys}, a, b FROM near
  UNION
  SELECT {a_keys}, a.a, b.b FROM reach a JOIN near b ON {on} AND a.b = b.a),
rooted AS (SELECT {keys}, a AS pos, min(b) AS root FROM reach GROUP BY ALL),
numbered AS (
  SELECT {keys}, root, row_number() OVER (PARTITION BY {keys} ORDER BY root) - 1 AS cluster_id
  FROM (SELECT DISTINCT {keys}, root FROM rooted)),
assigned AS MATERIALIZED (
  SELECT {keys}, pos, CAST(coalesce(cluster_id, -1) AS INTEGER) AS cluster_id
  FROM points LEFT JOIN rooted USING ({keys}, pos) LEFT JOIN numbered USING ({keys}, root)),
stats AS MATERIALIZED (
  SELECT {keys}, cluster_id, min(pos) AS u, max(pos) AS v, count(*) AS n,
    count(*)::DOUBLE / (max(pos) - min(pos) + 1.0::DOUBLE) AS loc
  FROM assigned GROUP BY ALL),
dense AS (SELECT * FROM stats WHERE cluster_id <> -1 AND loc >= {LOCALITY}),
guard AS (
  SELECT {keys}, count(*) FILTER (cluster_id <> -1) AS n_clusters,
    count(*) FILTER (cluster_id <> -1 AND loc >= {LOCALITY}) AS n_dense
  FROM stats GROUP BY {keys} HAVING n_clusters >= 2 AND n_dense >= 2)"""


def pairs(keys: str, source: str = "dense", name: str = "pairs") -> str:
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    a_keys = ", ".join(f"a.{k}" for k in keys.split(", "))
    return f"""{name} AS (
  SELECT {a_keys}, a.cluster_id AS c1, a.u AS u1, a.v AS v1,
    b.cluster_id AS c2, b.u AS u2, b.v AS v2
  FROM {source} a JOIN {source} b ON {on} AND a.cluster_id < b.cluster_id)"""


def intervals(keys: str, where: str, low: str = "v1", high: str = "u2") -> str:
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    a_keys = ", ".join(f"a.{k}" for k in keys.split(", "))
    return f"""intervals AS (
  SELECT {a_keys}, a.c1, a.c2, min(b.pos) AS first, max(b.pos) AS last,
    string_agg(b.pos::VARCHAR, ',' ORDER BY b.pos) AS interval_
  FROM pairs a JOIN assigned b ON {on} AND b.cluster_id = -1 AND b.pos > a.{low} AND b.pos < a.{high}
  WHERE {where} GROUP BY ALL)"""


BLOCK_KEYS = "stream_id, window_id"
CUT_KEYS = "stream_id, window_id, cut"
REAL = "real AS (SELECT * FROM stats WHERE cluster_id <> -1)"

# Sequential detection. For every window start, grow the window one point at a time and keep
# the component (least index) of each point; judge every window; keep the cut of the backward
# pass; then walk each series from a fresh start.
DETECTOR = f"""series AS MATERIALIZED (SELECT stream_id, idx, f1, f2 FROM detector_input),
linked AS (
  SELECT b.stream_id, b.idx, list(a.idx) AS before FROM series a JOIN series b
    ON a.stream_id = b.stream_id AND a.idx < b.idx AND a.idx >= b.idx - {W2}
   AND {DISTANCE} <= {EPS} GROUP BY ALL),
links AS MATERIALIZED (
  SELECT s.stream_id, s.idx, coalesce(l.before, []) AS before
  FROM series s LEFT JOIN linked l USING (stream_id, idx)),
grown(stream_id, st, t, labels) AS (
  SELECT stream_id, idx, idx, [idx] FROM series
  UNION ALL
  SELECT stream_id, st, t + 1, list_append(
      list_transform(labels, lambda l: CASE WHEN list_contains(hit, l) THEN least_hit ELSE l END),
      coalesce(least_hit, t + 1))
  FROM (SELECT *, list_min(hit) AS least_hit FROM (
    SELECT g.*, list_transform(list_filter(n.before, lambda p: p >= g.st),
      lambda p: g.labels[p - g.st + 1]) AS hit
    FROM grown g JOIN links n ON n.stream_id = g.stream_id AND n.idx = g.t + 1
    WHERE g.t - g.st < {W2}))),
members AS (
  SELECT stream_id, st, t, unnest(labels) AS c, unnest(range(st, t + 1)) AS p
  FROM grown WHERE t - st >= 4),
groups_ AS (
  SELECT stream_id, st, t, c, count(*) AS n, min(p) AS u, max(p) AS v FROM members GROUP BY ALL),
dense_groups AS (
  SELECT * FROM groups_ WHERE n >= 2 AND n::DOUBLE / (v - u + 1.0::DOUBLE) >= {LOCALITY}),
noise_lists AS (
  SELECT stream_id, st, t, list(u ORDER BY u) AS ns FROM groups_ WHERE n = 1 GROUP BY ALL),
group_pairs AS (
  SELECT a.stream_id, a.st, a.t, a.u AS u1, b.u AS u2,
    list_filter(ns, lambda x: x > a.v AND x < b.u) AS inner_
  FROM dense_groups a JOIN dense_groups b
    ON a.stream_id = b.stream_id AND a.st = b.st AND a.t = b.t AND a.v < b.u
  JOIN noise_lists z ON z.stream_id = a.stream_id AND z.st = a.st AND z.t = a.t),
chosen AS (
  SELECT stream_id, st, t,
    min({{'u1': u1, 'u2': u2, 'a': inner_[1], 'b': inner_[len(inner_)]}}) AS k
  FROM group_pairs WHERE len(inner_) > 0 GROUP BY ALL),
runs AS (
  SELECT *, st + row_number() OVER (PARTITION BY stream_id, t ORDER BY st DESC) AS run FROM chosen),
judged AS MATERIALIZED (
  SELECT stream_id, st, t, k.a + 1 AS a, k.b + 1 AS b FROM (
    SELECT stream_id, st, t, last_value(k) OVER (PARTITION BY stream_id, t, run ORDER BY st
      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS k FROM runs)),
walk(stream_id, t, st, a, b) AS (
  SELECT DISTINCT stream_id, -1::BIGINT, 0::BIGINT, NULL::BIGINT, NULL::BIGINT FROM series
  UNION ALL
  SELECT w.stream_id, x.idx,
    CASE WHEN e.t IS NOT NULL THEN e.b WHEN x.idx - w.st >= {W2} THEN x.idx + 1 ELSE w.st END,
    e.a, e.b
  FROM walk w JOIN series x ON x.stream_id = w.stream_id AND x.idx = w.t + 1
  LEFT JOIN judged e ON e.stream_id = w.stream_id AND e.st = w.st AND e.t = x.idx),
walked AS MATERIALIZED (SELECT * FROM walk WHERE t >= 0),
results AS (
  SELECT stream_id, t AS s, a IS NOT NULL AS d, coalesce((a + b) // 2 + 1, -1) AS event_s,
    a AS event_start, b AS event_end FROM walked)"""
DIRECT = "detector_input AS (SELECT stream_id, idx, f1, f2 FROM features)"
# Partitions of P features plus the first W2 of the next one, each a series of its own.
def parts(p: int) -> str:
    return f"""parts AS (
  SELECT idx // {p} AS part_key, idx % {p} AS part_offset, idx, f1, f2 FROM features
  UNION ALL
  SELECT idx // {p} - 1, idx % {p} + {p}, idx, f1, f2 FROM features
  WHERE idx % {p} < {W2} AND idx // {p} > 0),
detector_input AS (SELECT part_key AS stream_id, part_offset AS idx, f1, f2 FROM parts)"""


def provisional(p: int) -> str:
    return f"""provisional AS (
  SELECT 0::BIGINT AS stream_id, stream_id * {p} + s AS s, d,
    CASE WHEN d THEN event_s + stream_id * {p} ELSE -1 END AS event_s,
    event_start + stream_id * {p} AS event_start, event_end + stream_id * {p} AS event_end
  FROM results WHERE NOT (stream_id > 0 AND s < {W2}))"""


PARTS = parts(P)


def _rename(sql: str, suffix: str) -> str:
    """The same definitions under other names, to run the detector twice in one statement."""
    names = [
        "series", "linked", "links", "grown", "members", "groups_", "dense_groups", "noise_lists",
        "group_pairs", "chosen", "runs", "judged", "walk", "walked", "results", "detector_input",
    ]
    for n in names:
        sql = re.sub(rf"\b{n}\b", n + suffix, sql)
    return sql


def select(*parts: str) -> str:
    *ctes, final = parts
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + final


SHOWN = "round(f1, 6) AS f1, round(f2, 6) AS f2"
FEATURE_ROWS = f"SELECT stream_id, idx, window_no, {SHOWN}, size FROM features"
WINDOW_ROWS = f"SELECT stream_id, window_no, {SHOWN}, size FROM features"
RESULT_ROWS = "SELECT stream_id, s, d, event_s, event_start, event_end FROM results"
JSON_ROWS = """SELECT stream_id, s,
  '{"s":' || s || ',"d":' || d::VARCHAR || ',"event_s":' || event_s || '}' AS json FROM results"""
ONE = (SIGNAL, POWER, FEATURES)
MANY = (MULTI, POWER, FEATURES)
ONE_BLOCKS = (*ONE, BLOCKS, clusters(BLOCK_KEYS))
ONE_RESULTS = (*ONE, DIRECT, DETECTOR)
MANY_RESULTS = (*MANY, DIRECT, DETECTOR)


def both(p: int) -> tuple[str, ...]:
    """Results of partitions judged on their own, and of the whole series."""
    return (*ONE, parts(p), DETECTOR, provisional(p),
            _rename(DIRECT, "_true"), _rename(DETECTOR, "_true"))



def alone(p: int) -> tuple[str, ...]:
    """Results of chunks judged from a fresh window each, and of the whole series."""
    return (*ONE, f"detector_input AS (SELECT idx // {p} AS stream_id, idx % {p} AS idx, f1, f2 FROM features)", DETECTOR,
            f"""provisional AS (
  SELECT stream_id * {p} + s AS s, event_start + stream_id * {p} AS event_start, event_end + stream_id * {p} AS event_end FROM results)""",
            _rename(DIRECT, "_true"), _rename(DETECTOR, "_true"))


ORACLE: dict[str, str] = {
    # sources and sinks
    "src_ordered": select(
        SIGNAL, f"SELECT stream_id, i // {W1} AS batch_no, i, voltage, current FROM samples"),
    "src_out_of_order": select(SIGNAL, "SELECT stream_id, i, voltage, current FROM samples"),
    "decode_records": f"""
        WITH marked AS (
          SELECT event_id // {W1} AS batch_no, event_id AS i, value AS voltage, {CURRENT} AS current,
            min(event_id) FILTER (event_type = 'error')
              OVER (PARTITION BY event_id // {W1}) AS bad FROM events)
        SELECT batch_no, i, voltage, current FROM marked WHERE bad IS NULL OR i < bad""",
    "decode_quarantine": f"""
        SELECT event_id // {W1} AS batch_no, event_id AS i FROM events
        WHERE event_type = 'error' AND event_id // {W1} % 5 <> 0
        UNION ALL SELECT DISTINCT event_id // {W1}, NULL::BIGINT FROM events WHERE event_id // {W1} % 5 = 0""",
    "null_readings": f"""
        SELECT 0::BIGINT AS stream_id, event_id // {W1} AS window_no, count(*) AS n, round(avg(v * c), 6) AS p,
          round(sqrt(avg(v * v)) * sqrt(avg(c * c)), 6) AS s
        FROM (SELECT event_id, value AS v, {CURRENT} AS c FROM events WHERE event_type <> 'error')
        GROUP BY event_id // {W1}""",
    "batch_tag": select(SIGNAL, f"SELECT stream_id, i, i // {W1} AS batch_no FROM samples"),
    "event_time": select(
        SIGNAL,
        "SELECT stream_id, i, epoch_ms(TIMESTAMP '2020-01-01 00:00:00') + i AS ts_ms FROM samples"),
    "csv_scan": select(SIGNAL, "SELECT i, voltage, current FROM samples"),
    "row_chunks": """
        SELECT stream_id, i, voltage, row_no, row_no // 1000 AS chunk FROM (
          SELECT user_id % 4 AS stream_id, event_id AS i, value AS voltage,
            CAST(row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id, value) - 1 AS BIGINT)
              AS row_no FROM events)""",
    "feature_array_scan": select(*ONE, f"SELECT idx % {BLOCK} AS idx, {SHOWN} FROM features"),
    "result_json": select(*ONE_RESULTS, JSON_ROWS),
    # projections and window metrics
    "instant_power": select(
        SIGNAL, "SELECT stream_id, i, round(voltage * current, 6) AS power FROM samples"),
    "slot_index": select(SIGNAL, f"SELECT stream_id, i, i % {W1} AS slot FROM samples"),
    "active_power": select(MULTI, POWER, "SELECT stream_id, window_no, round(p, 6) AS p FROM power"),
    "apparent_power": select(MULTI, POWER, "SELECT stream_id, window_no, round(s, 6) AS s FROM power"),
    "reactive_power": select(MULTI, POWER, "SELECT stream_id, window_no, round(q, 6) AS q FROM power"),
    "log_features": select(*MANY, f"SELECT stream_id, window_no, {SHOWN} FROM features"),
    "tumbling_features": select(*MANY, WINDOW_ROWS),
    "window_count": select(
        GAPPY, LOCF, "SELECT stream_id, window_no, n AS size FROM power"),
    "dense_index": select(GAPPY, POWER, FEATURES, "SELECT stream_id, window_no, idx FROM features"),
    "features": select(*MANY, FEATURE_ROWS),
    "locf_features": select(GAPPY, LOCF, FEATURES, FEATURE_ROWS),
    "partition_key": select(
        *ONE,
        f"SELECT stream_id, idx, idx // {P} AS part_key, idx % {P} AS part_offset FROM features"),
    "overlap_partitions": select(
        *ONE, PARTS, "SELECT 0::BIGINT AS stream_id, idx, part_key, part_offset FROM parts"),
    "overlap_suppress": select(
        *ONE, PARTS,
        f"""SELECT 0::BIGINT AS stream_id, idx, part_key, part_offset FROM parts
            WHERE NOT (part_key > 0 AND part_offset < {W2})"""),
    # clustering and event model
    "eps_neighbours": select(
        *ONE_BLOCKS, f"SELECT {BLOCK_KEYS}, a, b, round(dist, 6) AS dist FROM near"),
    "euclid_distance": select(
        *ONE, f"""SELECT a.stream_id, a.idx, round({DISTANCE}, 6) AS dist
        FROM features a JOIN features b ON a.stream_id = b.stream_id AND a.idx = b.idx + 1"""),
    "noise_points": select(
        *ONE_BLOCKS,
        f"SELECT {BLOCK_KEYS}, pos FROM points ANTI JOIN (SELECT *, a AS pos FROM near) USING ({BLOCK_KEYS}, pos)"),
    "cluster_assign": select(*ONE_BLOCKS, f"SELECT {BLOCK_KEYS}, pos, cluster_id FROM assigned"),
    "cluster_stats": select(
        *ONE_BLOCKS, f"SELECT {BLOCK_KEYS}, cluster_id, u, v, n, round(loc, 6) AS loc FROM stats"),
    "cluster_members": select(
        *ONE_BLOCKS, f"""SELECT {BLOCK_KEYS}, cluster_id,
          string_agg(pos::VARCHAR, ',' ORDER BY pos) AS members FROM assigned GROUP BY ALL"""),
    "dense_clusters": select(*ONE_BLOCKS, f"SELECT {BLOCK_KEYS}, cluster_id, u, v, n FROM dense"),
    "cluster_guard": select(*ONE_BLOCKS, "SELECT * FROM guard"),
    "cluster_pairs": select(*ONE_BLOCKS, pairs(BLOCK_KEYS), "SELECT * FROM pairs"),
    "ordered_pairs": select(*ONE_BLOCKS, pairs(BLOCK_KEYS), "SELECT * FROM pairs WHERE v1 < u2"),
    "event_intervals": select(
        *ONE_BLOCKS, REAL, pairs(BLOCK_KEYS, "real"), intervals(BLOCK_KEYS, "v1 < u2"),
        f'SELECT {BLOCK_KEYS}, c1, c2, interval_ AS "interval" FROM intervals'),
    "event_candidates": select(
        *ONE_BLOCKS, pairs(BLOCK_KEYS), intervals(BLOCK_KEYS, "v1 < u2"),
        f'SELECT {BLOCK_KEYS}, c1, c2, interval_ AS "interval" FROM intervals'),
    "event_bounds": select(
        *ONE_BLOCKS, pairs(BLOCK_KEYS), intervals(BLOCK_KEYS, "v1 < u2"),
        f"SELECT {BLOCK_KEYS}, c1, c2, first, last FROM intervals"),
    "candidate_loss": select(
        *ONE_BLOCKS, REAL, pairs(BLOCK_KEYS, "real"), intervals(BLOCK_KEYS, "true", "u1", "v2"),
        f"""SELECT {BLOCK_KEYS}, c1, c2, first, last, a, b, c, a + b + c AS loss FROM (
          SELECT {BLOCK_KEYS}, c1, c2, first, last,
            count(*) FILTER (cluster_id = c2 AND pos <= first - 1) AS a,
            count(*) FILTER (cluster_id = c1 AND pos >= last + 1) AS b,
            count(*) FILTER (pos > first - 1 AND pos < last + 1) AS c
          FROM intervals JOIN assigned USING ({BLOCK_KEYS})
          WHERE cluster_id = c1 OR cluster_id = c2 GROUP BY ALL)"""),
    "best_candidate": select(
        *ONE_BLOCKS, pairs(BLOCK_KEYS), intervals(BLOCK_KEYS, "v1 < u2"),
        # Every candidate of the event model has loss 0, so the first pair wins.
        f"""SELECT {BLOCK_KEYS}, 0::BIGINT AS loss, c1, c2, first, last FROM intervals
            QUALIFY row_number() OVER (PARTITION BY {BLOCK_KEYS} ORDER BY c1, c2) = 1"""),
    "suffix_cuts": select(
        *ONE, BLOCKS,
        f"""SELECT {BLOCK_KEYS}, CAST(cut AS INTEGER) AS cut, pos, round(f1, 6) AS f1
            FROM points, LATERAL (SELECT unnest(range(0, pos + 1)) AS cut)"""),
    "shift_indices": select(
        *ONE_BLOCKS, f"""SELECT {BLOCK_KEYS}, cluster_id,
          string_agg((pos + window_id * {BLOCK})::VARCHAR, ',' ORDER BY pos) AS indices
          FROM assigned GROUP BY ALL"""),
    # frames
    "prefix_counts": select(
        *ONE, BLOCKS, f"""SELECT {BLOCK_KEYS}, pos, count(*) OVER w AS n,
          round(min(f1) OVER w, 6) AS low, round(max(f1) OVER w, 6) AS high FROM points
          WINDOW w AS (PARTITION BY {BLOCK_KEYS} ORDER BY pos
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""),
    "trailing_buffer": select(
        *ONE, f"""SELECT stream_id, idx, count(*) OVER w AS buffered, min(idx) OVER w AS first_idx
          FROM features WINDOW w AS (PARTITION BY stream_id ORDER BY idx
            ROWS BETWEEN {12 * W2 + 1} PRECEDING AND CURRENT ROW)"""),
    # detection
    "detect_events": select(
        *ONE_RESULTS, "SELECT stream_id, s, event_s, event_start, event_end FROM results WHERE d"),
    "detect_all_rows": select(*ONE_RESULTS, RESULT_ROWS),
    "detect_partitioned": select(*MANY_RESULTS, RESULT_ROWS),
    "detect_first": select(
        *MANY_RESULTS,
        """SELECT stream_id, s, event_s, event_start, event_end FROM results WHERE d
           QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY s) = 1"""),
    "detect_udtf": select(*ONE_RESULTS, RESULT_ROWS),
    "window_resets": select(
        *ONE_RESULTS,
        """SELECT stream_id, idx, new_start, by_event FROM (
             SELECT stream_id, t AS idx, st AS new_start, b IS NOT NULL AS by_event,
               coalesce(lag(st) OVER (PARTITION BY stream_id ORDER BY t), 0) AS old_start FROM walked)
           WHERE new_start <> old_start"""),
    "sorted_results": select(*MANY_RESULTS, RESULT_ROWS + " ORDER BY stream_id, s"),
    # results
    "provisional_results": select(*ONE, PARTS, DETECTOR, provisional(P), "SELECT * FROM provisional"),
    "reconcile_merge": select(
        *both(130),
        """SELECT stream_id, s, r.d, r.event_s, p.d AND NOT r.d AS retracted
           FROM provisional p JOIN results_true r USING (stream_id, s)"""),
    "pending_minus_verified": select(
        *both(P),
        """SELECT stream_id, s, event_s FROM provisional p WHERE NOT EXISTS (
             SELECT 1 FROM results_true r WHERE r.d AND r.stream_id = p.stream_id AND r.s = p.s)"""),
    "range_lookup": select(
        *ONE_RESULTS, f"""SELECT f.stream_id, r.s AS region_id, f.idx, {SHOWN} FROM results r
          JOIN features f ON r.d AND f.stream_id = r.stream_id
            AND f.idx BETWEEN r.event_start AND r.event_end"""),
    "recheck_points": select(
        *ONE_RESULTS, f"""SELECT stream_id, idx, window_no FROM features
          WHERE (stream_id, idx) IN (
            SELECT stream_id, event_end + {2 * (W2 + 1)} FROM results WHERE d)"""),
    "latest_recheck": select(
        *MANY_RESULTS, f"""SELECT stream_id, max(event_end) + {2 * (W2 + 1)} AS latest_recheck
          FROM results WHERE d GROUP BY ALL"""),
    "release_below_bound": select(
        *MANY_RESULTS, """SELECT r.* FROM results r JOIN (
          SELECT stream_id, max(event_end) AS bound FROM results WHERE d GROUP BY ALL) b
          ON r.stream_id = b.stream_id AND r.s < b.bound"""),
    "contiguous_prefix": select(
        GAPPY, POWER, f"""SELECT stream_id, s, n FROM (
          SELECT stream_id, window_no AS s, n,
            row_number() OVER (PARTITION BY stream_id ORDER BY window_no) - 1 AS place
          FROM power WHERE n * 10 > {W1 * 6}) WHERE s = place"""),
    # streaming
    "stream_tumbling": select(*ONE, WINDOW_ROWS),
    "stream_out_of_order": select(SIGNAL, POWER, FEATURES, WINDOW_ROWS),
    "stream_locf": select(GAPPY, LOCF, FEATURES, FEATURE_ROWS),
    "stream_sort": select(SIGNAL, "SELECT stream_id, i, voltage, current FROM samples"),
    "stream_detect": select(*MANY_RESULTS, RESULT_ROWS),
    "stream_end_mark": select(*MANY, FEATURE_ROWS),
    "stream_unequal_clocks": select(
        f"""samples AS (
  SELECT event_id % 2 AS stream_id, event_id + (event_id % 2) * {1000 * W1} AS i, value AS voltage, {CURRENT} AS current
  FROM events)""", POWER, FEATURES, WINDOW_ROWS),
    "detect_steps": select(*MANY_RESULTS, RESULT_ROWS),
    "late_rows": select(
        SIGNAL, f"""files AS (SELECT greatest(10, max(i) // {W1} // 6) AS width FROM samples),
sent AS (SELECT *, i // {W1} AS window_no, (i // {W1} + (i * 7919) % (2 * width)) AS batch_no FROM samples, files),
clocks AS (SELECT stream_id, batch_no // width AS step, max(batch_no) AS newest FROM sent GROUP BY ALL),
closed AS (SELECT stream_id, step, max(newest) OVER (PARTITION BY stream_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM clocks)""",
        f"""SELECT s.stream_id, i, voltage, current, coalesce(window_no <= before - {PARAMS.max_latency + 1}, false) AS late
          FROM sent s JOIN closed c ON c.stream_id = s.stream_id AND c.step = s.batch_no // s.width"""),
    "stream_from_history": select(*MANY_RESULTS, RESULT_ROWS),
    "stream_trailing": select(
        *MANY, f"""SELECT stream_id, idx, count(*) OVER w AS buffered, min(idx) OVER w AS first_idx,
            round(min(f1) OVER w, 6) AS low, round(max(f1) OVER w, 6) AS high
          FROM features WINDOW w AS (PARTITION BY stream_id ORDER BY idx ROWS BETWEEN {12 * W2 + 1} PRECEDING AND CURRENT ROW)"""),
    "state_audit": select(
        MULTI, f"""sent AS (SELECT *, i // {W1} AS window_no, i // {W1} + (i * 7919) % {PARAMS.max_latency + 1} AS batch_no FROM samples),
clocks AS (SELECT stream_id, max(batch_no) - {PARAMS.max_latency + 1} AS closed FROM sent GROUP BY ALL)""",
        """SELECT c.stream_id, closed, count(DISTINCT window_no) AS waiting, min(window_no) AS oldest, max(window_no) AS newest
          FROM clocks c LEFT JOIN sent s ON s.stream_id = c.stream_id AND s.window_no > c.closed GROUP BY ALL"""),
    "stream_idle_close": select(*MANY, WINDOW_ROWS),
    "stream_verify": select(
        *alone(130), """SELECT r.*, r.event_start IS DISTINCT FROM p.event_start OR r.event_end IS DISTINCT FROM p.event_end AS corrected
          FROM results_true r JOIN provisional p USING (s)"""),
    "stream_upsert": select(*ONE_RESULTS, RESULT_ROWS),
    "e2e_ordered": select(*ONE_RESULTS, JSON_ROWS),
    "e2e_out_of_order": select(GAPPY, LOCF, FEATURES, DIRECT, DETECTOR, JSON_ROWS),
}

_WHOLE = BLOCKS.replace("points AS", "whole_points AS", 1)
_BACK = select(
    *ONE, _WHOLE, CUTS, clusters(CUT_KEYS), pairs(CUT_KEYS), intervals(CUT_KEYS, "v1 < u2"),
    f"""best AS (
  SELECT {CUT_KEYS}, first, last FROM intervals
  QUALIFY row_number() OVER (PARTITION BY {CUT_KEYS} ORDER BY c1, c2) = 1)""",
    f"""unbroken AS (
  SELECT * FROM best
  QUALIFY row_number() OVER (PARTITION BY {BLOCK_KEYS} ORDER BY cut) = cut + 1)""",
    f"""SELECT {BLOCK_KEYS}, cut, first + 1 AS event_start, last + 1 AS event_end FROM unbroken
QUALIFY row_number() OVER (PARTITION BY {BLOCK_KEYS} ORDER BY cut DESC) = 1""",
)
ORACLE["backward_pass"] = _BACK
ORACLE["stream_contiguous"] = ORACLE["contiguous_prefix"]
ORACLE["stream_recheck"] = ORACLE["recheck_points"]
ORACLE["detect_window"] = (
    f"SELECT {BLOCK_KEYS}, event_start, event_end FROM ({_BACK})"
)
