"""Queries on visibility, probing and update sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.functions.timegrid import floor_to, grid, seconds
from sluice.operators import calibration, comparison, phases, quality, restoration, sessions, states, visibility
from sluice.operators.asof import asof_backward, at_every

from .adapters import CLASS_SQL, DAY, EVENTS_SQL, GRID, PHASES, PHASES_SQL, SIGNAL_SQL, START, UPDATES_SQL, VISIBILITY_SQL, case_sql, classification, events, query, rounded, signal, table, updates
from .adapters import visibility as seen

RATIOS = [round(0.05 * k, 2) for k in range(1, 20)]
_ELEMS = f"(SELECT t - t % {DAY} AS ts, 'c' || CAST(event_id % 3 AS VARCHAR) AS collector, event_id % 12 AS peer_asn, user_id % 50 AS prefix, CASE WHEN user_id % 5 = 0 THEN 6 ELSE 4 END AS family, user_id AS origin, event_id % 7 AS upstream FROM {EVENTS_SQL})"


@query(f"""
    WITH e AS {_ELEMS}, full_feed AS (SELECT ts, collector, peer_asn, family FROM e GROUP BY ALL HAVING count(*) >= CASE WHEN family = 4 THEN 20 ELSE 6 END),
    total AS (SELECT ts, family, count(*) AS n FROM full_feed GROUP BY ALL)
    SELECT e.ts, CAST(e.prefix AS BIGINT) AS prefix, CAST(e.family AS INTEGER) AS family, min(e.origin) AS origin_asn,
           count(DISTINCT CASE WHEN f.ts IS NOT NULL THEN e.collector || '-' || CAST(e.peer_asn AS VARCHAR) END) AS peers_seen, CAST(coalesce(any_value(t.n), 0) AS BIGINT) AS peers_total,
           round(coalesce(count(DISTINCT CASE WHEN f.ts IS NOT NULL THEN e.collector || '-' || CAST(e.peer_asn AS VARCHAR) END) / CAST(any_value(t.n) AS DOUBLE), 0), 9) AS visibility,
           array_to_string(list_sort(list(DISTINCT e.upstream)), ',') AS upstreams
    FROM e LEFT JOIN full_feed f USING (ts, collector, peer_asn, family) LEFT JOIN total t ON t.ts = e.ts AND t.family = e.family GROUP BY e.ts, e.prefix, e.family
""")
def visibility_fraction(spark, sf_dir):
    e = events(spark, sf_dir).select(
        floor_to(F.col("t"), DAY).alias("ts"), F.concat(F.lit("c"), (F.col("event_id") % 3).cast("string")).alias("collector"), (F.col("event_id") % 12).alias("peer_asn"), F.lit("").alias("peer_address"),
        (F.col("user_id") % 50).alias("prefix"), F.when(F.col("user_id") % 5 == 0, 6).otherwise(4).alias("family"), F.col("user_id").alias("origin"), (F.col("event_id") % 7).alias("upstream"),
    )
    return rounded(visibility.visibility(e, {4: 20, 6: 6}), "visibility")


@query(f"""
    WITH e AS {_ELEMS}, full_feed AS (SELECT ts, collector, peer_asn, family FROM e GROUP BY ALL HAVING count(*) >= CASE WHEN family = 4 THEN 20 ELSE 6 END)
    SELECT ts, collector, count(*) FILTER (family = 4) AS ipv4, count(*) FILTER (family = 6) AS ipv6 FROM full_feed GROUP BY ts, collector
""")
def fullfeed_by_collector(spark, sf_dir):
    e = events(spark, sf_dir).select(
        floor_to(F.col("t"), DAY).alias("ts"), F.concat(F.lit("c"), (F.col("event_id") % 3).cast("string")).alias("collector"), (F.col("event_id") % 12).alias("peer_asn"), F.lit("").alias("peer_address"),
        F.when(F.col("user_id") % 5 == 0, 6).otherwise(4).alias("family"),
    )
    return visibility.fullfeed_by_collector(visibility.full_feed_peers(e, {4: 20, 6: 6}))


_BY_TYPE = f"SELECT ts, coalesce(nullif(c.type, ''), 'unclassified') AS type, avg(visibility) AS visibility_mean, median(visibility) AS visibility_median, count(DISTINCT prefix) AS n_prefixes FROM {VISIBILITY_SQL} v LEFT JOIN {CLASS_SQL} c ON c.asn = v.origin_asn GROUP BY 1, 2"


@query(f"SELECT ts, type, round(visibility_mean, 9) AS visibility_mean, round(visibility_median, 9) AS visibility_median, n_prefixes FROM ({_BY_TYPE})")
def visibility_by_type(spark, sf_dir):
    return rounded(visibility.by_type(seen(spark, sf_dir), classification(spark, sf_dir)), "visibility_mean", "visibility_median")


@query(f"SELECT {case_sql('ts', PHASES)} AS phase, type, round(avg(visibility_mean), 9) AS visibility_mean FROM ({_BY_TYPE}) WHERE {case_sql('ts', PHASES)} IS NOT NULL GROUP BY 1, 2")
def visibility_by_type_by_phase(spark, sf_dir):
    types = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "unclassified"]
    wide = phases.type_means(visibility.by_type(seen(spark, sf_dir), classification(spark, sf_dir)), PHASES, types)
    return rounded(wide.unpivot("phase", types, "type", "visibility_mean").where("visibility_mean IS NOT NULL"), "visibility_mean")


@query(f"SELECT ts, origin_asn AS asn, max(visibility) AS visibility FROM {VISIBILITY_SQL} GROUP BY ALL")
def per_as_visibility(spark, sf_dir):
    return visibility.per_as(seen(spark, sf_dir))


_TIMELINE = f"""
    vis AS {VISIBILITY_SQL}, sig AS {SIGNAL_SQL}, per_as AS (SELECT ts, origin_asn AS asn, max(visibility) AS v FROM vis GROUP BY ALL),
    dense AS (SELECT t.ts, a.asn, coalesce(p.v, 0.0) AS visibility FROM (SELECT DISTINCT ts FROM vis) t CROSS JOIN (SELECT DISTINCT origin_asn AS asn FROM vis) a LEFT JOIN per_as p ON p.ts = t.ts AND p.asn = a.asn),
    clean AS (SELECT ts, asn, max(value) AS value FROM sig WHERE value IS NOT NULL GROUP BY ALL),
    base AS (SELECT asn, avg(CASE WHEN value > 0 THEN 1.0 ELSE 0 END) >= 0.5 AND median(value) >= 5 AS adequate, median(value) AS med FROM sig WHERE value IS NOT NULL AND ts < {PHASES[0].end} GROUP BY asn),
    timeline AS (
        SELECT d.ts, d.asn, d.visibility, c.value AS probing, CASE WHEN b.adequate THEN b.med END AS probing_baseline, coalesce(b.adequate, false) AS probing_adequate,
               CASE WHEN d.visibility < 0.5 THEN 'withdrawn' WHEN b.adequate AND b.med > 0 AND c.value < 0.8 * b.med THEN 'dark' ELSE 'reachable' END AS state
        FROM dense d ASOF LEFT JOIN clean c ON c.asn = d.asn AND d.ts >= c.ts LEFT JOIN base b ON b.asn = d.asn)"""


def _timeline(spark, sf_dir):
    sig = signal(spark, sf_dir)
    return states.state_timeline(seen(spark, sf_dir), sig, sig.where(F.col("ts") < PHASES[0].end), dark_ratio=0.8)


@query(f"WITH {_TIMELINE} SELECT ts, asn, round(visibility, 9) AS visibility, round(probing, 9) AS probing, round(probing_baseline, 9) AS probing_baseline, probing_adequate, state FROM timeline")
def state_timeline(spark, sf_dir):
    return rounded(_timeline(spark, sf_dir), "visibility", "probing", "probing_baseline")


@query(f"""WITH {_TIMELINE}, inside AS (SELECT *, {case_sql('ts', PHASES)} AS phase FROM timeline)
    SELECT p.phase, round(avg(CASE WHEN state = 'dark' THEN 1.0 WHEN state IS NOT NULL THEN 0 END), 9) AS dark_share, round(avg(CASE WHEN state = 'withdrawn' THEN 1.0 WHEN state IS NOT NULL THEN 0 END), 9) AS withdrawn_share, nullif(count(state), 0) AS n
    FROM {PHASES_SQL} LEFT JOIN inside i ON i.phase = phases.phase, LATERAL (SELECT phases.phase AS phase) p GROUP BY p.phase""")
def phase_shares(spark, sf_dir):
    return rounded(phases.state_shares(_timeline(spark, sf_dir), PHASES), "dark_share", "withdrawn_share")


_INSTANTS = [START, START + 3 * GRID, START + 40 * GRID, START + 1, START + 400 * GRID]


@query(f"""WITH {_TIMELINE} SELECT CAST(i.ts AS BIGINT) AS ts, round(avg(CASE WHEN state = 'dark' THEN 1.0 WHEN state IS NOT NULL THEN 0 END), 9) AS dark_share, round(avg(CASE WHEN state = 'withdrawn' THEN 1.0 WHEN state IS NOT NULL THEN 0 END), 9) AS withdrawn_share, count(state) AS n
    FROM (VALUES {', '.join(f'({t})' for t in _INSTANTS)}) AS i(ts) LEFT JOIN timeline t ON t.ts = i.ts GROUP BY i.ts""")
def snapshot_trajectory(spark, sf_dir):
    return rounded(phases.snapshot_trajectory(_timeline(spark, sf_dir), _INSTANTS), "dark_share", "withdrawn_share")


@query(f"WITH sig AS {SIGNAL_SQL}, base AS (SELECT asn, avg(CASE WHEN value > 0 THEN 1.0 ELSE 0 END) AS s, median(value) AS m FROM sig WHERE value IS NOT NULL AND ts < {START + DAY} GROUP BY asn) SELECT a.asn, round(s, 4) AS nonzero_share, m AS median FROM (SELECT DISTINCT user_id AS asn FROM events) a LEFT JOIN base b ON b.asn = a.asn WHERE NOT coalesce(s >= 0.5 AND m >= 40, false)")
def probing_exclusions(spark, sf_dir):
    base = states.probing_baseline(signal(spark, sf_dir).where(F.col("ts") < START + DAY), "asn", 0.5, 40)
    return states.exclusions(base, events(spark, sf_dir).select(F.col("user_id").alias("asn")))


_UPSTREAMS = """sets AS (SELECT l_partkey % 300 AS asn, (epoch_us(l_shipdate) // 1000000) - (epoch_us(l_shipdate) // 1000000) % 2592000 AS ts, list_sort(list(DISTINCT l_suppkey)) AS u FROM lineitem WHERE l_partkey % 300 > 0 GROUP BY 1, 2),
    texts AS (SELECT asn, ts, array_to_string(u, ',') AS upstreams, len(u) AS n_upstreams FROM sets)"""


def _upstreams(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 300).alias("origin_asn"), floor_to(seconds(F.col("l_shipdate")), 2_592_000).alias("ts"), F.col("l_suppkey").cast("string").alias("upstreams"))
    return sessions.transitions(visibility.upstream_sets(rows))


@query(f"WITH {_UPSTREAMS} SELECT asn, ts, upstreams, lag(upstreams) OVER w AS prev_upstreams, coalesce(lag(upstreams) OVER w <> upstreams, false) AS changed, CAST(n_upstreams AS INTEGER) AS n_upstreams FROM texts WINDOW w AS (PARTITION BY asn ORDER BY ts)")
def upstream_transitions(spark, sf_dir):
    return _upstreams(spark, sf_dir)


_CHANGED = f"tr AS (SELECT ts, asn, coalesce(lag(n) OVER (PARTITION BY asn ORDER BY ts) <> n, false) AS changed FROM (SELECT t - t % {GRID} AS ts, user_id AS asn, count(*) AS n FROM {EVENTS_SQL} GROUP BY ALL))"


def _changes(spark, sf_dir):
    counts = events(spark, sf_dir).groupBy(floor_to(F.col("t"), GRID).alias("ts"), F.col("user_id").alias("asn")).agg(F.count("*").alias("n"))
    return sessions.transitions(counts, value="n").select("ts", "asn", "changed")


@query(f"WITH {_CHANGED} SELECT phases.phase, round(avg(CASE WHEN changed THEN 1.0 WHEN changed IS NOT NULL THEN 0 END), 9) AS transition_rate, nullif(count(changed), 0) AS n FROM {PHASES_SQL} LEFT JOIN tr ON tr.ts >= p_start AND tr.ts < p_end GROUP BY phases.phase")
def transition_rates(spark, sf_dir):
    return rounded(phases.transition_rates(_changes(spark, sf_dir), PHASES), "transition_rate")


_SHIFTS = [k * DAY // 2 for k in range(-6, 7)]


@query(f"""WITH {_TIMELINE}, {_CHANGED}, shifts AS (SELECT unnest({_SHIFTS}) AS shift),
    w AS (SELECT shift, phase, p_start + CASE WHEN phase = 'P2' THEN shift ELSE 0 END AS a, p_end + CASE WHEN phase = 'P1' THEN shift ELSE 0 END AS b FROM shifts CROSS JOIN {PHASES_SQL}),
    d AS (SELECT shift, phase, round(avg(CASE WHEN state = 'dark' THEN 1.0 ELSE 0 END), 9) AS dark_share FROM w JOIN timeline ON ts >= a AND ts < b GROUP BY ALL),
    r AS (SELECT shift, phase, round(avg(CASE WHEN changed THEN 1.0 ELSE 0 END), 9) AS transition_rate FROM w JOIN tr ON ts >= a AND ts < b GROUP BY ALL)
    SELECT CAST(w.shift AS BIGINT) AS shift, w.phase, dark_share, transition_rate FROM w LEFT JOIN d USING (shift, phase) LEFT JOIN r USING (shift, phase)""")
def boundary_sweep(spark, sf_dir):
    return rounded(phases.boundary_sweep(_timeline(spark, sf_dir), _changes(spark, sf_dir), PHASES, "P1", _SHIFTS), "dark_share", "transition_rate")


_FLAP = "event = 'withdraw' AND coalesce(lead(event) OVER s = 'announce' AND (lead(ts) OVER s) - ts <= 86400, false)"


@query(f"SELECT seq, prefix, ts, event, {_FLAP} AS is_flap FROM {UPDATES_SQL} WINDOW s AS (PARTITION BY prefix, asn, peer_asn ORDER BY ts, seq)")
def flap_mask(spark, sf_dir):
    return sessions.flag_flaps(updates(spark, sf_dir), DAY).select("seq", "prefix", "ts", "event", "is_flap")


@query(f"SELECT seq, prefix, gap_s FROM (SELECT seq, prefix, event, lag(event) OVER s AS before, ts - (lag(ts) OVER s) AS gap_s FROM {UPDATES_SQL} WINDOW s AS (PARTITION BY prefix, asn, peer_asn ORDER BY ts, seq)) WHERE event = 'announce' AND before = 'withdraw'")
def reannounce_gaps(spark, sf_dir):
    return sessions.reannounce_gaps(updates(spark, sf_dir)).select("seq", "prefix", "gap_s")


@query(f"SELECT CAST(threshold AS BIGINT) AS threshold, count(*) AS n_withdrawals, count(*) FILTER (gap <= threshold) AS n_flaps FROM (SELECT event, CASE WHEN lead(event) OVER s = 'announce' THEN (lead(ts) OVER s) - ts END AS gap FROM {UPDATES_SQL} WINDOW s AS (PARTITION BY prefix, asn, peer_asn ORDER BY ts, seq)) CROSS JOIN (VALUES (30), (3600), (43200), (86400)) AS x(threshold) WHERE event = 'withdraw' GROUP BY threshold")
def flap_variants(spark, sf_dir):
    return sessions.flap_variants(updates(spark, sf_dir), [30, 3600, 43_200, 86_400])


_FIRST = f'(SELECT "window", prefix, min(ts) AS t FROM (SELECT *, {_FLAP} AS f FROM {UPDATES_SQL} WINDOW s AS (PARTITION BY prefix, asn, peer_asn ORDER BY ts, seq)) WHERE event = \'withdraw\' AND NOT f GROUP BY ALL)'
_Q = lambda p: f"quantile_cont(t, {p})"


@query(f"""SELECT "window", count(*) AS n_prefixes_withdrawn, min(t) AS t_first, max(t) AS t_last, CAST(trunc({_Q(0.05)}) AS BIGINT) AS t_p5, CAST(trunc({_Q(0.95)}) AS BIGINT) AS t_p95, max(t) - min(t) AS duration_s,
    CAST(trunc({_Q(0.95)} - {_Q(0.05)}) AS BIGINT) AS duration_p5_p95_s, {', '.join(f'CAST(trunc({_Q(p / 100)} - min(t)) AS BIGINT) AS duration_p{p}_s' for p in (50, 90, 99))} FROM {_FIRST} GROUP BY "window" """)
def event_speed(spark, sf_dir):
    return restoration.event_speed(sessions.drop_flaps(updates(spark, sf_dir), DAY))


@query(f"""SELECT count(*) AS n_prefixes, min(t) AS t_min, {', '.join(f'CAST(trunc({_Q(p / 100)}) AS BIGINT) AS t_p{p}' for p in (5, 50, 95))}, max(t) AS t_max
    FROM (SELECT prefix, min(ts) AS t FROM (SELECT *, {_FLAP} AS f FROM {UPDATES_SQL} WINDOW s AS (PARTITION BY prefix, asn, peer_asn ORDER BY ts, seq)) WHERE event = 'withdraw' AND NOT f AND ts >= {PHASES[2].start} GROUP BY prefix)""")
def withdrawal_wave(spark, sf_dir):
    return restoration.wave_timing(sessions.drop_flaps(updates(spark, sf_dir), DAY), PHASES[2].start)


@query(f"SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'click' THEN event_id % 50 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), -1) AS asn FROM {EVENTS_SQL} WHERE event_type IN ('click', 'error')")
def last_origin(spark, sf_dir):
    e = events(spark, sf_dir).where("event_type IN ('click', 'error')").withColumn("type", F.when(F.col("event_type") == "click", "A").otherwise("W"))
    return sessions.attribute_withdrawals(e, F.col("event_id") % 50, ("user_id",), ("event_id",)).select("event_id", "asn")


_CONTROLS = f"""sig AS {SIGNAL_SQL}, base AS (SELECT asn, median(value) AS baseline FROM sig WHERE value IS NOT NULL AND ts < {PHASES[0].end} GROUP BY asn HAVING avg(CASE WHEN value > 0 THEN 1.0 ELSE 0 END) >= 0.5 AND median(value) >= 5),
    clean AS (SELECT ts, asn, max(value) AS value FROM sig WHERE value IS NOT NULL GROUP BY ALL), grid AS (SELECT unnest(generate_series({START}, {START + 30 * DAY - 1}, {GRID})) AS ts),
    readings AS (SELECT * FROM (SELECT g.ts, b.asn, b.baseline, c.value AS probing FROM grid g CROSS JOIN base b ASOF LEFT JOIN clean c ON c.asn = b.asn AND g.ts >= c.ts) WHERE probing IS NOT NULL)"""


def _controls(spark, sf_dir, ratio=0.8):
    sig = signal(spark, sf_dir)
    return states.control_dark_rows(grid(spark, START, START + 30 * DAY, GRID), sig, sig.where(F.col("ts") < PHASES[0].end), ratio)


@query(f"WITH {_CONTROLS} SELECT ts, count(DISTINCT asn) AS n_controls, round(avg(CASE WHEN probing < 0.8 * baseline THEN 1.0 ELSE 0 END), 9) AS dark_share, avg(CASE WHEN probing < 0.8 * baseline THEN 1.0 ELSE 0 END) >= 0.5 AS artifact FROM readings GROUP BY ts")
def dark_share_controls(spark, sf_dir):
    return rounded(states.control_dark_shares(_controls(spark, sf_dir), 0.5), "dark_share")


_SWEEP = f"SELECT ratio, count(*) AS n, count(DISTINCT asn) AS n_asns, avg(CASE WHEN probing < ratio * baseline THEN 1.0 ELSE 0 END) AS false_dark_rate FROM readings CROSS JOIN (SELECT unnest({RATIOS}::DOUBLE[]) AS ratio) GROUP BY ratio"


@query(f"WITH {_CONTROLS} SELECT ratio, n, n_asns, round(false_dark_rate, 9) AS false_dark_rate FROM ({_SWEEP})")
def threshold_sweep(spark, sf_dir):
    return rounded(calibration.dark_ratio_sweep(_controls(spark, sf_dir), RATIOS), "false_dark_rate")


@query(f"WITH {_CONTROLS} SELECT max(CASE WHEN false_dark_rate < 0.3 THEN ratio END) AS ratio FROM ({_SWEEP})")
def largest_ratio(spark, sf_dir):
    return calibration.largest_ratio_under(calibration.dark_ratio_sweep(_controls(spark, sf_dir), RATIOS), 0.3)


@query(f"WITH sig AS (SELECT * FROM {SIGNAL_SQL}), ref AS (SELECT median(value) AS m FROM sig WHERE ts < {PHASES[0].end}) SELECT ts, asn, round(value / nullif(m, 0), 9) AS ratio FROM sig, ref")
def baseline_ratio(spark, sf_dir):
    sig = signal(spark, sf_dir)
    return rounded(calibration.to_baseline_median(sig, sig.where(F.col("ts") < PHASES[0].end)).select("ts", "asn", "ratio"), "ratio")


@query(f"WITH s AS (SELECT user_id AS asn, t AS ts FROM {EVENTS_SQL}), d AS (SELECT asn, ts, ts - lag(ts) OVER (PARTITION BY asn ORDER BY ts) AS diff FROM s), m AS (SELECT asn, diff FROM (SELECT asn, diff, row_number() OVER (PARTITION BY asn ORDER BY count(*) DESC, diff) AS k FROM d WHERE diff IS NOT NULL GROUP BY asn, diff) WHERE k = 1), n AS (SELECT asn, count(*) AS n, min(ts) AS a, max(ts) AS b FROM s GROUP BY asn HAVING count(*) >= 2) SELECT n.asn, n.n, m.diff AS step, (SELECT count(*) FROM d WHERE d.asn = n.asn AND (d.diff <= 0 OR d.diff % nullif(m.diff, 0) <> 0)) AS n_irregular, a >= {START} + m.diff AS starts_late, b < {START + 30 * DAY} - m.diff AS ends_early FROM n JOIN m USING (asn)")
def native_step_qc(spark, sf_dir):
    return quality.native_steps(events(spark, sf_dir).select(F.col("user_id").alias("asn"), F.col("t").alias("ts")), ["asn"], START, START + 30 * DAY)


_KEYS = f"SELECT user_id AS asn, CAST((t - {START}) // {DAY} AS BIGINT) AS day FROM {EVENTS_SQL} GROUP BY ALL"


@query(f"WITH have AS ({_KEYS}), want AS (SELECT a.asn, d.day FROM (SELECT DISTINCT user_id AS asn FROM events) a CROSS JOIN (SELECT CAST(unnest(generate_series(0, 27)) AS BIGINT) AS day) d) SELECT *, 'missing' AS problem FROM (SELECT * FROM want EXCEPT SELECT * FROM have) UNION ALL SELECT *, 'extra' AS problem FROM (SELECT * FROM have EXCEPT SELECT * FROM want)")
def inventory_gaps(spark, sf_dir):
    have = events(spark, sf_dir).select(F.col("user_id").alias("asn"), F.floor((F.col("t") - START) / DAY).alias("day"))
    want = at_every(have.select("asn").distinct(), spark.range(28).withColumnRenamed("id", "day"), "day")
    return quality.missing_keys(want, have, ["asn", "day"])


@query(f"SELECT ts, next_ts, next_ts - ts AS gap_s FROM (SELECT ts, lead(ts) OVER (ORDER BY ts) AS next_ts FROM (SELECT DISTINCT t - t % 60 AS ts FROM {EVENTS_SQL})) WHERE next_ts - ts > 600")
def time_gaps(spark, sf_dir):
    return quality.time_gaps(events(spark, sf_dir).select(floor_to(F.col("t"), 60).alias("ts")), 600)


@query(f"WITH d AS (SELECT t // {DAY} AS day, count(*) AS n FROM {EVENTS_SQL} GROUP BY ALL), m AS (SELECT median(n) AS median FROM d) SELECT day, n, median FROM d, m WHERE abs(n - median) > 0.05 * median")
def median_drift(spark, sf_dir):
    days = events(spark, sf_dir).groupBy(F.floor(F.col("t") / DAY).alias("day")).agg(F.count("*").alias("n"))
    return quality.median_drift(days, "n", 0.05)


@query("WITH c AS (SELECT quality AS a, toxic AS b, count(*) AS k FROM labels GROUP BY ALL), n AS (SELECT CAST(sum(k) AS BIGINT) AS n, sum(CASE WHEN a = b THEN k ELSE 0 END) / CAST(sum(k) AS DOUBLE) AS po FROM c), pe AS (SELECT sum(x.k * y.k) AS s FROM (SELECT a AS v, sum(k) AS k FROM c GROUP BY a) x JOIN (SELECT b AS v, sum(k) AS k FROM c GROUP BY b) y USING (v)) SELECT n, round(po, 9) AS observed, round(s / (CAST(n AS DOUBLE) * n), 9) AS expected, round((po - s / (CAST(n AS DOUBLE) * n)) / (1 - s / (CAST(n AS DOUBLE) * n)), 9) AS kappa FROM n, pe")
def kappa(spark, sf_dir):
    return rounded(comparison.kappa(table(spark, sf_dir, "labels"), "quality", "toxic"), "observed", "expected", "kappa")


@query(f"SELECT e.event_id, e.user_id AS asn, p.value AS probing FROM (SELECT event_id, user_id, t FROM {EVENTS_SQL} WHERE event_type = 'view') e ASOF LEFT JOIN (SELECT asn, ts, max(value) AS value FROM {SIGNAL_SQL} WHERE value IS NOT NULL GROUP BY ALL) p ON p.asn = e.user_id AND e.t >= p.ts")
def asof_signal(spark, sf_dir):
    views = events(spark, sf_dir).where("event_type = 'view'").select("event_id", F.col("user_id").alias("asn"), F.col("t").alias("ts"))
    return asof_backward(views, signal(spark, sf_dir), ["asn"], "value", into="probing").drop("ts")
