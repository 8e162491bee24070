"""Queries of thresholds in grids and of runs compared snapshot by snapshot."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.functions.timegrid import floor_to
from sluice.operators import calibration, comparison, leaveout, quality

from .adapters import EVENTS_SQL, GRID, events, query, rounded

ANNOUNCED = [0.1, 0.25, 0.5, 0.75, 0.9]
DARK = [0.1, 0.2, 0.5, 1.0, 2.0]
_ROWS = f"(SELECT CAST((event_id * 7919) % 101 AS DOUBLE) / 100 AS v, CASE WHEN event_id % 8 > 0 THEN value END AS p, CASE WHEN user_id % 9 > 0 THEN CAST(user_id % 30 * 5 AS DOUBLE) END AS b FROM {EVENTS_SQL})"
_A, _D = (f"(SELECT CAST(unnest({xs}) AS DOUBLE) AS {name})" for xs, name in ((ANNOUNCED, "announced_min"), (DARK, "dark_ratio")))


@query(f"""SELECT announced_min, dark_ratio, count(*) AS n, count(*) FILTER (v < announced_min) AS n_withdrawn, count(*) FILTER (NOT v < announced_min AND coalesce(b > 0 AND p < dark_ratio * b, false)) AS n_dark,
    count(*) FILTER (NOT v < announced_min AND NOT coalesce(b > 0 AND p < dark_ratio * b, false)) AS n_reachable FROM {_ROWS} CROSS JOIN {_A} CROSS JOIN {_D} GROUP BY ALL""")
def state_share_grid(spark, sf_dir):
    """How many events are withdrawn, dark and reachable under every pair of thresholds."""
    rows = events(spark, sf_dir).select(
        (((F.col("event_id") * 7919) % 101).cast("double") / 100).alias("visibility"), F.when(F.col("event_id") % 8 > 0, F.col("value")).alias("probing"),
        F.when(F.col("user_id") % 9 > 0, (F.col("user_id") % 30 * 5).cast("double")).alias("baseline"),
    )
    return calibration.state_grid(rows, ANNOUNCED, DARK)


_RUN = f"""(SELECT ts, prefix, seq, seq % 40 AS seen, CASE WHEN seq % 5 = 0 THEN 'TR' WHEN seq % 5 = 1 THEN NULL ELSE 'IR' END AS cc, CAST(seq // 64 % 3 AS VARCHAR) AS audit
    FROM (SELECT t - t % {GRID} AS ts, 'p' || CAST(event_id % 200 AS VARCHAR) AS prefix, max(event_id) AS seq FROM {EVENTS_SQL} GROUP BY ALL))"""


@query(f"""WITH a AS (SELECT * FROM {_RUN} WHERE seq % 17 > 0), b AS (SELECT ts, prefix, seq, CASE WHEN seq % 13 = 0 THEN seen + 1 ELSE seen END AS seen, cc, CASE WHEN ts // {GRID} % 4 = 0 THEN audit || 'x' ELSE audit END AS audit FROM {_RUN} WHERE seq % 19 > 0),
    la AS (SELECT ts, audit, row_number() OVER (PARTITION BY ts ORDER BY min(seq)) AS place FROM a GROUP BY ts, audit), lb AS (SELECT ts, audit, row_number() OVER (PARTITION BY ts ORDER BY min(seq)) AS place FROM b GROUP BY ts, audit),
    l AS (SELECT ts, place, la.audit IS DISTINCT FROM lb.audit AS odd FROM la FULL JOIN lb USING (ts, place)),
    j AS (SELECT ts, prefix, x.seen AS xs, y.seen AS ys FROM (FROM a WHERE cc IS NULL OR cc = 'IR') x FULL JOIN (FROM b WHERE cc IS NULL OR cc = 'IR') y USING (ts, prefix))
    SELECT * FROM (SELECT ts, 'collector_fullfeed' AS kind, count(*) FILTER (odd) AS n, count(*) AS "of", CAST(min(CASE WHEN odd THEN place END) AS VARCHAR) AS example FROM l GROUP BY ts
        UNION ALL SELECT ts, 'only_base', count(*) FILTER (ys IS NULL), count(*), min(CASE WHEN ys IS NULL THEN prefix END) FROM j GROUP BY ts UNION ALL SELECT ts, 'only_candidate', count(*) FILTER (xs IS NULL), count(*), min(CASE WHEN xs IS NULL THEN prefix END) FROM j GROUP BY ts
        UNION ALL SELECT ts, 'peers_seen', count(*) FILTER (xs <> ys), count(*) FILTER (xs IS NOT NULL AND ys IS NOT NULL), min(CASE WHEN xs <> ys THEN prefix END) FROM j GROUP BY ts) WHERE n > 0""")
def snapshot_comparison(spark, sf_dir):
    """Two runs of the same snapshots: audits in their order, prefixes, and numbers."""
    rows = events(spark, sf_dir).groupBy(floor_to(F.col("t"), GRID).alias("ts"), F.concat(F.lit("p"), (F.col("event_id") % 200).cast("string")).alias("prefix")).agg(F.max("event_id").alias("seq"))
    audit = (F.floor(F.col("seq") / 64) % 3).cast("string")
    rows = rows.withColumns({"peers_seen": F.col("seq") % 40, "cc": F.when(F.col("seq") % 5 == 0, "TR").when(F.col("seq") % 5 > 1, "IR"), "collector_fullfeed": audit})
    seen = F.when(F.col("seq") % 13 == 0, F.col("peers_seen") + 1).otherwise(F.col("peers_seen"))
    said = F.when(F.floor(F.col("ts") / GRID) % 4 == 0, F.concat("collector_fullfeed", F.lit("x"))).otherwise(F.col("collector_fullfeed"))
    theirs = rows.where("seq % 19 > 0").withColumns({"peers_seen": seen, "collector_fullfeed": said})
    return comparison.compare_snapshots(rows.where("seq % 17 > 0"), theirs, columns=("peers_seen",))


@query(f"WITH r AS (SELECT user_id % 30 AS asn, value FROM {EVENTS_SQL} WHERE event_type = 'error') SELECT e.asn, count(r.value) AS n, round(avg(r.value), 6) AS mean, round(median(r.value), 6) AS median FROM (SELECT DISTINCT asn FROM r WHERE value IS NOT NULL) e JOIN r ON r.asn <> e.asn GROUP BY e.asn")
def leave_one_out_readings(spark, sf_dir):
    """Mean and median reading of all control entities but one, for each."""
    rows = events(spark, sf_dir).where("event_type = 'error'").select((F.col("user_id") % 30).alias("asn"), "value")
    return rounded(leaveout.leave_one_out(rows, "asn", "value"), "mean", "median", to=6)


_AUDIT = f"""'{{"c1":{{"ipv4":' || CAST(CASE WHEN unit // {GRID} % 7 = 3 THEN 30 ELSE 9 END AS VARCHAR) || ',"ipv6":3}}' || CASE WHEN unit // {GRID} % 5 > 0 THEN ',"c2":{{"ipv4":1,"ipv6":1}}' ELSE '' END || '}}'"""
_HEALTH = f"""(SELECT unit, unit + CASE WHEN event_id % 977 = 0 THEN 1 ELSE 0 END AS ts, event_id % 200 AS prefix, CASE WHEN event_id % 4 = 0 THEN 6 ELSE 4 END AS family, {_AUDIT} AS audit,
    CASE WHEN event_id % 4 = 0 THEN 4 WHEN event_id % 331 = 0 THEN 1 ELSE (CASE WHEN unit // {GRID} % 7 = 3 THEN 31 ELSE 10 END) END AS total
    FROM (SELECT *, t - t % {GRID} AS unit FROM {EVENTS_SQL}) WHERE unit // {GRID} % 11 > 0)"""


@query(f"""WITH s AS (SELECT unit, count(*) AS n_rows, count(DISTINCT prefix) AS n_prefixes, coalesce(max(CASE WHEN family = 4 THEN total END), 0) AS ff_v4, coalesce(max(CASE WHEN family = 6 THEN total END), 0) AS ff_v6, min(ts) <> unit OR max(ts) <> unit AS off,
        coalesce(min(CASE WHEN family = 4 THEN total END) <> max(CASE WHEN family = 4 THEN total END), false) AS u4, max(CASE WHEN unit // {GRID} % 7 = 3 THEN 30 ELSE 9 END) + max(CASE WHEN unit // {GRID} % 5 > 0 THEN 1 ELSE 0 END) AS s4, 3 + max(CASE WHEN unit // {GRID} % 5 > 0 THEN 1 ELSE 0 END) AS s6,
        max(CASE WHEN family = 4 THEN 1 ELSE 0 END) = 1 AS h4, max(CASE WHEN family = 6 THEN 1 ELSE 0 END) = 1 AS h6 FROM {_HEALTH} GROUP BY unit),
    m AS (SELECT median(ff_v4) AS m4, median(ff_v6) AS m6 FROM s)
    SELECT unit, n_rows, n_prefixes, ff_v4, ff_v6, CASE WHEN lead(unit) OVER (ORDER BY unit) - unit > {GRID} THEN lead(unit) OVER (ORDER BY unit) - unit END AS gap_s,
        concat_ws('; ', CASE WHEN off THEN 'ts is not the unit' END, CASE WHEN unit // {GRID} % 5 = 0 THEN 'no c2' END, CASE WHEN u4 THEN 'uneven totals of IPv4' END, CASE WHEN h4 AND ff_v4 <> s4 THEN 'total of IPv4 is not the audit''s sum' END,
            CASE WHEN h6 AND ff_v6 <> s6 THEN 'total of IPv6 is not the audit''s sum' END, CASE WHEN abs(ff_v4 - m4) > 0.15 * m4 THEN 'IPv4 drifts' END, CASE WHEN abs(ff_v6 - m6) > 0.15 * m6 THEN 'IPv6 drifts' END) AS problems FROM s, m""")
def snapshot_health(spark, sf_dir):
    """One report of a series: sizes, totals, gaps and what is wrong with each snapshot."""
    step = lambda k: F.floor(F.col("unit") / GRID) % k
    rows = events(spark, sf_dir).withColumn("unit", floor_to(F.col("t"), GRID)).where(step(11) > 0)
    event, high = F.col("event_id"), step(7) == 3
    two = F.when(step(5) > 0, F.lit(',"c2":{"ipv4":1,"ipv6":1}')).otherwise("")
    audit = F.concat(F.lit('{"c1":{"ipv4":'), F.when(high, "30").otherwise("9"), F.lit(',"ipv6":3}'), two, F.lit("}"))
    total = F.when(event % 4 == 0, 4).when(event % 331 == 0, 1).otherwise(F.when(high, 31).otherwise(10))
    rows = rows.select("unit", (F.col("unit") + F.when(event % 977 == 0, 1).otherwise(0)).alias("ts"), (event % 200).alias("prefix"), F.when(event % 4 == 0, 6).otherwise(4).alias("family"), total.alias("peers_total"), audit.alias("collector_fullfeed"))
    return quality.snapshot_health(rows, ["c1", "c2"], most_gap=GRID)
