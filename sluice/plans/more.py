"""Queries on gaps, excursions, samples, parsed text, and a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sluice.functions.net import v4_text
from sluice.functions.timegrid import seconds
from sluice.operators import comparison, excursions, restoration, sessions
from sluice.operators.asof import asof_backward
from sluice.operators.quantiles import beside, quantiles
from sluice.operators.visibility import with_type
from sluice.sources import registries, signals
from sluice.sources.sinks import remove, shared_folder, write_table
from sluice.streaming import origins

from .adapters import CLASS_SQL, DAY, EVENTS_SQL, PREFIX_SQL, START, UPDATES_SQL, VISIBILITY_SQL, classification, events, prefixes, query, rounded, table, updates
from .adapters import visibility as seen

_GAPS = f"(SELECT gap_s FROM (SELECT event, lag(event) OVER s AS b, ts - (lag(ts) OVER s) AS gap_s FROM {UPDATES_SQL} WINDOW s AS (PARTITION BY prefix, asn, peer_asn ORDER BY ts, seq)) WHERE event = 'announce' AND b = 'withdraw')"


@query(f"SELECT count(*) AS n, count(*) FILTER (gap_s = 0) AS n_zero, {', '.join(f'round(quantile_cont(gap_s, {q / 100}), 6) AS p{q}' for q in (5, 25, 50, 75, 95))} FROM {_GAPS}")
def gap_distribution(spark, sf_dir):
    gaps = sessions.reannounce_gaps(updates(spark, sf_dir))
    counts = gaps.agg(F.count("*").alias("n"), F.count_if(F.col("gap_s") == 0).alias("n_zero"))
    out = beside(counts, quantiles(gaps, [], {f"p{q}": ("gap_s", q / 100) for q in (5, 25, 50, 75, 95)}))
    return rounded(out, *[f"p{q}" for q in (5, 25, 50, 75, 95)], to=6)


@query(f"""WITH d AS (SELECT t - t % {DAY} AS ts, user_id % 20 AS asn, avg(value) AS v FROM {EVENTS_SQL} GROUP BY ALL), m AS (SELECT asn, ts, v < 45 AS low FROM d),
    r AS (SELECT asn, ts, low, sum(CASE WHEN low THEN 0 ELSE 1 END) OVER (PARTITION BY asn ORDER BY ts) AS g FROM m)
    SELECT asn, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM r WHERE low GROUP BY asn, g HAVING max(ts) - min(ts) >= {DAY}""")
def sustained_excursions(spark, sf_dir):
    days = events(spark, sf_dir).groupBy((F.col("t") - F.col("t") % DAY).alias("ts"), (F.col("user_id") % 20).alias("asn")).agg(F.avg("value").alias("v"))
    return excursions.excursions(days, F.col("v") < 45, ["asn"], DAY)


@query(f"""WITH d AS (SELECT t - t % {DAY} AS ts, user_id % 20 AS asn, CAST(count(*) AS DOUBLE) AS v FROM {EVENTS_SQL} GROUP BY ALL)
    SELECT asn, ts, v, round(lag(v) OVER w + (lead(v) OVER w - lag(v) OVER w) * ((ts - lag(ts) OVER w) / CAST(lead(ts) OVER w - lag(ts) OVER w AS DOUBLE)), 9) AS interpolated FROM d WINDOW w AS (PARTITION BY asn ORDER BY ts)""")
def neighbour_interpolation(spark, sf_dir):
    days = events(spark, sf_dir).groupBy((F.col("t") - F.col("t") % DAY).alias("ts"), (F.col("user_id") % 20).alias("asn")).agg(F.count("*").cast("double").alias("v"))
    return rounded(excursions.against_neighbours(days, "v", ["asn"]), "interpolated")


@query("SELECT asn, type, CAST(place AS INTEGER) AS place FROM (SELECT c_custkey AS asn, c_mktsegment AS type, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('seed:' || CAST(c_custkey AS VARCHAR)), c_custkey) AS place FROM customer) WHERE place <= 20")
def stratified_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("asn"), F.col("c_mktsegment").alias("type"))
    return excursions.stratified(rows, "type", "asn", 20)


_HOT = "CASE WHEN user_id % 10 > 0 THEN 0 ELSE user_id END"


@query(f"""WITH e AS (SELECT {_HOT} AS k, t, event_id, event_type, value FROM {EVENTS_SQL}), r AS (SELECT k, t, max(value) AS v FROM e WHERE event_type = 'error' AND value IS NOT NULL GROUP BY k, t)
    SELECT e.event_id, e.k AS asn, r.v AS value FROM (SELECT * FROM e WHERE event_type <> 'error') e ASOF LEFT JOIN r ON r.k = e.k AND r.t <= e.t""")
def asof_hot_entity(spark, sf_dir):
    """The last reading before each event, where one entity has nine tenths of all rows."""
    rows = events(spark, sf_dir).withColumn("asn", F.when(F.col("user_id") % 10 > 0, 0).otherwise(F.col("user_id")))
    left = rows.where("event_type <> 'error'").select("event_id", "asn", F.col("t").alias("ts"))
    right = rows.where("event_type = 'error'").select("asn", F.col("t").alias("ts"), "value")
    return asof_backward(left, right, ["asn"], "value", most=1000).select("event_id", "asn", "value")


@query(f"WITH d AS (SELECT coalesce(nullif(c.type, ''), 'unclassified') AS type, median(visibility) AS m FROM {VISIBILITY_SQL} v LEFT JOIN {CLASS_SQL} c ON c.asn = v.origin_asn GROUP BY 1) SELECT (SELECT type FROM d ORDER BY m, type LIMIT 1) AS lowest, (SELECT type FROM d ORDER BY m DESC, type LIMIT 1) AS highest")
def type_extremes(spark, sf_dir):
    medians = with_type(seen(spark, sf_dir), classification(spark, sf_dir), "origin_asn")
    medians = quantiles(medians, ["type"], {"m": ("visibility", 0.5)})
    return excursions.extremes(medians, "type", "m")


@query(f"""WITH s AS (SELECT origin_asn AS asn, ts, max(visibility) >= 0.5 AS seen FROM {VISIBILITY_SQL} GROUP BY ALL),
    p AS (SELECT user_id AS asn, t - 3600 AS a, t + 7200 AS b FROM {EVENTS_SQL} WHERE event_type = 'view')
    SELECT asn, count(*) AS n, count(*) FILTER (seen = EXISTS (SELECT 1 FROM p WHERE p.asn = s.asn AND s.ts BETWEEN a AND b)) AS n_agree FROM s GROUP BY asn""")
def presence_agreement(spark, sf_dir):
    periods = events(spark, sf_dir).where("event_type = 'view'").select(F.col("user_id").alias("asn"), (F.col("t") - 3600).alias("start"), (F.col("t") + 7200).alias("end"))
    return comparison.presence_agreement(seen(spark, sf_dir).withColumnRenamed("origin_asn", "asn"), periods)


_COVER = "unnest([((s + (1 << k) - 1) >> k) << k, (((s + n) >> k) << k) - (1 << k)])"


@query(f"""WITH r AS (SELECT c_custkey AS k0, 167772160 + c_custkey * 4096 AS s, 1 + (c_custkey * 7919) % 4000 AS n FROM customer WHERE c_custkey % 5 > 0 AND c_custkey % 3 = 0),
    c AS (SELECT DISTINCT k0, s, s + n AS e, k, {_COVER} AS a FROM r CROSS JOIN (SELECT CAST(unnest(generate_series(0, 12)) AS INTEGER) AS k))
    SELECT 'o' || CAST(k0 AS VARCHAR) AS org, ((a >> 24) & 255) || '.' || ((a >> 16) & 255) || '.' || ((a >> 8) & 255) || '.' || (a & 255) || '/' || (32 - k) AS item FROM c WHERE a >= s AND a + (1 << k) <= e AND NOT ((a >> (k + 1)) << (k + 1) >= s AND ((a >> (k + 1)) << (k + 1)) + (1 << (k + 1)) <= e)
    UNION ALL SELECT 'o' || CAST(c_custkey AS VARCHAR), CAST(64000 + c_custkey * 10 + i AS VARCHAR) FROM customer CROSS JOIN (VALUES (0), (1), (2)) AS x(i) WHERE c_custkey % 5 > 0 AND c_custkey % 3 = 1
    UNION ALL SELECT 'o' || CAST(c_custkey AS VARCHAR), '2a01:' || CAST(c_custkey % 9000 AS VARCHAR) || '::/32' FROM customer WHERE c_custkey % 5 > 0 AND c_custkey % 3 = 2""")
def delegation_lines(spark, sf_dir):
    """Customers as lines of a delegation file, parsed again."""
    k = F.col("c_custkey")
    text = lambda c: c.cast("string")
    start = F.element_at(F.split(v4_text(F.lit(167_772_160) + k * 4096, F.lit(32)), "/"), 1)
    body = F.when(k % 3 == 0, F.concat_ws("|", F.lit("ipv4"), start, text(1 + (k * 7919) % 4000)))
    body = body.when(k % 3 == 1, F.concat_ws("|", F.lit("asn"), text(64_000 + k * 10), F.lit("3"))).otherwise(F.concat_ws("|", F.lit("ipv6"), F.concat(F.lit("2a01:"), text(k % 9000), F.lit("::")), F.lit("32")))
    status = F.when(k % 5 == 0, "reserved").otherwise("allocated")
    lines = table(spark, sf_dir, "customer").select(F.concat_ws("|", F.lit("reg"), F.lit("IR"), body, F.lit("20200101"), status, F.concat(F.lit("o"), text(k))).alias("value"))
    rows = registries.delegation_rows(lines.union(lines.sparkSession.createDataFrame([("# comment",), ("2|reg|1|2|3|4|5",)], "value string")), "IR")
    return registries.delegated_prefixes(rows).select("org", F.col("prefix").alias("item")).union(registries.delegated_asns(rows).select("org", F.col("asn").cast("string")))


@query(f"SELECT ts, entity_code, value FROM (SELECT {START} + 300 * (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) AS ts, CAST(user_id AS VARCHAR) AS entity_code, CASE WHEN event_id % 7 > 0 THEN value END AS value FROM {EVENTS_SQL})")
def signal_documents(spark, sf_dir):
    """Readings as one JSON document per entity, flattened again."""
    value = F.when(F.col("event_id") % 7 > 0, F.col("value"))
    kept = events(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", value.alias("v")))).alias("x"))
    numbers = F.array_join(F.transform("x", lambda e: F.coalesce(e["v"].cast("string"), F.lit("null"))), ",")
    doc = F.concat(F.lit(f'{{"data":[[{{"from":{START},"step":300,"datasource":"ping","values":['), numbers, F.lit("]}]]}"))
    docs = kept.select(F.lit("asn").alias("entity_type"), F.col("user_id").cast("string").alias("entity_code"), F.lit(0).alias("chunk"), doc.alias("doc"))
    return signals.first_of_each(signals.normalise(docs)).select("ts", "entity_code", "value")


@query(f"WITH p AS {PREFIX_SQL}, f AS (SELECT block, min(ts) AS first_reannounce_ts FROM p WHERE seq % 2 = 0 AND seq % 5 <> 0 AND ts >= 883612800 GROUP BY block) SELECT * FROM f")
def fine_restoration_order(spark, sf_dir):
    rows = prefixes(spark, sf_dir)
    feed = rows.select("ts", "prefix", F.when(F.col("seq") % 2 == 0, "announce").otherwise("withdraw").alias("event"), F.when(F.col("seq") % 5 == 0, "TR").otherwise("IR").alias("cc"))
    return restoration.fine_restoration_order(feed, rows.select("block").distinct(), 883_612_800)


@query(f"SELECT event_id AS seq, coalesce(last_value(CASE WHEN event_type = 'click' THEN event_id % 50 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), -1) AS asn FROM {EVENTS_SQL} WHERE event_type IN ('click', 'error')")
def stream_last_origin(spark, sf_dir):
    """The events as a stream, to a table in the shared checkpoint folder."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # a pattern, for a stream's path must not be a single file
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet").where("event_type IN ('click', 'error')")
    kind = F.when(F.col("event_type") == "click", "A").otherwise("W")
    elems = rows.select(F.lit("x").alias("peer_address"), F.col("user_id").alias("peer_asn"), F.lit("p").alias("prefix"), seconds(F.col("ts")).alias("time"), F.col("event_id").alias("seq"), kind.alias("type"), (F.col("event_id") % 50).cast("string").alias("as_path"))
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def sink(batch, number):
        write_table(batch, f"{base}/out/{number}")

    try:
        origins.attribute_stream(elems).writeStream.foreachBatch(sink).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(f"{base}/out/*").select("seq", "asn").checkpoint()
    finally:
        remove(spark, base)
