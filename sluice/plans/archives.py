"""Queries over archives: the driver's events written as routing files and read back, in batches and streams."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.timegrid import floor_to
from sluice.operators import inventory
from sluice.operators.visibility import visibility
from sluice.sources import archive, gated, mrt
from sluice.sources.sinks import remove, shared_folder, write_table
from sluice.streaming import sessions

from .adapters import DAY, EVENTS_SQL, GRID, START, events, query

_PEER = "'10.1.' || CAST(user_id % 7 AS VARCHAR) || '.1'"
_V6 = "'2a01:' || CAST(1 + user_id % 500 AS VARCHAR) || '::/32'"
_V4 = "'10.' || CAST(user_id % 250 AS VARCHAR) || '.' || CAST(event_id % 9 AS VARCHAR) || '.0/24'"
ELEMS_SQL = f"""(SELECT event_id, t AS time, CASE event_type WHEN 'error' THEN 'W' ELSE 'A' END AS type, 64500 + user_id % 7 AS peer_asn, {_PEER} AS peer_address,
    CASE WHEN user_id % 5 = 0 THEN {_V6} ELSE {_V4} END AS prefix, CASE WHEN event_type <> 'error' THEN CAST(64500 + user_id % 7 AS VARCHAR) || ' {{1,2}} ' || CAST(event_id % 50 AS VARCHAR) END AS as_path
    FROM {EVENTS_SQL} WHERE event_type IN ('click', 'error'))"""


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as announcements and errors as withdrawals of seven peers, IPv4 and IPv6."""
    text = lambda c: c.cast("string")
    user, event = F.col("user_id"), F.col("event_id")
    v6 = F.concat(F.lit("2a01:"), text(1 + user % 500), F.lit("::/32"))
    v4 = F.concat(F.lit("10."), text(user % 250), F.lit("."), text(event % 9), F.lit(".0/24"))
    path = F.concat_ws(" ", text(64_500 + user % 7), F.lit("{1,2}"), text(event % 50))
    return events(spark, sf_dir).where("event_type IN ('click', 'error')").select(
        event, F.col("t").alias("time"), F.when(F.col("event_type") == "error", "W").otherwise("A").alias("type"), (64_500 + user % 7).alias("peer_asn"),
        F.concat(F.lit("10.1."), text(user % 7), F.lit(".1")).alias("peer_address"), F.when(user % 5 == 0, v6).otherwise(v4).alias("prefix"), F.when(F.col("event_type") == "click", path).alias("as_path"),
    )


#: Elements of a file, about, where there are more than eight times as many: what a task writes or reads does not grow with the archive.
PER_FILE = 100_000


def written(elems: DataFrame, base: str, *by: str, most: DataFrame | None = None) -> str:
    """Elements as an archive, each file a stretch of time in the order of `by`. `most`: rows that are no fewer and cheaper to count."""
    files = max(8, -(-(elems if most is None else most).count() // PER_FILE))
    elems.repartitionByRange(files, by[0]).sortWithinPartitions(*by).write.format("mrt").mode("append").save(base)
    return base


def settled(df: DataFrame, base: str) -> DataFrame:
    """The result in the shared checkpoint folder, and what it was made from removed, whether or not that went well."""
    shared_folder(df.sparkSession)
    try:
        return df.checkpoint()
    finally:
        remove(df.sparkSession, base)


def _base(spark: SparkSession) -> str:
    archive.register(spark)
    return f"{shared_folder(spark)}/archive-{uuid.uuid4().hex}"


@query(f"SELECT type, peer_asn, peer_address, prefix, count(*) AS n, min(time) AS first, max(time) AS last, max(as_path) AS path FROM {ELEMS_SQL} GROUP BY ALL")
def archive_round_trip(spark, sf_dir):
    """Every event as a BGP message in MRT files, decoded again."""
    base = _base(spark)
    elems = spark.read.format("mrt").load(f"{written(elements(spark, sf_dir), f'{base}/rrc00', 'time', 'event_id')}/*")
    out = elems.groupBy("type", "peer_asn", "peer_address", "prefix").agg(F.count("*").alias("n"), F.min("time").alias("first"), F.max("time").alias("last"), F.max("as_path").alias("path"))
    return settled(out, base)


@query(f"SELECT peer_asn, count(*) AS n, sum(time) AS total FROM {ELEMS_SQL} WHERE time >= 1704500000 AND time < 1705500000 GROUP BY peer_asn")
def archive_window(spark, sf_dir):
    """Elements of a window of time; files outside it are not opened."""
    base = _base(spark)
    path = written(elements(spark, sf_dir), f"{base}/rrc00", "time", "event_id")
    elems = spark.read.format("mrt").option("start", 1_704_500_000).option("end", 1_705_500_000).option("span", 10_000_000).load(f"{path}/*")
    return settled(elems.groupBy("peer_asn").agg(F.count("*").alias("n"), F.sum("time").alias("total")), base)


def _cut_short(spark: SparkSession, folder: str, to: str) -> None:
    """Every file of a folder as a broken transfer leaves it: its first 60 %. The files are copied by tasks."""
    files = [(f.path,) for f in archive.listed(folder)]

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                (store, old), (_, new) = archive.located(path), archive.located(f"{to}/{path.rsplit('/', 1)[1]}")
                store.create_dir(new.rsplit("/", 1)[0])
                with store.open_input_file(old) as whole, store.open_output_stream(new, compression=None) as out:
                    left = whole.size() * 6 // 10
                    while left:
                        part = whole.read(min(left, 1 << 20))
                        out.write(part)
                        left -= len(part)
            yield batch

    spark.createDataFrame(files, "path string").repartition(min(len(files), spark.sparkContext.defaultParallelism)).mapInArrow(copy, "path string").write.format("noop").mode("overwrite").save()


@query(f"SELECT type, count(*) AS n, sum(time) AS total, 1 AS source FROM {ELEMS_SQL} GROUP BY type")
def archive_fallback(spark, sf_dir):
    """Two sources of the same slots, the first of which breaks off: all slots come whole from the second."""
    base = _base(spark)
    _cut_short(spark, written(elements(spark, sf_dir), f"{base}/second/rrc00", "time", "event_id"), f"{base}/first/rrc00")
    chain = spark.read.format("mrt").option("onCorrupt", "mark").load(f"{base}/first/*/*,{base}/second/*/*")
    out = archive.first_sound(chain).groupBy("type").agg(F.count("*").alias("n"), F.sum("time").alias("total"), F.max("source").alias("source"))
    return settled(out, base)


# expected units: two ranges of one series overlap, a second series, and one of which nothing is there
RANGES = [("click", START, START + 30 * DAY, GRID), ("click", START + 20 * DAY + 1, START + 35 * DAY, GRID), ("error", START + 100, START + 10 * DAY, GRID), ("none", START, START + 15 * GRID, GRID)]
_GRIDS = " UNION ".join(f"SELECT '{s}' AS series, CAST(unnest(generate_series({-(-a // g) * g}, {b - 1}, {g})) AS VARCHAR) AS unit" for s, a, b, g in RANGES)
_THERE = f"(SELECT DISTINCT event_type AS series, CAST(t - t % {GRID} AS VARCHAR) AS unit FROM {EVENTS_SQL} WHERE event_type IN ('click', 'error', 'view') AND event_id % 3 = 0)"


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = (F.col("t") - F.col("t") % GRID).cast("string").alias("unit")
    return events(spark, sf_dir).select(F.col("event_type").alias("series"), unit, "event_id", "value")


@query(f"""WITH e AS ({_GRIDS}), p AS {_THERE}, c AS (SELECT * FROM p WHERE CAST(unit AS BIGINT) // {GRID} % 7 > 0),
    u AS (SELECT series, unit, e.series IS NOT NULL AS e, p.series IS NOT NULL AS p, c.series IS NOT NULL AS c FROM e FULL JOIN p USING (series, unit) FULL JOIN c USING (series, unit)),
    m AS (SELECT series, unit, row_number() OVER (PARTITION BY series ORDER BY unit) AS k FROM u WHERE e AND NOT p)
    SELECT series, count(*) FILTER (e) AS n_expected, count(*) FILTER (e AND p) AS n_present, count(*) FILTER (e AND NOT p) AS n_missing, count(*) FILTER (p AND NOT e) AS n_extra, count(*) FILTER (c <> p) AS n_stale,
        coalesce((SELECT string_agg(unit, ',' ORDER BY unit) FROM m WHERE m.series = u.series AND k <= 10), '') AS first_missing, count(*) FILTER ((e AND NOT p) OR c <> p) = 0 AS complete
    FROM u GROUP BY series""")
def inventory_report(spark, sf_dir):
    """Expected, present and consolidated units of each series, with the first that are missing."""
    there = _units(spark, sf_dir).where("series IN ('click', 'error', 'view') AND event_id % 3 = 0").select("series", "unit").distinct()
    return inventory.report(inventory.expected_units(spark, RANGES), there, there.where(F.floor(F.col("unit").cast("long") / GRID) % 7 > 0))


@query(f"""WITH e AS ({_GRIDS}), i AS (SELECT event_type AS series, CAST(t - t % {GRID} AS VARCHAR) AS unit, count(*) FILTER (event_id % 41 > 0) AS old, count(*) FILTER (event_id % 41 = 0) AS new FROM {EVENTS_SQL} GROUP BY ALL)
    SELECT * FROM (SELECT series, unit, CASE WHEN coalesce(old, 0) = 0 THEN 'missing' WHEN new > 0 THEN 'stale' END AS reason FROM e LEFT JOIN i USING (series, unit)) WHERE reason IS NOT NULL""")
def stale_units(spark, sf_dir):
    """What a run has to do after a manifest was written and rows were added to the inputs of some units."""
    base, rows = f"{shared_folder(spark)}/manifest-{uuid.uuid4().hex}", _units(spark, sf_dir)
    inventory.record(inventory.fingerprints(rows.where("event_id % 41 > 0"), inventory.UNIT), base)
    out = inventory.to_do(inventory.expected_units(spark, RANGES), inventory.finished(spark, base), inventory.fingerprints(rows, inventory.UNIT))
    return settled(out, base)


_SERIES = f"""(SELECT t - t % {GRID} AS ts, 'p' || CAST(event_id % 200 AS VARCHAR) AS prefix, CASE WHEN event_id % 200 % 4 = 0 THEN 6 ELSE 4 END AS family, max(value) AS visibility FROM {EVENTS_SQL} GROUP BY ALL)"""
_TOTAL = f"CASE WHEN family = 4 THEN 9 + ts // {GRID} % 5 ELSE 4 END"


@query(f"SELECT ts, family, count(*) AS n, CAST(max({_TOTAL}) AS BIGINT) AS peers_total, CAST(max(CASE WHEN family = 4 THEN 1 END) * max(9 + ts // {GRID} % 5) AS BIGINT) AS ff_v4, 1 AS n_files FROM {_SERIES} GROUP BY ts, family")
def snapshot_gate(spark, sf_dir):
    """A series written through its gates, read back by snapshot and family: each snapshot lies in one file."""
    rows = events(spark, sf_dir).select(floor_to(F.col("t"), GRID).alias("ts"), (F.col("event_id") % 200).alias("k"), "value")
    rows = rows.groupBy("ts", "k").agg(F.max("value").alias("visibility")).withColumn("family", F.when(F.col("k") % 4 == 0, 6).otherwise(4))
    four = (9 + F.floor(F.col("ts") / GRID) % 5).cast("int")
    audit = F.format_string('{"c1":{"ipv4":%d,"ipv6":3},"c2":{"ipv4":2,"ipv6":1}}', four - 2)
    rows = rows.select("ts", F.concat(F.lit("p"), F.col("k").cast("string")).alias("prefix"), "family", "visibility", F.when(F.col("family") == 4, four).otherwise(4).alias("peers_total"), audit.alias("collector_fullfeed"))
    base = f"{shared_folder(spark)}/gate-{uuid.uuid4().hex}"
    gated.write_consolidated(rows, f"{base}/series", ["c1", "c2"])
    back = spark.read.parquet(f"{base}/series").withColumn("file", F.col("_metadata.file_path"))
    files = back.groupBy("ts").agg(F.countDistinct("file").cast("int").alias("n_files"))
    out = back.groupBy("ts", "family").agg(F.count("*").alias("n"), F.max("peers_total").cast("long").alias("peers_total"), F.max(F.when(F.col("family") == 4, F.col("ff_v4"))).cast("long").alias("ff_v4"))
    return settled(out.join(files, "ts"), base)


_SNAPSHOTS = f"(SELECT DISTINCT time - time % {GRID} AS ts, peer_asn, peer_address, prefix FROM {ELEMS_SQL} WHERE type = 'A')"


@query(f"""WITH s AS {_SNAPSHOTS}, peers AS (SELECT ts, CASE WHEN prefix LIKE '%:%' THEN 6 ELSE 4 END AS family, count(DISTINCT peer_address) AS peers_total FROM s GROUP BY ALL)
    SELECT s.ts, s.prefix, count(DISTINCT peer_address) AS peers_seen, max(peers_total) AS peers_total FROM s JOIN peers p ON p.ts = s.ts AND p.family = CASE WHEN s.prefix LIKE '%:%' THEN 6 ELSE 4 END GROUP BY ALL""")
def archive_tables(spark, sf_dir):
    """Routing tables on the 8-hour grid as dumps with peer indexes, IPv4 and IPv6, and the visibility read from them."""
    base = _base(spark)
    tops = elements(spark, sf_dir).where("type = 'A'")
    rows = tops.withColumn("time", F.col("time") - F.col("time") % GRID).groupBy("time", "peer_asn", "peer_address", "prefix").agg(F.max("as_path").alias("as_path")).withColumn("type", F.lit("R"))
    elems = spark.read.format("mrt").load(f"{written(rows, f'{base}/rrc00', 'time', 'prefix', most=tops)}/*")
    out = visibility(mrt.as_visibility_input(elems, GRID, 0), {4: 1, 6: 1}).select("ts", "prefix", F.col("peers_seen").cast("long"), F.col("peers_total").cast("long"))
    return settled(out, base)


@query(f"SELECT peer_address, prefix, time, type, coalesce(last_value(CASE WHEN type = 'A' THEN event_id % 50 END IGNORE NULLS) OVER (PARTITION BY peer_address, peer_asn, prefix ORDER BY time, event_id ROWS UNBOUNDED PRECEDING), -1) AS asn, 'attributed' AS status FROM {ELEMS_SQL}")
def stream_sessions(spark, sf_dir):
    """The archive as a stream, its files in the order of their names, withdrawals attributed by sessions with state."""
    base = _base(spark)
    elems = elements(spark, sf_dir)
    path = written(elems, f"{base}/rrc00", "time", "event_id")
    # the end of the feed: an element years later that wakes what still waits
    end = elems.limit(1).select(F.lit(2_000_000_000).alias("time"), F.lit("A").alias("type"), F.lit(1).cast("long").alias("peer_asn"), F.lit("10.0.0.0").alias("peer_address"), F.lit("10.0.0.0/8").alias("prefix"), F.lit("1").alias("as_path"))
    end.write.format("mrt").mode("append").save(path)
    sessions.use_state_store(spark)
    rows = sessions.attributed(spark.readStream.format("mrt").option("filesPerBatch", 4).load(f"{path}/*"), idle=10 * 365 * 86_400)

    def sink(batch: DataFrame, number: int) -> None:
        write_table(batch, f"{base}/out/{number}")

    running = rows.writeStream.foreachBatch(sink).option("checkpointLocation", f"{base}/state").start()
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    return settled(spark.read.parquet(f"{base}/out/*").select("peer_address", "prefix", "time", "type", "asn", "status"), base)
