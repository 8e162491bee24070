"""How the driver's tables stand in for routing data: the same rules in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.net import v4_text
from sluice.functions.timegrid import floor_to, seconds
from sluice.operators.bands import Window

GRID = 28_800
START = 1_704_067_200
DAY = 86_400
PHASES = [Window(f"P{k}", START + 6 * k * DAY, START + 6 * (k + 1) * DAY) for k in range(5)]
#: A month or so, for orders.
MONTH = 2_592_000

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, to: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), to) for c in columns})


def case_sql(ts: str, windows: list[Window]) -> str:
    return "CASE " + " ".join(f"WHEN {ts} >= {w.start} AND {ts} < {w.end} THEN '{w.name}'" for w in reversed(windows)) + " END"


PHASES_SQL = "(VALUES " + ", ".join(f"('{w.name}', {w.start}, {w.end})" for w in PHASES) + ") AS phases(phase, p_start, p_end)"
EVENTS_SQL = "(SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000000 AS t FROM events)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", seconds(F.col("ts")).alias("t"))


def visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ts, prefix, origin_asn, visibility) on the 8-hour grid."""
    return events(spark, sf_dir).select(
        floor_to(F.col("t"), GRID).alias("ts"), F.concat(F.lit("p"), (F.col("event_id") % 200).cast("string")).alias("prefix"), F.col("user_id").alias("origin_asn"),
        (((F.col("event_id") * 7919) % 101).cast("double") / 100).alias("visibility"),
    )


VISIBILITY_SQL = f"(SELECT t - t % {GRID} AS ts, 'p' || CAST(event_id % 200 AS VARCHAR) AS prefix, user_id AS origin_asn, CAST((event_id * 7919) % 101 AS DOUBLE) / 100 AS visibility FROM {EVENTS_SQL})"


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ts, asn, value): errors as probing readings; values of 20 and less are missing readings."""
    value = F.when(F.col("value") > 20, F.col("value"))
    return events(spark, sf_dir).where("event_type = 'error'").select(F.col("t").alias("ts"), F.col("user_id").alias("asn"), value.alias("value"))


SIGNAL_SQL = f"(SELECT t AS ts, user_id AS asn, CASE WHEN value > 20 THEN value END AS value FROM {EVENTS_SQL} WHERE event_type = 'error')"


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ts, seq, event, prefix, asn, peer_asn, window): clicks announce, errors withdraw."""
    kind = F.when(F.col("event_type") == "click", "announce").when(F.col("event_type") == "error", "withdraw")
    rows = events(spark, sf_dir).withColumn("event", kind).where("event IS NOT NULL")
    return rows.select(
        F.col("t").alias("ts"), F.col("event_id").alias("seq"), "event", F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("prefix"), F.col("user_id").alias("asn"), (F.col("user_id") % 3).alias("peer_asn"),
        F.concat(F.lit("w"), F.floor((F.col("t") - START) / (6 * DAY)).cast("string")).alias("window"),
    )


UPDATES_SQL = f"""(SELECT t AS ts, event_id AS seq, CASE event_type WHEN 'click' THEN 'announce' ELSE 'withdraw' END AS event, 'p' || CAST(user_id AS VARCHAR) AS prefix,
    user_id AS asn, user_id % 3 AS peer_asn, 'w' || CAST((t - {START}) // {6 * DAY} AS VARCHAR) AS "window" FROM {EVENTS_SQL} WHERE event_type IN ('click', 'error'))"""


def classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asn, type) of customers; one in seven is blank."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("asn"), F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.col("c_mktsegment")).alias("type"))


CLASS_SQL = "(SELECT c_custkey AS asn, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS type FROM customer)"


def prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ts, addr, plen, prefix, block, asn, visibility): IPv4 prefixes of length 16 to 24 from orders, in /16 blocks."""
    plen = (16 + F.col("o_orderkey") % 9).cast("int")
    raw = F.lit(10 * 2**24) + (F.col("o_orderkey") * 2654435761) % 2**24
    size = F.call_function("shiftleft", F.lit(1).cast("long"), (32 - plen).cast("int"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", seconds(F.col("o_orderdate")).alias("t"), plen.alias("plen"), (raw - raw % size).alias("addr"))
    block = F.col("addr") - F.col("addr") % 65536
    return rows.select(
        floor_to(F.col("t"), MONTH).alias("ts"), "addr", "plen", v4_text(F.col("addr"), F.col("plen")).alias("prefix"), v4_text(block, F.lit(16)).alias("block"),
        F.col("o_custkey").alias("asn"), ((F.col("o_orderkey") % 97).cast("double") / 100).alias("visibility"), F.col("o_orderkey").alias("seq"),
    )


def text_sql(addr: str, plen: str) -> str:
    octets = " || '.' || ".join(f"CAST(({addr} >> {s}) & 255 AS VARCHAR)" for s in (24, 16, 8, 0))
    return f"({octets} || '/' || CAST({plen} AS VARCHAR))"


_RAW = "(167772160 + (o_orderkey * 2654435761) % 16777216)"
PREFIX_SQL = f"""(SELECT ts, addr, plen, asn, visibility, seq, {text_sql('addr', 'plen')} AS prefix, {text_sql('(addr - addr % 65536)', '16')} AS block FROM (
    SELECT (epoch_us(o_orderdate) // 1000000) - (epoch_us(o_orderdate) // 1000000) % {MONTH} AS ts, {_RAW} - {_RAW} % (1 << (32 - (16 + o_orderkey % 9))) AS addr,
           CAST(16 + o_orderkey % 9 AS INTEGER) AS plen, o_custkey AS asn, CAST(o_orderkey % 97 AS DOUBLE) / 100 AS visibility, o_orderkey AS seq FROM orders))"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes(spark, sf_dir).select("block").distinct()
