"""Routing visibility: how many full-feed peers carry a prefix, per snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.lists import blank_to, join_numbers, list_size, split_list

from .asof import at_every
from .quantiles import with_quantiles

PEER = ("collector", "peer_asn", "peer_address")
FULL_FEED = {4: 400_000, 6: 50_000}


def full_feed_peers(elems: DataFrame, least: dict[int, int] = FULL_FEED) -> DataFrame:
    """(ts, collector, peer_asn, peer_address, family) of peers that carry at least `least` routes of the family. Counts every element."""
    counts = elems.groupBy("ts", *PEER, "family").agg(F.count("*").alias("routes"))
    floor = F.when(F.col("family") == 4, least[4]).otherwise(least[6])
    return counts.where(F.col("routes") >= floor).drop("routes")


def fullfeed_by_collector(peers: DataFrame) -> DataFrame:
    """(ts, collector, ipv4, ipv6): full-feed peers of each collector."""
    return peers.groupBy("ts", "collector").agg(F.count_if(F.col("family") == 4).alias("ipv4"), F.count_if(F.col("family") == 6).alias("ipv6"))


def audit_json(by_collector: DataFrame) -> DataFrame:
    """(ts, collector_fullfeed): the counts as JSON with sorted keys."""
    one = F.struct("collector", F.struct("ipv4", "ipv6").alias("n"))
    return by_collector.groupBy("ts").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(one)))).alias("collector_fullfeed"))


def missing_collectors(by_collector: DataFrame, expected: DataFrame) -> DataFrame:
    """(ts, collector) of configured collectors without a full-feed peer in either family. Empty: the snapshot may be used."""
    good = by_collector.where("ipv4 + ipv6 > 0").select("ts", "collector")
    return at_every(by_collector.select("ts").distinct(), expected, "collector").join(good, ["ts", "collector"], "left_anti")


def require_collectors(by_collector: DataFrame, expected: DataFrame) -> None:
    """Fail (a job runs) when a configured collector has no full-feed peer."""
    gap = missing_collectors(by_collector, expected).first()
    if gap is not None:
        raise ValueError(f"snapshot {gap['ts']}: no full-feed peer from {gap['collector']}")


def visibility(elems: DataFrame, least: dict[int, int] = FULL_FEED) -> DataFrame:
    """(ts, prefix, family, origin_asn, peers_seen, peers_total, visibility, upstreams): one row per prefix seen.

    A prefix that no full-feed peer carries stays, with 0. Several origins collapse to the smallest; -1 if none is known.
    """
    peers = full_feed_peers(elems, least)
    totals = peers.groupBy("ts", "family").agg(F.count("*").alias("peers_total"))
    seen = elems.join(peers.withColumn("_full", F.lit(1)), ["ts", *PEER, "family"], "left")
    out = seen.groupBy("ts", "prefix", "family").agg(
        F.coalesce(F.min("origin"), F.lit(-1)).cast("long").alias("origin_asn"),
        F.countDistinct(F.when(F.col("_full") == 1, F.struct(*PEER))).alias("peers_seen"),
        join_numbers(F.collect_set("upstream")).alias("upstreams"),
    )
    out = out.join(totals, ["ts", "family"], "left").withColumn("peers_total", F.coalesce("peers_total", F.lit(0)))
    share = F.when(F.col("peers_total") > 0, F.col("peers_seen") / F.col("peers_total")).otherwise(0.0)
    return out.withColumn("visibility", share).select("ts", "prefix", "family", "origin_asn", "peers_seen", "peers_total", "visibility", "upstreams")


def drop_degraded(df: DataFrame, least: int) -> DataFrame:
    """Without rows measured by fewer than `least` peers; an unknown number stays."""
    return df.where((F.col("peers_total") >= least) | F.col("peers_total").isNull())


def degraded_cells(df: DataFrame, least: int) -> DataFrame:
    return df.where(F.col("peers_total") < least).select("ts", "family").distinct()


def stamp_fullfeed(df: DataFrame) -> DataFrame:
    """Adds ff_v4 and ff_v6, the snapshot's denominators (0 for an absent family)."""
    of = lambda f: F.coalesce(F.max(F.when(F.col("family") == f, F.col("peers_total"))).over(Window.partitionBy("ts")), F.lit(0))
    return df.withColumn("ff_v4", of(4)).withColumn("ff_v6", of(6))


def consolidate(snapshots: DataFrame, default_cc: str = "IR") -> DataFrame:
    """Snapshots as one series: cc filled in, denominators stamped, ranged by ts and sorted within."""
    cc = F.coalesce("cc", F.lit(default_cc)) if "cc" in snapshots.columns else F.lit(default_cc)
    totals = snapshots.groupBy("ts").agg(*[F.coalesce(F.max(F.when(F.col("family") == f, F.col("peers_total"))), F.lit(0)).alias(f"ff_v{f}") for f in (4, 6)])
    return snapshots.withColumn("cc", cc).join(totals, "ts").repartitionByRange("ts").sortWithinPartitions("ts", "prefix")


def per_as(df: DataFrame) -> DataFrame:
    """(ts, asn, visibility): the best-seen prefix of each origin; -1 is an origin too."""
    return df.groupBy("ts", F.col("origin_asn").alias("asn")).agg(F.max("visibility").alias("visibility"))


def with_type(df: DataFrame, classification: DataFrame, asn: str) -> DataFrame:
    """Adds `type` by AS; unknown or blank is "unclassified"."""
    types = classification.select(F.col("asn").alias(asn), "type")
    return df.join(types, asn, "left").withColumn("type", blank_to(F.col("type"), "unclassified"))


def by_type(df: DataFrame, classification: DataFrame) -> DataFrame:
    """(ts, type) to mean, exact median and number of prefixes."""
    typed = with_type(df, classification, "origin_asn")
    out = typed.groupBy("ts", "type").agg(F.avg("visibility").alias("visibility_mean"), F.countDistinct("prefix").alias("n_prefixes"))
    return with_quantiles(out, typed, ["ts", "type"], {"visibility_median": ("visibility", 0.5)}).select("ts", "type", "visibility_mean", "visibility_median", "n_prefixes")


def upstream_sets(df: DataFrame) -> DataFrame:
    """(ts, asn, upstreams, n_upstreams): the union of the upstreams of an origin's prefixes, in numeric order; may be empty."""
    known = df.where("origin_asn > 0").select("ts", F.col("origin_asn").alias("asn"), F.explode_outer(split_list(F.col("upstreams"))).alias("u"))
    sets = known.groupBy("ts", "asn").agg(join_numbers(F.collect_set(F.col("u").try_cast("long"))).alias("upstreams"))
    return sets.withColumn("n_upstreams", list_size(F.col("upstreams")))
