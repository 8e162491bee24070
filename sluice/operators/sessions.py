"""Sessions of announcements and withdrawals: gaps, flaps, transitions, and the origin a withdrawal belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SESSION = ("prefix", "asn", "peer_asn")
ORDER = ("ts", "seq")


def _window(keys, order):
    return Window.partitionBy(*keys).orderBy(*order)


def population_events(events: DataFrame, cc: str = "IR") -> DataFrame:
    """Announcements and withdrawals of the population; no cc (column or value) means it belongs to it."""
    if "cc" in events.columns:
        events = events.where(F.coalesce("cc", F.lit(cc)) == cc)
    return events.where(F.col("event").isin("announce", "withdraw"))


def reannounce_gaps(events: DataFrame, keys=SESSION, order=ORDER) -> DataFrame:
    """Announcements that directly follow a withdrawal in their session, with `gap_s`."""
    w = _window(keys, order)
    out = events.withColumn("_e", F.lag("event").over(w)).withColumn("gap_s", F.col("ts") - F.lag("ts").over(w))
    return out.where((F.col("event") == "announce") & (F.col("_e") == "withdraw")).drop("_e")


def flag_flaps(events: DataFrame, threshold: int, keys=SESSION, order=ORDER, into: str = "is_flap") -> DataFrame:
    """Withdrawals whose very next row in the session is an announcement within `threshold` seconds (inclusive)."""
    w = _window(keys, order)
    soon = (F.lead("event").over(w) == "announce") & ((F.lead("ts").over(w) - F.col("ts")) <= threshold)
    return events.withColumn(into, (F.col("event") == "withdraw") & F.coalesce(soon, F.lit(False)))


def drop_flaps(events: DataFrame, threshold: int | None, keys=SESSION, order=ORDER) -> DataFrame:
    """Without flapping withdrawals; their announcements stay. None: unchanged."""
    if threshold is None:
        return events
    return flag_flaps(events, threshold, keys, order, "_flap").where("NOT _flap").drop("_flap")


def flap_variants(events: DataFrame, thresholds: list[int], keys=SESSION, order=ORDER) -> DataFrame:
    """(threshold, n_withdrawals, n_flaps): one window serves all thresholds."""
    w = _window(keys, order)
    gap = F.when(F.lead("event").over(w) == "announce", F.lead("ts").over(w) - F.col("ts"))
    rows = events.withColumn("_gap", gap).where("event = 'withdraw'")
    each = F.explode(F.array(*[F.lit(t).cast("long") for t in thresholds]))
    return rows.select("_gap", each.alias("threshold")).groupBy("threshold").agg(F.count("*").alias("n_withdrawals"), F.count_if(F.col("_gap") <= F.col("threshold")).alias("n_flaps"))


def attribute_withdrawals(elems: DataFrame, origin: Column, keys=("peer_address", "peer_asn", "prefix"), order=ORDER, into: str = "asn") -> DataFrame:
    """The origin of every element: an announcement's own, a withdrawal's from the last announcement of its session; -1 if unknown.

    An announcement whose origin can't be read sets -1, and withdrawals don't clear what was set.
    """
    known = F.when(F.col("type") == "A", F.coalesce(origin, F.lit(-1)).cast("long"))
    w = _window(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return elems.withColumn(into, F.coalesce(F.last(known, ignorenulls=True).over(w), F.lit(-1).cast("long")))


def transitions(sets: DataFrame, key: str = "asn", value: str = "upstreams", on: str = "ts") -> DataFrame:
    """Each row with the value before it and whether it changed (a first row has not)."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(on))
    return sets.withColumn(f"prev_{value}", before).withColumn("changed", F.coalesce(F.col(f"prev_{value}") != F.col(value), F.lit(False)))
