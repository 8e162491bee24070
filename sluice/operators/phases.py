"""Shares and rates by phase, at given instants, and under moved boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bands import Window, all_phases, assign, in_each, shifted


def _share(what: Column) -> Column:
    return F.avg(what.cast("double"))


def in_phases(df: DataFrame, windows: list[Window]) -> DataFrame:
    return df.withColumn("phase", assign(F.col("ts"), windows)).where("phase IS NOT NULL")


def state_shares(states: DataFrame, windows: list[Window]) -> DataFrame:
    """(phase, dark_share, withdrawn_share, n) for every phase; an empty one has nulls."""
    out = in_phases(states, windows).groupBy("phase").agg(_share(F.col("state") == "dark").alias("dark_share"), _share(F.col("state") == "withdrawn").alias("withdrawn_share"), F.count("*").alias("n"))
    return all_phases(out, windows)


def transition_rates(transitions: DataFrame, windows: list[Window]) -> DataFrame:
    """(phase, transition_rate, n) for every phase."""
    out = in_phases(transitions, windows).groupBy("phase").agg(_share(F.col("changed")).alias("transition_rate"), F.count("*").alias("n"))
    return all_phases(out, windows)


def type_means(by_type: DataFrame, windows: list[Window], types: list[str] | None = None) -> DataFrame:
    """(phase, one column per type): the mean over instants of visibility_mean, not weighted by prefixes."""
    out = in_phases(by_type, windows).groupBy("phase").pivot("type", types).agg(F.avg("visibility_mean"))
    return all_phases(out, windows)


def snapshot_trajectory(states: DataFrame, instants: list[int]) -> DataFrame:
    """(ts, dark_share, withdrawn_share, n) at each instant; one without rows has n = 0 and null shares."""
    at = states.sparkSession.createDataFrame([(t,) for t in instants], "ts long")
    rows = states.where(F.col("ts").isin(instants)).groupBy("ts").agg(_share(F.col("state") == "dark").alias("dark_share"), _share(F.col("state") == "withdrawn").alias("withdrawn_share"), F.count("*").alias("n"))
    return at.join(rows, "ts", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def boundary_sweep(states: DataFrame, transitions: DataFrame, windows: list[Window], boundary: str, shifts: list[int]) -> DataFrame:
    """(shift, phase, dark_share, transition_rate) with the end of `boundary` moved by each shift. Each input is read once."""
    variants = {s: shifted(windows, boundary, s) for s in shifts}
    dark = in_each(states, variants).groupBy("shift", "phase").agg(_share(F.col("state") == "dark").alias("dark_share"))
    rate = in_each(transitions, variants).groupBy("shift", "phase").agg(_share(F.col("changed")).alias("transition_rate"))
    names = states.sparkSession.createDataFrame([(s, w.name) for s in shifts for w in windows], "shift long, phase string")
    return names.join(dark, ["shift", "phase"], "left").join(rate, ["shift", "phase"], "left")
