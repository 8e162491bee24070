"""Reachability states: routing visibility against active probing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .asof import asof_backward, at_every, densify
from .quantiles import with_quantiles
from .visibility import per_as

WITHDRAWN, DARK, REACHABLE = "withdrawn", "dark", "reachable"


def state(visibility: Column, probing: Column, baseline: Column, announced_min: float, dark_ratio: float) -> Column:
    """withdrawn below `announced_min`; else dark below `dark_ratio` of the baseline; else reachable, as when probing or baseline is missing or the baseline is not positive."""
    known = probing.isNotNull() & baseline.isNotNull() & (baseline > 0)
    return F.when(visibility < announced_min, WITHDRAWN).when(known & (probing < F.lit(dark_ratio) * baseline), DARK).otherwise(REACHABLE)


def probing_baseline(signal: DataFrame, key: str, nonzero_min: float, median_min: float) -> DataFrame:
    """(key, nonzero_share, median, adequate, baseline) over the reference window's non-null readings; baseline is null unless adequate."""
    read = signal.where("value IS NOT NULL")
    out = read.groupBy(key).agg(F.avg((F.col("value") > 0).cast("double")).alias("nonzero_share"))
    out = with_quantiles(out, read, [key], {"median": ("value", 0.5)})
    out = out.withColumn("adequate", (F.col("nonzero_share") >= nonzero_min) & (F.col("median") >= median_min))
    return out.withColumn("baseline", F.when(F.col("adequate"), F.col("median")))


def exclusions(baselines: DataFrame, asns: DataFrame, key: str = "asn") -> DataFrame:
    """ASes without an adequate baseline, with the share rounded to four places; those without readings have nulls."""
    out = asns.select(key).distinct().join(baselines, key, "left").where("NOT coalesce(adequate, false)")
    return out.select(key, F.round("nonzero_share", 4).alias("nonzero_share"), "median")


def state_timeline(visibility: DataFrame, signal: DataFrame, reference: DataFrame, announced_min: float = 0.5, dark_ratio: float = 0.2, nonzero_min: float = 0.5, median_min: float = 5.0) -> DataFrame:
    """(ts, asn, visibility, probing, probing_baseline, probing_adequate, state) for each AS seen, at every snapshot.

    An AS that is absent from a snapshot has visibility 0 there. Probing is the last non-null reading at or before the snapshot.
    """
    dense = densify(per_as(visibility), ["asn"], visibility.select("ts"), "visibility")
    joined = asof_backward(dense, signal, ["asn"], "value", into="probing")
    base = probing_baseline(reference, "asn", nonzero_min, median_min).select("asn", F.col("baseline").alias("probing_baseline"), F.col("adequate").alias("probing_adequate"))
    out = joined.join(base, "asn", "left").withColumn("probing_adequate", F.coalesce("probing_adequate", F.lit(False)))
    return out.withColumn("state", state(F.col("visibility"), F.col("probing"), F.col("probing_baseline"), announced_min, dark_ratio))


def control_dark_rows(grid: DataFrame, signal: DataFrame, reference: DataFrame, dark_ratio: float, nonzero_min: float = 0.5, median_min: float = 5.0) -> DataFrame:
    """(ts, asn, probing, baseline, dark) for adequate controls at the grid points that have a reading at or before."""
    base = probing_baseline(reference, "asn", nonzero_min, median_min).where("adequate").select("asn", "baseline")
    joined = asof_backward(at_every(base, grid), signal, ["asn"], "value", into="probing").where("probing IS NOT NULL")
    return joined.withColumn("dark", F.col("probing") < F.lit(dark_ratio) * F.col("baseline"))


def control_dark_shares(rows: DataFrame, artifact_share: float) -> DataFrame:
    """(ts, n_controls, dark_share, artifact): a bin in which many controls go dark at once is the instrument's doing."""
    out = rows.groupBy("ts").agg(F.countDistinct("asn").alias("n_controls"), F.avg(F.col("dark").cast("double")).alias("dark_share"))
    return out.withColumn("artifact", F.col("dark_share") >= artifact_share)


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """`df`, or an error (a job runs) when it is empty."""
    if df.isEmpty():
        raise ValueError(f"no {what}")
    return df
