"""Onset speed, restoration per block, and their order by type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as By
from pyspark.sql import functions as F

from sluice.sources.sinks import shared_folder

from .bands import Window
from .lpm import map_to_blocks
from .quantiles import beside, modes, quantiles, with_quantiles
from .visibility import with_type


def dominant(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): the most frequent value; of several the smallest."""
    return modes(df, [key], value)


def first_withdrawals(events: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return events.where("event = 'withdraw'").groupBy(*by, "prefix").agg(F.min("ts").alias("t"))


def event_speed(events: DataFrame, by: str = "window") -> DataFrame:
    """Onset speed per window from each prefix's first withdrawal; windows without withdrawals have no row.

    Quantiles are exact and linear; durations are truncated to seconds after subtracting.
    """
    rows = first_withdrawals(events, (by,))
    out = rows.groupBy(by).agg(F.count("*").alias("n_prefixes_withdrawn"), F.min("t").alias("t_first"), F.max("t").alias("t_last"))
    out = with_quantiles(out, rows, [by], {f"q{p}": ("t", p / 100) for p in (5, 50, 90, 95, 99)})
    whole = lambda c: c.cast("long")
    first = F.col("t_first")
    return out.select(
        by, "n_prefixes_withdrawn", "t_first", "t_last",
        whole(F.col("q5")).alias("t_p5"), whole(F.col("q95")).alias("t_p95"),
        (F.col("t_last") - first).alias("duration_s"),
        whole(F.col("q95") - F.col("q5")).alias("duration_p5_p95_s"),
        *[whole(F.col(f"q{p}") - first).alias(f"duration_p{p}_s") for p in (50, 90, 99)],
    )


def wave_timing(events: DataFrame, start: int) -> DataFrame:
    """One row: quantiles of the first withdrawals from `start` on."""
    late = first_withdrawals(events.where(F.col("ts") >= start))
    ends = late.agg(F.count("*").alias("n_prefixes"), F.min("t").alias("t_min"), F.max("t").alias("t_max"))
    middle = quantiles(late, [], {f"t_p{p}": ("t", p / 100) for p in (5, 50, 95)})
    return beside(ends, middle).select("n_prefixes", "t_min", *[F.col(f"t_p{p}").cast("long") for p in (5, 50, 95)], "t_max")


def restoration_events(rollup: DataFrame, owners: DataFrame, before: Window, after: Window, thresholds: tuple[float, ...] = (0.25, 0.5, 0.8), main: float = 0.5, block: str = "block", value: str = "visibility_weighted") -> DataFrame:
    """Per block: mean before, the first ts from `after` on at each share of it, and the steady state within `after`.

    Means are over the roll-up's own instants, a missing block counting as 0: the sum over the number of instants, so that
    nothing has to be filled in. Without an instant in `before` the baseline is null; without a positive baseline times and ratio are null.
    """
    ts, v = F.col("ts"), F.col(value)
    early, late = (ts >= before.start) & (ts < before.end), (ts >= after.start) & (ts < after.end)
    counts = rollup.agg(F.countDistinct(F.when(early, ts)).alias("_n0"), F.countDistinct(F.when(late, ts)).alias("_n1")).withColumn("_one", F.lit(1))
    rows = rollup.withColumn("_sum", F.coalesce(F.sum(F.when(early, v)).over(By.partitionBy(block)), F.lit(0.0)))
    rows = rows.withColumn("_one", F.lit(1)).join(F.broadcast(counts), "_one").withColumn("p0_baseline_mean", F.col("_sum") / F.nullif(F.col("_n0"), F.lit(0)))
    goal = F.when(F.col("p0_baseline_mean") > 0, F.col("p0_baseline_mean"))
    out = rows.groupBy(block).agg(
        F.first("p0_baseline_mean").alias("p0_baseline_mean"),
        *[F.min(F.when((ts >= after.start) & (v >= F.lit(t) * goal), ts)).alias(f"restoration_ts_p{round(t * 100)}") for t in thresholds],
        (F.coalesce(F.sum(F.when(late, v)), F.lit(0.0)) / F.nullif(F.first("_n1"), F.lit(0))).alias("steady_state_visibility"),
    )
    out = out.withColumn("restoration_ts", F.col(f"restoration_ts_p{round(main * 100)}"))
    out = out.withColumn("steady_state_ratio", F.when(F.col("p0_baseline_mean") > 0, F.col("steady_state_visibility") / F.col("p0_baseline_mean")))
    return out.join(dominant(owners, block, "asn"), block, "left")


def restoration_by_type(events: DataFrame, classification: DataFrame, start: int, block: str = "block") -> DataFrame:
    """(type, n_blocks, n_restored, delay_mean, delay_median, ratio_median, n_never_restored). A row a block is written to the checkpoint folder first (a job runs), for it is read twice."""
    shared_folder(events.sparkSession)
    typed = with_type(events, classification, "asn").withColumn("delay", F.col("restoration_ts") - start).checkpoint()
    out = typed.groupBy("type").agg(F.countDistinct(block).alias("n_blocks"), F.count("restoration_ts").alias("n_restored"), F.avg("delay").alias("delay_mean"))
    out = with_quantiles(out, typed, ["type"], {"delay_median": ("delay", 0.5), "ratio_median": ("steady_state_ratio", 0.5)})
    return out.withColumn("n_never_restored", F.col("n_blocks") - F.col("n_restored"))


def fine_restoration_order(events: DataFrame, blocks: DataFrame, since: int, cc: str = "IR", block: str = "block") -> DataFrame:
    """(block, first_reannounce_ts): the first announcement of the population in each block from `since` on."""
    own = events.where(F.col("event") == "announce").where((F.col("cc") == cc) & (F.col("ts") >= since))
    return map_to_blocks(own, blocks, block=block).groupBy(block).agg(F.min("ts").alias("first_reannounce_ts"))


def restoration_order_by_type(order: DataFrame, owners: DataFrame, classification: DataFrame, start: int, block: str = "block") -> DataFrame:
    """(type, n, delay_median, delay_mean, delay_p10, delay_p90). A row a block is written to the checkpoint folder first (a job runs), for it is read twice."""
    shared_folder(order.sparkSession)
    typed = with_type(order.join(owners.select(block, "asn"), block, "left"), classification, "asn").withColumn("delay", F.col("first_reannounce_ts") - start).checkpoint()
    out = typed.groupBy("type").agg(F.count("*").alias("n"), F.avg("delay").alias("delay_mean"))
    return with_quantiles(out, typed, ["type"], {"delay_median": ("delay", 0.5), "delay_p10": ("delay", 0.1), "delay_p90": ("delay", 0.9)})
