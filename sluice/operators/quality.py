"""Checks of datasets: what is missing, doubled, off the grid or inconsistent. All return findings; empty is good."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import beside, modes, quantiles


def missing_keys(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, problem): expected keys without data are missing, present ones that nobody expects are extra."""
    want, have = expected.select(*keys).distinct(), present.select(*keys).distinct()
    return want.join(have, keys, "left_anti").withColumn("problem", F.lit("missing")).unionByName(have.join(want, keys, "left_anti").withColumn("problem", F.lit("extra")))


def same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> bool:
    """Whether both have the same keys (a job runs)."""
    return missing_keys(a, b, keys).isEmpty()


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n): keys that repeat."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def n_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return duplicates(df, keys).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))


def native_steps(df: DataFrame, by: list[str], start: int | None = None, end: int | None = None) -> DataFrame:
    """(by, n, step, n_irregular, starts_late, ends_early) of series of two rows or more.

    The step is the most frequent difference (of several the smallest); irregular differences are not positive or no multiple of
    it, so a tick missing on the grid is regular. A series starts late or ends early when a whole step is missing at that end of [start, end).
    """
    diff = F.col("ts") - F.lag("ts").over(Window.partitionBy(*by).orderBy("ts"))
    rows = df.withColumn("diff", diff)
    steps = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")).where("n >= 2")
    steps = steps.join(modes(rows, by, "diff").withColumnRenamed("diff", "step"), by)
    odd = rows.where("diff IS NOT NULL").join(steps.select(*by, "step"), by).where("diff <= 0 OR pmod(diff, nullif(step, 0)) <> 0").groupBy(*by).agg(F.count("*").alias("n_irregular"))
    out = steps.join(odd, by, "left").withColumn("n_irregular", F.coalesce("n_irregular", F.lit(0).cast("long")))
    late = F.lit(False) if start is None else F.col("first") >= F.lit(start) + F.col("step")
    early = F.lit(False) if end is None else F.col("last") < F.lit(end) - F.col("step")
    return out.withColumn("starts_late", late).withColumn("ends_early", early).drop("first", "last")


def median_drift(df: DataFrame, value: str, share: float = 0.15) -> DataFrame:
    """Rows whose value is farther than `share` of the median from the series' median."""
    middle = quantiles(df, [], {"_m": (value, 0.5)}).withColumn("_one", F.lit(1))
    far = F.abs(F.col(value) - F.col("_m")) > F.lit(share) * F.col("_m")
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(middle), "_one").where(far).select(*df.columns, F.col("_m").alias("median"))


def time_gaps(df: DataFrame, most: int) -> DataFrame:
    """(ts, next_ts, gap_s): consecutive instants more than `most` seconds apart. Instants are few (one per snapshot)."""
    rows = df.select("ts").distinct().withColumn("next_ts", F.lead("ts").over(Window.orderBy("ts")))
    return rows.withColumn("gap_s", F.col("next_ts") - F.col("ts")).where(F.col("gap_s") > most)


def snapshot_problems(df: DataFrame) -> DataFrame:
    """(ts, problem): snapshots with several audits, uneven peers_total within a family, or a total other than the audit's sum."""
    audit = F.from_json("collector_fullfeed", "map<string,struct<ipv4:int,ipv6:int>>")
    sums = df.groupBy("ts").agg(
        F.countDistinct("collector_fullfeed").alias("audits"),
        *[F.countDistinct(F.when(F.col("family") == f, F.col("peers_total"))).alias(f"kinds{f}") for f in (4, 6)],
        *[F.max(F.when(F.col("family") == f, F.col("peers_total"))).alias(f"total{f}") for f in (4, 6)],
        F.first(audit).alias("audit"),
    )
    told = lambda f: F.aggregate(F.map_values("audit"), F.lit(0), lambda acc, x: acc + x[f"ipv{f}"])
    problem = F.when(F.col("audits") > 1, "several audits").when((F.col("kinds4") > 1) | (F.col("kinds6") > 1), "uneven peers_total")
    problem = problem.when((F.col("total4") != told(4)) | (F.col("total6") != told(6)), "peers_total is not the audit's sum")
    return sums.select("ts", problem.alias("problem")).where("problem IS NOT NULL")


def summary(df: DataFrame, value: str) -> DataFrame:
    ends = df.agg(F.min(value).alias("min"), F.max(value).alias("max"))
    return beside(ends, quantiles(df, [], {"median": (value, 0.5)})).select("min", "median", "max")


def snapshot_health(df: DataFrame, collectors: list[str], share: float = 0.15, most_gap: int = 28_800) -> DataFrame:
    """(unit, n_rows, n_prefixes, ff_v4, ff_v6, gap_s, problems): one row a snapshot, from one scan of (unit, ts, prefix, family, peers_total, collector_fullfeed).

    `unit` is the snapshot that a row's file stands for. `problems`, joined by "; ", are: a ts other than the unit, several audits, collectors that the audit lacks, uneven totals in a family, a total other than the audit's sum, and totals farther
    than `share` of the series' median from it. `gap_s` is the time to the next snapshot where that is more than `most_gap`, else null: between ranges gaps are to be expected, so they are no problem. All that follows the scan works on one row a snapshot.
    """
    family = lambda f, c: F.when(F.col("family") == f, F.col(c))
    per = df.groupBy("unit").agg(
        F.count("*").alias("n_rows"), F.countDistinct("prefix").alias("n_prefixes"), F.min("ts").alias("_t0"), F.max("ts").alias("_t1"),
        F.min("collector_fullfeed").alias("_a0"), F.max("collector_fullfeed").alias("_a1"),
        *[g(family(f, "peers_total")).alias(f"_{n}{f}") for f in (4, 6) for n, g in (("lo", F.min), ("hi", F.max))],
    )
    per = per.withColumn("_told", F.from_json("_a0", "map<string,struct<ipv4:int,ipv6:int>>"))
    whole = Window.partitionBy()  # over snapshots
    for f in (4, 6):
        per = per.withColumn(f"ff_v{f}", F.coalesce(f"_hi{f}", F.lit(0))).withColumn(f"_mid{f}", F.median(F.coalesce(f"_hi{f}", F.lit(0))).over(whole))
    told = lambda f: F.aggregate(F.map_values("_told"), F.lit(0), lambda acc, x: acc + F.coalesce(x[f"ipv{f}"], F.lit(0)))
    said = [
        F.when((F.col("_t0") != F.col("unit")) | (F.col("_t1") != F.col("unit")), "ts is not the unit"),
        F.when(F.col("_a0") != F.col("_a1"), "several audits"),
        *[F.when(~F.coalesce(F.map_contains_key("_told", F.lit(c)), F.lit(False)), f"no {c}") for c in collectors],
        *[F.when(F.col(f"_lo{f}") != F.col(f"_hi{f}"), f"uneven totals of IPv{f}") for f in (4, 6)],
        *[F.when(F.col(f"_hi{f}") != told(f), f"total of IPv{f} is not the audit's sum") for f in (4, 6)],
        *[F.when(F.abs(F.col(f"ff_v{f}") - F.col(f"_mid{f}")) > F.lit(share) * F.col(f"_mid{f}"), f"IPv{f} drifts") for f in (4, 6)],
    ]
    gap = F.lead("unit").over(Window.orderBy("unit")) - F.col("unit")
    return per.select("unit", "n_rows", "n_prefixes", "ff_v4", "ff_v6", F.when(gap > most_gap, gap).alias("gap_s"), F.array_join(F.array_compact(F.array(*said)), "; ").alias("problems"))
