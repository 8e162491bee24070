"""Sustained excursions of a signal, neighbours' interpolation, and stratified samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def excursions(df: DataFrame, below: Column, by: list[str], least: int, ts: str = "ts") -> DataFrame:
    """(by, start, end, n): runs of consecutive rows for which `below` holds, from the first to the last, that span `least` seconds or more."""
    order = Window.partitionBy(*by).orderBy(ts)
    rows = df.withColumn("_in", F.coalesce(below, F.lit(False)))
    rows = rows.withColumn("_run", F.sum((~F.col("_in")).cast("int")).over(order)).where("_in")
    runs = rows.groupBy(*by, "_run").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n"))
    return runs.where(F.col("end") - F.col("start") >= least).drop("_run")


def against_neighbours(df: DataFrame, value: str, by: list[str], ts: str = "ts") -> DataFrame:
    """Adds `interpolated`, linear between the rows before and after; null at either end."""
    order = Window.partitionBy(*by).orderBy(ts)
    a, b, s, t = F.lag(value).over(order), F.lead(value).over(order), F.lag(ts).over(order), F.lead(ts).over(order)
    share = (F.col(ts) - s) / F.nullif(t - s, F.lit(0))
    return df.withColumn("interpolated", a + (b - a) * share)


def stratified(df: DataFrame, stratum: str, key: str, most: int, seed: str = "seed") -> DataFrame:
    """`most` rows of each stratum, drawn by a seeded hash of the key: the same at every run. Adds `place`."""
    order = Window.partitionBy(stratum).orderBy(F.md5(F.concat(F.lit(seed + ":"), F.col(key).cast("string"))), key)
    return df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def extremes(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row (lowest, highest): the keys with the smallest and the largest value; of several the smallest key."""
    order = F.struct(F.col(value), F.col(key))
    low, high = F.min_by(key, order), F.min_by(key, F.struct(-F.col(value), F.col(key)))
    return df.where(F.col(value).isNotNull()).agg(low.alias("lowest"), high.alias("highest"))
