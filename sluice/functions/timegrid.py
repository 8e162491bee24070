"""Unix seconds, ISO-8601, and fixed grids (UTC sessions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def seconds(ts: Column) -> Column:
    """TIMESTAMP or TIMESTAMP_NTZ to unix seconds."""
    return F.unix_seconds(ts.cast("timestamp"))


def from_iso(text: Column) -> Column:
    """ISO-8601 to unix seconds; no zone means UTC."""
    return F.unix_seconds(F.to_timestamp(text))


def to_iso(ts: Column) -> Column:
    return F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def floor_to(ts: Column, step: int) -> Column:
    return ts - F.pmod(ts, F.lit(step))


def ceil_to(ts: Column, step: int) -> Column:
    return floor_to(ts + F.lit(step - 1), step)


def on_grid(ts: Column, step: int) -> Column:
    return F.pmod(ts, F.lit(step)) == 0


def grid_array(start: Column, end: Column, step: int) -> Column:
    """Grid points in [start, end); empty when there are none (a bare sequence() would descend or fail)."""
    first = ceil_to(start, step)
    return F.when(first < end, F.sequence(first, end - 1, F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def grid(spark: SparkSession, start: int, end: int, step: int) -> DataFrame:
    """Grid points in [start, end) as rows (ts)."""
    first = -(-start // step) * step
    return spark.range(first, max(first, end), step).withColumnRenamed("id", "ts")


def chunks(spark: SparkSession, start: int, end: int, most: int) -> DataFrame:
    """[start, end) cut into consecutive [from, until) of at most `most` seconds."""
    return spark.range(start, max(start, end), most).select(F.col("id").alias("from"), F.least(F.col("id") + most, F.lit(end)).alias("until"))


def near_grid(ts: Column, step: int, margin: int) -> Column:
    """The grid point that lies within `margin` seconds of ts, else null."""
    point = floor_to(ts + F.lit(margin), step)
    return F.when(F.abs(ts - point) <= margin, point)


def url_path(pattern: str, ts: Column) -> Column:
    """A URL from a date pattern (text in quotes) at unix second `ts`."""
    return F.date_format(F.timestamp_seconds(ts), pattern)
