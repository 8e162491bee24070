"""Named half-open windows, assignment to them, and sweeps over their bounds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Window:
    """[start, end) in unix seconds."""

    name: str
    start: int
    end: int


def table(spark: SparkSession, windows: list[Window]) -> DataFrame:
    return spark.createDataFrame([(k, w.name, w.start, w.end) for k, w in enumerate(windows)], "position int, phase string, start long, end long")


def assign(ts: Column, windows: list[Window]) -> Column:
    """The window that holds `ts`; of several the one declared last; outside all, null."""
    out = F.lit(None).cast("string")
    for w in windows:
        out = F.when((ts >= w.start) & (ts < w.end), F.lit(w.name)).otherwise(out)
    return out


def shifted(windows: list[Window], boundary: str, shift: int) -> list[Window]:
    """The end of `boundary`, and with it the start of the next window, moved by `shift` seconds."""
    at = next((k for k, w in enumerate(windows) if w.name == boundary), None)
    if at is None:
        raise KeyError(f"unknown window {boundary!r}; known: {[w.name for w in windows]}")
    if at == len(windows) - 1:
        raise ValueError(f"{boundary!r} is the last window: it has no boundary to move")
    out = list(windows)
    out[at] = Window(out[at].name, out[at].start, out[at].end + shift)
    out[at + 1] = Window(out[at + 1].name, out[at + 1].start + shift, out[at + 1].end)
    return out


def in_each(df: DataFrame, variants: dict[int, list[Window]], ts: str = "ts", name: str = "shift") -> DataFrame:
    """One copy of `df`'s rows per variant that has a window for them: adds `name` (the variant) and `phase`.

    One scan serves all variants: each row is exploded to at most len(variants) rows.
    """
    each = F.array(*[F.struct(F.lit(k).cast("long").alias(name), assign(F.col(ts), ws).alias("phase")) for k, ws in variants.items()])
    return df.withColumn("_v", F.explode(each)).select(*df.columns, f"_v.{name}", "_v.phase").where("phase IS NOT NULL")


def all_phases(df: DataFrame, windows: list[Window]) -> DataFrame:
    """Per-phase results with a row for every window; what a missing one lacks is null."""
    return table(df.sparkSession, windows).select("phase").join(df, "phase", "left")
