"""What should be there, what is, and what has to be done again.

A unit is a snapshot of a series, an entity, a file: whatever is made and written as a whole. Expected units come from grids, several of which may make up one
series. A manifest has a row for each finished unit, with the number of rows it gave and a fingerprint of what it was made from; so a unit that gave no rows is
done all the same, and one whose input has changed is not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.functions.timegrid import grid_array
from sluice.sources.sinks import exists

UNIT = ["series", "unit"]
MANIFEST = "series string, unit string, n_rows long, fingerprint long"


class Incomplete(ValueError):
    """A required series is not whole."""


def expected_units(spark: SparkSession, ranges: list[tuple[str, int, int, int]]) -> DataFrame:
    """(series, unit): the union of grids (series, start, end, step), starts rounded up to the grid, ends exclusive. Units that several ranges of a series share count once."""
    rows = spark.createDataFrame(ranges, "series string, start long, end long, step long")
    points = None
    for step in sorted({r[3] for r in ranges}):
        some = rows.where(F.col("step") == step).select("series", F.explode(grid_array(F.col("start"), F.col("end"), step)).alias("unit"))
        points = some if points is None else points.unionByName(some)
    return points.select("series", F.col("unit").cast("string").alias("unit")).distinct()


def fingerprints(inputs: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_rows, fingerprint): of the rows each unit is made from, in any order. Rows that repeat count."""
    rows = inputs.select(*by, F.xxhash64(*[c for c in inputs.columns if c not in by]).alias("h"))
    counted = rows.groupBy(*by, "h").agg(F.count("*").alias("k"))
    return counted.groupBy(*by).agg(F.sum("k").alias("n_rows"), F.bit_xor(F.xxhash64("h", "k")).alias("fingerprint"))


def finished(spark: SparkSession, path: str) -> DataFrame:
    """The manifest at `path`: of units recorded more than once the last record."""
    if not exists(spark, path):
        return spark.createDataFrame([], MANIFEST)
    last = Window.partitionBy(*UNIT).orderBy(F.desc("at"))
    return spark.read.parquet(path).withColumn("_k", F.row_number().over(last)).where("_k = 1").select(*[c.split()[0] for c in MANIFEST.split(", ")])


def record(units: DataFrame, path: str) -> None:
    """Add finished units (series, unit, n_rows, fingerprint) to the manifest, once their data is written. Runs a job."""
    units.select(*[c.split()[0] for c in MANIFEST.split(", ")], F.current_timestamp().alias("at")).write.mode("append").parquet(path)


def to_do(expected: DataFrame, manifest: DataFrame, inputs: DataFrame | None = None) -> DataFrame:
    """(series, unit, reason): expected units that are not finished (missing), and, given the present `inputs` (series, unit, fingerprint), those made from others (stale)."""
    done = manifest.select(*UNIT, F.col("fingerprint").alias("_made"), F.lit(True).alias("_done"))
    units = expected.select(*UNIT).distinct().join(done, UNIT, "left")
    reason = F.when(F.col("_done").isNull(), "missing")
    if inputs is not None:
        units = units.join(inputs.select(*UNIT, F.col("fingerprint").alias("_now")), UNIT, "left")
        reason = reason.when(~F.col("_made").eqNullSafe(F.col("_now")), "stale")
    return units.select(*UNIT, reason.alias("reason")).where("reason IS NOT NULL")


def report(expected: DataFrame, present: DataFrame, consolidated: DataFrame | None = None, sample: int = 10) -> DataFrame:
    """(series, n_expected, n_present, n_missing, n_extra, n_stale, first_missing, complete), a row a series, from (series, unit) tables, each read once.

    Stale are the units in which `consolidated` differs from what is present. `first_missing` lists at most `sample` units. A series is complete if nothing is missing or stale; extra units do no harm.
    """
    flags = {"e": expected, "p": present} | ({} if consolidated is None else {"c": consolidated})
    marked = None
    for name, units in flags.items():
        some = units.select(*UNIT, *[F.lit(name == n).alias(n) for n in ("e", "p", "c")])
        marked = some if marked is None else marked.unionByName(some)
    units = marked.groupBy(*UNIT).agg(*[F.bool_or(n).alias(n) for n in ("e", "p", "c")])
    missing, stale = F.col("e") & ~F.col("p"), (F.col("c") != F.col("p")) if consolidated is not None else F.lit(False)
    counts = units.groupBy("series").agg(
        F.count_if("e").alias("n_expected"), F.count_if(F.col("e") & F.col("p")).alias("n_present"), F.count_if(missing).alias("n_missing"),
        F.count_if(F.col("p") & ~F.col("e")).alias("n_extra"), F.count_if(stale).alias("n_stale"),
    )
    first = Window.partitionBy("series").orderBy("unit")
    listed = units.where(missing).withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= sample)
    listed = listed.groupBy("series").agg(F.array_join(F.array_sort(F.collect_list("unit")), ",").alias("first_missing"))
    out = counts.join(listed, "series", "left").withColumn("first_missing", F.coalesce("first_missing", F.lit("")))
    return out.withColumn("complete", (F.col("n_missing") == 0) & (F.col("n_stale") == 0))


def require(found: DataFrame, series: list[str]) -> None:
    """Fail (a job runs) if one of these series is unknown to the report or not complete."""
    states = {r["series"]: r["complete"] for r in found.where(F.col("series").isin(series)).select("series", "complete").collect()}
    if unknown := sorted(set(series) - set(states)):
        raise Incomplete(f"unknown series: {', '.join(unknown)}")
    if broken := sorted(s for s, whole in states.items() if not whole):
        raise Incomplete(f"incomplete: {', '.join(broken)}")
