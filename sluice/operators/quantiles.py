"""Exact quantiles and modes of groups of any size.

The built-in aggregates keep all distinct values of a group in one task. Here equal values are counted map-side and dealt by value, then in bins; the bin in which a rank falls follows from
the running counts of a group's bins, and only the values of that bin are put in order. One pass over the rows, one shuffle of distinct values, no job, no group in one task.

Bins are even in the logarithm of 1 + |value|: `FINE` to each factor of e, so their number is bounded by the type's range. Only their order matters for the result, and the logarithm keeps it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FINE = 4096


def bin_of(value: Column) -> Column:
    """Falls nowhere as the value grows; NaN stays NaN, which sorts last."""
    return F.signum(value) * F.rint(F.log1p(F.abs(value)) * FINE)


def _found(df: DataFrame, by: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """(g, wanted) for groups with values; g is the struct of `by`."""
    columns = sorted({c for c, _ in wanted.values()})
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    rows = df.select(group.alias("g"), F.explode(F.array(*[F.struct(F.lit(k).alias("c"), F.col(c).cast("double").alias("v")) for k, c in enumerate(columns)])).alias("x"))
    rows = rows.select("g", "x.c", "x.v").where("v IS NOT NULL").withColumn("bin", bin_of(F.col("v")))
    values = rows.groupBy("g", "c", "bin", "v").agg(F.count("*").alias("n"))

    every = Window.partitionBy("g", "c")
    before = every.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = values.groupBy("g", "c", "bin").agg(F.sum("n").alias("n")).withColumn("below", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("total", F.sum("n").over(every))
    ranks = F.lit(None).cast("array<long>")
    for k, c in enumerate(columns):
        shares = sorted({p for d, p in wanted.values() if d == c})
        here = F.array_distinct(F.array(*[f(F.lit(p) * (F.col("total") - 1)).cast("long") for p in shares for f in (F.floor, F.ceil)]))
        ranks = F.when(F.col("c") == k, here).otherwise(ranks)
    holds = lambda c: F.filter(c, lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("n")))
    bins = bins.withColumn("ranks", holds(ranks)).where(F.size("ranks") > 0).select(F.col("g").alias("_g"), F.col("c").alias("_c"), F.col("bin").alias("_bin"), "below", "total", "ranks")

    # null-safe, so that no filter on nulls goes below the counts: both readings of them share one shuffle
    same = F.col("g").eqNullSafe(F.col("_g")) & F.col("c").eqNullSafe(F.col("_c")) & F.col("bin").eqNullSafe(F.col("_bin"))
    inside = Window.partitionBy("g", "c", "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    placed = values.join(bins, same).withColumn("below", F.col("below") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    found = placed.select("g", "c", "v", "total", F.explode(holds("ranks")).alias("rank"))

    out = []
    for name, (c, p) in wanted.items():
        at = F.lit(p) * (F.col("total") - 1)
        low, high = (F.max(F.when((F.col("c") == columns.index(c)) & (F.col("rank") == f(at)), F.col("v"))) for f in (F.floor, F.ceil))
        after, until = (F.max(F.when(F.col("c") == columns.index(c), x)) for x in (at - F.floor(at), F.ceil(at) - at))
        out.append(F.when(low == high, low).otherwise(until * low + after * high).alias(name))
    return found.groupBy("g").agg(*out) if by else found.agg(*out)


def quantiles(df: DataFrame, by: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """`by` and a column for each of `wanted`, {name: (column, share)}: between two ranks as `percentile` does it. Columns are read as doubles.

    Null values are not counted; a group without values has nulls. Nulls in `by` are a group. Without `by`, one row, also for an empty table.
    """
    found = _found(df, by, wanted)
    if not by:
        return found
    return df.select(F.struct(*by).alias("g")).distinct().join(found, "g", "left").select("g.*", *wanted)


def with_quantiles(aggregated: DataFrame, df: DataFrame, by: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """`aggregated`, one row for each group of `df`, with the quantiles beside it."""
    found = _found(df, by, wanted).withColumnRenamed("g", "_quantiles_of")
    return aggregated.withColumn("_quantiles_of", F.struct(*by)).join(found, "_quantiles_of", "left").drop("_quantiles_of")


def beside(one: DataFrame, other: DataFrame) -> DataFrame:
    """Two tables of one row as one, without a join."""
    return one.unionByName(other, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in one.columns + other.columns])


def modes(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """`by` and the value that a group's rows have most often; of equally frequent ones the smallest, nulls aside. Null where a group has only nulls."""
    counted = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    seen = F.when(F.col(value).isNotNull(), F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v")))
    return counted.groupBy(*by).agg(F.min(seen)["v"].alias(value))
