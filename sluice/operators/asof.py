"""Backward as-of joins and densified grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def at_every(keys: DataFrame, grid: DataFrame, on: str = "ts") -> DataFrame:
    """Each row of `keys` at every distinct `on` of `grid`.

    The grid travels as one row with an array, so its size is that of the instants alone, and rows are exploded where they are.
    """
    whole = grid.select(on).distinct().agg(F.collect_list(on).alias("_grid")).withColumn("_one", F.lit(1))
    return keys.withColumn("_one", F.lit(1)).join(F.broadcast(whole), "_one").select(*keys.columns, F.explode("_grid").alias(on))


#: Rows of one key that a task orders at most, and the units of time in which slices begin and end.
MOST, GRAIN = 1_000_000, 3600


def sliced(rows: DataFrame, by: list[str], on: str, most: int = MOST, grain: int = GRAIN) -> DataFrame:
    """`rows` with `_slice`: keys of more than `most` rows are cut into slices of time of about so many, counted in the data; null for all other keys.

    Rows are counted per key and `grain` of time, and a slice begins wherever the running count passes a multiple of `most`. What lies within one grain stays together.
    """
    rows = rows.withColumn("_bin", F.floor(F.col(on) / grain))
    counts = rows.groupBy(*by, "_bin").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_all", F.sum("_n").over(Window.partitionBy(*by)))
    heavy = counts.where(F.col("_all") > most).select(*[F.col(c).alias(f"_h{k}") for k, c in enumerate([*by, "_bin"])], F.floor(F.col("_before") / most).alias("_slice"))
    same = [F.col(c).eqNullSafe(F.col(f"_h{k}")) for k, c in enumerate([*by, "_bin"])]
    return rows.join(heavy, same, "left").drop("_bin", *[f"_h{k}" for k in range(len(by) + 1)])


def running(rows: DataFrame, by: list[str], on: str, then: str, value: str, into: str, how: str, most: int = MOST, grain: int = GRAIN) -> DataFrame:
    """`rows` with `into`: of the rows of a key up to each, in the order of (`on`, `then`), the last non-null `value` (`how` = last) or the largest (max).

    One ordered window a slice, and a scan over the slices of a key that carries what came before into each: a key that holds most of all rows is spread like any other.
    """
    rows = sliced(rows, by, on, most, grain)
    pick = {"last": lambda c: F.last(c, ignorenulls=True), "max": F.max}[how]
    order = Window.partitionBy(*by, "_slice").orderBy(on, then).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn(into, pick(value).over(order))
    final = F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(on, then))) if how == "last" else F.max(value)
    ends = rows.where("_slice IS NOT NULL").groupBy(*by, "_slice").agg(final.alias("_end"))
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    keys = [*by, "_slice"]
    carried = ends.select(*[F.col(c).alias(f"_c{k}") for k, c in enumerate(keys)], pick("_end").over(before).alias("_carried"))
    out = out.join(carried, [F.col(c).eqNullSafe(F.col(f"_c{k}")) for k, c in enumerate(keys)], "left")
    whole = F.coalesce(into, "_carried") if how == "last" else F.greatest(into, "_carried")
    return out.withColumn(into, whole).drop("_slice", "_carried", *[f"_c{k}" for k in range(len(keys))])


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], value: str, on: str = "ts", into: str | None = None, width: int | None = None, most: int = MOST, grain: int = GRAIN) -> DataFrame:
    """`left` with the last non-null `value` of `right` at or before `on`, per `by`; null where there is none.

    Union and an ordered window: no comparison of pairs, streaming within the partition; keys of more than `most` rows are cut into slices of time. Of several readings at one instant the largest counts.
    With `width`, all keys are cut, into stretches of so many seconds.
    """
    into = into or value
    if width:
        most, grain = 1, width
    right = right.where(F.col(value).isNotNull()).groupBy(*by, on).agg(F.max(value).alias("_value"))
    names = [c for c in left.columns if c != into]
    tagged = left.select(*names, F.lit(1).alias("_side"), F.lit(None).cast(dict(right.dtypes)["_value"]).alias("_value"))
    both = tagged.unionByName(right.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    return running(both, list(by), on, "_side", "_value", into, "last", most, grain).where("_side = 1").select(*names, into)


def densify(df: DataFrame, keys: list[str], grid: DataFrame, value: str, on: str = "ts", fill: float = 0.0) -> DataFrame:
    """Every key of `df` at every point of `grid`, with `fill` where `df` has no row: (keys, on, value)."""
    points = at_every(df.select(*keys).distinct(), grid, on)
    return points.join(df.select(*keys, on, value), [*keys, on], "left").withColumn(value, F.coalesce(F.col(value), F.lit(fill)))
