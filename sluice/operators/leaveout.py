"""Statistics of all entities but one, for each of them, without a run for each.

What is left when an entity goes is the whole less its own part. For sums that is a subtraction. For medians it is one of ranks: of an entity's own rows, in
order, it is known how many rows of others come before each; a rank among the others is then a rank among all, moved on by the number of own rows before it. So the rows are ranked
once, each entity counts its own rows, and one join by rank fetches the values.

Ranks are found in bins of the value (see `quantiles`), so no task orders a whole group or a whole entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import bin_of


def _before(rows: DataFrame, by: list[str], into: str, *order: Column | str) -> DataFrame:
    """`rows` (with _bin) and the number of rows of the same `by` that come before each, by value, then `order`."""
    counts = rows.groupBy(*by, "_bin").agg(F.count("*").alias("_n"))
    along = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(c).alias(f"_b{k}") for k, c in enumerate([*by, "_bin"])], F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_base"))
    same = [F.col(c).eqNullSafe(F.col(f"_b{k}")) for k, c in enumerate([*by, "_bin"])]
    inside = Window.partitionBy(*by, "_bin").orderBy("_v", *order)
    out = rows.withColumn("_k", F.row_number().over(inside) - 1).join(counts, same)
    return out.withColumn(into, F.col("_base") + F.col("_k")).drop("_k", "_base", *[f"_b{k}" for k in range(len(by) + 1)])


def leave_one_out(rows: DataFrame, entity: str, value: str) -> DataFrame:
    """(entity, n, mean, median) of the rows of all other entities, a row for each entity; null where there is no other.

    Null values are not counted, and an entity that has no others is left out. A null entity is an entity.
    """
    rows = rows.select(F.col(entity).alias("_e"), F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL").withColumn("_bin", bin_of(F.col("_v")))
    # where two rows of one entity have one value, either order gives the same ranks to both
    ranked = _before(_before(rows, [], "_rank", "_e"), ["_e"], "_own")
    whole = Window.partitionBy()  # over entities
    own = rows.groupBy("_e").agg(F.count("*").alias("_n"), F.sum("_v").alias("_s"))
    own = own.withColumn("n", F.sum("_n").over(whole) - F.col("_n")).withColumn("mean", (F.sum("_s").over(whole) - F.col("_s")) / F.nullif("n", F.lit(0)))
    middle = {"_low": F.floor((F.col("n") - 1) / 2), "_high": F.ceil((F.col("n") - 1) / 2)}
    facts = own.select(F.col("_e").alias("_f"), "n", "mean", *[at.alias(name) for name, at in middle.items()])
    moved = ranked.join(facts, F.col("_e").eqNullSafe(F.col("_f"))).groupBy("_f", "n", "mean", "_low", "_high").agg(*[F.count_if(F.col("_rank") - F.col("_own") <= F.col(c)).alias(f"{c}_moved") for c in middle])
    asked = moved.select("_f", "n", "mean", F.explode(F.array(*[F.col(c) + F.col(f"{c}_moved") for c in middle])).alias("_at"))
    found = asked.join(ranked.select(F.col("_rank").alias("_at"), "_v"), "_at", "left").groupBy("_f", "n", "mean").agg(F.avg("_v").alias("median"))
    return found.select(F.col("_f").alias(entity), "n", "mean", F.when(F.col("n") > 0, F.col("median")).alias("median"))
