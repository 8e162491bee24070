"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a token target from its weight. Whole epochs of a source come first; the rest of its target is
filled by weighted sampling without replacement: each document draws an exponential key with the document's
quality as rate, the keys are sorted within the source, and documents are taken until the prefix sum of their
sizes comes nearest to what is left.

The prefix sum never sorts a whole source in one task. Keys are counted in bins of their logarithm, `BINS` to each power of two; whatever the
qualities, no bin is expected to hold more than 0.37 ln 2 / BINS of a source. Only the keys of the one bin in which the target falls are sorted, and every other row is
decided by its bin alone. So a source that holds most of the rows costs as much as many small ones. Rows that repeat id and
text share a key; where the target falls among them, as many are taken as come nearest, told apart by a hash of their place that is counted in bins as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, hide, shown

BINS = 1024
#: Rows of one key are told apart in 2**TIES bins.
TIES = 12
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0


def words(text: Column) -> Column:
    """Runs of anything but ASCII white space (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD + "+")), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """From 0.1 to 1: the share of letters and white space in the text (null or empty: 0.1)."""
    share = F.length(F.regexp_replace(text, r"[^\p{L}\s]+", "")) / F.nullif(F.length(text), F.lit(0))
    return F.lit(0.1) + F.lit(0.9) * F.coalesce(share, F.lit(0.0))


def uniform(*columns: Column) -> Column:
    """In (0, 1), decided by the values alone, so that reruns and retried tasks agree."""
    return (F.shiftrightunsigned(F.xxhash64(*columns), 11) + F.lit(0.5)) / F.lit(float(1 << 53))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sources in code point order, null last, weigh `weights` in turn. They share `share` times all sizes; no target passes
    `most` times its source's size, and what is above goes to the others by weight: water rises to one level
    per unit of weight, found from prefix sums over the sources sorted by where they are full. A source of size 0 gets 0.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    ranked = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("full", F.col("cap") / F.col("w"))
    up = Window.orderBy(F.col("full"), F.col("source").asc_nulls_last())
    before, after, every = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    left = F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    levels = ranked.withColumn("level", left / F.sum("w").over(after))
    water = F.min_by(F.when(F.col("level") <= F.col("full"), F.col("level")), F.when(F.col("level") <= F.col("full"), F.col("full"))).over(every)
    levels = levels.withColumn("water", water)
    return levels.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("w") * F.col("water"), F.col("cap"))).alias("target"))


def _among_equals(narrow: DataFrame, asked: DataFrame) -> DataFrame:
    """(_s, _p): for each source of `asked` (_s, _v, take) the `_p` of the last of the `take` rows with key _v and the smallest _p. No task sorts all of them."""
    rows = narrow.join(asked, ["_s", "_v"]).select("_s", "take", "_p", F.shiftright("_p", 63 - TIES).alias("_pb"))
    up = Window.partitionBy("_s").orderBy("_pb").rowsBetween(Window.unboundedPreceding, 0)
    bins = rows.groupBy("_s", "_pb").agg(F.count("*").alias("b"), F.first("take").alias("take")).withColumn("upto", F.sum("b").over(up))
    edge = bins.where(F.col("upto") >= F.col("take")).groupBy("_s").agg(F.min("_pb").alias("_pb"), F.min_by(F.col("take") - F.col("upto") + F.col("b"), "_pb").alias("nth"))
    ranked = rows.join(edge, ["_s", "_pb"]).withColumn("k", F.row_number().over(Window.partitionBy("_s").orderBy("_p")))
    return ranked.where("k = nth").select("_s", F.col("_p").alias("_tie"))


def mix(
    docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 17, weight: Callable[[Column], Column] = quality
) -> DataFrame:
    """All rows of `docs` with `size`, `source_size`, `target`, `copies` and `taken` (= copies * size).

    `weight` makes a positive quality weight from the text. Null or blank text: size 0, taken 0 words, though its copies follow its key. A null source is a source of
    its own. Rows that repeat id and text are each a document, and as good as each other. A column of `docs` that has the
    name of a result column is replaced. No rows in, no rows out. `docs` must be the same when it is read again, as a scan of files is.
    """
    docs, names = hide(docs)
    id, text, source = names[id], names[text], names[source]
    v = F.greatest(-F.log(uniform(F.lit(seed), F.col(id), F.col(text))) / weight(F.col(text)), F.lit(1e-17))
    place = F.shiftrightunsigned(F.xxhash64(F.lit(23), F.monotonically_increasing_id()), 1)
    keyed = docs.select(*names.values(), words(F.col(text)).alias("size"), v.alias("_v"), place.alias("_p"), F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("_s"))
    keyed = keyed.withColumn("_bin", F.floor(F.log2("_v") * BINS).cast("int"))
    narrow = cut(keyed.select("_s", "size", "_v", "_p", "_bin"))

    sizes = narrow.groupBy("_s").agg(F.sum("size").alias("source_size"))
    named = sizes.select(F.when(F.col("_s") != "", F.substring("_s", 2, 1 << 30)).alias("source"), "source_size")
    goal = source_targets(named, weights, share, most)
    goal = goal.select(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("_s"), "source_size", "target")
    goal = goal.withColumn("epochs", F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)))
    goal = cut(goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))

    bins = narrow.groupBy("_s", "_bin").agg(F.sum("size").alias("b"))
    up = Window.partitionBy("_s").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("upto", F.sum("b").over(up)).join(goal, "_s")
    edge = bins.where((F.col("upto") >= F.col("rest")) & (F.col("rest") > 0)).groupBy("_s").agg(F.min("_bin").alias("_edge"), F.min_by(F.col("upto") - F.col("b"), "_bin").alias("below"), F.first("rest").alias("rest"))
    inside = narrow.join(edge.withColumnRenamed("_edge", "_bin"), ["_s", "_bin"])
    inside = inside.groupBy("_s", "_v").agg(F.sum("size").alias("all"), F.count("*").alias("n"), F.max("size").alias("size"), F.first("below").alias("below"), F.first("rest").alias("rest"))
    inside = inside.withColumn("upto", F.col("below") + F.sum("all").over(Window.partitionBy("_s").orderBy("_v")))
    at = inside.where(F.col("upto") >= F.col("rest")).groupBy("_s").agg(F.min_by(F.struct("_v", "n", F.least("n", F.coalesce(F.floor((F.col("rest") - F.col("upto") + F.col("all")) / F.nullif("size", F.lit(0)) + 0.5), "n")).alias("take")), "_v").alias("x"))
    at = cut(at.select("_s", "x.*"))
    ties = _among_equals(narrow, at.where("take > 0 AND take < n").select("_s", "_v", "take"))
    plan = goal.join(edge.select("_s", "_edge"), "_s", "left").join(at.select("_s", F.col("_v").alias("_last"), "n", "take"), "_s", "left").join(ties, "_s", "left")
    plan = cut(plan.withColumn("_tie", F.coalesce("_tie", F.when(F.col("take") >= F.col("n"), F.lit((1 << 63) - 1)), F.lit(-1))).drop("rest", "n", "take"))

    out = keyed.join(plan, "_s", "left")
    inner = (F.col("_v") < F.col("_last")) | ((F.col("_v") == F.col("_last")) & (F.col("_p") <= F.col("_tie")))
    picked = (F.col("_bin") < F.col("_edge")) | ((F.col("_bin") == F.col("_edge")) & inner)
    out = out.withColumn("copies", F.col("epochs") + F.coalesce(picked, F.lit(False)).cast("long"))
    return out.select(*shown(names, "size", "source_size", "target", "copies", "taken"), "size", F.col("source_size").cast("long"), F.col("target").cast("double"), "copies", (F.col("copies") * F.col("size")).alias("taken"))
