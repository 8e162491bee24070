"""Histograms, valleys and threshold sweeps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .quantiles import quantiles


def bin_edges(spark: SparkSession, bins: int, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """(bin, bin_lo, bin_hi) with evenly spaced edges, computed as lo + k * (hi - lo) / bins."""
    edge = lambda k: F.when(k == bins, F.lit(float(hi))).otherwise(F.lit(float(lo)) + k * F.lit((hi - lo) / bins))
    return spark.range(bins).select(F.col("id").cast("int").alias("bin"), edge(F.col("id")).alias("bin_lo"), edge(F.col("id") + 1).alias("bin_hi"))


def histogram(values: DataFrame, value: str, bins: int, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """(bin, bin_lo, bin_hi, count): bins are closed below and open above, the last closed; empty ones are listed.

    A guess by division is put right by comparing with the edges themselves, so values on an edge fall where the edge says.
    """
    v, step = F.col(value), (hi - lo) / bins
    edge = lambda k: F.when(k == bins, F.lit(float(hi))).otherwise(F.lit(float(lo)) + k * F.lit(step))
    guess = F.least(F.greatest(F.floor((v - F.lit(lo)) / F.lit(step)), F.lit(0)), F.lit(bins - 1))
    exact = F.when(v < edge(guess), guess - 1).when((guess < bins - 1) & (v >= edge(guess + 1)), guess + 1).otherwise(guess)
    counts = values.where((v >= lo) & (v <= hi)).groupBy(exact.cast("int").alias("bin")).agg(F.count("*").alias("count"))
    return bin_edges(values.sparkSession, bins, lo, hi).join(counts, "bin", "left").withColumn("count", F.coalesce("count", F.lit(0).cast("long")))


def density(hist: DataFrame) -> DataFrame:
    total = F.sum("count").over(Window.partitionBy())
    return hist.withColumn("density", F.col("count") / (total * (F.col("bin_hi") - F.col("bin_lo"))))


def find_valley(hist: DataFrame, lo: float, hi: float) -> DataFrame:
    """One row (valley_lo, valley_hi, min_count, method): within the band, the widest run of empty bins (of equal ones the first), else from the first to the last of the sparsest bins."""
    band = hist.where((F.col("bin_lo") >= lo) & (F.col("bin_hi") <= hi))
    empty = band.where("count = 0").withColumn("island", F.col("bin") - F.row_number().over(Window.orderBy("bin")))
    run = empty.groupBy("island").agg(F.min("bin_lo").alias("valley_lo"), F.max("bin_hi").alias("valley_hi"), F.count("*").alias("width"), F.min("bin").alias("first"))
    best = run.orderBy(F.desc("width"), "first").limit(1).select("valley_lo", "valley_hi", F.lit(0).cast("long").alias("min_count"), F.lit("empty").alias("method"), F.lit(0).alias("rank"))
    sparse = band.withColumn("least", F.min("count").over(Window.partitionBy())).where("count = least")
    other = sparse.agg(F.min("bin_lo").alias("valley_lo"), F.max("bin_hi").alias("valley_hi"), F.max("least").alias("min_count")).where("valley_lo IS NOT NULL").withColumn("method", F.lit("sparsest")).withColumn("rank", F.lit(1))
    return best.union(other).orderBy("rank").limit(1).drop("rank")


def _passed(value: Column, limits: list[Column]) -> Column:
    """How many of the ascending limits the value has reached."""
    return reduce(Column.__add__, [(value >= x).cast("int") for x in limits])


def dark_ratio_sweep(readings: DataFrame, ratios: list[float]) -> DataFrame:
    """(ratio, n, n_asns, false_dark_rate) from (asn, probing, baseline): a row is placed once between the ratios, and the counts up to each ratio answer it. Baselines are not negative; rows without a reading or a baseline are no part of the rate."""
    ratios = sorted(set(ratios))
    rows = readings.withColumn("_from", _passed(F.col("probing"), [F.lit(r) * F.col("baseline") for r in ratios]))  # dark from this ratio on
    one = rows.agg(F.count("*").alias("n"), F.countDistinct("asn").alias("n_asns"), F.count("_from").alias("known"), *[F.count_if(F.col("_from") <= k).alias(f"_dark{k}") for k in range(len(ratios))])
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("ratio"), (F.col(f"_dark{k}") / F.nullif("known", F.lit(0))).alias("false_dark_rate")) for k, r in enumerate(ratios)]))
    return one.where("n > 0").select("n", "n_asns", each.alias("x")).select("x.ratio", "n", "n_asns", "x.false_dark_rate")


def state_grid(rows: DataFrame, announced: list[float], dark: list[float]) -> DataFrame:
    """(announced_min, dark_ratio, n, n_withdrawn, n_dark, n_reachable) of (visibility, probing, baseline) rows, for every pair of thresholds.

    A row is placed once among both lists of thresholds; running counts over the cells in both directions then answer all pairs, however many there are. States are those of `states.state`; rows without a visibility are announced.
    """
    announced, dark = sorted(set(announced)), sorted(set(dark))
    na, nd = len(announced), len(dark)
    known = F.col("probing").isNotNull() & F.col("baseline").isNotNull() & (F.col("baseline") > 0)
    i = F.coalesce(_passed(F.col("visibility"), [F.lit(a) for a in announced]), F.lit(na))  # withdrawn from threshold i on
    j = F.when(known, _passed(F.col("probing"), [F.lit(d) * F.col("baseline") for d in dark])).otherwise(nd)  # dark from ratio j on
    cells = rows.select(i.alias("i"), j.alias("j")).groupBy("i", "j").agg(F.count("*").alias("n"))
    empty = rows.sparkSession.range((na + 1) * (nd + 1)).select((F.col("id") / (nd + 1)).cast("int").alias("i"), (F.col("id") % (nd + 1)).cast("int").alias("j"), F.lit(0).cast("long").alias("n"))
    cells = cells.unionByName(empty).groupBy("i", "j").agg(F.sum("n").alias("n"))
    along = Window.partitionBy("i").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("j").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    table = cells.withColumn("n", F.sum("n").over(along)).withColumn("n", F.sum("n").over(down))  # rows at i or more and at j or less
    whole = Window.partitionBy()  # the table has a cell for each pair
    table = table.withColumn("all", F.max("n").over(whole)).withColumn("up", F.max("n").over(Window.partitionBy("i")))
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), k)
    out = table.where((F.col("i") >= 1) & (F.col("j") < nd))
    return out.select(pick(announced, F.col("i")).alias("announced_min"), pick(dark, F.col("j") + 1).alias("dark_ratio"), F.col("all").alias("n"), (F.col("all") - F.col("up")).alias("n_withdrawn"), F.col("n").alias("n_dark"), (F.col("up") - F.col("n")).alias("n_reachable"))


def largest_ratio_under(sweep: DataFrame, most: float) -> DataFrame:
    """One row: the largest ratio whose rate is below `most` (strictly); null if none is."""
    return sweep.agg(F.max(F.when(F.col("false_dark_rate") < most, F.col("ratio"))).alias("ratio"))


def bimodality(series: dict[str, DataFrame], lo: float = 0.2, hi: float = 0.8) -> DataFrame:
    """(series, n, ambiguous_share, near_zero_share, near_one_share) over the instants all series share. Edges count on both sides."""
    shared = None
    for df in series.values():
        ts = df.select("ts").distinct()
        shared = ts if shared is None else shared.intersect(ts)
    parts = [df.join(shared, "ts", "left_semi").select(F.lit(name).alias("series"), "visibility") for name, df in series.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    v, share = F.col("visibility"), lambda c: F.avg(c.cast("double"))
    return rows.groupBy("series").agg(F.count("*").alias("n"), share(v.between(lo, hi)).alias("ambiguous_share"), share(v <= lo).alias("near_zero_share"), share(v >= hi).alias("near_one_share"))


def monthly_band(df: DataFrame, value: str, by: str = "type") -> DataFrame:
    """(month, lo, hi): the range across types of their monthly means. `ts` is unix seconds."""
    month = F.date_trunc("month", F.timestamp_seconds("ts"))
    means = df.groupBy(month.alias("month"), by).agg(F.avg(value).alias("m"))
    return means.groupBy("month").agg(F.min("m").alias("lo"), F.max("m").alias("hi"))


def to_baseline_median(df: DataFrame, reference: DataFrame, value: str = "value") -> DataFrame:
    """Adds `ratio`, the value over the median of the reference rows."""
    median = quantiles(reference, [], {"_m": (value, 0.5)})
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(median.withColumn("_one", F.lit(1))), "_one").withColumn("ratio", F.col(value) / F.nullif(F.col("_m"), F.lit(0.0))).drop("_one", "_m")
