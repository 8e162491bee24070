"""Agreement between series, runs, sources and coders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .asof import GRAIN, MOST, running


def cross_check(a: DataFrame, b: DataFrame, keys: list[str], value: str = "value", within: float = 1e-6) -> DataFrame:
    """Rows of both whose values differ: not both null, and not closer than `within`."""
    both = a.select(*keys, F.col(value).alias("a")).join(b.select(*keys, F.col(value).alias("b")), keys)
    same = (F.col("a").isNull() & F.col("b").isNull()) | F.coalesce(F.abs(F.col("a") - F.col("b")) <= within, F.lit(False))
    return both.where(~same)


def run_differences(ours: DataFrame, theirs: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(kind, keys) where two runs are not the same: missing, extra, or differing in `columns` (null equals null)."""
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    mark = lambda df, side: df.withColumn("_here", F.lit(1)).alias(side)
    both = mark(ours, "a").join(mark(theirs, "b"), on, "full")
    kind = F.when(F.col("b._here").isNull(), "extra").when(F.col("a._here").isNull(), "missing").when(~same, "differs")
    return both.select(kind.alias("kind"), *[F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys]).where("kind IS NOT NULL")


def own_rows(df: DataFrame, cc: str = "IR") -> DataFrame:
    """Rows of the population `cc`; all of them where none is named, as in snapshots made before there were several."""
    return df.where(F.col("cc").isNull() | (F.col("cc") == cc)) if "cc" in df.columns else df


def audit_lists(df: DataFrame, by: str = "ts", audit: str = "collector_fullfeed", seq: str = "seq") -> DataFrame:
    """(by, place, audit): the distinct audits of each snapshot in the order in which they come first."""
    first = df.groupBy(by, audit).agg(F.min(seq).alias("_first"))
    return first.select(by, F.row_number().over(Window.partitionBy(by).orderBy("_first")).alias("place"), audit)


def compare_snapshots(base: DataFrame, candidate: DataFrame, cc: str = "IR", columns: tuple[str, ...] = ("peers_seen", "peers_total", "visibility", "origin_asn")) -> DataFrame:
    """(ts, kind, n, of, example): what differs between two runs of the same snapshots; empty if nothing does.

    Kinds: `collector_fullfeed`, the places at which the ordered lists of audits differ; `only_base` and `only_candidate`, prefixes of the population that one run lacks; and each of `columns`, in which null equals null. `of` counts
    places, prefixes of either run, and prefixes of both. The example is the first place, or the smallest prefix. Rows have ts, seq (their order in the snapshot), prefix and the columns; rows of other populations may be there or not.
    """
    a, b = (audit_lists(df).select("ts", "place", F.struct("collector_fullfeed").alias(name)) for df, name in ((base, "_a"), (candidate, "_b")))
    odd = ~F.col("_a").eqNullSafe(F.col("_b"))
    lists = a.join(b, ["ts", "place"], "full").groupBy("ts").agg(F.count_if(odd).alias("n"), F.count("*").alias("of"), F.min(F.when(odd, F.col("place"))).cast("string").alias("example"))
    side = lambda df, name: own_rows(df, cc).select("ts", "prefix", F.struct(*columns).alias(name))
    both = side(base, "_a").join(side(candidate, "_b"), ["ts", "prefix"], "full")
    there = {"only_base": F.col("_b").isNull(), "only_candidate": F.col("_a").isNull()}
    shared = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    kinds = {k: (v, F.lit(True)) for k, v in there.items()} | {c: (shared & ~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), shared) for c in columns}
    rows = both.select("ts", "prefix", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), odd.alias("odd"), among.alias("among")) for k, (odd, among) in kinds.items()])).alias("x"))
    found = rows.groupBy("ts", "x.kind").agg(F.count_if("x.odd").alias("n"), F.count_if("x.among").alias("of"), F.min(F.when(F.col("x.odd"), F.col("prefix"))).alias("example"))
    return lists.select("ts", F.lit("collector_fullfeed").alias("kind"), "n", "of", "example").unionByName(found).where("n > 0")


def active_at(points: DataFrame, periods: DataFrame, key: str = "asn", ts: str = "ts", most: int = MOST, grain: int = GRAIN) -> DataFrame:
    """`points` with `active`: some period (start, end, both ends closed) of the same key holds the instant.

    It does if, of the periods that began by then, the one that ends last has not ended. One union and one ordered window, whatever the number of periods; keys of more than `most` rows are cut into slices of time.
    """
    marks = periods.where("start <= end").select(key, F.col("start").alias(ts), F.col("end").alias("_end"), F.lit(0).alias("_side"))
    both = points.withColumn("_side", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    both = running(both, [key], ts, "_side", "_end", "_reach", "max", most, grain)
    return both.where("_side = 1").withColumn("active", F.coalesce(F.col("_reach") >= F.col(ts), F.lit(False))).select(*points.columns, "active")


def presence_agreement(visibility: DataFrame, periods: DataFrame, announced_min: float = 0.5) -> DataFrame:
    """(asn, n, n_agree): per AS, the instants at which it has rows, and those where being seen agrees with the periods."""
    seen = visibility.groupBy("asn", "ts").agg(F.max((F.col("visibility") >= announced_min).cast("int")).alias("seen"))
    out = active_at(seen, periods)
    return out.groupBy("asn").agg(F.count("*").alias("n"), F.count_if(F.col("active") == (F.col("seen") == 1)).alias("n_agree"))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, observed, expected, kappa): Cohen's kappa of two codings; 1 when expected agreement is 1. Rows with a null are an error."""
    blank = F.raise_error(F.lit("uncoded row")).cast("string")
    code = lambda c: F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), blank).otherwise(F.col(c).cast("string"))
    rows = df.select(code(a).alias("a"), code(b).alias("b"))
    cells = rows.groupBy("a", "b").agg(F.count("*").alias("k"))
    left, right = cells.groupBy(F.col("a").alias("c")).agg(F.sum("k").alias("ka")), cells.groupBy(F.col("b").alias("c")).agg(F.sum("k").alias("kb"))
    pe = left.join(right, "c", "left").agg(F.coalesce(F.sum(F.col("ka") * F.col("kb")), F.lit(0)).cast("double").alias("pairs"))
    po = cells.agg(F.sum("k").alias("n"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("k"))), F.lit(0)).alias("same"))
    out = po.withColumn("_one", F.lit(1)).join(pe.withColumn("_one", F.lit(1)), "_one")
    out = out.withColumn("observed", F.col("same") / F.col("n")).withColumn("expected", F.col("pairs") / (F.col("n").cast("double") * F.col("n")))
    return out.select("n", "observed", "expected", F.when(F.col("expected") == 1, 1.0).otherwise((F.col("observed") - F.col("expected")) / (1 - F.col("expected"))).alias("kappa"))


def require_unique(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """`df`, or an error (a job runs) when a key repeats."""
    twice = df.groupBy(*keys).count().where("count > 1").first()
    if twice is not None:
        raise ValueError(f"{what}: {twice.asDict()} repeats")
    return df


def coded_pairs(proposal: DataFrame, sample: DataFrame, key: str = "asn") -> DataFrame:
    """Sample rows with their proposals, one to one; a sample row without a proposal is an error."""
    require_unique(proposal, [key], "proposal"), require_unique(sample, [key], "sample")
    gap = sample.join(proposal, key, "left_anti").first()
    if gap is not None:
        raise ValueError(f"no proposal for {key} {gap[key]}")
    return sample.join(proposal, key)
