"""Delegation registries, organisations, and the hand-kept classification."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def org_blocks(delegations: DataFrame, frozen: DataFrame, form: Callable[[Column], Column] = lambda asns: asns) -> DataFrame:
    """(prefix, family, cc, org, org_asns): blocks of the organisations that hold at least one of the frozen ASes, with the frozen ASes each holds, sorted.

    `form` says what a list of ASes is given out as. It is worked out once for each organisation, before its blocks take it, so that no work on a list is repeated for every block.
    """
    asns = delegations.where("type = 'asn'").join(frozen.select("asn").distinct(), "asn", "left_semi")
    held = asns.groupBy("org").agg(F.array_sort(F.collect_set("asn")).alias("org_asns")).select("org", form(F.col("org_asns")).alias("org_asns"))
    return delegations.where("type IN ('ipv4', 'ipv6')").join(held, "org").select("prefix", "family", "cc", "org", "org_asns")


def rank_by_space(asns: DataFrame, space: DataFrame) -> DataFrame:
    """(cc, asn, org, space, rank): ASes by the address space of their organisation, larger first; of one size, organisations in the order of their first AS (`seq`), then ASes. No space is 0."""
    totals = space.groupBy("org").agg(F.sum("size").alias("space"))
    rows = asns.join(totals, "org", "left").withColumn("space", F.coalesce("space", F.lit(0)))
    rows = rows.withColumn("_first", F.min("seq").over(Window.partitionBy("cc", "org")))
    order = Window.partitionBy("cc").orderBy(F.desc("space"), "_first", "asn")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).drop("_first")


def top_adequate(ranked: DataFrame, candidates: int = 40, most: int = 10) -> DataFrame:
    """Per country the first `most` adequate of the first `candidates` by rank."""
    good = ranked.where((F.col("rank") <= candidates) & F.col("adequate"))
    return good.withColumn("place", F.row_number().over(Window.partitionBy("cc").orderBy("rank")).cast("long")).where(F.col("place") <= most)


def merge_classification(old: DataFrame, new: DataFrame) -> DataFrame:
    """(asn, org_name, type, notes) by asn: kept rows win and are never overwritten, except that a blank org_name is filled in; new ASes are added, departed ones stay."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    out = old.withColumn("_old", F.lit(1)).alias("o").join(new.alias("n"), "asn", "full")
    kept = lambda c: F.when(F.col("_old") == 1, F.col(f"o.{c}")).otherwise(F.lit(""))
    name = F.coalesce(blank(F.col("o.org_name")), F.col("n.org_name"), F.col("o.org_name"), F.lit(""))
    return out.select("asn", name.alias("org_name"), kept("type").alias("type"), kept("notes").alias("notes")).orderBy("asn")
