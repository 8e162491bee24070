"""Longest-prefix match and overlap checks, as equi-joins on ancestors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.net import masked, parse_prefix


def parsed(df: DataFrame, prefix: str = "prefix") -> DataFrame:
    """`df` with `_p`, the parsed prefix."""
    return df.withColumn("_p", parse_prefix(F.col(prefix)))


def ancestors(p: Column, lengths: list[tuple[int, int]], strict: bool = False) -> Column:
    """The prefixes of the given (family, length) pairs that contain `p`, itself included unless `strict`."""
    rows = []
    for family, k in lengths:
        hi, lo = masked(F.lit(family), p["hi"], p["lo"], F.lit(k))
        fits = (p["family"] == family) & ((p["plen"] > k) if strict else (p["plen"] >= k))
        rows.append(F.when(fits, F.struct(F.lit(family).alias("family"), hi.alias("hi"), lo.alias("lo"), F.lit(k).alias("plen"))))
    return F.array_compact(F.array(*rows)) if rows else F.array().cast("array<struct<family:int,hi:bigint,lo:bigint,plen:int>>")


def block_lengths(blocks: DataFrame) -> list[tuple[int, int]]:
    """The distinct (family, length) pairs of parsed blocks: at most 162 of them come to the driver."""
    return sorted((r[0], r[1]) for r in blocks.where("_p IS NOT NULL").select("_p.family", "_p.plen").distinct().collect())


def match_longest(observed: DataFrame, blocks: DataFrame, prefix: str = "prefix", block: str = "block", keep: tuple[str, ...] = (), parsed_as: str | None = None) -> DataFrame:
    """Left join of `observed` with the longest block that contains its prefix: adds `block`, the `keep` columns of the blocks and, under the name `parsed_as`, the parsed prefix of what matched.

    Each distinct prefix is parsed once, exploded to its ancestors of the lengths that blocks have, and joined by equality, so nothing is
    compared pairwise. A supernet of a block does not match it; malformed prefixes match nothing.
    """
    # parsing what the aggregate gives keeps the parser above it: a filter on it would otherwise be pushed to every row
    named = parsed(blocks.groupBy(F.col(block).alias("_b")).agg(F.min(F.struct(F.col(block), *keep)).alias("_v")), f"_v.{block}").where("_p IS NOT NULL")
    lengths = block_lengths(named)
    side = named.groupBy("_p").agg(F.min("_v").alias("_v"))
    pick = parsed(observed.select(prefix).distinct(), prefix)
    pick = pick.select(prefix, F.col("_p").alias("_own"), F.explode(ancestors(F.col("_p"), lengths)).alias("_p"))
    best = pick.join(side, "_p").groupBy(prefix).agg(F.max_by("_v", F.col("_p.plen")).alias("_v"), F.first("_own").alias("_own"))
    added = [F.col(f"_v.{c}").alias(c) for c in (block, *keep)] + ([F.col("_own").alias(parsed_as)] if parsed_as else [])
    kept = [c for c in observed.columns if c not in (block, *keep, parsed_as)]
    return observed.select(*kept).join(best, prefix, "left").select(*kept, *added)


def map_to_blocks(observed: DataFrame, blocks: DataFrame, prefix: str = "prefix", block: str = "block", parsed_as: str | None = None) -> DataFrame:
    """As `match_longest`, but a prefix in no block fails the job."""
    out = match_longest(observed, blocks, prefix, block, parsed_as=parsed_as)
    orphan = F.raise_error(F.concat(F.lit("prefix outside every block: "), F.col(prefix))).cast("string")
    return out.withColumn(block, F.when(F.col(block).isNull(), orphan).otherwise(F.col(block)))


def overlaps(blocks: DataFrame, prefix: str = "prefix", tag: str = "cc") -> DataFrame:
    """Pairs (prefix, tag, other, other_tag) where a block lies in, or equals, one of another tag. Empty means the tags don't overlap."""
    side = parsed(blocks.select(prefix, tag).distinct(), prefix)
    up = side.select(prefix, tag, F.explode(ancestors(F.col("_p"), block_lengths(side))).alias("_p"))
    other = side.select("_p", F.col(prefix).alias("other"), F.col(tag).alias("other_tag"))
    return up.join(other, "_p").where(F.col(tag) != F.col("other_tag")).select(prefix, tag, "other", "other_tag")


def require_disjoint(blocks: DataFrame, prefix: str = "prefix", tag: str = "cc") -> DataFrame:
    """`blocks`, after a check (a job runs) that no two tags overlap."""
    clash = overlaps(blocks, prefix, tag).first()
    if clash is not None:
        raise ValueError(f"populations overlap: {clash[0]} ({clash[1]}) and {clash[2]} ({clash[3]})")
    return blocks
