"""A series that is checked while it is written.

The rows are dealt into ranges of snapshots and ordered, as the file is to have them; what is wrong with a row then shows beside the row before it, and is counted by observed metrics of
the same job that writes. The table is renamed to its place only if nothing was counted; otherwise nothing is left, and the error says what was found.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from sluice.sources.sinks import move, remove

AUDIT = "map<string,struct<ipv4:int,ipv6:int>>"


class GateError(ValueError):
    """What was found, by name, with how often."""

    def __init__(self, found: dict[str, int]) -> None:
        self.found = found
        super().__init__(", ".join(f"{name}: {n}" for name, n in found.items()))


def checked(snapshots: DataFrame, collectors: list[str], default_cc: str = "IR") -> tuple[DataFrame, Observation]:
    """The consolidated series, ordered by (ts, family, prefix) in files of whole snapshots, and what is observed as it is written.

    Counted are rows (`rows`), snapshots (`snapshots`), prefixes that repeat in a snapshot and family, changes of peers_total within a family, changes of the audit within a snapshot, families whose total is not
    the audit's sum, and for each of `collectors` the snapshots in which it has no full-feed peer. A null `cc` is `default_cc`. ff_v4 and ff_v6 are the families' totals, 0 where a family is absent.
    """
    cc = F.coalesce("cc", F.lit(default_cc)) if "cc" in snapshots.columns else F.lit(default_cc)
    whole = Window.partitionBy("ts").orderBy("family", "prefix")
    every = Window.partitionBy("ts")
    before = lambda c: F.lag(c).over(whole)
    rows = snapshots.withColumn("cc", cc).repartitionByRange("ts").withColumns({f"ff_v{f}": F.coalesce(F.max(F.when(F.col("family") == f, F.col("peers_total"))).over(every), F.lit(0)) for f in (4, 6)})
    rows = rows.withColumns({"_family": before("family"), "_prefix": before("prefix"), "_total": before("peers_total"), "_audit": before("collector_fullfeed")})
    first = F.col("_family").isNull()  # of a snapshot
    opens = first | (F.col("_family") != F.col("family"))  # of a family
    rows = rows.withColumn("_told", F.when(opens, F.from_json("collector_fullfeed", AUDIT)))
    of = lambda c: F.coalesce(F.col("_told")[c]["ipv4"], F.lit(0)) + F.coalesce(F.col("_told")[c]["ipv6"], F.lit(0))
    told = lambda f: F.aggregate(F.map_values("_told"), F.lit(0), lambda acc, x: acc + F.coalesce(x[f"ipv{f}"], F.lit(0)))
    same = ~opens
    seen = Observation()
    gates = {
        "snapshots": first,
        "repeated prefixes": same & (F.col("_prefix") == F.col("prefix")),
        "uneven totals": same & ~F.col("_total").eqNullSafe(F.col("peers_total")),
        "several audits": ~first & ~F.col("_audit").eqNullSafe(F.col("collector_fullfeed")),
        "totals that are not the audit's sum": opens & ~F.when(F.col("family") == 4, told(4)).otherwise(told(6)).eqNullSafe(F.col("peers_total").cast("int")),
    } | {f"no full-feed peer of {c}": first & (of(c) < 1) for c in collectors}
    flags = {f"_gate{k}": F.coalesce(flag, F.lit(False)).cast("int") for k, flag in enumerate(gates.values())}
    rows = rows.withColumns(flags)
    out = rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in zip(flags, gates)])
    kept = [c for c in snapshots.columns if c not in ("cc", "ff_v4", "ff_v6")]
    return out.select(*kept, "cc", "ff_v4", "ff_v6"), seen


def write_consolidated(snapshots: DataFrame, path: str, collectors: list[str], default_cc: str = "IR") -> dict[str, int]:
    """Check and write `snapshots` in one pass (besides the sample of ts by which ranges are chosen); {"rows": ..., "snapshots": ...} if all gates hold, else GateError and `path` as it was."""
    spark, beside = snapshots.sparkSession, f"{path}.gate-{uuid.uuid4().hex}"
    out, seen = checked(snapshots, collectors, default_cc)
    try:
        out.write.parquet(beside)
        counts = seen.get
        if found := {k: n for k, n in counts.items() if n and k not in ("rows", "snapshots")}:
            raise GateError(found)
        move(spark, beside, path)
    finally:
        remove(spark, beside)
    return {k: counts[k] for k in ("rows", "snapshots")}
