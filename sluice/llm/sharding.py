"""Sharding by sampled splitters.

A size-weighted sample of the record keys gives quantile boundaries; records fall into the ranges between them; ranges that
turn out overfull are subdivided by a second key; consecutive ranges then make up the shards. The key is a hash of the text, so equal texts lie side by
side, and a group too large for its range is cut by a hash of its ids and places (so even rows that repeat are dealt out).

What the driver holds is bounded by parameters: the sample (about SAMPLE keys) and the cells (at most about three
times shards * RANGES). Everything else, sizes of the cells included, is counted over all rows by Spark.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hide, shown

SHARDS = 24
#: Ranges per shard: shard sizes differ by about one range, a 1/RANGES of a shard.
RANGES = 128
#: Keys drawn for the splitters.
SAMPLE = 40_000
ADDED = ("size", "text_crc32", "shard", "slot")


def shard(docs: DataFrame, id: str = "doc_id", text: str = "text", shards: int = SHARDS, ranges: int = RANGES, sample: int = SAMPLE) -> DataFrame:
    """All rows of `docs` with `size`, `text_crc32`, `shard` (0 to shards - 1) and `slot` (gapless from 0 within the shard).

    size is the UTF-8 bytes of the text plus 8 (null text: 8, crc 0). The law kept is `bytes`: sizes of shards near
    equal. Repeated rows may get each other's slots. `docs` must be the same when it is read again, as a scan of files is. With fewer records than shards some shards stay empty. A
    column of `docs` with the name of a result column is replaced.
    """
    docs, names = hide(docs)
    id, text = names[id], names[text]
    blob = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    keyed = docs.select(
        *names.values(),
        (F.octet_length(blob) + 8).cast("long").alias("size"),
        F.crc32(blob).alias("text_crc32"),
        F.xxhash64(F.col(text)).alias("_k"),
        F.xxhash64(F.lit(5), F.col(id), F.monotonically_increasing_id()).alias("_t"),
    )
    narrow = cut(keyed.select("size", "_k", "_t"))
    total = narrow.agg(F.sum("size")).first()[0] or 0
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(11), "_k", "_t"), 11) / F.lit(float(1 << 53))
    drawn = narrow.where(draw < F.lit(float(sample)) * F.col("size") / F.lit(float(max(total, 1)))).select("_k")
    keys = np.sort(np.array([r[0] for r in drawn.collect()], dtype=np.int64))
    n = shards * ranges
    at = np.unique(keys[(np.arange(1, n) * len(keys)) // n]) if len(keys) else np.zeros(0, np.int64)

    @F.pandas_udf("int")
    def place(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(at, k.to_numpy(np.int64), side="right").astype(np.int32))

    full = total / n if total else 1.0
    sizes = {r["_r"]: r["s"] for r in narrow.groupBy(place("_k").alias("_r")).agg(F.sum("size").alias("s")).collect()}
    parts = np.ones(len(at) + 1, np.int64)
    for r, s in sizes.items():
        parts[r] = max(1, round(s / full))
    first = np.concatenate([[0], np.cumsum(parts)])

    @F.pandas_udf("int")
    def cell(k: pd.Series, t: pd.Series) -> pd.Series:
        r = np.searchsorted(at, k.to_numpy(np.int64), side="right")
        part = ((t.to_numpy(np.int64).view(np.uint64) >> np.uint64(32)).astype(np.int64) * parts[r]) >> 32
        return pd.Series((first[r] + part).astype(np.int32))

    cells = narrow.groupBy(cell("_k", "_t").alias("_c")).agg(F.sum("size").alias("s"), F.count("*").alias("n")).orderBy("_c").collect()
    at_shard, at_slot = np.zeros(int(first[-1]) + 1, np.int32), np.zeros(int(first[-1]) + 1, np.int64)
    run, slots = 0, [0] * shards
    for c in cells:
        k = min(shards - 1, int((run + c["s"] / 2) * shards / total))
        at_shard[c["_c"]], at_slot[c["_c"]] = k, slots[k]
        slots[k] += c["n"]
        run += c["s"]

    @F.pandas_udf("shard int, base long")
    def home(c: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"shard": at_shard[c.to_numpy()], "base": at_slot[c.to_numpy()]})

    within = Window.partitionBy("_c").orderBy("_k", "_t", id)
    out = keyed.withColumn("_c", cell("_k", "_t")).withColumn("_n", F.row_number().over(within) - 1).withColumn("_h", home("_c"))
    return out.select(*shown(names, *ADDED), "size", "text_crc32", F.col("_h.shard").alias("shard"), (F.col("_h.base") + F.col("_n")).cast("long").alias("slot"))
