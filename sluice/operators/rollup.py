"""Roll-up of nested prefixes to the address space of their blocks.

Each address counts once, at its most specific announcement. With v_p the visibility of prefix p and parent(p) its
nearest announced ancestor in the same (ts, block), the block's weighted visibility is

    sum over p of 2**(plen(block) - plen(p)) * (v_p - v_parent(p)),   v_parent = 0 for roots

since every nested prefix takes its area from its parent. Ratios are powers of two, so any address width is exact.

Parents are found by a sweep: rows are dealt by (ts, block) and put in order of address and falling size within their partition, so a prefix comes
right after what it lies in. One pass keeps the prefixes that are open at an address on a stack (never more than there are lengths) and adds up each
(ts, block) as it goes: one shuffle, and a row's cost does not depend on the width of addresses.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions.net import parse_prefix

from .lpm import map_to_blocks

_WORD = (1 << 64) - 1


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (ts, block, top, family, hi, lo, plen, visibility), ordered by ts, block, address and plen, to a row for each (ts, block)."""
    group, open_, out = None, [], []
    n, total, most, family, last = 0, 0.0, None, None, None
    for batch in batches:
        columns = batch.columns
        for ts, block, top, kind, hi, lo, plen, v in zip(*(c.to_pylist() for c in columns)):
            if (ts, block) != group:
                if group is not None:
                    out.append((*group, family, most, n, total))
                group, family, n, total, most, last = (ts, block), kind, 0, 0.0, None, None
                open_.clear()
            n += 1
            if v is None:
                continue
            start = (hi & _WORD) << 64 | lo & _WORD
            if last is not None and last[:2] == (start, plen):  # the prefix repeats: the highest counts
                if v > last[2]:
                    total += 2.0 ** (top - plen) * (v - last[2])
                    last = start, plen, v
                    open_[-1] = (open_[-1][0], v)
                    most = max(most, v)
                continue
            while open_ and open_[-1][0] < start:
                open_.pop()
            total += 2.0 ** (top - plen) * (v - (open_[-1][1] if open_ else 0.0))
            open_.append((start | (1 << ((32 if kind == 4 else 128) - plen)) - 1, v))
            last, most = (start, plen, v), v if most is None else max(most, v)
        if len(out) >= 10_000:
            yield _rows(out, columns)
            out = []
    if group is not None:
        out.append((*group, family, most, n, total))
    if out:
        yield _rows(out, columns)


def _rows(out: list[tuple], like: list[pa.Array]) -> pa.RecordBatch:
    kinds = [like[0].type, like[1].type, pa.int32(), pa.float64(), pa.int64(), pa.float64()]
    names = ["ts", "block", "family", "visibility_max", "n_observed", "visibility_weighted"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)


def rollup_visibility(visibility: DataFrame, blocks: DataFrame, prefix: str = "prefix", block: str = "block") -> DataFrame:
    """(ts, block, family, visibility_max, n_observed, visibility_weighted). A block without prefixes at a ts has no row; a prefix in no block fails the job.

    A prefix that repeats at a ts counts once, at its highest visibility, in the weighted sum; n_observed counts its rows. A block has addresses of one family. Rows without a
    visibility are counted and otherwise left out.
    """
    p = F.col("_p")
    mapped = map_to_blocks(visibility.withColumn("visibility", F.col("visibility").cast("double")), blocks, prefix, block, "_p")
    rows = mapped.select("ts", F.col(block).alias("block"), parse_prefix(F.col(block))["plen"].alias("top"), p["family"].alias("family"), p["hi"].alias("hi"), p["lo"].alias("lo"), p["plen"].alias("plen"), "visibility")
    unsigned = [F.col(c).bitwiseXOR(F.lit(-(1 << 63))) for c in ("hi", "lo")]
    swept = rows.repartition("ts", "block").sortWithinPartitions("ts", "block", *unsigned, "plen")
    kind = {c: t for c, t in rows.dtypes}
    out = swept.mapInArrow(_sweep, f"ts {kind['ts']}, block {kind['block']}, family int, visibility_max double, n_observed long, visibility_weighted double")
    return out.withColumnRenamed("block", block)
