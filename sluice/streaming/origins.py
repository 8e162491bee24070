"""Update streams with state: the origin a withdrawal belongs to, and flaps as events arrive.

State is kept per session (peer address, peer AS, prefix). Within a micro-batch rows are put in order of (time, seq); across
batches the source must deliver each collector's files in order, as `sources.mrt.read_stream` does.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sluice.functions.lists import path_origin

SESSION = ("peer_address", "peer_asn", "prefix")
_OUT = "peer_address string, peer_asn long, prefix string, time long, seq long, type string, asn long"
_FLAPS = "peer_address string, peer_asn long, prefix string, time long, seq long, is_flap boolean"


def attribute_stream(elems: DataFrame) -> DataFrame:
    """Elements with `asn`: an announcement's own origin, a withdrawal's from the last announcement; -1 if unknown. Equals the batch operator on the same input."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else -1
        rows = pd.concat(list(batches)).sort_values(["time", "seq"], kind="stable")
        out = []
        for t, seq, kind, origin in zip(rows["time"], rows["seq"], rows["type"], rows["origin"], strict=True):
            if kind == "A":
                last = int(origin)
            out.append((*key, t, seq, kind, last))
        state.update((last,))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])

    rows = elems.where("type IN ('A', 'W')").select(*SESSION, "time", "seq", "type", F.coalesce(path_origin(F.col("as_path")), F.lit(-1)).alias("origin"))
    return rows.groupBy(*SESSION).applyInPandasWithState(step, _OUT, "asn long", "append", GroupStateTimeout.NoTimeout)


def flap_stream(events: DataFrame, threshold: int, late: str = "10 minutes") -> DataFrame:
    """Withdrawals, each once it is decided: a flap when the session's next element announces within `threshold` seconds; not one when the watermark has passed that time, or another withdrawal comes first."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_ = state.get if state.exists else None
        out = []
        if state.hasTimedOut:
            out.append((*key, *open_, False))
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values(["time", "seq"], kind="stable")
            for t, seq, kind in zip(rows["time"], rows["seq"], rows["type"], strict=True):
                if open_ is not None:
                    out.append((*key, *open_, bool(kind == "A" and t - open_[0] <= threshold)))
                    open_ = None
                if kind == "W":
                    open_ = (int(t), int(seq))
            if open_ is None:
                if state.exists:
                    state.remove()
            else:
                state.update(open_)
                state.setTimeoutTimestamp(max((open_[0] + threshold + 1) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _FLAPS.split(", ")])

    rows = events.withColumn("at", F.timestamp_seconds("time")).withWatermark("at", late).select(*SESSION, "time", "seq", "type", "at")
    return rows.groupBy(*SESSION).applyInPandasWithState(step, _FLAPS, "time long, seq long", "append", GroupStateTimeout.EventTimeTimeout)


def snapshot_counts(elems: DataFrame, step: str = "8 hours", late: str = "1 hour") -> DataFrame:
    """Elements per grid window, collector and type, as a stream: each window once, when the watermark has passed it."""
    rows = elems.withColumn("at", F.timestamp_seconds("time")).withWatermark("at", late)
    counts = rows.groupBy(F.window("at", step), "collector", "type").agg(F.count("*").alias("n"))
    return counts.select(F.unix_seconds("window.start").alias("ts"), "collector", "type", "n")
