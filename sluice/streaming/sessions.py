"""Sessions with state that is ordered, bounded and forgotten: withdrawals attributed on a stream whose rows come out of order.

A session (peer address, peer AS, prefix) keeps the rows that wait for the watermark in a list, and the origin it announced last as a value. An
event-time timer wakes it when the watermark has passed its first waiting row: all rows before the watermark are then put in order of (time, seq) and
attributed as the batch operator does it. A session that has been idle for `idle` seconds of event time is forgotten by another timer, so state holds what is active
and not all that ever was. Rows behind the watermark are not lost without a word: they come out with status `late`.

Spark drops late rows before a processor can see them. So its own watermark is kept `GRACE` behind the one that counts here: what arrives between the two
is late, and only rows that are later than that by all of `GRACE` are dropped by Spark, which counts them in its progress.

Rows travel and wait in packs: a task puts the rows of one session and type into one row with a binary column, up to `PACK` rows at once. Spark hands a processor its input row by
row, and the state store takes it value by value; so both have as many steps as there are packs. A pack is as late as its latest row: rows beside a newer one of their session come out as late, however old they are.

The state store must be RocksDB: `spark.sql.streaming.stateStore.providerClass` (`use_state_store` sets it).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sluice.functions.lists import path_origin

SESSION = ["peer_address", "peer_asn", "prefix"]
OUT = "peer_address string, peer_asn long, prefix string, time long, seq long, type string, asn long, status string"
COLUMNS = [c.split()[0] for c in OUT.split(", ")]
#: Days between the watermark that counts and Spark's.
GRACE = 400
ATTRIBUTED, LATE = "attributed", "late"
#: The numbers of a row that are packed, and about how many rows are packed together, kept as one value or given out at once.
PACKED = ["time", "seq", "origin"]
PACK = 200_000


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _given(key: tuple, rows: np.ndarray, kind: str | None | np.ndarray, asn: np.ndarray | None, status: str) -> pd.DataFrame:
    """Rows in the form of `OUT`."""
    values = (*key, rows[0], rows[1], kind, asn, status)
    return pd.DataFrame(dict(zip(COLUMNS, values, strict=True)), index=range(rows.shape[1]))


def packed(rows: DataFrame) -> DataFrame:
    """Rows (session, type, and the numbers of `PACKED`) with one row for each session and type of at most `PACK` rows that a task reads: its `latest` time, and `rows`, the numbers one after the other."""
    keys = [*SESSION, "type"]

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        lists = pa.Table.from_batches(held).group_by(keys, use_threads=False).aggregate([*[(c, "list") for c in PACKED], ("time", "max")]).combine_chunks()
        numbers = []
        for c in PACKED:
            ends = pc.list_value_length(lists[f"{c}_list"]).to_numpy().cumsum()
            flat = pc.list_flatten(lists[f"{c}_list"])
            if flat.null_count:
                raise ValueError(f"{c} is null")
            numbers.append(flat.to_numpy())
        parts = [p.tobytes() for p in np.split(np.stack(numbers), ends[:-1], axis=1)]
        return pa.Table.from_arrays([*[lists[k] for k in keys], lists["time_max"], pa.array(parts, pa.binary())], [*keys, "latest", "rows"]).to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= PACK:
                yield pack(held)
                held, n = [], 0
        if held:
            yield pack(held)

    return rows.select(*keys, *PACKED).mapInArrow(run, "peer_address string, peer_asn long, prefix string, type string, latest long, rows binary")


class Attribution(StatefulProcessor):
    """Input: packs of one type (A or W, others only wake the session); see `packed`."""

    def __init__(self, idle: int) -> None:
        self.idle, self.behind = idle * 1000, GRACE * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.last = handle.getValueState("last", "asn long, time long")

    def _passed(self, timers) -> int | None:
        """Milliseconds; rows before it are complete. None before Spark has seen any row."""
        at = timers.getCurrentWatermarkInMs()
        return at + self.behind if at > 0 else None

    def _wake(self, at: int) -> None:
        """When the watermark has passed this millisecond."""
        self.handle.registerTimer(at + 1 - self.behind)

    def _keep(self, some: list[np.ndarray]) -> None:
        self.waiting.appendValue((np.concatenate(some, axis=1).tobytes(),))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed, kept, held, first = self._passed(timerValues), [], 0, None
        for some in rows:
            for kind, pack in zip(some["type"], some["rows"], strict=True):
                part = np.frombuffer(pack, np.int64).reshape(len(PACKED), -1)
                if passed is not None and (behind := part[0] * 1000 < passed).any():
                    yield _given(key, part[:, behind], kind, None, LATE)
                    part = part[:, ~behind]
                if kind in ("A", "W") and part.shape[1]:
                    kept.append(np.vstack([part, np.full(part.shape[1], kind == "W")]))
                    first = min(int(part[0].min()), first) if first is not None else int(part[0].min())
                    held += part.shape[1]
                if held >= PACK:
                    self._keep(kept)
                    kept, held = [], 0
        if kept:
            self._keep(kept)
        if first is not None:
            self._wake(1000 * first)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = self._passed(timerValues)
        waiting = [np.frombuffer(w[0], np.int64).reshape(len(PACKED) + 1, -1) for w in self.waiting.get()]
        waiting = np.concatenate(waiting, axis=1) if waiting else np.zeros((len(PACKED) + 1, 0), np.int64)
        time, seq, origin, gone = waiting
        waiting = waiting[:, np.lexsort((origin, gone, seq, time))]
        n = int((waiting[0] * 1000 < passed).sum())
        ready, left = waiting[:, :n], waiting[:, n:]
        asn, at = self.last.get() or (-1, None)
        if n:
            time, seq, origin, gone = ready
            told = np.maximum.accumulate(np.where(gone == 0, np.arange(n), -1))  # the last announcement
            asns = np.where(told < 0, asn, origin[told])
            asn, at = int(asns[-1]), int(time[-1])
            self.last.update((asn, at))
            self._keep_only(left)
        if left.shape[1]:
            self._wake(1000 * int(left[0, 0]))
        elif at is not None and at * 1000 + self.idle < passed:
            self.last.clear()
        elif at is not None:
            self._wake(at * 1000 + self.idle)
        for k in range(0, n, PACK):
            yield _given(key, ready[:, k : k + PACK], np.where(gone[k : k + PACK] == 0, "A", "W"), asns[k : k + PACK], ATTRIBUTED)

    def _keep_only(self, left: np.ndarray) -> None:
        if left.shape[1]:
            self.waiting.put([(left[:, k : k + PACK].tobytes(),) for k in range(0, left.shape[1], PACK)])
        else:
            self.waiting.clear()

    def close(self) -> None:
        pass


def attributed(elems: DataFrame, late: int = 0, idle: int = 7 * 86_400) -> DataFrame:
    """A stream of elements with `asn` and `status`, each announcement or withdrawal once the watermark (the latest time less `late` seconds) has passed it.

    `attributed` rows equal the batch operator's whatever the order of arrival, as long as no session pauses for more than `idle` seconds: its withdrawals are unknown (-1) after that. Rows that arrive behind the watermark are `late`, with a
    null asn. Rows of other types are not given out, but move the watermark: a last one, later than all, brings out what waits.
    """
    numbers = F.col("time").cast("long").alias("time"), F.col("seq").cast("long").alias("seq"), F.coalesce(path_origin(F.col("as_path")), F.lit(-1)).cast("long").alias("origin")
    rows = packed(elems.select(*SESSION, "type", *numbers)).withColumn("at", F.timestamp_seconds("latest"))
    rows = rows.withWatermark("at", f"{GRACE * 86_400 + late} seconds")
    return rows.groupBy(*SESSION).transformWithStateInPandas(Attribution(idle), OUT, "Append", "EventTime")
