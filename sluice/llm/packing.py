"""Packing documents into sequences of a fixed length by sums of squares.

A document becomes token ids and an end id. One that is longer than a sequence is cut into pieces of full length, but for its first
piece. Full pieces are sequences of their own. Every other piece goes to the open sequence by which the sum of the squared counts of
open sequences per gap becomes smallest, and starts a new one only where it fits into none; of equal choices the smallest gap is taken.
Pieces come in order of falling length, so that the short ones, which fit anywhere, close what the long ones leave open.

The choice needs the counts per gap and nothing else, so packing costs a vector of `SIZE` numbers a piece. Pieces are dealt into groups of about
`GROUP` by their place in the table, whatever their ids or texts, and each group is packed by a task of its own: the number of groups
grows with the data, a group does not. A group leaves a few sequences open, which is all that grouping costs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocab
from .common import cut, whole_texts

VOCABULARY = "byte_bpe_50k.json"
SIZE, END = 1024, 2
#: Pieces a group.
GROUP = 1 << 14
#: Characters of the words a worker keeps.
KNOWN = 2_000_000
#: Characters whose words are looked up together.
RUN = 1 << 20


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit numbers."""

    def __init__(self, name: str, end: int) -> None:
        self.vocabulary, self.end = vocab.ByteLevel(name), end.to_bytes(4, "little")
        self.known = vocab.Memo(self.vocabulary.encode_words, KNOWN)

    def __call__(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text with the end id; texts are few enough for their words to be in memory."""
        split = [self.vocabulary.split(t) if t else [] for t in texts]
        self.known.need(set().union(*(words[1:] for words in split)))
        for words in split:
            first = self.vocabulary.encode(words[0]) if words else b""
            yield b"".join([first, *map(self.known.__getitem__, words[1:]), self.end])


_encoders: dict[tuple[str, int], Encoder] = {}


def cut_texts(batches: Iterator[pa.RecordBatch], name: str, size: int, end: int) -> Iterator[pa.RecordBatch]:
    """Batches of (doc_id, text) to (doc_id, piece, start, length, ids_crc32)."""
    encode = _encoders.get((name, end)) or _encoders.setdefault((name, end), Encoder(name, end))
    for batch in batches:
        of, piece, start, length, crc = [], [], [], [], []
        for row, ids in enumerate(chain.from_iterable(map(encode, vocab.runs(batch.column(1), RUN)))):
            ids = memoryview(ids)
            n = len(ids) // 4
            edges = [0, *range((n - 1) % size + 1, n + 1, size)]
            for k, (a, b) in enumerate(zip(edges, edges[1:])):
                of.append(row), piece.append(k), start.append(a), length.append(b - a), crc.append(zlib.crc32(ids[4 * a : 4 * b]))
        numbers = [pa.array(x, pa.int64()) for x in (start, length, crc)]
        columns = [batch.column(0).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), *numbers]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence (from 0) and the offset of each piece; lengths from 1 to `size`, in any order."""
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    count, members, opened = np.zeros(size, np.int64), [[] for _ in range(size)], 0
    for i in np.argsort(-lengths, kind="stable"):
        need = int(lengths[i])
        there = count[need:]  # sequences with a gap of need, need + 1, ...
        if need < size and there.any():
            after = 2 * (count[: size - need] - there) + 2  # change of the sum if one of them shrinks to a gap of 0, 1, ...
            after[0] = 1 - 2 * there[0]  # a sequence without a gap is open no more
            gap = need + int(np.where(there > 0, after, np.iinfo(np.int64).max).argmin())
            count[gap] -= 1
            which = members[gap].pop()
        else:
            gap, which, opened = size, opened, opened + 1
        sequence[i], offset[i] = which, size - gap
        if gap > need:
            count[gap - need] += 1
            members[gap - need].append(which)
    return sequence, offset


def _pack_group(group: pa.Table, size: int) -> pa.Table:
    sequence, offset = sum_of_squares(group.column("length").to_numpy(), size)
    high = group.column("_group").to_numpy() << 32
    group = group.drop_columns(["_group"])
    return group.append_column("sequence_id", pa.array(high + sequence)).append_column("offset", pa.array(offset))


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, size: int = SIZE, end: int = END, group: int = GROUP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece of each document. Runs jobs.

    A null or empty text has the end id alone. Null and repeated ids, and equal texts, are documents like any other. Other columns of
    `docs` are not read. An empty table gives no rows. Sequence ids are unique and have gaps.
    """
    whole_texts(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    pieces = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    read = docs.select("doc_id", "text").mapInArrow(partial(cut_texts, name=vocabulary, size=size, end=end), pieces)
    rows = cut(read)
    place = F.monotonically_increasing_id()
    groups = max(1, -(-rows.where(F.col("length") < size).count() // group))
    full = rows.where(F.col("length") == size).withColumn("sequence_id", F.bitwise_not(place)).withColumn("offset", F.lit(0).cast("long"))
    rest = rows.withColumn("_group", F.pmod(F.xxhash64(place), F.lit(groups))).where(F.col("length") < size)

    def of_group(group: pa.Table) -> pa.Table:
        return _pack_group(group, size)

    packed = rest.groupBy("_group").applyInArrow(of_group, f"{pieces}, sequence_id long, offset long")
    return full.unionByName(packed)
