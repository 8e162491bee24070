"""Archives of routing dumps and updates as a data source: `format("mrt")` for batch reads, streams and writes.

    register(spark)
    spark.read.format("mrt").option("start", t0).option("end", t1).load("/archive/rrc00/*,/archive/rrc01/*")

A read plans its files from their names: those whose grid slot lies outside the times asked for are never opened, runs of small files share a task, and a
large file is inflated and decoded record by record, so a task needs memory for a batch of rows and not for a dump. Several paths are one ordered chain: `source` is
a path's place in it. What cannot be decoded fails the job, or, with `onCorrupt` = `mark`, ends its file with a row that says so; `first_sound` builds on that to
take each slot from the first source that has it whole. A stream takes files in the order of their slots, and its offsets are names of files.

Files are opened by pyarrow's file systems (local paths, hdfs, s3, gs), on the executors. What only Spark can open is read by `sources.mrt`.
"""

from __future__ import annotations

import fnmatch
import gzip
import io
import ipaddress
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

from sluice.sources import mrt

SCHEMA = "source int, path string, collector string, slot long, status string, " + mrt.ELEMS
VALID, COMPLETE, BAD_SOURCE, BAD_RECORD = "valid", "complete", "corrupted-source", "corrupted-record"
ARROW = pa.schema([("source", pa.int32()), ("path", pa.string()), ("collector", pa.string()), ("slot", pa.int64()), ("status", pa.string()), ("seq", pa.int64()), ("time", pa.int64()), ("type", pa.string()), ("peer_asn", pa.int64()), ("peer_address", pa.string()), ("prefix", pa.string()), ("as_path", pa.string())])
ROWS = 20_000
#: Files of fewer bytes share a task even where tasks are few.
SMALL = 64 << 10
FAULTS = (mrt.CorruptRecord, struct.error, EOFError, OSError)


@dataclass(frozen=True)
class File:
    source: int
    path: str
    size: int

    @property
    def collector(self) -> str:
        """The name of the file's folder."""
        return self.path.rsplit("/", 2)[-2] if "/" in self.path else ""

    @property
    def slot(self) -> int | None:
        return slot_of(self.path)

    @property
    def key(self) -> str:
        """Files in the order of their slots, then of their paths; those without a slot come first."""
        return f"{self.slot or 0:012d} {self.source:04d} {self.path}"


def slot_of(path: str) -> int | None:
    """The time in a file's name (`updates.20240131.0455.gz`), if there is one."""
    found = re.search(r"\.(\d{8})\.(\d{4})\b[^/]*$", path)
    return int(datetime.strptime("".join(found.groups()), "%Y%m%d%H%M").replace(tzinfo=UTC).timestamp()) if found else None


def window_of(path: str) -> str:
    """The name a window file stands for: its file name without folders and endings."""
    return path.rsplit("/", 1)[-1].split(".", 1)[0]


def located(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"\w+:/", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def listed(paths: str) -> list[File]:
    """The files at each of the comma-separated paths (files, folders or patterns), in the order of their keys. A path without any file is an error."""
    out = []
    for source, path in enumerate(paths.split(",")):
        store, inner = located(path.strip())
        fixed = inner if not re.search(r"[*?\[]", inner) else re.split(r"[^/]*[*?\[]", inner, maxsplit=1)[0]
        info = store.get_file_info(fixed)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(fixed, recursive=True, allow_not_found=True))
        found = [i for i in found if i.type == fs.FileType.File and not re.search(r"/[._][^/]*", i.path[len(fixed.rstrip("/")) :])]
        if fixed != inner:
            found = [i for i in found if fnmatch.fnmatch(i.path, inner) and i.path.count("/") == inner.count("/")]
        if not found:
            raise FileNotFoundError(path)
        prefix = path.strip()[: len(path.strip()) - len(inner)]
        out += [File(source, prefix + i.path, i.size) for i in found]
    return sorted(out, key=lambda f: f.key)


@dataclass
class Run(InputPartition):
    """Files that one task reads one after the other."""

    files: list[File]


class _Options:
    def __init__(self, options: dict) -> None:
        self.path, self.collector = options["path"], options.get("collector")
        self.start, self.end = (int(options[k]) if k in options else None for k in ("start", "end"))
        #: how long after its slot a file's records may be
        self.span = int(options.get("span", 900))
        self.mark = {"fail": False, "mark": True}[options.get("onCorrupt", "fail")]
        self.bytes = int(options.get("partitionBytes", 4 << 20))
        #: about as many tasks there are at least, if files are not SMALL: compressed bytes say little about a task's work, as a megabyte may be a million elements
        self.tasks = int(options.get("minPartitions", 64))
        self.batch = int(options.get("filesPerBatch", 64))
        self.keep = str(options.get("keepFiles", "true")).lower() == "true"

    def wanted(self, files: list[File]) -> list[File]:
        """Without those whose slot is wholly outside the times asked for."""
        early = lambda f: self.start is not None and f.slot is not None and f.slot + self.span <= self.start
        late = lambda f: self.end is not None and f.slot is not None and f.slot >= self.end
        return [f for f in files if not early(f) and not late(f)]

    def runs(self, files: list[File]) -> list[Run]:
        """Neighbours of one source and collector together, up to `partitionBytes` or a share of `minPartitions`; a larger file is alone."""
        out, most = [], min(self.bytes, max(SMALL, sum(f.size for f in files) // self.tasks))
        for _, some in groupby(sorted(files, key=lambda f: (f.source, f.collector, f.key)), key=lambda f: (f.source, f.collector)):
            size = 0
            for f in some:
                if not size or size + f.size > most:
                    out.append(Run([]))
                    size = 0
                out[-1].files.append(f)
                size += f.size
        return out

    def read(self, run: Run) -> Iterator[pa.RecordBatch]:
        for f in run.files:
            yield from self._file(f)

    def _file(self, f: File) -> Iterator[pa.RecordBatch]:
        name, status, last, rows = self.collector or f.collector, COMPLETE, None, []

        def batch(status: str, rows: list[tuple]) -> pa.RecordBatch:
            head = [pa.repeat(pa.scalar(x, t), len(rows)) for x, t in zip((f.source, f.path, name, f.slot, status), ARROW.types)]
            return pa.RecordBatch.from_arrays(head + [pa.array(c, t) for c, t in zip(zip(*rows), ARROW.types[5:])], schema=ARROW)

        try:
            store, inner = located(f.path)
            with store.open_input_file(inner) as file, mrt.inflated(file) as content:
                for k, e in enumerate(mrt.elements(mrt.records(content))):
                    last = e[0]
                    if (self.start is None or last >= self.start) and (self.end is None or last < self.end):
                        rows.append((k, *e))
                    if len(rows) == ROWS:
                        yield batch(VALID, rows)
                        rows = []
        except FAULTS as fault:
            if not self.mark:
                raise mrt.CorruptRecord(f"{f.path}: {fault}") from fault
            status = BAD_SOURCE if last is None else BAD_RECORD
        if rows:
            yield batch(VALID, rows)
        if self.mark:
            yield batch(status, [(None, last, None, None, None, None, None)])


class _Reader(DataSourceReader):
    def __init__(self, options: _Options) -> None:
        self.options = options

    def partitions(self) -> list[Run]:
        return self.options.runs(self.options.wanted(listed(self.options.path))) or [Run([])]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        return self.options.read(partition)


class _StreamReader(DataSourceStreamReader):
    """Offsets are {"after": key of the last file taken, "n": files up to it}: a file that appears behind the offset would never be read, so it is an error."""

    def __init__(self, options: _Options) -> None:
        self.options, self.at = options, None

    def initialOffset(self) -> dict:
        self.at = {"after": "", "n": 0}
        return self.at

    def _files(self) -> list[File]:
        try:
            return self.options.wanted(listed(self.options.path))
        except FileNotFoundError:  # nothing has arrived, or all is done and deleted
            return []

    def latestOffset(self) -> dict:
        """At most `filesPerBatch` files after the last batch. Spark asks before it says where a query starts, so the first batch of a run takes all there are."""
        at, files = self.at or {"after": "", "n": 0}, self._files()
        if self.at is not None:
            behind = sum(f.key <= at["after"] for f in files)
            if behind > at["n"]:
                raise ValueError(f"{behind - at['n']} files arrived behind {at['after']!r}")
            files = files[behind : behind + self.options.batch]
        return {"after": files[-1].key, "n": at["n"] + len(files)} if files else at

    def partitions(self, start: dict, end: dict) -> list[Run]:
        self.at = end
        return self.options.runs([f for f in self._files() if start["after"] < f.key <= end["after"]]) or [Run([])]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        return self.options.read(partition)

    def commit(self, end: dict) -> None:
        """With `keepFiles` = `false`, what has been processed is deleted."""
        if not self.options.keep:
            for f in self._files():
                if f.key <= end["after"]:
                    store, inner = located(f.path)
                    store.delete_file(inner)


@dataclass
class _Written(WriterCommitMessage):
    name: str | None


class _Writer(DataSourceArrowWriter):
    """Each task writes a file of its rows, in their order, named by the time of the first; all appear when all are written. Columns as those of `mrt.ELEMS`; others are ignored."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def _at(self, name: str) -> tuple[fs.FileSystem, str]:
        return located(f"{self.path}/_{self.job}/{name}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        rows = _rows(iterator)
        first = next(rows, None)
        if first is None:
            return _Written(None)
        name = f"{'rib' if first['type'] == 'R' else 'updates'}.{datetime.fromtimestamp(first['time'], UTC):%Y%m%d.%H%M}-{uuid.uuid4().hex}.mrt.gz"
        store, inner = self._at(name)
        store.create_dir(inner.rsplit("/", 1)[0])
        with store.open_output_stream(inner, compression=None) as file, gzip.GzipFile(fileobj=file, mode="wb", compresslevel=6, mtime=0) as zipped, io.BufferedWriter(zipped, 1 << 16) as content:
            for record in encoded(_and(first, rows)):
                content.write(record)
        return _Written(name)

    def commit(self, messages: list[_Written | None]) -> None:
        store, inner = located(self.path)
        store.create_dir(inner)
        old = [i.path for i in store.get_file_info(fs.FileSelector(inner)) if i.type == fs.FileType.File] if self.overwrite else []
        for m in messages:
            if m and m.name:
                store.move(self._at(m.name)[1], f"{inner}/{m.name}")
        for path in old:
            store.delete_file(path)
        self._clear()

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, inner = located(f"{self.path}/_{self.job}")
        if store.get_file_info(inner).type == fs.FileType.Directory:
            store.delete_dir(inner)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        names = batch.schema.names
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield dict(zip(names, row, strict=True))


def _and(first, rest: Iterator) -> Iterator:
    yield first
    yield from rest


class MrtSource(DataSource):
    """Options: path, start, end, span, collector, onCorrupt, partitionBytes, minPartitions, filesPerBatch, keepFiles."""

    @classmethod
    def name(cls) -> str:
        return "mrt"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(_Options(self.options))

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(_Options(self.options))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MrtSource)


def first_sound(elems: DataFrame) -> DataFrame:
    """Of a chain read with `onCorrupt` = `mark`: each slot of each collector from the first source whose files for it are all complete.

    Fails, when it runs, if a slot that any source has is whole in none.
    """
    key = ["collector", "slot"]
    whole = elems.where(F.col("status") != VALID).groupBy(*key, "source").agg(F.bool_and(F.col("status") == COMPLETE).alias("whole"))
    none = F.raise_error(F.concat(F.lit("no complete source for "), F.concat_ws(" ", "collector", F.col("slot").cast("string"))))
    chosen = whole.groupBy(*key).agg(F.min(F.when(F.col("whole"), F.col("source"))).alias("first")).withColumn("first", F.coalesce("first", none.cast("int")))
    chosen = chosen.select(F.col("collector").alias("c_"), F.col("slot").alias("s_"), "first")
    on = (F.col("collector") == F.col("c_")) & F.col("slot").eqNullSafe(F.col("s_")) & (F.col("source") == F.col("first"))
    return elems.join(chosen, on).where(F.col("status") == VALID).drop("c_", "s_", "first")


# what the writer makes


# what recurs is remembered, as when it is read


@lru_cache(1 << 12)
def _packed(address: str) -> bytes:
    return ipaddress.ip_address(address).packed


@lru_cache(1 << 14)
def _bits(prefix: str) -> bytes:
    net = ipaddress.ip_network(prefix)
    return bytes([net.prefixlen]) + net.network_address.packed[: (net.prefixlen + 7) // 8]


def _attribute(kind: int, value: bytes) -> bytes:
    return struct.pack(">BBH", 0x50, kind, len(value)) + value  # transitive, with a length of two bytes


@lru_cache(1 << 12)
def _path(text: str | None) -> bytes:
    """The reverse of `mrt.as_path`, with numbers of four bytes; segments of at most 255."""
    out = b""
    for is_set, hops in groupby((text or "").split(), key=lambda h: h.startswith("{")):
        segments = [h.strip("{}").split(",") for h in hops] if is_set else [[*hops]]
        for asns in segments:
            for k in range(0, len(asns), 255):
                some = asns[k : k + 255]
                out += bytes([mrt.AS_SET if is_set else mrt.AS_SEQUENCE, len(some)]) + b"".join(int(a).to_bytes(4, "big") for a in some)
    return out


def _record(time: int, kind: int, sub: int, body: bytes) -> bytes:
    return struct.pack(">IHHI", time, kind, sub, len(body)) + body


def _update(e: dict) -> bytes:
    """An announcement or withdrawal as a message of its own."""
    peer, prefix, v6 = _packed(e["peer_address"]), _bits(e["prefix"]), ":" in e["prefix"]
    gone, new, attributes = b"", b"", b""
    if e["type"] == "A":
        attributes = _attribute(mrt.AS_PATH, _path(e["as_path"]))
        if v6:
            attributes += _attribute(mrt.MP_REACH, struct.pack(">HBB", 2, 1, 16) + bytes(16) + b"\0" + prefix)
        else:
            new = prefix
    elif v6:
        attributes = _attribute(mrt.MP_UNREACH, struct.pack(">HB", 2, 1) + prefix)
    else:
        gone = prefix
    message = struct.pack(">H", len(gone)) + gone + struct.pack(">H", len(attributes)) + attributes + new
    head = struct.pack(">IIHH", e["peer_asn"], 0, 0, 1 if len(peer) == 4 else 2) + peer + bytes(len(peer))
    return _record(e["time"], mrt.BGP4MP, mrt.MESSAGE_AS4, head + b"\xff" * 16 + struct.pack(">HB", 19 + len(message), mrt.UPDATE) + message)


def _table(time: int, entries: list[dict]) -> Iterator[bytes]:
    """A snapshot: its peers, then a record for each run of entries of one prefix."""
    peers = {p: k for k, p in enumerate(dict.fromkeys((e["peer_asn"], e["peer_address"]) for e in entries))}
    index = b""
    for asn, address in peers:
        packed = _packed(address)
        index += bytes([2 | (len(packed) == 16)]) + bytes(4) + packed + asn.to_bytes(4, "big")
    yield _record(time, mrt.TABLE_DUMP_V2, mrt.PEER_INDEX, bytes(4) + struct.pack(">HH", 0, len(peers)) + index)
    for k, (prefix, some) in enumerate(groupby(entries, key=lambda e: e["prefix"])):
        routes = []
        for e in some:
            attributes = _attribute(mrt.AS_PATH, _path(e["as_path"]))
            routes.append(struct.pack(">HIH", peers[e["peer_asn"], e["peer_address"]], time, len(attributes)) + attributes)
        body = struct.pack(">I", k) + _bits(prefix) + struct.pack(">H", len(routes)) + b"".join(routes)
        yield _record(time, mrt.TABLE_DUMP_V2, mrt.RIB_V6 if ":" in prefix else mrt.RIB_V4, body)


def encoded(elems: Iterator[dict]) -> Iterator[bytes]:
    """Elements to records: `mrt.elements` of them gives the elements back. Neighbouring table entries of one time are one snapshot, held in memory."""
    for (kind, time), some in groupby(elems, key=lambda e: ("R", e["time"]) if e["type"] == "R" else ("U", None)):
        if kind == "R":
            yield from _table(time, [*some])
        else:
            yield from map(_update, some)
