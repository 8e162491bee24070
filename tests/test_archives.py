"""The archive source, sessions with state, and the operators whose plans were made for large groups."""

import gzip
import ipaddress
import itertools
import random
import statistics
import struct
import time
from collections import Counter
from itertools import islice

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sluice.functions import net
from sluice.operators import asof, calibration, comparison, inventory, leaveout, quantiles, rollup, states
from sluice.operators.sessions import attribute_withdrawals
from sluice.plans import archives
from sluice.sources import archive, fetch, gated, mrt, registries, sinks
from sluice.streaming import sessions

ELEMS = "seq long, time long, type string, peer_asn long, peer_address string, prefix string, as_path string"
T0 = 1_706_000_000


def elements(n, seed=1, start=T0):
    r = random.Random(seed)
    out = []
    for k in range(n):
        kind = r.choice("AAW")
        prefix = r.choice(["10.0.0.0/8", "10.1.2.0/23", "0.0.0.0/0", "2a01:5e00::/29", "::/0", "10.9.9.9/32"])
        path = r.choice(["3356 49666", "1 {2,3} 4", "4200000000", " ".join(["7"] * 300), "", "{5} {6,7}"]) if kind == "A" else None
        out.append((k, start + 7 * k, kind, r.choice([1, 65_000, 4_200_000_000]), r.choice(["10.0.0.1", "2001:db8::7"]), prefix, path))
    return out


@pytest.fixture(scope="module")
def source(spark):
    archive.register(spark)
    sessions.use_state_store(spark)
    return spark


def save(spark, rows, path, partitions=1):
    spark.createDataFrame(rows, ELEMS).repartitionByRange(partitions, "seq").sortWithinPartitions("seq").write.format("mrt").mode("append").save(str(path))


def plain(df):
    return sorted((r.time, r.type, r.peer_asn, r.peer_address, r.prefix, r.as_path) for r in df.collect())


def test_what_is_written_is_read(source, tmp_path):
    rows = elements(500)
    save(source, rows, tmp_path / "rrc00", 3)
    df = source.read.format("mrt").load(f"{tmp_path}/*/*")
    assert plain(df) == sorted(r[1:] for r in rows)
    assert df.select("path").distinct().count() == 3 and {r[0] for r in df.select("collector").distinct().collect()} == {"rrc00"}
    again = source.read.format("mrt").load(str(tmp_path / "rrc00"))
    assert plain(again) == plain(mrt.read(source, f"{tmp_path}/*/*"))
    with pytest.raises(Exception, match="nothing"):
        source.read.format("mrt").load(str(tmp_path / "nothing")).count()


def test_files_of_a_large_archive_are_more_and_not_larger(source, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "PER_FILE", 20)
    rows = elements(500)
    archives.written(source.createDataFrame(rows, ELEMS).coalesce(1), str(tmp_path / "second" / "rrc00"), "time", "seq")
    counts = [sum(1 for _ in mrt.decode(f.read_bytes())) for f in (tmp_path / "second" / "rrc00").iterdir()]
    assert sum(counts) == 500 and len(counts) > 20 and max(counts) < 60
    archives._cut_short(source, str(tmp_path / "second" / "rrc00"), str(tmp_path / "first" / "rrc00"))
    whole, part = ({f.name: f.read_bytes() for f in (tmp_path / k / "rrc00").iterdir()} for k in ("second", "first"))
    assert part == {name: data[: len(data) * 6 // 10] for name, data in whole.items()}
    chain = source.read.format("mrt").option("onCorrupt", "mark").load(f"{tmp_path}/first/*/*,{tmp_path}/second/*/*")
    assert plain(archive.first_sound(chain)) == sorted(r[1:] for r in rows)


def test_tables_are_written_with_their_peers(source, tmp_path):
    rows = [(k, 57_600, "R", asn, peer, prefix, path) for k, (asn, peer, prefix, path) in enumerate([(1, "10.0.0.1", "10.1.0.0/16", "1 2"), (2, "2001:db8::1", "10.1.0.0/16", ""), (1, "10.0.0.1", "2a01::/32", "1 {2,3}")])]
    rows += [(9, 86_400, "R", 5, "10.0.0.5", "10.1.0.0/16", "5")]
    save(source, rows, tmp_path / "rv")
    assert plain(source.read.format("mrt").load(str(tmp_path / "rv"))) == sorted(r[1:] for r in rows)


def test_overwriting_replaces_and_failing_leaves_nothing(source, tmp_path):
    save(source, elements(10), tmp_path / "a")
    one = source.createDataFrame(elements(3, 2), ELEMS)
    one.coalesce(1).write.format("mrt").mode("overwrite").save(str(tmp_path / "a"))
    assert source.read.format("mrt").load(str(tmp_path / "a")).count() == 3
    bad = one.withColumn("prefix", F.when(F.col("seq") < 2, F.col("prefix")).otherwise("nonsense"))
    with pytest.raises(Exception):  # noqa: B017
        bad.coalesce(1).write.format("mrt").mode("append").save(str(tmp_path / "a"))
    assert source.read.format("mrt").load(str(tmp_path / "a")).count() == 3 and len(list((tmp_path / "a").iterdir())) == 1


def test_files_outside_the_window_are_not_opened(source, tmp_path):
    for k in range(4):
        save(source, elements(5, k, T0 + 3600 * k), tmp_path / "rrc00")
    files = sorted((tmp_path / "rrc00").iterdir())
    assert [archive.slot_of(str(f)) for f in files] == [(T0 + 3600 * k) // 60 * 60 for k in range(4)]
    files[0].write_bytes(b"broken"), files[3].write_bytes(b"broken")
    df = source.read.format("mrt").option("start", T0 + 3600).option("end", T0 + 7200 + 10).load(str(tmp_path / "rrc00"))
    assert sorted(r.time for r in df.collect()) == [T0 + 3600 + 7 * k for k in range(5)] + [T0 + 7200, T0 + 7207]
    options = archive._Options({"path": str(tmp_path / "rrc00"), "partitionBytes": "1"})
    assert len(options.runs(archive.listed(options.path))) == 4 and len(archive._Options({"path": options.path}).runs(archive.listed(options.path))) == 1


@pytest.mark.parametrize("name", ["updates.20240123.0905.gz", "/a/b/rib.20240123.0905.bz2", "bview.20240123.0905.gz"])
def test_slots_and_names(name):
    assert archive.slot_of(name) == 1_706_000_700
    assert archive.slot_of("feb2026.parquet") is None and archive.window_of("/x/feb2026_onset.parquet") == "feb2026_onset"


def record(kind, sub, body=b"\0" * 40):
    return struct.pack(">IHHI", T0, kind, sub, len(body)) + body


@pytest.mark.parametrize("kind,sub", [(13, 3), (13, 5), (13, 6), (13, 8), (16, 8), (16, 9), (17, 11), (12, 3), (99, 1)])
def test_what_is_not_supported_fails(source, tmp_path, kind, sub):
    (tmp_path / "x.mrt").write_bytes(record(kind, sub))
    for df in (source.read.format("mrt").load(str(tmp_path)), mrt.read(source, str(tmp_path))):
        with pytest.raises(Exception, match="not supported"):
            df.count()


def test_state_changes_and_the_old_table_format():
    entry = b"\0\0\0\1" + ipaddress.ip_address("10.1.0.0").packed + b"\x10\1" + bytes(4) + ipaddress.ip_address("10.0.0.1").packed + struct.pack(">HH", 65_000, 9) + b"\x40\2\6\2\2\0\1\0\2"
    got = list(mrt.decode(record(16, 0) + record(16, 5) + record(12, 1, entry)))
    assert got == [(T0, "R", 65_000, "10.0.0.1", "10.1.0.0/16", "1 2")]


def test_records_are_read_one_by_one(tmp_path):
    rows = [dict(zip(("time", "type", "peer_asn", "peer_address", "prefix", "as_path"), r[1:])) for r in elements(400)]
    with gzip.open(tmp_path / "x.gz", "wb") as f:
        f.write(b"".join(archive.encoded(iter(rows))))
    with gzip.open(tmp_path / "x.gz", "ab") as f:  # a second member
        f.write(b"".join(archive.encoded(iter(rows[:3]))))
    with open(tmp_path / "x.gz", "rb") as f:
        content = mrt.inflated(f)
        first = list(islice(mrt.elements(mrt.records(content)), 5))
        assert [e[0] for e in first] == [r["time"] for r in rows[:5]] and content.tell() < 4000
    with open(tmp_path / "x.gz", "rb") as f:
        assert sum(1 for _ in mrt.elements(mrt.records(mrt.inflated(f)))) == 403


@pytest.mark.parametrize("part", [0.0, 0.5, 0.97])
def test_a_broken_source_is_told_and_replaced(source, tmp_path, part):
    rows = elements(300)
    for name in ("first", "second"):
        save(source, rows, tmp_path / name / "rrc00")
        save(source, elements(20, 5, T0 + 9000), tmp_path / name / "rrc00")
    file = next(f for f in (tmp_path / "first" / "rrc00").iterdir() if archive.slot_of(str(f)) < T0 + 900)
    file.write_bytes(file.read_bytes()[: int(part * file.stat().st_size)] or b"\x1f\x8bxx")
    chain = f"{tmp_path}/first/*/*,{tmp_path}/second/*/*"
    with pytest.raises(Exception, match="mrt"):
        source.read.format("mrt").load(chain).count()
    marked = source.read.format("mrt").option("onCorrupt", "mark").load(chain)
    kinds = Counter(r.status for r in marked.where("status <> 'valid'").collect())
    assert kinds == {"complete": 3, "corrupted-record" if part > 0.2 else "corrupted-source": 1}
    out = archive.first_sound(marked)
    assert sorted((r.time, r.source) for r in out.collect()) == sorted([(r[1], 1) for r in rows] + [(T0 + 9000 + 7 * k, 0) for k in range(20)])
    with pytest.raises(Exception, match="no complete source"):
        archive.first_sound(marked.where("source = 0")).count()


def drain(df, out, state, name):
    q = df.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(state)).outputMode("append").start()
    try:
        q.processAllAvailable()
        return q.recentProgress
    finally:
        q.stop()


def test_stream_takes_files_in_order_and_refuses_what_comes_late(source, tmp_path):
    for k in (2, 0, 1):
        save(source, elements(5, k, T0 + 3600 * k), tmp_path / "s")
    stream = source.readStream.format("mrt").option("filesPerBatch", 1).option("keepFiles", "false").load(str(tmp_path / "s"))
    seen = drain(stream.select("slot", "time"), tmp_path / "out", tmp_path / "ck", "s")
    assert [p["numInputRows"] for p in seen if p["numInputRows"]] == [15]
    for k in (3, 4):
        save(source, elements(5, k, T0 + 3600 * k), tmp_path / "s")
    drain(stream.select("slot", "time"), tmp_path / "out", tmp_path / "ck", "s")  # goes on where the first run stopped
    assert source.read.parquet(str(tmp_path / "out")).count() == 25 and len(list((tmp_path / "s").glob("*.gz"))) <= 2
    reader = archive._StreamReader(archive._Options({"path": str(tmp_path / "t"), "filesPerBatch": "1"}))
    assert reader.initialOffset() == reader.latestOffset()
    for k in (3, 4):
        save(source, elements(5, k, T0 + 3600 * k), tmp_path / "t")
    a = reader.initialOffset()
    b = reader.latestOffset()
    assert [len(r.files) for r in reader.partitions(a, b)] == [1]
    c = reader.latestOffset()
    assert reader.partitions(b, c)[0].files[0].slot > reader.partitions(a, b)[0].files[0].slot
    save(source, elements(5, 1, T0), tmp_path / "t")
    with pytest.raises(ValueError, match="1 files arrived behind"):
        reader.at = c
        reader.latestOffset()


def test_sessions_equal_the_batch_operator_and_forget(source, tmp_path):
    """Rows shuffled within the allowed lateness; sessions that end leave no state."""
    r, rows = random.Random(3), elements(400)
    order = sorted(rows, key=lambda e: e[1] + r.randint(0, 300))
    for k in range(0, 400, 100):
        source.createDataFrame(order[k : k + 100], ELEMS).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k:03d}"))
    late = (999, T0 + 1, "W", 1, "10.0.0.1", "10.0.0.0/8", None)
    end = (0, T0 + 90 * 86_400, "S", 1, "10.0.0.9", "10.0.0.0/8", None)
    for name, some in (("900", [late, end]), ("901", [(0, end[1] + 9, *end[2:])])):
        source.createDataFrame(some, ELEMS).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    stream = source.readStream.schema(ELEMS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    seen = drain(sessions.attributed(stream, late=300, idle=86_400), tmp_path / "out", tmp_path / "ck", "x")
    out = source.read.parquet(str(tmp_path / "out")).collect()
    got = sorted((x.seq, x.asn) for x in out if x.status == "attributed")
    batch = source.createDataFrame(rows, ELEMS)
    origin = F.regexp_extract("as_path", r"(\d+)$", 1).try_cast("long")
    want = attribute_withdrawals(batch, F.coalesce(origin, F.lit(-1)), tuple(sessions.SESSION), ("time", "seq"))
    assert got == sorted((x.seq, x.asn) for x in want.collect())
    assert [(x.seq, x.asn) for x in out if x.status == "late"] == [(999, None)]
    states = [p["stateOperators"][0]["numRowsTotal"] for p in seen if p["stateOperators"]]
    assert max(states) > 20 and states[-1] <= 2


def test_files_that_shrink_well_are_dealt_to_many_tasks():
    """A hundred thousand elements may be 90 KB: 24 such files were one task's work."""
    runs = lambda n, size, **o: archive._Options({"path": "", **o}).runs([archive.File(0, f"/a/rrc00/u{k:05d}", size) for k in range(n)])
    assert len(runs(24, 90_000)) == 24 and len(runs(144, 90_000)) >= 64 and len(runs(144, 90_000, minPartitions="12")) == 12
    assert len(runs(500, 100)) == 1 and max(sum(f.size for f in r.files) for r in runs(10_000, 100_000)) <= 4 << 20
    assert [f.path for r in runs(144, 90_000) for f in r.files] == [f"/a/rrc00/u{k:05d}" for k in range(144)]


def test_rows_of_a_session_travel_in_packs(spark):
    """One row for each session and type of a task, with all its rows in it, those without an address too."""
    r = random.Random(4)
    rows = [(r.choice(["10.0.0.1", None]), r.choice([1, 2]), r.choice(["a", "b"]), r.choice(["A", "W", "S", None]), T0 + r.randint(0, 50), k, r.choice([-1, 7])) for k in range(3000)]
    df = spark.createDataFrame(rows, "peer_address string, peer_asn long, prefix string, type string, time long, seq long, origin long").coalesce(1)
    got = sessions.packed(df).collect()
    assert len(got) == len({x[:4] for x in rows}) == 32
    numbers = [(x, sessions.np.frombuffer(x.rows, "i8").reshape(3, -1)) for x in got]
    assert sorted(((x.peer_address, x.peer_asn, x.prefix, x.type, *t) for x, n in numbers for t in n.T.tolist()), key=str) == sorted(rows, key=str)
    assert all(x.latest == n[0].max() for x, n in numbers)
    with pytest.raises(Exception, match="seq is null"):
        sessions.packed(df.withColumn("seq", F.expr("if(seq = 9, null, seq)"))).collect()


@pytest.mark.parametrize("seed", range(4))
def test_packs_wait_and_come_out_in_order(monkeypatch, seed):
    """A session against a loop over its rows: ties, rows that come late, values of a few rows each."""
    monkeypatch.setattr(sessions, "PACK", 3)
    r = random.Random(seed)
    batches = [[(r.choice("AW"), [(T0 + r.randint(40 * b, 40 * b + 60), r.randint(0, 3), r.randint(1, 9)) for _ in range(r.randint(1, 9))]) for _ in range(r.randint(1, 4))] for b in range(5)]

    class State:
        def __init__(self, *_):
            self.values = []

        def get(self):
            return list(self.values)

        def put(self, values):
            self.values = list(values)

        def appendValue(self, value):
            self.values.append(value)

        def clear(self):
            self.values = []

    class Value(State):
        def get(self):
            return self.values[0] if self.values else None

        def update(self, value):
            self.values = [value]

    class Handle:
        getListState, getValueState = State, Value
        due = None

        def registerTimer(self, at):
            self.due = at if self.due is None else min(at, self.due)

    class Timers:
        def __init__(self, at):
            self.at = at

        def getCurrentWatermarkInMs(self):
            return self.at

    processor, handle, key = sessions.Attribution(10**6), Handle(), ("10.0.0.1", 1, "a")
    processor.init(handle)
    out, waiting, want, asn = [], [], [], -1
    for b, packs in enumerate([*batches, []]):
        passed = T0 + 40 * b if b else None
        now = Timers(0 if passed is None else passed * 1000 - processor.behind)
        frame = sessions.pd.DataFrame({"type": [k for k, _ in packs], "rows": [sessions.np.array(rows).T.tobytes() for _, rows in packs]})
        out += [tuple(x) for f in processor.handleInputRows(key, iter([frame]), now) for x in f.itertuples(index=False)]
        for kind, rows in packs:
            for t, seq, origin in rows:
                if passed is not None and t < passed:
                    want.append((*key, t, seq, kind, None, "late"))
                else:
                    waiting.append((t, seq, kind, origin))
        now = Timers(10**13 if b == 5 else now.at)
        if passed is not None:
            out += [tuple(x) for f in processor.handleExpiredTimer(key, now, None) for x in f.itertuples(index=False)]
            ready = sorted(w for w in waiting if b == 5 or w[0] < passed)
            waiting = [] if b == 5 else [w for w in waiting if w[0] >= passed]
            for t, seq, kind, origin in ready:
                asn = origin if kind == "A" else asn
                want.append((*key, t, seq, kind, asn, "attributed"))
    assert out == want and processor.waiting.values == [] and handle.due is not None


@pytest.mark.parametrize("seed", range(3))
def test_quantiles_equal_the_built_in(spark, seed):
    r = random.Random(seed)
    draw = [lambda: r.gauss(0, 1), lambda: float(r.randint(0, 3)), lambda: r.choice([None, 0.0, -0.0, 1e300, -1e300, 1e-300, 5.0]), lambda: r.lognormvariate(0, 6), lambda: 1e9 + r.random()][(seed * 2) % 5 :] + [lambda: None]
    rows = [(None if g == 1 else g, d(), i, 7) for g, d in enumerate(draw) for i in range(r.choice([1, 2, 301]))]
    df = spark.createDataFrame(rows, "g int, v double, w long, bin int")
    wanted = {f"v{int(p * 100)}": ("v", p) for p in (0.0, 0.05, 0.5, 0.95, 1.0)} | {"w50": ("w", 0.5)}
    said = lambda rows: sorted((str(x.g), *(None if x[n] is None else float(x[n]) for n in wanted)) for x in rows)
    built_in = df.groupBy("g").agg(*[F.percentile(c, F.lit(p)).alias(n) for n, (c, p) in wanted.items()]).collect()
    assert said(quantiles.quantiles(df, ["g"], wanted).collect()) == said(built_in)
    beside = quantiles.with_quantiles(df.groupBy("g").agg(F.count("*").alias("n")), df, ["g"], wanted)
    assert said(beside.collect()) == said(built_in) and {x.n for x in beside.collect()} <= {1, 2, 301}
    whole = df.agg(*[F.percentile(c, F.lit(p)).alias(n) for n, (c, p) in wanted.items()]).first()
    assert tuple(quantiles.quantiles(df, [], wanted).first()) == tuple(map(float, whole))
    nothing = df.where("false")
    assert tuple(quantiles.quantiles(nothing, [], wanted).first()) == (None,) * 6 and quantiles.quantiles(nothing, ["g"], wanted).count() == 0


def test_modes_and_single_rows(spark):
    rows = [(1, 5), (1, 5), (1, 3), (2, 9), (2, 4), (3, None), (3, None), (3, 8), (4, None), (None, 2)]
    df = spark.createDataFrame(rows, "g int, v int")
    assert {(x.g, x.v) for x in quantiles.modes(df, ["g"], "v").collect()} == {(1, 5), (2, 4), (3, 8), (4, None), (None, 2)}
    assert tuple(quantiles.beside(df.agg(F.max("v").alias("a")), df.agg(F.min("v").alias("b"))).first()) == (9, 2)


def test_a_hot_entity_is_cut_into_even_slices(spark):
    r = random.Random(6)
    key = lambda: 0 if r.random() < 0.9 else r.choice([None, 1, 2, 3])
    readings = [(key(), r.randint(0, 50_000), r.choice([None, r.random()])) for _ in range(900)]
    points = [(k, key(), r.randint(-10, 50_010)) for k in range(900)]
    right, left = spark.createDataFrame(readings, "asn int, ts long, value double"), spark.createDataFrame(points, "id int, asn int, ts long")
    want = {}
    for k, asn, ts in points:
        before = [(t, v) for a, t, v in readings if a == asn and t <= ts and v is not None]
        want[k] = max(before)[1] if before else None
    for most in (1, 60, 10**6):
        out = asof.asof_backward(left, right, ["asn"], "value", most=most, grain=500)
        assert {x.id: x.value for x in out.collect()} == {k: v if points[k][1] is not None else out_of_null(readings, points[k][2]) for k, v in want.items()}
    parts = asof.sliced(left, ["asn"], "ts", most=60, grain=500).groupBy("asn", "_slice").agg(F.count("*").alias("n")).collect()
    assert max(x.n for x in parts) < 90 and {x.asn for x in parts if x._slice is not None} == {0} and len(parts) > 10

    periods = [(key(), s, s + r.randint(-5, 900)) for s in (r.randint(0, 50_000) for _ in range(300))]
    inside = {k: any(a == asn and s <= ts <= e for a, s, e in periods) for k, asn, ts in points}
    spans = spark.createDataFrame(periods, "asn int, start long, end long")
    for most in (50, 10**6):
        assert {x.id: x.active for x in comparison.active_at(left, spans, most=most, grain=500).collect()} == inside


def out_of_null(readings, ts):
    """A null entity is an entity like any other."""
    before = [(t, v) for a, t, v in readings if a is None and t <= ts and v is not None]
    return max(before)[1] if before else None


def test_cover_rows_are_the_cover(spark):
    r = random.Random(2)
    ranges = [(r.getrandbits(32) >> r.randint(0, 8), r.randint(1, 1 << r.randint(0, 20))) for _ in range(200)] + [(0, 2**32), (2**32 - 1, 1), (5, 0), (5, -3)]
    ranges = [(s, min(n, 2**32 - s)) for s, n in ranges]
    df = spark.createDataFrame(ranges, "s long, n long")
    got = Counter((x.s, x.n, x.addr, x.plen) for x in net.cover_rows(df, "s", "n").collect())
    want = Counter((x.s, x.n, c.addr, c.plen) for x in df.select("s", "n", net.cidr_cover(F.col("s"), F.col("n")).alias("c")).collect() for c in x.c)
    assert got == want and net.cover_rows(df.withColumn("n", F.lit(None).cast("long")), "s", "n").count() == 0


@pytest.mark.parametrize("block", ["10.0.0.0/24", "2a01:5e00::/32", "ffff:ffff:ffff:ffff:ffff::/80"])
def test_sweep_against_every_ancestor(spark, block):
    r, net_ = random.Random(block), ipaddress.ip_network(block)
    rows, width = [], net_.max_prefixlen
    for ts in (1, 2, 3):
        for _ in range(r.choice([1, 40])):
            plen = min(width, net_.prefixlen + r.randint(0, 10))
            at = int(net_.network_address) + (r.getrandbits(plen - net_.prefixlen) << (width - plen) if plen > net_.prefixlen else 0)
            p = ipaddress.ip_network((at, plen))
            rows += [(ts, str(p), v) for v in r.choices([0.25, 0.5, 0.75, 1.0, None], k=r.choice([1, 1, 2]))]
    want = {}
    for ts in {t for t, *_ in rows}:
        best = {}
        for t, p, v in rows:
            if t == ts and v is not None:
                best[ipaddress.ip_network(p)] = max(v, best.get(ipaddress.ip_network(p), 0))
        total = 0.0
        for p, v in best.items():
            above = [q for q in best if q != p and p.subnet_of(q)]
            total += 2.0 ** (net_.prefixlen - p.prefixlen) * (v - (best[max(above, key=lambda q: q.prefixlen)] if above else 0))
        want[ts] = (max(best.values(), default=None), sum(t == ts for t, *_ in rows), round(total, 12))
    df = spark.createDataFrame(rows, "ts long, prefix string, visibility double")
    out = rollup.rollup_visibility(df, spark.createDataFrame([(block,)], "block string")).collect()
    assert {x.ts: (x.visibility_max, x.n_observed, round(x.visibility_weighted, 12)) for x in out} == want
    assert {(x.block, x.family) for x in out} == {(block, net_.version)}


AUDIT = '{"c1":{"ipv4":3,"ipv6":1},"c2":{"ipv4":1,"ipv6":1}}'
SNAPSHOT = "ts long, prefix string, family int, peers_total int, collector_fullfeed string, visibility double, cc string"


def snapshots(n=3):
    return [(ts, p, f, 4 if f == 4 else 2, AUDIT, 0.5, None if p == "a" else "TR") for ts in range(n) for p, f in (("a", 4), ("b", 4), ("x", 6), ("y", 6))]


@pytest.mark.parametrize(
    "change,found",
    [
        (lambda r: r + [r[0]], {"repeated prefixes": 1}),
        (lambda r: [(*r[0][:3], 5, *r[0][4:]), *r[1:]], {"uneven totals": 1, "totals that are not the audit's sum": 1}),
        (lambda r: [x if x[0] else (*x[:4], AUDIT.replace('"c1"', '"c9"'), *x[5:]) for x in r], {"no full-feed peer of c1": 1}),
        (lambda r: [*r[:3], (*r[3][:4], AUDIT + " ", *r[3][5:]), *r[4:]], {"several audits": 1}),
        (lambda r: [(*x[:4], None, *x[5:]) for x in r], {"totals that are not the audit's sum": 6, "no full-feed peer of c1": 3, "no full-feed peer of c2": 3}),
    ],
)
def test_a_gate_that_fails_leaves_nothing(spark, tmp_path, change, found):
    path = str(tmp_path / "series")
    good = spark.createDataFrame(snapshots(), SNAPSHOT)
    assert gated.write_consolidated(good, path, ["c1", "c2"]) == {"rows": 12, "snapshots": 3}
    with pytest.raises(gated.GateError) as error:
        gated.write_consolidated(spark.createDataFrame(change(snapshots()), SNAPSHOT), path, ["c1", "c2"])
    assert error.value.found == found
    assert [x.name for x in tmp_path.iterdir()] == ["series"] and spark.read.parquet(path).count() == 12
    with pytest.raises(Exception, match="boom"):
        gated.write_consolidated(good.withColumn("visibility", F.when(F.col("ts") == 2, F.raise_error(F.lit("boom")).cast("double")).otherwise(0.5)), path, ["c1"])
    assert [x.name for x in tmp_path.iterdir()] == ["series"]


def test_snapshots_are_whole_and_ordered_in_their_files(spark, tmp_path):
    path = str(tmp_path / "series")
    rows = snapshots(40)
    random.Random(1).shuffle(rows)
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"  # few rows would become one file
    spark.conf.set(coalesce, "false")
    try:
        gated.write_consolidated(spark.createDataFrame(rows, SNAPSHOT).repartition(7), path, ["c1", "c2"])
    finally:
        spark.conf.unset(coalesce)
    files = [pq.ParquetFile(f) for f in sorted((tmp_path / "series").glob("*.parquet"))]
    assert len(files) > 1
    groups = [f.metadata.row_group(g).column(f.schema.names.index("ts")).statistics for f in files for g in range(f.num_row_groups)]
    for ts in range(40):
        assert sum(s.min <= ts <= s.max for s in groups) == 1  # one row group answers a filter on ts
    for f in files:
        t = f.read().to_pylist()
        assert [(r["ts"], r["family"], r["prefix"]) for r in t] == sorted((r["ts"], r["family"], r["prefix"]) for r in t)
        assert all((r["ff_v4"], r["ff_v6"], r["cc"]) == (4, 2, "IR" if r["prefix"] == "a" else "TR") for r in t)
    gated.write_consolidated(spark.createDataFrame([], SNAPSHOT), str(tmp_path / "none"), ["c1"])
    assert spark.read.parquet(str(tmp_path / "none")).count() == 0


def test_inventory(spark, tmp_path):
    want = inventory.expected_units(spark, [("a", 5, 41, 10), ("a", 40, 60, 10), ("b", 0, 30, 15), ("c", 7, 7, 10)])
    assert sorted(map(tuple, want.collect())) == [("a", x) for x in ("10", "20", "30", "40", "50")] + [("b", "0"), ("b", "15")]
    have = spark.createDataFrame([("a", "10"), ("a", "99"), ("b", "0"), ("b", "15"), ("d", "1")], "series string, unit string")
    found = {r.series: tuple(r)[1:] for r in inventory.report(want, have, sample=2).collect()}
    assert found == {"a": (5, 1, 4, 1, 0, "20,30", False), "b": (2, 2, 0, 0, 0, "", True), "d": (0, 0, 0, 1, 0, "", True)}
    stale = inventory.report(want, have, have.where("unit <> '15'"))
    assert {r.series: (r.n_stale, r.complete) for r in stale.collect()} == {"a": (0, False), "b": (1, False), "d": (0, True)}
    inventory.require(inventory.report(want, have), ["b", "d"])
    with pytest.raises(inventory.Incomplete, match="incomplete: a"):
        inventory.require(inventory.report(want, have), ["a", "b"])
    with pytest.raises(inventory.Incomplete, match="unknown series: z"):
        inventory.require(inventory.report(want, have), ["z", "b"])


def test_units_without_rows_are_done_and_changed_inputs_are_not(spark, tmp_path):
    path = str(tmp_path / "manifest")
    want = inventory.expected_units(spark, [("s", 0, 40, 10)])
    assert inventory.to_do(want, inventory.finished(spark, path)).count() == 4
    rows = lambda *r: spark.createDataFrame([("s", u, v) for u, v in r], "series string, unit string, v int")
    old = inventory.fingerprints(rows(("0", 1), ("0", 2), ("10", 5), ("10", 5), ("10", 5)), inventory.UNIT)
    inventory.record(old, path)
    inventory.record(spark.createDataFrame([("s", "20", 0, None)], inventory.MANIFEST), path)
    assert [tuple(r) for r in inventory.to_do(want, inventory.finished(spark, path)).collect()] == [("s", "30", "missing")]
    now = inventory.fingerprints(rows(("0", 2), ("0", 1), ("10", 5)), inventory.UNIT)
    assert {r.unit: r.n_rows for r in now.collect()} == {"0": 2, "10": 1}
    assert sorted(tuple(r)[1:] for r in inventory.to_do(want, inventory.finished(spark, path), now).collect()) == [("10", "stale"), ("30", "missing")]
    inventory.record(now, path)
    assert [r.unit for r in inventory.to_do(want, inventory.finished(spark, path), now).collect()] == ["30"]


def test_renaming_replaces(spark, tmp_path):
    for text in ("one", "two"):
        sinks.write_text(spark, str(tmp_path / "f.txt"), text)
        assert (tmp_path / "f.txt").read_text() == text
    for n in (1, 2):
        spark.range(n).write.parquet(str(tmp_path / f"new{n}"))
        sinks.move(spark, str(tmp_path / f"new{n}"), str(tmp_path / "t"))
        assert spark.read.parquet(str(tmp_path / "t")).count() == n
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["f.txt", "t"]


def fetcher(folder, calls, slow=(), bad=()):
    def get(url):
        calls.append(url)
        for _ in range(200 if url in slow else 1):
            time.sleep(0.005)
        if url in bad:
            raise fetch.TransportError(url)
        path = folder / url
        path.write_text(url)
        return path

    return get


def test_files_come_in_order_and_go(tmp_path):
    calls = []
    urls = [f"u{k:02d}" for k in range(20)]
    seen = []
    for p in fetch.in_order(urls, fetcher(tmp_path, calls, slow={"u00"}), 4):
        seen.append(p.name)
        assert len(list(tmp_path.iterdir())) <= 4 and len(calls) <= len(seen) + 4
    assert seen == urls and not list(tmp_path.iterdir())
    kept = [p.read_text() for p in fetch.in_order(urls[:5], fetcher(tmp_path, calls), 2, keep=True)]
    assert kept == urls[:5] and len(list(tmp_path.iterdir())) == 5
    assert list(fetch.in_order([], fetcher(tmp_path, calls))) == []


def test_a_failure_cancels_what_waits_and_leaves_nothing(tmp_path):
    """The error comes at once, though a slow file is under way; what has not begun is never fetched."""
    calls, urls = [], [f"u{k:02d}" for k in range(30)]
    files = fetch.in_order(urls, fetcher(tmp_path, calls, slow={"u03"}, bad={"u02"}), 4)
    began, seen = time.perf_counter(), []
    with pytest.raises(fetch.TransportError, match="u02"):
        for p in files:
            seen.append(p.name)
    assert seen == urls[:2] and time.perf_counter() - began < 0.8
    time.sleep(1.5)
    assert len(calls) <= 7 and not list(tmp_path.iterdir())


def test_a_reader_that_stops_cancels_too(tmp_path):
    calls, urls = [], [f"u{k:02d}" for k in range(30)]
    files = fetch.in_order(urls, fetcher(tmp_path, calls), 3)
    assert next(files).name == "u00"
    files.close()
    time.sleep(0.3)
    assert len(calls) <= 5 and not list(tmp_path.iterdir())


def test_runs_are_compared_in_order(spark):
    row = "ts long, seq long, prefix string, peers_seen int, peers_total int, visibility double, origin_asn long, collector_fullfeed string"
    base = [(0, k, f"10.0.{k}.0/24", 40, 50, 0.8, 65_000, f"a{k % 2}") for k in range(4)]
    a = spark.createDataFrame(base, row)
    same = spark.createDataFrame([(*r, "IR") for r in base] + [(0, 9, "192.0.2.0/24", 1, 50, 0.5, 1, "a1", "TR")], row + ", cc string")
    assert comparison.compare_snapshots(a, same).count() == 0
    drift = spark.createDataFrame([(*base[0][:3], 35, 50, 0.7, None, "a0"), *base[1:]], row)
    assert sorted(map(tuple, comparison.compare_snapshots(a, drift).collect())) == [(0, k, 1, 4, "10.0.0.0/24") for k in ("origin_asn", "peers_seen", "visibility")]
    turned = spark.createDataFrame([(*r[:1], 10 - r[1], *r[2:]) for r in base], row)  # the same audits, the other way round
    assert [tuple(r) for r in comparison.compare_snapshots(a, turned).collect()] == [(0, "collector_fullfeed", 2, 2, "1")]
    less = spark.createDataFrame([(*r[:7], "a0") for r in base[:3]], row)
    assert sorted(map(tuple, comparison.compare_snapshots(a, less).collect())) == [(0, "collector_fullfeed", 1, 2, "2"), (0, "only_base", 1, 4, "10.0.3.0/24")]
    assert sorted(map(tuple, comparison.compare_snapshots(less, a).collect())) == [(0, "collector_fullfeed", 1, 2, "2"), (0, "only_candidate", 1, 4, "10.0.3.0/24")]
    other = comparison.compare_snapshots(a, spark.createDataFrame([(1, *r[1:]) for r in base[:1]], row))
    assert {(r.ts, r.kind): r.n for r in other.collect()} == {(0, "collector_fullfeed"): 2, (1, "collector_fullfeed"): 1, (0, "only_base"): 4, (1, "only_candidate"): 1}


def test_threshold_grid_against_every_pair(spark):
    r = random.Random(9)
    rows = [(r.choice([None, 0.0, 0.1, 0.5, 0.9, r.random()]), r.choice([None, 0.0, 20.0, 100 * r.random()]), r.choice([None, 0.0, -5.0, 100.0])) for _ in range(400)]
    df = spark.createDataFrame(rows, "visibility double, probing double, baseline double")
    announced, dark = [0.5, 0.1, 0.9, 0.0], [0.2, 0.5, 0.0]
    want = {}
    for a, d in itertools.product(announced, dark):
        said = Counter(x.s for x in df.select(states.state(F.col("visibility"), F.col("probing"), F.col("baseline"), a, d).alias("s")).collect())
        want[a, d] = (400, said["withdrawn"], said["dark"], said["reachable"])
    assert {(x.announced_min, x.dark_ratio): tuple(x)[2:] for x in calibration.state_grid(df, announced, dark).collect()} == want
    none = calibration.state_grid(df.limit(0), announced, dark).collect()
    assert len(none) == 12 and all(tuple(x)[2:] == (0, 0, 0, 0) for x in none)


def test_leaving_one_out_is_running_without_it(spark):
    r = random.Random(4)
    rows = [(r.choice([1, 1, 1, 1, 2, 3, None]), r.choice([None, 1.0, 2.0, r.gauss(0, 50), 1e9])) for _ in range(301)] + [(7, None), (8, 5.0)]
    df = spark.createDataFrame(rows, "asn int, value double")
    out = {x.asn: x for x in leaveout.leave_one_out(df, "asn", "value").collect()}
    assert set(out) == {1, 2, 3, None, 8}
    for e, x in out.items():
        rest = [v for a, v in rows if a != e and v is not None]
        assert x.n == len(rest) and x.median == pytest.approx(statistics.median(rest)) and x.mean == pytest.approx(statistics.fmean(rest))
    alone = leaveout.leave_one_out(df.where("asn = 8"), "asn", "value").first()
    assert tuple(alone) == (8, 0, None, None) and leaveout.leave_one_out(df.limit(0), "asn", "value").count() == 0


def test_a_missing_dimension_has_no_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("asn,cc\n5,TR\n")
    there = registries.dimension_if_there(spark, str(tmp_path / "a.csv"), "asn long, cc string")
    gone = registries.dimension_if_there(spark, str(tmp_path / "b.csv"), "asn long, cc string")
    assert [tuple(r) for r in there.collect()] == [(5, "TR")] and gone.count() == 0 and gone.columns == there.columns
