import bz2
import gzip
import ipaddress
import json
import struct

import pytest
from pyspark.sql import functions as F

from sluice.operators.bands import Window
from sluice.operators.visibility import visibility
from sluice.sources import fetch, mrt, registries, signals, sinks
from sluice.sources.config import Config
from sluice.streaming import origins


def record(time, kind, sub, body):
    return struct.pack(">IHHI", time, kind, sub, len(body)) + body


def nlri(prefix):
    net = ipaddress.ip_network(prefix)
    return bytes([net.prefixlen]) + net.network_address.packed[: (net.prefixlen + 7) // 8]


def attribute(kind, data):
    return bytes([0x40, kind, len(data)]) + data


def path(*hops, size=4):
    out = b""
    for h in hops:
        asns = [h] if isinstance(h, int) else list(h)
        out += bytes([mrt.AS_SEQUENCE if isinstance(h, int) else mrt.AS_SET, len(asns)]) + b"".join(a.to_bytes(size, "big") for a in asns)
    return out


def update(time, peer, announced=(), withdrawn=(), hops=(), as4=True, more=b"", sub=None):
    size = 4 if as4 else 2
    attributes = (attribute(mrt.AS_PATH, path(*hops, size=size)) if hops else b"") + more
    gone = b"".join(map(nlri, withdrawn))
    message = struct.pack(">H", len(gone)) + gone + struct.pack(">H", len(attributes)) + attributes + b"".join(map(nlri, announced))
    bgp = b"\xff" * 16 + struct.pack(">HB", 19 + len(message), mrt.UPDATE) + message
    head = peer.to_bytes(size, "big") + (65000).to_bytes(size, "big") + struct.pack(">HH", 0, 1) + bytes([192, 0, 2, 1]) + bytes([192, 0, 2, 2])
    return record(time, mrt.BGP4MP, sub or (mrt.MESSAGE_AS4 if as4 else mrt.MESSAGE_AS2), head + bgp)


def table(time=28_800):
    peers = b"\0" * 4 + struct.pack(">H", 0) + struct.pack(">H", 2)
    peers += b"\x02" + b"\0" * 4 + bytes([192, 0, 2, 1]) + (3356).to_bytes(4, "big")
    peers += b"\x01" + b"\0" * 4 + ipaddress.ip_address("2001:db8::1").packed + (1299).to_bytes(2, "big")

    def entry(prefix, *routes):
        body = b"\0" * 4 + nlri(prefix) + struct.pack(">H", len(routes))
        for peer, hops in routes:
            a = attribute(mrt.AS_PATH, path(*hops))
            body += struct.pack(">HIH", peer, 0, len(a)) + a
        return record(time, mrt.TABLE_DUMP_V2, mrt.RIB_V6 if ":" in prefix else mrt.RIB_V4, body)

    return record(time, mrt.TABLE_DUMP_V2, mrt.PEER_INDEX, peers) + entry("5.22.192.0/18", (0, (3356, 49666)), (1, (1299, 3356, 49666))) + entry("2a01:5e00::/32", (0, (3356, (1, 2))))


@pytest.fixture
def dumps(tmp_path):
    for name, data in (("rrc00/bview.gz", gzip.compress(table())), ("rv2/rib.bz2", bz2.compress(table()))):
        (tmp_path / name).parent.mkdir()
        (tmp_path / name).write_bytes(data)
    return tmp_path


def test_table_dumps(spark, dumps):
    rows = mrt.read(spark, f"{dumps}/*/*").orderBy("collector", "seq").collect()
    assert [(r.collector, r.seq, r.type, r.peer_asn, r.peer_address, r.prefix, r.as_path) for r in rows[:3]] == [
        ("rrc00", 0, "R", 3356, "192.0.2.1", "5.22.192.0/18", "3356 49666"),
        ("rrc00", 1, "R", 1299, "2001:db8::1", "5.22.192.0/18", "1299 3356 49666"),
        ("rrc00", 2, "R", 3356, "192.0.2.1", "2a01:5e00::/32", "3356 {1,2}"),
    ]
    out = {r.prefix: r for r in visibility(mrt.as_visibility_input(mrt.read(spark, f"{dumps}/*/*")), {4: 1, 6: 1}).collect()}
    assert (out["5.22.192.0/18"].peers_seen, out["5.22.192.0/18"].origin_asn, out["5.22.192.0/18"].upstreams) == (4, 49666, "3356")
    assert out["2a01:5e00::/32"].origin_asn == -1


def elems():
    v6 = struct.pack(">HBB", 2, 1, 16) + b"\0" * 16 + b"\0" + nlri("2a01:5e00:1::/48")
    return [
        update(1, 3356, ["5.22.200.0/24"], hops=(3356, 12880)),
        update(2, 3356, ["78.170.1.0/24"], hops=(3356, 9121), as4=False),
        update(3, 3356, withdrawn=["5.22.200.0/24"]),
        update(4, 3356, ["8.8.8.0/24"], hops=(3356, 15169)),
        update(5, 3356, withdrawn=["78.170.1.0/24"]),
        update(6, 3356, hops=(3356, 49666), more=attribute(mrt.MP_REACH, v6)),
        update(7, 3356, more=attribute(mrt.MP_UNREACH, struct.pack(">HB", 2, 1) + nlri("2a01:5e00:1::/48"))),
    ]


BLOCKS = [("5.22.192.0/18", "IR"), ("2a01:5e00::/32", "IR"), ("78.160.0.0/11", "TR")]


def test_updates_become_events(spark, tmp_path):
    (tmp_path / "rrc00").mkdir()
    (tmp_path / "rrc00" / "updates.gz").write_bytes(gzip.compress(b"".join(elems())))
    out = mrt.as_events(mrt.read(spark, f"{tmp_path}/*"), spark.createDataFrame(BLOCKS, "block string, cc string")).orderBy("ts").collect()
    assert [(r.ts, r.cc, r.event, r.asn) for r in out] == [(1, "IR", "announce", 12880), (2, "TR", "announce", 9121), (3, "IR", "withdraw", 12880), (5, "TR", "withdraw", 9121), (6, "IR", "announce", 49666), (7, "IR", "withdraw", 49666)]


@pytest.mark.parametrize("cut", [1, 7, 20, 31])
def test_a_short_file_fails(spark, tmp_path, cut):
    (tmp_path / "x.mrt").write_bytes(table()[:-cut])
    with pytest.raises(Exception, match="CorruptRecord"):
        mrt.read(spark, str(tmp_path), "c").count()


def test_streams_agree_with_batches(spark, tmp_path):
    for k, e in enumerate(elems()):
        (tmp_path / f"u{k}").write_bytes(e)
    batch = mrt.read(spark, str(tmp_path), "c")
    stream = origins.attribute_stream(mrt.read_stream(spark, str(tmp_path), "c", 100).withColumn("seq", F.col("time")))
    q = stream.writeStream.format("memory").queryName("origins").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    have = sorted((r.time, r.prefix, r.asn) for r in spark.table("origins").collect())
    from sluice.functions.lists import path_origin
    from sluice.operators.sessions import attribute_withdrawals

    want = attribute_withdrawals(batch, path_origin(F.col("as_path")), origins.SESSION, ("time",))
    assert have == sorted((r.time, r.prefix, r.asn) for r in want.collect()) and len(have) == 7


def test_flaps_are_decided_in_the_stream(spark, tmp_path):
    schema = "peer_address string, peer_asn long, prefix string, time long, seq long, type string"
    first = [("x", 1, "p", 100, 0, "W"), ("x", 1, "p", 150, 1, "A"), ("x", 1, "p", 300, 2, "W"), ("x", 1, "q", 100, 3, "W"), ("x", 1, "q", 120, 4, "W")]
    for k, rows in enumerate((first, [("x", 1, "z", 100_000, 9, "A")], [("x", 1, "z", 100_001, 10, "A")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
        events = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        q = origins.flap_stream(events, 60, "0 seconds").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
    out = sorted((r.prefix, r.time, r.is_flap) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert out == [("p", 100, True), ("p", 300, False), ("q", 100, False), ("q", 120, False)]


def test_delegations(spark):
    text = """2|apnic|20260101|9|x|y|+0
# comment
apnic|*|asn|*|1|summary
ripencc|IR|asn|64496|3|20200101|allocated|o1
ripencc|TR|asn|1|1|20200101|allocated|o2
ripencc|IR|ipv4|5.22.192.0|6144|20200101|assigned|o1
ripencc|IR|ipv4|10.0.0.0|65536|20200101|allocated|o1
ripencc|IR|ipv4|11.0.0.0|256|20200101|reserved|o1
ripencc|IR|ipv6|2a01:5e00::|32|20200101|allocated|o1"""
    rows = registries.delegation_rows(spark.createDataFrame([(x,) for x in text.splitlines()], "value string"), "IR")
    assert sorted(r.asn for r in registries.delegated_asns(rows).collect()) == [64496, 64497, 64498]
    assert sorted(r.prefix for r in registries.delegated_prefixes(rows).collect()) == ["10.0.0.0/16", "2a01:5e00::/32", "5.22.192.0/20", "5.22.208.0/21"]


def test_organisations(spark, tmp_path):
    lines = [{"type": "ASN", "asn": "1", "organizationId": "O1", "name": "own"}, {"type": "Organization", "organizationId": "O1", "name": "Old"}, {"type": "Organization", "organizationId": "O1", "name": "Org"}, {"type": "ASN", "asn": "2", "organizationId": "O2", "name": "Second"}, {"type": "ASN", "asn": "3", "organizationId": ""}]
    (tmp_path / "a.jsonl.gz").write_bytes(gzip.compress("\n".join(map(json.dumps, lines)).encode()))
    out = registries.as_organisations(spark, str(tmp_path / "a.jsonl.gz"))
    assert sorted((r.asn, r.org_name) for r in out.collect()) == [(1, "Org"), (2, "Second"), (3, "")]
    page = spark.createDataFrame([('<a href="20250101.x.gz"> <a href="20260101.x.gz">',)], "value string")
    assert registries.latest_listed(page, r'href="((\d{8})\.x\.gz)"').first().file == "20260101.x.gz"
    assert registries.codes(spark, {}).count() == 0


def test_signals(spark):
    nested = json.dumps({"data": [[{"from": 0, "step": 300, "datasource": "ping", "values": [1.0, None, 3.0]}, {"from": 0, "datasource": "x", "values": [1]}]]})
    flat = json.dumps({"data": [{"from": 600, "step": 300, "datasource": "ping", "values": [9.0, 4.0]}]})
    docs = spark.createDataFrame([("asn", "1", 0, nested), ("asn", "1", 1, flat), ("asn", "2", 0, "{}")], "entity_type string, entity_code string, chunk int, doc string")
    out = signals.first_of_each(signals.normalise(docs))
    assert sorted((r.ts, r.value) for r in out.collect()) == [(0, 1.0), (300, None), (600, 3.0), (900, 4.0)]
    doc = json.dumps({"data": {"by_origin": [{"prefixes": [{"timelines": [{"starttime": "1970-01-01T00:00:10", "endtime": "1970-01-01T00:01:00"}]}]}, {}]}})
    out = signals.active_periods(spark.createDataFrame([(7, doc), (8, "{}")], "asn long, doc string"))
    assert [tuple(r) for r in out.collect()] == [(7, 10, 60)]


def test_pulls_are_chunked(spark):
    asked = []

    def fake(url, params):
        asked.append((url, params["from"], params["until"], params["datasource"]))
        return {"data": [[{"from": params["from"], "step": 10, "datasource": params["datasource"], "values": [1.0, 2.0, 3.0]}]]}

    docs = signals.pull(spark, "b", "asn", "7", 0, 50, ["x", "y"], 20, 0, fake)
    assert [a[1:3] for a in asked[:3]] == [(0, 20), (20, 40), (40, 50)] and len(asked) == 6
    out = signals.first_of_each(signals.normalise(docs)).where("datasource = 'x'").orderBy("ts").collect()
    assert [(r.ts, r.value) for r in out] == [(0, 1.0), (10, 2.0), (20, 3.0), (30, 2.0), (40, 3.0), (50, 2.0), (60, 3.0)]


def test_urls():
    ts = 1_767_225_600  # 2026-01-01
    assert fetch.ris_table_url("b", "rrc00", ts) == "b/rrc00/2026.01/bview.20260101.0000.gz"
    assert fetch.ris_update_url("b", "rrc00", ts + 300) == "b/rrc00/2026.01/updates.20260101.0005.gz"
    assert fetch.routeviews_table_url("b", "route-views2", ts) == "b/bgpdata/2026.01/RIBS/rib.20260101.0000.bz2"
    assert fetch.routeviews_table_url("b", "route-views3", ts).startswith("b/route-views3/bgpdata/")
    for url, off in ((fetch.ris_table_url, 7200), (fetch.ris_update_url, 60), (fetch.routeviews_table_url, 3600)):
        with pytest.raises(ValueError):
            url("b", "c", ts + off)


def test_transfers(tmp_path):
    pauses, calls = [], []

    def fails(n):
        def action():
            calls.append(1)
            if len(calls) <= n:
                raise fetch.TransportError("x")
            return "done"

        return action

    assert fetch.retry(fails(2), 5, 60, pauses.append) == "done" and pauses == [60, 120]
    with pytest.raises(ZeroDivisionError):
        fetch.retry(lambda: 1 / 0, sleep=pauses.append)
    calls.clear()
    with pytest.raises(fetch.TransportError):
        fetch.retry(fails(9), 3, 1, lambda _: None)
    calls.clear()
    assert fetch.with_fallback([fails(2), lambda: "second"], 2, 1, lambda _: None) == "second"
    assert fetch.with_fallback([fails(99)], 1) is None
    dest = tmp_path / "d" / "f"
    with pytest.raises(RuntimeError):
        fetch.atomic_write(dest, lambda p: (p.write_text("half"), (_ for _ in ()).throw(RuntimeError()))[0])
    assert list(dest.parent.iterdir()) == []
    urls = [str(k) for k in range(20)]

    def get(url):
        p = tmp_path / url
        p.write_text(url)
        return p

    most, seen = 0, []
    for p in fetch.in_order(urls, get, 4):
        most = max(most, len([x for x in tmp_path.iterdir() if x.is_file()]))
        seen.append(p.read_text())
    assert seen == urls and most <= 5 and not [x for x in tmp_path.iterdir() if x.is_file()]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "ts long, v string")
    sinks.write_table(df, f"{tmp_path}/t", "ts")
    sinks.write_table(df.where("ts = 2").withColumn("v", F.lit("c")), f"{tmp_path}/t", "ts")
    assert sorted((r.ts, r.v) for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [(1, "a"), (2, "c")]
    assert [r.ts for r in sinks.remaining(spark.createDataFrame([(2,), (3,)], "ts long"), f"{tmp_path}/t", "ts").collect()] == [3]
    assert sinks.remaining(df, f"{tmp_path}/none", "ts").count() == 2
    sinks.write_frozen(df, f"{tmp_path}/f")
    with pytest.raises(Exception, match="already exists"):
        sinks.write_frozen(df, f"{tmp_path}/f")
    sinks.write_with_provenance(df, f"{tmp_path}/p", {"x": 1})
    assert json.loads((tmp_path / "p.meta.json").read_text()) == {"x": 1}
    with pytest.raises(FileExistsError):
        sinks.write_with_provenance(df, f"{tmp_path}/p", {})
    with pytest.raises(ValueError, match="letters"):
        sinks.macro_lines({"a1": "x"})
    with pytest.raises(ValueError, match="end"):
        sinks.macro_lines({"endOf": "x"})
    assert sinks.macro_lines({"darkShare": "1\\%"}) == "\\newcommand{\\darkShare}{1\\%}\n"
    row = spark.range(1).select(sinks.formatted("percent", F.lit(0.0575)).alias("p"), sinks.formatted("number", F.lit(1234567.0)).alias("n"), sinks.formatted("hours", F.lit(5400)).alias("h"), sinks.formatted("date", F.lit(1_767_225_600)).alias("d")).first()
    assert tuple(row) == ("5.75\\%", "1,234,567", "1.5", "1 January 2026")


def test_config():
    c = Config.from_dict({"phases": {"P0": [0, 10]}, "event_windows": {"onset": [5, 6]}, "peers_total_min": 9})
    assert c.window("onset") == Window("onset", 5, 6) and c.peers_total_min == 9
    with pytest.raises(KeyError, match="onset"):
        c.window("nope")
