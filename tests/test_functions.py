import ipaddress
import random

from pyspark.sql import functions as F

from sluice.functions import lists, net, timegrid


def test_prefixes_parse_as_the_standard_library_does(spark):
    r = random.Random(1)
    good = [f"{ipaddress.IPv4Address(r.getrandbits(32))}/{r.randint(0, 32)}" for _ in range(150)]
    good += [f"{ipaddress.IPv6Address(r.getrandbits(128) & r.choice([-1, (1 << 64) - 1, ((1 << 40) - 1) << 88]))}/{r.randint(0, 128)}" for _ in range(150)]
    good += ["::/0", "::1", "2a01:5e00::/32", "10.0.0.1"]
    bad = ["", "1.2.3", "1.2.3.4/33", "300.1.1.1/8", "::/129", "g::/8", "1.2.3.4/x", "1:2:3/10", "1.2.3.4/8/8", None]
    rows = spark.createDataFrame([(p,) for p in good + bad], "p string").select("p", net.parse_prefix(F.col("p")).alias("x")).collect()
    for row in rows:
        if row.p in bad:
            assert row.x is None, row.p
        else:
            e = ipaddress.ip_network(row.p, strict=False)
            assert (row.x.family, ((row.x.hi % 2**64) << 64) | (row.x.lo % 2**64), row.x.plen) == (e.version, int(e.network_address), e.prefixlen)


def test_cover_is_minimal(spark):
    r = random.Random(2)
    ranges = [(r.getrandbits(32) >> r.randint(0, 8), r.randint(1, 1 << r.randint(0, 20))) for _ in range(200)] + [(0, 2**32), (2**32 - 1, 1), (ipaddress.IPv4Address("5.22.192.0")._ip, 6144)]
    ranges = [(s, min(n, 2**32 - s)) for s, n in ranges]
    rows = spark.createDataFrame(ranges, "s long, n long").select("s", "n", net.cidr_cover(F.col("s"), F.col("n")).alias("c")).collect()
    for row in rows:
        want = ipaddress.summarize_address_range(ipaddress.IPv4Address(row.s), ipaddress.IPv4Address(row.s + row.n - 1))
        assert [(c.addr, c.plen) for c in row.c] == [(int(w.network_address), w.prefixlen) for w in want]


def test_grids_are_half_open_and_round_up(spark):
    assert [r.ts for r in timegrid.grid(spark, 1, 57_600, 28_800).collect()] == [28_800]
    assert timegrid.grid(spark, 10, 5, 5).count() == 0
    one = spark.range(1).select(timegrid.grid_array(F.lit(5).cast("long"), F.lit(3).cast("long"), 1).alias("a"), timegrid.grid_array(F.lit(0).cast("long"), F.lit(600).cast("long"), 300).alias("b")).first()
    assert one.a == [] and one.b == [0, 300]
    assert [tuple(r) for r in timegrid.chunks(spark, 0, 425, 90).collect()] == [(0, 90), (90, 180), (180, 270), (270, 360), (360, 425)]


def test_iso_both_ways(spark):
    row = spark.createDataFrame([("2026-01-08T00:00:00Z",), ("2026-01-08 00:00:00",)], "s string").select(timegrid.from_iso(F.col("s")).alias("t"), timegrid.to_iso(timegrid.from_iso(F.col("s"))).alias("s"))
    assert [tuple(r) for r in row.collect()] == [(1_767_830_400, "2026-01-08T00:00:00Z")] * 2


def test_near_grid(spark):
    rows = spark.createDataFrame([(28_800 - 3600,), (28_800 + 3600,), (28_800 + 3601,), (14_400,)], "t long").select(timegrid.near_grid(F.col("t"), 28_800, 3600).alias("g")).collect()
    assert [r.g for r in rows] == [28_800, 28_800, None, None]


def test_paths_and_lists(spark):
    df = spark.createDataFrame([("3356 12880",), ("1 12880 12880",), ("7 {1,2}",), ("9",), ("",)], "p string")
    rows = df.select(lists.path_origin(F.col("p")).alias("o"), lists.path_upstream(F.col("p")).alias("u")).collect()
    assert [tuple(r) for r in rows] == [(12880, 3356), (12880, 12880), (None, 7), (9, None), (None, None)]
    df = spark.createDataFrame([("10,9,9",), ("",)], "p string")
    rows = df.select(lists.list_size(F.col("p")).alias("n"), lists.join_numbers(F.transform(lists.split_list(F.col("p")), lambda x: x.cast("long"))).alias("s")).collect()
    assert [tuple(r) for r in rows] == [(3, "9,10"), (0, "")]
    assert spark.createDataFrame([("foo_bar-9x",)], "p string").select(lists.camel(F.col("p"))).first()[0] == "FooBar9x"
