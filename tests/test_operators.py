import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sluice.operators import asof, bands, calibration, comparison, lpm, phases, quality, registry, restoration, rollup, sessions, states, visibility
from sluice.operators.bands import Window


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def got(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


BLOCKS = [("5.22.192.0/18", "IR"), ("91.98.0.0/15", "IR"), ("2a01:5e00::/32", "IR"), ("78.160.0.0/11", "TR")]


def test_longest_match(spark):
    blocks = frame(spark, BLOCKS, "block string, cc string")
    seen = ["5.22.192.0/18", "5.22.200.0/24", "91.99.32.0/19", "2a01:5e00:1234::/48", "8.8.8.0/24", "5.0.0.0/8", "nonsense"]
    out = lpm.match_longest(frame(spark, [(s,) for s in seen], "prefix string"), blocks, keep=("cc",))
    assert {r.prefix: r.block for r in out.collect()} == dict(zip(seen, ["5.22.192.0/18", "5.22.192.0/18", "91.98.0.0/15", "2a01:5e00::/32", None, None, None], strict=True))


def test_longest_of_nested_blocks(spark):
    blocks = frame(spark, [("10.0.0.0/8",), ("10.1.0.0/16",)], "block string")
    out = lpm.match_longest(frame(spark, [("10.1.2.0/24",), ("10.2.0.0/24",)], "prefix string"), blocks)
    assert got(out) == [("10.1.2.0/24", "10.1.0.0/16"), ("10.2.0.0/24", "10.0.0.0/8")]


def test_orphans_and_overlaps_are_errors(spark):
    blocks = frame(spark, BLOCKS, "block string, cc string")
    with pytest.raises(Exception, match="outside every block"):
        lpm.map_to_blocks(frame(spark, [("8.8.8.0/24",)], "prefix string"), blocks).collect()
    fine = frame(spark, [*BLOCKS, BLOCKS[0]], "prefix string, cc string")
    lpm.require_disjoint(fine)
    with pytest.raises(ValueError, match="overlap"):
        lpm.require_disjoint(fine.union(frame(spark, [("5.22.200.0/24", "TR")], "prefix string, cc string")))


def stack_rollup(observed):
    """Independent check: every address of a small block by its most specific announcement."""
    size, best = 256, {}
    for start, plen, v in observed:
        for a in range(start, start + (1 << (8 - plen))):
            if a not in best or best[a][0] < plen:
                best[a] = (plen, v)
    return sum(v for _, v in best.values()) / size


def test_rollup_against_addresses(spark):
    r = random.Random(3)
    rows, want = [], {}
    for ts in range(60):
        seen = {}
        for _ in range(r.randint(1, 9)):
            plen = r.randint(0, 8)
            seen[(r.randrange(1 << plen) << (8 - plen), plen)] = round(r.random(), 2)
        rows += [(ts, f"10.0.0.{a}/{24 + k}", v) for (a, k), v in seen.items()]
        want[ts] = stack_rollup([(a, k, v) for (a, k), v in seen.items()])
    out = rollup.rollup_visibility(frame(spark, rows, "ts long, prefix string, visibility double"), frame(spark, [("10.0.0.0/24",)], "block string"))
    have = {x.ts: x.visibility_weighted for x in out.collect()}
    assert have == pytest.approx(want)


@pytest.mark.parametrize(
    ("seen", "want"),
    [
        ([("5.22.0.0/16", 0.75)], 0.75),
        ([("5.22.1.0/24", 1.0)], 1 / 256),
        ([("5.22.0.0/16", 0.9), ("5.22.1.0/24", 1.0)], (1 - 1 / 256) * 0.9 + 1 / 256),
        ([("5.22.0.0/17", 0.9), ("5.22.0.0/19", 0.95), ("5.22.0.0/22", 1.0)], None),
    ],
)
def test_rollup_cases(spark, seen, want):
    block = "5.22.0.0/17" if want is None else "5.22.0.0/16"
    want = (1 - 1 / 4) * 0.9 + (1 / 4 - 1 / 32) * 0.95 + 1 / 32 if want is None else want
    out = rollup.rollup_visibility(frame(spark, [(1, p, v) for p, v in seen], "ts long, prefix string, visibility double"), frame(spark, [(block,)], "block string")).first()
    assert out.visibility_weighted == pytest.approx(want) and out.n_observed == len(seen) and out.visibility_max == max(v for _, v in seen)


def test_asof_is_merge_asof(spark):
    r = random.Random(4)
    left = pd.DataFrame([(k, r.randrange(200)) for k in range(3) for _ in range(40)], columns=["asn", "ts"]).drop_duplicates().sort_values("ts")
    right = pd.DataFrame([(k, t, r.random() if r.random() < 0.7 else None) for k in range(2) for t in r.sample(range(200), 30)], columns=["asn", "ts", "value"]).sort_values("ts")
    want = pd.merge_asof(left, right.dropna(), on="ts", by="asn")
    right = right.astype(object).where(right.notna(), None)
    readings = frame(spark, [tuple(x) for x in right.values.tolist()], "asn long, ts long, value double")
    for width in (None, 7, 60):
        out = asof.asof_backward(frame(spark, left.values.tolist(), "asn long, ts long"), readings, ["asn"], "value", width=width).toPandas()
        both = out.merge(want, on=["asn", "ts"])
        assert len(out) == len(both) == len(left) and (both["value_x"].fillna(-1) == both["value_y"].fillna(-1)).all()


def test_state_boundaries(spark):
    rows = [(0.49, None, None), (0.5, None, None), (0.9, 20.0, 100.0), (0.9, 19.9, 100.0), (0.9, None, 100.0), (0.9, 1.0, None), (0.9, 1.0, 0.0), (0.49, 0.0, 100.0)]
    df = frame(spark, [(k, *r) for k, r in enumerate(rows)], "k int, v double, p double, b double")
    out = df.select("k", states.state(F.col("v"), F.col("p"), F.col("b"), 0.5, 0.2).alias("s")).orderBy("k")
    assert [r.s for r in out.collect()] == ["withdrawn", "reachable", "reachable", "dark", "reachable", "reachable", "reachable", "withdrawn"]


def test_timeline_densifies_and_excludes(spark):
    vis = frame(spark, [(1000, "a", 49666, 0.9), (1000, "b", 12880, 0.95), (2000, "b", 12880, 0.94)], "ts long, prefix string, origin_asn long, visibility double")
    sig = frame(spark, [(900, 12880, 100.0), (1500, 12880, 1.0), (1600, 12880, None)], "ts long, asn long, value double")
    ref = frame(spark, [(t, 12880, 100.0) for t in range(10)] + [(t, 49666, 0.0) for t in range(9)] + [(9, 49666, 100.0)], "ts long, asn long, value double")
    out = states.state_timeline(vis, sig, ref)
    assert got(out, "ts", "asn", "visibility", "probing", "state") == sorted([(1000, 12880, 0.95, 100.0, "reachable"), (2000, 12880, 0.94, 1.0, "dark"), (1000, 49666, 0.9, None, "reachable"), (2000, 49666, 0.0, None, "withdrawn")], key=str)
    base = states.probing_baseline(ref, "asn", 0.5, 5.0)
    assert got(states.exclusions(base, vis.select(F.col("origin_asn").alias("asn")))) == [(49666, 0.1, 0.0)]


def test_controls(spark):
    ref = frame(spark, [(t, 1, 100.0) for t in range(10)], "ts long, asn long, value double")
    sig = frame(spark, [(0, 1, 100.0), (150, 1, 1.0)], "ts long, asn long, value double")
    grid = frame(spark, [(100,), (200,)], "ts long")
    shares = states.control_dark_shares(states.control_dark_rows(grid, sig, ref, 0.2), 0.5)
    assert got(shares) == [(100, 1, 0.0, False), (200, 1, 1.0, True)]
    with pytest.raises(ValueError, match="no control"):
        states.require_rows(states.control_dark_rows(grid, sig, ref.where("asn = 2"), 0.2), "control observations")


def ups(spark, rows):
    return frame(spark, [(t, k, e, "p", "IR" if len(r) < 2 else r[1], 1, r[0]) for k, (t, e, *r) in enumerate(rows)], "ts long, seq long, event string, prefix string, cc string, asn long, peer_asn long").replace({"A": "announce", "W": "withdraw"}, subset="event")


def test_gaps_and_flaps(spark):
    one = ups(spark, [(100, "W", 2), (160, "A", 2)])
    assert [r.gap_s for r in sessions.reannounce_gaps(one).collect()] == [60]
    assert [r.is_flap for r in sessions.flag_flaps(one, 60).where("event = 'withdraw'").collect()] == [True]
    assert [r.is_flap for r in sessions.flag_flaps(one, 59).where("event = 'withdraw'").collect()] == [False]
    assert sessions.reannounce_gaps(ups(spark, [(100, "W", 2), (110, "A", 3)])).count() == 0
    twice = ups(spark, [(100, "W", 2), (105, "A", 2), (200, "W", 2), (260, "A", 2)])
    assert sorted(r.gap_s for r in sessions.reannounce_gaps(twice).collect()) == [5, 60]
    assert sorted(r.ts for r in sessions.drop_flaps(ups(spark, [(100, "W", 2), (105, "A", 2), (200, "W", 2)]), 60).collect()) == [105, 200]
    assert [r.is_flap for r in sessions.flag_flaps(ups(spark, [(1, "W", 2), (2, "W", 2), (3, "A", 2)]), 60).orderBy("seq").collect()] == [False, True, False]
    assert sessions.population_events(ups(spark, [(1, "W", 2, "TR"), (1, "W", 2, None)])).count() == 1
    assert sessions.population_events(one.drop("cc")).count() == 2
    assert got(sessions.flap_variants(twice, [5, 60])) == [(5, 2, 1), (60, 2, 2)]


def test_withdrawals_take_the_last_origin(spark):
    r = random.Random(5)
    rows, last, want = [], {}, []
    for seq in range(400):
        key, kind = r.randrange(4), r.choice("AAW")
        origin = r.choice([None, 1, 2, 3]) if kind == "A" else None
        if kind == "A":
            last[key] = -1 if origin is None else origin
        rows.append((seq, seq // 3, kind, key, 1, "p", origin))
        want.append((seq, last.get(key, -1)))
    df = frame(spark, rows, "seq long, ts long, type string, peer_address long, peer_asn long, prefix string, origin long")
    assert sorted((x.seq, x.asn) for x in sessions.attribute_withdrawals(df, F.col("origin")).collect()) == want


def test_speed(spark):
    rows = [("w", t, k, e, p, 1, 2) for k, (p, t, e) in enumerate([("a", 100, "withdraw"), ("a", 150, "announce"), ("a", 300, "withdraw"), ("b", 360, "withdraw"), ("c", 5, "announce")])]
    df = frame(spark, [*rows, ("quiet", 1, 99, "announce", "a", 1, 2)], "window string, ts long, seq long, event string, prefix string, asn long, peer_asn long")
    first, = restoration.event_speed(df).collect()
    assert (first.t_first, first.n_prefixes_withdrawn, first.duration_s) == (100, 2, 260)
    assert restoration.event_speed(sessions.drop_flaps(df, 60)).first().t_first == 300
    late = frame(spark, [("w", 1000 + k, k, "withdraw", str(k)) for k in range(20)] + [("w", 100_000, 99, "withdraw", "z")], "window string, ts long, seq long, event string, prefix string")
    one = restoration.event_speed(late).first()
    assert one.duration_s > 90_000 and one.duration_p5_p95_s < 100
    wave = restoration.wave_timing(late.union(frame(spark, [("w", 5, 100, "withdraw", "0")], late.schema)), 1000).first()
    assert (wave.n_prefixes, wave.t_min) == (21, 1000)


def test_restoration(spark):
    seen = [(t, "5.22.0.0/16", 1.0) for t in (0, 100, 200)] + [(400, "5.22.0.0/17", 1.0), (500, "5.22.0.0/16", 1.0)]
    blocks = frame(spark, [("5.22.0.0/16",), ("6.0.0.0/16",)], "block string")
    rolled = rollup.rollup_visibility(frame(spark, [*seen, (500, "6.0.0.0/16", 0.5)], "ts long, prefix string, visibility double"), blocks)
    owners = frame(spark, [("5.22.0.0/16", 9), ("5.22.0.0/16", 7), ("5.22.0.0/16", 9), ("6.0.0.0/16", 3), ("6.0.0.0/16", 2)], "block string, asn long")
    out = {r.block: r for r in restoration.restoration_events(rolled, owners, Window("P0", 0, 300), Window("P4", 400, 600)).collect()}
    a, b = out["5.22.0.0/16"], out["6.0.0.0/16"]
    assert (a.asn, a.restoration_ts_p50, a.restoration_ts_p80, a.restoration_ts, a.p0_baseline_mean) == (9, 400, 500, 400, 1.0)
    assert a.steady_state_ratio == pytest.approx(0.75)
    assert (b.asn, b.p0_baseline_mean, b.restoration_ts, b.steady_state_ratio) == (2, 0.0, None, None)
    none = restoration.restoration_events(rolled, owners, Window("P0", 10, 20), Window("P4", 400, 600)).first()
    assert none.p0_baseline_mean is None and none.restoration_ts is None
    cls = frame(spark, [(9, "isp"), (2, "")], "asn long, type string")
    by = {r.type: r for r in restoration.restoration_by_type(restoration.restoration_events(rolled, owners, Window("P0", 0, 300), Window("P4", 400, 600)), cls, 400).collect()}
    assert by["isp"].n_never_restored == 0 and by["unclassified"].n_never_restored == 1


def test_phases(spark):
    windows = [Window("a", 0, 10), Window("b", 10, 20), Window("c", 20, 30)]
    df = frame(spark, [(0, "dark"), (9, "reachable"), (10, "withdrawn"), (30, "dark")], "ts long, state string")
    assert got(phases.state_shares(df, windows)) == [("a", 0.5, 0.0, 2), ("b", 0.0, 1.0, 1), ("c", None, None, None)]
    assert bands.shifted(windows, "a", 3)[:2] == [Window("a", 0, 13), Window("b", 13, 20)]
    with pytest.raises(ValueError, match="last"):
        bands.shifted(windows, "c", 1)
    with pytest.raises(KeyError):
        bands.shifted(windows, "x", 1)
    assert got(phases.snapshot_trajectory(df, [0, 5])) == [(0, 1.0, 0.0, 1), (5, None, None, 0)]
    over = [Window("a", 0, 10), Window("b", 5, 10)]
    assert [r.p for r in df.where("ts = 9").select(bands.assign(F.col("ts"), over).alias("p")).collect()] == ["b"]
    changed = frame(spark, [(0, True), (11, False)], "ts long, changed boolean")
    sweep = {(r.shift, r.phase): r.dark_share for r in phases.boundary_sweep(df, changed, windows, "a", [0, -5]).collect()}
    assert sweep[(0, "a")] == 0.5 and sweep[(-5, "a")] == 1.0 and sweep[(-5, "c")] is None
    by = frame(spark, [(0, "isp", 1.0, 9), (1, "isp", 0.0, 1)], "ts long, type string, visibility_mean double, n_prefixes long")
    assert phases.type_means(by, windows).where("phase = 'a'").first().isp == 0.5


def test_calibration(spark):
    def hist(counts):
        return frame(spark, [(k, k / 10, (k + 1) / 10, c) for k, c in enumerate(counts)], "bin int, bin_lo double, bin_hi double, count long")

    a = calibration.find_valley(hist([50, 40, 0, 0, 0, 0, 0, 0, 30, 60]), 0.2, 0.8).first()
    assert (a.valley_lo, a.valley_hi, a.method) == (0.2, 0.8, "empty")
    b = calibration.find_valley(hist([50, 40, 5, 3, 4, 6, 3, 5, 30, 60]), 0.2, 0.8).first()
    assert (b.valley_lo, b.valley_hi, b.min_count, b.method) == (0.3, 0.7, 3, "sparsest")
    h = calibration.histogram(frame(spark, [(0.0,), (0.1,), (0.3,), (1.0,), (0.29999999,)], "v double"), "v", 10).orderBy("bin")
    edges = [k * 0.1 for k in range(10)]
    want = [sum(1 for v in (0.0, 0.1, 0.3, 1.0, 0.29999999) if v >= edges[k] and (v < (edges[k + 1] if k < 9 else 2))) for k in range(10)]
    assert [r["count"] for r in h.collect()] == want
    sweep = frame(spark, [(0.1, 0.0), (0.2, 0.005), (0.3, 0.02)], "ratio double, false_dark_rate double")
    assert calibration.largest_ratio_under(sweep, 0.01).first().ratio == 0.2
    assert calibration.largest_ratio_under(sweep, 0.0).first().ratio is None
    readings = frame(spark, [(1, 10.0, 100.0), (2, 90.0, 100.0)], "asn long, probing double, baseline double")
    assert got(calibration.dark_ratio_sweep(readings, [0.1, 0.2])) == [(0.1, 2, 2, 0.0), (0.2, 2, 2, 0.5)]


def test_agreement(spark):
    codes = [("a", "a")] * 20 + [("a", "b")] * 5 + [("b", "a")] * 10 + [("b", "b")] * 15
    assert comparison.kappa(frame(spark, codes, "x string, y string"), "x", "y").first().kappa == pytest.approx(0.4)
    assert comparison.kappa(frame(spark, [("a", "a")], "x string, y string"), "x", "y").first().kappa == 1.0
    with pytest.raises(Exception, match="uncoded"):
        comparison.kappa(frame(spark, [("a", None)], "x string, y string"), "x", "y").collect()
    two, one = frame(spark, [(1,), (1,)], "asn long"), frame(spark, [(1,), (2,)], "asn long")
    with pytest.raises(ValueError, match="repeats"):
        comparison.coded_pairs(two, one)
    with pytest.raises(ValueError, match="no proposal"):
        comparison.coded_pairs(frame(spark, [(1,)], "asn long"), one)


def test_periods_are_closed_and_merge(spark):
    r = random.Random(6)
    periods = [(k, s, s + r.randrange(9)) for k in range(3) for s in (r.randrange(100) for _ in range(12))]
    points = [(k, t) for k in range(4) for t in range(110)]
    out = comparison.active_at(frame(spark, points, "asn long, ts long"), frame(spark, periods, "asn long, start long, end long"))
    assert {(x.asn, x.ts): x.active for x in out.collect()} == {(k, t): any(a == k and s <= t <= e for a, s, e in periods) for k, t in points}


def test_cross_check_and_runs(spark):
    s = "ts long, value double"
    check = lambda a, b: comparison.cross_check(frame(spark, a, s), frame(spark, b, s), ["ts"]).count()
    assert check([(1, 1.0)], [(1, 1.0)]) == 0 and check([(1, None)], [(1, None)]) == 0 and check([(1, 1.0)], [(2, 2.0)]) == 0
    assert check([(1, 1.0)], [(1, 2.0)]) == 1 and check([(1, None)], [(1, 2.0)]) == 1
    out = comparison.run_differences(frame(spark, [(1, 1.0), (2, 2.0), (4, None)], s), frame(spark, [(2, 2.5), (3, 1.0), (4, None)], s), ["ts"], ["value"])
    assert got(out) == [("differs", 2), ("extra", 1), ("missing", 3)]


def test_registry(spark):
    rows = [("asn", "o1", 9121, None), ("asn", "o1", 5, None), ("asn", "o2", 7, None), ("ipv4", "o1", None, "78.160.0.0/11"), ("ipv6", "o1", None, "2a02:e0::/29"), ("ipv4", "o2", None, "1.0.0.0/8")]
    df = frame(spark, rows, "type string, org string, asn long, prefix string").withColumn("family", F.lit(4)).withColumn("cc", F.lit("TR"))
    out = registry.org_blocks(df, frame(spark, [(9121,)], "asn long"))
    assert got(out, "prefix", "org_asns") == [("2a02:e0::/29", [9121]), ("78.160.0.0/11", [9121])]
    asns = frame(spark, [("a", 64510, "s", 2), ("a", 64500, "b", 0), ("a", 64501, "b", 1), ("a", 64600, "n", 3)], "cc string, asn long, org string, seq long")
    ranked = registry.rank_by_space(asns, frame(spark, [("b", 65_536), ("s", 256)], "org string, size long"))
    assert [(r.asn, r.space) for r in ranked.orderBy("rank").collect()] == [(64500, 65_536), (64501, 65_536), (64510, 256), (64600, 0)]
    good = registry.top_adequate(ranked.withColumn("adequate", F.col("asn") != 64501), 3, 2)
    assert [r.asn for r in good.orderBy("place").collect()] == [64500, 64510]
    old = frame(spark, [(1, "", "isp", "n1"), (2, "Kept", "gov", "n2"), (9, "Gone", "x", "")], "asn long, org_name string, type string, notes string")
    new = frame(spark, [(1, "Filled"), (2, "Other"), (3, "New")], "asn long, org_name string")
    assert [tuple(r) for r in registry.merge_classification(old, new).collect()] == [(1, "Filled", "isp", "n1"), (2, "Kept", "gov", "n2"), (3, "New", "", ""), (9, "Gone", "x", "")]


def test_lists_of_asns_are_made_once_for_each_organisation(spark):
    rows = [("asn", "o1", k, None) for k in (30, 5, 9)] + [("asn", "o2", 7, None)] + [("ipv4", f"o{1 + k % 2}", None, f"10.{k}.0.0/16") for k in range(200)]
    df = frame(spark, rows, "type string, org string, asn long, prefix string").withColumn("family", F.lit(4)).withColumn("cc", F.lit("TR"))
    made = spark.sparkContext.accumulator(0)

    def named(asns):
        made.add(1)
        return ",".join(map(str, asns))

    out = registry.org_blocks(df, frame(spark, [(5,), (7,), (30,)], "asn long"), F.udf(named, "string").asNondeterministic()).collect()
    assert len(out) == 200 and {(r.org, r.org_asns) for r in out} == {("o1", "5,30"), ("o2", "7")} and made.value == 2


def test_quality(spark):
    s = "k string, ts long"
    regular = frame(spark, [("a", t) for t in range(0, 3000, 300)], s)
    one = quality.native_steps(regular, ["k"], 0, 3000).first()
    assert (one.step, one.n_irregular, one.starts_late, one.ends_early) == (300, 0, False, False)
    assert quality.native_steps(regular.where("ts <> 900"), ["k"], 0, 3000).first().n_irregular == 0
    assert quality.native_steps(regular.union(frame(spark, [("a", 1450)], s)), ["k"], 0, 3000).first().n_irregular == 2
    assert quality.native_steps(regular.where("ts > 0"), ["k"], 0, 3000).first().starts_late
    assert quality.native_steps(regular.where("ts < 2400"), ["k"], 0, 3000).first().ends_early
    assert quality.native_steps(frame(spark, [("a", 1)], s), ["k"]).count() == 0
    assert quality.n_duplicates(regular.union(frame(spark, [("a", 900)], s)), ["k", "ts"]).first()[0] == 1
    assert got(quality.missing_keys(frame(spark, [(1,), (2,)], "x long"), frame(spark, [(2,), (3,)], "x long"), ["x"])) == [(1, "missing"), (3, "extra")]
    assert [r.gap_s for r in quality.time_gaps(frame(spark, [(0,), (28_800,), (90_000,)], "ts long"), 28_800).collect()] == [61_200]
    snap = [(1, 4, 50, '{"rv":{"ipv4":50,"ipv6":29}}'), (1, 6, 29, '{"rv":{"ipv4":50,"ipv6":29}}'), (2, 4, 49, '{"rv":{"ipv4":50,"ipv6":29}}'), (3, 4, 50, "{}"), (3, 4, 51, "{}")]
    out = quality.snapshot_problems(frame(spark, snap, "ts long, family int, peers_total int, collector_fullfeed string"))
    assert got(out) == [(2, "peers_total is not the audit's sum"), (3, "uneven peers_total")]


def test_visibility(spark):
    rows = []
    for peer in range(3):
        for p in range(3 if peer < 2 else 1):
            rows.append((0, "rv", peer, "x", f"10.{p}.0.0/16", 4, 100 + p, 7 - peer))
    df = frame(spark, [*rows, (0, "rv", 2, "x", "10.9.0.0/16", 4, None, None)], "ts long, collector string, peer_asn long, peer_address string, prefix string, family int, origin long, upstream long")
    out = {r.prefix: r for r in visibility.visibility(df, {4: 3, 6: 1}).collect()}
    assert (out["10.0.0.0/16"].peers_seen, out["10.0.0.0/16"].peers_total, out["10.0.0.0/16"].visibility, out["10.0.0.0/16"].upstreams) == (2, 2, 1.0, "5,6,7")
    assert (out["10.9.0.0/16"].peers_seen, out["10.9.0.0/16"].visibility, out["10.9.0.0/16"].origin_asn) == (0, 0.0, -1)
    by = visibility.fullfeed_by_collector(visibility.full_feed_peers(df, {4: 3, 6: 1}))
    assert got(by) == [(0, "rv", 2, 0)]
    assert visibility.audit_json(by).first().collector_fullfeed == '{"rv":{"ipv4":2,"ipv6":0}}'
    visibility.require_collectors(by, frame(spark, [("rv",)], "collector string"))
    with pytest.raises(ValueError, match="rrc"):
        visibility.require_collectors(by, frame(spark, [("rv",), ("rrc",)], "collector string"))


def test_snapshots(spark):
    df = frame(spark, [(1, "a", 4, 40, "IR"), (1, "b", 6, 3, None), (2, "a", 4, None, "IR")], "ts long, prefix string, family int, peers_total int, cc string")
    assert got(visibility.drop_degraded(df, 15), "ts", "prefix") == [(1, "a"), (2, "a")]
    assert got(visibility.degraded_cells(df, 15)) == [(1, 6)]
    assert got(visibility.stamp_fullfeed(df), "ts", "prefix", "ff_v4", "ff_v6") == [(1, "a", 40, 3), (1, "b", 40, 3), (2, "a", 0, 0)]
    assert got(visibility.consolidate(df), "prefix", "cc", "ff_v6") == [("a", "IR", 0), ("a", "IR", 3), ("b", "IR", 3)]


def test_upstreams(spark):
    df = frame(spark, [(1, 5, "3356,1299"), (2, 5, "3356"), (2, 5, ""), (1, -1, "9")], "ts long, origin_asn long, upstreams string")
    out = sessions.transitions(visibility.upstream_sets(df)).orderBy("ts").collect()
    assert [(r.upstreams, r.n_upstreams, r.changed) for r in out] == [("1299,3356", 2, False), ("3356", 1, True)]


def test_bimodality_uses_shared_instants(spark):
    s = "ts long, visibility double"
    out = calibration.bimodality({"x": frame(spark, [(1, 0.2), (1, 0.9), (2, 0.5)], s), "y": frame(spark, [(1, 0.0)], s)})
    assert got(out) == [("x", 2, 0.5, 0.5, 0.5), ("y", 1, 0.0, 1.0, 0.0)]
