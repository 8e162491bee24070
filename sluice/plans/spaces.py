"""Queries on prefixes, blocks, registries and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.functions.net import cover_rows, parse_prefix, size_of, v4_text
from sluice.functions.timegrid import seconds
from sluice.operators import calibration, comparison, lpm, quality, registry, restoration, rollup, visibility
from sluice.operators.bands import Window

from .adapters import CLASS_SQL, MONTH, PREFIX_SQL, blocks, classification, prefixes, query, rounded, table, text_sql

BEFORE = Window("before", 788_918_400, 820_454_400)
AFTER = Window("after", 883_612_800, 946_684_800)


def _search_blocks(spark, sf_dir):
    rows = prefixes(spark, sf_dir).where("plen IN (16, 18, 20)")
    return rows.select(F.col("prefix").alias("block")).distinct()


_SEARCH = f"p AS {PREFIX_SQL}, b AS (SELECT DISTINCT addr, plen, prefix AS block FROM p WHERE plen IN (16, 18, 20)), up AS (SELECT p.prefix, k, p.addr - p.addr % (1 << (32 - k)) AS a FROM (SELECT DISTINCT prefix, addr, plen FROM p) p CROSS JOIN (VALUES (16), (18), (20)) AS x(k) WHERE k <= p.plen), best AS (SELECT up.prefix, arg_max(b.block, b.plen) AS block FROM up JOIN b ON b.addr = up.a AND b.plen = up.k GROUP BY up.prefix)"


@query(f"WITH {_SEARCH} SELECT p.seq, p.prefix, best.block FROM p LEFT JOIN best ON best.prefix = p.prefix")
def lpm_match(spark, sf_dir):
    return lpm.match_longest(prefixes(spark, sf_dir).select("seq", "prefix"), _search_blocks(spark, sf_dir))


@query(f"WITH p AS {PREFIX_SQL}, t AS (SELECT DISTINCT prefix, addr, plen, CASE WHEN seq % 2 = 0 THEN 'A' ELSE 'B' END AS cc FROM p), up AS (SELECT t.*, k, addr - addr % (1 << (32 - k)) AS a FROM t CROSS JOIN (SELECT DISTINCT plen AS k FROM t) WHERE k <= plen) SELECT x.prefix, x.cc, y.prefix AS other, y.cc AS other_tag FROM up x JOIN t y ON y.plen = x.k AND y.addr = x.a AND x.cc <> y.cc")
def population_overlaps(spark, sf_dir):
    rows = prefixes(spark, sf_dir).select("prefix", F.when(F.col("seq") % 2 == 0, "A").otherwise("B").alias("cc"))
    return lpm.overlaps(rows)


_ROLLUP = f"""p AS {PREFIX_SQL}, own AS (SELECT ts, block, addr, plen, max(visibility) AS v, count(*) AS k FROM p GROUP BY ALL),
    up AS (SELECT o.ts, o.block, o.addr, o.plen, len, o.addr - o.addr % (1 << (32 - len)) AS a FROM own o CROSS JOIN (SELECT unnest(generate_series(16, 23)) AS len) WHERE len < o.plen),
    parent AS (SELECT up.ts, up.block, up.addr, up.plen, arg_max(own.v, own.plen) AS vp FROM up JOIN own ON own.ts = up.ts AND own.block = up.block AND own.addr = up.a AND own.plen = up.len GROUP BY ALL),
    rolled AS (SELECT o.ts, o.block, 4 AS family, max(o.v) AS visibility_max, CAST(sum(o.k) AS BIGINT) AS n_observed, sum(power(2.0, 16 - o.plen) * (o.v - coalesce(q.vp, 0))) AS visibility_weighted
        FROM own o LEFT JOIN parent q ON q.ts = o.ts AND q.block = o.block AND q.addr = o.addr AND q.plen = o.plen GROUP BY o.ts, o.block)"""


def _rolled(spark, sf_dir):
    return rollup.rollup_visibility(prefixes(spark, sf_dir).select("ts", "prefix", "visibility"), blocks(spark, sf_dir))


@query(f"WITH {_ROLLUP} SELECT ts, block, CAST(family AS INTEGER) AS family, visibility_max, n_observed, round(visibility_weighted, 12) AS visibility_weighted FROM rolled")
def block_rollup(spark, sf_dir):
    return rounded(_rolled(spark, sf_dir), "visibility_weighted", to=12)


@query("SELECT l_partkey, CAST(l_suppkey AS BIGINT) AS l_suppkey FROM (SELECT l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY count(*) DESC, l_suppkey) AS k FROM lineitem GROUP BY l_partkey, l_suppkey) WHERE k = 1")
def dominant_origin(spark, sf_dir):
    return restoration.dominant(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


_OWNER = "owner AS (SELECT block, asn FROM (SELECT block, asn, row_number() OVER (PARTITION BY block ORDER BY count(*) DESC, asn) AS k FROM p GROUP BY block, asn) WHERE k = 1)"
_RESTORED = f"""{_ROLLUP}, dense AS (SELECT b.block, t.ts, coalesce(r.visibility_weighted, 0.0) AS v FROM (SELECT DISTINCT block FROM rolled) b CROSS JOIN (SELECT DISTINCT ts FROM rolled) t LEFT JOIN rolled r ON r.block = b.block AND r.ts = t.ts),
    base AS (SELECT block, avg(v) AS m FROM dense WHERE ts >= {BEFORE.start} AND ts < {BEFORE.end} GROUP BY block), {_OWNER},
    restored AS (SELECT d.block, any_value(b.m) AS p0_baseline_mean, {', '.join(f"min(CASE WHEN ts >= {AFTER.start} AND b.m > 0 AND v >= {t} * b.m THEN ts END) AS restoration_ts_p{round(t * 100)}" for t in (0.25, 0.5, 0.8))},
        avg(CASE WHEN ts >= {AFTER.start} AND ts < {AFTER.end} THEN v END) AS steady_state_visibility FROM dense d LEFT JOIN base b ON b.block = d.block GROUP BY d.block)"""


def _owners(spark, sf_dir):
    return prefixes(spark, sf_dir).select("block", "asn")


def _restored(spark, sf_dir):
    return restoration.restoration_events(_rolled(spark, sf_dir), _owners(spark, sf_dir), BEFORE, AFTER)


_RATIO = "CASE WHEN p0_baseline_mean > 0 THEN steady_state_visibility / p0_baseline_mean END"


@query(f"WITH {_RESTORED} SELECT r.block, o.asn, round(p0_baseline_mean, 12) AS p0_baseline_mean, restoration_ts_p25, restoration_ts_p50, restoration_ts_p80, restoration_ts_p50 AS restoration_ts, round(steady_state_visibility, 12) AS steady_state_visibility, round({_RATIO}, 6) AS steady_state_ratio FROM restored r LEFT JOIN owner o ON o.block = r.block")
def restoration_events(spark, sf_dir):
    out = rounded(_restored(spark, sf_dir), "p0_baseline_mean", "steady_state_visibility", to=12)
    return rounded(out, "steady_state_ratio", to=6)


@query(f"""WITH {_RESTORED}, j AS (SELECT r.*, coalesce(nullif(c.type, ''), 'unclassified') AS type, restoration_ts_p50 - {AFTER.start} AS delay, {_RATIO} AS ratio FROM restored r LEFT JOIN owner o ON o.block = r.block LEFT JOIN {CLASS_SQL} c ON c.asn = o.asn)
    SELECT type, count(DISTINCT block) AS n_blocks, count(delay) AS n_restored, round(median(delay), 6) AS delay_median, round(avg(delay), 6) AS delay_mean, round(median(ratio), 6) AS ratio_median, count(DISTINCT block) - count(delay) AS n_never_restored FROM j GROUP BY type""")
def restoration_by_type(spark, sf_dir):
    out = restoration.restoration_by_type(_restored(spark, sf_dir), classification(spark, sf_dir), AFTER.start)
    return rounded(out, "delay_median", "delay_mean", "ratio_median", to=6)


@query(f"""WITH p AS {PREFIX_SQL}, {_OWNER}, o AS (SELECT block, min(ts) AS t FROM p WHERE seq % 2 = 0 AND seq % 5 <> 0 AND ts >= {AFTER.start} GROUP BY block),
    j AS (SELECT coalesce(nullif(c.type, ''), 'unclassified') AS type, o.t - {AFTER.start} AS delay FROM o LEFT JOIN owner w ON w.block = o.block LEFT JOIN {CLASS_SQL} c ON c.asn = w.asn)
    SELECT type, count(*) AS n, round(median(delay), 6) AS delay_median, round(avg(delay), 6) AS delay_mean, round(quantile_cont(delay, 0.1), 6) AS delay_p10, round(quantile_cont(delay, 0.9), 6) AS delay_p90 FROM j GROUP BY type""")
def restoration_order_by_type(spark, sf_dir):
    rows = prefixes(spark, sf_dir)
    feed = rows.select("ts", "prefix", F.when(F.col("seq") % 2 == 0, "announce").otherwise("withdraw").alias("event"), F.when(F.col("seq") % 5 == 0, "TR").otherwise("IR").alias("cc"))
    order = restoration.fine_restoration_order(feed, blocks(spark, sf_dir), AFTER.start)
    out = restoration.restoration_order_by_type(order, restoration.dominant(rows, "block", "asn"), classification(spark, sf_dir), AFTER.start)
    return rounded(out, "delay_median", "delay_mean", "delay_p10", "delay_p90", to=6)


_HIST = """edges AS (SELECT CAST(k AS INTEGER) AS bin, k * 0.005 AS bin_lo, CASE WHEN k = 199 THEN 1.0 ELSE (k + 1) * 0.005 END AS bin_hi FROM (SELECT CAST(unnest(generate_series(0, 199)) AS DOUBLE) AS k)),
    vals AS (SELECT l_discount * 7 + (l_orderkey % 31) / 100.0::DOUBLE AS v FROM lineitem),
    hist AS (SELECT e.bin, e.bin_lo, e.bin_hi, count(v) AS "count" FROM edges e LEFT JOIN vals ON v >= bin_lo AND (v < bin_hi OR (bin = 199 AND v <= bin_hi)) GROUP BY ALL)"""


def _hist(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 7 + (F.col("l_orderkey") % 31) / F.lit(100.0)).alias("v"))
    return calibration.histogram(rows, "v", 200)


@query(f'WITH {_HIST} SELECT bin, round(bin_lo, 9) AS bin_lo, round(bin_hi, 9) AS bin_hi, "count", round("count" / (sum("count") OVER () * (bin_hi - bin_lo)), 6) AS density FROM hist')
def histogram_density(spark, sf_dir):
    return rounded(rounded(calibration.density(_hist(spark, sf_dir)), "bin_lo", "bin_hi"), "density", to=6)


@query(f"""WITH {_HIST}, band AS (SELECT * FROM hist WHERE bin_lo >= 0.2 AND bin_hi <= 0.8), e AS (SELECT *, bin - row_number() OVER (ORDER BY bin) AS g FROM band WHERE "count" = 0),
    runs AS (SELECT min(bin_lo) AS valley_lo, max(bin_hi) AS valley_hi, CAST(0 AS BIGINT) AS min_count, 'empty' AS method, 0 AS r, count(*) AS w, min(bin) AS f FROM e GROUP BY g ORDER BY w DESC, f LIMIT 1),
    sparse AS (SELECT min(bin_lo), max(bin_hi), min("count"), 'sparsest', 1, 0, 0 FROM band WHERE "count" = (SELECT min("count") FROM band) HAVING count(*) > 0)
    SELECT round(valley_lo, 9) AS valley_lo, round(valley_hi, 9) AS valley_hi, min_count, method FROM (SELECT * FROM runs UNION ALL SELECT * FROM sparse) ORDER BY r LIMIT 1""")
def histogram_valley(spark, sf_dir):
    return rounded(calibration.find_valley(_hist(spark, sf_dir), 0.2, 0.8), "valley_lo", "valley_hi")


_SERIES = "o AS (SELECT epoch_us(o_orderdate) // 86400000000 AS ts, CAST(o_orderkey % 101 AS DOUBLE) / 100 AS visibility FROM orders), l AS (SELECT epoch_us(l_shipdate) // 86400000000 AS ts, l_discount * 10 AS visibility FROM lineitem)"


@query(f"WITH {_SERIES}, s AS (SELECT ts FROM o INTERSECT SELECT ts FROM l), a AS (SELECT 'orders' AS series, * FROM o WHERE ts IN (FROM s) UNION ALL SELECT 'lines', * FROM l WHERE ts IN (FROM s)) SELECT series, count(*) AS n, " + ", ".join(f"round(avg(CASE WHEN {c} THEN 1.0 ELSE 0 END), 9) AS {n}" for n, c in (("ambiguous_share", "visibility BETWEEN 0.2 AND 0.8"), ("near_zero_share", "visibility <= 0.2"), ("near_one_share", "visibility >= 0.8"))) + " FROM a GROUP BY series")
def bimodality_summary(spark, sf_dir):
    day = lambda c: F.floor(seconds(F.col(c)) / 86_400)
    orders = table(spark, sf_dir, "orders").select(day("o_orderdate").alias("ts"), ((F.col("o_orderkey") % 101).cast("double") / 100).alias("visibility"))
    lines = table(spark, sf_dir, "lineitem").select(day("l_shipdate").alias("ts"), (F.col("l_discount") * 10).alias("visibility"))
    return rounded(calibration.bimodality({"orders": orders, "lines": lines}), "ambiguous_share", "near_zero_share", "near_one_share")


@query("WITH m AS (SELECT date_trunc('month', o_orderdate) AS month, o_orderpriority AS type, avg(o_totalprice) AS m FROM orders GROUP BY ALL) SELECT CAST(epoch_us(month) // 1000000 AS BIGINT) AS month, round(min(m), 4) AS lo, round(max(m), 4) AS hi FROM m GROUP BY month")
def monthly_band(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(seconds(F.col("o_orderdate")).alias("ts"), F.col("o_orderpriority").alias("type"), F.col("o_totalprice").alias("v"))
    return rounded(calibration.monthly_band(rows, "v").withColumn("month", F.unix_seconds("month")), "lo", "hi", to=4)


@query("SELECT n_nationkey AS cc, c_custkey AS asn, org, space, rank FROM (SELECT c_nationkey AS n_nationkey, c_custkey, org, space, row_number() OVER (PARTITION BY c_nationkey ORDER BY space DESC, f, c_custkey) AS rank FROM (SELECT c.*, 'o' || CAST(c_custkey % 40 AS VARCHAR) AS org, coalesce(s.space, 0) AS space, min(c_custkey) OVER (PARTITION BY c_nationkey, c_custkey % 40) AS f FROM customer c LEFT JOIN (SELECT s_suppkey % 40 AS o, CAST(sum(s_suppkey % 5) AS BIGINT) AS space FROM supplier GROUP BY 1) s ON s.o = c_custkey % 40)) ")
def org_rank(spark, sf_dir):
    return _ranked(spark, sf_dir)


def _ranked(spark, sf_dir):
    org = lambda c: F.concat(F.lit("o"), (F.col(c) % 40).cast("string")).alias("org")
    asns = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("cc"), F.col("c_custkey").alias("asn"), org("c_custkey"), F.col("c_custkey").alias("seq"))
    space = table(spark, sf_dir, "supplier").select(org("s_suppkey"), (F.col("s_suppkey") % 5).alias("size"))
    return registry.rank_by_space(asns, space).select("cc", "asn", "org", "space", "rank")


@query("WITH r AS (SELECT c_nationkey AS cc, c_custkey AS asn, c_acctbal > 2000 AS adequate, row_number() OVER (PARTITION BY c_nationkey ORDER BY space DESC, f, c_custkey) AS rank FROM (SELECT c.*, coalesce(s.space, 0) AS space, min(c_custkey) OVER (PARTITION BY c_nationkey, c_custkey % 40) AS f FROM customer c LEFT JOIN (SELECT s_suppkey % 40 AS o, sum(s_suppkey % 5) AS space FROM supplier GROUP BY 1) s ON s.o = c_custkey % 40)) SELECT cc, asn, rank, place FROM (SELECT *, row_number() OVER (PARTITION BY cc ORDER BY rank) AS place FROM r WHERE rank <= 40 AND adequate) WHERE place <= 10")
def org_rank_topn(spark, sf_dir):
    good = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("asn"), (F.col("c_acctbal") > 2000).alias("adequate"))
    return registry.top_adequate(_ranked(spark, sf_dir).join(good, "asn")).select("cc", "asn", "rank", "place")


@query("SELECT coalesce(c.asn, s.asn) AS asn, coalesce(nullif(c.n, ''), s.n, c.n, '') AS org_name, CASE WHEN c.asn IS NULL THEN '' ELSE c.t END AS type, CASE WHEN c.asn IS NULL THEN '' ELSE 'kept' END AS notes FROM (SELECT c_custkey AS asn, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END AS n, c_mktsegment AS t FROM customer) c FULL JOIN (SELECT s_suppkey * 31 AS asn, s_name AS n FROM supplier) s USING (asn)")
def registry_merge(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("asn"), F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.col("c_name")).alias("org_name"), F.col("c_mktsegment").alias("type"), F.lit("kept").alias("notes"))
    new = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 31).alias("asn"), F.col("s_name").alias("org_name"))
    return registry.merge_classification(old, new)


@query("WITH a AS (SELECT s_suppkey AS org, 64000 + s_suppkey AS asn FROM supplier WHERE s_suppkey % 3 = 0), held AS (SELECT org % 10 AS org, array_to_string(list_sort(list(DISTINCT asn)), ',') AS org_asns FROM a GROUP BY 1) SELECT 'c' || CAST(c_custkey AS VARCHAR) AS prefix, CAST(c_custkey % 15 AS BIGINT) AS org, org_asns FROM customer JOIN held ON held.org = c_custkey % 15")
def org_blocks(spark, sf_dir):
    asns = table(spark, sf_dir, "supplier").select(F.lit("asn").alias("type"), (F.col("s_suppkey") % 10).alias("org"), (F.col("s_suppkey") + 64_000).alias("asn"), F.lit(None).cast("string").alias("prefix"), F.lit(None).cast("int").alias("family"), F.lit("IR").alias("cc"))
    nets = table(spark, sf_dir, "customer").select(F.lit("ipv4").alias("type"), (F.col("c_custkey") % 15).alias("org"), F.lit(None).cast("long").alias("asn"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("prefix"), F.lit(4).alias("family"), F.lit("IR").alias("cc"))
    frozen = asns.where("(asn - 64000) % 3 = 0").select("asn")
    text = lambda held: F.array_join(F.transform(held, lambda a: a.cast("string")), ",")
    return registry.org_blocks(asns.unionByName(nets), frozen, text).select("prefix", "org", "org_asns")


_CELLS = "(SELECT (epoch_us(l_shipdate) // 1000000) - (epoch_us(l_shipdate) // 1000000) % 2592000 AS ts, CASE WHEN l_orderkey % 3 = 0 THEN 6 ELSE 4 END AS family, CASE WHEN l_orderkey % 11 > 0 THEN l_quantity END AS peers_total, l_orderkey, l_linenumber FROM lineitem)"


def _cells(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        (seconds(F.col("l_shipdate")) - seconds(F.col("l_shipdate")) % MONTH).alias("ts"), F.when(F.col("l_orderkey") % 3 == 0, 6).otherwise(4).alias("family"),
        F.when(F.col("l_orderkey") % 11 > 0, F.col("l_quantity")).alias("peers_total"), "l_orderkey", "l_linenumber",
    )


@query(f"SELECT ts, CAST(family AS INTEGER) AS family, peers_total, l_orderkey, l_linenumber, coalesce(max(CASE WHEN family = 4 THEN peers_total END) OVER (PARTITION BY ts), 0) AS ff_v4, coalesce(max(CASE WHEN family = 6 THEN peers_total END) OVER (PARTITION BY ts), 0) AS ff_v6 FROM {_CELLS} WHERE peers_total >= 15 OR peers_total IS NULL")
def degraded_cells(spark, sf_dir):
    return visibility.stamp_fullfeed(visibility.drop_degraded(_cells(spark, sf_dir), 15))


@query("SELECT o_orderkey, p.asn, p.ts, EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey % 50 = p.asn AND p.ts BETWEEN epoch_us(l_shipdate) // 86400000000 AND epoch_us(l_shipdate) // 86400000000 + l_orderkey % 4) AS active FROM (SELECT o_orderkey, o_custkey % 50 AS asn, epoch_us(o_orderdate) // 86400000000 AS ts FROM orders) p")
def interval_stab(spark, sf_dir):
    day = lambda c: F.floor(seconds(F.col(c)) / 86_400)
    points = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("asn"), day("o_orderdate").alias("ts"))
    periods = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50).alias("asn"), day("l_shipdate").alias("start"), (day("l_shipdate") + F.col("l_orderkey") % 4).alias("end"))
    return comparison.active_at(points, periods)


_LINES = "(SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity, max(l_tax) AS l_tax FROM lineitem GROUP BY l_orderkey, l_linenumber)"


def _lines(spark, sf_dir):
    """One row per order line number: the driver's table repeats some."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"), F.max("l_tax").alias("l_tax"))


@query(f"WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM {_LINES} WHERE l_orderkey % 7 > 0), b AS (SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_tax END AS l_tax FROM {_LINES} WHERE l_orderkey % 5 > 0) SELECT * FROM (SELECT CASE WHEN b.l_quantity IS NULL THEN 'extra' WHEN a.l_quantity IS NULL THEN 'missing' WHEN a.l_tax IS DISTINCT FROM b.l_tax THEN 'differs' END AS kind, coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, coalesce(a.l_linenumber, b.l_linenumber) AS l_linenumber FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber) WHERE kind IS NOT NULL")
def run_equivalence(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    theirs = rows.where("l_orderkey % 5 > 0").withColumn("l_tax", F.when(F.col("l_orderkey") % 13 > 0, F.col("l_tax")))
    return comparison.run_differences(rows.where("l_orderkey % 7 > 0"), theirs, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_tax"])


@query(f"SELECT l_orderkey, l_linenumber, a, b FROM (SELECT l_orderkey, l_linenumber, l_tax AS a, CASE WHEN l_orderkey % 9 = 0 THEN l_tax + 0.001 WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_tax END AS b FROM {_LINES}) WHERE NOT ((a IS NULL AND b IS NULL) OR coalesce(abs(a - b) <= 1e-6, false))")
def cross_check(spark, sf_dir):
    rows = _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", F.col("l_tax").alias("value"))
    key = F.col("l_orderkey")
    other = rows.withColumn("value", F.when(key % 9 == 0, F.col("value") + 0.001).when(key % 10 == 0, None).otherwise(F.col("value")))
    return comparison.cross_check(rows, other, ["l_orderkey", "l_linenumber"])


@query("SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return quality.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_suppkey"])


@query(f"""WITH r AS (SELECT o_orderkey, 167772160 + (o_orderkey * 977) % 4000000000 AS s, 1 + (o_orderkey * 7919) % 5000 AS n FROM orders),
    k AS (SELECT CAST(unnest(generate_series(0, 13)) AS INTEGER) AS k), c AS (SELECT DISTINCT o_orderkey, s, s + n AS e, k, unnest([((s + (1 << k) - 1) >> k) << k, (((s + n) >> k) << k) - (1 << k)]) AS a FROM r CROSS JOIN k)
    SELECT o_orderkey, {text_sql('a', '32 - k')} AS prefix FROM c WHERE a >= s AND a + (1 << k) <= e AND NOT ((a >> (k + 1)) << (k + 1) >= s AND ((a >> (k + 1)) << (k + 1)) + (1 << (k + 1)) <= e)""")
def cidr_cover_ranges(spark, sf_dir):
    start, count = F.lit(167_772_160) + (F.col("o_orderkey") * 977) % 4_000_000_000, 1 + (F.col("o_orderkey") * 7919) % 5000
    rows = cover_rows(table(spark, sf_dir, "orders").select("o_orderkey", start.alias("start"), count.alias("count")), "start", "count")
    return rows.select("o_orderkey", v4_text(F.col("addr"), F.col("plen")).alias("prefix"))


@query(f"SELECT seq, CAST(4 AS INTEGER) AS family, addr AS lo, plen, power(2.0, 32 - plen) AS size FROM {PREFIX_SQL}")
def prefix_bounds(spark, sf_dir):
    p = F.col("p")
    rows = prefixes(spark, sf_dir).select("seq", parse_prefix(F.col("prefix")).alias("p"))
    return rows.select("seq", p["family"].alias("family"), p["lo"].alias("lo"), p["plen"].alias("plen"), size_of(p["family"], p["plen"]).alias("size"))
