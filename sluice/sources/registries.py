"""Delegation files, AS-to-organisation files and hand-kept tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.net import cover_rows, v4_text
from sluice.sources.sinks import exists

#: The statuses under which a registry's row is in use.
IN_USE = ("allocated", "assigned")


def delegation_rows(lines: DataFrame, cc: str | None = None) -> DataFrame:
    """Lines (`value`) of extended delegation files as (registry, cc, type, start, count, date, status, org). Comments, headers, summaries, short lines and rows not in use go."""
    f = F.split(F.trim("value"), r"\|")
    rows = lines.where(~F.trim("value").startswith("#")).where(F.size(f) >= 7)
    part = lambda k: F.get(f, F.lit(k))
    out = rows.select(part(0).alias("registry"), part(1).alias("cc"), part(2).alias("type"), part(3).alias("start"), part(4).try_cast("long").alias("count"), part(5).alias("date"), part(6).alias("status"), part(7).alias("org"))
    out = out.where(F.col("status").isin(*IN_USE) & F.col("count").isNotNull())
    return out if cc is None else out.where(F.col("cc") == cc)


def delegated_asns(rows: DataFrame) -> DataFrame:
    """(cc, asn, status, date, org): ranges are expanded."""
    first = F.col("start").cast("long")
    return rows.where("type = 'asn' AND count > 0").select("cc", F.explode(F.sequence(first, first + F.col("count") - 1)).alias("asn"), "status", "date", "org")


def _v4(text: Column) -> Column:
    return F.aggregate(F.split(text, r"\."), F.lit(0).cast("long"), lambda acc, q: acc * 256 + q.cast("long"))


def delegated_prefixes(rows: DataFrame) -> DataFrame:
    """(cc, prefix, family, status, date, org): IPv4 counts become minimal covers; for IPv6 the count is the prefix length."""
    v4 = cover_rows(rows.where("type = 'ipv4'").withColumn("_from", _v4(F.col("start"))), "_from", "count")
    v4 = v4.select("cc", v4_text(F.col("addr"), F.col("plen")).alias("prefix"), F.lit(4).alias("family"), "status", "date", "org")
    v6 = rows.where("type = 'ipv6'").select("cc", F.concat("start", F.lit("/"), F.col("count").cast("string")).alias("prefix"), F.lit(6).alias("family"), "status", "date", "org")
    return v4.unionByName(v6)


def delegations(spark: SparkSession, path: str, cc: str | None = None) -> DataFrame:
    return delegation_rows(spark.read.text(path), cc)


def as_organisations(spark: SparkSession, path: str) -> DataFrame:
    """(asn, org_name) from JSON lines that mix organisations and ASes in any order: the organisation's name, else the AS's own, else "". Of repeated keys the last counts."""
    schema = "type string, organizationId string, name string, asn string"
    lines = spark.read.text(path).select(F.from_json("value", schema).alias("r"), F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()).alias("at")).select("r.*", "at")
    org = lines.where("type = 'Organization'").groupBy("organizationId").agg(F.max_by(F.coalesce("name", F.lit("")), "at").alias("org"))
    own = lines.where("type = 'ASN' AND asn IS NOT NULL").groupBy(F.col("asn").cast("long").alias("asn")).agg(
        F.max_by(F.coalesce("organizationId", F.lit("")), "at").alias("organizationId"), F.max_by("name", F.when(F.nullif("name", F.lit("")).isNotNull(), F.col("at"))).alias("own")
    )
    return own.join(org, "organizationId", "left").select("asn", F.coalesce(F.nullif("org", F.lit("")), F.nullif("own", F.lit("")), F.lit("")).alias("org_name"))


def latest_listed(pages: DataFrame, pattern: str) -> DataFrame:
    """One row (file): of the links in `value` that match `pattern` (group 1 the file, group 2 a date), the one with the latest date."""
    files, dates = F.regexp_extract_all("value", F.lit(pattern), F.lit(1)), F.regexp_extract_all("value", F.lit(pattern), F.lit(2))
    pairs = pages.select(F.explode(F.arrays_zip(files.alias("f"), dates.alias("d"))).alias("x"))
    return pairs.agg(F.max_by(F.col("x")["f"], F.col("x")["d"]).alias("file"))


def dimension(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with a header; empty fields are null."""
    return spark.read.schema(schema).csv(path, header=True)


def codes(spark: SparkSession, by_country: dict[str, list[int]]) -> DataFrame:
    """{cc: [asn]} as rows (cc, asn); an empty mapping gives no rows."""
    return spark.createDataFrame([(cc, int(a)) for cc, asns in by_country.items() for a in asns], "cc string, asn long")


def dimension_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As `dimension`; without the file, a table without rows."""
    return dimension(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)
