"""Queries of this subpackage over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import alignment, collocations, decontaminate, htmltext, imatch, jaccard, licences, mixing, packing, pii, sharding, toxicity, warc
from .common import checkpoint_dir, cut, table

QUERIES, ORACLE_SQL = {}, {}

ORACLE_SQL["op1_warc"] = """
    WITH p AS (
        SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, ''))) AS n FROM pages
    ), m AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS top FROM p)
    SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
           CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to,
           CAST(1 AS INTEGER) AS n_requests
    FROM m
"""

ORACLE_SQL["op11_collocations"] = """
    WITH p AS (
        SELECT doc_id, coalesce(lang, 'und') AS lang,
               unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
        FROM documents
    ), w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
    g AS (
        SELECT lang, k, unnest([list_slice(w, i, i + k - 1) FOR i IN range(1, len(w) - k + 2)]) AS ws
        FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k
    ), f AS (SELECT lang, k, ws, CAST(count(*) AS HUGEINT) AS n FROM g GROUP BY ALL),
    sizes AS (SELECT lang, sum(n) AS n FROM f WHERE k = 1 GROUP BY lang),
    c AS (SELECT lang, k, ws, n AS a, unnest(range(1, k)) AS cut FROM f WHERE k > 1 AND n >= 10),
    s AS (
        SELECT c.*, x.n AS l, y.n AS r, 1000000 * a * a // (x.n * y.n) AS score
        FROM c JOIN f x ON x.lang = c.lang AND x.ws = c.ws[:c.cut] JOIN f y ON y.lang = c.lang AND y.ws = c.ws[c.cut + 1:]
        QUALIFY row_number() OVER (PARTITION BY c.lang, c.ws ORDER BY score, c.cut) = 1
    ), inside AS (
        SELECT lang, part, max(a) AS longer
        FROM (SELECT lang, a, unnest([ws[1:2], ws[2:3]]) AS part FROM s WHERE k = 3) GROUP BY lang, part
    ), kept AS (
        SELECT s.*, array_to_string(ws, ' ') AS phrase FROM s LEFT JOIN inside i ON i.lang = s.lang AND i.part = s.ws
        WHERE NOT coalesce(100 * longer >= 50 * a, false)
    ), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
    SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(sizes.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
    FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    flat = cut(warc.assemble(warc.read_records(spark, path, payloads=False)))
    warc.remove(spark, path)
    return warc.captures(flat).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "n_requests")


@query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.sanitise(table(spark, sf_dir, "documents")).drop("sanitised")


@query
def op3_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_row")


@query
def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


@query
def op9_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compare(table(spark, sf_dir, "documents"))


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query
def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
