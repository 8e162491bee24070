"""Signal documents of an outage API, and routing-history documents."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.functions.timegrid import from_iso

from .fetch import get_json

_SERIES = "struct<`from`:bigint,step:bigint,datasource:string,`values`:array<double>>"
_HISTORY = "struct<data:struct<by_origin:array<struct<prefixes:array<struct<timelines:array<struct<starttime:string,endtime:string>>>>>>>>"


def pull(spark: SparkSession, base: str, entity_type: str, code: str, start: int, end: int, names: list[str], most: int, pause: float = 1.0, fetch: Callable[..., dict] = get_json) -> DataFrame:
    """Documents (entity_type, entity_code, chunk, doc) of an entity: each signal in chunks of at most `most` seconds, with a pause after each request."""
    rows = []
    for name in names:
        for at in range(start, end, most):
            doc = fetch(f"{base}/signals/raw/{entity_type}/{code}", {"from": at, "until": min(at + most, end), "datasource": name})
            rows.append((entity_type, code, len(rows), json.dumps(doc)))
            time.sleep(pause)
    return spark.createDataFrame(rows, "entity_type string, entity_code string, chunk int, doc string")


def normalise(docs: DataFrame) -> DataFrame:
    """(ts, entity_type, entity_code, datasource, value, chunk) from documents (entity_type, entity_code, chunk, doc).

    `data` holds lists of series, or series; ts = from + i * step. Null values stay null, which is not 0; a series without from or step is skipped.
    """
    nested = F.from_json("doc", f"struct<data:array<array<{_SERIES}>>>")["data"]
    flat = F.from_json("doc", f"struct<data:array<{_SERIES}>>")["data"]
    series = F.concat(F.coalesce(F.flatten(nested), F.array().cast(f"array<{_SERIES}>")), F.coalesce(flat, F.array().cast(f"array<{_SERIES}>")))
    rows = docs.select("entity_type", "entity_code", "chunk", F.explode(series).alias("s")).where("s.`from` IS NOT NULL AND s.step IS NOT NULL")
    rows = rows.select("*", F.posexplode("s.values").alias("i", "value"))
    return rows.select((F.col("s.from") + F.col("i") * F.col("s.step")).alias("ts"), "entity_type", "entity_code", F.coalesce("s.datasource", F.lit("")).alias("datasource"), "value", "chunk")


def first_of_each(rows: DataFrame) -> DataFrame:
    """One row per (entity, ts, datasource), that of the earliest chunk: chunks share their edges."""
    order = Window.partitionBy("entity_type", "entity_code", "ts", "datasource").orderBy("chunk")
    return rows.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k", "chunk")


def active_periods(docs: DataFrame) -> DataFrame:
    """(asn, start, end) from routing-history documents (asn, doc); missing levels give no rows."""
    rows = docs.select("asn", F.explode(F.from_json("doc", _HISTORY)["data"]["by_origin"]).alias("o"))
    rows = rows.select("asn", F.explode("o.prefixes").alias("p")).select("asn", F.explode("p.timelines").alias("t"))
    return rows.select("asn", from_iso(F.col("t.starttime")).alias("start"), from_iso(F.col("t.endtime")).alias("end"))
