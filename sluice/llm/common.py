"""What several operators of this subpackage share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: How many keys `lookup` treats apart. A key outside them holds at most 1/HOT_KEYS of all rows.
HOT_KEYS = 256

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hide(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """`df` with its columns renamed, so that no name of an operator's own can clash, and {name: new name}."""
    new = {c: f"in{k}\u00b7" for k, c in enumerate(df.columns)}
    return df.toDF(*new.values()), new


def shown(names: dict[str, str], *besides: str) -> list[Column]:
    """The hidden columns under their names, without those called like `besides`."""
    return [F.col(h).alias(c) for c, h in names.items() if c not in besides]


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a folder of our own only where none is named and all runs in one process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return named or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder: later jobs start from files that outlive executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def whole_texts(spark: SparkSession) -> None:
    """Hand Python at most 1,000 rows and about 64 MB at once, for rows are whole texts; a session that asks for less keeps its settings.

    The settings stay, for a plan reads them when it runs.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20)):
        if not 0 < int(spark.conf.get(key).rstrip("bB")) <= most:
            spark.conf.set(key, str(most))


def lookup(left: DataFrame, right: DataFrame, key: str, weight: str, spread: Column) -> DataFrame:
    """Left join of `left` with `right` (one row per `key`), safe when one key holds a large part of `left`.

    `weight` is a column of `right` that counts the rows of `left` with that key. The HOT_KEYS keys with the
    largest counts are broadcast (a bound fixed by that constant); all other keys are joined by a shuffle in which no key holds
    more than 1/HOT_KEYS of the rows. `spread` is a column of `left` that spreads the rows already served.
    `weight` is dropped.
    """
    values = [c for c in right.columns if c not in (key, weight)]
    hot = right.orderBy(F.desc(weight), F.asc(key)).limit(HOT_KEYS).select(F.col(key).alias("_hk"), F.struct(*values).alias("_hot"))
    cold = right.select(F.col(key).alias("_ck"), F.xxhash64(key).alias("_ch"), F.struct(*values).alias("_cold"))
    out = left.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left")
    # rows already served, and those without a key, are spread; the second condition keeps them from meeting another key
    served = F.col("_hk").isNotNull() | F.col(key).isNull()
    out = out.withColumn("_jk", F.when(served, F.xxhash64(key, spread)).otherwise(F.xxhash64(key)))
    out = out.join(cold, (F.col("_jk") == F.col("_ch")) & (F.col(key) == F.col("_ck")), "left")
    got = F.coalesce(F.col("_hot"), F.col("_cold"))
    return out.select(*left.columns, *[got[v].alias(v) for v in values])


def bitmap(hashes: DataFrame, column: str, bits: int) -> bytes:
    """The set of `column`'s values modulo 2**bits as little-endian bits, built by Spark.

    At most 2**bits / 8 bytes reach the driver, whatever the number of rows.
    """
    slot = F.pmod(F.col(column), F.lit(1 << bits)) + 1
    rows = (
        hashes.where(F.col(column).isNotNull())
        .groupBy(F.bitmap_bucket_number(slot).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("part"))
        .collect()
    )
    out = bytearray((1 << bits) // 8 if bits > 15 else 4096)
    for row in rows:
        start = (row["bucket"] - 1) * 4096
        out[start : start + 4096] = row["part"]
    return bytes(out)
