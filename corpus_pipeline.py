"""A corpus from raw documents: clean, deduplicate, decontaminate, mix, shard.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. Its rows are written as Parquet and read again as the
next one's docs, so a lost executor costs no finished stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import decontaminate, jaccard, mixing, sharding, toxicity
from sluice.llm.common import checkpoint_dir, cut, table
from sluice.llm.warc import remove


#: Columns that stages read. All others travel as one, so that none can clash with a column of a stage.
READ = ("doc_id", "text", "lang", "source", "n_chars")
REST = "rest\u00b7"


def _apart(docs: DataFrame) -> DataFrame:
    """`docs` with its other columns in one."""
    rest = [c for c in docs.columns if c not in READ]
    own = [F.col(c) for c in READ if c in docs.columns]
    return docs.select(*own, F.struct(*[F.col(f"`{c}`") for c in rest]).alias(REST)) if rest else docs


def _whole(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of `docs`, as they were."""
    return rows.select(*[F.col(c) if c in READ else F.col(REST)[c].alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold. The model learns from the labels of those given.

    Null and empty texts are scored as texts without words; rows that repeat an id are scored each by its own text. An empty table stays empty. Columns stay as they are.
    """
    scored = toxicity.toxicity(_apart(docs), table(spark, sf_dir, "labels"))
    return _whole(scored.where("predicted = 0"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked by similarity; of several rows with that id one.

    Texts without words are linked with nothing, so all of them stay; an id that is null comes last. Columns stay as they are.
    """
    return _whole(jaccard.deduplicate(_apart(docs)), docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark. Null and empty texts hold none; rows that repeat an id are judged each by its own text. Columns stay as they are."""
    return _whole(decontaminate.decontaminate(_apart(docs), table(spark, sf_dir, "benchmark")), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it: its source's whole epochs, and one more if it is sampled.

    A null source is a source. Texts without words have size 0, and their copies follow their key. Rows equal in id and text are told apart by their place. Columns stay as they are.
    """
    mixed = mixing.mix(_apart(docs)).where("copies > 0")
    return _whole(mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs)


def put_in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and slot. Null texts have a size of 8 bytes, as empty ones. Of the columns given, those called like one that is added are left out."""
    out = sharding.shard(_apart(docs))
    added = [c for c in out.columns if c not in (*docs.columns, REST)]
    clash = [c for c in out.columns if c in docs.columns and c not in READ]
    kept = [c for c in docs.columns if c not in clash]
    return out.select(*[F.col(c) if c in READ else F.col(REST)[c].alias(c) for c in kept], *clash, *added)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", put_in_shards),
]

#: The classifier, the hashes and the sampled keys have no counterpart in DuckDB.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`; what lies between them is in the shared checkpoint folder until the result is there."""
    docs, base = table(spark, sf_dir, "documents"), f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    try:
        for k, (_, stage) in enumerate(STAGES[:-1]):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
            docs = spark.read.parquet(f"{base}/{k}")
        return cut(STAGES[-1][1](spark, docs, sf_dir))
    finally:
        remove(spark, base)
