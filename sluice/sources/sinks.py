"""Writing results: atomic tables, resumable units, frozen files, reports."""

from __future__ import annotations

import json
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    """`path` and all below it, on whatever file system it is."""
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def move(spark: SparkSession, old: str, new: str) -> None:
    """Rename, replacing what is at `new`: a file in one step where the file system can; a folder's former content is set aside first and comes back if that fails."""
    fs, source = _fs(spark, old)
    jvm, target, aside = spark._jvm.org.apache.hadoop.fs, _fs(spark, new)[1], f"{new}.old"
    if fs.exists(target) and fs.getFileStatus(target).isDirectory():
        kept = _fs(spark, aside)[1]
        fs.delete(kept, True)
        if not fs.rename(target, kept):
            raise OSError(f"{new} can't be replaced")
        if not fs.rename(source, target):
            fs.rename(kept, target)
            raise OSError(f"{new} can't be written")
        fs.delete(kept, True)
        return
    context = jvm.FileContext.getFileContext(source.toUri() if source.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
    options[0] = jvm.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(source), fs.makeQualified(target), options)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for what all executors share, and the checkpoint folder from now on; one of our own only where none is named and all runs in one process."""
    named, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if context.getCheckpointDir() is None:
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="shared-"))
    return named or context.getCheckpointDir()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written beside its place and renamed over what is there."""
    fs, p = _fs(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(path + ".part")
    out = fs.create(part, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    move(spark, path + ".part", path)


def write_table(df: DataFrame, path: str, partition: str | None = None, rows_per_file: int | None = None) -> None:
    """Parquet through the commit protocol: readers see all of it or nothing. With `partition`, only the partitions in `df` are replaced."""
    out = df.write.mode("overwrite")
    if rows_per_file:
        out = out.option("maxRecordsPerFile", rows_per_file)
    if partition:
        out = out.partitionBy(partition).option("partitionOverwriteMode", "dynamic")
    out.parquet(path)


def write_frozen(df: DataFrame, path: str) -> None:
    """First writer wins: an error if something is there."""
    df.write.mode("errorifexists").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A small result as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_with_provenance(df: DataFrame, path: str, facts: dict, force: bool = False) -> None:
    """CSV with a sidecar `path`.meta.json; refuses to replace unless forced."""
    spark = df.sparkSession
    if exists(spark, path) and not force:
        raise FileExistsError(f"{path} is there; force to replace it")
    write_text(spark, f"{path}.meta.json", json.dumps(facts, indent=2, sort_keys=True))  # first: a table never stands without it
    write_csv(df, path)


def remaining(expected: DataFrame, path: str, key: str) -> DataFrame:
    """Units (`key`) without a partition under `path` yet: what a resumed run has to do."""
    spark = expected.sparkSession
    if not exists(spark, path):
        return expected
    return expected.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")


def header_lines(lines: DataFrame) -> DataFrame:
    """(path, header): the first line of each file that is neither blank nor a comment. `lines` has path, at and value."""
    real = lines.where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    return real.groupBy("path").agg(F.min_by(F.trim("value"), "at").alias("header"))


def formatted(kind: str, value):
    """A value column as report text: number, percent (two places), hours, minutes (one place, from seconds), date (UTC, without the time at midnight)."""
    if kind == "number":
        return F.format_number(F.round(value), 0)
    if kind == "percent":
        return F.concat(F.format_string("%.2f", value * 100), F.lit("\\%"))
    if kind in ("hours", "minutes"):
        return F.format_string("%.1f", value / {"hours": 3600, "minutes": 60}[kind])
    if kind == "date":
        ts = F.timestamp_seconds(value)
        return F.when(F.pmod(value, F.lit(86_400)) == 0, F.date_format(ts, "d MMMM yyyy")).otherwise(F.date_format(ts, "d MMMM yyyy, HH:mm 'UTC'"))
    raise ValueError(f"unknown format {kind!r}")


def macro_lines(values: dict[str, str]) -> str:
    """Report macros, one a line. Names are letters only and don't begin with "end"."""
    for name in values:
        if not re.fullmatch("[A-Za-z]+", name):
            raise ValueError(f"{name!r}: a macro's name has letters only")
        if name[:3].lower() == "end":
            raise ValueError(f"{name!r}: a macro's name must not begin with 'end'")
    return "".join("\\newcommand{\\%s}{%s}\n" % item for item in values.items())
