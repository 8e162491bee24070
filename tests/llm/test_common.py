"""What the operators share."""

from pyspark.sql import functions as F

from sluice.llm import common


def test_lookup_is_a_left_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", 3)
    left = spark.range(2000).select("id", F.when(F.col("id") % 10 > 0, F.concat(F.lit("k"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).cast("string"))).alias("key"))
    right = left.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("top")).where("key <> 'k7'")
    out = {r.id: r.top for r in common.lookup(left, right, "key", "n", F.col("id")).collect()}
    tops = {r.key: r.top for r in right.collect()}
    assert out == {r.id: tops.get(r.key) for r in left.collect()} and len(tops) > 10


def test_bitmaps(spark):
    values = [0, 1, 5, 32_767, 32_768, (1 << 18) - 1, (1 << 18) + 2, -1]
    bits = common.bitmap(spark.createDataFrame([(v,) for v in values] + [(None,)], "h long"), "h", 18)
    want = {v % (1 << 18) for v in values}
    assert {i for i in range(1 << 18) if bits[i >> 3] >> (i & 7) & 1} == want
    assert common.bitmap(spark.range(0).withColumnRenamed("id", "h"), "h", 18) == bytes(1 << 15)


def test_checkpoints_go_where_the_cluster_says(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or common.checkpoint_dir(spark) == named
    assert common.cut(spark.range(5)).count() == 5


def test_hidden_names_come_back(spark):
    df, names = common.hide(spark.createDataFrame([(1, "a", 2)], "_row long, `we.ird` string, size int"))
    assert df.select(*common.shown(names, "size")).columns == ["_row", "we.ird"]
