from pyspark.sql import functions as F

from maskwright.llm import tables


def test_among_keeps_every_key_and_few_others(spark):
    own = spark.range(200_000).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), F.col("id").cast("string").alias("v"))
    keys = spark.range(0, 200_000, 10).select("id")
    got = {r.v for r in tables.among(own, F.col("k"), keys, 20_000).collect()}
    assert {str(k) for k in range(10, 200_000, 10)} <= got
    assert len(got) < 20_000 + 180_000 / 12
    assert tables.among(own, F.col("k"), keys.where("id < 0"), 0).count() == 0


def test_meeting_is_a_join_at_any_size(spark):
    own = spark.range(1000).select((F.col("id") % 100).alias("k"), F.col("id").cast("string").alias("v"))
    keys = spark.range(0, 200, 3).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    for most in (0, 10_000):
        got = sorted((r.k, r.v, r.w) for r in tables.meeting(own, keys, ["k"], most).collect())
        assert got == sorted((i % 100, str(i), i % 100 * 2) for i in range(1000) if i % 100 % 3 == 0)
