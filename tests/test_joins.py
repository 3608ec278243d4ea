"""A side that `explode` or a list makes long is not sent through the driver because its source file is small."""
from pyspark.sql import functions as F

from test_tracks import fixes
from wakeline.operators import alerts as al
from wakeline.operators import metocean as mo
from wakeline.operators import spatial as sp
from wakeline.operators import tracks as tr
from wakeline.session import durable


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_salted_join_shuffles_what_is_not_small(spark):
    big = durable(spark.range(3000).select((F.col("id") % 30).alias("k"), F.col("id").alias("v")))
    small = durable(spark.range(30)).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("w"))
    assert "Broadcast" not in plan(sp.salted_join(big, small, ["k"], max_broadcast_rows=10))
    assert "BroadcastHashJoin" in plan(sp.salted_join(big, small, ["k"]))


def test_salted_join_spreads_hot_keys_and_keeps_every_pair(spark):
    hot = F.when(F.col("id") < 2000, 7).when(F.col("id") < 2010, None).otherwise(F.col("id") % 30)
    big = durable(spark.range(3000).select(hot.alias("k"), F.col("id").alias("v")))
    small = durable(spark.range(30)).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("w"))
    want = sorted(map(tuple, big.join(small, "k").select("k", "v", "w").collect()))
    j = sp.salted_join(big, small, ["k"], max_broadcast_rows=10, hot_rows=100)
    assert "SortMergeJoin" in plan(j) and "_salt" in plan(j)
    assert sorted(map(tuple, j.select("k", "v", "w").collect())) == want


def test_near_alerts_shuffle_the_spread_history(spark):
    a = durable(spark.range(200).select(F.col("id").alias("alert_id"), (F.col("id") * 1000000).alias("t_us"), (F.col("id") % 7 * 0.04).alias("lat"),
                                        F.lit(0.0).alias("lon"), F.lit("SENT").alias("status"), F.lit(None).cast("bigint").alias("dedup_of_id")))
    assert "Broadcast" not in plan(al.near_alerts(a, a))


def test_kept_fixes_and_legs_are_shuffled(spark):
    f = durable(fixes(spark, [(1, 0.1 * k, 10.0 + 0.001 * k, 70.0) for k in range(50)]))
    assert "BroadcastHashJoin [mmsi" not in plan(tr.drop_fast(f))
    times = f.select("mmsi", F.col("t_h"))
    assert "SortMergeJoin" in plan(sp.position_at(f, times))


def test_cubes_are_shuffled_beyond_the_bound(spark):
    i = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    c = spark.range(1, 601).withColumnRenamed("id", "field_id").withColumn("yi", i(4)).withColumn("xi", i(4)).withColumn("ti", i(5))
    c = durable(c.select("*", F.col("ti").cast("double").alias("t_h"), F.col("yi").cast("double").alias("lat"), F.col("xi").cast("double").alias("lon"),
                         *[F.col("yi").cast("double").alias(v) for v in mo.VALUES]))
    p = durable(spark.range(1, 601).select(F.col("id").alias("field_id"), F.lit(1.5).alias("lat"), F.lit(1.0).alias("lon"), F.lit(2.0).alias("t_h")))
    at = mo.metocean_at(p, c)                 # 600 x 36 cubes
    assert "SortMergeJoin" in plan(at)
    assert [tuple(r) for r in at.agg(F.count("wu"), F.min("wu"), F.max("cv")).collect()] == [(600, 1.5, 1.5)]
