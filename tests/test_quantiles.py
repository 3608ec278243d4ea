import numpy as np
from pyspark.sql import functions as F

from wakeline.operators import raster as ra
from wakeline.operators.slices import exact_quantiles
from wakeline.plans import all_queries
from wakeline.plans import fixtures as fx


def test_quantile_bins_have_one_set_of_edges(spark):
    """Approximate edges differ from one evaluation to the next, so the plan must not hold them: bins come from a table."""
    d = spark.range(0, 12000, 1, 40).select((F.col("id") % 2).alias("k"), F.sin(F.col("id").cast("double") * 1.7).alias("v"))
    q = exact_quantiles(d, ["k"], "v", {"a": 0.05, "m": 0.5, "z": 0.98})
    assert "percentile_approx" not in q._jdf.queryExecution().optimizedPlan().toString()
    for r in q.collect():
        want = np.quantile(np.sin(np.arange(r.k, 12000, 2) * 1.7), [0.05, 0.5, 0.98])
        assert np.allclose([r.a, r.m, r.z], want, rtol=0, atol=1e-12)


def test_extent_without_a_full_bin_has_no_bin_width(spark, monkeypatch):
    px = spark.range(32).select(F.lit(1).alias("scene_id"), F.lit(7).cast("bigint").alias("region_id"), F.expr("cast(id div 16 as int)").alias("row"),
                                (F.col("id") % 16).cast("int").alias("col"))
    sc = spark.createDataFrame([(1, 64, 2, 73.0, 15.0, 73.04, 15.05)], "scene_id int, width int, height int, w double, s double, e double, n double")
    r = ra.extent(px, sc, min_px=33).first()
    assert r.bin_width_m is None and r.width_m > 0
    monkeypatch.setattr(fx, "blocks", lambda *_: px.limit(8))
    monkeypatch.setattr(fx, "scenes", lambda *_: sc)
    assert all_queries()[0]["r12_oriented_extent"](spark, "").first().width_m is None
