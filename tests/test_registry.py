import re

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_entry_and_registry(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 140
    df = entry.entry(spark)
    assert {"incident_id", "mmsi", "rank", "score"} <= set(df.columns)


def test_no_cartesian_in_spatial_joins(spark):
    q = entry.queries()
    for name in ("j1_traffic_gate", "j2_s6_s7_zones_of_points", "j12_near_alerts", "j10_cloud_volume_match"):
        plan = q[name](spark, SF)._jdf.queryExecution().toString()
        assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", plan), name
