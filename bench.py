"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wakeline.plans import all_queries  # noqa: E402
from wakeline.plans import fixtures as fx  # noqa: E402
from wakeline.plans.q_evidence import pairs  # noqa: E402
from wakeline.session import build_session  # noqa: E402

HEADLINE = ["g1_cleaning_report", "w5_loitering", "g2_track_summary", "j1_traffic_gate", "g8_f8_closest_approach", "g6_space_time_kernel",
            "g11_w8_fused_ranking", "j10_cloud_volume_match", "j2_s6_s7_zones_of_points", "j4_row_visibility", "a1_exact_suppression",
            "j9_grid_interpolation", "f12_f13_f14_weathering", "g16_origin_density", "g20_horizon_snapshot", "r1_refined_lee",
            "r6_connected_components", "p16_g15_route_deviation", "g26_tallies"]


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session("bench", f"local[{cpus}]", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()[0]
    times = {}

    def timed(name, fn):
        t0 = time.time()
        df = fn()
        if df is not None:
            df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    timed("derive_pings", lambda: fx.pings_raw(spark, sf))
    timed("w2_build_tracks", lambda: fx.tracks(spark, sf))          # clean -> strict time -> greedy speed filter
    timed("derive_inputs", lambda: [fx.drift_back(spark, sf), fx.drift_forward(spark, sf), fx.fields(spark, sf),
                                    fx.scene_pixels(spark, sf), pairs(spark, sf)][0])
    for q in HEADLINE:
        timed(q, lambda q=q: queries[q](spark, sf))
    n = fx.incidents(spark, sf).count()
    work = {k: v for k, v in times.items() if not k.startswith("derive_")}
    out = {"metric": "headline_total", "value": round(sum(work.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf),
           "incidents": n, "ms_per_incident_ranked": round(1000 * times["g11_w8_fused_ranking"] / n, 3)}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
