"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` is the warehouse folder, ``BENCH_CPUS`` the local cores,
``BENCH_RUNS`` the timed runs per query (the median counts, after one warm-up).
Each result is forced in full with a ``noop`` write. ``records_per_sec`` is the
number of incidents divided by the time of ``load`` (CSV scan, typing, point,
cell).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from kerbwise.plans.registry import queries  # noqa: E402
from kerbwise.session import get_session, new_path  # noqa: E402
from kerbwise.sources import files  # noqa: E402
from kerbwise.sources import warehouse as wh  # noqa: E402

HEADLINE = [
    "spatial_clusters", "hotspot_view", "grid_hotspots", "cell_top5", "city_top_cells", "cell_profile",
    "neighbor_density", "rush_hour", "seasonal", "temporal_view", "road_risk", "severity_view",
    "risk_factors", "relative_risk", "global_stats", "overview_kpis", "insights_summary", "insights",
    "city_report", "top_hotspots", "recent_scan", "filter_incidents", "dq_violations", "dq_deduplicated",
    "features", "within_radius", "radius_join", "road_match", "hotspot_requests", "label_encode",
    "stratified_split", "standardize", "append_ingest", "results_refresh", "road_cell_risk", "road_network_risk",
    "buffered_hotspots", "results_contents", "stream_hotspots", "stream_timely", "severity_predictions",
]
SLOW = {"severity_predictions", "results_contents", "stream_hotspots", "stream_timely", "append_ingest"}  # timed once


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = get_session(
        "kerbwise-bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g", spark__ui__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")

    def force(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    csv = new_path(spark, "bench-csv")
    files.write_incident_csv(wh.incidents(spark, sf_dir), csv)
    rows = files.read_incident_csv(spark, csv).count()
    jobs = {"load": lambda: force(files.load_incidents(spark, csv))}
    registered = queries()
    for name in HEADLINE:
        jobs[name] = lambda run=registered[name]: force(run(spark, sf_dir))

    seconds = {}
    for name, job in jobs.items():
        if name in SLOW:
            seconds[name] = round(timed(job), 4)
            continue
        job()
        seconds[name] = round(statistics.median(timed(job) for _ in range(runs)), 4)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
                "runs": runs,
                "incidents": rows,
                "records_per_sec": round(rows / seconds["load"]),
                "driver_memory": spark.conf.get("spark.driver.memory"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
