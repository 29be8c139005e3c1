"""Time the headline queries: python bench.py prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3, after one
warm-up; the median counts). Every row is computed and discarded.
"""

import json
import os
import statistics
import time

from rillway.session import build_session
from rillway.workload import QUERIES

HEADLINE = (
    "task_end_to_end", "flow_chain", "snapshot_scan_no_pk", "map_inline_rename", "coerce_string", "filter_drop",
    "relate_11_first", "relate_11_sub", "relate_1n_sub", "relate_1n_sib_map", "relate_multi_key", "relate_chain",
    "relate_1n_siblings", "queue_parse", "index_scan", "change_pairs", "apply_changes_sql", "apply_changes_index",
    "replica", "change_outcomes", "sink_insert", "sink_update", "sink_envelope", "task_metrics", "fn_trim", "fn_strtotime",
    "fn_max_array", "stream_apply_changes",
)


def run_once(spark, name, folder):
    begin = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        run_once(spark, name, folder)
        times[name] = round(statistics.median(run_once(spark, name, folder) for _ in range(runs)), 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, median seconds each, summed", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
