"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import time

from vecloom.plans import catalog
from vecloom.session import build_session, drop_scratch

HEADLINE = (
    "m1_recall_at_k",
    "k4_knn_join",
    "k4_knn_join_cells",
    "k5_knn_join_by_key",
    "k1_cosine_topk",
    "k3_search_by_id",
    "m2_tag_jaccard_at_k",
    "m3_group_cohesion",
    "m4_label_confusion",
    "m6_cosine_summary",
    "m7_neighbour_overlap",
    "m8_relational_mse",
    "m9_redundancy_report",
    "m12_compare_report",
    "m13_eval_report_label",
    "s4_upsert",
    "s7_ingest_incremental",
    "h1_content_fingerprint",
    "j11_windows_to_tracks",
    "w1_sliding_windows",
    "w7_batched_inference",
    "p2_event_pairs",
    "p5_epoch_batches",
    "t3_t4_titles",
    "t5_dedup_first_wins",
    "t15_infer_genre",
    "l1_norm_tokens",
    "l5_best_match",
    "r1_latency_summary",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    only = os.environ.get("BENCH_QUERIES")
    names = only.split(",") if only else HEADLINE
    # start the JVM code paths and the Python workers before the clock runs
    catalog.QUERIES["m1_recall_at_k"](spark, sf_dir).collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        drop_scratch(spark)
    result = {
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
