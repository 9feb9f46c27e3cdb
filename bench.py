"""Headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; one JSON line, seconds per query (best of two, warm)."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = ["agg_group_by", "agg_distinct", "agg_cube", "join_star_5way", "join_inner", "join_asof", "join_range", "join_semi", "win_rank_family", "win_qualify_topn", "win_running_sum", "topk", "union_distinct", "except_all", "filter_compare", "fn_regex", "dml_merge_upsert", "dml_update", "overwrite_dynamic_day", "read_session_restriction", "load_parquet_append"]


def main() -> None:
    from basalt.plans.catalogue import QUERIES
    from basalt.session import local

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = local(cpus, int(cpus) if cpus.isdigit() else 8, "12g")
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1], "cpus": cpus}))


if __name__ == "__main__":
    main()
