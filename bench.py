"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 4), BENCH_QUERIES (comma list).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from faultlens.plans.catalog import QUERIES  # noqa: E402
from faultlens.session import local_session  # noqa: E402

HEADLINE = [
    "mask_pii", "truncate_log", "preprocess", "retrieval_keywords", "fts_topk", "like_match", "embed_column",
    "vector_topk", "vector_topk_ann", "hybrid_search", "dedup_24h", "answer_fields", "mode_comparison",
    "kb_update", "run_experiment",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(int(os.environ.get("BENCH_CPUS", "4")))
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
