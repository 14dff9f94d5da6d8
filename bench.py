"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from citegrain.plans.queries import QUERIES
from citegrain.session import build_session

HEADLINE = (
    "token_counts", "chunk_documents", "term_weights", "bm25_top20", "dense_text_top20",
    "rrf_fusion", "rerank_top20", "recall_mrr", "evidence_items", "context_windows",
    "quoted_sentences", "extractive_answers", "bm25_per_paper", "answer_funnel", "dense_top20",
    "paired_summary", "timing_interpolated", "threshold_scan", "job_latest_state",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]", "bench",
        **{
            "spark.driver.memory": "16g",
            "spark.sql.shuffle.partitions": cpus,
            "spark.citegrain.spreadScans": "true",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1).count()
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
