"""Benchmark: run the headline queries on one scale-factor directory and print one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list,
optional). Each query is executed in full through the ``noop`` sink (no collect to the driver).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from revforge.plans.registry import all_queries  # noqa: E402
from revforge.session import build_session, drop_written  # noqa: E402

HEADLINE = [
    "balance_longest", "balance_shortest", "class_counts", "clean_text", "union_sources", "nested_cuts",
    "sort_by_length", "add_row_ids", "tokenize_words", "remove_stopwords", "stopword_antijoin",
    "lemma_vocab", "stem_vocab", "vocab_fit", "encode_fixed", "split_stratified", "folds_stratified",
    "wide_metrics", "micro_prf", "loss_carry", "loss_log_snapshots", "best_epoch", "nb_predict",
    "cv_multiclass", "holdout_multiclass", "holdout_multilabel", "hp_search", "run_matrix", "lemmatize_text",
    "stem_text", "prepare_generated", "scan_reviews", "loss_carry_stream", "embed_means", "softmax_history",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    spark = build_session(f"local[{cpus}]", app="revforge-bench", shuffle_partitions=int(cpus))
    qs = all_queries()
    # warm-up: JVM, codegen and Python workers, on the smallest table
    qs["class_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        t0 = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        drop_written(spark)
        print(f"# {name} {times[name]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
