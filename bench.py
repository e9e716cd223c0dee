"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; one JSON line."""

from __future__ import annotations

import json
import os
import time

from loomwright.plans import registry
from loomwright.session import build_session

HEADLINE = (
    "flagship_role_counts exact_merge_stats leakage_strict_views near_duplicate_pairs overlap_triples stratified_lineage_split "
    "owner_election balanced_weights metrics_by_slice auroc_and_average_precision threshold_grid dense_top_k bm25_top_k rank_fusion "
    "cascade_replay policy_decisions latest_ledger_records normalized_text_hash fingerprints"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench")
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()  # starts the session's workers
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
