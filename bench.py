"""Time the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ.setdefault("EVIDRA_CHECKPOINT_DIR", "/tmp/evidra-checkpoints")

from evidra.plans import QUERIES  # noqa: E402
from evidra.session import local_session  # noqa: E402

HEADLINE = (
    "top_k_similar", "simgic_pairs", "term_ic", "ancestor_closure", "most_specific", "weighted_similarity", "ranked_neighbors",
    "integrate_links", "evidence_rollup", "resolve_ids", "review_status", "evidence_state", "track_records", "reviewer_agreement",
    "visible_claims", "phrase_match", "locate_quotes", "canonical_text", "best_sentence", "audit_quotes", "merkle_root", "tfidf_profiles",
    "knn_graph", "communities", "name_search", "substring_search", "conditional_summary", "impact_frontier", "task_list", "changed_shards",
    "claim_dossier", "rolling_quota", "minute_load", "activity_sessions", "latency_stats",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES", "").split() or list(HEADLINE)
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "evidra-bench")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start the executors
    times = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
