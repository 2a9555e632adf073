"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Every query is timed from building its plan to its last row; rows are consumed
by the ``noop`` sink, so nothing is collected and nothing is pruned away. One
small query runs first so that the JVM's start is not counted as query time.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from vitalgrid.plans import registry  # noqa: E402
from vitalgrid.session import local_session  # noqa: E402

HEADLINE = [
    "class_summary", "clean_training", "clean_import", "import_rule_counts", "single_profiles",
    "number_respondents", "neighbour_windows", "lookup_by_number", "decode_profiles", "value_usage",
    "stratified_split", "predictions", "classification_report", "roc_points", "auc_by_class",
    "permutation_importance", "permutation_importance_all", "shap_contributions", "top_factors",
    "supports_and_opposes", "profile_attributes", "scenario_scores", "stale_twins", "graph_nodes",
    "graph_edges", "graph_views", "graph_connections", "evidence_packages", "evidence_summaries",
    "draft_checks", "guidance", "forest_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    chosen = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), memory="16g", app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    queries["class_summary"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in chosen:
        started = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
