"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""
from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "number_lines", "token_count", "filter_content_binary", "ignore_hierarchy", "exclusion_counts", "file_limit",
    "render_xml", "directory_tree", "repo_summary", "import_edges", "transitive_imports", "dependents_candidates",
    "dependents", "implementations", "tests_in_test_dirs", "related_resources", "package_peers", "fold_traces",
    "export_diff", "recent_exports", "export_selected", "export_bidirectional", "fold_and_emit",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from packloom.plans.catalog import QUERIES
    from packloom.session import local_session
    from packloom.sources.views import Corpus

    spark = local_session("packloom-bench", cores=cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("OFF")
    start = time.time()
    Corpus(spark, sf_dir).files.count()
    seconds = {"ingest": round(time.time() - start, 3)}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
