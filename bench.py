"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from postledger.plans.catalogue import QUERIES  # noqa: E402
from postledger.session import build_session  # noqa: E402

HEADLINE = [
    "top_matches",
    "score_postings_required",
    "profile_keywords",
    "score_many_profiles",
    "token_frequency",
    "exclude_companies_table",
    "exclude_companies_long_table",
    "exclude_titles",
    "merge_decisions",
    "dedup_two_keys",
    "import_exact_url",
    "normalize_defaults",
    "hash_ids",
    "upsert_ledger",
    "upsert_two_batches",
    "ledger_tables",
    "sighting_counts",
    "scan_log",
    "new_in_latest_scan",
    "ranked_jobs",
    "report_flags",
    "application_state",
    "status_view_counts",
    "constraint_violations",
    "csv_source",
    "json_source",
    "feed_source",
    "tab_results",
    "page_records_numbered",
    "page_flags",
    "incremental_scan",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "postledger-bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One small query first, so that start-up is not charged to the first name.
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    seconds = {}
    for name in names:
        begun = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begun, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({
        "metric": "total query time", "value": total, "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
