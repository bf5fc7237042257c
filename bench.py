"""Time the headline queries; prints one JSON line.

Each query is planned and run twice in full, all columns of all rows, into the no-op sink:
`queries` has the first (cold) time, `warm` the second.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from forgepulse.plans import catalog  # noqa: E402
from forgepulse.session import build_session  # noqa: E402

HEADLINE = [
    "flatten_events",
    "event_type_counts",
    "latest_events",
    "dedup_events",
    "act_forking_repository",
    "act_closing_pull_request",
    "activities_all",
    "consumed_events",
    "repo_runs",
    "feat_basic",
    "feat_dca",
    "features_all",
    "classify_accounts_fixed_score",
    "progressive_fixed_score",
    "pair_release_tag",
    "pair_reject_pr",
    "band_merge_push",
    "features_one_account",
    "stream_latest_events",
    "classify_stream",
    "train_score_gbt",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus if cpus.isdigit() else "8",
        # Rows are few but costly here: one task per core instead of one per megabyte.
        spark__sql__adaptive__coalescePartitions__enabled="false",
        spark__ui__enabled="false",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    all_queries = catalog.queries()
    only = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    timings: dict[str, dict[str, float]] = {"cold": {}, "warm": {}}
    errors: dict[str, str] = {}
    for name in only:
        try:
            for run in timings.values():
                start = time.perf_counter()
                all_queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                run[name] = round(time.perf_counter() - start, 3)
        except Exception as error:  # one failing query must not hide the figures of the others
            errors[name] = f"{type(error).__name__}: {error}"[:300]
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(timings["cold"].values()), 3),
                "unit": "sec",
                "queries": timings["cold"],
                "warm": timings["warm"],
                "errors": errors,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
