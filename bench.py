"""Wall seconds of the headline queries: one warm-up, then the median of the timed runs.

Each query runs in full into the noop sink. Prints one JSON line. ``BENCH_SF_DIR``,
``BENCH_CPUS`` and ``BENCH_RUNS`` set data, cores and timed runs; arguments choose queries.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

from tidemark.queries import QUERIES  # noqa: E402
from tidemark.session import local_session  # noqa: E402

HEADLINE = [
    # stateless
    "filter_allow", "expire", "size_stub", "validate", "quorum", "project_keep", "mask_rules", "redact", "cast",
    "clamp", "normalize_trim", "lookup_map", "lookup_table", "annotate", "promote", "partition_by",
    "digest_sha256", "score", "format_json", "format_text", "route",
    # counts
    "census", "summarize", "pipeline_metrics", "window_count",
    # arrival order
    "align", "sequence", "cap", "reorder", "schema_version", "dedup_ttl", "dedup_content",
    "debounce", "sample_max_per_second", "token_bucket", "distinct_key",
    # combining rows
    "decode_changes", "merge_prefer_src", "coalesce_slice", "stash_latest", "ttl_lookup", "gate", "hold_release",
    # sinks
    "sink_write", "dead_letter", "replay_recent",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or [q for q in HEADLINE if q in QUERIES]
    spark = local_session("bench", cores)
    times: dict[str, float] = {}
    for name in names:
        took = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        times[name] = round(statistics.median(took[1:]), 3)
        print(f"{name} {times[name]} (first {took[0]:.2f})", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_wall_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cores": cores, "runs": runs, "spark": spark.version,
            }
        )
    )


if __name__ == "__main__":
    main()
