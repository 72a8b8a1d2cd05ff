"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores; BENCH_QUERIES may name
other queries (comma separated, or ``all``).
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "t04_chunks", "t08_explode", "t09_header", "t16_prompt", "q02_bm25", "q04_knn", "q05_hybrid", "q12_search_keyword",
    "q15_stats", "f13_add_relevance", "s02_issues", "s07_messages", "s14_emails", "s18_files", "s30_html_to_text", "s31_union",
    "u01_changed", "u03_upsert", "u14_embed_plan", "a03_source_stats", "a04_mean_duration", "a08_daily", "p07_groups", "p08_apply_patch",
    "w17_priority_score", "w21_daily_priorities", "w22_overlaps", "w24_focus_blocks", "l03_duplicates", "l08_statement", "l09_findings",
    "k04_expand", "k08_similar", "u11_incremental", "a16_daily_stream",
]


def main() -> None:
    from worklore.plans.catalog import QUERIES
    from worklore.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    asked = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if asked == "all" else [n for n in asked.split(",") if n] or HEADLINE
    spark = local_session(cpus)
    QUERIES["t02_tokens"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm the session
    took: dict[str, float] = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
