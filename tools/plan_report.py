"""Summarise the physical plan of every registered (non-streaming) query.

Usage: python tools/plan_report.py [sf_dir] > PLANS.md
Counts shuffles (Exchange), join strategies, aggregate strategies and
windows per query from ``executedPlan`` (before adaptive re-planning).
"""

from __future__ import annotations

import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

OPS = ["Exchange hashpartitioning", "Exchange rangepartitioning", "Exchange SinglePartition",
       "Exchange RoundRobinPartitioning", "BroadcastExchange", "BroadcastHashJoin", "SortMergeJoin",
       "ShuffledHashJoin", "BroadcastNestedLoopJoin", "HashAggregate", "SortAggregate",
       "ObjectHashAggregate", "Window", "Generate", "TakeOrderedAndProject", "BatchEvalPython",
       "ArrowEvalPython"]
STREAMING = {"stream_ingest", "stream_ingest_workouts", "stream_dedupe", "stream_new_files", "stream_bucket_hour",
             "foreach_batch_ingest", "external_import", "export_ingest", "ingest_counts"}


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    from kardia.session import build_session
    from kardia.plans import registry
    registry.load_all()
    spark = build_session("local[8]", shuffle_partitions=16, extra_conf={"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    print("# Physical plans of the registered queries\n")
    print(f"Generated by `tools/plan_report.py` at `{sf}` (static plan of the last step, before AQE re-planning; what a key writes and reads back first is not shown).\n")
    print("| query | shuffles (hash/range/single) | joins | aggregates | windows | pushed filters |")
    print("| --- | --- | --- | --- | --- | --- |")
    for name, fn in sorted(registry.QUERIES.items()):
        if name in STREAMING:
            continue
        plan = fn(spark, sf)._jdf.queryExecution().executedPlan().toString()
        c = Counter(m for op in OPS for m in re.findall(re.escape(op), plan))
        joins = ", ".join(f"{k} {v}" for k, v in c.items() if "Join" in k) or "–"
        aggs = ", ".join(f"{k} {v}" for k, v in c.items() if "Aggregate" in k) or "–"
        sh = f"{c['Exchange hashpartitioning']}/{c['Exchange rangepartitioning']}/{c['Exchange SinglePartition']}"
        # filters other than that a column isn't NULL
        pushed = ", ".join(sorted({f.strip() for found in re.findall(r"PushedFilters: \[([^\n]*)", plan) for f in re.findall(r"(?:Greater|Less|Equal|In)\w*\([a-z_]+", found)})).replace("(", " ") or "–"
        print(f"| `{name}` | {sh} | {joins} | {aggs} | {c['Window']} | {pushed} |")
    print("\nStreaming / multi-job keys (not listed): " + ", ".join(sorted(STREAMING)) + ".")
    spark.stop()


if __name__ == "__main__":
    main()
