"""Print the plan-shape table of README.md: per registered query, the
shuffles, broadcasts, joins, windows and fact scans of its physical plan.

    python tools_plan_shapes.py [sf_dir]

The broadcast threshold is lowered to 100 kB so the machine dimension is
broadcast (as at any volume) and the facts are not (as at 100 TB).
"""

from __future__ import annotations

import os
import re
import sys


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from plantpulse.plans.config import get_session
    from plantpulse.plans.inspect import plan_formatted
    from plantpulse.registry import QUERIES

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_session("local[8]")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(100 * 1024))
    print("| query | shuffles (hash / range / single) | broadcasts | joins | windows | fact scans |")
    print("| --- | --- | --- | --- | --- | --- |")
    for name, fn in QUERIES.items():
        if name in ("efficiency_scores", "failure_scores", "model_metrics"):
            continue
        t = plan_formatted(fn(spark, sf))
        count = lambda pat: len(re.findall(pat, t))
        joins = [f"{n} {label}" for n, label in (
            (count(r"\(\d+\) SortMergeJoin"), "SMJ"), (count(r"\(\d+\) BroadcastHashJoin"), "BHJ"),
            (count(r"\(\d+\) BroadcastNestedLoopJoin"), "BNLJ(1 row)")) if n]
        facts = [s for s in re.findall(r"\(\d+\) Scan parquet (\S+)", t) if "fact" in s]
        print(f"| `{name}` | {count('Arguments: hashpartitioning')} / {count('Arguments: rangepartitioning')}"
              f" / {count('Arguments: SinglePartition')} | {count(r'\(\d+\) BroadcastExchange')} | "
              f"{', '.join(joins) or '-'} | {count(r'\(\d+\) Window\b')} | "
              f"{len(facts)} |")


if __name__ == "__main__":
    main()
