"""Write PLANS.md: for every registered query, the shape of its final (AQE)
physical plan — shuffles, joins, windows, scans, Python operators, filters
pushed into the scan — and the formatted plans of the headline queries.

    python tools/plan_report.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerline.session import build_session  # noqa: E402

HEADLINE = ("student_ltv", "daily_trends", "finance_monthly_trend", "kb_search", "match_replies",
            "upsert_drafts", "parse_bookings")


def final_plan(df):
    df.collect()
    p = df._jdf.queryExecution().executedPlan()
    try:
        return p.executedPlan().toString()          # AdaptiveSparkPlanExec: the final plan only
    except Exception:  # noqa: BLE001
        return p.toString()


def shape(plan: str) -> dict:
    return {
        "shuffles": len(re.findall(r"\bExchange hashpartitioning|\bExchange rangepartitioning|\bExchange "
                                   r"RoundRobinPartitioning|\bExchange SinglePartition", plan)),
        "reused": plan.count("ReusedExchange"),
        "broadcast joins": plan.count("BroadcastHashJoin"),
        "sort-merge joins": plan.count("SortMergeJoin"),
        "windows": len(re.findall(r"\bWindow(GroupLimit)? ", plan)),
        "scans": plan.count("FileScan") + plan.count("Scan ExistingRDD"),
        "python": sum(plan.count(k) for k in ("MapInPandas", "ArrowEvalPython", "FlatMapGroupsInPandas")),
        "pushed": sorted({m for m in re.findall(r"PushedFilters: \[([^\]]*)\]", plan) if m}),
    }


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", shuffle_partitions=8)
    from ledgerline.plans.registry import QUERIES as qs
    lines = ["# PLANS", "", f"Final AQE physical plans at `{sf_dir}` (generated by `tools/plan_report.py`).",
             "Shuffles count exchanges in the final plan; scalar subqueries count their own scans.", "",
             "| query | shuffles | reused | BHJ | SMJ | windows | scans | python | filters pushed to the scan |",
             "|---|---|---|---|---|---|---|---|---|"]
    full = []
    for name, q in qs.items():
        plan = final_plan(q(spark, sf_dir))
        s = shape(plan)
        pushed = "; ".join(x[:90] for x in s["pushed"]) or "–"
        lines.append(f"| {name} | {s['shuffles']} | {s['reused']} | {s['broadcast joins']} | {s['sort-merge joins']} "
                     f"| {s['windows']} | {s['scans']} | {s['python']} | {pushed} |")
        if name in HEADLINE:
            full.append(f"### {name}\n\n```\n{plan.strip()}\n```\n")
    lines += ["", "## Headline plans", ""] + full
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(lines) + "\n")
    spark.stop()


if __name__ == "__main__":
    main()
