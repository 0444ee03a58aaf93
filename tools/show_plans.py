"""Write PLANS.md: the physical plan tree of representative queries.

usage: python tools/show_plans.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gatewatch.plans.registry import all_queries  # noqa: E402
from gatewatch.session import get_spark  # noqa: E402

SHOW = {
    "rule_blocks": "column pruning through the adapter (ReadSchema = one column), partial + final aggregate",
    "country_top30": "top-k as TakeOrderedAndProject after a partial aggregate",
    "top_anomalous_ip": "top IP per day as a min_by aggregate (partial + final), no window",
    "policy_replay": "AI block-list membership as an equi-join chosen at runtime; rules are one CASE projection",
    "cidr_trusted": "literal CIDR ranges as InSet probes (no join); block-table ranges as (prefix, network) equi-join",
    "group_stats": "exact quartiles: range exchange + stored numbering + small rank joins",
    "running_counters": "chunked prefix scan: local window per (key, chunk) + carry-in join of a small table",
    "golden_forest_score": "forest scoring in an Arrow UDF (ArrowEvalPython) over a broadcast node table",
    "doc_entropy": "entropy as native higher-order functions inside whole-stage codegen",
}


def tree(plan: str) -> str:
    keep = []
    for line in plan.splitlines():
        if line.startswith("(") or line.startswith("==") and "Physical" not in line:
            break
        keep.append(line)
    return "\n".join(keep).strip()


def details(plan: str, ops=("Scan parquet", "Exchange", "BroadcastHashJoin", "SortMergeJoin",
                              "TakeOrderedAndProject", "ArrowEvalPython", "FlatMapGroupsInPandas")) -> str:
    out = []
    blocks = re.split(r"\n(?=\(\d+\) )", plan)
    for b in blocks:
        head = b.splitlines()[0] if b else ""
        if any(o in head for o in ops):
            lines = [ln for ln in b.splitlines()
                     if ln.startswith("(") or ln.split(":")[0].strip() in
                     ("ReadSchema", "PushedFilters", "Arguments", "Join type", "Join condition", "Left keys",
                      "Right keys", "Functions")]
            out.append("\n".join(ln[:220] for ln in lines))
    return "\n".join(out)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark()
    qs = all_queries()
    parts = ["# Physical plans of representative queries", "",
             f"Generated by `tools/show_plans.py` at `{sf}` (local[8], AQE on). "
             "Each section shows the plan tree (initial plan before AQE re-planning) and the "
             "scan / exchange / join details.", ""]
    for name, why in SHOW.items():
        df = qs[name].build(spark, sf)
        plan = df._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        parts += [f"## {name}", "", why, "", "```", tree(plan), "", details(plan), "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(parts))
    spark.stop()


if __name__ == "__main__":
    main()
