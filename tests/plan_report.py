"""Write the physical plans of representative jobs to PLANS.md.

Usage: python tests/plan_report.py [sf_dir]   (default /root/testdata/sf0.1)

For each job: the operator tree (``explain()`` physical plan, scan paths
shortened) and a tally of the operators the scale review looks for.
"""

from __future__ import annotations

import io
import os
import re
import sys
import tempfile
from contextlib import redirect_stdout

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

JOBS = [
    ("category_scorecard", "flagship: line measures pre-aggregated per sub-category on the "
                           "bucketed fact, small dimension broadcast, windows over 8 rows"),
    ("monthly_growth", "orders stored by month, no join; LAG / running sums over the month rows"),
    ("monthly_growth_period", "the same of a period: partition filters on the months"),
    ("v_customer_rfm", "scores kept by the stored model; the bucket ends are selected without a sort"),
    ("v_sub_category_performance", "distinct orders per sub-category as a two-level aggregate"),
    ("top3_per_state", "per-state top 3: partial WindowGroupLimit before the shuffle"),
    ("first_vs_latest", "first/last order values in one aggregation (no self-join)"),
    ("order_sequence", "customer sequences: checkpointed global sort, block-wise group join"),
    ("revenue_concentration", "two rows of a running sum, selected without a sort"),
    ("val_results", "the whole suite: one scalar subquery a side"),
    ("load_rejects", "rejected rows by reason, from the load's quarantine"),
    ("target_grid", "targets LEFT JOIN actuals pre-aggregated per (order, category)"),
]
MARKERS = ["Exchange hashpartitioning", "Exchange rangepartitioning", "Exchange SinglePartition",
           "BroadcastExchange", "BroadcastHashJoin", "SortMergeJoin", "WindowGroupLimit",
           "Bucketed: true", "CartesianProduct", "BroadcastNestedLoopJoin"]


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    from tillroll.session import local_session
    import __spark_entry__ as E
    spark = local_session(8, 16, app="tillroll-plans",
                          extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="tillroll-plans-")})
    jobs = E.queries()
    out = ["# Physical plans of representative jobs", "",
           f"Generated by `tests/plan_report.py` on `{os.path.basename(sf_dir)}`, local[8]. "
           "Plans are the pre-execution AQE plans (`explain()`); at runtime AQE may turn "
           "small shuffle joins into broadcasts. Scans of `tillroll_*` tables read the "
           "materialised model (both facts bucketed by `order_id`). Global windows "
           "(`Exchange SinglePartition`) appear only above aggregates bounded by a dimension, "
           "or over the P-row partition summaries of the ordering operator.", ""]
    for name, why in JOBS:
        df = jobs[name](spark, sf_dir)
        buf = io.StringIO()
        with redirect_stdout(buf):
            df.explain()
        plan = re.sub(r"file:[^,\]]*", "file:…", buf.getvalue())
        plan = re.sub(r"#\d+L?", "", plan)
        tally = {m: plan.count(m) for m in MARKERS if plan.count(m)}
        out += [f"## {name}", "", why, "",
                "Operator tally: " + ", ".join(f"`{k}` × {v}" for k, v in tally.items()), "",
                "```", plan.strip(), "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))),
                           "PLANS.md"), "w") as f:
        f.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
