"""Write PLANS.md: physical-plan facts for the headline queries.

For each query: exchanges (shuffles), join strategies, sorts, aggregates,
windows, pushed filters and read schemas of every scan, and the operator tree.
usage: python scripts/explain_plans.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from revcast.plans.registry import REGISTRY  # noqa: E402
from revcast.session import local_session  # noqa: E402

QUERIES = ["clean_daily", "rolling_features", "forecast_all", "period_features", "daily_rollup_type",
           "pinball_loss", "vendor_bing", "incremental_features", "paused_types_30", "contribution_table", "budget_scenarios", "chrono_index", "label_encode_apply"]


def plan_text(df) -> str:
    # formatted plan of the executed (final, adaptive) plan
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().explainString(  # noqa: SLF001 - same text as df.explain("formatted")
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


PATTERNS = {
    "exchange": r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobinPartitioning)",
    "bexchange": r"BroadcastExchange",
    "bhj": r"BroadcastHashJoin",
    "smj": r"SortMergeJoin",
    "nlj": r"BroadcastNestedLoopJoin|CartesianProduct",
    "hagg": r"HashAggregate",
    "sagg": r"SortAggregate",
    "window": r"Window ",
    "sort": r"[+-] Sort ",
}


def summarise(name: str, text: str) -> str:
    tree = text.split("\n\n")[0]
    n = {k: len(re.findall(p, tree)) for k, p in PATTERNS.items()}
    details = text.split("\n\n", 1)[1] if "\n\n" in text else ""
    n["exchange"] = len(re.findall(r"^\(\d+\) Exchange", details, re.M))
    pushed = sorted(set(re.findall(r"PushedFilters: (\[.*?\])", text)))
    schemas = sorted(set(re.findall(r"ReadSchema: (struct<.*?>)", text)))
    lines = [f"## {name}", "",
             f"- shuffle exchanges: {n['exchange']}, broadcast exchanges: {n['bexchange']}",
             f"- joins: broadcast-hash {n['bhj']}, sort-merge {n['smj']}, nested-loop/cartesian {n['nlj']}",
             f"- aggregates: hash {n['hagg']}, sort {n['sagg']}; windows {n['window']}",
             f"- pushed filters: {'; '.join(pushed) if pushed else 'none'}",
             "- read schemas:"] + [f"  - `{x}`" for x in schemas] + ["", "```", tree.strip(), "```", ""]
    return "\n".join(lines)


def from_sources(spark, sf: str) -> dict:
    """Plans that start at the source tables, without a landed one."""
    from revcast.operators.clean import clean
    from revcast.operators.features import engineer_features
    from revcast.operators.periods import period_features
    from revcast.sources.fixture import ad_daily
    features = engineer_features(clean(ad_daily(spark, sf)))
    return {"clean_from_sources": clean(ad_daily(spark, sf)), "features_from_sources": features, "period_features_from_sources": period_features(features)}


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    out = ["# Physical plans of the headline queries", "",
           f"Generated by `scripts/explain_plans.py` at `{sf}` (final adaptive plans). The landed daily tables are read "
           "from the shared checkpoint folder, so the plans of registered queries start at a parquet scan of them; the first three start at the sources.", ""]
    for name, df in from_sources(spark, sf).items():
        out.append(summarise(name, plan_text(df)))
    for name in QUERIES:
        out.append(summarise(name, plan_text(REGISTRY[name].spark(spark, sf))))
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out))


if __name__ == "__main__":
    main()
