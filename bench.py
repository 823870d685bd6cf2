"""Headline timings at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Stages (``build_*``) are timed once: deriving the facts, the rollups, the
feature tables, the forecasts and the scored tables, each ending in a Parquet
write. Queries then run on those stages, as the published timings do, and the
faster of two runs counts. Results go to a sink that reads every row.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from supplyspark import catalog  # noqa: E402
from supplyspark.session import build_session, staged  # noqa: E402
from supplyspark.sources.adapter import StagedStar  # noqa: E402

STAGES = {
    "build_facts": lambda v: (v.star.fact_demand, v.star.fact_purchase_orders, v.star.ledger),
    "build_rollups": lambda v: (v.daily_demand, v.supplier_performance, v.warehouse_operations, v.cost_summary),
    "build_demand_features": lambda v: v.demand_features,
    "build_inventory_features": lambda v: v.inventory_features,
    "build_supplier_features": lambda v: staged(v.supplier_features, "supplier_features"),
    "build_baseline_forecasts": lambda v: (v.baseline_forecasts, v.validation_metrics, v.selected_forecasts),
    "build_risk_scores": lambda v: (v.scored_inventory, v.scored_suppliers, v.supplier_profile, v.exposure),
    "build_policies": lambda v: (v.positions, v.scenario_positions, v.baseline, v.plan),
}
QUERIES = (
    "monthly_cost warehouse_capacity supplier_scorecard executive_kpis category_performance stockout_durations "
    "demand_volatility_hhi inventory_turnover supplier_otif service_level_by_category warehouse_cost_breakdown "
    "product_supply_risk reconcile_all dq_issues audit_trail best_model interval_coverage auc_ap risk_snapshot "
    "scenario_sweep plan_audit sensitivity_sweep"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    view = catalog.View(StagedStar(spark, folder))
    spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count().write.format("noop").mode("overwrite").save()
    timings: dict[str, float] = {}
    for name, build in STAGES.items():
        start = time.perf_counter()
        build(view)
        timings[name] = round(time.perf_counter() - start, 3)
    for name in QUERIES:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            catalog.QUERIES[name](view).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        timings[name] = round(min(runs), 3)
    print(
        json.dumps(
            {
                "metric": "stages_plus_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
