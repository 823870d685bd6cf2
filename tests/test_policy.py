"""Cost models, conservation and caps of the plans."""

import pytest
from pyspark.sql import functions as F

from supplyspark.functions import costs
from supplyspark.operators import policy, risk
from supplyspark.plans import queries


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_cost_models(spark):
    lit = F.lit
    assert value(spark, costs.procurement_unit_cost(lit(100.0), False)) == pytest.approx(105.0)
    assert value(spark, costs.freight_unit_cost(lit(1.2), lit(1.1))) == pytest.approx(3.3)
    assert value(spark, costs.transfer_unit_cost(lit(1.5), lit(1.0), lit(1.2))) == pytest.approx(4.25)
    assert value(spark, costs.holding_unit_cost(lit(100.0))) == pytest.approx(100 * 0.2 / 365.25 * 7)
    assert value(spark, costs.shortage_unit_cost(lit(50.0), lit(0.5))) == pytest.approx(112.5)
    assert value(spark, costs.delay_unit_cost(lit(2.0), lit(10))) == pytest.approx(3.0)


def test_hhi(spark):
    df = spark.createDataFrame([("k", "a", 50), ("k", "b", 50), ("m", "a", 9)], "k string, s string, q long")
    got = {r.k: r.h for r in queries.hhi(df, "k", "s", "q", "h").collect()}
    assert got == {"k": 5000.0, "m": 10000.0}


@pytest.fixture(scope="module")
def world(spark):
    products = spark.createDataFrame(
        [("A", "Alpha", 10.0, 25.0, "S1", "S2"), ("B", "Beta", 40.0, 90.0, "S2", "S1"), ("C", "Gamma", 7.0, 9.0, "S1", "S1")],
        "product_id string, product_name string, unit_cost double, selling_price double, primary_supplier_id string, secondary_supplier_id string",
    )
    suppliers = spark.createDataFrame(
        [("S1", "One", 1.0, 7, 600), ("S2", "Two", 1.5, 10, 900)],
        "supplier_id string, supplier_name string, transport_cost_factor double, baseline_lead_time_days int, monthly_capacity_units long",
    )
    places = spark.createDataFrame(
        [("W1", "North", 1000, 1.5, 1.0), ("W2", "South", 1000, 1.0, 1.25), ("W3", "East", 1000, 2.0, 0.75)],
        "warehouse_id string, warehouse_name string, capacity_units long, handling_cost_per_unit double, transport_cost_factor double",
    )
    rows = []
    for i, p in enumerate("ABC"):
        for j, w in enumerate(("W1", "W2", "W3")):
            rows.append((p, w, "High" if i == 0 else "Low", 60 + 35 * j, 150 - 55 * j + 5 * i, 20, 0.25, 0.2))
    positions = spark.createDataFrame(
        rows,
        "product_id string, warehouse_id string, criticality string, forecast_demand_7d long, ending_inventory_lag1 long, safety_stock_target long, stockout_probability_7d double, supplier_delay_probability double",
    )
    dims = {"dim_product": products, "dim_supplier": suppliers, "dim_warehouse": places}
    return policy.apply_scenarios(positions, policy.standard_scenarios(spark)).persist(), dims


def test_baseline_conserves_and_respects_capacity(spark, world):
    positions, d = world
    plan = policy.baseline_plan(positions, **d).persist()
    assert plan.count() == 6 * 9
    gap = F.abs(F.col("stock") + F.col("order_quantity") + F.col("shortage_quantity") - F.col("ending_inventory") - F.col("demand"))
    assert plan.agg(F.max(gap)).first()[0] < 1e-6
    used = plan.groupBy("scenario_name", "supplier_id").agg(F.sum("order_quantity").alias("q"), F.max(F.col("monthly_capacity") * F.col("supplier_capacity_multiplier") / costs.WEEKS_PER_MONTH).alias("cap"))
    assert used.filter("q > cap + 1e-6").count() == 0
    totals = policy.baseline_totals(plan)
    assert totals.filter("service_level < 0 OR service_level > 1").count() == 0


def test_coordinated_plan_passes_its_audit(spark, world):
    positions, d = world
    plan = policy.coordinated_plan(positions, d)
    audit = policy.plan_audit(positions, plan["flows"], plan["transfers"], plan["orders"], d["dim_supplier"], d["dim_warehouse"], d["dim_product"])
    hard = audit.filter("constraint_name != 'service_level_floor'")
    assert hard.filter("constraint_type = 'EQUALITY' AND abs(slack) > 1e-6").count() == 0
    assert hard.filter("constraint_type = 'INEQUALITY' AND slack < -1e-6").count() == 0
    moved = plan["transfers"].groupBy("scenario_name", "product_id").agg(F.sum("transfer_quantity").alias("q"))
    sides = positions.groupBy("scenario_name", "product_id").agg(
        F.sum(F.greatest(F.lit(0.0), F.col("stock") - F.col("demand"))).alias("s"),
        F.sum(F.greatest(F.lit(0.0), F.col("demand") - F.col("stock"))).alias("d"),
    )
    joined = sides.join(moved, ["scenario_name", "product_id"], "left").fillna(0.0, ["q"])
    assert joined.filter("abs(q - least(s, d)) > 1e-3").count() == 0
    assert plan["transfers"].filter("origin_warehouse = dest_warehouse").count() == 0


def test_comparison_tables_agree(spark, world):
    positions, d = world
    base = policy.baseline_plan(positions, **d)
    plan = policy.coordinated_plan(positions, d)
    b = policy.baseline_totals(base)
    c = policy.coordinated_totals(plan["flows"], plan["transfers"], plan["orders"])
    fall = policy.cost_waterfall(b, c)
    assert fall.count() == 6 * 7
    parts = fall.filter("cost_category != 'total_landed_cost'").groupBy("scenario_name").agg(F.sum("optimized_cost").alias("s"))
    whole = fall.filter("cost_category = 'total_landed_cost'")
    assert whole.join(parts, "scenario_name").filter("abs(s - optimized_cost) > 0.05").count() == 0
    shares = policy.sourcing_shares(base, plan["orders"]).groupBy("scenario_name").agg(F.sum("baseline_share_pct").alias("b"))
    assert shares.filter("abs(b - 100) > 0.05").count() == 0
    log = policy.decision_rows(plan["flows"], plan["transfers"], plan["orders"], "R1")
    assert {r.decision_type for r in log.select("decision_type").distinct().collect()} <= {"ORDER", "TRANSFER", "SHORTAGE"}
    text = policy.explain_transfers(plan["transfers"], d["dim_product"], d["dim_warehouse"], 2)
    assert text.count() == 2 and "lateral transfer" in text.first().explanation


def test_sweeps_are_one_job(spark, world):
    table = policy.sweep_scenarios(spark)
    assert table.count() == 17 and table.select("scenario_name").distinct().count() == 17


def test_explanations(spark):
    row = dict(
        forecast_demand_7d=100, ending_inventory_lag1=40, beginning_inventory=40, inventory_days_of_supply=2.8, safety_stock_target=60,
        stockout_count_7d=3, stockout_rate_28d=0.2, supplier_delay_probability=0.6, hist_on_time_rate=0.5, hist_p90_delay=3.5,
        supplier_capacity_pressure=0.9, criticality="High", supplier_dependency="Dual", warehouse_capacity_utilization_lag1=90.0,
        supplier_name="Acme", operational_exposure_band="CRITICAL",
    )
    out = risk.with_explanations(spark.createDataFrame([row])).first()
    assert out.explanation_summary.startswith(
        "Elevated critical operational exposure because projected 7-day demand (100 units) exceeds available inventory (40 units) by 60 units; Severely"
    )
    assert out.recommended_action.startswith("URGENT")
    assert len(out.evidence_bullets.split(" | ")) == 4
    calm = row | dict(forecast_demand_7d=1, inventory_days_of_supply=20.0, safety_stock_target=1, stockout_count_7d=0, stockout_rate_28d=0.0,
                      supplier_delay_probability=0.1, hist_on_time_rate=0.9, hist_p90_delay=1.0, supplier_capacity_pressure=0.1, criticality="Low",
                      warehouse_capacity_utilization_lag1=10.0, operational_exposure_band="LOW")
    quiet = risk.with_explanations(spark.createDataFrame([calm])).first()
    assert quiet.explanation_summary.startswith("LOW operational exposure: Stable buffer health")


def test_composites(spark):
    df = spark.createDataFrame([(0.5, "critical", 10.0, 40.0), (0.5, "unknown", 500.0, 40.0)], "p double, c string, inv double, ss double")
    rows = df.select(risk.supplier_vulnerability("p", "c").alias("v"), risk.buffer_deficiency("inv", "ss").alias("b")).collect()
    assert [(r.v, r.b) for r in rows] == [(1.5, 0.75), (0.75, -2.0)]
