"""Quality and cleaning queries cover the whole of the tables given."""

import compare
import pytest
from pyspark.sql import functions as F

from oracle.star import sql
from supplyspark import catalog
from supplyspark.operators import audit, cleaning
from supplyspark.plans import reconcile
from supplyspark.sources.adapter import StagedStar
from supplyspark.sources.schemas import SPECS

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    return compare.connect(FOLDER)


@pytest.fixture(scope="module")
def view(spark):
    return catalog.View(StagedStar(spark, FOLDER))


def test_cleaning_keeps_every_purchase(view, oracle):
    rows = catalog.QUERIES["clean_po"](view)
    assert compare.differences(rows, oracle, sql("SELECT * FROM fact_purchase_orders")) == []
    assert rows.count() == oracle.execute("SELECT count(*) FROM lineitem").fetchone()[0]
    actions = {(r.table_name, r.action) for r in catalog.QUERIES["audit_trail"](view).collect()}
    assert ("fact_purchase_orders", "DEDUPLICATE_PRIMARY_KEY") not in actions


def test_audit_reports_ledger_transport_and_calendar_faults(spark, view):
    s = view.star
    key = s.ledger.agg(F.min("product_id"), F.min("warehouse_id"), F.min("date")).first()
    one = s.ledger.filter((F.col("product_id") == key[0]) & (F.col("warehouse_id") == key[1]) & (F.col("date") == key[2]))
    stock = s.ledger.unionByName(one).unionByName(
        one.withColumns({"product_id": F.lit("Brand#999"), "warehouse_id": F.lit("WH-X"), "ending_inventory": F.lit(-1).cast("long")})
    )
    lost = s.fact_transport.orderBy("transport_id").limit(1).withColumns({"po_id": F.lit("PO-X"), "transport_id": F.lit("")})
    day = s.dim_date.limit(1).withColumn("date", F.lit("2050-01-01").cast("date"))
    changed = view.given_tables | {
        "fact_inventory": stock, "fact_transport": s.fact_transport.unionByName(lost), "dim_date": s.dim_date.unionByName(day),
    }
    faulty = catalog.View(s)
    faulty.__dict__["given_tables"] = changed

    def found(v):
        rows = catalog.QUERIES["dq_issues"](v).collect()
        return {(r.rule_id, r.table_name, r.column_name): r.row_count for r in rows}

    before, after = found(view), found(faulty)
    assert {k: n for k, n in after.items() if before.get(k) != n} == {
        ("DQ-001", "fact_transport", "transport_id"): 1,
        ("DQ-002", "dim_date", "date"): 1,
        ("DQ-003", "fact_inventory", "date, product_id, warehouse_id"): 1,
        ("DQ-004", "fact_inventory", "ending_inventory"): 1,
        ("DQ-005", "fact_inventory", "product_id"): 1,
        ("DQ-005", "fact_inventory", "warehouse_id"): 1,
        ("DQ-005", "fact_transport", "po_id"): 1,
    }


def test_audit_fails_without_a_table_or_column(view):
    tables = view.given_tables
    with pytest.raises(ValueError, match="fact_inventory"):
        audit.audit({t: df for t, df in tables.items() if t != "fact_inventory"})
    with pytest.raises(ValueError, match="fact_purchase_orders.quantity_ordered"):
        audit.audit(tables | {"fact_purchase_orders": tables["fact_purchase_orders"].drop("quantity_ordered")})


def test_profile_has_every_table(view, oracle):
    rows = {r.table_name: r for r in catalog.QUERIES["table_profile"](view).collect()}
    assert set(rows) == set(SPECS)
    for name in ("fact_inventory", "fact_purchase_orders", "dim_date", "dim_product"):
        assert rows[name].rows == oracle.execute(sql(f"SELECT count(*) FROM {name}")).fetchone()[0]
    assert {n: r.columns for n, r in rows.items()} == {n: len(spec.schema) for n, spec in SPECS.items()}


def test_cleaning_covers_the_four_facts(view):
    assert set(view.cleaned_tables[1]) == {"fact_demand", "fact_purchase_orders", "fact_inventory", "fact_transport"}
    totals = {(r.phase, r.severity): r.row_count for r in catalog.QUERIES["severity_before_after"](view).collect()}
    assert totals.get(("after", "ERROR"), 0) <= totals.get(("before", "ERROR"), 0)


def test_cost_identity_covers_repaired_orders(spark, view):
    s = view.star
    returned = F.xxhash64("po_id") % 3 == 0
    twice = s.fact_purchase_orders.filter(F.xxhash64("po_id") % 50 == 1)
    raw = s.fact_purchase_orders.unionByName(twice).unionByName(twice).withColumns(
        {c: F.when(returned, -F.col(c)).otherwise(F.col(c)) for c in ("unit_cost", "total_procurement_cost")}
    )
    faulty = catalog.View(s)
    faulty.__class__ = type("Faulty", (catalog.View,), {"raw_orders": property(lambda _: raw)})
    row = catalog.QUERIES["cross_stage_cost"](faulty).first()
    total = raw.agg(F.sum(F.col("total_procurement_cost") + F.col("transport_cost"))).first()[0]
    assert row.source_value == pytest.approx(total, abs=0.01)
    assert row.passed and row.difference <= 0.05
    # A repair that pays double for a product is found: here one with two master rows.
    double = s.dim_product.unionByName(s.dim_product.orderBy("product_id").limit(1))
    c = cleaning.clean_purchase_orders(raw, s.dim_supplier, double, faulty.order_rank)
    quarantined = c.quarantine.withColumns({x: F.col(x) * F.col("copies") for x in ("total_procurement_cost", "transport_cost")})
    assert not reconcile.cross_stage_cost(raw, c.rows, quarantined, c.repaired_cost).first().passed


def with_faults(demand):
    """Deterministic faults: lost and unknown products, sign errors, days outside the calendar, blank events."""
    q = F.col("demand_requested")
    return demand.select(
        F.when(q == 13, F.date_add("date", 4000)).otherwise(F.col("date")).alias("date"),
        F.when(q == 7, F.lit(None)).when(q == 8, F.lit("Brand#999")).otherwise(F.col("product_id")).alias("product_id"),
        "market_id",
        "warehouse_id",
        F.when(q % 10 == 9, -q).otherwise(q).alias("demand_requested"),
        "promotion_flag",
        F.when(F.col("event_id") == "NONE", F.lit("")).otherwise(F.col("event_id")).alias("event_id"),
        "outlier_flag",
    )


def test_demand_is_read_as_given(view, oracle):
    columns = "date, product_id, market_id, warehouse_id, demand_requested, promotion_flag, event_id"
    cleaned = catalog.QUERIES["clean_demand"](view).select(*columns.split(", "))
    assert compare.differences(cleaned, oracle, sql(f"SELECT DISTINCT {columns} FROM fact_demand")) == []
    row = catalog.QUERIES["cross_stage_demand"](view).first()
    assert row.passed and row.source_value == oracle.execute(sql("SELECT sum(demand_requested) FROM fact_demand")).fetchone()[0]
    found = {(r.rule_id, r.column_name) for r in catalog.QUERIES["dq_issues"](view).collect() if r.table_name == "fact_demand"}
    assert not found & {("DQ-001", "product_id"), ("DQ-002", "date"), ("DQ-004", "demand_requested"), ("DQ-005", "product_id")}


def test_demand_with_faults_is_cleaned_by_the_operator(view):
    s = view.star
    raw = with_faults(s.fact_demand)
    faulty = type("Faulty", (catalog.View,), {"raw_demand": property(lambda _: raw)})(s)
    actions = {r.action for r in faulty.cleaned_demand.actions.filter("records_affected > 0").collect()}
    assert actions >= {"QUARANTINE_NULL_OR_ORPHAN_KEY", "QUARANTINE_INVALID_DATE", "REPAIR_NEGATIVE_VALUE"}
    assert catalog.QUERIES["cross_stage_demand"](faulty).first().passed
