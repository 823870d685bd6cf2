"""The quality and cleaning queries on a copy of the tables with faults of every kind, against the same SQL."""

import compare
import pytest

from oracle import checks
from oracle.star import names_in, sql
from supplyspark import catalog
from supplyspark.sources.adapter import StagedStar
from supplyspark.sources.schemas import SPECS

FOLDER = "/root/testdata/sf0.001"


def select(columns, source, where="TRUE", **changes):
    listed = ", ".join(f"{changes[c]} AS {c}" if c in changes else c for c in columns)
    return f"SELECT {listed} FROM {source} WHERE {where}"


def faults(columns):
    """For each table, one statement that both engines run over the table as given."""
    d, o, i, t = (columns[x] for x in ("demand", "orders", "inventory", "transport"))
    demand = select(
        d, "{demand}",
        date="CASE WHEN demand_requested = 13 THEN CAST(date + INTERVAL '4000' DAY AS DATE) ELSE date END",
        product_id="CASE WHEN demand_requested = 7 THEN NULL WHEN demand_requested = 8 THEN 'Brand#999' ELSE product_id END",
        warehouse_id="CASE WHEN demand_requested = 21 THEN 'WH-X' ELSE warehouse_id END",
        market_id="CASE WHEN demand_requested = 22 THEN ' ' ELSE market_id END",
        demand_requested="CASE WHEN demand_requested % 10 = 9 THEN -demand_requested WHEN demand_requested = 33 THEN 3300 ELSE demand_requested END",
        event_id="CASE WHEN event_id = 'NONE' THEN '' ELSE event_id END",
    )
    # Copies of changed rows, some of them twice.
    demand = f"WITH faulty AS ({demand}) SELECT * FROM faulty UNION ALL SELECT * FROM faulty WHERE demand_requested IN (7, 31) UNION ALL SELECT * FROM faulty WHERE demand_requested = 31"
    sign = "CASE WHEN quantity_ordered % 9 = 4 THEN -{0} ELSE {0} END"
    orders = select(
        o, "{orders}",
        supplier_id="CASE WHEN quantity_ordered = 11 THEN 'SUP-X' WHEN quantity_ordered = 12 THEN NULL ELSE supplier_id END",
        product_id="CASE WHEN quantity_ordered = 13 THEN 'Brand#999' ELSE product_id END",
        order_date="CASE WHEN quantity_ordered = 14 THEN CAST(order_date - INTERVAL '9000' DAY AS DATE) ELSE order_date END",
        unit_cost=sign.format("unit_cost"), total_procurement_cost=sign.format("total_procurement_cost"),
    )
    conflicting = select(o, "faulty", "quantity_ordered = 17", quantity_received="quantity_received - 1", order_date="CAST(order_date + INTERVAL '1' DAY AS DATE)")
    orders = f"WITH faulty AS ({orders}) SELECT * FROM faulty UNION ALL {conflicting} UNION ALL SELECT * FROM faulty WHERE quantity_ordered IN (4, 18)"
    stock = select(
        i, "{inventory}",
        ending_inventory="CASE WHEN demand_requested = 5 THEN -1 WHEN demand_requested = 6 THEN ending_inventory + 2 ELSE ending_inventory END",
        holding_cost="CASE WHEN demand_requested = 8 THEN -1.0 ELSE holding_cost END",
    )
    stock = f"WITH faulty AS ({stock}) SELECT * FROM faulty UNION ALL SELECT * FROM faulty WHERE demand_requested = 12"
    moved = select(
        t, "{transport}",
        po_id="CASE WHEN quantity_transported = 12 THEN 'PO-X' WHEN quantity_transported = 13 THEN NULL ELSE po_id END",
        transport_id="CASE WHEN quantity_transported = 14 THEN 'NULL' ELSE transport_id END",
    )
    return {"demand": demand, "orders": orders, "inventory": stock, "transport": moved}


@pytest.fixture(scope="module")
def faulty(spark):
    """The view over faulted tables, and the SQL with the same faults in it."""
    star = StagedStar(spark, FOLDER)
    given = {"demand": star.fact_demand, "orders": star.fact_purchase_orders, "inventory": star.ledger, "transport": star.fact_transport}
    texts = faults({name: df.columns for name, df in given.items()})
    changed = {name: spark.sql(text, **{name: given[name]}) for name, text in texts.items()}
    view = type("Faulty", (catalog.View,), {f"raw_{name}": property(lambda _, df=df: df) for name, df in changed.items()})(star)
    bodies = {"demand": "fact_demand", "orders": "fact_purchase_orders", "inventory": "fact_inventory", "transport": f"({checks.VIEWS['raw_transport']})"}
    return view, checks.with_faults({f"raw_{name}": text.format(**{name: bodies[name]}) for name, text in texts.items()})


@pytest.mark.parametrize("name", sorted(checks.QUALITY))
def test_matches_sql_on_faults(faulty, name):
    view, statements = faulty
    assert compare.differences(catalog.QUERIES[name](view), compare.connect(FOLDER), statements[name]) == []


def test_every_rule_and_action_occurs(faulty):
    """The comparison above is about something: all rules, all actions, full samples."""
    from supplyspark.operators import cleaning, quality

    view, _ = faulty
    rows = catalog.QUERIES["dq_samples"](view).collect()
    assert {r.rule_id for r in rows} == set(quality.RULES)
    assert {len(r.samples.split(",")) for r in rows if r.rule_id != "DQ-001" and r.row_count > 50} == {quality.SAMPLE}
    found = {(r.table_name, r.action) for r in catalog.QUERIES["audit_trail"](view).collect()}
    assert found == {(table, action) for table, actions in cleaning.ACTIONS.items() for action in actions}


def test_a_table_is_scanned_once(spark, faulty):
    """The pass over orders: one scan of the orders, no matter how many rules there are."""
    from supplyspark.operators import audit

    view, _ = faulty
    star = view.star
    plan = audit.table_violations("fact_purchase_orders", star.fact_purchase_orders, star.tables(), (1995, 2001))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("quantity_received") == 0  # columns without a rule are not read
    assert sum("FileScan parquet" in line and "total_procurement_cost" in line for line in plan.splitlines()) == 1


def test_statements_use_the_faulted_views():
    assert all({"raw_demand", "raw_orders"} & set(names_in(sql(text))) for name, text in checks.QUALITY.items() if name not in ("clean_demand",))
    assert set(SPECS) == set(checks._PROFILED)
