"""Oracle SQL per query name: ``ORACLE[name]`` is one DuckDB statement."""

from __future__ import annotations

import re

from oracle.star import VIEWS, names_in, sql, view

ORACLE: dict[str, str] = {}
TRAIN_END, VAL_END, CUTOFF = "DATE '1999-06-30'", "DATE '2000-06-30'", "2000-06-30"


def hu(x: str, n: int) -> str:
    """Half away from zero on the scaled binary value."""
    s = f"{float(10**n)!r}::DOUBLE"
    return f"(sign({x}) * (floor(abs({x}) * {s} + 0.5::DOUBLE) / {s}))"


def he(x: str, n: int) -> str:
    """Half to even on the scaled binary value."""
    s = f"{float(10**n)!r}::DOUBLE"
    return f"(round_even(({x}) * {s}, 0) / {s})"


def ratio(a: str, b: str) -> str:
    return f"(({a})::DOUBLE / nullif(({b})::DOUBLE, 0))"


def put(name: str, query: str) -> None:
    ORACLE[name] = sql(query)


def mean2(c: str) -> str:
    """Mean of two-decimal values, summed exactly in hundredths."""
    return f"(sum(CAST(round({c} * 100.0::DOUBLE) AS BIGINT))::DOUBLE / count({c})::DOUBLE / 100.0::DOUBLE)"


def std(n: str, s1: str, s2: str, ddof: int = 1) -> str:
    n, s1, s2 = f"({n})::DOUBLE", f"({s1})::DOUBLE", f"({s2})::DOUBLE"
    return f"CASE WHEN {n} > {ddof} THEN sqrt(greatest({n} * {s2} - {s1} * {s1}, 0) / ({n} * ({n} - {ddof}))) END"


# ---------------------------------------------------------------------- rollups
view("daily_demand", """
SELECT d.date, d.product_id, p.product_name, p.category, d.warehouse_id, w.warehouse_name,
       count(DISTINCT market_id) AS markets_count, CAST(sum(demand_requested) AS BIGINT) AS demand_requested,
       max(promotion_flag) AS promotion_flag, max(CASE WHEN event_id <> 'NONE' THEN 1 ELSE 0 END) AS event_flag,
       max(outlier_flag) AS outlier_flag, CAST(sum(outlier_flag) AS BIGINT) AS outlier_market_count
FROM fact_demand d JOIN dim_product p ON d.product_id = p.product_id JOIN dim_warehouse w ON d.warehouse_id = w.warehouse_id
GROUP BY d.date, d.product_id, p.product_name, p.category, d.warehouse_id, w.warehouse_name
""")
view("supplier_performance", f"""
SELECT strftime(order_date, '%Y-%m') AS year_month, s.supplier_id, s.supplier_name, s.tier, count(po_id) AS total_orders,
       CAST(sum(quantity_ordered) AS BIGINT) AS units_ordered, CAST(sum(quantity_received) AS BIGINT) AS units_received,
       {hu('avg(on_time_flag) * 100.0::DOUBLE', 2)} AS on_time_rate_pct, {hu('avg(in_full_flag) * 100.0::DOUBLE', 2)} AS in_full_rate_pct,
       {hu('avg(otif_flag) * 100.0::DOUBLE', 2)} AS otif_rate_pct, {hu('avg(delay_days)', 2)} AS avg_delay_days,
       {hu('sum(total_procurement_cost)', 2)} AS total_procurement_cost, {hu('sum(transport_cost)', 2)} AS total_freight_cost
FROM fact_purchase_orders po JOIN dim_supplier s ON po.supplier_id = s.supplier_id
GROUP BY 1, 2, 3, 4
""")
view("warehouse_operations", f"""
SELECT i.date, w.warehouse_id, w.warehouse_name, w.capacity_units, CAST(sum(ending_inventory) AS BIGINT) AS ending_inventory,
       {hu('sum(ending_inventory)::DOUBLE / w.capacity_units::DOUBLE * 100.0::DOUBLE', 2)} AS capacity_utilization_pct,
       CAST(sum(demand_requested) AS BIGINT) AS demand_requested, CAST(sum(demand_fulfilled) AS BIGINT) AS demand_fulfilled,
       CAST(sum(lost_sales_quantity) AS BIGINT) AS lost_sales_units, CAST(sum(stockout_flag) AS BIGINT) AS stockout_skus_count,
       {hu('sum(holding_cost)', 2)} AS holding_cost, {hu('sum(stockout_cost)', 2)} AS stockout_cost
FROM fact_inventory i JOIN dim_warehouse w ON i.warehouse_id = w.warehouse_id
GROUP BY i.date, w.warehouse_id, w.warehouse_name, w.capacity_units
""")
view("cost_rows", """
SELECT i.year_month, w.warehouse_id, w.warehouse_name, coalesce(p.pc, 0) AS procurement_cost, coalesce(i.hc, 0) AS holding_cost,
       coalesce(i.sc, 0) AS stockout_cost, coalesce(p.tc, 0) AS transport_cost,
       coalesce(p.pc, 0) + coalesce(i.hc, 0) + coalesce(i.sc, 0) + coalesce(p.tc, 0) AS total_operational_cost
FROM dim_warehouse w
JOIN (SELECT strftime(date, '%Y-%m') AS year_month, warehouse_id, sum(holding_cost) AS hc, sum(stockout_cost) AS sc FROM fact_inventory GROUP BY 1, 2) i
  ON w.warehouse_id = i.warehouse_id
LEFT JOIN (SELECT strftime(order_date, '%Y-%m') AS year_month, warehouse_id, sum(total_procurement_cost) AS pc, sum(transport_cost) AS tc FROM fact_purchase_orders GROUP BY 1, 2) p
  ON w.warehouse_id = p.warehouse_id AND i.year_month = p.year_month
""")
put("daily_demand_rollup", "SELECT * FROM daily_demand")
HEALTH = ("beginning_inventory, po_received, demand_requested, demand_fulfilled, lost_sales_quantity, ending_backorder, "
          "ending_inventory, stockout_flag, stockout_quantity, safety_stock_target")  # fmt: skip
put("inventory_health", f"""
SELECT i.date, i.product_id, product_name, category, criticality, i.warehouse_id, warehouse_name, {HEALTH},
       {hu(ratio('ending_inventory', 'safety_stock_target'), 2)} AS safety_stock_coverage, holding_cost, stockout_cost
FROM fact_inventory i JOIN dim_product p ON i.product_id = p.product_id JOIN dim_warehouse w ON i.warehouse_id = w.warehouse_id
""")
put("supplier_monthly", "SELECT * FROM supplier_performance")
put("warehouse_daily", "SELECT * FROM warehouse_operations")
put("cost_summary", "SELECT * FROM cost_rows")
put("product_supply_risk", f"""
SELECT i.product_id, product_name, category, criticality, primary_supplier_id, s.supplier_name AS primary_supplier_name,
       s.baseline_reliability AS supplier_reliability, i.warehouse_id, warehouse_name,
       {hu('avg(ending_inventory)', 1)} AS avg_inventory_units, {hu('avg(demand_requested)', 1)} AS avg_daily_demand,
       {hu('avg(ending_inventory) / nullif(avg(demand_requested), 0)', 1)} AS avg_days_of_coverage,
       CAST(sum(stockout_flag) AS BIGINT) AS stockout_days_count,
       {hu('sum(stockout_flag)::DOUBLE / count(*) * 100.0::DOUBLE', 2)} AS stockout_frequency_pct,
       CAST(sum(lost_sales_quantity) AS BIGINT) AS total_lost_sales_units,
       {hu('sum(demand_fulfilled)::DOUBLE / nullif(sum(demand_requested), 0)::DOUBLE * 100.0::DOUBLE', 2)} AS service_level_pct,
       CASE WHEN sum(stockout_flag)::DOUBLE / count(*) >= 0.15::DOUBLE OR s.baseline_reliability < 0.85::DOUBLE THEN 'HIGH'
            WHEN sum(stockout_flag)::DOUBLE / count(*) >= 0.05::DOUBLE THEN 'MEDIUM' ELSE 'LOW' END AS empirical_risk_tier
FROM fact_inventory i JOIN dim_product p ON i.product_id = p.product_id JOIN dim_warehouse w ON i.warehouse_id = w.warehouse_id
JOIN dim_supplier s ON p.primary_supplier_id = s.supplier_id
GROUP BY i.product_id, product_name, category, criticality, primary_supplier_id, s.supplier_name, s.baseline_reliability, i.warehouse_id, warehouse_name
""")

# ---------------------------------------------------------------------- queries
DAYS = "(SELECT count(*) FROM dim_date)::DOUBLE"
put("inventory_turnover", f"""
SELECT category, w.warehouse_id, warehouse_name, count(DISTINCT i.product_id) AS active_skus,
       CAST(sum(demand_fulfilled) AS BIGINT) AS total_fulfilled_units, {hu('avg(ending_inventory)', 1)} AS avg_daily_inventory_units,
       {hu('sum(holding_cost)', 2)} AS total_holding_cost,
       {hu(f"sum(demand_fulfilled)::DOUBLE / nullif(avg(ending_inventory), 0) * (365.25::DOUBLE / {DAYS})", 2)} AS annualized_inventory_turnover,
       {hu(f"avg(ending_inventory) / nullif(sum(demand_fulfilled)::DOUBLE / {DAYS}, 0)", 1)} AS days_of_inventory_coverage
FROM fact_inventory i JOIN dim_product p ON i.product_id = p.product_id JOIN dim_warehouse w ON i.warehouse_id = w.warehouse_id
GROUP BY category, w.warehouse_id, warehouse_name
""")
put("supplier_otif", f"""
SELECT s.supplier_id, supplier_name, tier, baseline_reliability, baseline_lead_time_days, count(po_id) AS total_purchase_orders,
       CAST(sum(quantity_ordered) AS BIGINT) AS total_units_ordered, CAST(sum(quantity_received) AS BIGINT) AS total_units_received,
       {hu('avg(on_time_flag) * 100.0::DOUBLE', 2)} AS on_time_delivery_pct, {hu('avg(in_full_flag) * 100.0::DOUBLE', 2)} AS in_full_delivery_pct,
       {hu('avg(otif_flag) * 100.0::DOUBLE', 2)} AS composite_otif_pct, {hu('avg(delay_days)', 2)} AS avg_delay_days,
       {hu('sum(total_procurement_cost)', 2)} AS total_procurement_value
FROM dim_supplier s LEFT JOIN fact_purchase_orders po ON s.supplier_id = po.supplier_id
GROUP BY s.supplier_id, supplier_name, tier, baseline_reliability, baseline_lead_time_days
""")
put("service_level_by_category", f"""
SELECT category, count(DISTINCT i.product_id) AS sku_count, CAST(sum(demand_requested) AS BIGINT) AS total_demand_requested,
       CAST(sum(demand_fulfilled) AS BIGINT) AS total_demand_fulfilled, CAST(sum(lost_sales_quantity) AS BIGINT) AS total_lost_sales_units,
       {hu('sum(demand_fulfilled)::DOUBLE / nullif(sum(demand_requested), 0)::DOUBLE * 100.0::DOUBLE', 2)} AS service_level_pct,
       CAST(sum(stockout_flag) AS BIGINT) AS stockout_days_count, count(*) AS total_sku_wh_days,
       {hu('sum(stockout_flag)::DOUBLE / count(*) * 100.0::DOUBLE', 2)} AS stockout_frequency_pct, {hu('sum(stockout_cost)', 2)} AS total_stockout_penalty_cost
FROM fact_inventory i JOIN dim_product p ON i.product_id = p.product_id GROUP BY category
""")
put("category_performance", f"""
SELECT category, count(DISTINCT i.product_id) AS sku_count, CAST(sum(demand_requested) AS BIGINT) AS total_demand_requested,
       CAST(sum(demand_fulfilled) AS BIGINT) AS total_demand_fulfilled, CAST(sum(lost_sales_quantity) AS BIGINT) AS total_lost_sales_units,
       {hu('sum(demand_fulfilled)::DOUBLE / nullif(sum(demand_requested), 0)::DOUBLE * 100.0::DOUBLE', 2)} AS service_level_pct,
       CAST(sum(stockout_flag) AS BIGINT) AS stockout_sku_days,
       {hu('sum(stockout_flag)::DOUBLE / count(*) * 100.0::DOUBLE', 2)} AS stockout_frequency_pct, {hu('avg(ending_inventory)', 1)} AS avg_inventory_units,
       {hu('sum(holding_cost)', 2)} AS total_holding_cost, {hu('sum(stockout_cost)', 2)} AS total_stockout_cost
FROM fact_inventory i JOIN dim_product p ON i.product_id = p.product_id GROUP BY category
""")
put("warehouse_cost_breakdown", f"""
SELECT w.warehouse_id, warehouse_name, capacity_units, coalesce(pc, 0) AS procurement_cost, coalesce(hc, 0) AS holding_cost,
       coalesce(sc, 0) AS stockout_cost, coalesce(tc, 0) AS transport_cost,
       {hu('coalesce(pc, 0) + coalesce(hc, 0) + coalesce(sc, 0) + coalesce(tc, 0)', 2)} AS total_operational_cost
FROM dim_warehouse w
LEFT JOIN (SELECT warehouse_id, {hu('sum(holding_cost)', 2)} AS hc, {hu('sum(stockout_cost)', 2)} AS sc FROM fact_inventory GROUP BY 1) i ON w.warehouse_id = i.warehouse_id
LEFT JOIN (SELECT warehouse_id, {hu('sum(total_procurement_cost)', 2)} AS pc, {hu('sum(transport_cost)', 2)} AS tc FROM fact_purchase_orders GROUP BY 1) p ON w.warehouse_id = p.warehouse_id
""")
MONEY = ("procurement_cost", "holding_cost", "stockout_cost", "transport_cost", "total_operational_cost")
put("executive_kpis", f"""
SELECT (SELECT count(*) FROM dim_product) AS products, (SELECT count(*) FROM dim_supplier) AS suppliers,
       (SELECT count(*) FROM dim_warehouse) AS warehouses, (SELECT count(*) FROM dim_market) AS markets, c.*,
       (SELECT CAST(sum(demand_requested) AS BIGINT) FROM daily_demand) AS total_commercial_demand_requested,
       req AS total_warehouse_demand_requested, req AS total_demand_requested, ful AS total_demand_fulfilled, lost AS total_lost_sales_units,
       {hu('ful::DOUBLE / nullif(req, 0)::DOUBLE * 100.0::DOUBLE', 2)} AS service_level_pct,
       {hu('outs::DOUBLE / n * 100.0::DOUBLE', 2)} AS stockout_frequency_pct, n AS total_sku_warehouse_days, outs AS stockout_sku_warehouse_days,
       {hu('ful::DOUBLE / nullif(stock::DOUBLE / days, 0) * (365.25::DOUBLE / days)', 2)} AS annualized_inventory_turnover, s.*
FROM (SELECT {', '.join(f"{hu(f'sum({c})', 2)} AS {c if c.startswith('total') else 'total_' + c}" for c in MONEY)} FROM cost_rows) c,
     (SELECT CAST(sum(demand_requested) AS BIGINT) AS req, CAST(sum(demand_fulfilled) AS BIGINT) AS ful, CAST(sum(lost_sales_quantity) AS BIGINT) AS lost,
             count(*) AS n, CAST(sum(stockout_flag) AS BIGINT) AS outs, sum(ending_inventory) AS stock, count(DISTINCT date)::DOUBLE AS days FROM fact_inventory),
     (SELECT CAST(sum(total_orders) AS BIGINT) AS total_purchase_orders, CAST(sum(units_ordered) AS BIGINT) AS total_units_ordered,
             CAST(sum(units_received) AS BIGINT) AS total_units_received, {hu(mean2('otif_rate_pct'), 2)} AS supplier_otif_pct,
             {hu(mean2('avg_delay_days'), 2)} AS supplier_avg_delay_days FROM supplier_performance) s
""")
put("monthly_cost", f"SELECT year_month, {', '.join(f'{hu(f'sum({c})', 2)} AS {c}' for c in MONEY)} FROM cost_rows GROUP BY year_month")
put("monthly_cost_one_warehouse", "SELECT * FROM cost_rows WHERE warehouse_id = 'WH-2'")
put("supplier_scorecard", f"""
SELECT s.supplier_id, s.supplier_name, s.tier, baseline_lead_time_days AS contractual_lead_time_days, baseline_reliability,
       CAST(sum(total_orders) AS BIGINT) AS total_orders, CAST(sum(units_ordered) AS BIGINT) AS units_ordered, CAST(sum(units_received) AS BIGINT) AS units_received,
       {', '.join(f"{hu(mean2(c), 2)} AS {c}" for c in ('on_time_rate_pct', 'in_full_rate_pct', 'otif_rate_pct', 'avg_delay_days'))},
       {hu('sum(total_procurement_cost)', 2)} AS total_spend, {hu('sum(p.total_freight_cost)', 2)} AS total_freight_cost,
       any_value(med) AS median_delay_days, any_value(p90) AS p90_delay_days
FROM dim_supplier s LEFT JOIN supplier_performance p ON s.supplier_id = p.supplier_id
LEFT JOIN (SELECT supplier_id, quantile_cont(delay_days::DOUBLE, 0.5) AS med, quantile_cont(delay_days::DOUBLE, 0.9) AS p90 FROM fact_purchase_orders GROUP BY 1) d ON s.supplier_id = d.supplier_id
GROUP BY 1, 2, 3, 4, 5
""")
put("warehouse_capacity", f"""
SELECT warehouse_id, warehouse_name, capacity_units, {hu('avg(ending_inventory)', 1)} AS avg_ending_inventory, max(ending_inventory) AS peak_ending_inventory,
       {hu(mean2('capacity_utilization_pct'), 2)} AS avg_capacity_utilization_pct, {hu('max(capacity_utilization_pct)', 2)} AS peak_capacity_utilization_pct,
       CAST(sum(demand_requested) AS BIGINT) AS total_demand_requested, CAST(sum(demand_fulfilled) AS BIGINT) AS total_demand_fulfilled,
       CAST(sum(lost_sales_units) AS BIGINT) AS total_lost_sales_units, CAST(sum(stockout_skus_count) AS BIGINT) AS total_stockout_events,
       {hu('sum(holding_cost)', 2)} AS total_holding_cost, {hu('sum(stockout_cost)', 2)} AS total_stockout_cost
FROM warehouse_operations GROUP BY 1, 2, 3
""")
put("demand_volatility_hhi", f"""
SELECT v.product_id, product_name, category, mean_daily_demand, std_daily_demand, total_product_demand,
       {hu('coalesce(std_daily_demand / nullif(mean_daily_demand, 0), 0)', 3)} AS demand_cv, market_hhi
FROM (SELECT product_id, product_name, category, {hu('avg(demand_requested)', 2)} AS mean_daily_demand,
             {hu(std('count(*)', 'sum(demand_requested)', 'sum(demand_requested * demand_requested)', 0), 2)} AS std_daily_demand,
             CAST(sum(demand_requested) AS BIGINT) AS total_product_demand FROM daily_demand GROUP BY 1, 2, 3) v
LEFT JOIN (SELECT product_id, {hu('sum(q * q) * 10000.0::DOUBLE / (sum(q) * sum(q))', 1)} AS market_hhi
           FROM (SELECT product_id, market_id, sum(demand_requested)::DOUBLE AS q FROM fact_demand GROUP BY 1, 2) GROUP BY 1) h ON v.product_id = h.product_id
""")
view("stockout_runs", """
SELECT product_id, warehouse_id, min(date) AS first_day, max(date) AS last_day, count(*) AS streak_days
FROM (SELECT product_id, warehouse_id, date, date - CAST(row_number() OVER (PARTITION BY product_id, warehouse_id ORDER BY date) AS INTEGER) AS island
      FROM fact_inventory WHERE stockout_flag = 1)
GROUP BY product_id, warehouse_id, island
""")
put("stockout_durations", f"""
SELECT CASE WHEN streak_days = 1 THEN '1 Day (Transient)' WHEN streak_days = 2 THEN '2 Days (Short)'
            WHEN streak_days <= 5 THEN '3-5 Days (Moderate)' ELSE '6+ Days (Severe/Disrupted)' END AS duration_bracket,
       count(*) AS episode_count, CAST(sum(streak_days) AS BIGINT) AS total_stockout_days, {hu('avg(streak_days)', 2)} AS avg_streak_days,
       max(streak_days) AS max_streak_days, {hu('count(*)::DOUBLE / (SELECT count(*) FROM stockout_runs)::DOUBLE * 100.0::DOUBLE', 2)} AS pct_of_episodes
FROM stockout_runs GROUP BY 1
""")
put("stockout_episodes", "SELECT * FROM stockout_runs")
put("kpi_by_warehouse", f"""
SELECT i.warehouse_id, {ratio('sum(demand_fulfilled)', 'sum(demand_requested)')} * 100.0::DOUBLE AS unit_fill,
       {ratio('sum(stockout_flag)', 'count(*)')} * 100.0::DOUBLE AS stockout_frequency,
       {ratio('sum(lost_sales_quantity)', 'sum(demand_requested)')} * 100.0::DOUBLE AS lost_sales_rate,
       sum(demand_fulfilled)::DOUBLE / avg(ending_inventory) * (365.25::DOUBLE / {DAYS}) AS annual_turnover,
       round(sum(ending_inventory * unit_cost * 0.20::DOUBLE / 365.25::DOUBLE), 4) AS holding_cost,
       sum(lost_sales_quantity * selling_price * 1.5::DOUBLE) AS stockout_penalty,
       {ratio('sum(ending_inventory)', 'max(capacity_units)')} * 100.0::DOUBLE AS capacity_utilisation,
       {he('stddev_pop(demand_requested) / avg(demand_requested)', 6)} AS demand_cv
FROM fact_inventory i JOIN dim_product p ON i.product_id = p.product_id JOIN dim_warehouse w ON i.warehouse_id = w.warehouse_id
GROUP BY i.warehouse_id
""")
put("kpi_by_tier", """
SELECT tier, avg(on_time_flag) * 100.0::DOUBLE AS on_time_rate, avg(otif_flag) * 100.0::DOUBLE AS otif_rate, avg(delay_days) AS mean_delay,
       quantile_cont(delay_days::DOUBLE, 0.9) AS p90_delay, quantile_cont(delay_days::DOUBLE, 0.95) AS p95_delay,
       sum(quantity_received * unit_cost) AS procurement_cost, sum(transport_cost) AS freight_cost
FROM fact_purchase_orders po JOIN dim_supplier s ON po.supplier_id = s.supplier_id GROUP BY tier
""")

# --------------------------------------------------------------- reconciliation
put("fanout_audit", """
SELECT t AS true_holding_cost, s AS summary_holding_cost, nv AS naive_holding_cost, nv / nullif(t, 0) AS inflation_factor,
       abs(s - t) <= 0.05::DOUBLE AND nv > 10 * t AS passed
FROM (SELECT sum(holding_cost) AS t FROM fact_inventory), (SELECT sum(holding_cost) AS s FROM cost_rows),
     (SELECT sum(c * n) AS nv FROM (SELECT warehouse_id, sum(holding_cost) AS c FROM fact_inventory GROUP BY 1)
      JOIN (SELECT warehouse_id, count(*) AS n FROM fact_purchase_orders GROUP BY 1) USING (warehouse_id))
""")
_INV = ("ending_inventory", "demand_requested", "demand_fulfilled", "lost_sales_quantity", "stockout_flag", "holding_cost", "stockout_cost")
_inv_rows = " UNION ALL ".join(
    f"SELECT 'RC2' AS check_id, '{c}' AS metric, sum({c})::DOUBLE AS a, sum({c})::DOUBLE AS b FROM fact_inventory" for c in _INV
)
_cost_src = {
    "procurement_cost": "(SELECT sum(total_procurement_cost) FROM fact_purchase_orders)",
    "holding_cost": "(SELECT sum(holding_cost) FROM fact_inventory)",
    "stockout_cost": "(SELECT sum(stockout_cost) FROM fact_inventory)",
    "transport_cost": "(SELECT sum(transport_cost) FROM fact_purchase_orders)",
}
_cost_src["total_operational_cost"] = " + ".join(_cost_src.values())
_cost_rows = " UNION ALL ".join(
    f"SELECT 'RC3', '{c}', ({src})::DOUBLE, (SELECT sum({c}) FROM cost_rows)::DOUBLE" for c, src in _cost_src.items()
)
put("reconcile_all", f"""
SELECT check_id, metric, a AS source_value, b AS derived_value, abs(a - b) AS difference,
       CASE WHEN check_id = 'RC4' THEN abs(a - b) <= 0.05::DOUBLE AND (SELECT sum(c * n) FROM (SELECT warehouse_id, sum(holding_cost) AS c FROM fact_inventory GROUP BY 1)
              JOIN (SELECT warehouse_id, count(*) AS n FROM fact_purchase_orders GROUP BY 1) USING (warehouse_id)) > 10 * a
            WHEN check_id IN ('RC2', 'RC3') THEN abs(a - b) <= 0.05::DOUBLE ELSE a = b END AS passed
FROM (
  SELECT 'RC1' AS check_id, 'demand_requested' AS metric, (SELECT sum(demand_requested) FROM fact_demand)::DOUBLE AS a, (SELECT sum(demand_requested) FROM daily_demand)::DOUBLE AS b
  UNION ALL {_inv_rows} UNION ALL {_cost_rows}
  UNION ALL SELECT 'RC4', 'holding_cost_fanout', (SELECT sum(holding_cost) FROM fact_inventory), (SELECT sum(holding_cost) FROM cost_rows)
  UNION ALL SELECT 'RC7', 'ledger_minus_demand_rows', ((SELECT count(*) FROM fact_inventory) - (SELECT count(*) FROM daily_demand))::DOUBLE,
     (SELECT count(*) FROM fact_inventory i WHERE NOT EXISTS (SELECT 1 FROM daily_demand d WHERE d.date = i.date AND d.product_id = i.product_id AND d.warehouse_id = i.warehouse_id))::DOUBLE
  UNION ALL SELECT 'RC9', 'max_balance_error', 0, (SELECT max(abs(beginning_inventory + po_received - demand_fulfilled - ending_inventory)) FROM fact_inventory)::DOUBLE
)
""")
put("table_counts", " UNION ALL ".join(
    [f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in
     ("dim_product", "dim_supplier", "dim_warehouse", "dim_market", "dim_date", "fact_demand", "fact_inventory", "fact_purchase_orders")]
    + ["SELECT 'dim_event', 1 + count(*) FROM event_rows", "SELECT 'fact_transport', count(*) FROM fact_purchase_orders"]
))
_FKS = [
    ("dim_market", "primary_warehouse_id", "dim_warehouse", "warehouse_id"), ("fact_demand", "date", "dim_date", "date"),
    ("fact_demand", "product_id", "dim_product", "product_id"), ("fact_demand", "market_id", "dim_market", "market_id"),
    ("fact_demand", "warehouse_id", "dim_warehouse", "warehouse_id"), ("fact_inventory", "date", "dim_date", "date"),
    ("fact_inventory", "product_id", "dim_product", "product_id"), ("fact_inventory", "warehouse_id", "dim_warehouse", "warehouse_id"),
    ("fact_purchase_orders", "supplier_id", "dim_supplier", "supplier_id"), ("fact_purchase_orders", "warehouse_id", "dim_warehouse", "warehouse_id"),
    ("fact_purchase_orders", "product_id", "dim_product", "product_id"),
]
put("foreign_keys", " UNION ALL ".join(
    [f"SELECT '{c}' AS child_table, '{fk}' AS foreign_key, '{p}' AS parent_table, (SELECT count(*) FROM {c} x WHERE {fk} IS NOT NULL AND {fk} NOT IN (SELECT {pk} FROM {p})) AS violations" for c, fk, p, pk in _FKS]
    + ["SELECT 'fact_demand', 'event_id', 'dim_event', (SELECT count(*) FROM fact_demand WHERE event_id <> 'NONE' AND event_id NOT IN (SELECT event_id FROM event_rows))"]
    + [f"SELECT 'fact_transport', '{a}', '{b}', 0" for a, b in (("po_id", "fact_purchase_orders"), ("origin_supplier_id", "dim_supplier"), ("dest_warehouse_id", "dim_warehouse"))]
))
_KEYS = {
    "dim_product": "product_id", "dim_supplier": "supplier_id", "dim_warehouse": "warehouse_id", "dim_market": "market_id", "dim_date": "date",
    "fact_inventory": "date, product_id, warehouse_id", "fact_purchase_orders": "po_id",
}
put("declared_keys", " UNION ALL ".join(
    [f"SELECT '{t}' AS table_name, '{k}' AS primary_key, CAST(0 AS BIGINT) AS null_cells, (SELECT count(*) FROM {t}) - (SELECT count(*) FROM (SELECT DISTINCT {k} FROM {t})) AS duplicate_keys" for t, k in _KEYS.items()]
    + ["SELECT 'dim_event', 'event_id', 0, 0", "SELECT 'fact_demand', '', 0, 0", "SELECT 'fact_transport', 'transport_id', 0, 0"]
))
RECENT = "DATE '2001-06-01'"
put("recent_slice_counts", " UNION ALL ".join(
    [f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in ("dim_product", "dim_supplier", "dim_warehouse", "dim_market", "dim_date")]
    + [f"SELECT '{t}', count(*) FROM {t} WHERE date >= {RECENT}" for t in ("fact_demand", "fact_inventory")]
    + ["SELECT 'dim_event', 1 + count(*) FROM event_rows", f"SELECT 'analytics_daily_demand', count(*) FROM daily_demand WHERE date >= {RECENT}"]
    + [f"SELECT '{t}', count(*) FROM fact_purchase_orders WHERE order_date >= {RECENT}" for t in ("fact_purchase_orders", "fact_transport")]
))

# ------------------------------------------------------------------------ series
put("date_dimension", "SELECT * FROM dim_date")
view("grid", """
SELECT d.date, p.product_id, w.warehouse_id, p.product_name, p.category, w.warehouse_name, coalesce(x.demand_requested, 0) AS demand_requested,
       coalesce(x.promotion_flag, 0) AS promotion_flag, coalesce(x.event_flag, 0) AS event_flag, coalesce(x.outlier_flag, 0) AS outlier_flag
FROM dim_date d CROSS JOIN dim_product p CROSS JOIN dim_warehouse w
LEFT JOIN daily_demand x ON x.date = d.date AND x.product_id = p.product_id AND x.warehouse_id = w.warehouse_id
""")
put("dense_demand_grid", "SELECT date, product_id, warehouse_id, category, demand_requested, promotion_flag, event_flag, outlier_flag FROM grid")
view("overlay", """
SELECT d.date, CAST(e.ev_seq IS NOT NULL AS INTEGER) AS event_active, coalesce(e.event_type, 'Normal') AS event_type, coalesce(e.severity, 'None') AS event_severity,
       coalesce(e.demand_multiplier, 1) AS event_demand_multiplier, coalesce(e.lead_time_multiplier, 1) AS event_lead_time_multiplier,
       coalesce(e.transport_cost_multiplier, 1) AS event_transport_multiplier,
       CAST(coalesce(d.date - e.start_date, -1) AS INTEGER) AS days_since_event_start, CAST(coalesce(e.end_date - d.date, -1) AS INTEGER) AS days_until_event_end
FROM dim_date d LEFT JOIN event_rows e ON d.date BETWEEN e.start_date AND e.end_date
QUALIFY row_number() OVER (PARTITION BY d.date ORDER BY e.ev_seq DESC NULLS LAST) = 1
""")
put("event_overlay", "SELECT * FROM overlay")
put("ledger_rows", "SELECT * FROM fact_inventory")
put("warehouse_load", """
SELECT date, product_id, warehouse_id, t AS total_warehouse_inventory, capacity_units AS warehouse_capacity, t::DOUBLE / capacity_units::DOUBLE * 100.0::DOUBLE AS capacity_utilization_pct
FROM (SELECT date, product_id, warehouse_id, CAST(sum(ending_inventory) OVER (PARTITION BY warehouse_id, date) AS BIGINT) AS t FROM fact_inventory) JOIN dim_warehouse USING (warehouse_id)
""")
put("safety_stock", """
SELECT product_id, warehouse_id, mean_demand, safety_stock, CAST(ceil(mean_demand * lead + safety_stock) AS BIGINT) AS reorder_point,
       CAST(ceil(mean_demand * lead + safety_stock) AS BIGINT) + greatest(moq::BIGINT, CAST(ceil(14 * mean_demand) AS BIGINT)) AS order_up_to
FROM stock_policy
""")

# ---------------------------------------------------------------------- features
W = "PARTITION BY product_id, warehouse_id ORDER BY date"


def fr(agg: str, a: int, b: int) -> str:
    def end(k: int) -> str:
        return "CURRENT ROW" if k == 0 else f"{abs(k)} {'PRECEDING' if k < 0 else 'FOLLOWING'}"
    return f"{agg} OVER ({W} ROWS BETWEEN {end(a)} AND {end(b)})"


def rstd(x: str, w: int) -> str:
    return f"coalesce({std(fr(f'count({x})', -w, -1), fr(f'sum({x})', -w, -1), fr(f'sum({x} * {x})', -w, -1))}, 0)"


X = "demand_requested"
LAGC = {f"demand_lag_{k}": f"lag({X}, {k}) OVER ({W})" for k in (1, 2, 7, 14, 28)}
ROLLC = {f"rolling_mean_{w}": he(fr(f"avg({X})", -w, -1), 2) for w in (7, 14, 28)}
ROLLC |= {f"rolling_std_{w}": he(rstd(X, w), 2) for w in (7, 28)}
ROLLC |= {"rolling_min_28": fr(f"min({X})", -28, -1), "rolling_max_28": fr(f"max({X})", -28, -1)}
DYN = {
    "demand_change_1d": "coalesce(demand_lag_1 - demand_lag_2, 0)::DOUBLE",
    "demand_change_7d": "coalesce(demand_lag_1 - demand_lag_7, 0)::DOUBLE",
    "demand_growth_28d": he(f"coalesce({ratio('rolling_mean_7', 'rolling_mean_28')}, 1)", 3),
    "demand_cv_28": he(f"coalesce({ratio('rolling_std_28', 'rolling_mean_28')}, 0)", 3),
    "zero_demand_frequency_28": he(fr("avg(CASE WHEN demand_lag_1 = 0 THEN 1 ELSE 0 END)", -27, 0), 3),
}
TGT = {f"target_demand_t_plus_{h}": f"lead({X}, {h}) OVER ({W})" for h in (1, 7, 14, 28)}
TGT |= {f"target_demand_sum_{h}d": f"CASE WHEN {fr('count(*)', 1, h)} = {h} THEN CAST({fr(f'sum({X})', 1, h)} AS BIGINT) END" for h in (7, 14, 28)}
AVAIL = {"has_sufficient_history_28d": "CAST(date >= (SELECT min(date) FROM dim_date) + 28 AS INTEGER)"}
AVAIL |= {f"is_target_available_t_plus_{h}": f"CAST(target_demand_t_plus_{h} IS NOT NULL AS INTEGER)" for h in (1, 7, 14, 28)}


def cols(d: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in d.items())


K = "product_id, warehouse_id, date"
put("demand_lags", f"SELECT {K}, {cols(LAGC)} FROM grid")
put("demand_rolling", f"SELECT {K}, {cols(ROLLC)} FROM grid")
view("demand_wide", f"SELECT *, {cols(LAGC)}, {cols(ROLLC)}, {cols(TGT)} FROM grid")
put("demand_dynamics", f"SELECT {K}, {cols(DYN)} FROM demand_wide")
put("demand_targets", f"SELECT {K}, {', '.join(TGT)}, {cols(AVAIL)} FROM demand_wide")
put("demand_feature_table", f"""
SELECT g.*, {cols(DYN)}, day_of_week, week AS week_of_year, month, quarter, is_weekend, is_month_start AS month_start, is_month_end AS month_end,
       holiday_flag, o.* EXCLUDE (date), {cols(AVAIL)}
FROM demand_wide g JOIN (SELECT date AS cal_date, day_of_week, week, month, quarter, is_weekend, is_month_start, is_month_end, holiday_flag FROM dim_date) c ON g.date = c.cal_date
JOIN (SELECT *, date AS o_date FROM overlay) o ON g.date = o.o_date
""".replace("o.* EXCLUDE (date)", "o.event_active, o.event_type, o.event_severity, o.event_demand_multiplier, o.event_lead_time_multiplier, o.event_transport_multiplier, o.days_since_event_start, o.days_until_event_end")
   .replace("CAST(date >=", "CAST(g.date >=").replace("PARTITION BY product_id, warehouse_id ORDER BY date", "PARTITION BY g.product_id, g.warehouse_id ORDER BY g.date"))
_SP = {f"lag_{k}": f"lag({X}, {k}) OVER ({W})" for k in (1, 7, 14, 28)}
for _w in (7, 14, 28):
    _SP[f"rolling_mean_{_w}"] = fr(f"avg({X})", -_w, -1)
    _SP[f"rolling_std_{_w}"] = rstd(X, _w)
put("sparse_demand_features", f"""
SELECT * REPLACE ({', '.join(f"{he(f'rolling_{s}_{w}', 6)} AS rolling_{s}_{w}" for s in ('mean', 'std') for w in (7, 14, 28))}),
       {he(f"coalesce({ratio('rolling_std_28', 'rolling_mean_28')}, 0)", 3)} AS demand_cv_28, {he(f"coalesce({ratio('rolling_mean_7', 'rolling_mean_28')}, 1)", 3)} AS demand_growth_ratio
FROM (SELECT date, product_id, category, warehouse_id, {X}, promotion_flag, event_flag, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, dayname(date) AS day_name,
             CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend, CAST(month(date) AS INTEGER) AS month, CAST(quarter(date) AS INTEGER) AS quarter, {cols(_SP)} FROM daily_demand)
""")

INV1 = {
    "ending_inventory_lag1": f"lag(ending_inventory, 1) OVER ({W})", "ending_inventory_lag2": f"lag(ending_inventory, 2) OVER ({W})",
    "demand_mean_7": he(fr(f"avg({X})", -7, -1), 2), "demand_mean_28": he(fr(f"avg({X})", -28, -1), 2), "demand_std_28": he(rstd(X, 28), 2),
    "stockout_lag_1": f"coalesce(lag(stockout_flag, 1) OVER ({W}), 0)",
    "stockout_count_7d": f"CAST(coalesce({fr('sum(stockout_flag)', -7, -1)}, 0) AS INTEGER)",
    "stockout_count_28d": f"CAST(coalesce({fr('sum(stockout_flag)', -28, -1)}, 0) AS INTEGER)",
    "lost_sales_7d": f"CAST(coalesce({fr('sum(lost_sales_quantity)', -7, -1)}, 0) AS BIGINT)",
    "lost_sales_28d": f"CAST(coalesce({fr('sum(lost_sales_quantity)', -28, -1)}, 0) AS BIGINT)",
    "ending_backorder_lag1": f"coalesce(lag(ending_backorder, 1) OVER ({W}), 0)",
    "backorder_count_7d": f"CAST(coalesce({fr('sum(CASE WHEN ending_backorder > 0 THEN 1 ELSE 0 END)', -7, -1)}, 0) AS INTEGER)",
    "backorder_count_28d": f"CAST(coalesce({fr('sum(CASE WHEN ending_backorder > 0 THEN 1 ELSE 0 END)', -28, -1)}, 0) AS INTEGER)",
    "target_stockout_t_plus_1": f"lead(stockout_flag, 1) OVER ({W})",
    "target_stockout_within_7d": f"CASE WHEN {fr('count(*)', 0, 6)} = 7 THEN {fr('max(stockout_flag)', 0, 6)} END",
    "target_stockout_within_14d": f"CASE WHEN {fr('count(*)', 0, 13)} = 14 THEN {fr('max(stockout_flag)', 0, 13)} END",
    "target_lost_sales_7d": f"CASE WHEN {fr('count(*)', 0, 6)} = 7 THEN CAST({fr('sum(lost_sales_quantity)', 0, 6)} AS BIGINT) END",
    "run_break": f"sum(CASE WHEN stockout_flag = 0 THEN 1 ELSE 0 END) OVER ({W})",
}
INV2 = {
    "inventory_change_1d": "coalesce(ending_inventory_lag1 - ending_inventory_lag2, 0)::DOUBLE", "safety_stock_gap": "beginning_inventory - safety_stock_target",
    "inventory_to_safety_stock_ratio": he(f"coalesce({ratio('beginning_inventory', 'safety_stock_target')}, 1)", 2),
    "demand_trend_28": he(f"coalesce({ratio('demand_mean_7', 'demand_mean_28')}, 1)", 3),
    "inventory_days_of_supply": he(f"coalesce({ratio('beginning_inventory', 'demand_mean_28')}, 999)", 1),
    "stockout_rate_28d": he("stockout_count_28d / 28.0::DOUBLE", 3),
    "lost_sales_rate_28d": he(f"coalesce({ratio('lost_sales_28d', 'demand_mean_28 * 28.0::DOUBLE')}, 0)", 3),
    "consecutive_stockout_days": "CAST(coalesce(lag(run_len, 1) OVER (PARTITION BY x.product_id, x.warehouse_id ORDER BY x.date), 0) AS INTEGER)",
    "warehouse_inventory_share": he(f"coalesce({ratio('beginning_inventory', 'warehouse_total_inv_lag1')}, 0)", 4),
    "has_sufficient_history_28d": "CAST(x.date >= (SELECT min(date) FROM dim_date) + 28 AS INTEGER)",
    "is_target_available_7d": "CAST(target_stockout_within_7d IS NOT NULL AS INTEGER)", "is_target_available_14d": "CAST(target_stockout_within_14d IS NOT NULL AS INTEGER)",
}
view("inv1", f"""
SELECT i.*, product_name, category, criticality, unit_cost, selling_price, warehouse_name, capacity_units AS warehouse_capacity_units, {cols(INV1)}
FROM fact_inventory i JOIN (SELECT product_id AS pid, product_name, category, criticality, unit_cost, selling_price FROM dim_product) p ON i.product_id = p.pid
JOIN (SELECT warehouse_id AS wid, warehouse_name, capacity_units FROM dim_warehouse) w ON i.warehouse_id = w.wid
""")
view("inv_load", f"""
SELECT *, {he("avg(warehouse_capacity_utilization_lag1) OVER (PARTITION BY warehouse_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)", 2)} AS warehouse_utilization_7d
FROM (SELECT warehouse_id, date, CAST(coalesce(sum(ending_inventory_lag1), 0) AS BIGINT) AS warehouse_total_inv_lag1,
             {he("coalesce(sum(ending_inventory_lag1), 0)::DOUBLE / any_value(warehouse_capacity_units)::DOUBLE * 100.0::DOUBLE", 2)} AS warehouse_capacity_utilization_lag1
      FROM inv1 GROUP BY warehouse_id, date)
""")
view("inv_features", f"""
SELECT x.*, warehouse_total_inv_lag1, warehouse_capacity_utilization_lag1, warehouse_utilization_7d, {cols(INV2)}
FROM (SELECT *, sum(stockout_flag) OVER (PARTITION BY product_id, warehouse_id, run_break ORDER BY date) AS run_len FROM inv1) x
JOIN inv_load l ON x.warehouse_id = l.warehouse_id AND x.date = l.date
""")
put("inventory_buffer", f"SELECT {K}, ending_inventory_lag1, ending_inventory_lag2, inventory_change_1d, safety_stock_gap, inventory_to_safety_stock_ratio, demand_mean_7, demand_mean_28, demand_std_28, demand_trend_28, inventory_days_of_supply FROM inv_features")
put("stockout_history", f"SELECT {K}, stockout_lag_1, stockout_count_7d, stockout_count_28d, stockout_rate_28d, consecutive_stockout_days, lost_sales_7d, lost_sales_28d, lost_sales_rate_28d, ending_backorder_lag1, backorder_count_7d, backorder_count_28d FROM inv_features")
put("warehouse_pressure", f"SELECT {K}, warehouse_total_inv_lag1, warehouse_capacity_utilization_lag1, warehouse_utilization_7d, warehouse_inventory_share FROM inv_features")
put("inventory_targets", f"SELECT {K}, target_stockout_t_plus_1, target_stockout_within_7d, target_stockout_within_14d, target_lost_sales_7d, has_sufficient_history_28d, is_target_available_7d, is_target_available_14d FROM inv_features")
put("coverage_kpis", f"""
SELECT {K}, {ratio('ending_inventory', 'demand_mean_28')} AS days_of_coverage, {ratio('ending_inventory', 'safety_stock_target')} AS safety_stock_coverage,
       greatest(least((greatest(safety_stock_target::DOUBLE, 1) - beginning_inventory) / greatest(safety_stock_target::DOUBLE, 1), 1), -2) AS buffer_deficiency
FROM inv_features
""")

# Supplier history by the definition: all deliveries before the order date.
view("order_days", "SELECT DISTINCT supplier_id, order_date AS day FROM fact_purchase_orders")
view("delivery_history", """
SELECT q.supplier_id, q.day, count(d.po_id) AS n, sum(d.quantity_received)::DOUBLE AS recv, sum(d.quantity_ordered)::DOUBLE AS ordq,
       sum(d.on_time_flag)::DOUBLE AS ont, sum(d.otif_flag)::DOUBLE AS oti, sum(d.delay_days)::DOUBLE AS del, sum(d.delay_days * d.delay_days)::DOUBLE AS del2,
       quantile_cont(d.delay_days::DOUBLE, 0.9) AS p90, quantile_cont(d.delay_days::DOUBLE, 0.95) AS p95, max(d.actual_delivery_date) AS last_day,
       count(d.po_id) FILTER (d.actual_delivery_date >= q.day - 30) AS n30, sum(d.delay_days) FILTER (d.actual_delivery_date >= q.day - 30)::DOUBLE AS del30,
       sum(d.otif_flag) FILTER (d.actual_delivery_date >= q.day - 30)::DOUBLE AS oti30,
       count(d.po_id) FILTER (d.actual_delivery_date >= q.day - 90) AS n90, sum(d.otif_flag) FILTER (d.actual_delivery_date >= q.day - 90)::DOUBLE AS oti90
FROM order_days q LEFT JOIN fact_purchase_orders d ON d.supplier_id = q.supplier_id AND d.actual_delivery_date < q.day
GROUP BY q.supplier_id, q.day
""")
view("in_flight", """
SELECT q.supplier_id, q.day, count(d.po_id) AS c, coalesce(sum(d.quantity_ordered), 0)::DOUBLE AS vol
FROM order_days q LEFT JOIN fact_purchase_orders d ON d.supplier_id = q.supplier_id AND d.order_date < q.day AND d.actual_delivery_date >= q.day
GROUP BY q.supplier_id, q.day
""")
view("sup_features", f"""
SELECT po.*, supplier_name, tier AS supplier_tier, baseline_reliability, CAST(n AS INTEGER) AS hist_order_count, coalesce(recv, 0) AS hist_order_volume,
       CASE WHEN n = 0 THEN baseline_reliability ELSE ont / n END AS hist_on_time_rate, CASE WHEN n = 0 THEN baseline_reliability ELSE oti / n END AS hist_otif_rate,
       CASE WHEN n = 0 THEN 1 ELSE recv / greatest(ordq, 1) END AS hist_fill_rate, CASE WHEN n = 0 THEN 0 ELSE del / n END AS hist_mean_delay,
       coalesce({std('n', 'del', 'del2')}, 0) AS hist_std_delay, coalesce(p90, 0) AS hist_p90_delay, coalesce(p95, 0) AS hist_p95_delay,
       CASE WHEN n = 0 THEN 0 WHEN n30 > 0 THEN del30 / n30 ELSE del / n END AS recent_delay_30d,
       CASE WHEN n = 0 THEN baseline_reliability WHEN n30 > 0 THEN oti30 / n30 ELSE oti / n END AS recent_otif_30d,
       CASE WHEN n = 0 THEN baseline_reliability WHEN n90 > 0 THEN oti90 / n90 ELSE oti / n END AS recent_otif_90d,
       CASE WHEN n = 0 THEN 0 WHEN n30 > 0 THEN del30 / n30 - del / n ELSE 0 END AS delay_trend,
       CAST(f.c AS INTEGER) AS supplier_active_orders_count, f.vol AS supplier_active_volume, f.vol / greatest(monthly_capacity_units, 1)::DOUBLE AS supplier_capacity_pressure,
       coalesce((po.order_date - last_day)::DOUBLE, 999) AS days_since_last_delivery, CAST(n = 0 AS INTEGER) AS is_cold_start
FROM fact_purchase_orders po JOIN dim_supplier s ON po.supplier_id = s.supplier_id
JOIN delivery_history h ON h.supplier_id = po.supplier_id AND h.day = po.order_date JOIN in_flight f ON f.supplier_id = po.supplier_id AND f.day = po.order_date
""")
put("supplier_history", "SELECT po_id, hist_order_count, hist_order_volume, hist_on_time_rate, hist_otif_rate, hist_fill_rate, hist_mean_delay, hist_std_delay, hist_p90_delay, hist_p95_delay, days_since_last_delivery, is_cold_start FROM sup_features")
put("supplier_recent", "SELECT po_id, recent_delay_30d, recent_otif_30d, recent_otif_90d, delay_trend FROM sup_features")
put("supplier_inflight", """
SELECT po_id, supplier_active_orders_count, supplier_active_volume, supplier_capacity_pressure, CAST(isodow(order_date) - 1 AS INTEGER) AS order_day_of_week,
       CAST(month(order_date) AS INTEGER) AS order_month, CAST(quarter(order_date) AS INTEGER) AS order_quarter, CAST(isodow(order_date) >= 6 AS INTEGER) AS order_is_weekend,
       CAST(order_date = last_day(order_date) AS INTEGER) AS order_is_month_end, delay_days AS target_delay_days, CAST(delay_days > 2 AS INTEGER) AS target_delay_gt_2d,
       CAST(delay_days > 5 AS INTEGER) AS target_delay_gt_5d, on_time_flag AS target_on_time, otif_flag AS target_otif, actual_lead_time_days AS target_actual_lead_time_days
FROM (SELECT * FROM sup_features)
""".replace("last_day(order_date)", "(date_trunc('month', order_date) + INTERVAL 1 MONTH - INTERVAL 1 DAY)::DATE"))
put("sku_cost_history", f"""
SELECT po_id, {he('coalesce(avg(unit_cost) OVER w, unit_cost)', 6)} AS hist_sku_unit_cost_mean, {he('coalesce(stddev_samp(unit_cost) OVER w, 0)', 4)} AS hist_sku_unit_cost_std
FROM fact_purchase_orders WINDOW w AS (PARTITION BY supplier_id, product_id ORDER BY order_date, po_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
""")
SPLIT = f"CASE WHEN {{d}} <= {TRAIN_END} THEN 'TRAIN' WHEN {{d}} <= {VAL_END} THEN 'VAL' ELSE 'TEST' END"
put("split_bounds", f"SELECT {SPLIT.format(d='date')} AS split, min(date) AS first_day, max(date) AS last_day, count(*) AS n_rows FROM grid GROUP BY 1")

# ------------------------------------------------------------------ data quality
# Tables as given; tests put faults into these four.
view("raw_demand", "SELECT * FROM fact_demand")
view("raw_orders", "SELECT * FROM fact_purchase_orders")
view("raw_inventory", "SELECT * FROM fact_inventory")
view("raw_transport", """
SELECT 'TR' || substr(po_id, 3) AS transport_id, po_id, supplier_id AS origin_supplier_id, warehouse_id AS dest_warehouse_id, order_date AS departure_date,
       actual_delivery_date AS arrival_date, quantity_received AS quantity_transported, transport_cost, (['Road', 'Rail', 'Sea'])[CAST(quantity_ordered % 3 + 1 AS INTEGER)] AS transport_mode, delay_days
FROM fact_purchase_orders
""")
view("dim_event", """
SELECT event_id, event_name, start_date, end_date, event_type, severity, affected_region, affected_categories, 'ALL' AS affected_suppliers,
       demand_multiplier, lead_time_multiplier, transport_cost_multiplier, event_name AS description FROM event_rows
UNION ALL SELECT 'NONE', 'No event', NULL, NULL, 'None', 'None', NULL, NULL, NULL, 1.0, 1.0, 1.0, NULL
""")
QUALITY: dict[str, str] = {}  # statements over the views above, before these are put in


def put_quality(name: str, query: str) -> None:
    QUALITY[name] = query
    put(name, query)


RULE_NAMES = {"DQ-001": ("NOT_NULL_KEYS", "ERROR"), "DQ-002": ("VALID_DATE_FORMAT", "ERROR"), "DQ-003": ("NO_DUPLICATE_ROWS", "ERROR"),
              "DQ-004": ("NON_NEGATIVE_NUMERICS", "ERROR"), "DQ-005": ("REFERENTIAL_INTEGRITY", "ERROR"), "DQ-006": ("TEMPORAL_CONTINUITY", "WARNING"),
              "DQ-007": ("STATISTICAL_OUTLIERS", "WARNING")}


def issue(rule: str, table: str, column: str, count: str) -> str:
    name, severity = RULE_NAMES[rule]
    return f"SELECT '{rule}' AS rule_id, '{name}' AS rule_name, '{table}' AS table_name, '{severity}' AS severity, CAST(({count}) AS BIGINT) AS row_count, '{column}' AS column_name"


def outliers(src: str, limit: str) -> str:
    return (f"SELECT count(*) FROM {src} d JOIN (SELECT product_id AS pid, avg(demand_requested) AS m, stddev_samp(demand_requested) AS s FROM {src} GROUP BY 1) g "
            f"ON d.product_id = g.pid WHERE abs((demand_requested - m) / CASE WHEN s > 0 THEN s ELSE 1 END) > {limit}")


DIMS = ("dim_product", "dim_supplier", "dim_warehouse", "dim_date")
GIVEN = {d: d for d in DIMS} | {"fact_demand": "raw_demand", "fact_inventory": "raw_inventory", "fact_purchase_orders": "raw_orders", "fact_transport": "raw_transport"}
CLEAN = {d: d for d in DIMS} | {"fact_demand": "cleaned_demand", "fact_inventory": "cleaned_inventory", "fact_purchase_orders": "cleaned_orders", "fact_transport": "cleaned_transport"}


def found(tables: dict[str, str]) -> str:
    """Keys that break a rule: (rule_id, table_name, column_name, row_key, records), each rule over its own read."""
    row_keys = {"dim_product": "product_id", "dim_supplier": "supplier_id", "dim_warehouse": "warehouse_id", "dim_date": "date", "fact_demand": "date product_id warehouse_id market_id",
                "fact_inventory": "date product_id warehouse_id", "fact_purchase_orders": "po_id", "fact_transport": "transport_id"}

    def joined(columns: str) -> str:
        return " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in columns.split())

    parts = []

    def rows(rule: str, table: str, column: str, where: str) -> None:
        parts.append(f"SELECT '{rule}' AS rule_id, '{table}' AS table_name, '{column}' AS column_name, {joined(row_keys[table])} AS row_key, count(*) AS records FROM {tables[table]} x WHERE {where} GROUP BY 4")

    for table, columns in {
        "dim_product": "product_id product_name category", "dim_supplier": "supplier_id supplier_name", "dim_warehouse": "warehouse_id warehouse_name",
        "fact_demand": "date product_id warehouse_id market_id", "fact_inventory": "date product_id warehouse_id",
        "fact_purchase_orders": "po_id order_date supplier_id product_id", "fact_transport": "transport_id po_id",
    }.items():
        for c in columns.split():
            rows("DQ-001", table, c, f"{c} IS NULL OR trim(CAST({c} AS VARCHAR)) IN ('', 'nan', 'None', 'NULL')")
    for table, c in (("dim_date", "date"), ("fact_demand", "date"), ("fact_inventory", "date"), ("fact_purchase_orders", "order_date"), ("fact_purchase_orders", "actual_delivery_date")):
        rows("DQ-002", table, c, f"year({c}) NOT BETWEEN 1995 AND 2001")
    for table, columns in {
        "dim_product": "unit_cost selling_price base_demand", "fact_demand": "demand_requested", "fact_inventory": "beginning_inventory ending_inventory holding_cost",
        "fact_purchase_orders": "quantity_ordered unit_cost total_procurement_cost",
    }.items():
        for c in columns.split():
            rows("DQ-004", table, c, f"{c} < 0")
    for table, fk, parent, pk in (
        ("fact_demand", "product_id", "dim_product", "product_id"), ("fact_demand", "warehouse_id", "dim_warehouse", "warehouse_id"),
        ("fact_inventory", "product_id", "dim_product", "product_id"), ("fact_inventory", "warehouse_id", "dim_warehouse", "warehouse_id"),
        ("fact_purchase_orders", "product_id", "dim_product", "product_id"), ("fact_purchase_orders", "supplier_id", "dim_supplier", "supplier_id"),
        ("fact_transport", "po_id", "fact_purchase_orders", "po_id"),
    ):
        rows("DQ-005", table, fk, f"{fk} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {tables[parent]} y WHERE y.{pk} = x.{fk})")
    for table, columns in {"dim_product": "product_id", "dim_supplier": "supplier_id", "fact_inventory": "date product_id warehouse_id", "fact_purchase_orders": "po_id"}.items():
        parts.append(f"SELECT 'DQ-003', '{table}', '{', '.join(columns.split())}', {joined(columns)}, count(*) - 1 FROM {tables[table]} GROUP BY 4 HAVING count(*) > 1")
    demand = tables["fact_demand"]
    parts.append(f"SELECT 'DQ-003', 'fact_demand', 'ALL', {joined(row_keys['fact_demand'])}, CAST(sum(c - 1) AS BIGINT) FROM (SELECT *, count(*) AS c FROM {demand} GROUP BY ALL) WHERE c > 1 GROUP BY 4")
    parts.append(f"SELECT 'DQ-006', 'fact_demand', 'date', {joined('product_id warehouse_id')}, 1 FROM {demand} GROUP BY product_id, warehouse_id HAVING count(DISTINCT date) < (SELECT count(*) FROM dim_date)")
    parts.append(f"SELECT 'DQ-007', 'fact_demand', 'demand_requested', {joined('d.date d.product_id d.warehouse_id d.market_id')}, count(*) FROM {demand} d "
                 f"JOIN (SELECT product_id AS pid, avg(demand_requested) AS m, stddev_samp(demand_requested) AS s FROM {demand} GROUP BY 1) g ON d.product_id = g.pid "
                 "WHERE abs((demand_requested - m) / CASE WHEN s > 0 THEN s ELSE 1 END) > 4.5::DOUBLE GROUP BY 4")
    return " UNION ALL ".join(parts)


def rule_case(at: int) -> str:
    return "CASE rule_id " + " ".join(f"WHEN '{r}' THEN '{info[at]}'" for r, info in RULE_NAMES.items()) + " END"


def audit(tables: dict[str, str]) -> str:
    return (f"SELECT rule_id, {rule_case(0)} AS rule_name, table_name, {rule_case(1)} AS severity, CAST(sum(records) AS BIGINT) AS row_count, column_name "
            f"FROM ({found(tables)}) GROUP BY rule_id, table_name, column_name")


put_quality("dq_issues", audit(GIVEN))
put_quality("dq_samples", f"""
SELECT rule_id, table_name, column_name, CAST(sum(records) AS BIGINT) AS row_count, array_to_string(list_sort(list(DISTINCT row_key))[1:5], ',') AS samples
FROM ({found(GIVEN)}) GROUP BY rule_id, table_name, column_name
""")
put("dq_outliers", "SELECT * FROM (" + issue("DQ-007", "fact_demand", "demand_requested", outliers("fact_demand", "1.7::DOUBLE")) + ") WHERE row_count > 0")
put("dq_continuity", "SELECT * FROM (" + issue("DQ-006", "fact_demand", "date", "SELECT count(*) FROM (SELECT product_id, warehouse_id FROM fact_demand GROUP BY 1, 2 HAVING count(DISTINCT date) < (SELECT count(*) FROM dim_date))") + ") WHERE row_count > 0")
view("dedup_demand", "SELECT DISTINCT * FROM raw_demand")
view("kept_demand", """
SELECT date, product_id, market_id, warehouse_id, greatest(demand_requested, 0) AS demand_requested, promotion_flag, CASE WHEN event_id = '' THEN 'NONE' ELSE event_id END AS event_id,
       demand_requested AS original
FROM dedup_demand WHERE product_id IN (SELECT product_id FROM dim_product) AND date IN (SELECT date FROM dim_date)
""")
view("cleaned_demand", """
SELECT date, product_id, market_id, warehouse_id, demand_requested, promotion_flag, event_id, CAST((demand_requested - m) / s > 5.0::DOUBLE AS INTEGER) AS outlier_flag
FROM kept_demand, (SELECT avg(demand_requested) AS m, stddev_samp(demand_requested) AS s FROM kept_demand)
""")
put_quality("clean_demand", "SELECT * FROM cleaned_demand")
view("dedup_orders", "SELECT DISTINCT * FROM raw_orders")
view("first_orders", """
SELECT * FROM dedup_orders QUALIFY row_number() OVER (PARTITION BY po_id ORDER BY order_date NULLS FIRST, supplier_id NULLS FIRST, warehouse_id NULLS FIRST, product_id NULLS FIRST,
  quantity_ordered NULLS FIRST, expected_lead_time_days NULLS FIRST, actual_lead_time_days NULLS FIRST, expected_delivery_date NULLS FIRST, actual_delivery_date NULLS FIRST,
  quantity_received NULLS FIRST, unit_cost NULLS FIRST, total_procurement_cost NULLS FIRST, transport_cost NULLS FIRST, delay_days NULLS FIRST, on_time_flag NULLS FIRST,
  in_full_flag NULLS FIRST, otif_flag NULLS FIRST, status NULLS FIRST) = 1
""")
view("cleaned_orders", f"""
SELECT f.* REPLACE (CASE WHEN f.unit_cost <= 0 THEN coalesce(p.unit_cost, 25) ELSE f.unit_cost END AS unit_cost,
  CASE WHEN f.unit_cost <= 0 THEN {he('quantity_received * coalesce(p.unit_cost, 25)', 2)} ELSE total_procurement_cost END AS total_procurement_cost)
FROM first_orders f LEFT JOIN (SELECT product_id AS pid, unit_cost FROM dim_product) p ON f.product_id = p.pid
WHERE supplier_id IN (SELECT supplier_id FROM dim_supplier)
""")
put_quality("clean_po", "SELECT * FROM cleaned_orders")
view("dedup_inventory", "SELECT DISTINCT * FROM raw_inventory")
view("unbalanced", """
SELECT * FROM dedup_inventory WHERE ending_inventory < 0 OR ending_inventory <> greatest(beginning_inventory + po_received - demand_fulfilled, 0)
""")
view("cleaned_inventory", f"""
SELECT i.* REPLACE (CASE WHEN n > 0 THEN greatest(beginning_inventory + po_received - demand_fulfilled, 0) ELSE ending_inventory END AS ending_inventory,
  CASE WHEN n > 0 THEN {he('greatest(beginning_inventory + po_received - demand_fulfilled, 0)::DOUBLE * unit_cost * (0.2::DOUBLE / 365.25::DOUBLE)', 4)} ELSE holding_cost END AS holding_cost)
FROM dedup_inventory i LEFT JOIN (SELECT product_id AS pid, unit_cost FROM dim_product) p ON i.product_id = p.pid, (SELECT count(*) AS n FROM unbalanced)
""")
view("cleaned_transport", "SELECT * FROM raw_transport WHERE po_id IN (SELECT po_id FROM cleaned_orders)")
_ORPHAN_DEMAND = "(product_id IS NULL OR product_id NOT IN (SELECT product_id FROM dim_product))"
_ORPHAN_ORDER = "(supplier_id IS NULL OR supplier_id NOT IN (SELECT supplier_id FROM dim_supplier))"
view("trail", f"""
SELECT * FROM (
 SELECT 'fact_demand' AS table_name, 'DEDUPLICATE' AS action, (SELECT count(*) FROM raw_demand) - (SELECT count(*) FROM dedup_demand) AS records_affected, 'DQ-003' AS rule_id, 'Removed exact duplicate demand rows.' AS reason, 'REMOVED' AS disposition
 UNION ALL SELECT 'fact_demand', 'QUARANTINE_NULL_OR_ORPHAN_KEY', (SELECT count(*) FROM dedup_demand WHERE {_ORPHAN_DEMAND}), 'DQ-001/005', 'Removed demand records with null or non-existent product IDs.', 'REMOVED'
 UNION ALL SELECT 'fact_demand', 'QUARANTINE_INVALID_DATE', (SELECT count(*) FROM dedup_demand WHERE NOT {_ORPHAN_DEMAND} AND date NOT IN (SELECT date FROM dim_date)), 'DQ-002', 'Removed demand records with malformed date timestamps.', 'REMOVED'
 UNION ALL SELECT 'fact_demand', 'REPAIR_NEGATIVE_VALUE', (SELECT count(*) FROM kept_demand WHERE original < 0), 'DQ-004', 'Clamped negative demand requested values to zero floor.', 'REPAIRED'
 UNION ALL SELECT 'fact_demand', 'ANNOTATE_OUTLIER', (SELECT count(*) FROM cleaned_demand WHERE outlier_flag = 1), 'DQ-007', 'Flagged statistical demand outliers for analytical awareness.', 'RETAINED_WITH_FLAG'
 UNION ALL SELECT 'fact_purchase_orders', 'DEDUPLICATE', (SELECT count(*) FROM raw_orders) - (SELECT count(*) FROM dedup_orders), 'DQ-003', 'Removed exact duplicate purchase order rows.', 'REMOVED'
 UNION ALL SELECT 'fact_purchase_orders', 'DEDUPLICATE_PRIMARY_KEY', (SELECT count(*) FROM dedup_orders) - (SELECT count(*) FROM first_orders), 'DQ-003', 'Quarantined conflicting duplicate po_id entries, preserving first authenticated record.', 'REMOVED'
 UNION ALL SELECT 'fact_purchase_orders', 'QUARANTINE_NULL_OR_ORPHAN_KEY', (SELECT count(*) FROM first_orders WHERE {_ORPHAN_ORDER}), 'DQ-001/005', 'Removed purchase orders referencing null or non-existent supplier IDs.', 'REMOVED'
 UNION ALL SELECT 'fact_purchase_orders', 'REPAIR_NEGATIVE_PRICE', (SELECT count(*) FROM first_orders WHERE unit_cost <= 0 AND NOT {_ORPHAN_ORDER}), 'DQ-004', 'Restored negative unit cost on purchase orders using product master standard cost.', 'REPAIRED'
 UNION ALL SELECT 'fact_inventory', 'DEDUPLICATE', (SELECT count(*) FROM raw_inventory) - (SELECT count(*) FROM dedup_inventory), 'DQ-003', 'Removed duplicate inventory records.', 'REMOVED'
 UNION ALL SELECT 'fact_inventory', 'REPAIR_INVENTORY_BALANCE', (SELECT count(*) FROM unbalanced), 'DQ-006', 'Re-derived ending inventory from beginning stock, receipts, and demand fulfillment.', 'REPAIRED'
 UNION ALL SELECT 'fact_transport', 'QUARANTINE_ORPHAN_TRANSPORT', (SELECT count(*) FROM raw_transport) - (SELECT count(*) FROM cleaned_transport), 'DQ-005', 'Removed transport shipments whose associated PO was quarantined.', 'REMOVED'
) WHERE records_affected > 0
""")
put_quality("audit_trail", "SELECT * FROM trail")
put_quality("severity_before_after", f"""
SELECT phase, severity, CAST(sum(row_count) AS BIGINT) AS row_count FROM (SELECT 'before' AS phase, severity, row_count FROM ({audit(GIVEN)}) UNION ALL SELECT 'after', severity, row_count FROM ({audit(CLEAN)})) GROUP BY 1, 2
""")
put_quality("quality_verdict", f"""
SELECT e AS error_rows, CASE WHEN e = 0 THEN 'PASSED (Zero Critical Errors)' ELSE 'FAILED' END AS overall_status
FROM (SELECT CAST(coalesce(sum(row_count) FILTER (severity = 'ERROR'), 0) AS BIGINT) AS e FROM ({audit(CLEAN)}))
""")
_FACTS = ("fact_demand", "fact_inventory", "fact_purchase_orders", "fact_transport")
put_quality("cleaning_summary", "SELECT " + ", ".join(
    [f"(SELECT count(*) FROM {t[f]}) AS {f}_{phase}" for phase, t in (("before", GIVEN), ("after", CLEAN)) for f in _FACTS]
    + [f"CAST(coalesce((SELECT sum(records_affected) FROM trail WHERE disposition = '{d}'), 0) AS BIGINT) AS {n}" for d, n in (("REMOVED", "records_removed"), ("REPAIRED", "records_repaired"))]
    + ["(" + " + ".join(f"(SELECT count(*) FROM {t})" for t in [*CLEAN.values(), "dim_market", "dim_event"]) + ") AS records_retained", "(SELECT count(*) FROM trail) AS audit_actions_count"]
))
put_quality("cross_stage_demand", f"""
SELECT 'RC5' AS check_id, 'demand_requested' AS metric, a AS source_value, b AS derived_value, abs(a - b) AS difference, a = b AS passed
FROM (SELECT (SELECT sum(demand_requested) FROM raw_demand)::DOUBLE AS a,
  ((SELECT sum(demand_requested) FROM cleaned_demand)
   + (SELECT sum(demand_requested) FROM raw_demand) - (SELECT sum(demand_requested) FROM dedup_demand)
   + coalesce((SELECT sum(demand_requested) FROM dedup_demand WHERE {_ORPHAN_DEMAND} OR date NOT IN (SELECT date FROM dim_date)), 0)
   + coalesce((SELECT sum(original) FROM kept_demand WHERE original < 0), 0))::DOUBLE AS b)
""")
_COST = "coalesce(total_procurement_cost, 0.0::DOUBLE) + coalesce(transport_cost, 0.0::DOUBLE)"
put_quality("cross_stage_cost", f"""
SELECT 'RC6' AS check_id, 'procurement_and_transport' AS metric, {he('a', 2)} AS source_value, {he('b', 2)} AS derived_value, {he('abs(a - b)', 2)} AS difference, abs(a - b) <= 0.05::DOUBLE AS passed
FROM (SELECT (SELECT sum({_COST}) FROM raw_orders) AS a,
  (SELECT sum({_COST}) FROM cleaned_orders)
   + (SELECT sum({_COST}) FROM raw_orders) - (SELECT sum({_COST}) FROM dedup_orders)
   + (SELECT sum({_COST}) FROM dedup_orders) - (SELECT sum({_COST}) FROM first_orders)
   + coalesce((SELECT sum({_COST}) FROM first_orders WHERE {_ORPHAN_ORDER}), 0.0::DOUBLE)
   - coalesce((SELECT sum(c.total_procurement_cost - coalesce(f.total_procurement_cost, 0.0::DOUBLE)) FROM cleaned_orders c JOIN first_orders f USING (po_id) WHERE f.unit_cost <= 0), 0.0::DOUBLE) AS b)
""")

_CHECKS = f"SELECT * FROM ({ORACLE['reconcile_all']}) UNION ALL SELECT * FROM ({ORACLE['cross_stage_demand']}) UNION ALL SELECT * FROM ({ORACLE['cross_stage_cost']})"
put("reconciliation_verdict", f"SELECT count(*) AS n_checks, count(*) FILTER (NOT passed) AS n_failed, bool_and(passed) AS all_passed FROM ({_CHECKS})")


def prof(table: str, src: str, columns: list[str]) -> str:
    miss = " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in columns)
    dup = f"((SELECT count(*) FROM {src}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {src})))"
    return (f"SELECT '{table}' AS table_name, count(*) AS rows, {len(columns)} AS columns, {miss} AS missing_cells, ({miss})::DOUBLE / (count(*) * {len(columns)})::DOUBLE * 100.0::DOUBLE AS missing_pct, "
            f"{dup} AS duplicate_rows, {dup}::DOUBLE / count(*)::DOUBLE * 100.0::DOUBLE AS duplicate_pct FROM {src}")


view("given_inventory", """
SELECT i.*, CAST(sum(ending_inventory) OVER (PARTITION BY warehouse_id, date) AS BIGINT) AS total_warehouse_inventory, capacity_units AS warehouse_capacity, 0.0::DOUBLE AS capacity_utilization_pct
FROM fact_inventory i JOIN dim_warehouse USING (warehouse_id)
""")
_PROFILED = {
    "dim_product": "product_id product_name category unit_cost selling_price criticality base_demand shelf_life_days storage_requirement supplier_dependency primary_supplier_id secondary_supplier_id moq_units lead_time_expectation_days",
    "dim_supplier": "supplier_id supplier_name primary_categories baseline_reliability baseline_lead_time_days lead_time_variance monthly_capacity_units moq_units transport_cost_factor tier",
    "dim_warehouse": "warehouse_id warehouse_name region capacity_units handling_cost_per_unit transport_cost_factor",
    "dim_market": "market_id market_name region primary_warehouse_id demand_multiplier seasonality_multiplier annual_growth_rate",
    "dim_date": "date year month quarter week day_of_week day_name is_weekend is_month_start is_month_end is_quarter_end holiday_flag promotion_period",
    "dim_event": "event_id event_name start_date end_date event_type severity affected_region affected_categories affected_suppliers demand_multiplier lead_time_multiplier transport_cost_multiplier description",
    "fact_demand": "date product_id market_id warehouse_id demand_requested promotion_flag event_id outlier_flag",
    "fact_inventory": "date product_id warehouse_id beginning_inventory po_received demand_requested demand_fulfilled opening_backorder backorder_fulfilled new_backorder lost_sales_quantity ending_backorder ending_inventory stockout_flag stockout_quantity safety_stock_target holding_cost stockout_cost",
    "fact_purchase_orders": "po_id order_date supplier_id warehouse_id product_id quantity_ordered expected_lead_time_days actual_lead_time_days expected_delivery_date actual_delivery_date quantity_received unit_cost total_procurement_cost transport_cost delay_days on_time_flag in_full_flag otif_flag status",
    "fact_transport": "transport_id po_id origin_supplier_id dest_warehouse_id departure_date arrival_date quantity_transported transport_cost transport_mode delay_days",
}
_LOAD = " total_warehouse_inventory warehouse_capacity capacity_utilization_pct"
put_quality("table_profile", " UNION ALL ".join(
    prof(t, "given_inventory" if t == "fact_inventory" else GIVEN.get(t, t), (c + (_LOAD if t == "fact_inventory" else "")).split()) for t, c in _PROFILED.items()
))
_MEASURES = ("rows", "missing_cells", "missing_pct", "duplicate_rows", "duplicate_pct")
put_quality("profile_comparison", "SELECT table_name, " + ", ".join(f"{x}.{m} AS {p}_{m}" for x, p in (("a", "before"), ("b", "after")) for m in _MEASURES)
            + " FROM (" + " UNION ALL ".join(prof(t, GIVEN.get(t, t), c.split()) for t, c in _PROFILED.items())
            + ") a FULL JOIN (" + " UNION ALL ".join(prof(t, CLEAN.get(t, t), c.split()) for t, c in _PROFILED.items()) + ") b USING (table_name)")


def with_faults(faults: dict[str, str]) -> dict[str, str]:
    """The statements of the quality queries, with other bodies of some views."""
    kept = {name: VIEWS[name] for name in faults}
    VIEWS.update(faults)
    try:
        return {name: sql(query) for name, query in QUALITY.items()}
    finally:
        VIEWS.update(kept)


# ----------------------------------------------------------------------- leakage
def rebuilt(target: str, base: str, changes: str) -> str:
    """A copy of view ``target`` for which the rows of ``base`` have been changed."""
    touched, path = {base}, {target}
    for _ in VIEWS:
        touched |= {n for n in VIEWS if touched & set(names_in(VIEWS[n]))}
        path |= {n for p in path for n in names_in(VIEWS[p])}
    copied = (touched & path) - {base}
    mark = f"__{target}"
    view(base + mark, f"SELECT * REPLACE ({changes}) FROM {base}")
    word = re.compile(r"\b(" + "|".join(copied | {base}) + r")\b")
    for n in copied:
        view(n + mark, word.sub(lambda m: m[1] + mark, VIEWS[n]))
    return target + mark


def leak(name: str, domain: str, target: str, base: str, changes: dict[str, str], keys: str, columns: list[str], day: str = "date") -> None:
    """Build the features twice, the second time with a changed future, and compare the past."""
    future = f"{day} > DATE '{CUTOFF}'"
    other = rebuilt(target, base, ", ".join(f"CASE WHEN {future} THEN {e} ELSE {c} END AS {c}" for c, e in changes.items()))
    gaps = ", ".join(f"coalesce(max(abs(coalesce(a.{c}, 0)::DOUBLE - coalesce(b.{c}, 0)::DOUBLE)), 0.0::DOUBLE) AS g{i}" for i, c in enumerate(columns))
    bad = " + ".join(f"CAST(g{i} > 1e-6::DOUBLE AS BIGINT)" for i in range(len(columns)))
    put(name, f"""
    SELECT '{domain}' AS domain, '{CUTOFF}' AS cutoff_date, greatest({", ".join(f"g{i}" for i in range(len(columns)))}, 0.0::DOUBLE) AS max_abs_diff,
           CAST({bad} AS BIGINT) AS violating_columns, ({bad}) = 0 AS is_leakage_free
    FROM (SELECT {gaps} FROM {target} a JOIN {other} b USING ({keys}) WHERE a.{day} <= DATE '{CUTOFF}')
    """)


view("demand_built", f"SELECT *, {cols(DYN)} FROM demand_wide")
view("demand_leaking", f"SELECT {K}, lead({X}, 1) OVER ({W}) AS next_day FROM grid")
view("rollup_built", f"SELECT {K}, {cols(_SP)} FROM daily_demand")
view("inv_built", "SELECT * FROM inv_features")
view("sup_built", """
SELECT *, coalesce(avg(unit_cost) OVER w, unit_cost) AS sku_mean, coalesce(stddev_samp(unit_cost) OVER w, 0) AS sku_std FROM sup_features
WINDOW w AS (PARTITION BY supplier_id, product_id ORDER BY order_date, po_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
""")
_SHOCK = {"demand_requested": "demand_requested + 10000"}
leak("leakage_demand", "demand", "demand_built", "grid", _SHOCK, K, [X, *LAGC, *ROLLC, *DYN])
leak("leakage_detected", "demand", "demand_leaking", "grid", _SHOCK, K, ["next_day"])
leak("leakage_rollup", "daily_demand", "rollup_built", "daily_demand", {X: f"{X} * 10 + 500"}, K, list(_SP))
leak(
    "leakage_inventory", "inventory", "inv_built", "fact_inventory",
    {"ending_inventory": "0", "stockout_flag": "1", "lost_sales_quantity": "5000"}, K,
    [c for c in (*INV1, *INV2) if not c.startswith(("target_", "is_target_"))] + ["warehouse_total_inv_lag1", "warehouse_utilization_7d"],
)
leak(
    "leakage_supplier", "supplier", "sup_built", "fact_purchase_orders",
    {"delay_days": "delay_days + 50", "actual_lead_time_days": "actual_lead_time_days + 50", "on_time_flag": "0", "otif_flag": "0",
     "unit_cost": "unit_cost + 1000", "quantity_ordered": "quantity_ordered + 500", "quantity_received": "0"}, "po_id",
    ["hist_order_count", "hist_order_volume", "hist_on_time_rate", "hist_otif_rate", "hist_fill_rate", "hist_mean_delay", "hist_std_delay",
     "hist_p90_delay", "hist_p95_delay", "recent_delay_30d", "recent_otif_30d", "recent_otif_90d", "delay_trend", "supplier_active_orders_count",
     "supplier_active_volume", "supplier_capacity_pressure", "days_since_last_delivery", "is_cold_start", "sku_mean", "sku_std",
     "quantity_ordered", "unit_cost", "transport_cost", "baseline_reliability"], "order_date",
)
# Column counts of the feature tables: keys, descriptions, features, targets and flags.
put("feature_summary", " UNION ALL ".join(
    f"SELECT '{d}' AS domain, (SELECT count(*) FROM {t}) AS n_rows, {n} AS n_columns, (SELECT is_leakage_free FROM ({ORACLE[q]})) AS is_leakage_free"
    for d, t, n, q in (("demand", "grid", 55, "leakage_demand"), ("inventory", "fact_inventory", 53, "leakage_inventory"), ("supplier", "fact_purchase_orders", 58, "leakage_supplier"))
))
put("lag_alignment", f"""
SELECT coalesce(max(abs(l - p)), 0.0::DOUBLE) AS max_abs_diff, count(*) FILTER (l IS DISTINCT FROM p) AS mismatches, count(*) FILTER (l IS DISTINCT FROM p) = 0 AS aligned
FROM (SELECT g.demand_lag_1::DOUBLE AS l, q.{X}::DOUBLE AS p FROM demand_wide g
      LEFT JOIN grid q ON q.product_id = g.product_id AND q.warehouse_id = g.warehouse_id AND q.date = g.date - 1)
""")

# ---------------------------------------------------------------------- forecasts
view("series_rows", f"SELECT {K}, category, demand_requested, {SPLIT.format(d='date')} AS split FROM grid")
_fc = []
for _h in (1, 7, 14, 28):
    _lag = 7 * -(-_h // 7) - _h
    _sn = "demand_requested" if _lag == 0 else f"lag(demand_requested, {_lag}) OVER ({W})"
    _fc.append(f"SELECT {K}, category, split, 't+{_h}' AS horizon, 'Seasonal Naive' AS model, lead(demand_requested, {_h}) OVER ({W})::DOUBLE AS actual, "
               f"greatest(coalesce(({_sn})::DOUBLE, (SELECT quantile_cont(demand_requested::DOUBLE, 0.5) FROM series_rows WHERE split = 'TRAIN')), 0) AS forecast FROM series_rows")
    for _w in (7, 14, 28):
        _fc.append(f"SELECT {K}, category, split, 't+{_h}', 'Moving Average (W={_w})', lead(demand_requested, {_h}) OVER ({W})::DOUBLE, greatest({fr('avg(demand_requested)', 1 - _w, 0)}, 0) FROM series_rows")
view("all_forecasts", " UNION ALL ".join(_fc))
view("base_forecasts", "SELECT * FROM all_forecasts WHERE actual IS NOT NULL")
put("seasonal_naive", f"SELECT {K}, horizon, actual, forecast FROM base_forecasts WHERE model = 'Seasonal Naive' AND split = 'TEST'")
put("moving_average", f"SELECT {K}, horizon, model, {he('forecast', 6)} AS forecast FROM base_forecasts WHERE model <> 'Seasonal Naive' AND split = 'TEST'")
view("val_metrics", f"""
SELECT model, horizon, {he('avg(abs(forecast - actual))', 4)} AS mae, {he('sqrt(avg((forecast - actual) * (forecast - actual)))', 4)} AS rmse,
       {he('coalesce(sum(abs(forecast - actual)) / nullif(sum(abs(actual)), 0), 0)', 4)} AS wape,
       {he('avg(2.0::DOUBLE * abs(forecast - actual) / (abs(actual) + abs(forecast) + 1e-8::DOUBLE)) * 100.0::DOUBLE', 4)} AS smape,
       {he('avg(forecast - actual)', 4)} AS bias, count(*) AS n_samples
FROM base_forecasts WHERE split = 'VAL' GROUP BY 1, 2
""")
put("forecast_metrics", "SELECT * FROM val_metrics")
view("winners", "SELECT * FROM val_metrics QUALIFY row_number() OVER (PARTITION BY horizon ORDER BY wape, mae, model) = 1")
view("weekly_forecast", f"""
SELECT {K}, {he('greatest(0.0::DOUBLE, forecast)', 2)} AS forecast_demand_7d FROM all_forecasts a JOIN winners w ON a.model = w.model AND a.horizon = w.horizon WHERE a.horizon = 't+7'
""")
put("best_model", "SELECT horizon, model AS selected_model, wape AS primary_value, mae, rmse, wape, smape, bias, n_samples FROM winners")
view("chosen", "SELECT b.* FROM base_forecasts b JOIN winners w ON b.horizon = w.horizon AND b.model = w.model")
view("q_interval", """
SELECT horizon, quantile_cont(actual - forecast, 0.1) AS q_lower, quantile_cont(actual - forecast, 0.9) AS q_upper FROM chosen WHERE split = 'VAL' GROUP BY 1
""")
put("prediction_intervals", f"SELECT horizon, {he('q_lower', 6)} AS q_lower, {he('q_upper', 6)} AS q_upper FROM q_interval")
view("fc_banded", """
SELECT c.*, greatest(0, forecast + q_lower) AS lo, greatest(greatest(0, forecast + q_lower), forecast + q_upper) AS hi FROM chosen c JOIN q_interval q ON c.horizon = q.horizon WHERE split = 'TEST'
""")
view("fc_output", f"""
SELECT {K}, category, actual AS actual_demand, {he('forecast', 2)} AS forecast, horizon, model, {he('lo', 2)} AS lower_prediction_interval, {he('hi', 2)} AS upper_prediction_interval,
       {he('actual - forecast', 2)} AS residual, split FROM fc_banded
""")
put("forecast_table", "SELECT * FROM fc_output")
put("interval_coverage", f"SELECT horizon, {he('avg(CASE WHEN actual BETWEEN lo AND hi THEN 1 ELSE 0 END)', 4)} AS empirical_coverage, {he('avg(hi - lo)', 4)} AS average_interval_width, count(*) AS n_samples FROM fc_banded GROUP BY 1")
put("residual_summary", f"""
SELECT horizon, {he('avg(residual)', 4)} AS mean_residual, {he('stddev_samp(residual)', 4)} AS std_residual, {', '.join(f"{he(f'quantile_cont(residual, {p})', 4)} AS p{int(p * 100)}_residual" for p in (0.1, 0.5, 0.9))}
FROM fc_output GROUP BY 1
""")
put("residual_breakdown", " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, {c} AS member, {he('sum(abs(residual)) / sum(actual_demand)', 4)} AS wape, {he('avg(abs(residual))', 4)} AS mae, {he('avg(-residual)', 4)} AS bias FROM fc_output WHERE horizon = 't+1' GROUP BY 2"
    for d, c in (("warehouse", "warehouse_id"), ("category", "category"))
))

# --------------------------------------------------------------------------- risk
PSTOCK = he("least(greatest(1.0::DOUBLE / (1.0::DOUBLE + exp(-((7.0::DOUBLE - inventory_days_of_supply) / 2.0::DOUBLE))) + CASE WHEN safety_stock_gap < 0 THEN 0.15::DOUBLE ELSE 0 END, 0.01::DOUBLE), 0.99::DOUBLE)", 4)
PSUP = he("least(greatest(1.0::DOUBLE - CASE WHEN is_cold_start = 1 THEN baseline_reliability ELSE hist_on_time_rate END, 0.05::DOUBLE), 0.95::DOUBLE)", 4)


def share(*w: float) -> list[str]:
    total = sum(w)
    return [f"{v / total!r}::DOUBLE" for v in w]


def clamp(x: str, lo: str = "0.0::DOUBLE", hi: str = "100.0::DOUBLE") -> str:
    return f"greatest(least({x}, {hi}), {lo})"


def bands(x: str, cuts: tuple[int, int, int]) -> str:
    return f"CASE WHEN {x} < {cuts[0]} THEN 'LOW' WHEN {x} < {cuts[1]} THEN 'MEDIUM' WHEN {x} < {cuts[2]} THEN 'HIGH' ELSE 'CRITICAL' END"


_w = share(0.35, 0.20, 0.15, 0.15, 0.15)
view("inv_test", f"SELECT *, {PSTOCK} AS p, coalesce(ending_inventory_lag1, beginning_inventory, 0)::DOUBLE AS stk FROM inv_features LEFT JOIN weekly_forecast USING ({K}) WHERE date > {VAL_END} AND is_target_available_7d = 1")
view("scored_inv", f"""
SELECT *, {bands('inventory_risk_score', (25, 60, 80))} AS inventory_risk_band FROM (
 SELECT *, p AS stockout_probability_7d, {clamp(he(
   f"{_w[0]} * {clamp('p * 100.0::DOUBLE')} + {_w[1]} * {clamp('(1.0::DOUBLE - inventory_days_of_supply / 14.0::DOUBLE) * 100.0::DOUBLE')} + {_w[2]} * "
   + clamp(f"(1.0::DOUBLE - {clamp('stk / coalesce(nullif(safety_stock_target, 0)::DOUBLE, 1)', '0.0::DOUBLE', '2.0::DOUBLE')}) * 100.0::DOUBLE")
   + f" + {_w[3]} * " + clamp(f"{clamp('forecast_demand_7d::DOUBLE / greatest(stk, 1)', '0.0::DOUBLE', '2.0::DOUBLE')} / 1.5::DOUBLE * 100.0::DOUBLE")
   + f" + {_w[4]} * {clamp('stockout_rate_28d * 100.0::DOUBLE')}", 1))} AS inventory_risk_score FROM inv_test)
""")
view("scored_sup", f"""
SELECT *, {bands('supplier_risk_score', (30, 60, 80))} AS supplier_risk_band FROM (
 SELECT *, p AS supplier_delay_probability, {clamp(he(
   f"{_w[0]} * {clamp('p * 100.0::DOUBLE')} + {_w[1]} * {clamp('(1.0::DOUBLE - hist_on_time_rate) * 100.0::DOUBLE')} + {_w[2]} * "
   + clamp("recent_delay_30d / 3.0::DOUBLE * 50.0::DOUBLE + greatest(delay_trend, 0) * 25.0::DOUBLE")
   + f" + {_w[3]} * {clamp('supplier_capacity_pressure * 100.0::DOUBLE')} + {_w[4]} * {clamp('hist_p90_delay / 5.0::DOUBLE * 100.0::DOUBLE')}", 1))} AS supplier_risk_score
 FROM (SELECT *, {PSUP} AS p FROM sup_features WHERE order_date > {VAL_END}))
""")
put("inventory_risk_score", f"SELECT {K}, stockout_probability_7d, inventory_risk_score, inventory_risk_band FROM scored_inv")
put("supplier_risk_score", "SELECT po_id, supplier_delay_probability, supplier_risk_score, supplier_risk_band FROM scored_sup")
view("rule_scores", f"""
SELECT 'inventory' AS domain, target_stockout_within_7d AS label, {PSTOCK} AS score FROM inv_features WHERE date > {TRAIN_END} AND date <= {VAL_END} AND is_target_available_7d = 1
UNION ALL SELECT 'supplier', 1 - on_time_flag, {PSUP} FROM sup_features WHERE order_date > {TRAIN_END} AND order_date <= {VAL_END}
""")
_pc = "least(greatest(score, 1e-7::DOUBLE), 1.0::DOUBLE - 1e-7::DOUBLE)"
put("risk_metrics", f"""
SELECT domain, n_samples, event_count, {he('rate', 4)} AS event_rate, {he('brier', 4)} AS brier_score, {he('1.0::DOUBLE - brier / (rate * (1.0::DOUBLE - rate))', 4)} AS brier_skill_score,
       {he('ll', 4)} AS log_loss, {he('coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0)', 4)} AS precision, {he('coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0)', 4)} AS recall,
       {he('coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0)', 4)} AS f1, tn, fp, fn, tp
FROM (SELECT domain, count(*) AS n_samples, CAST(sum(label) AS BIGINT) AS event_count, sum(label)::DOUBLE / count(*) AS rate, avg(({_pc} - label) * ({_pc} - label)) AS brier,
        avg(-(label * ln({_pc}) + (1 - label) * ln(1.0::DOUBLE - {_pc}))) AS ll, count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp,
        count(*) FILTER (score < 0.5 AND label = 1) AS fn, count(*) FILTER (score < 0.5 AND label = 0) AS tn FROM rule_scores GROUP BY 1)
""")
view("curve", """
SELECT domain, score, pos, n, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER (PARTITION BY domain) AS allpos, sum(n) OVER (PARTITION BY domain) AS alln
FROM (SELECT domain, score, sum(label)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM rule_scores GROUP BY 1, 2) WINDOW w AS (PARTITION BY domain ORDER BY score DESC)
""")
put("auc_ap", f"SELECT domain, {he('sum((n - pos) * (tp - pos / 2)) / any_value(allpos * (alln - allpos))', 4)} AS roc_auc, {he('sum(pos * (tp / seen)) / any_value(allpos)', 4)} AS pr_auc FROM curve GROUP BY 1")
put("topk_capture", "SELECT domain, " + ", ".join(
    he(f"sum(pos * least(greatest((greatest(1, ceil(alln * {k}::DOUBLE)) - (seen - n)) / n, 0), 1)) / any_value(allpos)", 4) + f" AS top_{int(k * 100)}pct_capture" for k in (0.05, 0.10, 0.20)
) + " FROM curve GROUP BY 1")
put("calibration_bins", f"""
SELECT domain, CAST(CAST(score > 0.2::DOUBLE AS INTEGER) + CAST(score > 0.4::DOUBLE AS INTEGER) + CAST(score > 0.6000000000000001::DOUBLE AS INTEGER) + CAST(score > 0.8::DOUBLE AS INTEGER) AS INTEGER) AS bin,
       count(*) AS n, {he('avg(label)', 8)} AS prob_true, {he('avg(score)', 8)} AS prob_pred FROM rule_scores GROUP BY 1, 2
""")
_PROF = ("supplier_name", "supplier_tier", "supplier_delay_probability", "supplier_risk_score", "supplier_risk_band", "hist_on_time_rate", "hist_p90_delay", "supplier_capacity_pressure", "delay_trend")
view("profile", f"SELECT supplier_id, {', '.join(_PROF)} FROM scored_sup QUALIFY row_number() OVER (PARTITION BY supplier_id ORDER BY order_date DESC, po_id DESC) = 1")
put("latest_supplier_profile", "SELECT * FROM profile")
_x = share(0.45, 0.35, 0.20)
view("exposure", f"""
SELECT *, {bands('operational_exposure_score', (25, 55, 75))} AS operational_exposure_band, {he('qty', 1)} AS projected_exposure_quantity, {he('qty * unit_cost * 1.5::DOUBLE', 2)} AS projected_exposure_cost
FROM (SELECT *, {clamp(he(f"{_x[0]} * inventory_risk_score + {_x[1]} * supplier_risk_score + {_x[2]} * (inventory_risk_score * supplier_risk_score / 100.0::DOUBLE)", 1))} AS operational_exposure_score,
   greatest(0.0::DOUBLE, forecast_demand_7d::DOUBLE - stk) * stockout_probability_7d AS qty
 FROM (SELECT i.*, primary_supplier_id, secondary_supplier_id, supplier_dependency, coalesce(f.supplier_delay_probability, 0.45::DOUBLE) AS supplier_delay_probability,
         coalesce(f.supplier_risk_score, 45.0::DOUBLE) AS supplier_risk_score, coalesce(f.supplier_risk_band, 'MEDIUM') AS supplier_risk_band, f.supplier_name, f.hist_on_time_rate, f.hist_p90_delay, f.supplier_capacity_pressure
       FROM scored_inv i JOIN (SELECT product_id AS pid, primary_supplier_id, secondary_supplier_id, supplier_dependency FROM dim_product) d ON i.product_id = d.pid
       LEFT JOIN profile f ON d.primary_supplier_id = f.supplier_id))
""")
put("operational_exposure", f"""
SELECT {K}, primary_supplier_id, supplier_risk_score, inventory_risk_score, operational_exposure_score, operational_exposure_band, projected_exposure_quantity, projected_exposure_cost,
       supplier_delay_probability * CASE upper(criticality) WHEN 'CRITICAL' THEN 3.0::DOUBLE WHEN 'HIGH' THEN 2.0::DOUBLE WHEN 'MEDIUM' THEN 1.5::DOUBLE WHEN 'LOW' THEN 1.0::DOUBLE ELSE 1.5::DOUBLE END AS supplier_vulnerability,
       {he('stockout_probability_7d * (forecast_demand_7d::DOUBLE / 7::DOUBLE) * unit_cost', 4)} AS expected_exposure
FROM exposure
""")


def f0(x: str) -> str:
    return f"format('{{:.0f}}', round_even({x}, 0))"


def f1(x: str) -> str:
    return f"format('{{:.1f}}', {he(x, 1)})"


_ev = [
    f"CASE WHEN forecast_demand_7d > stk THEN 'Projected 7-day demand (' || {f0('forecast_demand_7d::DOUBLE')} || ' units) exceeds available inventory (' || {f0('stk')} || ' units) by ' || {f0('forecast_demand_7d::DOUBLE - stk')} || ' units.' END",
    f"CASE WHEN inventory_days_of_supply < 5 THEN 'Severely depleted inventory buffer: only ' || {f1('inventory_days_of_supply')} || ' days of supply remaining.' WHEN inventory_days_of_supply < 7 THEN 'Sub-optimal inventory buffer: ' || {f1('inventory_days_of_supply')} || ' days of supply remaining (below 7-day planning target).' END",
    f"CASE WHEN stk < safety_stock_target AND safety_stock_target > 0 THEN 'Physical buffer below safety stock target (' || {f0('stk')} || ' vs ' || {f0('safety_stock_target::DOUBLE')} || ' units, ' || {f1('(safety_stock_target::DOUBLE - stk) / safety_stock_target::DOUBLE * 100.0::DOUBLE')} || '% deficit).' END",
    f"CASE WHEN stockout_count_7d >= 2 THEN 'Elevated recent stockout frequency: ' || stockout_count_7d || ' stockout days in the past 7 days.' WHEN stockout_rate_28d >= 0.15::DOUBLE THEN 'Persistent historical stockout incidence: ' || {f1('stockout_rate_28d * 100.0::DOUBLE')} || '% of past 28 days experienced stockouts.' END",
    f"CASE WHEN supplier_delay_probability >= 0.55::DOUBLE THEN 'Primary supplier [' || coalesce(supplier_name, 'Primary Supplier') || '] presents elevated delivery delay risk (predicted late probability: ' || {f1('supplier_delay_probability * 100.0::DOUBLE')} || '%).' WHEN coalesce(hist_on_time_rate, 1) < 0.60::DOUBLE THEN 'Supplier [' || coalesce(supplier_name, 'Primary Supplier') || '] exhibits low historical reliability (' || {f1('hist_on_time_rate * 100.0::DOUBLE')} || '% on-time delivery rate).' END",
    f"CASE WHEN coalesce(hist_p90_delay, 0) >= 3 THEN 'Severe tail-risk delivery delays: historical 90th percentile delay is ' || {f1('hist_p90_delay')} || ' days.' END",
    f"CASE WHEN coalesce(supplier_capacity_pressure, 0) >= 0.80::DOUBLE THEN 'High supplier capacity pressure: active order volume is ' || {f1('supplier_capacity_pressure * 100.0::DOUBLE')} || '% of monthly capacity.' END",
    "CASE WHEN lower(criticality) = 'high' THEN 'High SKU operational criticality: stockout imposes immediate revenue and SLA penalties.' END",
    "CASE WHEN contains(lower(supplier_dependency), 'single') THEN 'Single-sourced dependency: no immediate secondary supplier alternative available on record.' END",
    f"CASE WHEN coalesce(warehouse_capacity_utilization_lag1, 0) >= 85 THEN 'Warehouse facility under severe saturation (' || {f1('warehouse_capacity_utilization_lag1')} || '% capacity utilization).' END",
]
view("explained", f"""
SELECT *, CASE WHEN len(ev0) = 0 THEN ['Stable buffer health and normal supplier delivery indicators under current operating parameters.'] ELSE ev0 END AS ev
FROM (SELECT *, list_filter([{', '.join(_ev)}], lambda e: e IS NOT NULL) AS ev0 FROM exposure)
""")
put("risk_explanations", f"""
SELECT {K}, CASE WHEN operational_exposure_band IN ('HIGH', 'CRITICAL') THEN 'Elevated ' || lower(operational_exposure_band) || ' operational exposure because ' || lower(details[1]) || details[2:]
                ELSE operational_exposure_band || ' operational exposure: ' || ev[1] END AS explanation_summary,
       CASE operational_exposure_band
         WHEN 'CRITICAL' THEN CASE WHEN supplier_delay_probability >= 0.60::DOUBLE AND contains(lower(supplier_dependency), 'dual') THEN 'URGENT: Expedite purchase order allocation to qualified secondary supplier; trigger emergency regional cross-dock transfer.'
              WHEN inventory_days_of_supply < 4 THEN 'CRITICAL: Issue emergency replenishment PO with express transit; evaluate temporary demand throttling or substitution.'
              ELSE 'CRITICAL: Place urgent expedited PO and reserve safety stock buffer at regional hub.' END
         WHEN 'HIGH' THEN CASE WHEN supplier_delay_probability >= 0.50::DOUBLE THEN 'HIGH PRIORITY: Advance replenishment reorder date by 3 days to absorb expected supplier delay; audit supplier active pipeline.'
              ELSE 'HIGH PRIORITY: Increase replenishment order quantity by safety stock deficit and monitor buffer daily.' END
         WHEN 'MEDIUM' THEN 'ROUTINE REVIEW: Flag for standard procurement review during next weekly planning cycle; verify supplier lead-time adherence.'
         ELSE 'MONITOR: Inventory and supply parameters within standard operating tolerances. No immediate intervention required.' END AS recommended_action,
       array_to_string(ev[1:4], ' | ') AS evidence_bullets
FROM (SELECT *, array_to_string(list_transform(ev[1:3], lambda e: rtrim(e, '.')), '; ') || '.' AS details FROM explained)
""")
view("snapshot", "SELECT * FROM exposure WHERE date = (SELECT max(date) FROM exposure)")
put("risk_snapshot", f"""
SELECT max(date) AS as_of, count(*) AS total_positions, count(*) FILTER (inventory_risk_score >= 60) AS high_risk_positions, {he('avg(stockout_probability_7d) * 100.0::DOUBLE', 4)} AS avg_stockout_probability_pct,
       {he('sum(projected_exposure_cost)', 4)} AS total_exposure_cost, {he("coalesce(sum(projected_exposure_cost) FILTER (operational_exposure_band IN ('HIGH', 'CRITICAL')), 0)", 4)} AS urgent_exposure_cost,
       (SELECT count(*) FILTER (supplier_risk_score >= 60) FROM profile) AS high_risk_suppliers, (SELECT count(*) FROM profile) AS total_suppliers
FROM snapshot
""")
put("exposure_matrix", "SELECT product_id, " + ", ".join(f"max(operational_exposure_score) FILTER (warehouse_id = 'WH-{i}') AS \"WH-{i}\"" for i in range(5)) + " FROM snapshot GROUP BY 1")
put("exposure_bands", f"SELECT operational_exposure_band, count(*) AS n_positions, {he('sum(projected_exposure_cost)', 2)} AS exposure_cost FROM exposure GROUP BY 1")
put("band_crosstab", "SELECT warehouse_id, " + ", ".join(f"count(*) FILTER (operational_exposure_band = '{b}') AS \"{b}\"" for b in ("LOW", "MEDIUM", "HIGH", "CRITICAL")) + " FROM snapshot GROUP BY 1")
put("probability_histogram", "SELECT CAST(least(floor(stockout_probability_7d * 10.0::DOUBLE) + 1, 10) AS INTEGER) AS bin, count(*) AS n_positions FROM exposure GROUP BY 1")
put("investigation_queue", """
SELECT product_id, category, warehouse_id, supplier_name AS primary_supplier_name, forecast_demand_7d, ending_inventory_lag1 AS inventory_position, inventory_days_of_supply, stockout_probability_7d,
       supplier_delay_probability, operational_exposure_score, operational_exposure_band FROM snapshot WHERE operational_exposure_band <> 'LOW'
""")

# ------------------------------------------------------------------------- policy
view("positions", "SELECT product_id, warehouse_id, criticality, forecast_demand_7d, ending_inventory_lag1, safety_stock_target, stockout_probability_7d, supplier_delay_probability FROM snapshot")
put("decision_positions", "SELECT * FROM positions")
view("scenarios", """
SELECT * FROM (VALUES ('baseline',1.0e0,1.0e0,0.0e0,1.0e0,1.0e0,1.0e0,0.95e0,0.6e0), ('demand_surge',1.2e0,1.35e0,0.05e0,1.1e0,1.0e0,1.0e0,0.95e0,0.6e0),
 ('supplier_delay_shock',1.0e0,1.0e0,0.35e0,1.05e0,0.75e0,1.0e0,0.95e0,0.6e0), ('transport_bottleneck',1.0e0,1.0e0,0.1e0,1.5e0,1.0e0,1.0e0,0.95e0,0.6e0),
 ('inventory_constraint',1.0e0,1.0e0,0.0e0,1.0e0,1.0e0,0.7e0,0.95e0,0.6e0), ('combined_stress',1.15e0,1.25e0,0.25e0,1.4e0,0.7e0,0.85e0,0.95e0,0.6e0))
 t(scenario_name, dg, dc, shift, freight, capf, invf, target, gamma)
""")


def applied(scenarios: str) -> str:
    return f"""
SELECT scenario_name, product_id, warehouse_id, forecast_demand_7d::DOUBLE * CASE WHEN lower(criticality) IN ('critical', 'high') THEN dc ELSE dg END AS demand,
       coalesce(ending_inventory_lag1::DOUBLE, 0) * invf AS stock, safety_stock_target::DOUBLE AS safety, stockout_probability_7d AS p_stockout,
       CASE WHEN shift = 0 THEN supplier_delay_probability ELSE greatest(least(supplier_delay_probability + shift, 1), 0) END AS p_delay, 2.5e0 * freight AS rate, capf, target, gamma
FROM positions CROSS JOIN {scenarios}
"""


view("spos", applied("scenarios"))
HOLD = "(0.2e0 / 365.25e0) * 7.0e0"
view("base_plan", f"""
SELECT *, greatest(0, demand - supply) AS shortage_quantity, greatest(0, supply - demand) AS ending_inventory, least(demand, supply) AS fulfilled_quantity,
       order_quantity * unit_cost AS procurement_cost, order_quantity * (rate * sf * wf) AS transport_cost, order_quantity * (p_delay * lead * 0.3e0) AS risk_cost,
       greatest(0, demand - supply) * (selling_price * 1.5e0 * (1.0e0 + p_stockout)) AS shortage_cost, greatest(0, supply - demand) * (unit_cost * {HOLD}) AS holding_cost
FROM (SELECT *, stock + order_quantity AS supply FROM (
  SELECT *, requested * CASE WHEN asked > weekly THEN weekly / asked ELSE 1 END AS order_quantity FROM (
    SELECT r.*, sum(requested) OVER (PARTITION BY scenario_name, supplier_id) AS asked FROM (
      SELECT p.*, d.unit_cost, d.selling_price, s.supplier_id, s.transport_cost_factor AS sf, s.baseline_lead_time_days AS lead, w.transport_cost_factor AS wf,
             s.monthly_capacity_units * capf / 4.333333e0 AS weekly, greatest(0, demand + safety - stock) AS requested
      FROM spos p JOIN dim_product d ON p.product_id = d.product_id JOIN dim_supplier s ON d.primary_supplier_id = s.supplier_id JOIN dim_warehouse w ON p.warehouse_id = w.warehouse_id) r)))
""")
put("baseline_policy", "SELECT scenario_name, product_id, warehouse_id, supplier_id, " + ", ".join(
    f"{he(c, 6)} AS {c}" for c in ("order_quantity", "fulfilled_quantity", "shortage_quantity", "ending_inventory", "procurement_cost", "transport_cost", "risk_cost", "shortage_cost", "holding_cost")
) + " FROM base_plan")
PARTS = ("procurement_cost", "transport_cost", "transshipment_cost", "holding_cost", "shortage_cost", "supplier_risk_cost")
UNITS = ("total_demand", "total_fulfilled", "total_shortage", "total_ordered", "total_transferred")


def totals(src: str) -> str:
    return ("SELECT scenario_name, " + ", ".join(f"{he(c, 2)} AS {c}" for c in PARTS) + f", {he(' + '.join(PARTS), 2)} AS total_landed_cost, "
            + ", ".join(f"{he(c, 2)} AS {c}" for c in UNITS) + f", {he('CASE WHEN total_demand > 0 THEN total_fulfilled / total_demand ELSE 1 END', 4)} AS service_level FROM ({src})")


view("base_totals", totals("""
SELECT scenario_name, sum(procurement_cost) AS procurement_cost, sum(transport_cost) AS transport_cost, 0.0e0 AS transshipment_cost, sum(holding_cost) AS holding_cost, sum(shortage_cost) AS shortage_cost,
       sum(risk_cost) AS supplier_risk_cost, sum(demand) AS total_demand, sum(fulfilled_quantity) AS total_fulfilled, sum(shortage_quantity) AS total_shortage, sum(order_quantity) AS total_ordered, 0.0e0 AS total_transferred
FROM base_plan GROUP BY 1"""))
put("baseline_policy_totals", "SELECT * FROM base_totals")


def transfers(pos: str) -> str:
    return f"""
SELECT scenario_name, product_id, o AS origin_warehouse, d AS dest_warehouse, q AS transfer_quantity, oh + rate * ((ofac + dfac) / 2.0e0) AS unit_transfer_cost, q * (oh + rate * ((ofac + dfac) / 2.0e0)) AS total_transfer_cost
FROM (SELECT s.scenario_name, s.product_id, s.warehouse_id AS o, d.warehouse_id AS d, s.rate, s.oh, s.fac AS ofac, d.fac AS dfac, least(s.hi, d.hi) - greatest(s.lo, d.lo) AS q
  FROM (SELECT *, coalesce(lag(hi) OVER (PARTITION BY scenario_name, product_id ORDER BY oh + rate * fac / 2.0e0, warehouse_id), 0) AS lo FROM (SELECT p.scenario_name, p.product_id, p.warehouse_id, p.rate, handling_cost_per_unit AS oh, transport_cost_factor AS fac, greatest(0, stock - demand) AS units,
          sum(greatest(0, stock - demand)) OVER (PARTITION BY p.scenario_name, p.product_id ORDER BY handling_cost_per_unit + rate * transport_cost_factor / 2.0e0, p.warehouse_id) AS hi
        FROM {pos} p JOIN dim_warehouse w ON p.warehouse_id = w.warehouse_id) QUALIFY units > 0) s
  JOIN (SELECT *, coalesce(lag(hi) OVER (PARTITION BY scenario_name, product_id ORDER BY warehouse_id), 0) AS lo FROM (SELECT p.scenario_name, p.product_id, p.warehouse_id, transport_cost_factor AS fac, greatest(0, demand - stock) AS units,
          sum(greatest(0, demand - stock)) OVER (PARTITION BY p.scenario_name, p.product_id ORDER BY p.warehouse_id) AS hi
        FROM {pos} p JOIN dim_warehouse w ON p.warehouse_id = w.warehouse_id) QUALIFY units > 0) d
  ON s.scenario_name = d.scenario_name AND s.product_id = d.product_id AND s.lo < d.hi AND d.lo < s.hi)
WHERE q > 1e-4::DOUBLE
"""


def nets(t: str) -> str:
    return (f"SELECT scenario_name, product_id, warehouse_id, sum(net) AS net FROM (SELECT scenario_name, product_id, dest_warehouse AS warehouse_id, transfer_quantity AS net FROM {t} "
            f"UNION ALL SELECT scenario_name, product_id, origin_warehouse, -transfer_quantity FROM {t}) GROUP BY 1, 2, 3")


def orders(pos: str, net: str) -> str:
    return f"""
SELECT scenario_name, product_id, warehouse_id, supplier_id, is_primary, order_quantity, order_quantity * puc AS procurement_cost, order_quantity * tuc AS transport_cost, order_quantity * ruc AS risk_cost,
       order_quantity * puc + order_quantity * tuc + order_quantity * ruc AS total_order_cost
FROM (SELECT *, CASE WHEN gamma < 1 THEN least(rq, (sum(rq) OVER (PARTITION BY scenario_name, product_id, warehouse_id) - rq) * gamma / (1.0e0 - gamma)) ELSE rq END AS order_quantity FROM (
  SELECT *, req * CASE WHEN asked > weekly THEN weekly / asked ELSE 1 END AS rq FROM (
    SELECT *, sum(req) OVER (PARTITION BY scenario_name, supplier_id) AS asked FROM (
      SELECT *, need * CASE WHEN row_number() OVER (PARTITION BY scenario_name, product_id, warehouse_id ORDER BY puc + tuc + ruc, supplier_id) = 1 THEN gamma ELSE 1.0e0 - gamma END AS req FROM (
        SELECT p.*, s.supplier_id, s.supplier_id = d.primary_supplier_id AS is_primary, CASE WHEN s.supplier_id = d.primary_supplier_id THEN d.unit_cost ELSE d.unit_cost * 1.05e0 END AS puc,
               p.rate * s.transport_cost_factor * w.transport_cost_factor AS tuc, p.p_delay * s.baseline_lead_time_days * 0.3e0 AS ruc, s.monthly_capacity_units * capf / 4.333333e0 AS weekly
        FROM (SELECT x.*, greatest(0, demand - stock - coalesce(net, 0)) AS need FROM {pos} x LEFT JOIN {net} n USING (scenario_name, product_id, warehouse_id)) p
        JOIN dim_product d ON p.product_id = d.product_id JOIN dim_supplier s ON s.supplier_id IN (d.primary_supplier_id, d.secondary_supplier_id) JOIN dim_warehouse w ON p.warehouse_id = w.warehouse_id
        WHERE need > 1e-4::DOUBLE)))))
WHERE order_quantity > 1e-4::DOUBLE
"""


def flows(pos: str, net: str, ords: str) -> str:
    return f"""
SELECT scenario_name, product_id, warehouse_id, demand, stock, ordered, net_transfer, least(demand, supply) AS fulfilled_quantity, greatest(0, demand - supply) AS shortage_quantity, greatest(0, supply - demand) AS ending_inventory,
       CASE WHEN demand > 0 THEN least(demand, supply) / demand ELSE 1 END AS fill_rate, greatest(0, demand - supply) * (selling_price * 1.5e0 * (1.0e0 + p_stockout)) AS shortage_cost, greatest(0, supply - demand) * (unit_cost * {HOLD}) AS holding_cost
FROM (SELECT p.*, unit_cost, selling_price, coalesce(oq, 0) AS ordered, coalesce(net, 0) AS net_transfer, stock + coalesce(oq, 0) + coalesce(net, 0) AS supply
  FROM {pos} p JOIN (SELECT product_id AS pid, unit_cost, selling_price FROM dim_product) d ON p.product_id = d.pid LEFT JOIN {net} n USING (scenario_name, product_id, warehouse_id)
  LEFT JOIN (SELECT scenario_name, product_id, warehouse_id, sum(order_quantity) AS oq FROM {ords} GROUP BY 1, 2, 3) o USING (scenario_name, product_id, warehouse_id))
"""


def plan_sum(f: str, t: str, o: str) -> str:
    return totals(f"""
SELECT f.*, coalesce(tc, 0) AS transshipment_cost, coalesce(tt, 0) AS total_transferred, coalesce(pc, 0) AS procurement_cost, coalesce(fc, 0) AS transport_cost, coalesce(rc, 0) AS supplier_risk_cost, coalesce(tq, 0) AS total_ordered
FROM (SELECT scenario_name, sum(holding_cost) AS holding_cost, sum(shortage_cost) AS shortage_cost, sum(demand) AS total_demand, sum(fulfilled_quantity) AS total_fulfilled, sum(shortage_quantity) AS total_shortage FROM {f} GROUP BY 1) f
LEFT JOIN (SELECT scenario_name, sum(total_transfer_cost) AS tc, sum(transfer_quantity) AS tt FROM {t} GROUP BY 1) USING (scenario_name)
LEFT JOIN (SELECT scenario_name, sum(procurement_cost) AS pc, sum(transport_cost) AS fc, sum(risk_cost) AS rc, sum(order_quantity) AS tq FROM {o} GROUP BY 1) USING (scenario_name)""")


view("plan_moves", transfers("spos"))
view("plan_nets", nets("plan_moves"))
view("plan_orders", orders("spos", "plan_nets"))
view("plan_flow_rows", flows("spos", "plan_nets", "plan_orders"))
view("plan_total_rows", plan_sum("plan_flow_rows", "plan_moves", "plan_orders"))


def r6(columns: tuple[str, ...], n: int = 6) -> str:
    return ", ".join(f"{he(c, n)} AS {c}" for c in columns)


put("lateral_rebalance", f"SELECT scenario_name, product_id, origin_warehouse, dest_warehouse, {r6(('transfer_quantity', 'unit_transfer_cost', 'total_transfer_cost'))} FROM plan_moves")
put("order_split", f"SELECT scenario_name, product_id, warehouse_id, supplier_id, is_primary, {r6(('order_quantity', 'procurement_cost', 'transport_cost', 'risk_cost', 'total_order_cost'))} FROM plan_orders")
put("plan_flows", f"SELECT scenario_name, product_id, warehouse_id, {r6(('demand', 'stock', 'ordered', 'net_transfer', 'fulfilled_quantity', 'shortage_quantity', 'ending_inventory', 'fill_rate', 'shortage_cost', 'holding_cost'))} FROM plan_flow_rows")
put("lane_costs", f"""
SELECT d.product_id, s.supplier_id, w.warehouse_id, s.supplier_id = d.primary_supplier_id AS is_primary, s.baseline_lead_time_days AS lead_time,
       {he('CASE WHEN s.supplier_id = d.primary_supplier_id THEN d.unit_cost ELSE d.unit_cost * 1.05e0 END', 6)} AS procurement_unit_cost, {he('2.5e0 * s.transport_cost_factor * w.transport_cost_factor', 6)} AS freight_unit_cost
FROM dim_product d JOIN dim_supplier s ON s.supplier_id IN (d.primary_supplier_id, d.secondary_supplier_id) CROSS JOIN dim_warehouse w
""")
put("transfer_lane_costs", """
SELECT product_id, o.warehouse_id AS origin_warehouse, d.warehouse_id AS dest_warehouse, o.handling_cost_per_unit + 2.5e0 * ((o.transport_cost_factor + d.transport_cost_factor) / 2.0e0) AS unit_transfer_cost
FROM dim_product CROSS JOIN dim_warehouse o JOIN dim_warehouse d ON o.warehouse_id <> d.warehouse_id
""")
put("scenario_sweep", f"""
SELECT b.scenario_name, b.total_landed_cost AS baseline_total_cost, b.service_level AS baseline_service_level, b.total_shortage AS baseline_shortage_units, o.total_landed_cost AS optimized_total_cost,
       o.service_level AS optimized_service_level, o.total_shortage AS optimized_shortage_units, o.total_transferred AS lateral_transfers_units, o.total_demand AS total_demand_units,
       {he('b.total_landed_cost - o.total_landed_cost', 2)} AS cost_difference, {he('coalesce((b.total_landed_cost - o.total_landed_cost) / nullif(b.total_landed_cost, 0) * 100.0e0, 0)', 2)} AS cost_reduction_pct,
       {he("b.total_landed_cost - (SELECT total_landed_cost FROM base_totals WHERE scenario_name = 'baseline')", 2)} AS baseline_vs_normal,
       {he("o.total_landed_cost - (SELECT total_landed_cost FROM plan_total_rows WHERE scenario_name = 'baseline')", 2)} AS optimized_vs_normal
FROM base_totals b JOIN plan_total_rows o USING (scenario_name)
""")
put("policy_waterfall", " UNION ALL ".join(
    f"SELECT b.scenario_name, '{c}' AS cost_category, b.{c} AS baseline_cost, o.{c} AS optimized_cost, {he(f'b.{c} - o.{c}', 2)} AS modeled_difference, "
    f"{he(f'CASE WHEN b.{c} > 0 THEN (b.{c} - o.{c}) / b.{c} * 100.0e0 ELSE 0 END', 2)} AS pct_change FROM base_totals b JOIN plan_total_rows o USING (scenario_name)"
    for c in (*PARTS, "total_landed_cost")
))
view("shares", """
SELECT scenario_name, supplier_id, coalesce(b, 0) AS b, coalesce(o, 0) AS o
FROM (SELECT scenario_name, supplier_id, sum(order_quantity) AS b FROM base_plan GROUP BY 1, 2 HAVING sum(order_quantity) > 0)
FULL JOIN (SELECT scenario_name, supplier_id, sum(order_quantity) AS o FROM plan_orders GROUP BY 1, 2) USING (scenario_name, supplier_id)
""")
put("sourcing_shares", f"""
SELECT scenario_name, supplier_id, {he('b', 2)} AS baseline_quantity, {he('coalesce(b / nullif(sum(b) OVER w, 0) * 100.0e0, 0)', 2)} AS baseline_share_pct, {he('o', 2)} AS optimized_quantity,
       {he('coalesce(o / nullif(sum(o) OVER w, 0) * 100.0e0, 0)', 2)} AS optimized_share_pct FROM shares WINDOW w AS (PARTITION BY scenario_name)
""")
put("sourcing_hhi", f"SELECT scenario_name, {he('coalesce(sum(b * b) * 10000.0e0 / nullif(sum(b) * sum(b), 0), 0)', 1)} AS baseline_hhi, {he('coalesce(sum(o * o) * 10000.0e0 / nullif(sum(o) * sum(o), 0), 0)', 1)} AS optimized_hhi FROM shares GROUP BY 1")
put("warehouse_policy_comparison", f"""
SELECT * FROM (SELECT scenario_name, warehouse_id, {he('sum(ending_inventory)', 2)} AS baseline_ending_inv, {he('sum(shortage_quantity)', 2)} AS baseline_shortage FROM base_plan GROUP BY 1, 2)
JOIN (SELECT scenario_name, warehouse_id, {he('sum(ending_inventory)', 2)} AS optimized_ending_inv, {he('sum(shortage_quantity)', 2)} AS optimized_shortage FROM plan_flow_rows GROUP BY 1, 2) USING (scenario_name, warehouse_id)
""")
view("audit_rows", """
SELECT scenario_name, 'flow_balance_' || product_id || '_' || warehouse_id AS constraint_name, 'EQUALITY' AS constraint_type, stock + ordered + net_transfer + shortage_quantity - ending_inventory - demand AS used, 0.0e0 AS bound FROM plan_flow_rows
UNION ALL SELECT scenario_name, 'warehouse_cap_' || warehouse_id, 'INEQUALITY', sum(ending_inventory), any_value(capacity_units)::DOUBLE FROM plan_flow_rows JOIN dim_warehouse USING (warehouse_id) GROUP BY scenario_name, warehouse_id
UNION ALL SELECT scenario_name, 'supplier_cap_' || supplier_id, 'INEQUALITY', sum(order_quantity), any_value(monthly_capacity_units * capf / 4.333333e0) FROM plan_orders JOIN dim_supplier USING (supplier_id) JOIN scenarios USING (scenario_name) GROUP BY scenario_name, supplier_id
UNION ALL SELECT scenario_name, 'dual_source_cap_' || product_id || '_' || supplier_id, 'INEQUALITY', q, 0.6e0 * sum(q) OVER (PARTITION BY scenario_name, product_id) FROM (SELECT scenario_name, product_id, supplier_id, sum(order_quantity) AS q FROM plan_orders GROUP BY 1, 2, 3)
UNION ALL SELECT scenario_name, 'service_level_floor', 'INEQUALITY', sum(shortage_quantity), (1.0e0 - any_value(target)) * sum(demand) FROM plan_flow_rows JOIN scenarios USING (scenario_name) GROUP BY scenario_name
""")
put("plan_audit", f"""
SELECT *, abs(slack) < 0.0001::DOUBLE AS is_binding, CASE WHEN constraint_type = 'EQUALITY' THEN abs(slack) > 0.001e0 ELSE slack < -0.001e0 END AS is_violated
FROM (SELECT scenario_name, constraint_name, constraint_type, {he('used', 6)} + 0.0e0 AS used, {he('bound', 6)} AS bound, {he('bound - used', 6)} + 0.0e0 AS slack FROM audit_rows)
""")
view("sweeps", "SELECT * FROM (VALUES " + ", ".join(
    [f"('sweep_freight_{v:.2f}', 'freight', {v}e0, 1.0e0, 1.0e0, 0.0e0, {v}e0, 1.0e0, 1.0e0, 0.95e0, 0.6e0)" for v in (0.5, 0.75, 1.0, 1.25, 1.5, 2.0)]
    + [f"('sweep_sourcing_cap_{v:.2f}', 'sourcing_cap', {v}e0, 1.0e0, 1.0e0, 0.0e0, 1.0e0, 1.0e0, 1.0e0, 0.95e0, {v}e0)" for v in (0.50, 0.55, 0.60, 0.70, 0.85, 1.00)]
    + [f"('sweep_service_level_{v:.2f}', 'service_level', {v}e0, 1.0e0, 1.0e0, 0.0e0, 1.0e0, 1.0e0, 1.0e0, {v}e0, 0.6e0)" for v in (0.90, 0.92, 0.95, 0.98, 0.99)]
) + ") t(scenario_name, sweep, sweep_value, dg, dc, shift, freight, capf, invf, target, gamma)")
view("swept", applied("sweeps"))
view("sw_moves", transfers("swept"))
view("sw_nets", nets("sw_moves"))
view("sw_orders", orders("swept", "sw_nets"))
view("sw_flows", flows("swept", "sw_nets", "sw_orders"))
put("sensitivity_sweep", f"SELECT t.*, s.sweep, s.sweep_value FROM ({plan_sum('sw_flows', 'sw_moves', 'sw_orders')}) t JOIN sweeps s USING (scenario_name)")
put("decision_log", f"""
SELECT 'RUN-1' AS run_id, scenario_name, decision_type, product_id, origin_id, dest_warehouse_id, {r6(('quantity', 'unit_cost', 'total_cost'))}, is_primary FROM (
 SELECT scenario_name, 'ORDER' AS decision_type, product_id, supplier_id AS origin_id, warehouse_id AS dest_warehouse_id, order_quantity AS quantity, total_order_cost / order_quantity AS unit_cost, total_order_cost AS total_cost, CAST(is_primary AS INTEGER) AS is_primary FROM plan_orders
 UNION ALL SELECT scenario_name, 'TRANSFER', product_id, origin_warehouse, dest_warehouse, transfer_quantity, unit_transfer_cost, total_transfer_cost, 1 FROM plan_moves
 UNION ALL SELECT scenario_name, 'SHORTAGE', product_id, NULL, warehouse_id, shortage_quantity, shortage_cost / shortage_quantity, shortage_cost, 0 FROM plan_flow_rows WHERE round_even(shortage_quantity * 100.0e0, 0) > 0)
""")


def units(x: str) -> str:
    return f"format('{{:,}}', CAST(round_even({x}, 0) AS BIGINT))"


def money(x: str) -> str:
    cents = f"CAST(round_even(({x}) * 100.0e0, 0) AS BIGINT)"
    return f"CASE WHEN {cents} < 0 THEN '-' ELSE '' END || format('{{:,}}', abs({cents}) // 100) || '.' || lpad(CAST(abs({cents}) % 100 AS VARCHAR), 2, '0')"


put("transfer_explanations", f"""
SELECT scenario_name, 'TRANSFER' AS entity_type, origin_warehouse || '->' || dest_warehouse || ':' || t.product_id AS entity_id, t.product_id, {he('q', 2)} AS quantity, {he('q * (unit_cost + 2.5e0) - c', 2)} AS impact_value,
  'Move ' || {units('q')} || ' of ' || product_name || ' [' || t.product_id || '] by lateral transfer, ' || o.warehouse_name || ' to ' || d.warehouse_name || ' [' || origin_warehouse || ' > ' || dest_warehouse
  || ']. Freight: ' || {money('c')} || ' in total, ' || {money('unit_transfer_cost')} || ' a unit. Buying the same units new would cost about ' || {money('q * (unit_cost + 2.5e0)')} || ' with freight.' AS explanation
FROM (SELECT *, transfer_quantity AS q, total_transfer_cost AS c FROM plan_moves WHERE scenario_name = 'baseline' ORDER BY transfer_quantity DESC, product_id, origin_warehouse, dest_warehouse LIMIT 5) t
JOIN dim_product p ON t.product_id = p.product_id JOIN dim_warehouse o ON o.warehouse_id = origin_warehouse JOIN dim_warehouse d ON d.warehouse_id = dest_warehouse
""")
put("dual_sourcing_explanations", f"""
SELECT scenario_name, 'DUAL_SOURCING' AS entity_type, t.product_id || ':' || secondary_supplier_id AS entity_id, t.product_id, {he('q', 2)} AS quantity, {he('q / a * 100.0e0', 1)} AS impact_value,
  product_name || ' [' || t.product_id || ']: ' || {units('q')} || ' units, ' || {f1('q / a * 100.0e0')} || '% of the order, go to ' || s2.supplier_name || ' [' || secondary_supplier_id || '], the rest to '
  || s1.supplier_name || ' [' || primary_supplier_id || ']. No supplier may get more than 60%, so that a late delivery of one leaves the other.' AS explanation
FROM (SELECT scenario_name, product_id, coalesce(sum(order_quantity) FILTER (NOT is_primary), 0) AS q, sum(order_quantity) AS a FROM plan_orders WHERE scenario_name = 'baseline' GROUP BY 1, 2 ORDER BY q DESC, product_id LIMIT 5) t
JOIN dim_product p ON t.product_id = p.product_id JOIN dim_supplier s1 ON s1.supplier_id = primary_supplier_id JOIN dim_supplier s2 ON s2.supplier_id = secondary_supplier_id
WHERE q > 0
""")
put("plan_narrative", f"""
SELECT scenario_name, 'Coordinated plan for scenario ''' || scenario_name || ''' reaches a service level of ' || {f1('o.service_level * 100.0e0')} || '% across ' || {units('o.total_demand')}
  || ' units of 7-day demand. Modeled 7-day cost is $' || {money('o.total_landed_cost')} || ', a difference of $' || {money('b.total_landed_cost - o.total_landed_cost')} || ' ('
  || {f1('(b.total_landed_cost - o.total_landed_cost) / b.total_landed_cost * 100.0e0')} || '% lower) to the order-up-to baseline ($' || {money('b.total_landed_cost')} || '). It moves ' || {units('o.total_transferred')} || ' units over '
  || coalesce(n, 0) || ' transfers and orders ' || {units('o.total_ordered')} || ' units under the single-supplier share ceiling.' AS narrative
FROM plan_total_rows o JOIN base_totals b USING (scenario_name) LEFT JOIN (SELECT scenario_name, count(*) AS n FROM plan_moves GROUP BY 1) USING (scenario_name)
""")

# ---------------------------------------------------------------------- part grain
view("part_demand", """
SELECT l_partkey AS part_id, 'WH-' || n_regionkey AS warehouse_id, CAST(o_orderdate AS DATE) AS date, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS demand_requested
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3
""")
view("part_receipts", """
SELECT CAST(split_part(po_id, '-', 4) AS BIGINT) AS part_id, warehouse_id, actual_delivery_date AS date, CAST(sum(quantity_received) AS BIGINT) AS po_received
FROM fact_purchase_orders GROUP BY 1, 2, 3
""")
_PK = "part_id, warehouse_id, date"
# Each day with demand meets the earlier ones of its series; days without demand count as zero.
_pairs = {}
for _w in (7, 28):
    _in = f"gap BETWEEN 1 AND {_w}"
    _n = f"least({_w}, age_days)"
    _pairs |= {
        f"rolling_sum_{_w}": f"CAST(coalesce(sum(q) FILTER ({_in}), 0) AS BIGINT)",
        f"rolling_mean_{_w}": he(f"coalesce(sum(q) FILTER ({_in}), 0)::DOUBLE / nullif({_n}, 0)", 4),
        f"rolling_max_{_w}": f"CASE WHEN {_n} > 0 THEN CAST(coalesce(max(q) FILTER ({_in}), 0) AS BIGINT) END",
        f"rolling_min_{_w}": f"CASE WHEN {_n} > 0 THEN CASE WHEN count(q) FILTER ({_in}) < {_n} THEN 0 ELSE CAST(min(q) FILTER ({_in}) AS BIGINT) END END",
        f"active_days_{_w}": f"count(q) FILTER ({_in})",
    }
_s1, _s2 = (f"coalesce(sum({x}) FILTER (gap BETWEEN 1 AND 28), 0)" for x in ("q", "q * q"))
_pairs["rolling_std_28"] = he(std("least(28, age_days)", _s1, _s2), 4)
_lags = {f"demand_lag_{k}": f"CASE WHEN age_days >= {k} THEN CAST(coalesce(sum(q) FILTER (gap = {k}), 0) AS BIGINT) END" for k in (1, 7, 14, 28)}
view("part_first_days", "SELECT part_id, warehouse_id, min(date) AS first_day FROM part_demand GROUP BY 1, 2")
view("part_pairs", """
SELECT a.part_id, a.warehouse_id, a.date, a.demand_requested, CAST(a.date - first_day AS INTEGER) AS age_days, b.demand_requested AS q, a.date - b.date AS gap
FROM part_demand a JOIN part_first_days f ON a.part_id = f.part_id AND a.warehouse_id = f.warehouse_id
LEFT JOIN part_demand b ON b.part_id = a.part_id AND b.warehouse_id = a.warehouse_id AND b.date < a.date
""")
put("part_demand_features", f"""
SELECT {_PK}, demand_requested, age_days, CAST(min(gap) AS INTEGER) AS days_since_last, {", ".join(f"{e} AS {n}" for n, e in (_lags | _pairs).items())}
FROM part_pairs GROUP BY {_PK}, demand_requested, age_days
""")
view("part_flows", f"""
SELECT {_PK}, CAST(sum(d) AS BIGINT) AS demand_requested, CAST(sum(r) AS BIGINT) AS po_received
FROM (SELECT {_PK}, demand_requested AS d, 0 AS r FROM part_demand UNION ALL SELECT {_PK}, 0, po_received FROM part_receipts) GROUP BY {_PK}
""")
view("part_stock", f"""
SELECT {_PK}, demand_requested, po_received, bal + conj AS ending_inventory, coalesce(lag(bal + conj) OVER w, 20) AS beginning_inventory,
       conj - coalesce(lag(conj) OVER w, 0) AS stockout_quantity, CAST(coalesce(lead(date) OVER w - date, 1) AS INTEGER) AS days_held
FROM (
  SELECT *, greatest(0, -min(bal) OVER (PARTITION BY part_id, warehouse_id ORDER BY date)) AS conj
  FROM (SELECT *, CAST(20 + sum(po_received - demand_requested) OVER (PARTITION BY part_id, warehouse_id ORDER BY date) AS BIGINT) AS bal FROM part_flows)
)
WINDOW w AS (PARTITION BY part_id, warehouse_id ORDER BY date)
""")
put("part_ledger", "SELECT * FROM part_stock")
put("part_stock_summary", f"""
SELECT part_id, warehouse_id, min(date) AS first_day, max(date) AS last_day, CAST(sum(days_held) AS BIGINT) AS days, count(*) AS movement_days,
       {he('sum(ending_inventory * days_held)::DOUBLE / sum(days_held)::DOUBLE', 4)} AS mean_stock,
       CAST(sum(CASE WHEN ending_inventory = 0 THEN days_held ELSE 0 END) AS BIGINT) AS empty_days, CAST(sum(stockout_quantity) AS BIGINT) AS unmet_units
FROM part_stock GROUP BY 1, 2
""")

put("supplier_display", """
SELECT supplier_id, supplier_name, supplier_tier, printf('%.1f', supplier_delay_probability * 100.0::DOUBLE) || '%' AS supplier_delay_probability, supplier_risk_score, supplier_risk_band,
       printf('%.1f', hist_on_time_rate * 100.0::DOUBLE) || '%' AS hist_on_time_rate, hist_p90_delay FROM profile
""")
put("worst_position", """
SELECT date, product_id, warehouse_id, operational_exposure_score, CAST(least(len(ev), 4) AS INTEGER) AS n_evidence
FROM explained WHERE date = (SELECT max(date) FROM explained) ORDER BY operational_exposure_score DESC, product_id, warehouse_id LIMIT 1
""")

# ------------------------------------------------------------------ stores and logs
put("run_logs", " UNION ALL ".join(
    f"SELECT '{log}' AS log_name, r.run_id, count(*) AS n_rows FROM ({ORACLE[q]}) x, (VALUES ('RUN-1'), ('RUN-2')) r(run_id) GROUP BY r.run_id"
    for log, q in (("decisions", "decision_log"), ("comparisons", "warehouse_policy_comparison"), ("explanations", "transfer_explanations"))
))
put("upserted_orders", """
SELECT po_id, order_date, quantity_ordered, CASE WHEN quantity_ordered % 5 = 0 THEN 'Closed' ELSE status END AS status FROM fact_purchase_orders
UNION ALL SELECT po_id || '-B', order_date, quantity_ordered, status FROM fact_purchase_orders WHERE quantity_ordered % 5 = 1
""")
put("slice_rows", """
SELECT po_id, order_date, quantity_ordered, transport_id, transport_mode FROM fact_purchase_orders JOIN (SELECT po_id, transport_id, transport_mode FROM raw_transport) USING (po_id)
WHERE order_date >= DATE '2001-09-15'
""")
put("csv_round_trip", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {GIVEN.get(t, t)}) AS rows_read, ({n}) AS lines_rejected, true AS equal"
    for t, n in ({t: "0" for t in _PROFILED} | {"fact_demand": "SELECT count(*) FROM raw_demand WHERE demand_requested = 13", "fact_purchase_orders": "SELECT count(*) FROM raw_orders WHERE quantity_ordered = 11"}).items()
).replace("(0) AS lines_rejected", "CAST(0 AS BIGINT) AS lines_rejected"))

# Columns of type DATE per query, for callers that want ISO text.
_KEYED = (
    "daily_demand_rollup inventory_health warehouse_daily coverage_kpis date_dimension dense_demand_grid event_overlay ledger_rows "
    "warehouse_load demand_lags demand_rolling demand_dynamics demand_targets demand_feature_table sparse_demand_features "
    "inventory_buffer stockout_history warehouse_pressure inventory_targets clean_demand seasonal_naive moving_average "
    "forecast_table inventory_risk_score operational_exposure risk_explanations"
).split()
DATE_COLUMNS: dict[str, tuple[str, ...]] = {name: ("date",) for name in _KEYED}
DATE_COLUMNS |= {
    "stockout_episodes": ("first_day", "last_day"),
    "part_demand_features": ("date",),
    "worst_position": ("date",),
    "part_ledger": ("date",),
    "part_stock_summary": ("first_day", "last_day"),
    "upserted_orders": ("order_date",),
    "slice_rows": ("order_date",),
    "split_bounds": ("first_day", "last_day"),
    "clean_po": ("order_date", "expected_delivery_date", "actual_delivery_date"),
    "risk_snapshot": ("as_of",),
}
