"""The star schema as SQL common table expressions over the source tables.

``sql("SELECT ...")`` puts the views a query names, and the views those need,
in front of it as one WITH clause.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}


def view(name: str, body: str) -> None:
    VIEWS[name] = body.strip()


def names_in(text: str) -> list[str]:
    found = set(re.findall(r"[a-z_][a-z0-9_]*", text))
    return [n for n in VIEWS if n in found]


def sql(query: str) -> str:
    needed: list[str] = []

    def visit(name: str) -> None:
        if name in needed:
            return
        for other in names_in(VIEWS[name]):
            if other != name:
                visit(other)
        needed.append(name)

    for name in names_in(query):
        visit(name)
    if not needed:
        return query.strip()
    parts = ",\n".join(f"{n} AS MATERIALIZED (\n{VIEWS[n]}\n)" for n in needed)
    return f"WITH {parts}\n{query.strip()}"


view("dim_warehouse", """
SELECT 'WH-' || r_regionkey AS warehouse_id, r_name AS warehouse_name, r_name AS region,
       CAST(40000 + 10000 * r_regionkey AS BIGINT) AS capacity_units,
       CAST(1.25 AS DOUBLE) + CAST(0.125 AS DOUBLE) * r_regionkey AS handling_cost_per_unit,
       CAST(1 AS DOUBLE) + CAST(0.125 AS DOUBLE) * r_regionkey AS transport_cost_factor
FROM region
""")

view("dim_market", """
SELECT 'MKT-' || n_nationkey AS market_id, n_name AS market_name, r_name AS region,
       'WH-' || n_regionkey AS primary_warehouse_id,
       1.0::DOUBLE + 0.125::DOUBLE * (n_nationkey % 4) AS demand_multiplier,
       1.0::DOUBLE + 0.0625::DOUBLE * (n_nationkey % 3) AS seasonality_multiplier,
       0.03125::DOUBLE * (n_nationkey % 5) AS annual_growth_rate
FROM nation JOIN region ON n_regionkey = r_regionkey
""")

view("dim_supplier", """
SELECT 'SUP-' || s_suppkey AS supplier_id, s_name AS supplier_name,
       (['ECONOMY','LARGE','MEDIUM','PROMO','SMALL','STANDARD'])[1 + s_suppkey % 6] || ', ' ||
       (['ECONOMY','LARGE','MEDIUM','PROMO','SMALL','STANDARD'])[1 + (s_suppkey + 1) % 6] AS primary_categories,
       0.75::DOUBLE + 0.0625::DOUBLE * (s_suppkey % 4) AS baseline_reliability,
       CAST(5 + s_suppkey % 14 AS INTEGER) AS baseline_lead_time_days,
       1.0::DOUBLE + 0.25::DOUBLE * (s_suppkey % 5) AS lead_time_variance,
       CAST(1200 + 300 * (s_suppkey % 7) AS BIGINT) AS monthly_capacity_units,
       CAST(50 * (1 + s_suppkey % 4) AS INTEGER) AS moq_units,
       0.75::DOUBLE + 0.125::DOUBLE * (s_suppkey % 5) AS transport_cost_factor,
       'Tier-' || (1 + s_suppkey % 3) AS tier
FROM supplier
""")

view("dim_product", """
SELECT p_brand AS product_id, 'Family ' || p_brand AS product_name, category,
       price * 0.625::DOUBLE AS unit_cost, price AS selling_price,
       (['High','Medium','Low'])[1 + hi % 3] AS criticality,
       CAST(n AS INTEGER) AS base_demand, CAST(30 * max_size AS INTEGER) AS shelf_life_days,
       CASE WHEN lo % 2 = 0 THEN 'Ambient' ELSE 'Cold' END AS storage_requirement,
       CASE WHEN lo % 4 = 0 THEN 'Single-sourced' ELSE 'Dual-sourced' END AS supplier_dependency,
       'SUP-' || ((lo * 7) % ns) AS primary_supplier_id,
       'SUP-' || ((lo * 7 + 1 + lo % 3) % ns) AS secondary_supplier_id,
       CAST(100 + 10 * (lo % 5) AS INTEGER) AS moq_units, 7 AS lead_time_expectation_days
FROM (
  SELECT p_brand, min(p_partkey) AS lo, max(p_partkey) AS hi, arg_min(p_type, p_partkey) AS category,
         count(*) AS n, max(p_size) AS max_size,
         floor(CAST(sum(CAST(round(p_retailprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100.0::DOUBLE * 64.0::DOUBLE + 0.5::DOUBLE) / 64.0::DOUBLE AS price
  FROM part GROUP BY p_brand
), (SELECT count(*) AS ns FROM supplier)
""")

view("dim_date", """
SELECT date, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
       CAST(quarter(date) AS INTEGER) AS quarter, CAST(weekofyear(date) AS INTEGER) AS week,
       CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, dayname(date) AS day_name,
       CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend, CAST(day(date) = 1 AS INTEGER) AS is_month_start,
       CAST(date = last_day(date) AS INTEGER) AS is_month_end,
       CAST(date = last_day(date) AND month(date) % 3 = 0 AS INTEGER) AS is_quarter_end,
       CAST(strftime(date, '%m-%d') IN ('01-01','05-01','07-04','11-28','12-25') AS INTEGER) AS holiday_flag,
       CAST(strftime(date, '%m-%d') BETWEEN '03-22' AND '03-29' OR strftime(date, '%m-%d') BETWEEN '07-10' AND '07-17'
         OR strftime(date, '%m-%d') BETWEEN '11-24' AND '12-02' OR strftime(date, '%m-%d') BETWEEN '12-15' AND '12-22' AS INTEGER) AS promotion_period
FROM (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS date FROM (
  SELECT o_orderdate AS day FROM orders UNION ALL SELECT l_shipdate FROM lineitem
  UNION ALL SELECT l_shipdate + INTERVAL 22 DAY FROM lineitem))
""")

view("event_rows", """
SELECT * FROM (VALUES
 (1,'EVT-01','Port strike',DATE '1995-09-01',DATE '1995-10-15','Supply','High','ASIA','ALL',1.0::DOUBLE,1.5::DOUBLE,1.25::DOUBLE),
 (2,'EVT-02','Spring promotion',DATE '1996-03-01',DATE '1996-03-31','Demand','Low','ALL','PROMO, SMALL',1.25,1.0,1.0),
 (3,'EVT-03','Fuel price rise',DATE '1997-05-10',DATE '1997-08-20','Transport','Medium','EUROPE','ALL',1.0,1.125,1.5),
 (4,'EVT-04','Summer heat',DATE '1997-08-01',DATE '1997-08-31','Demand','Medium','AFRICA','ECONOMY, LARGE',1.5,1.0,1.125),
 (5,'EVT-05','Supplier outage',DATE '1999-02-01',DATE '1999-03-15','Supply','Critical','ALL','STANDARD',0.75,2.0,1.0),
 (6,'EVT-06','Year-end rush',DATE '2000-11-20',DATE '2000-12-31','Demand','High','ALL','ALL',1.75,1.25,1.25)
) t(ev_seq, event_id, event_name, start_date, end_date, event_type, severity, affected_region, affected_categories,
    demand_multiplier, lead_time_multiplier, transport_cost_multiplier)
""")

view("fact_demand", """
SELECT date, product_id, market_id, warehouse_id, demand_requested, promotion_flag,
       coalesce((SELECT arg_max(e.event_id, e.ev_seq) FROM event_rows e
                 WHERE x.date BETWEEN e.start_date AND e.end_date
                   AND (e.affected_region = 'ALL' OR e.affected_region = x.region)
                   AND (e.affected_categories = 'ALL' OR list_contains(string_split(e.affected_categories, ', '), x.category))), 'NONE') AS event_id,
       outlier_flag
FROM (
  SELECT CAST(o_orderdate AS DATE) AS date, p_brand AS product_id, 'MKT-' || c_nationkey AS market_id,
         'WH-' || n_regionkey AS warehouse_id, r_name AS region, category,
         CAST(l_quantity AS BIGINT) AS demand_requested, CAST(l_discount >= 0.08::DOUBLE AS INTEGER) AS promotion_flag,
         CAST(l_quantity >= 50 AS INTEGER) AS outlier_flag
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  JOIN part ON l_partkey = p_partkey JOIN dim_product ON p_brand = product_id
) x
""")

view("fact_purchase_orders", """
SELECT 'PO-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || s_suppkey || '-' || strftime(order_date, '%Y%m%d') AS po_id, order_date, 'SUP-' || s_suppkey AS supplier_id,
       'WH-' || n_regionkey AS warehouse_id, p_brand AS product_id, q AS quantity_ordered,
       elt AS expected_lead_time_days, alt AS actual_lead_time_days,
       order_date + elt AS expected_delivery_date, order_date + alt AS actual_delivery_date,
       qr AS quantity_received, uc AS unit_cost, qr * uc AS total_procurement_cost,
       q * ((0.75::DOUBLE + 0.125::DOUBLE * (s_suppkey % 5)) * (1.0::DOUBLE + 0.125::DOUBLE * n_regionkey) * 2.5::DOUBLE) AS transport_cost,
       greatest(0, alt - elt) AS delay_days, CAST(alt <= elt AS INTEGER) AS on_time_flag,
       CAST(q = qr AS INTEGER) AS in_full_flag, CAST(alt <= elt AND q = qr AS INTEGER) AS otif_flag, 'Delivered' AS status
FROM (
  SELECT l.*, p_brand, s_suppkey, n_regionkey, CAST(l_shipdate AS DATE) AS order_date, CAST(l_quantity AS BIGINT) AS q,
         CAST(5 + s_suppkey % 14 AS INTEGER) AS elt,
         CAST(greatest(1, 5 + s_suppkey % 14 + (7 * l_partkey + 3 * l_orderkey + l_linenumber) % 8 - 3) AS INTEGER) AS alt,
         CASE WHEN l_returnflag = 'R' THEN CAST(floor(l_quantity * 0.9375::DOUBLE) AS BIGINT) ELSE CAST(l_quantity AS BIGINT) END AS qr,
         floor(l_extendedprice / l_quantity * 64.0::DOUBLE + 0.5::DOUBLE) / 64.0::DOUBLE AS uc
  FROM lineitem l JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey
)
""")

view("daily_flows", """
SELECT p.product_id, w.warehouse_id, d.date, CAST(coalesce(dem.q, 0) AS BIGINT) AS demand_requested,
       CAST(coalesce(rec.q, 0) AS BIGINT) AS po_received
FROM dim_date d CROSS JOIN dim_product p CROSS JOIN dim_warehouse w
LEFT JOIN (SELECT product_id, warehouse_id, date, sum(demand_requested) AS q FROM fact_demand GROUP BY ALL) dem
  ON dem.product_id = p.product_id AND dem.warehouse_id = w.warehouse_id AND dem.date = d.date
LEFT JOIN (SELECT product_id, warehouse_id, actual_delivery_date AS date, sum(quantity_received) AS q FROM fact_purchase_orders GROUP BY ALL) rec
  ON rec.product_id = p.product_id AND rec.warehouse_id = w.warehouse_id AND rec.date = d.date
""")

view("stock_policy", """
SELECT f.product_id, f.warehouse_id, greatest(1.0::DOUBLE, avg(demand_requested)) AS mean_demand,
       CAST(ceil(1.645::DOUBLE * greatest(1.0::DOUBLE, sqrt((count(*)::DOUBLE * sum(demand_requested * demand_requested)::DOUBLE
          - sum(demand_requested)::DOUBLE * sum(demand_requested)::DOUBLE) / (count(*)::DOUBLE * count(*)::DOUBLE)))
          * sqrt(any_value(baseline_lead_time_days)::DOUBLE)) AS BIGINT) AS safety_stock,
       any_value(baseline_lead_time_days)::DOUBLE AS lead, any_value(p.moq_units) AS moq
FROM daily_flows f JOIN dim_product p ON f.product_id = p.product_id
JOIN dim_supplier s ON p.primary_supplier_id = s.supplier_id
GROUP BY f.product_id, f.warehouse_id
""")

view("fact_inventory", """
SELECT date, y.product_id, y.warehouse_id, coalesce(lag(ending_inventory) OVER w, 200) AS beginning_inventory, po_received,
       demand_requested, demand_requested - unmet AS demand_fulfilled, CAST(0 AS BIGINT) AS opening_backorder,
       CAST(0 AS BIGINT) AS backorder_fulfilled, unmet * 3 // 10 AS new_backorder, unmet - unmet * 3 // 10 AS lost_sales_quantity,
       unmet * 3 // 10 AS ending_backorder, ending_inventory, CAST(unmet > 0 AS INTEGER) AS stockout_flag,
       unmet AS stockout_quantity, safety_stock AS safety_stock_target,
       floor(ending_inventory * unit_cost * 0.2::DOUBLE / 365.25::DOUBLE * 16384.0::DOUBLE + 0.5::DOUBLE) / 16384.0::DOUBLE AS holding_cost,
       (unmet - unmet * 3 // 10) * selling_price * 1.5::DOUBLE AS stockout_cost
FROM (
  SELECT product_id, warehouse_id, date, demand_requested, po_received, bal + conj AS ending_inventory,
         conj - coalesce(lag(conj) OVER (PARTITION BY product_id, warehouse_id ORDER BY date), 0) AS unmet
  FROM (
    SELECT *, greatest(0, -min(bal) OVER (PARTITION BY product_id, warehouse_id ORDER BY date)) AS conj
    FROM (
      SELECT *, CAST(200 + sum(po_received - demand_requested) OVER (PARTITION BY product_id, warehouse_id ORDER BY date) AS BIGINT) AS bal
      FROM daily_flows
    )
  )
) y
JOIN stock_policy USING (product_id, warehouse_id) JOIN dim_product p ON y.product_id = p.product_id
WINDOW w AS (PARTITION BY y.product_id, y.warehouse_id ORDER BY date)
""")
