"""Named queries over a data folder: ``QUERIES[name](star) -> DataFrame``.

``View`` holds the derived tables several queries share, built from a star
schema on first use. Tables that stand for a written stage (features, scores,
decisions) are staged as Parquet, the others stay lazy. The split dates below are the chronological train / validation /
test borders used with the adapted order data.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplyspark.functions import kpis
from supplyspark.functions.exprs import half_even, ratio
from supplyspark.operators import audit, cleaning, evaluate, forecast, forecast_store, leakage, ledger, policy, quality, ragged, risk, series, splits
from supplyspark.operators.features import demand as fd
from supplyspark.operators.features import inventory as fi
from supplyspark.operators.features import supplier as fs
from supplyspark.plans import models, served
from supplyspark.plans import queries as q
from supplyspark.plans import reconcile, rollups
from supplyspark.session import shared_dir, staged, staged_property
from supplyspark.sources import io, versioned
from supplyspark.sources.adapter import HOLIDAYS, StarSchema
from supplyspark.sources.commits import CommitConflict
from supplyspark.sources.schemas import SPECS

TRAIN_END, VAL_END = "1999-06-30", "2000-06-30"
LEAK_CUTOFF = "2000-06-30"
RECENT_CUTOFF = "2001-06-01"
LATER_CUTOFF = "2001-09-15"
PART_STOCK = 20  # units of each part that a warehouse starts with
SERIES_KEY = ["product_id", "warehouse_id", "date"]


class View:
    def __init__(self, star: StarSchema):
        self.star = star
        self.spark = star.spark

    # --------------------------------------------------------------- rollups
    @staged_property
    def daily_demand(self) -> DataFrame:
        s = self.star
        return rollups.daily_demand(s.narrow("fact_demand"), s.dim_product, s.dim_warehouse)

    @staged_property
    def supplier_performance(self) -> DataFrame:
        return rollups.supplier_performance(self.star.fact_purchase_orders, self.star.dim_supplier)

    @staged_property
    def warehouse_operations(self) -> DataFrame:
        return rollups.warehouse_operations(self.star.ledger, self.star.dim_warehouse)

    @staged_property
    def cost_summary(self) -> DataFrame:
        s = self.star
        return rollups.cost_summary(s.ledger, s.narrow("fact_purchase_orders"), s.dim_warehouse)

    @staged_property
    def inventory_health(self) -> DataFrame:
        s = self.star
        return rollups.inventory_health(s.ledger, s.dim_product, s.dim_warehouse)

    @cached_property
    def stored_rollups(self) -> dict[str, DataFrame]:
        """The written rollups that the queries read."""
        return {
            "analytics_daily_demand": self.daily_demand,
            "analytics_inventory_health": self.inventory_health,
            "analytics_cost_summary": self.cost_summary,
        }

    # -------------------------------------------------------------- features
    @cached_property
    def grid(self) -> DataFrame:
        s = self.star
        return fd.base_grid(s.dim_product, s.dim_warehouse, s.dim_date, self.daily_demand)

    @staged_property
    def demand_features(self) -> DataFrame:
        start = self.star.dim_date.agg(F.min("date")).scalar()
        return fd.demand_features(self.grid, self.star.event_rows, HOLIDAYS, start)

    @cached_property
    def part_stock(self) -> DataFrame:
        """Lazy: it has about as many rows as the orders, and its summary uses the series as they lie."""
        return ragged.ledger(ragged.flows(self.star.part_demand_rows, self.star.part_receipt_rows), PART_STOCK)

    @cached_property
    def ledger_base(self) -> DataFrame:
        s = self.star
        return fi.base_ledger(s.ledger, s.dim_product, s.dim_warehouse)

    @staged_property
    def inventory_features(self) -> DataFrame:
        start = self.star.dim_date.agg(F.min("date")).scalar()
        return fi.inventory_features(self.ledger_base, start=start)

    @cached_property
    def order_base(self) -> DataFrame:
        return fs.base_orders(self.star.fact_purchase_orders, self.star.dim_supplier)

    @cached_property
    def supplier_features(self) -> DataFrame:
        """Lazy: as wide as it is long, and most readers need a few of its columns or one split."""
        return fs.order_features(self.order_base, self.busy_suppliers)

    @cached_property
    def busy_suppliers(self) -> list[str]:
        return fs.busy_suppliers(self.order_base)

    # ------------------------------------------------------------- forecasts
    @cached_property
    def series_rows(self) -> DataFrame:
        return splits.with_split(self.grid, "date", TRAIN_END, VAL_END)

    @cached_property
    def forecast_store(self) -> DataFrame:
        """Forecasts of the baselines for every day and horizon, written by horizon."""
        made = forecast.baseline_forecasts(self.series_rows, known_only=False)
        return staged(forecast_store.store_rows(made, forecast_store.BASELINE), "forecast_store", ("horizon",))

    @cached_property
    def _learned(self) -> dict[tuple[str, int], DataFrame]:
        return {}

    @cached_property
    def _horizon_rows(self) -> dict[int, DataFrame]:
        return {}

    def learned(self, family: str, horizon: int) -> DataFrame:
        """Forecasts of the tuned model of one family for one horizon, fitted on first use."""
        if (family, horizon) not in self._learned:
            if horizon not in self._horizon_rows:
                rows = models.horizon_rows(self.demand_features, horizon, TRAIN_END, VAL_END)
                self._horizon_rows[horizon] = staged(rows, f"rows_{horizon}")
            made = models.best_forecasts(self._horizon_rows[horizon], horizon, family)
            self._learned[family, horizon] = staged(forecast_store.store_rows(made, forecast_store.LEARNED), f"{family}_{horizon}")
        return self._learned[family, horizon]

    @cached_property
    def learned_store(self) -> DataFrame:
        """Forecasts of the tuned ridge and boosted models, in the same form; the horizons are fitted side by side."""
        _ = self.demand_features, self._horizon_rows, self._learned  # made once, before the threads
        made = models.together(lambda h: [self.learned(f, h) for f in models.FORECAST_FAMILIES], fd.HORIZONS)
        return reduce(DataFrame.unionByName, [df for family in zip(*made) for df in family])

    @cached_property
    def full_store(self) -> DataFrame:
        return self.forecast_store.unionByName(self.learned_store)

    @cached_property
    def baseline_forecasts(self) -> DataFrame:
        return forecast_store.known(self.forecast_store)

    @staged_property
    def validation_metrics(self) -> DataFrame:
        return forecast_store.validation_metrics(self.forecast_store)

    @cached_property
    def forecast_winners(self) -> DataFrame:
        best = evaluate.best_model(self.validation_metrics)
        return best.select("horizon", F.col("selected_model").alias("model"))

    @staged_property
    def selected_forecasts(self) -> DataFrame:
        """Validation and test rows of the winning model of each horizon."""
        return self.baseline_forecasts.join(self.forecast_winners, ["horizon", "model"], "left_semi")

    @cached_property
    def intervals(self) -> DataFrame:
        val = self.selected_forecasts.filter(F.col("split") == splits.VALIDATION)
        return evaluate.interval_quantiles(val, ["horizon"])

    @staged_property
    def forecast_output(self) -> DataFrame:
        test = self.selected_forecasts.filter(F.col("split") == splits.TEST)
        return forecast.forecast_output(test, self.intervals)

    # ------------------------------------------------------------------ risk
    @cached_property
    def inventory_rows(self) -> DataFrame:
        """Features with the 7-day forecast that was made on the row's day."""
        rows = forecast_store.as_of(self.inventory_features, self.forecast_store, self.forecast_winners, "t+7", "forecast_demand_7d")
        return splits.with_split(rows, "date", TRAIN_END, VAL_END)

    @staged_property
    def scored_inventory(self) -> DataFrame:
        rows = self.inventory_rows.filter(
            (F.col("split") == splits.TEST) & (F.col("is_target_available_7d") == 1)
        )
        return risk.score_inventory(rows)

    @cached_property
    def supplier_rows(self) -> DataFrame:
        return risk.late_label(splits.with_split(self.supplier_features, "order_date", TRAIN_END, VAL_END))

    @cached_property
    def supplier_model_rows(self) -> DataFrame:
        """What the classifiers learn from and what is read of their scores, written once."""
        names = ["po_id", "order_date", "supplier_id", "split", "target_supplier_late", *splits.SUPPLIER_FEATURES, *risk.PROFILE_COLUMNS]
        rows = self.supplier_rows
        return staged(rows.select(*[c for c in rows.columns if c in names]), "supplier_model_rows")

    @cached_property
    def scored_suppliers(self) -> DataFrame:
        return risk.score_suppliers(self.supplier_rows.filter(F.col("split") == splits.TEST))

    @staged_property
    def supplier_profile(self) -> DataFrame:
        return risk.latest_supplier_profile(self.scored_suppliers)

    @staged_property
    def exposure(self) -> DataFrame:
        layer = risk.exposure_layer(self.scored_inventory, self.supplier_profile, self.star.dim_product)
        return risk.with_explanations(layer)

    @cached_property
    def snapshot(self) -> DataFrame:
        return risk.latest_snapshot(self.exposure)

    @staged_property
    def rule_scores(self) -> DataFrame:
        """(domain, label, score) of both rule baselines on validation rows."""
        stock = self.inventory_rows.filter(
            (F.col("split") == splits.VALIDATION) & (F.col("is_target_available_7d") == 1)
        ).select(
            F.lit("inventory").alias("domain"),
            F.col("target_stockout_within_7d").alias("label"),
            half_even(risk.stockout_rule(), 4).alias("score"),
        )
        late = self.supplier_rows.filter(F.col("split") == splits.VALIDATION).select(
            F.lit("supplier").alias("domain"),
            F.col("target_supplier_late").alias("label"),
            half_even(risk.supplier_rule(), 4).alias("score"),
        )
        return stock.unionByName(late)

    # ---------------------------------------------------------- served models
    @cached_property
    def registry(self) -> served.Registry:
        return served.Registry(self.spark, f"{shared_dir(self.spark)}/models-{uuid.uuid4().hex}")

    @cached_property
    def stockout_model(self):
        """The chosen stockout classifier: fitted, published and loaded again."""
        known = self.inventory_rows.filter((F.col("is_target_available_7d") == 1) & (F.col("has_sufficient_history_28d") == 1))
        rows = models.risk_rows(known, splits.INVENTORY_FEATURES, "target_stockout_within_7d", splits.FORBIDDEN_INVENTORY, SERIES_KEY)
        numeric = [c for c in splits.INVENTORY_FEATURES if c not in splits.INVENTORY_CATEGORICAL]
        chosen = served.choose(rows, numeric, splits.INVENTORY_CATEGORICAL, SERIES_KEY, models.INVENTORY_SETTINGS)
        self.registry.publish("stockout", chosen)
        return self.registry.load("stockout")

    @cached_property
    def lateness_model(self):
        """The chosen supplier classifier: fitted, published and loaded again."""
        rows = models.risk_rows(self.supplier_model_rows, splits.SUPPLIER_FEATURES, "target_supplier_late", splits.FORBIDDEN_SUPPLIER, ["po_id"])
        numeric = [c for c in splits.SUPPLIER_FEATURES if c not in splits.SUPPLIER_CATEGORICAL]
        chosen = served.choose(rows, numeric, splits.SUPPLIER_CATEGORICAL, ["po_id"], models.SUPPLIER_SETTINGS)
        self.registry.publish("lateness", chosen)
        return self.registry.load("lateness")

    @staged_property
    def model_scored_inventory(self) -> DataFrame:
        """Every inventory row, scored by the served model."""
        rows = served.score(self.inventory_rows, self.stockout_model, "probability")
        return risk.score_inventory(rows, F.col("probability")).drop("probability")

    @staged_property
    def model_scored_suppliers(self) -> DataFrame:
        """Every order row, scored by the served model."""
        rows = served.score(self.supplier_model_rows, self.lateness_model, "probability")
        return risk.score_suppliers(rows, F.col("probability")).drop("probability")

    @staged_property
    def model_exposure(self) -> DataFrame:
        """The exposure layer on served scores, for the rows that ``exposure`` has."""
        test = self.model_scored_inventory.filter((F.col("split") == splits.TEST) & (F.col("is_target_available_7d") == 1))
        profile = risk.latest_supplier_profile(self.model_scored_suppliers.filter(F.col("split") == splits.TEST))
        return risk.with_explanations(risk.exposure_layer(test, profile, self.star.dim_product))

    # ---------------------------------------------------------------- policy
    @staged_property
    def positions(self) -> DataFrame:
        """Positions of the latest scored day, as the policies read them."""
        return risk.latest_snapshot(self.exposure).select(
            "product_id",
            "warehouse_id",
            "criticality",
            "forecast_demand_7d",
            "ending_inventory_lag1",
            "safety_stock_target",
            "stockout_probability_7d",
            "supplier_delay_probability",
        )

    @cached_property
    def dims(self) -> dict[str, DataFrame]:
        s = self.star
        return {"dim_product": s.dim_product, "dim_supplier": s.dim_supplier, "dim_warehouse": s.dim_warehouse}

    @staged_property
    def scenario_positions(self) -> DataFrame:
        return policy.apply_scenarios(self.positions, policy.standard_scenarios(self.spark))

    @staged_property
    def baseline(self) -> DataFrame:
        s = self.star
        return policy.baseline_plan(self.scenario_positions, s.dim_product, s.dim_supplier, s.dim_warehouse)

    @cached_property
    def plan(self) -> dict[str, DataFrame]:
        """Decision tables of the coordinated policy, each written once."""
        return policy.coordinated_plan(self.scenario_positions, self.dims, keep=staged)

    @cached_property
    def baseline_totals(self) -> DataFrame:
        return policy.baseline_totals(self.baseline)

    @cached_property
    def plan_totals(self) -> DataFrame:
        p = self.plan
        return policy.coordinated_totals(p["flows"], p["transfers"], p["orders"])

    # --------------------------------------------------------------- quality
    @property
    def raw_orders(self) -> DataFrame:
        """Purchase orders as given: every order line under its own id."""
        return self.star.fact_purchase_orders

    @property
    def raw_demand(self) -> DataFrame:
        """Demand as given."""
        return self.star.fact_demand

    @property
    def raw_inventory(self) -> DataFrame:
        return self.star.ledger

    @property
    def raw_transport(self) -> DataFrame:
        return self.star.fact_transport

    @cached_property
    def given_tables(self) -> dict[str, DataFrame]:
        """All ten tables before cleaning."""
        own = {
            "fact_demand": self.raw_demand,
            "fact_purchase_orders": self.raw_orders,
            "fact_inventory": self.raw_inventory,
            "fact_transport": self.raw_transport,
        }
        return self.star.tables() | own

    @staged_property
    def found_issues(self) -> DataFrame:
        return _issues(self, self.given_tables)

    @staged_property
    def issues_left(self) -> DataFrame:
        """What the audit finds after cleaning."""
        return _issues(self, self.cleaned_tables[0])

    @cached_property
    def cleaned_demand(self) -> cleaning.Cleaned:
        """Kept rows, quarantine and action counts are separate reads of one written table."""
        return cleaning.clean_demand(self.raw_demand, self.star.dim_product, self.star.dim_date)

    @property
    def order_rank(self) -> list[str]:
        """Which of two conflicting rows of one po_id came first: by date, then by all other columns."""
        return ["order_date", *(c for c in self.raw_orders.columns if c not in ("po_id", "order_date"))]

    @cached_property
    def cleaned_orders(self) -> cleaning.Cleaned:
        return cleaning.clean_purchase_orders(
            self.raw_orders, self.star.dim_supplier, self.star.dim_product, self.order_rank
        )

    @cached_property
    def cleaned_tables(self) -> tuple[dict[str, DataFrame], dict[str, cleaning.Cleaned]]:
        """All ten tables after cleaning, and the details of each fact."""
        given = self.given_tables
        stock = cleaning.clean_inventory(given["fact_inventory"], given["dim_product"])
        orders = self.cleaned_orders
        transport = cleaning.clean_transport(given["fact_transport"], orders.rows)
        details = {c.table: c for c in (self.cleaned_demand, orders, stock, transport)}
        return given | {name: c.rows for name, c in details.items()}, details


QUERIES: dict[str, Callable[[View], DataFrame]] = {}


def query(fn: Callable[[View], DataFrame]) -> Callable[[View], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


# ---------------------------------------------------------------------- rollups
@query
def daily_demand_rollup(v: View) -> DataFrame:
    return v.daily_demand


@query
def inventory_health(v: View) -> DataFrame:
    return v.inventory_health


@query
def supplier_monthly(v: View) -> DataFrame:
    return v.supplier_performance


@query
def warehouse_daily(v: View) -> DataFrame:
    return v.warehouse_operations


@query
def cost_summary(v: View) -> DataFrame:
    return v.cost_summary


@query
def product_supply_risk(v: View) -> DataFrame:
    s = v.star
    return rollups.product_supply_risk(s.ledger, s.dim_product, s.dim_warehouse, s.dim_supplier)


# ---------------------------------------------------------------------- queries
@query
def inventory_turnover(v: View) -> DataFrame:
    return q.inventory_turnover(v.star.ledger, v.star.dim_product, v.star.dim_warehouse)


@query
def supplier_otif(v: View) -> DataFrame:
    return q.supplier_otif(v.star.fact_purchase_orders, v.star.dim_supplier)


@query
def service_level_by_category(v: View) -> DataFrame:
    return q.service_level_by_category(v.star.ledger, v.star.dim_product)


@query
def warehouse_cost_breakdown(v: View) -> DataFrame:
    return q.warehouse_cost_breakdown(v.star.ledger, v.star.fact_purchase_orders, v.star.dim_warehouse)


@query
def executive_kpis(v: View) -> DataFrame:
    s = v.star
    dims = {
        "products": s.dim_product, "suppliers": s.dim_supplier, "warehouses": s.dim_warehouse, "markets": s.dim_market,
    }
    nested = q.executive_kpis(v.cost_summary, v.daily_demand, s.ledger, v.supplier_performance, dims)
    return nested.select("entity_counts.*", "financials.*", "operations.*", "procurement.*")


@query
def category_performance(v: View) -> DataFrame:
    return q.category_performance(v.star.ledger, v.star.dim_product)


@query
def monthly_cost(v: View) -> DataFrame:
    return q.monthly_cost(v.cost_summary)


@query
def monthly_cost_one_warehouse(v: View) -> DataFrame:
    return q.monthly_cost(v.cost_summary, warehouse_id="WH-2")


@query
def supplier_scorecard(v: View) -> DataFrame:
    return q.supplier_scorecard(v.supplier_performance, v.star.fact_purchase_orders, v.star.dim_supplier)


@query
def warehouse_capacity(v: View) -> DataFrame:
    return q.warehouse_capacity(v.warehouse_operations)


@query
def demand_volatility_hhi(v: View) -> DataFrame:
    return q.demand_volatility_hhi(v.daily_demand, v.star.fact_demand, v.star.dim_product)


@query
def stockout_durations(v: View) -> DataFrame:
    return q.stockout_durations(v.star.ledger)


@query
def kpi_by_warehouse(v: View) -> DataFrame:
    """Every ledger KPI of the registry at warehouse grain."""
    s = v.star
    prices = s.dim_product.select("product_id", "unit_cost", "selling_price")
    places = s.dim_warehouse.select("warehouse_id", "capacity_units")
    rows = s.ledger.join(prices, "product_id").join(places, "warehouse_id")
    return rows.groupBy("warehouse_id").agg(
        kpis.unit_fill().alias("unit_fill"),
        kpis.stockout_frequency().alias("stockout_frequency"),
        kpis.lost_sales_rate().alias("lost_sales_rate"),
        kpis.annual_turnover(F.countDistinct("date").cast("double")).alias("annual_turnover"),
        F.round(kpis.holding_cost(), 4).alias("holding_cost"),
        kpis.stockout_penalty().alias("stockout_penalty"),
        kpis.capacity_utilisation().alias("capacity_utilisation"),
        half_even(kpis.demand_cv(), 6).alias("demand_cv"),
    )


@query
def kpi_by_tier(v: View) -> DataFrame:
    """Every purchase-order KPI at supplier-tier grain."""
    rows = v.star.fact_purchase_orders.join(v.star.dim_supplier.select("supplier_id", "tier"), "supplier_id")
    return rows.groupBy("tier").agg(
        kpis.on_time_rate().alias("on_time_rate"),
        kpis.otif_rate().alias("otif_rate"),
        kpis.mean_delay().alias("mean_delay"),
        kpis.delay_percentile(0.9).alias("p90_delay"),
        kpis.delay_percentile(0.95).alias("p95_delay"),
        kpis.procurement_cost().alias("procurement_cost"),
        kpis.freight_cost().alias("freight_cost"),
    )


@query
def coverage_kpis(v: View) -> DataFrame:
    """Row-level coverage KPIs on the feature table."""
    return v.inventory_features.select(
        *SERIES_KEY,
        kpis.days_of_coverage("ending_inventory", "demand_mean_28").alias("days_of_coverage"),
        kpis.safety_stock_coverage().alias("safety_stock_coverage"),
        risk.buffer_deficiency("beginning_inventory", "safety_stock_target").alias("buffer_deficiency"),
    )


# ----------------------------------------------------------------- reconciliation
@query
def reconcile_all(v: View) -> DataFrame:
    return reconcile.reconcile_all(v.star, v.stored_rollups)


@query
def reconciliation_verdict(v: View) -> DataFrame:
    """Whether every check of one build holds, those across the cleaning included."""
    cross = [cross_stage_demand(v), cross_stage_cost(v)]
    return reconcile.all_passed(reconcile.reconcile_all(v.star, v.stored_rollups, cross))


@query
def fanout_audit(v: View) -> DataFrame:
    return reconcile.fanout_audit(v.star.ledger, v.star.fact_purchase_orders, v.cost_summary)


@query
def cross_stage_demand(v: View) -> DataFrame:
    """Raw units = clean + quarantined + units the clamp took away."""
    c = v.cleaned_demand
    quarantined = c.quarantine.withColumn("demand_requested", F.col("demand_requested") * F.col("copies"))
    return reconcile.cross_stage_demand(v.raw_demand, c.rows, quarantined, c.repaired_units)


@query
def cross_stage_cost(v: View) -> DataFrame:
    """Raw cost = clean + quarantined - what the price repairs added, over all orders."""
    c = v.cleaned_orders
    costs = ("total_procurement_cost", "transport_cost")
    quarantined = c.quarantine.withColumns({x: F.col(x) * F.col("copies") for x in costs})
    out = reconcile.cross_stage_cost(v.raw_orders, c.rows, quarantined, c.repaired_cost)
    return out.select(*[half_even(x, 2).alias(x) if t == "double" else F.col(x) for x, t in out.dtypes])


@query
def table_counts(v: View) -> DataFrame:
    s = v.star
    tables = s.tables() | {"fact_inventory": s.ledger}
    return io.row_counts(tables)


@query
def foreign_keys(v: View) -> DataFrame:
    return quality.foreign_key_check(v.star.tables() | {"fact_inventory": v.star.ledger})


@query
def declared_keys(v: View) -> DataFrame:
    return quality.declared_key_check(v.star.tables() | {"fact_inventory": v.star.ledger})


@query
def table_profile(v: View) -> DataFrame:
    return quality.profile_all(v.given_tables | {"fact_inventory": v.star.fact_inventory})


@query
def recent_slice_counts(v: View) -> DataFrame:
    s = v.star
    tables = s.tables() | {"fact_inventory": s.ledger, "analytics_daily_demand": v.daily_demand}
    return io.row_counts(io.recent_slice(tables, RECENT_CUTOFF))


# ------------------------------------------------------------------ series, grids
@query
def date_dimension(v: View) -> DataFrame:
    return v.star.dim_date


@query
def dense_demand_grid(v: View) -> DataFrame:
    return v.grid.drop("product_name", "warehouse_name")


@query
def event_overlay(v: View) -> DataFrame:
    return series.with_events(v.star.dim_date.select("date"), v.star.event_rows)


@query
def ledger_rows(v: View) -> DataFrame:
    return v.star.ledger


@query
def warehouse_load(v: View) -> DataFrame:
    return v.star.fact_inventory.select(
        *SERIES_KEY, "total_warehouse_inventory", "warehouse_capacity", "capacity_utilization_pct"
    )


@query
def safety_stock(v: View) -> DataFrame:
    return ledger.stock_policy(v.star.daily_flows, v.star.policy_terms)


@query
def stockout_episodes(v: View) -> DataFrame:
    return series.episodes(v.star.ledger, "stockout_flag").drop("streak_id")


# ------------------------------------------------------------------------ features
@query
def demand_lags(v: View) -> DataFrame:
    return v.grid.withColumns(fd.lag_columns()).select(*SERIES_KEY, *fd.lag_columns())


@query
def demand_rolling(v: View) -> DataFrame:
    return v.grid.withColumns(fd.rolling_columns()).select(*SERIES_KEY, *fd.rolling_columns())


@query
def demand_dynamics(v: View) -> DataFrame:
    wide = v.grid.withColumns(fd.lag_columns() | fd.rolling_columns()).withColumns(fd.dynamics_columns())
    return wide.select(*SERIES_KEY, *fd.dynamics_columns())


@query
def demand_targets(v: View) -> DataFrame:
    start = v.star.dim_date.agg(F.min("date")).scalar()
    wide = v.grid.withColumns(fd.target_columns())
    return wide.withColumns(fd.availability_columns(start)).select(
        *SERIES_KEY, *fd.target_columns(), *fd.availability_columns(start)
    )


@query
def demand_feature_table(v: View) -> DataFrame:
    return v.demand_features


@query
def sparse_demand_features(v: View) -> DataFrame:
    wide = fd.sparse_demand_features(v.daily_demand)
    return wide.select(
        *[half_even(c, 6).alias(c) if c.startswith("rolling_") else F.col(c) for c in wide.columns]
    )


@query
def inventory_buffer(v: View) -> DataFrame:
    names = [
        "ending_inventory_lag1", "ending_inventory_lag2", "inventory_change_1d", "safety_stock_gap",
        "inventory_to_safety_stock_ratio", "demand_mean_7", "demand_mean_28", "demand_std_28", "demand_trend_28",
        "inventory_days_of_supply",
    ]
    return v.inventory_features.select(*SERIES_KEY, *names)


@query
def stockout_history(v: View) -> DataFrame:
    names = [
        "stockout_lag_1", "stockout_count_7d", "stockout_count_28d", "stockout_rate_28d", "consecutive_stockout_days",
        "lost_sales_7d", "lost_sales_28d", "lost_sales_rate_28d", "ending_backorder_lag1", "backorder_count_7d",
        "backorder_count_28d",
    ]
    return v.inventory_features.select(*SERIES_KEY, *names)


@query
def warehouse_pressure(v: View) -> DataFrame:
    names = [
        "warehouse_total_inv_lag1", "warehouse_capacity_utilization_lag1", "warehouse_utilization_7d",
        "warehouse_inventory_share",
    ]
    return v.inventory_features.select(*SERIES_KEY, *names)


@query
def inventory_targets(v: View) -> DataFrame:
    names = [
        "target_stockout_t_plus_1", "target_stockout_within_7d", "target_stockout_within_14d", "target_lost_sales_7d",
        "has_sufficient_history_28d", "is_target_available_7d", "is_target_available_14d",
    ]
    return v.inventory_features.select(*SERIES_KEY, *names)


SUPPLIER_HISTORY = (
    "hist_order_count", "hist_order_volume", "hist_on_time_rate", "hist_otif_rate", "hist_fill_rate",
    "hist_mean_delay", "hist_std_delay", "hist_p90_delay", "hist_p95_delay", "days_since_last_delivery",
    "is_cold_start",
)


@query
def supplier_history(v: View) -> DataFrame:
    return v.supplier_features.select("po_id", *SUPPLIER_HISTORY)


@query
def supplier_recent(v: View) -> DataFrame:
    return v.supplier_features.select("po_id", "recent_delay_30d", "recent_otif_30d", "recent_otif_90d", "delay_trend")


@query
def supplier_inflight(v: View) -> DataFrame:
    return v.supplier_features.select(
        "po_id",
        "supplier_active_orders_count",
        "supplier_active_volume",
        "supplier_capacity_pressure",
        *fs.calendar_feature_columns(),
        *fs.target_columns(),
    )


@query
def sku_cost_history(v: View) -> DataFrame:
    return fs.with_cost_history(v.order_base).select(
        "po_id",
        half_even("hist_sku_unit_cost_mean", 6).alias("hist_sku_unit_cost_mean"),
        half_even("hist_sku_unit_cost_std", 4).alias("hist_sku_unit_cost_std"),
    )


@query
def split_bounds(v: View) -> DataFrame:
    return splits.split_bounds(v.series_rows)


# -------------------------------------------------------------------- data quality
def _issues(v: View, tables: dict[str, DataFrame]) -> DataFrame:
    span = v.star.dim_date.agg(F.count(F.lit(1))).scalar()
    return audit.audit(tables, years=(1995, 2001), expected_days=span)


@query
def dq_issues(v: View) -> DataFrame:
    return v.found_issues.drop("samples", "action_suggested")


@query
def dq_samples(v: View) -> DataFrame:
    """Every broken rule with its five smallest row keys."""
    samples = F.concat_ws(",", "samples").alias("samples")
    return v.found_issues.select("rule_id", "table_name", "column_name", "row_count", samples)


@query
def dq_outliers(v: View) -> DataFrame:
    return quality.check_outliers(v.star.fact_demand, "fact_demand", "demand_requested", "product_id", 1.7).drop(
        "samples", "action_suggested"
    )


@query
def dq_continuity(v: View) -> DataFrame:
    span = v.star.dim_date.agg(F.count(F.lit(1))).scalar()
    return quality.check_continuity(
        v.star.fact_demand, "fact_demand", ["product_id", "warehouse_id"], "date", span
    ).drop("samples", "action_suggested")


@query
def clean_demand(v: View) -> DataFrame:
    return v.cleaned_demand.rows


@query
def clean_po(v: View) -> DataFrame:
    return v.cleaned_orders.rows


@query
def audit_trail(v: View) -> DataFrame:
    return cleaning.audit_trail(v.cleaned_tables[1])


@query
def severity_before_after(v: View) -> DataFrame:
    return quality.severity_totals(v.found_issues, v.issues_left)


@query
def quality_verdict(v: View) -> DataFrame:
    """Whether errors are left after cleaning."""
    return quality.verdict(v.issues_left)


@query
def profile_comparison(v: View) -> DataFrame:
    """Profile of every table before and after cleaning."""
    return quality.compare_profiles(quality.profile_all(v.given_tables), quality.profile_all(v.cleaned_tables[0]))


@query
def cleaning_summary(v: View) -> DataFrame:
    after, details = v.cleaned_tables
    return cleaning.cleaning_summary(v.given_tables, after, cleaning.audit_trail(details))


# ------------------------------------------------------------------------- leakage
@query
def leakage_demand(v: View) -> DataFrame:
    start = v.star.dim_date.agg(F.min("date")).scalar()
    return leakage.demand_leakage(
        lambda d: fd.demand_features(d, v.star.event_rows, HOLIDAYS, start), v.grid, LEAK_CUTOFF
    )


@query
def feature_summary(v: View) -> DataFrame:
    """Rows, columns and leakage verdict of each feature table."""
    tables = {"demand": v.demand_features, "inventory": v.inventory_features, "supplier": v.supplier_features}
    sizes = [
        df.agg(F.lit(name).alias("domain"), F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"))
        for name, df in tables.items()
    ]
    verdicts = reduce(DataFrame.unionByName, [leakage_demand(v), leakage_inventory(v), leakage_supplier(v)])
    return reduce(DataFrame.unionByName, sizes).join(verdicts.select("domain", "is_leakage_free"), "domain")


@query
def leakage_detected(v: View) -> DataFrame:
    """A builder that looks a day ahead, which the check has to find."""
    tomorrow = series.lead("demand_requested", 1).alias("next_day")
    return leakage.demand_leakage(lambda d: d.select(*SERIES_KEY, tomorrow), v.grid, LEAK_CUTOFF)


@query
def leakage_inventory(v: View) -> DataFrame:
    start = v.star.dim_date.agg(F.min("date")).scalar()
    return leakage.inventory_leakage(lambda d: fi.inventory_features(d, start=start), v.ledger_base, LEAK_CUTOFF)


@query
def leakage_supplier(v: View) -> DataFrame:
    # Dealt here, the orders are shuffled once for both builds.
    base = v.order_base if v.busy_suppliers else v.order_base.repartition("supplier_id")
    return leakage.supplier_leakage(lambda orders: fs.order_features(orders, v.busy_suppliers), base, LEAK_CUTOFF, v.order_base)


@query
def leakage_rollup(v: View) -> DataFrame:
    return leakage.rollup_leakage(fd.sparse_demand_features, v.daily_demand, LEAK_CUTOFF)


@query
def lag_alignment(v: View) -> DataFrame:
    return leakage.lag_alignment(
        v.grid.withColumns(fd.lag_columns((1,))), ["product_id", "warehouse_id"], "demand_requested", "demand_lag_1"
    )


# ----------------------------------------------------------------------- forecasts
@query
def seasonal_naive(v: View) -> DataFrame:
    rows = v.baseline_forecasts.filter((F.col("model") == "Seasonal Naive") & (F.col("split") == splits.TEST))
    return rows.select(*SERIES_KEY, "horizon", "actual", "forecast")


@query
def moving_average(v: View) -> DataFrame:
    rows = v.baseline_forecasts.filter(F.col("model").startswith("Moving Average") & (F.col("split") == splits.TEST))
    return rows.select(*SERIES_KEY, "horizon", "model", half_even("forecast", 6).alias("forecast"))


@query
def forecast_metrics(v: View) -> DataFrame:
    return v.validation_metrics


@query
def best_model(v: View) -> DataFrame:
    return evaluate.best_model(v.validation_metrics)


@query
def prediction_intervals(v: View) -> DataFrame:
    return v.intervals.select("horizon", *[half_even(c, 6).alias(c) for c in ("q_lower", "q_upper")])


@query
def forecast_table(v: View) -> DataFrame:
    return v.forecast_output


@query
def interval_coverage(v: View) -> DataFrame:
    test = v.selected_forecasts.filter(F.col("split") == splits.TEST)
    return evaluate.interval_coverage(evaluate.with_intervals(test, v.intervals, ["horizon"]), ["horizon"])


@query
def residual_summary(v: View) -> DataFrame:
    return evaluate.residual_summary(v.forecast_output)


@query
def residual_breakdown(v: View) -> DataFrame:
    one = v.forecast_output.filter(F.col("horizon") == "t+1").withColumnRenamed("actual_demand", "actual")
    by_place = evaluate.residual_breakdown(one, ["warehouse_id"]).select(
        F.lit("warehouse").alias("dimension"), F.col("warehouse_id").alias("member"), "wape", "mae", "bias"
    )
    by_category = evaluate.residual_breakdown(one, ["category"]).select(
        F.lit("category").alias("dimension"), F.col("category").alias("member"), "wape", "mae", "bias"
    )
    return by_place.unionByName(by_category)


# ---------------------------------------------------------------------------- risk
@query
def risk_metrics(v: View) -> DataFrame:
    return evaluate.confusion_metrics(v.rule_scores, ["domain"])


@query
def auc_ap(v: View) -> DataFrame:
    return evaluate.ranking_metrics(v.rule_scores, ["domain"]).select("domain", "roc_auc", "pr_auc")


@query
def topk_capture(v: View) -> DataFrame:
    return evaluate.ranking_metrics(v.rule_scores, ["domain"]).drop("roc_auc", "pr_auc")


@query
def calibration_bins(v: View) -> DataFrame:
    curve = evaluate.reliability_curve(v.rule_scores, ["domain"])
    return curve.select("domain", "bin", "n", *[half_even(c, 8).alias(c) for c in ("prob_true", "prob_pred")])


@query
def inventory_risk_score(v: View) -> DataFrame:
    return v.scored_inventory.select(
        *SERIES_KEY, "stockout_probability_7d", "inventory_risk_score", "inventory_risk_band"
    )


@query
def supplier_risk_score(v: View) -> DataFrame:
    return v.scored_suppliers.select("po_id", "supplier_delay_probability", "supplier_risk_score", "supplier_risk_band")


@query
def latest_supplier_profile(v: View) -> DataFrame:
    return v.supplier_profile


@query
def operational_exposure(v: View) -> DataFrame:
    return v.exposure.select(
        *SERIES_KEY,
        "primary_supplier_id",
        "supplier_risk_score",
        "inventory_risk_score",
        "operational_exposure_score",
        "operational_exposure_band",
        "projected_exposure_quantity",
        "projected_exposure_cost",
        risk.supplier_vulnerability("supplier_delay_probability", "criticality").alias("supplier_vulnerability"),
        half_even(
            risk.expected_exposure("stockout_probability_7d", "unit_cost", ratio("forecast_demand_7d", F.lit(7))), 4
        ).alias("expected_exposure"),
    )


@query
def risk_explanations(v: View) -> DataFrame:
    return v.exposure.select(*SERIES_KEY, "explanation_summary", "recommended_action", "evidence_bullets")


@query
def risk_snapshot(v: View) -> DataFrame:
    out = risk.risk_snapshot(v.exposure, v.supplier_profile)
    return out.select(*[half_even(c, 4).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query
def supplier_display(v: View) -> DataFrame:
    return risk.supplier_display(v.supplier_profile)


@query
def worst_position(v: View) -> DataFrame:
    """The riskiest position of the snapshot, looked up as a drill-down does."""
    order = [F.desc("operational_exposure_score"), "product_id", "warehouse_id"]
    worst = v.snapshot.orderBy(*order).limit(1).select("product_id", "warehouse_id").first()
    row = risk.drill_down(v.snapshot, worst["product_id"], worst["warehouse_id"])
    return row.select("date", "product_id", "warehouse_id", "operational_exposure_score", F.size("evidence_items").alias("n_evidence"))


@query
def exposure_matrix(v: View) -> DataFrame:
    places = v.star.dim_warehouse.select("warehouse_id").orderBy("warehouse_id").collect()  # one column for each
    return risk.exposure_matrix(v.snapshot, [row.warehouse_id for row in places])


@query
def exposure_bands(v: View) -> DataFrame:
    out = risk.band_counts(v.exposure)
    return out.withColumn("exposure_cost", half_even("exposure_cost", 2))


@query
def band_crosstab(v: View) -> DataFrame:
    return risk.band_crosstab(v.snapshot)


@query
def probability_histogram(v: View) -> DataFrame:
    return risk.probability_histogram(v.exposure)


@query
def investigation_queue(v: View) -> DataFrame:
    return risk.investigation_queue(v.snapshot, bands=("CRITICAL", "HIGH", "MEDIUM")).drop(
        "explanation_summary", "recommended_action"
    )


# -------------------------------------------------------------------------- policy
def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Sums of scenario-scaled doubles depend on the order of addition in the
    last bits; results are compared at ``digits`` decimals."""
    return df.select(*[half_even(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query
def decision_positions(v: View) -> DataFrame:
    return v.positions


@query
def baseline_policy(v: View) -> DataFrame:
    return _rounded(
        v.baseline.select(
            *policy.POSITION_KEY, "supplier_id", "order_quantity", "fulfilled_quantity", "shortage_quantity",
            "ending_inventory", "procurement_cost", "transport_cost", "risk_cost", "shortage_cost", "holding_cost",
        )
    )


@query
def baseline_policy_totals(v: View) -> DataFrame:
    return v.baseline_totals


@query
def scenario_sweep(v: View) -> DataFrame:
    return policy.scenario_summary(v.baseline_totals, v.plan_totals)


@query
def lane_costs(v: View) -> DataFrame:
    return _rounded(policy.order_lanes(**v.dims))


@query
def transfer_lane_costs(v: View) -> DataFrame:
    return policy.transfer_lanes(v.star.dim_product, v.star.dim_warehouse)


@query
def lateral_rebalance(v: View) -> DataFrame:
    return _rounded(v.plan["transfers"])


@query
def order_split(v: View) -> DataFrame:
    return _rounded(v.plan["orders"])


@query
def plan_flows(v: View) -> DataFrame:
    return _rounded(v.plan["flows"])


@query
def plan_audit(v: View) -> DataFrame:
    p = v.plan
    s = v.star
    rows = policy.plan_audit(
        v.scenario_positions, p["flows"], p["transfers"], p["orders"], s.dim_supplier, s.dim_warehouse, s.dim_product
    )
    out = _rounded(rows.drop("is_binding")).withColumn("is_binding", F.abs("slack") < policy.BINDING)
    return out.withColumn("is_violated", F.when(F.col("constraint_type") == "EQUALITY", F.abs("slack") > 0.001).otherwise(F.col("slack") < -0.001))


@query
def policy_waterfall(v: View) -> DataFrame:
    return policy.cost_waterfall(v.baseline_totals, v.plan_totals)


@query
def sourcing_shares(v: View) -> DataFrame:
    return policy.sourcing_shares(v.baseline, v.plan["orders"])


@query
def sourcing_hhi(v: View) -> DataFrame:
    return policy.sourcing_hhi(v.baseline, v.plan["orders"])


@query
def warehouse_policy_comparison(v: View) -> DataFrame:
    return policy.warehouse_comparison(v.baseline, v.plan["flows"])


@query
def sensitivity_sweep(v: View) -> DataFrame:
    """All freight, share and service sweeps in one job."""
    table = policy.sweep_scenarios(v.spark)
    swept = policy.apply_scenarios(v.positions, table)
    plan = policy.coordinated_plan(swept, v.dims, keep=staged)
    totals = policy.coordinated_totals(plan["flows"], plan["transfers"], plan["orders"])
    labels = table.select("scenario_name", "sweep", "sweep_value")
    return totals.join(labels, "scenario_name")


@query
def transfer_explanations(v: View) -> DataFrame:
    p = v.plan["transfers"].filter(F.col("scenario_name") == "baseline")
    return policy.explain_transfers(p, v.star.dim_product, v.star.dim_warehouse)


@query
def dual_sourcing_explanations(v: View) -> DataFrame:
    p = v.plan["orders"].filter(F.col("scenario_name") == "baseline")
    return policy.explain_dual_sourcing(p, v.star.dim_product, v.star.dim_supplier)


@query
def plan_narrative(v: View) -> DataFrame:
    return policy.narrative(v.plan_totals, v.baseline_totals, v.plan["transfers"])


@query
def decision_log(v: View) -> DataFrame:
    p = v.plan
    return _rounded(policy.decision_rows(p["flows"], p["transfers"], p["orders"], "RUN-1"))


# -------------------------------------------------------------------- stores and logs
@query
def run_logs(v: View) -> DataFrame:
    """Decision, comparison and explanation logs of two runs, one of them appended twice: rows by log and run."""
    folder = f"{shared_dir(v.spark)}/logs-{uuid.uuid4().hex}"
    logs = {"decisions": decision_log(v), "comparisons": warehouse_policy_comparison(v), "explanations": transfer_explanations(v)}
    parts = []
    for name, df in logs.items():
        kept = staged(df, f"log_{name}")
        for run_id in ("RUN-1", "RUN-2", "RUN-1"):
            versioned.append_once(kept, f"{folder}/{name}", run_id)
        log = versioned.read_log(v.spark, f"{folder}/{name}", kept.schema)
        counted = log.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_rows"))
        parts.append(counted.select(F.lit(name).alias("log_name"), "run_id", "n_rows"))
    return reduce(DataFrame.unionByName, parts)


@query
def upserted_orders(v: View) -> DataFrame:
    """Purchase orders written by one upsert, of which two later ones from the same version change different rows."""
    columns = ["po_id", "order_date", "quantity_ordered", "status"]
    orders = staged(v.star.narrow("fact_purchase_orders").select(*columns), "upserted_orders")
    table = versioned.VersionedTable(v.spark, f"{shared_dir(v.spark)}/orders-{uuid.uuid4().hex}", ["po_id"])
    base = table.upsert(orders)
    closed = orders.filter("quantity_ordered % 5 = 0").withColumn("status", F.lit("Closed"))
    added = orders.filter("quantity_ordered % 5 = 1").withColumn("po_id", F.concat("po_id", F.lit("-B")))
    late = table.prepare(added, base)
    table.upsert(closed)
    try:
        table.commit(late)
    except CommitConflict:  # the other writer was first
        table.upsert(added)
    return table.read()


@query
def slice_rows(v: View) -> DataFrame:
    """Orders and shipments of the recent slice, read back from its files from a later day on."""
    s = v.star
    folder = f"{shared_dir(v.spark)}/slice-{uuid.uuid4().hex}"
    tables = {"fact_purchase_orders": s.fact_purchase_orders, "fact_transport": s.fact_transport}
    io.write_slice(io.recent_slice(tables, RECENT_CUTOFF), folder)
    orders = io.read_slice(v.spark, folder, "fact_purchase_orders", LATER_CUTOFF).select("po_id", "order_date", "quantity_ordered")
    moves = io.read_slice(v.spark, folder, "fact_transport").select("po_id", "transport_id", "transport_mode")
    return orders.join(moves, "po_id", "left")


@query
def csv_round_trip(v: View) -> DataFrame:
    """All ten tables written as CSV, two of them with broken lines added, and read back with checks."""
    folder = f"{shared_dir(v.spark)}/csv-{uuid.uuid4().hex}"
    broken = {
        "fact_demand": (F.col("demand_requested") == 13, "demand_requested"),
        "fact_purchase_orders": (F.col("quantity_ordered") == 11, "order_date"),
    }
    parts = []
    for name in SPECS:
        df = v.given_tables[name] if name != "fact_inventory" else v.star.fact_inventory
        io.write_csv(df.select(*SPECS[name].schema.names), f"{folder}/{name}.csv", compression="gzip")
        if name in broken:
            where, column = broken[name]
            lines = df.filter(where).select(*[F.concat(F.lit("x"), F.col(c).cast("string")).alias(c) if c == column else F.col(c) for c in SPECS[name].schema.names])
            io.write_csv(lines, f"{folder}/{name}.csv", mode="append", compression="gzip")
        good, bad = io.read_csv_checked(v.spark, f"{folder}/{name}.csv", name)
        rejected = bad.agg(F.count(F.lit(1))).scalar()
        written, back = (_content(x.select(*SPECS[name].schema.names)) for x in (df, good))
        parts.append(
            good.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows_read"), rejected.alias("lines_rejected"), (written == back).alias("equal"))
        )
    return reduce(DataFrame.unionByName, parts)


def _content(df: DataFrame) -> Column:
    """A number that equal sets of rows share: the sum of row hashes."""
    return df.agg(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).scalar()


# ---------------------------------------------------------------------- part grain
@query
def part_demand_features(v: View) -> DataFrame:
    """Lags and rolling measures of every part and warehouse, on its days with demand."""
    return ragged.demand_features(v.star.part_demand)


@query
def part_ledger(v: View) -> DataFrame:
    """Stock of every part and warehouse after each day with a movement."""
    return v.part_stock


@query
def part_stock_summary(v: View) -> DataFrame:
    """Span, mean stock, empty days and unmet units of every part and warehouse."""
    return ragged.stock_summary(v.part_stock)


# ------------------------------------------------------------------- learned models
# Regressors and classifiers are fitted on all training rows; validation and test
# rows are all used. Rounds, depths and configurations are the published ones.
@query
def ridge_forecast(v: View) -> DataFrame:
    """Test forecasts of the ridge model with the best strength, at every horizon."""
    made = reduce(DataFrame.unionByName, [v.learned("ridge", h) for h in fd.HORIZONS])
    return forecast_store.known(made).filter(F.col("split") == splits.TEST)


def _boosted(v: View, horizon: int) -> DataFrame:
    """Metrics and residual spread of the best of the three configurations."""
    return evaluate.forecast_metrics(forecast_store.known(v.learned("boosted", horizon)), ["model", "horizon", "split"])


@query
def gbt_forecast(v: View) -> DataFrame:
    return _boosted(v, 1)


@query
def gbt_forecast_7(v: View) -> DataFrame:
    return _boosted(v, 7)


@query
def gbt_forecast_14(v: View) -> DataFrame:
    return _boosted(v, 14)


@query
def gbt_forecast_28(v: View) -> DataFrame:
    return _boosted(v, 28)


@query
def model_comparison(v: View) -> DataFrame:
    """Validation metrics of all four families at every horizon, on the rows that all of them forecast."""
    keys = ["product_id", "warehouse_id", "made_on", "horizon"]
    common = v.learned_store.select(*keys).distinct()
    return forecast_store.validation_metrics(v.full_store.join(common, keys, "left_semi"))


@query
def best_model_all(v: View) -> DataFrame:
    """The winner of each horizon among baselines, ridge and boosted trees."""
    return evaluate.best_model(model_comparison(v))


@query
def inventory_classifiers(v: View) -> DataFrame:
    """Validation metrics of the stockout classifiers."""
    rows = staged(
        models.risk_rows(
            v.inventory_rows.filter((F.col("is_target_available_7d") == 1) & (F.col("has_sufficient_history_28d") == 1)),
            splits.INVENTORY_FEATURES, "target_stockout_within_7d", splits.FORBIDDEN_INVENTORY, SERIES_KEY,
        ),
        "stockout_rows",
    )
    return models.fit_candidates(rows, splits.INVENTORY_CATEGORICAL, splits.INVENTORY_FEATURES)[2]


@query
def supplier_classifiers(v: View) -> DataFrame:
    """Calibrated test metrics of the best supplier-delay classifier."""
    features = splits.SUPPLIER_FEATURES
    rows = models.risk_rows(v.supplier_model_rows, features, "target_supplier_late", splits.FORBIDDEN_SUPPLIER, ["po_id"])
    encoder, fitted, metrics = models.fit_candidates(
        rows, splits.SUPPLIER_CATEGORICAL, features, settings=models.SUPPLIER_SETTINGS
    )
    best = models.best_family(metrics)
    tuned = models.calibrate(encoder, fitted[best], rows.filter(F.col("split") == splits.VALIDATION))
    test = tuned.score(rows.filter(F.col("split") == splits.TEST)).select("label", "score")
    return evaluate.evaluate_classifier(test).withColumn("model", F.lit(best))


@query
def inventory_model_score(v: View) -> DataFrame:
    """Calibrated stockout probability, score and band of every inventory row, from the saved model."""
    return v.model_scored_inventory.select(*SERIES_KEY, "stockout_probability_7d", "inventory_risk_score", "inventory_risk_band")


@query
def supplier_model_score(v: View) -> DataFrame:
    """Calibrated delay probability, score and band of every order, from the saved model."""
    return v.model_scored_suppliers.select("po_id", "supplier_delay_probability", "supplier_risk_score", "supplier_risk_band")


@query
def model_exposure(v: View) -> DataFrame:
    """Operational exposure on the scores of the served models."""
    return v.model_exposure.select(*v.exposure.columns)


@query
def served_models(v: View) -> DataFrame:
    """Version, family and validation figures of the models in use; served rows are counted."""
    counts = {"stockout": v.model_scored_inventory, "lateness": v.model_scored_suppliers}
    out = []
    for name, scored in counts.items():
        version, entry = v.registry.current(name)
        figures = [F.lit(entry[k]).alias(k) for k in ("family", "pr_auc", "roc_auc", "brier_raw", "brier_calibrated")]
        out.append(scored.agg(F.lit(name).alias("model"), F.lit(version).alias("version"), *figures, F.count(F.lit(1)).alias("scored_rows")))
    return reduce(DataFrame.unionByName, out)
