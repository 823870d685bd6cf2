"""Risk scoring: rule baselines, composite scores, exposure and explanations.

Everything is column expressions over the feature tables; a row never leaves
the JVM, and the only joins are to the product table and to one profile row
per supplier.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplyspark.functions.exprs import band, clip, col, flag, half_even, histogram_bin, lower_first, sentence_list
from supplyspark.sources.io import scan_equal

# Score weights, band limits and defaults.
INVENTORY_WEIGHTS = {"prob": 0.35, "dos": 0.20, "ss": 0.15, "dem": 0.15, "hist": 0.15}
SUPPLIER_WEIGHTS = {"prob": 0.35, "unrel": 0.20, "drift": 0.15, "cap": 0.15, "sev": 0.15}
EXPOSURE_WEIGHTS = {"inv": 0.45, "sup": 0.35, "inter": 0.20}
BANDS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
INVENTORY_CUTS = (25.0, 60.0, 80.0)
SUPPLIER_CUTS = (30.0, 60.0, 80.0)
EXPOSURE_CUTS = (25.0, 55.0, 75.0)
DEFAULT_SUPPLIER = {"supplier_delay_probability": 0.45, "supplier_risk_score": 45.0, "supplier_risk_band": "MEDIUM"}
CRITICALITY_WEIGHTS = {"CRITICAL": 3.0, "HIGH": 2.0, "MEDIUM": 1.5, "LOW": 1.0}
DEFAULT_CRITICALITY_WEIGHT = 1.5
STOCKOUT_PENALTY = 1.5


def _share(weights: Mapping[str, float]) -> dict[str, float]:
    total = sum(weights.values())
    return {k: v / total for k, v in weights.items()}


def _or(c: Column | str, default: float) -> Column:
    return F.coalesce(col(c).cast("double"), F.lit(float(default)))


# ------------------------------------------------------------ composite helpers
def buffer_deficiency(stock: Column | str, safety_stock: Column | str) -> Column:
    target = F.greatest(col(safety_stock).cast("double"), F.lit(1.0))
    return clip((target - col(stock)) / target, -2.0, 1.0)


def supplier_vulnerability(delay_probability: Column | str, criticality: Column | str) -> Column:
    weights = F.create_map(*[F.lit(v) for pair in CRITICALITY_WEIGHTS.items() for v in pair])
    weight = F.coalesce(F.try_element_at(weights, F.upper(col(criticality))), F.lit(DEFAULT_CRITICALITY_WEIGHT))
    return col(delay_probability) * weight


def expected_exposure(probability: Column | str, unit_cost: Column | str, daily_demand: Column | str) -> Column:
    return col(probability) * col(daily_demand) * col(unit_cost)


# ------------------------------------------------------------------ baselines
def stockout_rule(
    days_of_supply: Column | str = "inventory_days_of_supply",
    gap: Column | str | None = "safety_stock_gap",
    target: float = 7.0,
    scale: float = 2.0,
) -> Column:
    z = (F.lit(target) - col(days_of_supply)) / max(scale, 0.1)
    p = 1.0 / (1.0 + F.exp(-z))
    if gap is None:
        return p
    return clip(p + F.when(col(gap) < 0, 0.15).otherwise(0.0), 0.01, 0.99)


def supplier_rule() -> Column:
    on_time = F.when(F.col("is_cold_start") == 1, F.col("baseline_reliability")).otherwise(
        F.coalesce("hist_on_time_rate", F.lit(0.5))
    )
    return clip(1.0 - on_time, 0.05, 0.95)


# --------------------------------------------------------------------- scores
def inventory_score(probability: Column | str, forecast: Column | str = "forecast_demand_7d", weights=INVENTORY_WEIGHTS) -> Column:
    w = _share(weights)
    stock = F.coalesce(F.col("ending_inventory_lag1"), F.col("beginning_inventory"), F.lit(0)).cast("double")
    target = F.coalesce(F.nullif(F.col("safety_stock_target"), F.lit(0)).cast("double"), F.lit(1.0))
    chance = clip(col(probability) * 100.0, 0.0, 100.0)
    supply = clip((1.0 - _or("inventory_days_of_supply", 14.0) / 14.0) * 100.0, 0.0, 100.0)
    buffer = clip((1.0 - clip(stock / target, 0.0, 2.0)) * 100.0, 0.0, 100.0)
    pull = clip(_or(forecast, 70.0) / F.greatest(stock, F.lit(1.0)), 0.0, 2.0)
    demand = clip(pull / 1.5 * 100.0, 0.0, 100.0)
    history = clip(_or("stockout_rate_28d", 0.0) * 100.0, 0.0, 100.0)
    total = (
        w["prob"] * chance + w["dos"] * supply + w["ss"] * buffer + w["dem"] * demand + w["hist"] * history
    )
    return clip(half_even(F.coalesce(total, F.lit(0.0)), 1), 0.0, 100.0)


def supplier_score(probability: Column | str, weights=SUPPLIER_WEIGHTS) -> Column:
    w = _share(weights)
    unreliable = clip((1.0 - _or("hist_on_time_rate", 0.5)) * 100.0, 0.0, 100.0)
    drift = clip(
        _or("recent_delay_30d", 0.0) / 3.0 * 50.0 + F.greatest(_or("delay_trend", 0.0), F.lit(0.0)) * 25.0, 0.0, 100.0
    )
    capacity = clip(_or("supplier_capacity_pressure", 0.0) * 100.0, 0.0, 100.0)
    severity = clip(_or("hist_p90_delay", 0.0) / 5.0 * 100.0, 0.0, 100.0)
    total = (
        w["prob"] * clip(col(probability) * 100.0, 0.0, 100.0)
        + w["unrel"] * unreliable
        + w["drift"] * drift
        + w["cap"] * capacity
        + w["sev"] * severity
    )
    return clip(half_even(total, 1), 0.0, 100.0)


def score_inventory(df: DataFrame, probability: Column | None = None) -> DataFrame:
    """Adds probability, score and band. Without a model the rule baseline is used."""
    p = half_even(stockout_rule() if probability is None else probability, 4)
    return (
        df.withColumn("stockout_probability_7d", p)
        .withColumn("inventory_risk_score", inventory_score("stockout_probability_7d"))
        .withColumn("inventory_risk_band", band("inventory_risk_score", INVENTORY_CUTS, BANDS))
    )


def score_suppliers(df: DataFrame, probability: Column | None = None) -> DataFrame:
    p = half_even(supplier_rule() if probability is None else probability, 4)
    return (
        df.withColumn("supplier_delay_probability", p)
        .withColumn("supplier_risk_score", supplier_score("supplier_delay_probability"))
        .withColumn("supplier_risk_band", band("supplier_risk_score", SUPPLIER_CUTS, BANDS))
    )


# ------------------------------------------------------------ supplier profile
PROFILE_COLUMNS = (
    "supplier_name",
    "supplier_tier",
    "supplier_delay_probability",
    "supplier_risk_score",
    "supplier_risk_band",
    "hist_on_time_rate",
    "hist_p90_delay",
    "supplier_capacity_pressure",
    "delay_trend",
)


def latest_supplier_profile(scored: DataFrame, columns: Sequence[str] = PROFILE_COLUMNS) -> DataFrame:
    """Last non-null value per column and supplier, by order date then po_id.

    ``max_by`` combines on the map side: however many orders one supplier has,
    one candidate per task reaches the shuffle.
    """
    when = F.struct("order_date", "po_id")
    return scored.groupBy("supplier_id").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), when)).alias(c) for c in columns]
    )


# -------------------------------------------------------------------- exposure
PRODUCT_COLUMNS = (
    "primary_supplier_id",
    "secondary_supplier_id",
    "supplier_dependency",
    "shelf_life_days",
    "storage_requirement",
)


def exposure_layer(
    scored_inventory: DataFrame,
    supplier_profile: DataFrame,
    dim_product: DataFrame,
    weights=EXPOSURE_WEIGHTS,
    penalty: float = STOCKOUT_PENALTY,
) -> DataFrame:
    """Scored positions with their primary supplier's profile and exposure."""
    w = _share(weights)
    products = dim_product.select("product_id", *PRODUCT_COLUMNS).dropDuplicates(["product_id"])
    profile = supplier_profile.withColumnRenamed("supplier_id", "primary_supplier_id")
    joined = (
        scored_inventory.join(products, "product_id", "left")
        .join(profile, "primary_supplier_id", "left")
        .withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in DEFAULT_SUPPLIER.items()})
        .withColumn("primary_supplier_name", F.col("supplier_name"))
    )
    inv, sup = F.col("inventory_risk_score"), F.col("supplier_risk_score")
    score = w["inv"] * inv + w["sup"] * sup + w["inter"] * (inv * sup / 100.0)
    stock = F.coalesce(F.col("ending_inventory_lag1"), F.col("beginning_inventory")).cast("double")
    demand = F.coalesce(F.col("forecast_demand_7d").cast("double"), F.col("demand_mean_7") * 7.0)
    quantity = F.greatest(F.lit(0.0), demand - stock) * F.col("stockout_probability_7d")
    return (
        joined.withColumn("operational_exposure_score", clip(half_even(score, 1), 0.0, 100.0))
        .withColumn("operational_exposure_band", band("operational_exposure_score", EXPOSURE_CUTS, BANDS))
        .withColumn("projected_exposure_quantity", half_even(quantity, 1))
        .withColumn("projected_exposure_cost", half_even(quantity * F.col("unit_cost") * penalty, 2))
    )


# ---------------------------------------------------------------- explanations
def _fmt0(c: Column) -> Column:
    """Whole number text, ties to even."""
    return F.format_string("%.0f", F.rint(c))


def _fmt1(c: Column) -> Column:
    return F.format_string("%.1f", half_even(c, 1))


def evidence() -> Column:
    """Array of threshold findings in fixed order, with a default when calm."""
    demand = _or("forecast_demand_7d", 0.0)
    stock = F.coalesce(F.col("ending_inventory_lag1"), F.col("beginning_inventory"), F.lit(0)).cast("double")
    supply = _or("inventory_days_of_supply", 999.0)
    target = _or("safety_stock_target", 0.0)
    rate28 = _or("stockout_rate_28d", 0.0)
    late = _or("supplier_delay_probability", 0.0)
    on_time = _or("hist_on_time_rate", 1.0)
    p90 = _or("hist_p90_delay", 0.0)
    pressure = _or("supplier_capacity_pressure", 0.0)
    crowded = _or("warehouse_capacity_utilization_lag1", 0.0)
    supplier = F.coalesce(F.col("supplier_name"), F.lit("Primary Supplier"))
    out_days = F.coalesce(F.col("stockout_count_7d"), F.lit(0))

    def text(*parts: Column | str) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    # Wording and thresholds of the findings.
    findings = sentence_list(
        F.when(
            demand > stock,
            text("Projected 7-day demand (", _fmt0(demand), " units) exceeds available inventory (", _fmt0(stock),
                 " units) by ", _fmt0(demand - stock), " units."),
        ),
        F.when(supply < 5.0, text("Severely depleted inventory buffer: only ", _fmt1(supply), " days of supply remaining."))
        .when(supply < 7.0, text("Sub-optimal inventory buffer: ", _fmt1(supply), " days of supply remaining (below 7-day planning target).")),
        F.when(
            (stock < target) & (target > 0),
            text("Physical buffer below safety stock target (", _fmt0(stock), " vs ", _fmt0(target), " units, ",
                 _fmt1((target - stock) / F.nullif(target, F.lit(0.0)) * 100.0), "% deficit)."),
        ),
        F.when(out_days >= 2, text("Elevated recent stockout frequency: ", out_days.cast("string"), " stockout days in the past 7 days."))
        .when(rate28 >= 0.15, text("Persistent historical stockout incidence: ", _fmt1(rate28 * 100.0), "% of past 28 days experienced stockouts.")),
        F.when(late >= 0.55, text("Primary supplier [", supplier, "] presents elevated delivery delay risk (predicted late probability: ", _fmt1(late * 100.0), "%)."))
        .when(on_time < 0.60, text("Supplier [", supplier, "] exhibits low historical reliability (", _fmt1(on_time * 100.0), "% on-time delivery rate).")),
        F.when(p90 >= 3.0, text("Severe tail-risk delivery delays: historical 90th percentile delay is ", _fmt1(p90), " days.")),
        F.when(pressure >= 0.80, text("High supplier capacity pressure: active order volume is ", _fmt1(pressure * 100.0), "% of monthly capacity.")),
        F.when(F.lower("criticality") == "high", F.lit("High SKU operational criticality: stockout imposes immediate revenue and SLA penalties.")),
        F.when(F.lower("supplier_dependency").contains("single"), F.lit("Single-sourced dependency: no immediate secondary supplier alternative available on record.")),
        F.when(crowded >= 85.0, text("Warehouse facility under severe saturation (", _fmt1(crowded), "% capacity utilization).")),
    )
    calm = F.array(F.lit("Stable buffer health and normal supplier delivery indicators under current operating parameters."))
    return F.when(F.size(findings) == 0, calm).otherwise(findings)


def recommended_action(band_column: str = "operational_exposure_band") -> Column:
    level = F.col(band_column)
    late = _or("supplier_delay_probability", 0.0)
    dual = F.coalesce(F.lower("supplier_dependency"), F.lit("")).contains("dual")
    # Wording of the recommendations.
    critical = (
        F.when((late >= 0.60) & dual, "URGENT: Expedite purchase order allocation to qualified secondary supplier; trigger emergency regional cross-dock transfer.")
        .when(_or("inventory_days_of_supply", 999.0) < 4.0, "CRITICAL: Issue emergency replenishment PO with express transit; evaluate temporary demand throttling or substitution.")
        .otherwise("CRITICAL: Place urgent expedited PO and reserve safety stock buffer at regional hub.")
    )
    high = F.when(late >= 0.50, "HIGH PRIORITY: Advance replenishment reorder date by 3 days to absorb expected supplier delay; audit supplier active pipeline.").otherwise(
        "HIGH PRIORITY: Increase replenishment order quantity by safety stock deficit and monitor buffer daily."
    )
    return (
        F.when(level == "CRITICAL", critical)
        .when(level == "HIGH", high)
        .when(level == "MEDIUM", "ROUTINE REVIEW: Flag for standard procurement review during next weekly planning cycle; verify supplier lead-time adherence.")
        .otherwise("MONITOR: Inventory and supply parameters within standard operating tolerances. No immediate intervention required.")
    )


def with_explanations(df: DataFrame, band_column: str = "operational_exposure_band") -> DataFrame:
    """Summary, action and the first four findings joined by a bar."""
    out = df.withColumn("_ev", evidence())
    level = F.col(band_column)
    trimmed = F.transform(F.slice("_ev", 1, 3), lambda e: F.rtrim(e, F.lit(".")))
    details = lower_first(F.concat(F.concat_ws("; ", trimmed), F.lit(".")))
    summary = F.when(
        level.isin("HIGH", "CRITICAL"),
        F.concat(F.lit("Elevated "), F.lower(level), F.lit(" operational exposure because "), details),
    ).otherwise(F.concat(level, F.lit(" operational exposure: "), F.get("_ev", F.lit(0))))
    return (
        out.withColumn("explanation_summary", summary)
        .withColumn("recommended_action", recommended_action(band_column))
        .withColumn("evidence_bullets", F.concat_ws(" | ", F.slice("_ev", 1, 4)))
        .drop("_ev")
    )


# ---------------------------------------------------------------- serving tables
INVENTORY_RISK_COLUMNS = (
    "date", "product_id", "warehouse_id", "category", "stockout_probability_7d", "inventory_risk_score",
    "inventory_risk_band", "forecast_demand_7d", "ending_inventory_lag1", "inventory_days_of_supply",
    "safety_stock_target", "safety_stock_gap", "target_stockout_within_7d", "split",
)
SUPPLIER_RISK_COLUMNS = (
    "po_id", "order_date", "supplier_id", "supplier_name", "warehouse_id", "product_id", "quantity_ordered",
    "supplier_delay_probability", "supplier_risk_score", "supplier_risk_band", "hist_on_time_rate",
    "recent_delay_30d", "supplier_capacity_pressure", "target_delay_days", "target_supplier_late", "split",
)
EXPOSURE_COLUMNS = (
    "date", "product_id", "product_name", "category", "criticality", "warehouse_id", "warehouse_name",
    "primary_supplier_id", "primary_supplier_name", "forecast_demand_7d", "ending_inventory_lag1",
    "inventory_days_of_supply", "stockout_probability_7d", "inventory_risk_score", "supplier_delay_probability",
    "supplier_risk_score", "operational_exposure_score", "operational_exposure_band", "projected_exposure_quantity",
    "projected_exposure_cost", "explanation_summary", "recommended_action", "evidence_bullets",
)


def serving_tables(inventory: DataFrame, suppliers: DataFrame, exposure: DataFrame) -> dict[str, DataFrame]:
    from supplyspark.operators.splits import keep_existing

    stamp = F.current_timestamp()
    return {
        "analytics_inventory_risk": keep_existing(
            inventory,
            INVENTORY_RISK_COLUMNS,
            {"ending_inventory_lag1": "inventory_position", "target_stockout_within_7d": "actual_stockout_within_7d"},
        ).withColumn("created_at", stamp),
        "analytics_supplier_risk": keep_existing(
            suppliers,
            SUPPLIER_RISK_COLUMNS,
            {"target_delay_days": "actual_delay_days", "target_supplier_late": "actual_supplier_late"},
        ).withColumn("created_at", stamp),
        "analytics_operational_exposure": keep_existing(
            exposure, EXPOSURE_COLUMNS, {"ending_inventory_lag1": "inventory_position"}
        ).withColumn("created_at", stamp),
    }


def late_label(df: DataFrame) -> DataFrame:
    return df.withColumn("target_supplier_late", flag(F.col("target_on_time") == 0))


# ------------------------------------------------------------------- dashboards
def latest_snapshot(df: DataFrame, date_column: str = "date") -> DataFrame:
    """Rows of the last day; the maximum is a scalar subquery, so on a table
    partitioned by date it prunes to one partition."""
    return df.filter(F.col(date_column) == df.agg(F.max(date_column)).scalar())


def risk_snapshot(exposure: DataFrame, profile: DataFrame) -> DataFrame:
    """One row of headline figures for the latest day."""
    high = F.count_if(F.col("supplier_risk_score") >= 60.0)
    suppliers = profile.agg(F.struct(high.alias("high"), F.count(F.lit(1)).alias("n"))).scalar()
    urgent = F.col("operational_exposure_band").isin("HIGH", "CRITICAL")
    return latest_snapshot(exposure).agg(
        F.max("date").alias("as_of"),
        F.count(F.lit(1)).alias("total_positions"),
        F.count_if(F.col("inventory_risk_score") >= 60.0).alias("high_risk_positions"),
        (F.avg("stockout_probability_7d") * 100.0).alias("avg_stockout_probability_pct"),
        F.sum("projected_exposure_cost").alias("total_exposure_cost"),
        F.coalesce(F.sum(F.when(urgent, F.col("projected_exposure_cost"))), F.lit(0.0)).alias("urgent_exposure_cost"),
    ).withColumns({"high_risk_suppliers": suppliers["high"], "total_suppliers": suppliers["n"]})


def exposure_matrix(snapshot: DataFrame, warehouses: Sequence[str]) -> DataFrame:
    """Product x warehouse exposure scores; the warehouse list is given, so no
    extra job collects the pivot values."""
    return snapshot.groupBy("product_id").pivot("warehouse_id", list(warehouses)).agg(
        F.max("operational_exposure_score")
    )


def band_crosstab(snapshot: DataFrame) -> DataFrame:
    level = F.col("operational_exposure_band")
    return snapshot.groupBy("warehouse_id").agg(*[F.count_if(level == b).alias(b) for b in BANDS])


def band_counts(exposure: DataFrame) -> DataFrame:
    return exposure.groupBy("operational_exposure_band").agg(
        F.count(F.lit(1)).alias("n_positions"), F.sum("projected_exposure_cost").alias("exposure_cost")
    )


def probability_histogram(snapshot: DataFrame, bins: int = 10) -> DataFrame:
    return snapshot.groupBy(histogram_bin("stockout_probability_7d", bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n_positions")
    )


QUEUE_COLUMNS = (
    "product_id", "category", "warehouse_id", "primary_supplier_name", "forecast_demand_7d", "inventory_position",
    "inventory_days_of_supply", "stockout_probability_7d", "supplier_delay_probability",
    "operational_exposure_score", "operational_exposure_band", "explanation_summary", "recommended_action",
)


def investigation_queue(
    snapshot: DataFrame,
    bands: Sequence[str] = ("CRITICAL", "HIGH"),
    warehouses: Sequence[str] | None = None,
    categories: Sequence[str] | None = None,
) -> DataFrame:
    out = snapshot.filter(F.col("operational_exposure_band").isin(*bands))
    if warehouses is not None:
        out = out.filter(F.col("warehouse_id").isin(*warehouses))
    if categories is not None:
        out = out.filter(F.col("category").isin(*categories))
    if "inventory_position" not in out.columns:
        out = out.withColumnRenamed("ending_inventory_lag1", "inventory_position")
    order = [F.desc("operational_exposure_score"), "product_id", "warehouse_id"]
    return out.select(*[c for c in QUEUE_COLUMNS if c in out.columns]).orderBy(*order)


def drill_down(snapshot: DataFrame, product_id: str, warehouse_id: str) -> DataFrame:
    row = scan_equal(snapshot, product_id=product_id, warehouse_id=warehouse_id)
    return row.withColumn("evidence_items", F.split("evidence_bullets", r" \| "))


def supplier_display(profile: DataFrame) -> DataFrame:
    """Supplier table as shown: percentages as text, riskiest first."""

    def percent(c: str) -> Column:
        return F.concat(_fmt1(F.col(c) * 100.0), F.lit("%"))

    return profile.select(
        "supplier_id",
        "supplier_name",
        "supplier_tier",
        percent("supplier_delay_probability").alias("supplier_delay_probability"),
        "supplier_risk_score",
        "supplier_risk_band",
        percent("hist_on_time_rate").alias("hist_on_time_rate"),
        "hist_p90_delay",
    ).orderBy(F.desc("supplier_risk_score"), "supplier_id")
