"""Supplier feature table: one row per purchase order, 58 columns.

At order date t an order may know deliveries strictly before t. Everything a
window needs is first summed per (supplier, day): a supplier with a third of
all orders becomes at most one row per calendar day and distinct delay. Range
frames then run on those rows, and the result is joined back to the orders by
(supplier, order day).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from supplyspark.functions.exprs import calendar_columns, day_number, flag, std_from_sums

COLD_START_GAP_DAYS = 999.0

BASE_SUPPLIER = {
    "supplier_name": "supplier_name",
    "tier": "supplier_tier",
    "baseline_reliability": "baseline_reliability",
    "baseline_lead_time_days": "baseline_lead_time_days",
    "lead_time_variance": "lead_time_variance",
    "monthly_capacity_units": "monthly_capacity_units",
    "moq_units": "moq_units",
    "transport_cost_factor": "supplier_transport_cost_factor",
}


def base_orders(fact_purchase_orders: DataFrame, dim_supplier: DataFrame) -> DataFrame:
    supplier = dim_supplier.select("supplier_id", *[F.col(a).alias(b) for a, b in BASE_SUPPLIER.items()])
    return fact_purchase_orders.join(supplier, "supplier_id")


# ------------------------------------------------------------- daily history
def daily_events(orders: DataFrame) -> DataFrame:
    """(supplier, day, delay): what was ordered and what was delivered that day.

    Orders are first summed by (supplier, order day, delivery day, delay), which
    leaves a hot supplier with a few rows for each calendar day. Most of these sums have
    one order, so orders are dealt by supplier and day before they are summed: summed
    where they are read, they fill the memory of a task and spill. The sums are dealt by
    supplier, and split only there into two events, an order (without delay) and a
    delivery: the sums below and the windows over them need no other shuffle.
    Delivered means the delivery date is known. ``asked`` marks the days on which a
    feature row is needed; each has one row without delay.
    """
    delivered = F.col("delivered").isNotNull()
    zero = F.lit(0).cast("long")
    sources = {"received": "quantity_received", "ordered": "quantity_ordered", "on_time": "on_time_flag", "otif": "otif_flag"}
    by_days = (
        orders.select(
            "supplier_id",
            day_number("order_date").alias("placed"),
            day_number("actual_delivery_date").alias("delivered"),
            F.col("delay_days").cast("int").alias("delay"),
            *sources.values(),
        )
        .repartition("supplier_id", "placed")
        .groupBy("supplier_id", "placed", "delivered", "delay")
        .agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c).cast("long")).alias(name) for name, c in sources.items()])
        .repartition("supplier_id")
    )
    measures = ("n", *sources)
    # An order without delivery date never counts as in flight, as published.
    placement = F.struct(
        F.col("placed").alias("day"),
        F.lit(None).cast("int").alias("delay"),
        F.lit(1).alias("asked"),
        F.when(delivered, F.col("n")).otherwise(zero).alias("placed"),
        F.when(delivered, F.col("ordered")).otherwise(zero).alias("placed_units"),
        *[zero.alias(c) for c in measures],
    )
    delivery = F.struct(
        F.col("delivered").alias("day"),
        F.col("delay"),
        F.lit(0).alias("asked"),
        zero.alias("placed"),
        zero.alias("placed_units"),
        *[F.col(c) for c in measures],
    )
    events = F.when(delivered, F.array(placement, delivery)).otherwise(F.array(placement))
    sums = [F.sum(c).alias(c) for c in ("placed", "placed_units", *measures)]
    return (
        by_days.select("supplier_id", F.inline(events))
        .groupBy("supplier_id", "day", "delay")
        .agg(F.max("asked").alias("asked"), *sums)
    )


# Look-back windows in days and the measures they need.
RECENT = {30: ("n", "delay", "otif"), 90: ("n", "otif")}


def history_by_day(orders: DataFrame) -> DataFrame:
    """The history of each supplier and day with an order."""
    return history_of_events(daily_events(orders))


def history_of_events(events: DataFrame) -> DataFrame:
    """Sums and percentiles over all deliveries before each day, sums over the last 30 and 90 days.

    Returns the events that ask for it, with their other columns.

    A delivery on day d counts for days d+1 .. d+w. The window sum is what came
    before the day less what came more than w days before it: two running sums,
    so each row costs the same however many days the window spans.
    """
    zero = F.lit(0).cast("long")
    delay = F.col("delay").cast("long")
    measures = {c: F.col(c) for c in ("placed", "placed_units", "n", "received", "ordered", "on_time", "otif")}
    measures |= {"delay": delay * F.col("n"), "delay_sq": delay * delay * F.col("n")}

    def until(days_before: int) -> WindowSpec:
        return Window.partitionBy("supplier_id").orderBy("day").rangeBetween(Window.unboundedPreceding, -days_before)

    def total(c: str, days_before: int = 1) -> Column:
        return F.coalesce(F.sum(measures[c]).over(until(days_before)), zero)

    percentiles = F.percentile("delay", F.array(F.lit(0.9), F.lit(0.95)), F.col("n")).over(until(1))
    kept = [c for c in events.columns if c not in ("delay", "asked", "placed", "placed_units", "n", "received", "ordered", "on_time", "otif")]
    out = events.select(
        *kept,
        (F.col("delay").isNull() & (F.col("asked") == 1)).alias("asked"),
        *[total(c).alias(f"past_{c}") for c in measures],
        *[(total(c) - total(c, w + 1)).alias(f"d{w}_{c}") for w, cs in RECENT.items() for c in cs],
        F.max(F.when(F.col("n") > 0, F.col("day"))).over(until(1)).alias("last_delivery_day"),
        percentiles.alias("p"),
    )
    return out.filter("asked").select(
        *[c for c in out.columns if c not in ("asked", "p")],
        F.get("p", F.lit(0)).alias("past_p90"),
        F.get("p", F.lit(1)).alias("past_p95"),
    )


def history_columns() -> dict[str, Column]:
    """Feature columns from the joined sums, with cold-start defaults."""
    cold = F.col("past_n") == 0
    prior = F.col("baseline_reliability")
    n = F.nullif(F.col("past_n"), F.lit(0)).cast("double")
    mean_delay = F.coalesce(F.col("past_delay") / n, F.lit(0.0))
    otif = F.coalesce(F.col("past_otif") / n, prior)
    n30 = F.nullif(F.col("d30_n"), F.lit(0)).cast("double")
    n90 = F.nullif(F.col("d90_n"), F.lit(0)).cast("double")
    recent = F.coalesce(F.col("d30_delay") / n30, mean_delay)
    in_flight = F.col("past_placed") - F.col("past_n")
    in_flight_units = F.col("past_placed_units") - F.col("past_ordered")
    spread = std_from_sums(F.col("past_n"), F.col("past_delay"), F.col("past_delay_sq"))
    return {
        "hist_order_count": F.col("past_n").cast("int"),
        "hist_order_volume": F.col("past_received").cast("double"),
        "hist_on_time_rate": F.coalesce(F.col("past_on_time") / n, prior),
        "hist_otif_rate": otif,
        "hist_fill_rate": F.when(cold, 1.0).otherwise(
            F.col("past_received") / F.greatest(F.col("past_ordered"), F.lit(1)).cast("double")
        ),
        "hist_mean_delay": mean_delay,
        "hist_std_delay": F.coalesce(spread, F.lit(0.0)),
        "hist_p90_delay": F.coalesce("past_p90", F.lit(0.0)),
        "hist_p95_delay": F.coalesce("past_p95", F.lit(0.0)),
        "recent_delay_30d": recent,
        "recent_otif_30d": F.coalesce(F.col("d30_otif") / n30, otif),
        "recent_otif_90d": F.coalesce(F.col("d90_otif") / n90, otif),
        "delay_trend": recent - mean_delay,
        "supplier_active_orders_count": in_flight.cast("int"),
        "supplier_active_volume": in_flight_units.cast("double"),
        "supplier_capacity_pressure": in_flight_units / F.greatest(F.col("monthly_capacity_units"), F.lit(1)).cast("double"),
        "days_since_last_delivery": F.coalesce(
            (day_number("order_date") - F.col("last_delivery_day")).cast("double"), F.lit(COLD_START_GAP_DAYS)
        ),
        "is_cold_start": cold.cast("int"),
    }


def with_history(base: DataFrame, orders: DataFrame | None = None) -> DataFrame:
    """Join the per-day history back to the orders of that supplier and day.

    ``orders`` may name a cheaper source of the same order rows.
    """
    history = history_by_day(base if orders is None else orders)
    helper = [c for c in history.columns if c not in ("supplier_id", "day")]
    dated = history.select("supplier_id", F.date_from_unix_date("day").alias("order_date"), *helper)
    columns = ["supplier_id", *(c for c in base.columns if c != "supplier_id")]
    joined = base.join(dated, ["supplier_id", "order_date"]).select(*columns, *helper)
    return joined.withColumns(history_columns()).drop(*helper)


# --------------------------------------------------------- other order columns
def calendar_feature_columns() -> dict[str, Column]:
    cal = calendar_columns("order_date")
    return {
        "order_day_of_week": cal["day_of_week"],
        "order_month": cal["month"],
        "order_quarter": cal["quarter"],
        "order_is_weekend": cal["is_weekend"],
        "order_is_month_end": cal["is_month_end"],
    }


def day_costs(orders: DataFrame) -> DataFrame:
    """Count, sum and squares of the unit costs before each day on which the supplier had the product ordered."""
    keys = ["supplier_id", "product_id"]
    c = F.col("unit_cost")
    by_day = orders.groupBy(*keys, "order_date").agg(F.count(c).alias("n"), F.sum(c).alias("s1"), F.sum(c * c).alias("s2"))
    before_day = Window.partitionBy(*keys).orderBy("order_date").rowsBetween(Window.unboundedPreceding, -1)
    return by_day.select(
        *keys, "order_date", *[F.coalesce(F.sum(x).over(before_day), F.lit(0)).alias(f"_day_{x}") for x in ("n", "s1", "s2")]
    )


SAME_DAY = ("_same_n", "_same_s1", "_same_s2")


def _earlier_that_day() -> dict[str, Column]:
    """Count, sum and squares of the unit costs of earlier orders of the same supplier, product and day."""
    c = F.col("unit_cost")
    before = Window.partitionBy("supplier_id", "order_date", "product_id").orderBy("po_id").rowsBetween(Window.unboundedPreceding, -1)
    sums = (
        F.coalesce(F.count(c).over(before), F.lit(0)),
        F.coalesce(F.sum(c).over(before), F.lit(0.0)),
        F.coalesce(F.sum(c * c).over(before), F.lit(0.0)),
    )
    return dict(zip(SAME_DAY, sums, strict=True))


def _with_cost_columns(joined: DataFrame, before: Callable[[str], Column]) -> DataFrame:
    """The two cost columns from ``before`` the day and ``_same``, earlier that day."""
    out = joined.withColumns({f"_{x}": before(f"_day_{x}") + F.col(f"_same_{x}") for x in ("n", "s1", "s2")})
    return out.withColumns(_cost_columns()).drop("_n", "_s1", "_s2", *SAME_DAY)


def _cost_columns() -> dict[str, Column]:
    """The two cost columns from the count, sum and squares of the earlier unit costs."""
    return {
        "hist_sku_unit_cost_mean": F.coalesce(
            F.col("_s1") / F.nullif(F.col("_n"), F.lit(0)).cast("double"), F.col("unit_cost")
        ),
        "hist_sku_unit_cost_std": F.coalesce(
            std_from_sums(F.col("_n"), F.col("_s1"), F.col("_s2")), F.lit(0.0)
        ),
    }


def with_cost_history(base: DataFrame, orders: DataFrame | None = None) -> DataFrame:
    """Mean and deviation of the unit cost of earlier orders of the product.

    Order is (order_date, po_id). Days are summed first; the day totals give
    everything before the day, and a short window over the orders of one
    (supplier, product, day) adds the earlier orders of the same day, so a
    popular product never puts its whole order history in one window group.
    ``orders`` may name a cheaper source of the same order rows.
    """
    keys = ["supplier_id", "product_id", "order_date"]
    days = day_costs(base if orders is None else orders)
    joined = base.dropna(subset=keys).join(days, keys, "left").withColumns(_earlier_that_day())
    return _with_cost_columns(joined, F.col).drop("_day_n", "_day_s1", "_day_s2")


def target_columns() -> dict[str, Column]:
    return {
        "target_delay_days": F.col("delay_days"),
        "target_delay_gt_2d": flag(F.col("delay_days") > 2),
        "target_delay_gt_5d": flag(F.col("delay_days") > 5),
        "target_on_time": F.col("on_time_flag"),
        "target_otif": F.col("otif_flag"),
        "target_actual_lead_time_days": F.col("actual_lead_time_days"),
    }


COST_COLUMNS = ("hist_sku_unit_cost_mean", "hist_sku_unit_cost_std")


def supplier_features(base: DataFrame) -> DataFrame:
    """All columns.

    The orders, the widest rows here, are dealt once, by supplier and day: that
    serves the window over the orders of one day, the join to the costs before
    that day (a map by product, one row for each supplier and day) and the join to
    the history. The costs have one row for each key, which the plan can see, so
    the left join to them is left out where neither cost column is read.
    """
    keys = ["supplier_id", "product_id", "order_date"]
    dealt = base.dropna(subset=keys).repartition("supplier_id", "order_date")
    sums = F.struct("product_id", F.struct("_day_n", "_day_s1", "_day_s2"))
    costs = (
        day_costs(base)
        .dropna(subset=keys)
        .groupBy("supplier_id", "order_date")
        .agg(F.map_from_entries(F.collect_list(sums)).alias("_costs"))
    )
    joined = dealt.withColumns(_earlier_that_day()).join(costs, ["supplier_id", "order_date"], "left")
    joined = joined.select(*keys, *(c for c in base.columns if c not in keys), *SAME_DAY, "_costs")
    costed = _with_cost_columns(joined, lambda c: F.element_at("_costs", F.col("product_id"))[c]).drop("_costs")
    out = with_history(costed, base).withColumns(calendar_feature_columns())
    columns = [c for c in out.columns if c not in COST_COLUMNS]
    return out.select(*columns, *COST_COLUMNS).withColumns(target_columns())


# ------------------------------------------------- suppliers of a usual size
BUSY_ORDERS = 100_000  # a supplier with more is spread over several tasks


def busy_suppliers(orders: DataFrame, limit: int = BUSY_ORDERS) -> list[str]:
    """Suppliers with more than ``limit`` orders: at most one for every ``limit`` orders there are."""
    counts = orders.groupBy("supplier_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)
    return [r.supplier_id for r in counts.filter(F.col("supplier_id").isNotNull()).collect()]


def order_features(base: DataFrame, busy: Sequence[str] = ()) -> DataFrame:
    """All columns: orders of ``busy`` suppliers are spread by day, all others are dealt once, by supplier."""
    if not busy:
        return features_by_supplier(base)
    is_busy = F.col("supplier_id").isin(list(busy))
    usual = features_by_supplier(base.filter(~is_busy))
    return usual.unionByName(supplier_features(base.filter(is_busy)))


def features_by_supplier(base: DataFrame) -> DataFrame:
    """The columns of ``supplier_features`` with one shuffle: every order of a supplier is in one task.

    An order is one event where it is placed and, without its columns, another
    where it is delivered, so the history is a window over the events. The costs
    of earlier orders are a window over the orders as they lie after it.
    """
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    others = [c for c in base.columns if c != "supplier_id"]
    placed, delivered = F.col("_kind") == 0, F.col("actual_delivery_date").isNotNull()
    known = F.when(delivered, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = base.repartition("supplier_id").withColumn("_kind", F.explode(known))
    sources = {"received": "quantity_received", "ordered": "quantity_ordered", "on_time": "on_time_flag", "otif": "otif_flag"}
    delay = F.when(~placed, F.col("delay_days").cast("int"))
    events = rows.select(
        "supplier_id",
        F.when(placed, day_number("order_date")).otherwise(day_number("actual_delivery_date")).alias("day"),
        delay.alias("delay"),
        F.when(placed, 1).otherwise(0).alias("asked"),
        F.when(placed & delivered, one).otherwise(zero).alias("placed"),
        F.when(placed & delivered, F.col("quantity_ordered").cast("long")).otherwise(zero).alias("placed_units"),
        F.when(placed, zero).otherwise(one).alias("n"),
        *[F.when(placed, zero).otherwise(F.col(c).cast("long")).alias(name) for name, c in sources.items()],
        *[F.when(placed, F.col(c)).alias(f"_order_{c}") for c in others],
    )
    history = history_of_events(events)
    helper = [c for c in history.columns if c not in ("supplier_id", "day") and not c.startswith("_order_")]
    keys = ["supplier_id", "product_id", "order_date"]
    orders = history.select("supplier_id", *[F.col(f"_order_{c}").alias(c) for c in others], *helper)
    c = F.col("unit_cost")
    before = Window.partitionBy("supplier_id", "product_id").orderBy("order_date", "po_id").rowsBetween(Window.unboundedPreceding, -1)
    earlier = {"_n": F.count(c).over(before), "_s1": F.coalesce(F.sum(c).over(before), F.lit(0.0)), "_s2": F.coalesce(F.sum(c * c).over(before), F.lit(0.0))}
    # Orders without a day come before all others, as in the sums by day.
    costed = orders.withColumns(earlier).dropna(subset=keys).withColumns(_cost_columns()).drop("_n", "_s1", "_s2")
    out = costed.withColumns(history_columns()).drop(*helper).withColumns(calendar_feature_columns())
    columns = ["supplier_id", "product_id", "order_date", *(x for x in out.columns if x not in (*keys, *COST_COLUMNS))]
    return out.select(*columns, *COST_COLUMNS).withColumns(target_columns())
