"""Cleaning with tagged rows: nothing disappears without a trace.

Each table is repaired in one pass that gives every row the ``action`` that
decided its fate (NULL when none did) and is written once. Kept rows,
quarantined rows and the audit trail are three views of that tagged table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supplyspark.functions.exprs import half_even
from supplyspark.operators.quality import z_scores
from supplyspark.session import staged

REMOVED, REPAIRED, FLAGGED = "REMOVED", "REPAIRED", "RETAINED_WITH_FLAG"

# Action -> (rule, reason, disposition), per table.
ACTIONS = {
    "fact_demand": {
        "DEDUPLICATE": ("DQ-003", "Removed exact duplicate demand rows.", REMOVED),
        "QUARANTINE_NULL_OR_ORPHAN_KEY": ("DQ-001/005", "Removed demand records with null or non-existent product IDs.", REMOVED),
        "QUARANTINE_INVALID_DATE": ("DQ-002", "Removed demand records with malformed date timestamps.", REMOVED),
        "REPAIR_NEGATIVE_VALUE": ("DQ-004", "Clamped negative demand requested values to zero floor.", REPAIRED),
        "ANNOTATE_OUTLIER": ("DQ-007", "Flagged statistical demand outliers for analytical awareness.", FLAGGED),
    },
    "fact_purchase_orders": {
        "DEDUPLICATE": ("DQ-003", "Removed exact duplicate purchase order rows.", REMOVED),
        "DEDUPLICATE_PRIMARY_KEY": ("DQ-003", "Quarantined conflicting duplicate po_id entries, preserving first authenticated record.", REMOVED),
        "QUARANTINE_NULL_OR_ORPHAN_KEY": ("DQ-001/005", "Removed purchase orders referencing null or non-existent supplier IDs.", REMOVED),
        "REPAIR_NEGATIVE_PRICE": ("DQ-004", "Restored negative unit cost on purchase orders using product master standard cost.", REPAIRED),
    },
    "fact_inventory": {
        "DEDUPLICATE": ("DQ-003", "Removed duplicate inventory records.", REMOVED),
        "REPAIR_INVENTORY_BALANCE": ("DQ-006", "Re-derived ending inventory from beginning stock, receipts, and demand fulfillment.", REPAIRED),
    },
    "fact_transport": {
        "QUARANTINE_ORPHAN_TRANSPORT": ("DQ-005", "Removed transport shipments whose associated PO was quarantined.", REMOVED),
    },
}
OUTLIER_Z = 5.0
UNKNOWN_UNIT_COST = 25.0
DAILY_HOLDING_RATE = 0.20 / 365.25


@dataclass(frozen=True)
class Cleaned:
    """``rows``: kept rows. ``quarantine``: removed rows with ``action`` and
    ``copies``. ``actions``: (action, records) including repairs.
    ``repaired_units``: what value repairs took from the raw unit total.
    ``repaired_cost``: what price repairs added to the raw cost total."""

    table: str
    rows: DataFrame
    quarantine: DataFrame
    actions: DataFrame
    repaired_units: Column | None = None
    repaired_cost: Column | None = None


def exact_duplicates(df: DataFrame) -> DataFrame:
    """Distinct rows with ``copies``: map-side combine collapses hot rows."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("copies"))


def _known(df: DataFrame, column: str, master: DataFrame, key: str, flag_name: str) -> DataFrame:
    """Left join of a presence flag: false for NULL and for orphans."""
    keys = master.select(F.col(key).alias(column)).filter(F.col(column).isNotNull()).distinct()
    marked = df.join(keys.withColumn(flag_name, F.lit(True)), column, "left")
    return marked.withColumn(flag_name, F.coalesce(flag_name, F.lit(False)))


def _count(df: DataFrame, action: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("records_affected")).select(F.lit(action).alias("action"), "records_affected")


def _actions(df: DataFrame, counts: Mapping[str, Column]) -> DataFrame:
    """(action, records_affected) of several counts in one pass."""
    rows = [F.struct(F.lit(action).alias("action"), n.cast("long").alias("records_affected")) for action, n in counts.items()]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def _extra_copies() -> Column:
    return F.coalesce(F.sum(F.col("copies") - 1), F.lit(0))


def clean_demand(demand: DataFrame, dim_product: DataFrame, dim_date: DataFrame) -> Cleaned:
    columns = demand.columns
    base = [c for c in columns if c != "outlier_flag"]
    distinct = exact_duplicates(demand)
    tagged = _known(distinct, "product_id", dim_product, "product_id", "known_product")
    tagged = _known(tagged, "date", dim_date, "date", "known_date")
    tagged = staged(
        tagged.withColumn(
            "action",
            F.when(~F.col("known_product"), "QUARANTINE_NULL_OR_ORPHAN_KEY").when(
                ~F.col("known_date"), "QUARANTINE_INVALID_DATE"
            ),
        ),
        "tagged_demand",
    )
    kept = tagged.filter(F.col("action").isNull())
    negative = F.col("demand_requested") < 0
    clamped = kept.select(
        *[F.greatest(F.col(c), F.lit(0)).alias(c) if c == "demand_requested" else F.col(c) for c in base],
        negative.alias("was_negative"),
    )
    scored = z_scores(clamped, "demand_requested").withColumn(
        "outlier_flag", F.coalesce((F.col("z") > OUTLIER_Z).cast("int"), F.lit(0))
    )
    event = F.coalesce(F.nullif(F.trim("event_id"), F.lit("")), F.lit("NONE"))
    rows = scored.withColumn("event_id", event).select(*base, "outlier_flag")
    removals = ("QUARANTINE_NULL_OR_ORPHAN_KEY", "QUARANTINE_INVALID_DATE")
    counts = {"DEDUPLICATE": _extra_copies()} | {a: F.count_if(F.col("action") == a) for a in removals}
    counts["REPAIR_NEGATIVE_VALUE"] = F.count_if(F.col("action").isNull() & negative)
    flagged = _count(scored.filter(F.col("outlier_flag") == 1), "ANNOTATE_OUTLIER")
    actions = _actions(tagged, counts).unionByName(flagged)
    removed = tagged.filter(F.col("action").isNotNull()).select(*columns, "action", F.col("copies"))
    copies = tagged.filter(F.col("copies") > 1).select(
        *columns, F.lit("DEDUPLICATE").alias("action"), (F.col("copies") - 1).alias("copies")
    )
    quarantine = removed.withColumn("copies", F.lit(1).cast("long")).unionByName(copies)
    taken = kept.agg(F.coalesce(F.sum(F.when(negative, F.col("demand_requested"))), F.lit(0)).cast("double")).scalar()
    return Cleaned("fact_demand", rows, quarantine, actions, taken)


def clean_purchase_orders(
    orders: DataFrame, dim_supplier: DataFrame, dim_product: DataFrame, first_by: Sequence[str]
) -> Cleaned:
    """``first_by``: the columns whose order decides which of two conflicting
    rows of one po_id came first (file order has no meaning on a cluster).

    Only ids that come more than once can have copies or conflicts. They are
    found on the ids alone, and only their rows are shuffled to be counted and
    ranked; all others pass as they are, with one copy."""
    columns = orders.columns
    repeated = staged(
        orders.groupBy(F.col("po_id").alias("_repeated")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_repeated"), "repeated_orders"
    )
    again = F.col("po_id").eqNullSafe(F.col("_repeated"))
    single = orders.join(repeated, again, "left_anti").withColumn("copies", F.lit(1).cast("long"))
    several = staged(exact_duplicates(orders.join(repeated, again, "left_semi")), "distinct_orders")
    order = Window.partitionBy("po_id").orderBy(*first_by)
    # The rank filter lets Spark keep one row per key before the shuffle.
    first = staged(several.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") == 1).drop("rn"), "first_orders")
    tagged = _known(single.unionByName(first), "supplier_id", dim_supplier, "supplier_id", "known_supplier")
    kept = tagged.filter(F.col("known_supplier"))
    master = dim_product.select("product_id", F.col("unit_cost").alias("master_cost"))
    bad_cost = F.col("unit_cost") <= 0
    cost = F.when(bad_cost, F.coalesce("master_cost", F.lit(UNKNOWN_UNIT_COST))).otherwise(F.col("unit_cost"))
    total = F.when(bad_cost, half_even(F.col("quantity_received") * cost, 2)).otherwise(
        F.col("total_procurement_cost")
    )
    rows = kept.join(master, "product_id", "left").select(
        *[
            {"unit_cost": cost, "total_procurement_cost": total}.get(c, F.col(c)).alias(c)
            for c in columns
        ]
    )
    before = several.agg(F.struct(_extra_copies().alias("copies"), F.count(F.lit(1)).alias("rows"))).scalar()
    ranked_first = first.agg(F.count(F.lit(1))).scalar()
    actions = _actions(
        tagged,
        {
            "DEDUPLICATE": F.coalesce(F.first(before["copies"]), F.lit(0)),
            "DEDUPLICATE_PRIMARY_KEY": F.coalesce(F.first(before["rows"]), F.lit(0)) - F.coalesce(F.first(ranked_first), F.lit(0)),
            "QUARANTINE_NULL_OR_ORPHAN_KEY": F.count_if(~F.col("known_supplier")),
            "REPAIR_NEGATIVE_PRICE": F.count_if(F.col("known_supplier") & bad_cost),
        },
    )
    # Everything that is not its key's first row, found by a join with the first
    # rows: a key with very many conflicting rows is then split by the skew
    # handling of the join instead of being ranked by one task.
    chosen = first.select(F.col("po_id").alias("_key"), F.struct(*columns).alias("_chosen"))
    later = several.join(chosen, F.col("po_id").eqNullSafe(F.col("_key"))).filter(
        ~F.struct(*columns).eqNullSafe(F.col("_chosen"))
    )
    one = F.lit(1).cast("long")
    quarantine = reduce(
        DataFrame.unionByName,
        [
            tagged.filter(~F.col("known_supplier")).select(
                *columns, F.lit("QUARANTINE_NULL_OR_ORPHAN_KEY").alias("action"), one.alias("copies")
            ),
            later.select(*columns, F.lit("DEDUPLICATE_PRIMARY_KEY").alias("action"), one.alias("copies")),
            several.filter(F.col("copies") > 1).select(
                *columns, F.lit("DEDUPLICATE").alias("action"), (F.col("copies") - 1).alias("copies")
            ),
        ],
    )
    # From the orders before the repair, with one price a product, so cost that the repair invents or loses shows.
    prices = master.groupBy("product_id").agg(F.min("master_cost").alias("price"))
    faulty = kept.filter(bad_cost).join(prices, "product_id", "left")
    owed = half_even(F.col("quantity_received") * F.coalesce("price", F.lit(UNKNOWN_UNIT_COST)), 2)
    change = F.coalesce(owed, F.lit(0.0)) - F.coalesce("total_procurement_cost", F.lit(0.0))
    added = faulty.agg(F.coalesce(F.sum(change), F.lit(0.0))).scalar()
    return Cleaned("fact_purchase_orders", rows, quarantine, actions, repaired_cost=added)


def clean_inventory(ledger: DataFrame, dim_product: DataFrame) -> Cleaned:
    """Re-derive ending stock from the balance equation.

    One bad row makes every row's stock and holding cost be rewritten, as
    published; rows that already balance keep their ending stock that way.
    """
    columns = ledger.columns
    distinct = staged(exact_duplicates(ledger), "distinct_inventory")
    balance = F.greatest(
        F.col("beginning_inventory") + F.col("po_received") - F.col("demand_fulfilled"), F.lit(0)
    )
    bad = (F.col("ending_inventory") < 0) | (F.col("ending_inventory") != balance)
    any_bad = distinct.agg(F.coalesce(F.bool_or(bad), F.lit(False))).scalar()
    costs = dim_product.select("product_id", F.col("unit_cost").alias("master_cost"))
    holding = half_even(balance * F.col("master_cost") * DAILY_HOLDING_RATE, 4)
    fixed = {
        "ending_inventory": F.when(any_bad, balance).otherwise(F.col("ending_inventory")),
        "holding_cost": F.when(any_bad, holding).otherwise(F.col("holding_cost")),
    }
    rows = distinct.join(costs, "product_id", "left").select(*[fixed.get(c, F.col(c)).alias(c) for c in columns])
    actions = _actions(distinct, {"DEDUPLICATE": _extra_copies(), "REPAIR_INVENTORY_BALANCE": F.count_if(bad)})
    quarantine = distinct.filter(F.col("copies") > 1).select(
        *columns, F.lit("DEDUPLICATE").alias("action"), (F.col("copies") - 1).alias("copies")
    )
    return Cleaned("fact_inventory", rows, quarantine, actions)


def clean_transport(transport: DataFrame, clean_orders: DataFrame) -> Cleaned:
    valid = clean_orders.select("po_id")
    orphans = transport.join(valid, "po_id", "left_anti").select(*transport.columns)
    return Cleaned(
        "fact_transport",
        transport.join(valid, "po_id", "left_semi").select(*transport.columns),
        orphans.select(
            *transport.columns,
            F.lit("QUARANTINE_ORPHAN_TRANSPORT").alias("action"),
            F.lit(1).cast("long").alias("copies"),
        ),
        _count(orphans, "QUARANTINE_ORPHAN_TRANSPORT"),
    )


def audit_trail(details: Mapping[str, Cleaned]) -> DataFrame:
    """One row per action that affected any record."""
    parts = []
    for table, cleaned in details.items():
        rule, reason, disposition = (
            F.create_map(*[F.lit(v) for action, info in ACTIONS[table].items() for v in (action, info[i])])
            for i in range(3)
        )
        parts.append(
            cleaned.actions.filter(F.col("records_affected") > 0).select(
                F.lit(table).alias("table_name"),
                "action",
                F.col("records_affected").cast("long").alias("records_affected"),
                rule[F.col("action")].alias("rule_id"),
                reason[F.col("action")].alias("reason"),
                disposition[F.col("action")].alias("disposition"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def cleaning_summary(
    before: Mapping[str, DataFrame], after: Mapping[str, DataFrame], trail: DataFrame
) -> DataFrame:
    """Rows before and after per table, and the three disposition totals."""
    facts = ("fact_demand", "fact_inventory", "fact_purchase_orders", "fact_transport")
    n = F.count(F.lit(1))
    counts = [before[t].agg(n).scalar().alias(f"{t}_before") for t in facts] + [
        after[t].agg(n).scalar().alias(f"{t}_after") for t in facts
    ]
    retained = reduce(lambda a, b: a + b, [df.agg(n).scalar() for df in after.values()])

    def total(disposition: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("disposition") == disposition, F.col("records_affected"))), F.lit(0))

    return trail.agg(
        total(REMOVED).alias("records_removed"),
        total(REPAIRED).alias("records_repaired"),
        n.alias("audit_actions_count"),
    ).select(*counts, "records_removed", "records_repaired", retained.alias("records_retained"), "audit_actions_count")
