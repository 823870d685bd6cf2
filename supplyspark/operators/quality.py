"""Data-quality rules. Each returns issue rows of one shape, none when clean.

Rules over the same table are counted in one pass: the per-column counts are
aggregated together and unpivoted afterwards. Samples are the five smallest
row keys, found with a top-n, not by gathering the offending rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplyspark.functions.exprs import is_null_like, iso_date

ERROR, WARNING, INFO = "ERROR", "WARNING", "INFO"

# Rule id, name, severity and suggested action.
RULES = {
    "DQ-001": ("NOT_NULL_KEYS", ERROR, "Quarantine and remove records with missing mandatory identifiers."),
    "DQ-002": ("VALID_DATE_FORMAT", ERROR, "Quarantine unparseable dates or restore from primary calendar if deterministic."),
    "DQ-003": ("NO_DUPLICATE_ROWS", ERROR, "Deduplicate records, retaining first authenticated entry."),
    "DQ-004": ("NON_NEGATIVE_NUMERICS", ERROR, "Repair by zero-clamping or absolute correction, logging the adjustment."),
    "DQ-005": ("REFERENTIAL_INTEGRITY", ERROR, "Quarantine orphan records that cannot be joined to master dimensions."),
    "DQ-006": ("TEMPORAL_CONTINUITY", WARNING, "Re-index to continuous calendar, forward-filling or imputing missing daily observations."),
    "DQ-007": ("STATISTICAL_OUTLIERS", WARNING, "Flag for anomaly analysis; do not remove valid physical demand spikes."),
}
YEAR_RANGE = (2020, 2030)
Z_LIMIT = 4.5
SAMPLE = 5


def issue_rows(counts: DataFrame, rule_id: str, table: str) -> DataFrame:
    """From (column_name, row_count, samples) to full issue rows, zero counts dropped."""
    name, severity, action = RULES[rule_id]
    return counts.filter(F.col("row_count") > 0).select(
        F.lit(rule_id).alias("rule_id"),
        F.lit(name).alias("rule_name"),
        F.lit(table).alias("table_name"),
        F.lit(severity).alias("severity"),
        F.col("row_count").cast("long").alias("row_count"),
        F.col("column_name"),
        F.col("samples"),
        F.lit(action).alias("action_suggested"),
    )


def first_keys(df: DataFrame, key: Column, n: int = SAMPLE) -> Column:
    """The ``n`` smallest keys as one array value.

    A distributed top-n keeps at most ``n`` rows per task, so it does not
    matter how many rows break the rule.
    """
    top = df.select(key.cast("string").alias("k")).orderBy("k").limit(n)
    return top.agg(F.sort_array(F.collect_list("k"))).scalar()


def no_samples() -> Column:
    return F.array().cast("array<string>")


def count_per_column(df: DataFrame, bad: Mapping[str, Column], row_key: str | None = None) -> DataFrame:
    """How many rows break each column's condition: one pass for all columns.

    With ``row_key`` each column also gets the five smallest offending keys.
    """
    counts = df.agg(*[F.count_if(condition).alias(f"n{i}") for i, condition in enumerate(bad.values())])
    pairs = []
    for i, (name, condition) in enumerate(bad.items()):
        samples = no_samples() if row_key is None else first_keys(df.filter(condition), F.col(row_key))
        pairs.append(
            F.struct(F.lit(name).alias("column_name"), F.col(f"n{i}").alias("row_count"), samples.alias("samples"))
        )
    return counts.select(F.inline(F.array(*pairs)))


def check_not_null(df: DataFrame, table: str, columns: Sequence[str], row_key: str | None = None) -> DataFrame:
    bad = {c: is_null_like(c) for c in columns if c in df.columns}
    return issue_rows(count_per_column(df, bad, row_key), "DQ-001", table)


def check_valid_dates(
    df: DataFrame, table: str, columns: Sequence[str], row_key: str | None = None, years: tuple[int, int] = YEAR_RANGE
) -> DataFrame:
    """Not a strict ISO date, or a year out of range; a NULL is not counted here."""
    bad = {}
    for c in columns:
        if c in df.columns:
            text = F.col(c).cast("string")
            parsed = iso_date(text)
            bad[c] = text.isNotNull() & (parsed.isNull() | ~F.year(parsed).between(*years))
    return issue_rows(count_per_column(df, bad, row_key), "DQ-002", table)


def check_non_negative(df: DataFrame, table: str, columns: Sequence[str], row_key: str | None = None) -> DataFrame:
    bad = {
        c: F.coalesce(F.col(c).try_cast("double") < 0, F.lit(False)) for c in columns if c in df.columns
    }
    return issue_rows(count_per_column(df, bad, row_key), "DQ-004", table)


def check_duplicates(df: DataFrame, table: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows beyond the first of each key (or of each whole row)."""
    keys = list(columns) if columns else df.columns
    extra = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("row_count"))
    )
    label = ", ".join(columns) if columns else "ALL"
    rows = extra.select(
        F.lit(label).alias("column_name"), "row_count", no_samples().alias("samples")
    )
    return issue_rows(rows, "DQ-003", table)


def check_referential(
    child: DataFrame, table: str, fk: str, parent: DataFrame, pk: str, row_key: str | None = None
) -> DataFrame:
    """Non-null foreign keys without a parent.

    The child is counted per key first: a key that a third of the rows share
    reaches the join as one row.
    """
    keys = child.filter(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("fk")).agg(F.count(F.lit(1)).alias("n"))
    parents = parent.select(F.col(pk).alias("fk")).filter(F.col("fk").isNotNull())
    orphans = keys.join(parents, "fk", "left_anti")
    samples = no_samples()
    if row_key is not None:
        rows_of = child.select(F.col(fk).alias("fk"), F.col(row_key).alias("_key"))
        samples = first_keys(rows_of.join(orphans, "fk", "left_semi"), F.col("_key"))
    rows = orphans.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count")).select(
        F.lit(fk).alias("column_name"), "row_count", samples.alias("samples")
    )
    return issue_rows(rows, "DQ-005", table)


def check_continuity(
    df: DataFrame, table: str, keys: Sequence[str], date_column: str = "date", expected_days: int | Column = 731
) -> DataFrame:
    """Entities with fewer distinct dates than expected."""
    wanted = expected_days if isinstance(expected_days, Column) else F.lit(expected_days)
    short = (
        df.groupBy(*keys)
        .agg(F.countDistinct(date_column).alias("n_days"))
        .filter(F.col("n_days") < wanted)
    )
    samples = first_keys(short, F.concat_ws("|", *keys))
    rows = short.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(date_column).alias("column_name"), "row_count", samples.alias("samples")
    )
    return issue_rows(rows, "DQ-006", table)


def z_scores(df: DataFrame, value: str, group: str | None = None) -> DataFrame:
    """Rows with ``z``; per-group mean and deviation are aggregated, then joined.

    An aggregate with a join, not a whole-group window: a product that holds a
    third of the rows is then summed on all executors.
    """
    x = F.coalesce(F.col(value).try_cast("double"), F.lit(0.0))
    stats = [F.avg(x).alias("_mean"), F.stddev_samp(x).alias("_std")]
    spread = F.when(F.col("_std") > 0, F.col("_std")).otherwise(1.0)
    if group is None:
        s = df.agg(F.struct(*stats)).scalar()
        out = df.withColumn("_mean", s["_mean"]).withColumn("_std", s["_std"])
    else:
        out = df.join(df.groupBy(group).agg(*stats), group, "left")
    return out.withColumn("z", (x - F.col("_mean")) / spread).drop("_mean", "_std")


def check_outliers(
    df: DataFrame, table: str, value: str, group: str | None = None, limit: float = Z_LIMIT, row_key: str | None = None
) -> DataFrame:
    scored = z_scores(df, value, group)
    return issue_rows(count_per_column(scored, {value: F.abs("z") > limit}, row_key), "DQ-007", table)


# --------------------------------------------------------------- whole audit
# Which rule runs on which table and columns.
NOT_NULL_COLUMNS = {
    "dim_product": ("product_id", "product_name", "category"),
    "dim_supplier": ("supplier_id", "supplier_name"),
    "dim_warehouse": ("warehouse_id", "warehouse_name"),
    "fact_demand": ("date", "product_id", "warehouse_id", "market_id"),
    "fact_inventory": ("date", "product_id", "warehouse_id"),
    "fact_purchase_orders": ("po_id", "order_date", "supplier_id", "product_id"),
    "fact_transport": ("transport_id", "po_id"),
}
DATE_COLUMNS = {
    "dim_date": ("date",),
    "fact_demand": ("date",),
    "fact_inventory": ("date",),
    "fact_purchase_orders": ("order_date", "actual_delivery_date"),
}
DUPLICATE_KEYS = {
    "dim_product": ("product_id",),
    "dim_supplier": ("supplier_id",),
    "fact_demand": None,
    "fact_inventory": ("date", "product_id", "warehouse_id"),
    "fact_purchase_orders": ("po_id",),
}
NON_NEGATIVE_COLUMNS = {
    "dim_product": ("unit_cost", "selling_price", "base_demand"),
    "fact_demand": ("demand_requested",),
    "fact_inventory": ("beginning_inventory", "ending_inventory", "holding_cost"),
    "fact_purchase_orders": ("quantity_ordered", "unit_cost", "total_procurement_cost"),
}
REFERENCES = (
    ("fact_demand", "product_id", "dim_product", "product_id"),
    ("fact_demand", "warehouse_id", "dim_warehouse", "warehouse_id"),
    ("fact_inventory", "product_id", "dim_product", "product_id"),
    ("fact_inventory", "warehouse_id", "dim_warehouse", "warehouse_id"),
    ("fact_purchase_orders", "product_id", "dim_product", "product_id"),
    ("fact_purchase_orders", "supplier_id", "dim_supplier", "supplier_id"),
    ("fact_transport", "po_id", "fact_purchase_orders", "po_id"),
)


def rule_columns() -> dict[str, set[str]]:
    """Every table the audit reads, with the columns its rules name."""
    pairs = [
        (t, c)
        for rule in (NOT_NULL_COLUMNS, DATE_COLUMNS, DUPLICATE_KEYS, NON_NEGATIVE_COLUMNS)
        for t, columns in rule.items()
        for c in columns or ()
    ]
    pairs += [pair for t, fk, p, pk in REFERENCES for pair in ((t, fk), (p, pk))]
    out: dict[str, set[str]] = {}
    for t, c in pairs:
        out.setdefault(t, set()).add(c)
    return out


def severity_totals(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows per phase and severity, with the final verdict on errors."""
    both = before.select(F.lit("before").alias("phase"), "severity", "row_count").unionByName(
        after.select(F.lit("after").alias("phase"), "severity", "row_count")
    )
    return both.groupBy("phase", "severity").agg(F.sum("row_count").alias("row_count"))


def verdict(after: DataFrame) -> DataFrame:
    errors = F.coalesce(F.sum(F.when(F.col("severity") == ERROR, F.col("row_count"))), F.lit(0))
    return after.agg(
        errors.alias("error_rows"),
        F.when(errors == 0, "PASSED (Zero Critical Errors)").otherwise("FAILED").alias("overall_status"),
    )


def row_digest(df: DataFrame) -> list[Column]:
    """128 bits of a whole row. Hashes pass over nulls, so which values are null is hashed as well; -0.0 equals 0.0."""
    values = [F.col(f"`{c}`") + F.lit(0.0).cast(t) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes]
    nulls = [F.col(f"`{c}`").isNull() for c in df.columns]
    return [F.xxhash64(F.lit(k), *values, *nulls).alias(f"_digest{k}") for k in range(2)]


def profile(df: DataFrame, table: str) -> DataFrame:
    """Rows, columns, missing cells and duplicate rows of one table.

    Equal rows are counted on digests: whole rows, nearly all of them different, are not shuffled."""
    missing = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in df.columns])
    counted = df.groupBy(*row_digest(df)).agg(F.count(F.lit(1)).alias("_n"))
    dup = counted.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0))).scalar()
    n_columns = len(df.columns)
    base = df.agg(F.count(F.lit(1)).alias("rows"), missing.alias("missing_cells")).withColumn("duplicate_rows", dup)
    cells = F.greatest(F.lit(1), F.col("rows") * n_columns)
    return base.select(
        F.lit(table).alias("table_name"),
        "rows",
        F.lit(n_columns).alias("columns"),
        "missing_cells",
        (F.col("missing_cells") / cells * 100.0).alias("missing_pct"),
        "duplicate_rows",
        (F.col("duplicate_rows") / F.greatest(F.lit(1), F.col("rows")) * 100.0).alias("duplicate_pct"),
    )


def profile_all(tables: Mapping[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [profile(df, name) for name, df in tables.items()])


def compare_profiles(before: DataFrame, after: DataFrame) -> DataFrame:
    measures = ("rows", "missing_cells", "missing_pct", "duplicate_rows", "duplicate_pct")
    left = before.select("table_name", *[F.col(c).alias(f"before_{c}") for c in measures])
    right = after.select("table_name", *[F.col(c).alias(f"after_{c}") for c in measures])
    return left.join(right, "table_name", "full")


# ------------------------------------------------------ declared constraints
def foreign_key_check(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Violations of every declared foreign key (one row each, zero included)."""
    from supplyspark.sources.schemas import SPECS

    rows = []
    for name, df in tables.items():
        for fk, parent, pk in SPECS[name].foreign_keys:
            if parent not in tables:
                continue
            keys = df.filter(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("fk")).agg(F.count(F.lit(1)).alias("n"))
            rows.append(
                keys.join(tables[parent].select(F.col(pk).alias("fk")), "fk", "left_anti")
                .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations"))
                .select(
                    F.lit(name).alias("child_table"),
                    F.lit(fk).alias("foreign_key"),
                    F.lit(parent).alias("parent_table"),
                    "violations",
                )
            )
    return reduce(DataFrame.unionByName, rows)


def declared_key_check(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Primary-key duplicates and NULLs in required columns, per table."""
    from supplyspark.sources.schemas import SPECS

    rows = []
    for name, df in tables.items():
        spec = SPECS[name]
        required = [c for c in spec.not_null if c in df.columns]
        nulls = df.agg(
            reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in required]).alias("null_cells")
        )
        if spec.key:
            dup = (
                df.groupBy(*spec.key)
                .agg(F.count(F.lit(1)).alias("n"))
                .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)))
                .scalar()
            )
        else:
            dup = F.lit(0).cast("long")
        rows.append(
            nulls.select(
                F.lit(name).alias("table_name"),
                F.lit(", ".join(spec.key)).alias("primary_key"),
                "null_cells",
                dup.alias("duplicate_keys"),
            )
        )
    return reduce(DataFrame.unionByName, rows)
