"""The whole rule set, compiled to one pass for each table.

A table's rules become conditions on its rows. Rows are counted by key (or as
whole rows, where that is the duplicate rule), which gives duplicates and all
other counts from the same scan. What breaks a rule leaves the pass as
(rule, table, column, row key, records), summed for each key and written once.
Counts are sums over that table; samples are the five smallest keys, which
Spark ranks in every task before it ranks what is left.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supplyspark.functions.exprs import is_null_like, iso_date
from supplyspark.operators import quality as Q
from supplyspark.session import staged

# What names a row of each table in samples.
ROW_KEYS = {
    "dim_product": ("product_id",),
    "dim_supplier": ("supplier_id",),
    "dim_warehouse": ("warehouse_id",),
    "dim_date": ("date",),
    "fact_demand": ("date", "product_id", "warehouse_id", "market_id"),
    "fact_inventory": ("date", "product_id", "warehouse_id"),
    "fact_purchase_orders": ("po_id",),
    "fact_transport": ("transport_id",),
}
SERIES = ("product_id", "warehouse_id")  # of demand, for continuity
VIOLATIONS = ("rule_id", "table_name", "column_name", "row_key", "records")


def key_text(columns: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


@dataclass(frozen=True)
class Rule:
    rule_id: str
    column: str
    broken: Column


def row_rules(table: str, years: tuple[int, int]) -> list[Rule]:
    """The rules of a table that look at one row at a time."""
    out = [Rule("DQ-001", c, is_null_like(c)) for c in Q.NOT_NULL_COLUMNS.get(table, ())]
    for c in Q.DATE_COLUMNS.get(table, ()):
        text = F.col(c).cast("string")
        day = iso_date(text)
        out.append(Rule("DQ-002", c, text.isNotNull() & (day.isNull() | ~F.year(day).between(*years))))
    out += [Rule("DQ-004", c, F.col(c).try_cast("double") < 0) for c in Q.NON_NEGATIVE_COLUMNS.get(table, ())]
    return out


def _with_parents(rows: DataFrame, table: str, tables: Mapping[str, DataFrame]) -> tuple[DataFrame, list[Rule]]:
    """A flag for each foreign key of the table. Spark broadcasts small parents and splits hot keys of others."""
    rules = []
    for child, fk, parent, pk in Q.REFERENCES:
        if child == table:
            flag = f"_known_{fk}"
            keys = tables[parent].select(F.col(pk).alias(fk)).filter(F.col(fk).isNotNull()).distinct()
            rows = rows.join(keys.withColumn(flag, F.lit(True)), fk, "left")
            rules.append(Rule("DQ-005", fk, F.col(fk).isNotNull() & F.col(flag).isNull()))
    return rows, rules


def whole_rows(df: DataFrame) -> DataFrame:
    """Distinct rows with ``_n``, how often each occurs."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))


def table_violations(table: str, df: DataFrame, tables: Mapping[str, DataFrame], years: tuple[int, int]) -> DataFrame:
    """All broken rules of one table but those over series. ``df`` may come with ``_n``, if rows stand for several."""
    counted = "_n" in df.columns
    rows, references = _with_parents(df, table, tables)
    rules = row_rules(table, years) + references
    keys = Q.DUPLICATE_KEYS.get(table, ())
    n = F.col("_n") if counted else F.lit(1)
    if keys:
        broken = [F.sum(F.when(r.broken, n).otherwise(F.lit(0))).alias(f"_b{i}") for i, r in enumerate(rules)]
        rows = rows.groupBy(*keys).agg(F.sum(n).alias("_n"), *broken)
        records = [F.col(f"_b{i}") for i in range(len(rules))]
    else:
        records = [F.when(r.broken, n).otherwise(F.lit(0)).cast("long") for r in rules]
    cells = [(r.rule_id, r.column, x) for r, x in zip(rules, records, strict=True)]
    if keys or keys is None:
        cells.append(("DQ-003", ", ".join(keys) if keys else "ALL", F.col("_n") - 1))
    # Most rows break nothing: they are dropped by a plain condition, before any cell is built for them.
    rows = rows.filter(F.greatest(F.lit(0), *[x for _, _, x in cells]) > 0)
    structs = [F.struct(F.lit(i).alias("rule_id"), F.lit(c).alias("column_name"), x.cast("long").alias("records")) for i, c, x in cells]
    found = F.filter(F.array(*structs), lambda cell: cell["records"] > 0)
    named = rows.select(key_text(ROW_KEYS[table]).alias("row_key"), found.alias("cells")).filter(F.size("cells") > 0)
    return named.select("row_key", F.inline("cells")).select(
        "rule_id", F.lit(table).alias("table_name"), "column_name", "row_key", "records"
    )


def series_violations(demand: DataFrame, expected_days: int | Column, limit: float = Q.Z_LIMIT) -> DataFrame:
    """Series with missing days, and values far from their product's mean; ``demand`` has ``_n``."""
    wanted = expected_days if isinstance(expected_days, Column) else F.lit(expected_days)
    short = demand.groupBy(*SERIES).agg(F.countDistinct("date").alias("days")).filter(F.col("days") < wanted)
    gaps = short.select(
        F.lit("DQ-006").alias("rule_id"), F.lit("fact_demand").alias("table_name"), F.lit("date").alias("column_name"),
        key_text(SERIES).alias("row_key"), F.lit(1).cast("long").alias("records"),
    )
    x = F.coalesce(F.col("demand_requested").try_cast("double"), F.lit(0.0))
    n, total, squares = F.sum("_n"), F.sum(x * F.col("_n")), F.sum(x * x * F.col("_n"))
    spread = F.sqrt(F.greatest(F.lit(0.0), squares - total * total / n) / F.nullif(n - 1, F.lit(0)))
    stats = demand.groupBy("product_id").agg((total / n).alias("_mean"), spread.alias("_std"))
    scored = demand.join(stats, "product_id", "left")
    z = (x - F.col("_mean")) / F.when(F.col("_std") > 0, F.col("_std")).otherwise(1.0)
    outliers = scored.filter(F.abs(z) > limit).select(
        F.lit("DQ-007").alias("rule_id"), F.lit("fact_demand").alias("table_name"), F.lit("demand_requested").alias("column_name"),
        key_text(ROW_KEYS["fact_demand"]).alias("row_key"), F.col("_n").alias("records"),
    )
    return gaps.unionByName(outliers)


def violations(tables: Mapping[str, DataFrame], years: tuple[int, int], expected_days: int | Column) -> DataFrame:
    """(rule, table, column, row key, records), one row for each key that breaks a rule, written once."""
    demand = staged(whole_rows(tables["fact_demand"]), "demand_rows")
    parts = [table_violations(t, demand if t == "fact_demand" else tables[t], tables, years) for t in ROW_KEYS]
    found = reduce(DataFrame.unionByName, [*parts, series_violations(demand, expected_days)])
    return staged(found.groupBy(*VIOLATIONS[:-1]).agg(F.sum("records").alias("records")), "violations")


def issues(found: DataFrame, sample: int = Q.SAMPLE) -> DataFrame:
    """One row for each rule, table and column that is broken, with up to ``sample`` keys."""
    place = list(VIOLATIONS[:3])
    totals = found.groupBy(*place).agg(F.sum("records").alias("row_count"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(*place).orderBy("row_key"))).filter(F.col("rank") <= sample)
    samples = ranked.groupBy(*place).agg(F.sort_array(F.collect_list("row_key")).alias("samples"))
    named = totals.join(samples, place)

    def fixed(at: int) -> Column:
        return F.create_map(*[F.lit(x) for rule, info in Q.RULES.items() for x in (rule, info[at])])[F.col("rule_id")]

    return named.select(
        "rule_id", fixed(0).alias("rule_name"), "table_name", fixed(1).alias("severity"), "row_count",
        "column_name", "samples", fixed(2).alias("action_suggested"),
    )


def audit(
    tables: Mapping[str, DataFrame], years: tuple[int, int] = Q.YEAR_RANGE, expected_days: int | Column = 731
) -> DataFrame:
    """The whole rule set over a table collection, as one DataFrame of issues.

    Fails if a table or column of any rule is missing, so no rule is left out unseen.
    """
    needed = Q.rule_columns()
    missing = [t for t in needed if t not in tables]
    missing += [f"{t}.{c}" for t in needed if t in tables for c in sorted(needed[t]) if c not in tables[t].columns]
    if missing:
        raise ValueError(f"audit rules without their table or column: {', '.join(missing)}")
    return issues(violations(tables, years, expected_days))
