"""Readers and writers for the star schema and the tables derived from it."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from supplyspark.functions.exprs import year_month
from supplyspark.session import staged
from supplyspark.sources.schemas import SPECS, text_schema

MONTH = "month_key"


# ------------------------------------------------------------------- reading
def read_csv_tables(
    spark: SparkSession, folder: str, as_text: bool = True, names: Iterable[str] = tuple(SPECS)
) -> dict[str, DataFrame]:
    """Header CSVs of a folder (all ten tables by default), by table name."""
    return {
        name: spark.read.schema(text_schema(name) if as_text else SPECS[name].schema)
        .option("header", True)
        .option("dateFormat", "yyyy-MM-dd")
        .csv(f"{folder}/{name}.csv")
        for name in names
    }


REJECTED = "_rejected_line"


def read_csv_checked(spark: SparkSession, path: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Typed rows of one header CSV, and the lines that don't fit its schema.

    A line with too few or too many fields, or with a value of the wrong type,
    is kept whole instead of turning into NULLs. Both results come from one
    written parse, so no line is lost or read as both.
    """
    schema = SPECS[name].schema
    nullable = StructType([StructField(f.name, f.dataType, True) for f in schema] + [StructField(REJECTED, StringType(), True)])
    parsed = (
        spark.read.schema(nullable)
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", REJECTED)
        .option("dateFormat", "yyyy-MM-dd")
        .csv(path)
    )
    parsed = staged(parsed, f"parsed_{name}")
    good = parsed.filter(F.col(REJECTED).isNull()).drop(REJECTED)
    bad = parsed.filter(F.col(REJECTED).isNotNull()).select(F.lit(name).alias("table_name"), F.col(REJECTED).alias("line"))
    return good, bad


def rejected_actions(bad: DataFrame) -> DataFrame:
    """Rejected lines as rows of the audit trail."""
    return bad.groupBy("table_name").agg(F.count(F.lit(1)).alias("records_affected")).select(
        "table_name",
        F.lit("REJECT_MALFORMED_LINE").alias("action"),
        "records_affected",
        F.lit("DQ-002").alias("rule_id"),
        F.lit("Kept lines that do not fit the table's columns and types out of the table.").alias("reason"),
        F.lit("REMOVED").alias("disposition"),
    )


def read_parquet(spark: SparkSession, path: str, columns: Iterable[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_table(spark: SparkSession, name: str, **equals: object) -> DataFrame:
    """Full table, or the rows where every given column equals its value."""
    df = spark.table(name)
    for column, value in equals.items():
        if value is not None:
            df = df.filter(F.col(column) == F.lit(value))
    return df


def scan_equal(df: DataFrame, **equals: object) -> DataFrame:
    """Parameterised scan: ``None`` means no restriction on that column."""
    for column, value in equals.items():
        if value is not None:
            df = df.filter(F.col(column) == F.lit(value))
    return df


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def read_parquet_or_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Parquet files when they are there, else the catalog table."""
    if path_exists(spark, path):
        return spark.read.parquet(path)
    if spark.catalog.tableExists(table):
        return spark.table(table)
    raise FileNotFoundError(f"neither {path} nor table {table} exists")


def literal_rows(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A few constant rows as a plan literal: no Python worker, no extra job."""
    fields = [part.strip().split(" ") for part in schema.split(",")]
    structs = [
        F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(row, fields)]) for row in rows
    ]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*structs)))


# ------------------------------------------------------------------- writing
def write_parquet(df: DataFrame, path: str, date_column: str | None = None, mode: str = "overwrite") -> None:
    """Parquet, partitioned by month when a date column is named.

    Rows are dealt by month, and Spark splits a month that holds more than its
    advisory partition size and merges small ones: each month becomes a few
    large files instead of one per task, however heavy it is.
    """
    if date_column is None:
        df.write.mode(mode).parquet(path)
        return
    out = df.withColumn(MONTH, year_month(date_column))
    out.hint("rebalance", F.col(MONTH)).write.mode(mode).partitionBy(MONTH).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", compression: str = "none") -> None:
    """Header CSV, by default not compressed. A gzip file is read back by one task; there are as many as writing tasks."""
    writer = df.write.mode(mode).option("header", True).option("compression", compression)
    writer.option("zlib.compress.level", "BEST_SPEED").csv(path)


def append_parquet(df: DataFrame, path: str, date_column: str | None = None) -> None:
    write_parquet(df, path, date_column, mode="append")


def rebuild_table(df: DataFrame, name: str) -> None:
    """Drop-and-rebuild a materialized rollup."""
    df.write.mode("overwrite").format("parquet").saveAsTable(name)


def publish_views(views: Mapping[str, DataFrame]) -> None:
    for name, df in views.items():
        df.createOrReplaceTempView(name)


def write_manifest(df: DataFrame, path: str) -> None:
    """A small aggregated result as JSON lines."""
    df.write.mode("overwrite").json(path)


def as_manifest(df: DataFrame, column: str = "manifest") -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias(column))


# ---------------------------------------------------------------- table tools
def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    counts = [
        df.groupBy().agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def with_default_member(dim: DataFrame, default: DataFrame, key: str) -> DataFrame:
    """Add the default dimension member unless its key is already there."""
    missing = default.join(dim.select(key), key, "left_anti")
    return dim.unionByName(missing.select(*dim.columns), allowMissingColumns=True)


# Tables cut by date in a recent-slice extract, with their date column.
SLICED = {
    "analytics_operational_exposure": "date",
    "analytics_inventory_risk": "date",
    "analytics_daily_demand": "date",
    "analytics_inventory_health": "date",
    "fact_purchase_orders": "order_date",
    "fact_demand": "date",
    "fact_inventory": "date",
}


def recent_slice(tables: Mapping[str, DataFrame], cutoff: str) -> dict[str, DataFrame]:
    """Dimensions and summaries whole, large tables from ``cutoff`` on, and
    transport rows of the purchase orders that remain."""
    since = F.to_date(F.lit(cutoff))
    out = {
        name: df.filter(F.col(SLICED[name]) >= since) if name in SLICED else df
        for name, df in tables.items()
        if name != "fact_transport"
    }
    if "fact_transport" in tables:
        recent_orders = out["fact_purchase_orders"].select("po_id")
        out["fact_transport"] = tables["fact_transport"].join(recent_orders, "po_id", "left_semi")
    return out


def write_slice(tables: Mapping[str, DataFrame], folder: str) -> None:
    """Each table of a slice; those cut by date in folders by month, so that later cuts read only what they need."""
    for name, df in tables.items():
        write_parquet(df, f"{folder}/{name}", SLICED.get(name))


def read_slice(spark: SparkSession, folder: str, name: str, since: str | None = None) -> DataFrame:
    """A table of a written slice from ``since`` on; earlier months are not read."""
    df = spark.read.parquet(f"{folder}/{name}")
    if since is not None:
        day = F.to_date(F.lit(since))
        df = df.filter((F.col(MONTH) >= year_month(day)) & (F.col(SLICED[name]) >= day))
    return df.drop(MONTH) if MONTH in df.columns else df
