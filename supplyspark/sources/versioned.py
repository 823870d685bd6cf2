"""A keyed table on plain Parquet with upserts that are safe with several writers.

Rows are dealt to a fixed number of buckets by the hash of their key. An upsert
reads and rewrites only the buckets that its rows fall into, under new folders;
then one commit names the folder of every bucket. A commit number can be taken
once, so of two writers that started from the same version one wins. The other
merges again with what the winner left, or fails if told not to. Old versions
stay readable, because no file is ever changed.
"""

from __future__ import annotations

from collections.abc import Sequence
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from supplyspark.sources.commits import CommitConflict, CommitLog

BUCKETS = 16
BUCKET = "_bucket"
SLICE = "_slice"  # of a bucket, so that one bucket is not one task
NEW = "_new"


class VersionedTable:
    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str], buckets: int = BUCKETS):
        self.spark, self.folder, self.keys, self.buckets = spark, folder.rstrip("/"), list(keys), buckets
        self.log = CommitLog(spark, f"{self.folder}/_log")

    def _dealt(self, df: DataFrame) -> DataFrame:
        return df.withColumn(BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _sliced(self, df: DataFrame) -> DataFrame:
        """Dealt by bucket and slice of it, in one shuffle: about as many groups as Spark has shuffle partitions."""
        slices = -(-int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.buckets)
        number = F.pmod(F.shiftright(F.xxhash64(*self.keys), 32), F.lit(slices)).cast("int")
        return self._dealt(df).withColumn(SLICE, number).repartition(BUCKET, SLICE)

    def _doubled(self, new: DataFrame) -> bool:
        """Whether a key comes twice. Only keys whose hash does are compared in full."""
        code = F.xxhash64(*self.keys).alias("_code")
        codes = new.select(code).groupBy("_code").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        if codes.isEmpty():
            return False
        rows = new.select(*self.keys, code).join(codes.select("_code"), "_code", "left_semi")
        return not rows.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()

    def entry(self, version: int | None = None) -> dict:
        """``{"buckets": {number: folder}, "schema": DDL}`` of a version, by default the latest."""
        number = self.log.latest() if version is None else version
        return {"buckets": {}, "schema": None} if number is None else self.log.read(number)

    def read(self, version: int | None = None) -> DataFrame:
        entry = self.entry(version)
        if entry["schema"] is None:
            raise LookupError(f"nothing has been written to {self.folder}")
        return self._read(entry, sorted(entry["buckets"]))

    def _read(self, entry: dict, numbers: Sequence[str]) -> DataFrame:
        paths = [entry["buckets"][n] for n in numbers if n in entry["buckets"]]
        if not paths:
            return self.spark.createDataFrame([], entry["schema"])
        return self.spark.read.schema(entry["schema"]).parquet(*paths)

    def prepare(self, new: DataFrame, base: int | None) -> dict:
        """Merge ``new`` into version ``base`` and write the touched buckets; the entry to commit."""
        if self._doubled(new):
            raise ValueError("rows of an upsert must have distinct keys")
        old = self.entry(base)
        dealt = self._dealt(new)
        touched = sorted(str(r[0]) for r in dealt.select(BUCKET).distinct().collect())  # at most as many as buckets
        merged = new
        if old["schema"] is not None:
            before = self._read(old, touched)
            merged = before.withColumn(NEW, F.lit(0)).unionByName(new.withColumn(NEW, F.lit(1)), allowMissingColumns=True)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in merged.schema if f.name != NEW)
        root = f"{self.folder}/data/{uuid.uuid4().hex}"
        out = self._sliced(merged)
        if old["schema"] is not None:
            # Old and new rows of a key lie in one slice, so the merge needs no shuffle of its own.
            newest = F.max(NEW).over(Window.partitionBy(BUCKET, SLICE, *self.keys))
            out = out.withColumn("_newest", newest).filter(F.col(NEW) == F.col("_newest")).drop(NEW, "_newest")
        out.drop(SLICE).write.partitionBy(BUCKET).option("compression", "zstd").parquet(root)
        return {"buckets": old["buckets"] | {n: f"{root}/{BUCKET}={n}" for n in touched}, "schema": schema, "touched": touched, "base": base}

    def commit(self, entry: dict) -> int:
        """Publish what ``prepare`` wrote. Raises ``CommitConflict`` if its base is no longer the latest version."""
        number = (entry["base"] or 0) + 1
        self.log.put(number, entry)
        return number

    def upsert(self, new: DataFrame, attempts: int = 5) -> int:
        """Replace rows with equal keys and add the others; returns the version.

        A lost race is merged again, up to ``attempts`` times in all.
        """
        for attempt in range(attempts):
            try:
                return self.commit(self.prepare(new, self.log.latest()))
            except CommitConflict:
                if attempt == attempts - 1:
                    raise
        raise AssertionError("unreachable")


def append_once(df: DataFrame, path: str, run_id: str) -> None:
    """Append to a log that has one folder for each run. A repeated run replaces its own rows and no others."""
    out = df.drop("run_id").withColumn("run_id", F.lit(run_id))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def read_log(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All runs of a log; one that never had a row is empty."""
    fields = [f for f in schema if f.name != "run_id"] + [StructField("run_id", StringType(), True)]
    return spark.read.schema(StructType(fields)).parquet(path)
