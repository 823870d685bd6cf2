"""Session settings and lineage cuts.

Nothing here fixes the number of shuffle partitions, broadcast threshold or
memory: those belong to whoever starts the cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
import tempfile
import uuid

from pyarrow.fs import FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the plans rely on.
# Adaptive execution re-plans joins on measured sizes, splits skewed join
# partitions and merges small ones. Joins keep hashing on all their keys: a
# (supplier, day) join must not fall back to the supplier alone, because one
# supplier may hold a third of all orders.
PLAN_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings above to an existing session."""
    for key, value in PLAN_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app_name: str = "supplyspark", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name).config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master)
    for key, value in {**PLAN_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    fallback = tempfile.mkdtemp(prefix="supplyspark-")
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


def staged(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once to the shared folder, in folders by ``partition_by``, and read it back.

    Used where a table is consumed by several later jobs (model training,
    leakage comparison), so that losing an executor costs a re-read of Parquet
    instead of a re-run of the whole lineage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage/{name}-{uuid.uuid4().hex}"
    _staged_paths.append(path)
    df.write.partitionBy(*partition_by).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_staged_paths: list[str] = []


def release_staged() -> int:
    """Remove every folder that ``staged`` has written in this process; returns how many.

    For the end of a session: results that still read them can't be used afterwards.
    """
    removed = 0
    while _staged_paths:
        path = _staged_paths.pop()
        store, place = FileSystem.from_uri(path if ":" in path else f"file://{path}")
        if store.get_file_info(place).type == FileType.Directory:
            store.delete_dir(place)
            removed += 1
    return removed


class staged_property:
    """A derived table that is written once, on first use, and then re-read.

    For tables that many later jobs share: the owner's next reads start from
    Parquet instead of repeating the whole derivation.
    """

    def __init__(self, build: Callable):
        self.build = build
        self.name = build.__name__
        self.__doc__ = build.__doc__

    def __get__(self, owner, owner_type=None):
        if owner is None:
            return self
        if self.name not in owner.__dict__:
            owner.__dict__[self.name] = staged(self.build(owner), self.name)
        return owner.__dict__[self.name]
