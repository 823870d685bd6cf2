"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Built-in functions only. A text's full content is hashed only where another
text has the same length and the same prefix. As long as the groups of a level
are few, they go to the scan of the next one and no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplyspark.llm.common import staged

PREFIX_CHARS = 64
# Groups of a level with at most so many rows (24 bytes each) are broadcast to
# the next scan. With more of them the level is a shuffled join, whose hot
# groups Spark splits.
BROADCAST_GROUPS = 500_000


def _narrow(rows: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Leave ``_alive`` true only where the group over ``keys`` has two rows or more."""
    repeated = rows.filter("_alive").groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    repeated = staged(repeated, "repeated")
    hit = repeated.withColumn("_hit", F.lit(True))
    hit = F.broadcast(hit) if repeated.count() <= limit else hit
    return rows.join(hit, keys, "left").withColumn("_alive", F.col("_alive") & F.col("_hit").isNotNull()).drop("_hit")


def refine(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    hash_all: bool = False,
    prefix_chars: int = PREFIX_CHARS,
    broadcast_groups: int = BROADCAST_GROUPS,
) -> tuple[DataFrame, DataFrame]:
    """``docs`` with the level columns ``_bytes``, ``_prefix``, ``_full``, and the groups of equal texts.

    The groups have one row (``_bytes``, ``_prefix``, ``_full``, ``_keep``,
    ``_size``) for each text that two rows or more share; ``_keep`` is the
    largest id. ``hash_all`` hashes the other texts too, for callers that need
    the digest of each. A null text counts as empty; null ids never win
    against others.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumn("_bytes", F.octet_length(text)).withColumn("_alive", F.lit(True))
    rows = _narrow(rows, ["_bytes"], broadcast_groups)
    rows = rows.withColumn("_prefix", F.when(F.col("_alive"), F.xxhash64(F.substring(text, 1, prefix_chars))))
    rows = _narrow(rows, ["_bytes", "_prefix"], broadcast_groups)
    full = F.sha2(text, 256)
    rows = rows.withColumn("_full", full if hash_all else F.when(F.col("_alive"), full))
    groups = (
        rows.filter("_alive")
        .groupBy("_bytes", "_prefix", "_full")
        .agg(F.max(id_col).alias("_keep"), F.count(F.lit(1)).alias("_size"))
        .filter("_size > 1")
    )
    return rows, groups


LEVELS = ["_bytes", "_prefix", "_full"]


def _small(groups: DataFrame, options: dict) -> DataFrame:
    """The groups, to be broadcast if there are few. Else Spark joins and splits the hot ones."""
    groups = staged(groups, "groups")
    few = groups.count() <= options.get("broadcast_groups", BROADCAST_GROUPS)
    return F.broadcast(groups) if few else groups


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Of equal texts the row with the largest id stays. Null texts are empty and
    so equal to each other and to ``""``. Rows that repeat both id and text are
    counted and all marked as kept. An empty table gives an empty result.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    rows, groups = refine(slim, id_col="doc_id", text_col="_text", hash_all=True, **options)
    joined = rows.drop("_text", "_alive").join(_small(groups, options), LEVELS, "left")
    return joined.select(
        "doc_id",
        F.coalesce("_keep", "doc_id").alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("doc_id") == F.col("_keep"), F.col("_size").isNull()).alias("kept"),
        F.col("_full").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, one for each text, with the columns of ``docs`` only.

    Rows whose length and prefix are unique never move while the groups are few
    enough to broadcast. Of the others only those with the largest id of their
    group are shuffled, to leave one where a row repeats. Columns of ``docs``
    may have any names: the operator works under names of its own.
    """
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    id_, text = inner[names.index(id_col)], inner[names.index(text_col)]
    rows, groups = refine(docs.toDF(*inner), id_col=id_, text_col=text, **options)
    joined = rows.filter("_alive").join(_small(groups, options), LEVELS, "left")
    winners = joined.filter(F.col("_size").isNotNull() & F.col(id_).eqNullSafe(F.col("_keep")))
    kept = (
        rows.filter(~F.col("_alive"))
        .select(*inner)
        .unionByName(joined.filter("_size is null").select(*inner))
        .unionByName(winners.dropDuplicates([*LEVELS, "_keep"]).select(*inner))
    )
    return kept.toDF(*names)
