"""Helpers shared by the operators: Arrow batches, word hashes, staged tables, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
import ctypes
import os
import tempfile
import zipfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supplyspark.session import shared_dir, staged, tune  # noqa: F401

# Rows and bytes handed to Python at once, and bytes of text worked on at once.
# They only bound memory; results do not depend on them.
BATCH_ROWS = 1000
BATCH_BYTES = 1 << 20
CHUNK_BYTES = 1 << 18

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


_shipped: set[str] = set()


def _ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application, in case it isn't installed there."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        archive = os.path.join(tempfile.mkdtemp(prefix="supplyspark-"), "supplyspark.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for folder, _, names in os.walk(os.path.join(root, "supplyspark")):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.relpath(path, root))
        context.addPyFile(archive)
        _shipped.add(context.applicationId)


def prepare(spark: SparkSession) -> SparkSession:
    """Plan settings of the library, and small Arrow batches, since one text may be very long."""
    tune(spark)
    _ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text, under fixed names, so other columns cannot clash. A null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _malloc_trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library
        return lambda _: 0


_give_back = _malloc_trim()


def trim() -> None:
    """Give memory that a batch has freed back to the system: workers live on, and an executor pays for all of them."""
    pa.default_memory_pool().release_unused()
    _give_back(0)


def trimmed(run: Callable) -> Callable:
    """``run`` over batches, with ``trim`` after every one that it is done with."""

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                del batch
                trim()

        yield from run(each())

    return lean


def by_groups(run: Callable[[pa.Table], pa.Table], keys: Sequence[str]) -> Callable:
    """``run`` on each group of rows with equal ``keys`` in partitions that are sorted by them.

    Like a grouped map, but in workers that don't load pandas for it.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys]
            changes = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
            for a, b in zip([0, *changes.tolist()], [*changes.tolist(), batch.num_rows], strict=True):
                key = tuple(c[a] for c in columns)
                if held and key != current:
                    yield from run(pa.Table.from_batches(held)).to_batches()
                    held = []
                current = key
                held.append(batch.slice(a, b - a))
        if held:
            yield from run(pa.Table.from_batches(held)).to_batches()

    return whole


def chunks(batch: pa.RecordBatch, column: str = "text", size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of rows of about ``size`` bytes; with each, its bytes and offsets.

    A row is never cut, so a chunk holds at least one row.
    """
    start = 0
    array = batch.column(batch.schema.get_field_index(column))
    sizes = np.asarray(pc.fill_null(pc.binary_length(array), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
        part = batch.slice(start, stop - start)
        offsets = np.concatenate([[0], np.cumsum(sizes[start:stop])])
        data = np.frombuffer(b"".join(x or b"" for x in array.slice(start, stop - start).cast(pa.binary()).to_pylist()), dtype=np.uint8)
        yield part, data, offsets
        start = stop


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, *, lower: bool = True, separators: np.ndarray = _SPACE
) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word ``[^\\x20\\x09-\\x0D]+`` of the texts, and each text's first word.

    ``separators`` says for each byte whether it stands between words, if others do.

    A word's hash is a polynomial over its (lower-cased) bytes, read off one
    running sum, so no Python object is made per word.
    """
    n = len(data)
    counts_at = np.zeros(len(offsets), dtype=np.int64)
    if n == 0:
        return np.empty(0, np.uint64), counts_at
    low = _LOWER[data] if lower else data
    space = separators[data]
    starts_new = np.zeros(n, dtype=bool)
    starts_new[offsets[:-1][offsets[:-1] < n]] = True
    word = ~space
    begin = word.copy()
    begin[1:] &= space[:-1] | starts_new[1:]
    end = word.copy()
    end[:-1] &= space[1:] | starts_new[1:]
    begin, end = np.flatnonzero(begin), np.flatnonzero(end)
    powers = _powers(_BASE, n)
    sums = np.cumsum(_BYTE[low] * powers, dtype=np.uint64)
    inner = sums[end] - np.where(begin > 0, sums[begin - 1], np.uint64(0))
    hashes = mix(inner * _powers(_INVERSE, n)[begin] + (end - begin + 1).astype(np.uint64))
    return hashes, np.searchsorted(begin, offsets)


_power_cache: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    have = _power_cache.get(int(base))
    if have is None or len(have) < n:
        have = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n + (n >> 2), base, dtype=np.uint64)]))
        if n <= 1 << 21:
            _power_cache[int(base)] = have
    return have[:n]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of the graph of ``edges``: the smallest node reachable.

    Alternates large-star and small-star steps until nothing changes. Each step
    joins a node's smallest neighbour to its edges (no neighbour lists are
    gathered) and is written out, which cuts the lineage. The edges are compared
    with the last ones only if their sums are equal.
    """
    sums = (F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.bit_xor(F.xxhash64("v", "u")))
    current = staged(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges"
    )
    before = current.agg(*sums).first()
    while True:
        both = current.unionAll(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
            low.select("u", F.col("m").alias("v"))
        )
        small = small.filter("u <> v").distinct()
        following = staged(small, "edges")
        after = following.agg(*sums).first()
        # As many distinct edges on both sides, so none is left over if all are found.
        if after == before and following.join(current, ["u", "v"], "left_anti").isEmpty():
            return following.select(F.col("u").alias("node"), F.col("v").alias("component"))
        current, before = following, after
