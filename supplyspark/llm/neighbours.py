"""Approximate nearest neighbours on robust-pruned directed graphs, one for each shard.

Distinct vectors are dealt to shards of bounded size by hash. In a shard, greedy
searches from the centre propose neighbours for a batch of points at once;
relaxed distance pruning keeps those that no kept neighbour is much nearer to;
edges are also added backwards and pruned again. Beam search then runs in every
shard for blocks of queries, and the distances of what it finds are computed
anew in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
import math
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from supplyspark.llm.common import shared_dir, staged
from supplyspark.llm.language_model import _place as place

SHARD_ROWS = 4000
DEGREE = 32
BEAM = 64
RELAX = (1.0, 1.2)  # pruning factor of each pass
BATCH = 256  # points that search and are pruned at once
QUERY_BLOCK = 1024  # queries that a worker reads at once


def _squared(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Squared distances of points (B, d) to others (B, c, d)."""
    gap = others - points[:, None]
    return np.einsum("bcd,bcd->bc", gap, gap)


def _exponent(data: np.ndarray) -> int:
    """Power of two that brings the largest component to about 1."""
    return -int(np.frexp(np.abs(data).max())[1]) if data.size else 0


def _coarse(vectors: np.ndarray, exponent: int) -> np.ndarray:
    """Scaled to single precision; a query far beyond the shard's vectors is cut off at what can be squared."""
    with np.errstate(over="ignore"):
        return np.clip(np.ldexp(vectors.astype("f8"), exponent), -1e15, 1e15).astype("f4")


def _distances(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision; squares that overflow or vanish are taken of scaled gaps."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        gap = others.astype("f8") - points.astype("f8")[:, None]
        plain = np.sqrt(np.einsum("bcd,bcd->bc", gap, gap))
    odd = ~np.isfinite(plain) | (plain < 1e-140)
    if odd.any():
        half = (others.astype("f8") * 0.5 - points.astype("f8")[:, None] * 0.5)[odd]  # a gap may overflow too
        largest = np.abs(half).max(axis=1, keepdims=True)
        safe = np.where(largest > 0, largest, 1.0)
        plain[odd] = np.sqrt(((half / safe) ** 2).sum(axis=1)) * safe[:, 0] * 2
    return plain


def beam_search(data: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest nodes found for each query, their squared distances, and the nodes passed on the way.

    Missing entries are -1.
    """
    b, rows = len(queries), np.arange(len(queries))
    ids = np.full((b, beam), -1)
    dist = np.full((b, beam), np.inf, dtype=data.dtype)
    opened = np.zeros((b, beam), dtype=bool)
    seen = np.zeros((b, len(data)), dtype=bool)
    ids[:, 0] = start
    dist[:, 0] = _squared(queries, data[ids[:, :1]])[:, 0]
    seen[:, start] = True
    passed = []
    while True:
        waiting = np.where(opened | (ids < 0), np.inf, dist)
        at = waiting.argmin(axis=1)
        live = np.flatnonzero(np.isfinite(waiting[rows, at]))
        if not len(live):
            break
        node = np.full(b, -1)
        node[live] = ids[live, at[live]]
        passed.append(node)
        opened[live, at[live]] = True
        around = graph[node[live]]
        fresh = (around >= 0) & ~seen[live[:, None], around]
        row, column = np.nonzero(around >= 0)
        seen[live[row], around[row, column]] = True
        far = np.where(fresh, _squared(queries[live], data[around]), np.inf)
        all_ids = np.concatenate([ids[live], np.where(fresh, around, -1)], axis=1)
        all_dist = np.concatenate([dist[live], far], axis=1)
        all_open = np.concatenate([opened[live], np.zeros_like(fresh)], axis=1)
        best = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
        ids[live], dist[live] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_dist, best, 1)
        opened[live] = np.take_along_axis(all_open, best, 1)
    return ids, dist, np.stack(passed, axis=1)


def robust_prune(data: np.ndarray, points: np.ndarray, candidates: np.ndarray, relax: float, degree: int) -> np.ndarray:
    """Up to ``degree`` neighbours for each point out of its candidates (-1: none).

    The nearest candidate is kept; it removes those that are nearer to it,
    times ``relax``, than to the point; and so on.
    """
    order = np.sort(candidates, axis=1)
    candidates = np.where(np.concatenate([np.zeros((len(order), 1), bool), order[:, 1:] == order[:, :-1]], axis=1), -1, order)
    candidates = np.where(candidates == points[:, None], -1, candidates)
    vectors = data[candidates]
    to_point = np.where(candidates < 0, np.inf, _squared(data[points], vectors))
    rows = np.arange(len(points))
    out = np.full((len(points), degree), -1)
    for k in range(degree):
        at = to_point.argmin(axis=1)
        have = np.isfinite(to_point[rows, at])
        if not have.any():
            break
        out[have, k] = candidates[have, at[have]]
        between = _squared(vectors[rows, at], vectors)
        to_point = np.where((relax * relax * between <= to_point) & have[:, None], np.inf, to_point)
        to_point[rows, at] = np.inf
    return out


def _join_backwards(data: np.ndarray, graph: np.ndarray, points: np.ndarray, relax: float) -> None:
    """Add the edges of ``points`` the other way round; prune where there are too many."""
    degree = graph.shape[1]
    source = np.repeat(points, degree)
    target = graph[points].ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
    by_size = np.argsort(counts, kind="stable")
    at = 0
    while at < len(by_size):
        # Rows of about the same size, and a bounded number of cells.
        wide = degree + int(counts[by_size[min(at + BATCH, len(by_size)) - 1]])
        group = by_size[at : at + max(1, min(BATCH, (1 << 17) // wide))]
        at += len(group)
        wide = int(counts[group].max())
        extra = np.full((len(group), wide), -1)
        for row, k in enumerate(group):
            extra[row, : counts[k]] = source[first[k] : first[k] + counts[k]]
        graph[nodes[group]] = robust_prune(data, nodes[group], np.concatenate([graph[nodes[group]], extra], axis=1), relax, degree)


def build_graph(data: np.ndarray, degree: int = DEGREE, beam: int = BEAM) -> tuple[np.ndarray, int]:
    """Out-neighbours of each row (-1: none), and the row nearest to the mean, where searches start."""
    n = len(data)
    rng = np.random.Generator(np.random.PCG64(n))
    start = int(_squared(data.mean(axis=0, keepdims=True), data[None])[0].argmin())
    if n <= degree + 1:
        everyone = np.tile(np.arange(n), (n, 1))
        graph = np.full((n, degree), -1)
        graph[:, : n - 1] = everyone[~np.eye(n, dtype=bool)].reshape(n, n - 1)
        return graph, start
    graph = rng.integers(0, n, (n, degree))
    for relax in RELAX:
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            points = order[at : at + BATCH]
            found, _, passed = beam_search(data, graph, start, data[points], beam)
            graph[points] = robust_prune(data, points, np.concatenate([found, passed, graph[points]], axis=1), relax, degree)
            _join_backwards(data, graph, points, relax)
    return graph, start


def _kind(vectors: DataFrame, vector_col: str) -> str:
    return "f8" if vectors.schema[vector_col].dataType.elementType.typeName() == "double" else "f4"


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id`` and ``vector`` of rows that take part.

    Left out are null ids and vectors, zero vectors, those with null or
    non-finite components, and those of another length than most have.
    """
    x = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")).filter(
        F.col("vec_id").isNotNull()
        & x.isNotNull()
        & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists(x, lambda v: v != 0)
    )
    usual = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("vector") == (usual["d"] if usual else 0)).distinct()


class GraphIndex:
    """Shards of distinct vectors with their graphs, and the ids that have each vector."""

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", keep: int = 11, shard_rows: int = SHARD_ROWS):
        kind = self.kind = _kind(vectors, vector_col)
        rows = staged(usable(vectors, id_col, vector_col), "vectors")
        nodes = staged(rows.groupBy("vector").agg(F.min("vec_id").alias("node")), "vector-nodes")
        members = rows.join(nodes, "vector").select("node", "vec_id")
        first = Window.partitionBy("node").orderBy("vec_id")
        # No search returns more than ``keep`` ids of one vector.
        self.members = staged(members.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= keep).drop("r"), "members")
        shards = max(1, math.ceil(nodes.count() / shard_rows))

        def build(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("node")
            data = np.stack(part["vector"].to_numpy()).astype(kind)
            graph, start = build_graph(_coarse(data, _exponent(data)))
            return pd.DataFrame(
                {"ids": [part["node"].to_numpy("i8").tobytes()], "data": [data.tobytes()], "graph": [graph.astype("i4").tobytes()], "start": [start]}
            )

        # A partition for each shard: the rows are few and the work on them isn't.
        sharded = nodes.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int")).repartitionById(shards, "shard")

        def build_all(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            parts = [frame for frame in frames if len(frame)]
            if parts:
                yield build(pd.concat(parts))

        self.shards = staged(sharded.mapInPandas(build_all, "ids binary, data binary, graph binary, start long"), "graphs")
        self.rows = rows

    def _near_nodes(self, folder: str, k: int, beam: int) -> DataFrame:
        """``k`` nodes from every shard for each of the queries in ``folder``."""
        kind = self.kind

        def blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            fs, path = place(folder)
            for block in pads.dataset(path, filesystem=fs, format="parquet").to_batches(batch_size=QUERY_BLOCK, use_threads=False):
                if block.num_rows:
                    vectors = block.column(block.schema.get_field_index("vector"))
                    yield block.column(block.schema.get_field_index("vec_id")).to_numpy(), vectors.flatten().to_numpy().reshape(block.num_rows, -1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    nodes = np.frombuffer(row["ids"], "i8")
                    data = np.frombuffer(row["data"], kind).reshape(len(nodes), -1)
                    graph = np.frombuffer(row["graph"], "i4").reshape(len(nodes), -1)
                    exponent = _exponent(data)
                    coarse = _coarse(data, exponent)
                    for ids, queries in blocks():
                        for at in range(0, len(ids), BATCH):
                            part = queries[at : at + BATCH]
                            found = beam_search(coarse, graph, row["start"], _coarse(part, exponent), max(beam, k))[0]
                            exact = np.where(found < 0, np.inf, _distances(part, data[found]))
                            best = np.argsort(exact, axis=1, kind="stable")[:, :k]
                            found, exact = np.take_along_axis(found, best, 1), np.take_along_axis(exact, best, 1)
                            real = found >= 0
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.repeat(ids[at : at + BATCH], real.sum(axis=1))), pa.array(nodes[found[real]]), pa.array(exact[real])],
                                ["query_id", "node", "score"],
                            )

        # Few large rows: each shard is a task of its own.
        return self.shards.mapInArrow(run, "query_id long, node long, score double")

    def search(self, is_query, k: int = 10, beam: int = BEAM) -> DataFrame:
        """``query_id``, ``rank``, ``vec_id``, ``score`` of the ``k`` nearest rows to each row for which ``is_query``.

        A row isn't its own neighbour; ties go to the smaller id. ``keep`` of
        the index must be more than ``k``. Without queries, or without rows, the
        result is empty. Queries never pass through the driver.
        """
        folder = f"{shared_dir(self.rows.sparkSession)}/vector-queries-{uuid.uuid4().hex}"
        self.rows.filter(is_query).select("vec_id", "vector").write.parquet(folder)
        nearest = _first(self._near_nodes(folder, k + 1, beam), F.col("score"), F.col("node"), k + 1).drop("rank")
        each = nearest.join(self.members, "node").filter("vec_id <> query_id")
        return _first(each.select("query_id", "vec_id", "score"), F.col("score"), F.col("vec_id"), k).select("query_id", "rank", "vec_id", "score")


def _first(rows: DataFrame, *order_and_count) -> DataFrame:
    *order, k = order_and_count
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)
