"""Near duplicates by SetSketch registers, banded, estimated by likelihood and verified on full sets.

A text's set is its distinct 5-word shingles. Register i of a set holds
``floor(1 - log_b(x))`` of the least exponential variate x of its members under
hash i, truncated to 16 bits, so registers of a union are the larger of two.
Equal values in a band make candidates; for a candidate pair the counts of
larger, smaller and equal registers give the likelihood of each Jaccard
similarity. Pairs whose likelihood rules out the threshold are left out, all
others are compared on their full sets.

Texts with the same set are one node from the start. Inside a bucket no list of
all pairs is made: members are first compared with a few hubs, and what is then
still in different components is compared block by block on the registers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplyspark.llm.common import by_groups, chunks, components, mix, staged, texts_of, trimmed, word_hashes

WORDS = 5
THRESHOLD = 75  # per cent
# 28 bands of 3: a pair at the threshold shares no band with probability 2e-7.
BANDS, BAND_SIZE = 28, 3
REGISTERS = BANDS * BAND_SIZE
# Registers of 16 bits at base 1.001 and rate 20, as recommended for this sketch.
LOG_BASE = np.log(1.001)
RATE = 20.0
TOP = (1 << 16) - 1
# A pair is ruled out if some lower similarity is e^10 times likelier than any
# from the threshold on (about four and a half standard deviations).
RULED_OUT = 10.0
LEAST_EQUAL = 36
# Nodes of a bucket (or their shingles) that are compared with each other in one task.
BLOCK, BLOCK_SHINGLES = 1000, 1_000_000
# Pairs of a task whose likelihood is taken at once.
PAIRS_AT_ONCE = 4096
# Ids that go to every task of a scan (8 bytes each); with more, the scan is joined.
BROADCAST_IDS = 1_000_000

_rng = np.random.Generator(np.random.PCG64(77))
_XOR = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + _rng.integers(0, 2, REGISTERS, dtype=np.uint64)
_MULTIPLY = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, concatenated, and where each text's begin."""
    words, first = word_hashes(data, offsets)
    n_words = np.diff(first)
    rolled = np.zeros(len(words), dtype=np.uint64)
    for j in range(WORDS):
        factor = mix(np.array([j + 1], dtype=np.uint64))[0] | np.uint64(1)
        rolled[: len(words) - j] += words[j:] * factor
    rolled = mix(rolled)
    sets = []
    for start, n in zip(first[:-1].tolist(), n_words.tolist(), strict=True):
        if n >= WORDS:
            sets.append(np.unique(rolled[start : start + n - WORDS + 1]))
        elif n:
            whole = np.uint64(n)
            for word in words[start : start + n]:
                whole = mix(np.array([whole ^ word], dtype=np.uint64))[0] + np.uint64(n)
            sets.append(np.array([whole], dtype=np.uint64))
        else:
            sets.append(np.empty(0, np.uint64))
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return (np.concatenate(sets) if sets else np.empty(0, np.uint64)), starts


def registers(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Registers of each (non-empty) set, one row for each."""
    out = np.empty((len(starts) - 1, REGISTERS), dtype=np.uint16)
    for i in range(REGISTERS):
        least = np.minimum.reduceat((values ^ _XOR[i]) * _MULTIPLY[i], starts[:-1])
        x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
        out[:, i] = np.clip(np.floor(1.0 - np.log(x) / LOG_BASE), 0, TOP)
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in chunks(batch):
            values, starts = shingle_sets(data, offsets)
            sizes = np.diff(starts)
            full = sizes > 0
            keys = np.zeros((2, len(sizes)), dtype=np.int64)
            sketches = np.zeros((len(sizes), REGISTERS), dtype=np.uint16)
            if full.any():
                at = np.concatenate([starts[:-1][full], starts[-1:]])
                for k in range(2):
                    keys[k, full] = np.add.reduceat(mix(values ^ _XOR[k]), at[:-1]).view(np.int64)
                sketches[full] = registers(values, at)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes), *map(pa.array, keys), pa.array([row.tobytes() for row in sketches], pa.binary())],
                ["doc_id", "n_shingles", "k1", "k2", "sketch"],
            )


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = _registers_of(batch.column(2).to_pylist()).astype(np.uint64)
        for band in range(BANDS):
            key = np.full(len(rows), band + 1, dtype=np.uint64)
            for i in range(band * BAND_SIZE, (band + 1) * BAND_SIZE):
                key = mix(key * _MULTIPLY[0] + rows[:, i])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(np.full(len(rows), band, dtype=np.int32)), batch.column(0), batch.column(1)],
                ["key", "band", "node", "n"],
            )


def _registers_of(sketches: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), dtype=np.uint16).reshape(-1, REGISTERS)


def likelihood(larger: np.ndarray, smaller: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Likeliest similarity of each pair, and whether the threshold is not ruled out.

    ``larger`` and ``smaller`` count the registers of a that are above and
    below those of b. The sizes are known, so similarity is the only unknown.
    """
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    equal = REGISTERS - larger - smaller
    highest = np.minimum(u / v, v / u)
    grid = np.linspace(0.0, 1.0, 41)[None, :]
    j = np.minimum(grid, highest[:, None])
    base = np.exp(LOG_BASE)

    def chance(x: np.ndarray) -> np.ndarray:
        return np.clip(-np.log1p(-x * (base - 1) / base) / LOG_BASE, 1e-9, 1.0)

    above, below = chance(u[:, None] - v[:, None] * j), chance(v[:, None] - u[:, None] * j)
    ll = larger[:, None] * np.log(above) + smaller[:, None] * np.log(below)
    ll += equal[:, None] * np.log(np.clip(1 - above - below, 1e-9, 1.0))
    best = ll.argmax(axis=1)
    rows = np.arange(len(ll))
    near = np.where(grid >= THRESHOLD / 100 - 1e-9, ll, -np.inf).max(axis=1)
    possible = (highest >= THRESHOLD / 100 - 1e-9) & (near >= ll[rows, best] - RULED_OUT)
    return j[rows, best], possible


def _estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, n_a, n_b, sketch_a, sketch_b) that are not ruled out, with their likeliest similarity."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = _registers_of(batch.column(4).to_pylist()), _registers_of(batch.column(5).to_pylist())
        n_a, n_b = (batch.column(k).to_numpy().astype(np.float64) for k in (2, 3))
        guess, possible = likelihood((x > y).sum(axis=1), (x < y).sum(axis=1), n_a, n_b)
        at = pa.array(np.flatnonzero(possible))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), batch.column(1).take(at), pa.array(guess[possible])], ["a", "b", "guess"]
        )


def _undecided(rows: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of the left block, each with the rows of the right block that it has to be compared with.

    These are nodes of other components that the registers don't rule out. A
    pair that already met in an earlier band is left to that one.
    """
    i, j, own, band, sizes, components_, nodes = (rows[c].to_numpy() for c in ("i", "j", "own", "band", "n", "component", "node"))
    side, same = i == own, bool(i[0] == j[0])
    left = np.flatnonzero(side)
    right = left if same else np.flatnonzero(~side)
    if not len(left) or not len(right):
        return
    sketches = _registers_of(rows["sketch"].to_pylist())
    # Pairs wait until there are enough of them for one call of the likelihood.
    waiting, held = [], 0
    for k in left:
        at = right[components_[right] != components_[k]]
        if same:
            at = at[nodes[at] > nodes[k]]
        at = at[100 * np.minimum(sizes[at], sizes[k]) >= THRESHOLD * np.maximum(sizes[at], sizes[k])]
        if not len(at):
            continue
        equal = sketches[k] == sketches[at]
        # Fewer equal registers have no chance: 63 are expected at the threshold, with deviation 4.
        enough = equal.view(np.uint8).sum(axis=1, dtype=np.uint8) >= LEAST_EQUAL
        at, equal = at[enough], equal[enough]
        whole = np.logical_and.reduce([equal[:, i::BAND_SIZE] for i in range(BAND_SIZE)])
        at = at[whole.argmax(axis=1) == band[0]]
        if len(at):
            waiting.append((int(k), at))
            held += len(at)
        if held >= PAIRS_AT_ONCE:
            yield from _not_ruled_out(waiting, sketches, sizes)
            waiting, held = [], 0
    if waiting:
        yield from _not_ruled_out(waiting, sketches, sizes)


def _not_ruled_out(waiting: list[tuple[int, np.ndarray]], sketches: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    counts = [len(at) for _, at in waiting]
    a, b = np.repeat([k for k, _ in waiting], counts), np.concatenate([at for _, at in waiting])
    x, y = sketches[a], sketches[b]
    larger, smaller = (z.view(np.uint8).sum(axis=1, dtype=np.uint8).astype(np.int64) for z in (x > y, x < y))
    _, possible = likelihood(larger, smaller, sizes[a].astype(np.float64), sizes[b].astype(np.float64))
    start = 0
    for (k, at), n in zip(waiting, counts, strict=True):
        left = at[possible[start : start + n]]
        start += n
        if len(left):
            yield k, left


def _contested(rows: pa.Table) -> pa.Table:
    """The nodes of two blocks that have to be compared with others."""
    found = np.zeros(rows.num_rows, dtype=bool)
    for k, at in _undecided(rows):
        found[k] = True
        found[at] = True
    return rows.select(["key", "i", "j", "node"]).filter(pa.array(found))


def _block_links(rows: pa.Table) -> pa.Table:
    """Links between nodes of two blocks, as many as join their components."""
    members = [np.frombuffer(m.as_buffer(), dtype=np.uint64) for m in rows["members"]]
    nodes, parts = rows["node"].to_numpy(), rows["component"].to_numpy()
    parent = {c: c for c in set(parts.tolist())}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    out = []
    for k, at in _undecided(rows):
        for other in at:
            a, b = root(int(parts[k])), root(int(parts[other]))
            if a != b and _linked(members[k], members[other]):
                parent[max(a, b)] = min(a, b)
                out.append((min(nodes[k], nodes[other]), max(nodes[k], nodes[other])))
    a, b = zip(*out, strict=True) if out else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= THRESHOLD * (len(both) - common)


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in chunks(batch):
            values, starts = shingle_sets(data, offsets)
            blobs = [values[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(blobs, pa.binary())], ["node", "members"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = (np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in (x, y))
            linked.append(_linked(x, y))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])


class NearDuplicates:
    """Signatures, nodes and links of one table of texts."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        self.texts = texts_of(docs, id_col, text_col)
        self.signatures = staged(
            self.texts.mapInArrow(trimmed(_sketch), "doc_id long, n_shingles long, k1 long, k2 long, sketch binary"), "signatures"
        )
        self.nodes = staged(
            self.signatures.filter("n_shingles > 0 and doc_id is not null")
            .groupBy("k1", "k2")
            .agg(F.min("doc_id").alias("node"), F.min("n_shingles").alias("n"), F.min("sketch").alias("sketch")),
            "nodes",
        )

    def buckets(self) -> DataFrame:
        """(key, band, node, n) of all buckets with two nodes or more."""
        rows = self.nodes.select("node", "n", "sketch").mapInArrow(_banded, "key long, band int, node long, n long")
        several = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key")
        return staged(rows.join(several, "key"), "buckets")

    def possible(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b), those that are not ruled out by sizes and likelihood, with the likeliest similarity."""
        a, b = (self.nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}")) for x in "ab")
        joined = pairs.join(a, "a").join(b, "b")
        joined = joined.filter(100 * F.least("n_a", "n_b") >= THRESHOLD * F.greatest("n_a", "n_b"))
        return joined.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(trimmed(_estimate), "a long, b long, guess double")

    def sets(self, nodes: DataFrame) -> DataFrame:
        """``node`` and ``members`` (its sorted shingle hashes) for each of ``nodes``."""
        needed = staged(nodes.select(F.col("node").alias("doc_id")).distinct(), "needed")
        if needed.count() <= BROADCAST_IDS:
            needed = F.broadcast(needed)
        rows = self.texts.join(needed, "doc_id", "left_semi").mapInArrow(trimmed(_set_rows), "node long, members binary")
        return staged(rows, "sets")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """``linked`` for each pair (a, b), by full sets."""
        pairs = staged(pairs, "pairs")
        sets = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("node")))
        a, b = (sets.select(F.col("node").alias(x), F.col("members").alias(f"m_{x}")) for x in "ab")
        joined = pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "m_a", "m_b")
        return joined.mapInArrow(trimmed(_verify), "a long, b long, linked boolean")

    def links(self) -> DataFrame:
        """Links (a, b) that join every node to its component; both ends are nodes."""
        buckets = self.buckets()
        hubs = buckets.groupBy("key").agg(F.min("node").alias("a"))
        pairs = buckets.join(hubs, "key").filter("node <> a").select("a", F.col("node").alias("b")).distinct()
        best = self.possible(pairs).groupBy("b").agg(F.max_by("a", "guess").alias("a")).select("a", "b")
        tested = staged(self.verified(best), "tested")
        tested = self._other_hubs(buckets, tested)
        return tested.filter("linked").select("a", "b").unionByName(self._rest(buckets, tested))

    def _labelled(self, buckets: DataFrame, tested: DataFrame) -> DataFrame:
        """Buckets whose nodes are in several components, with each node's."""
        found = components(tested.filter("linked"))
        rows = buckets.join(found.withColumnRenamed("component", "c"), "node", "left")
        rows = rows.select("key", "band", "node", "n", F.coalesce("c", "node").alias("component"))
        rows = staged(rows, "labelled")
        mixed = rows.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y")
        return rows.join(mixed.select("key"), "key")

    def _other_hubs(self, buckets: DataFrame, tested: DataFrame) -> DataFrame:
        """Try the hub of each bucket under another order, for nodes that are still apart from it."""
        rows = staged(self._labelled(buckets, tested), "apart")
        hubs = rows.groupBy("key").agg(F.min_by(F.struct("node", "component"), F.xxhash64("key", "node")).alias("hub"))
        pairs = rows.join(hubs, "key").filter("component <> hub.component")
        pairs = pairs.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()
        pairs = self.possible(pairs.join(tested, ["a", "b"], "left_anti")).select("a", "b")
        return staged(tested.unionByName(self.verified(pairs)), "tested")

    def _rest(self, buckets: DataFrame, tested: DataFrame) -> DataFrame:
        """Links that are still missing: nodes of a bucket in different components, compared block by block.

        Registers alone tell which nodes are contested; only their full sets
        are brought together. A task returns a link for each two components
        that it joins, never a list of pairs.
        """
        rows = self._labelled(buckets, tested)
        blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES))
        # The pair of a bucket of two has been a hub and its partner before.
        sizes = rows.groupBy("key").agg(blocks.alias("blocks"), F.count(F.lit(1)).alias("c")).filter("c > 2").drop("c")
        rows = rows.join(sizes, "key").join(self.nodes.select("node", "sketch"), "node")
        rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), "blocks"))
        # Block x meets block y in the task of (min, max).
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        names = ["key", "band", "node", "n", "component", "sketch", "own"]
        rows = rows.select(*names, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        task = ["key", "i", "j"]
        # The rows are small and the work on them isn't: keep Spark from merging these partitions by their bytes.
        parts = int(self.texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = staged(rows, "blocks")
        dealt = rows.repartition(parts, *task).sortWithinPartitions(*task)
        contested = dealt.mapInArrow(trimmed(by_groups(_contested, task)), "key long, i long, j long, node long")
        contested = staged(contested, "contested")
        rows = rows.join(contested, [*task, "node"], "left_semi").join(self.sets(contested), "node")
        dealt = rows.repartition(parts, *task).sortWithinPartitions(*task)
        return dealt.mapInArrow(trimmed(by_groups(_block_links, task)), "a long, b long").distinct()

    def result(self) -> DataFrame:
        found = components(self.links())
        nodes = self.nodes.select("k1", "k2", "node").join(found, "node", "left")
        nodes = nodes.select("k1", "k2", F.coalesce("component", "node").alias("component"))
        rows = self.signatures.drop("sketch").withColumn("full", F.col("n_shingles") > 0)
        # Texts without words are linked with nothing and need no partner.
        full = rows.filter("full").join(nodes, ["k1", "k2"], "left")
        full = full.select("doc_id", "n_shingles", F.col("component").alias("component_id"))
        empty = rows.filter("not full").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        return full.unionByName(empty).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept`` for each row of ``docs``.

    Null, empty and blank texts have no shingles and are their own component.
    Rows with the same id count as one document. Rows without an id get the
    component of texts with the same set, if those have ids, and are not kept.
    An empty table gives an empty result; other columns are ignored.
    """
    return NearDuplicates(docs, id_col, text_col).result()


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one document for each group; same columns. Rows without an id stay."""
    found = NearDuplicates(docs, id_col, text_col).result()
    gone = staged(found.filter("doc_id is not null and not kept").select(F.col("doc_id").alias(id_col)).distinct(), "gone")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, id_col, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
