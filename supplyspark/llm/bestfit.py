"""Pack documents into as few sequences as possible by a grouping genetic algorithm.

Documents longer than a sequence are cut into whole sequences and a shorter
first piece; whole sequences are finished, so only the rests are packed. They
are dealt to blocks of bounded size. For each block, islands evolve populations
of packings in tasks of their own: crossover puts well-filled sequences of one
packing into another as they are, dissolves those of the other that hold the
same pieces, and places displaced pieces by best fit. After each epoch the best
packing of an island migrates to the next one. A block is finished as soon as
an island meets its lower bound. Then the emptiest sequence of every block goes
to a next, much smaller round, until one block is left.

The search moves only lengths and row numbers, never tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplyspark.llm.common import staged, texts_of
from supplyspark.llm.packing import END_ID, _encoder

SEQUENCE = 2048
BLOCK_PIECES = 8192
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 3, 3, 8, 6
WHOLE = 1 << 62  # sequence numbers of whole sequences start here
TOKENS = "row long, doc_id long, n long, first_whole long, ids binary"
STATE = "block long, island int, migrant boolean, bound long, bins long, rows binary, sizes binary, population array<binary>"


def lower_bound(sizes: np.ndarray, size: int) -> int:
    """Sequences that no packing can do without: by total length, and by pieces too long to share (Martello and Toth's L2)."""
    count = np.bincount(sizes, minlength=size + 1)
    many = np.concatenate([[0], np.cumsum(count)])  # pieces shorter than the index
    total = np.concatenate([[0], np.cumsum(count * np.arange(size + 1))])
    alpha, half = np.arange(0, size // 2 + 1), size // 2
    long_ = many[size + 1] - many[half + 1]
    # Pieces in (half, size - alpha] can be filled up by those in [alpha, half].
    room = size * (many[size - alpha + 1] - many[half + 1]) - (total[size - alpha + 1] - total[half + 1])
    short = total[half + 1] - total[alpha]
    return int((long_ + np.maximum(0, -(-(short - room) // size))).max())


def best_fit(sizes: np.ndarray, bin_of: np.ndarray, todo: np.ndarray, rooms: list[int], size: int) -> int:
    """Place ``todo`` in this order, each where the least room is left; returns the number of bins.

    Bins of equal room share a stack, and the bits of one integer say which
    rooms occur, so the tightest bin is found by a shift and the lowest bit.
    """
    stacks: list[list[int]] = [[] for _ in range(size + 1)]
    mask = 0
    for b, room in enumerate(rooms):
        stacks[room].append(b)
        mask |= 1 << room
    bins = len(rooms)
    placed = []
    for need in sizes[todo].tolist():
        fitting = mask >> need
        if fitting:
            room = need + (fitting & -fitting).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                mask ^= 1 << room
        else:
            room, b, bins = size, bins, bins + 1
        placed.append(b)
        stacks[room - need].append(b)
        mask |= 1 << (room - need)
    bin_of[todo] = placed
    return bins


def _fills(sizes: np.ndarray, bin_of: np.ndarray) -> np.ndarray:
    return np.bincount(bin_of, weights=sizes).astype(np.int64)


def fitness(sizes: np.ndarray, bin_of: np.ndarray) -> tuple[int, int]:
    """Fewer bins first; of equal many, the less even ones. Smaller is better."""
    fills = _fills(sizes, bin_of)
    return len(fills), -int((fills * fills).sum())


def _finish(sizes: np.ndarray, kept: np.ndarray, bin_of: np.ndarray, order: np.ndarray, size: int) -> np.ndarray:
    """A packing with the bins of the ``kept`` pieces, and all others placed by best fit in ``order``."""
    child = np.full(len(sizes), -1, dtype=np.int64)
    _, child[kept] = np.unique(bin_of[kept], return_inverse=True)
    fills = _fills(sizes[kept], child[kept]) if kept.any() else np.empty(0, np.int64)
    best_fit(sizes, child, order[~kept[order]], (size - fills).tolist(), size)
    return child


def crossover(sizes: np.ndarray, a: np.ndarray, b: np.ndarray, order: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """Put some well-filled bins of ``b`` into ``a``.

    Bins of ``a`` that hold a piece of these would hold it twice, so they are
    dissolved; their other pieces are placed anew by best fit.
    """
    fills = _fills(sizes, b)
    well = fills >= np.median(fills)
    injected = well & (rng.random(len(fills)) < rng.uniform(0.05, 0.5))
    coming = injected[b]
    double = np.zeros(a.max() + 1, dtype=bool)
    double[a[coming]] = True
    kept = coming | ~double[a]
    return _finish(sizes, kept, np.where(coming, b + len(double), a), order, size)


def mutate(sizes: np.ndarray, a: np.ndarray, order: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """Dissolve the emptiest and a few other bins, exchange pieces where that fills a bin, and best-fit the rest."""
    fills = _fills(sizes, a)
    gone = rng.random(len(fills)) < 0.02
    gone[np.argsort(fills, kind="stable")[: max(2, len(fills) // 50)]] = True
    bin_of, free = a.copy(), gone[a]
    # A free piece can take the place of a shorter one if the bin is then full, or nearly.
    held = np.flatnonzero(~free)
    wanted = size - fills[bin_of[held]] + sizes[held]
    by = np.argsort(wanted, kind="stable")
    held, wanted = held[by], wanted[by]
    touched = np.zeros(len(fills), dtype=bool)
    for i in order[free[order]].tolist():
        low, high = np.searchsorted(wanted, (sizes[i], sizes[i] + 1 + size // 128))
        for j in held[low : min(high, low + 8)].tolist():
            if not touched[bin_of[j]] and sizes[j] < sizes[i]:
                touched[bin_of[j]] = True
                bin_of[i], free[i], free[j] = bin_of[j], False, True
                break
    return _finish(sizes, ~free, bin_of, order, size)


def evolve(
    sizes: np.ndarray, population: list[np.ndarray], bound: int, size: int, rng: np.random.Generator, generations: int, most: int
) -> list[np.ndarray]:
    """The population after ``generations``, best first. It never loses its best packing."""
    order = np.argsort(-sizes, kind="stable")
    while len(population) < most:
        shuffled = np.argsort(-sizes * (1 + 0.15 * rng.random(len(sizes))), kind="stable")
        population = [*population, _finish(sizes, np.zeros(len(sizes), bool), np.zeros(len(sizes), np.int64), shuffled, size)]
    ranked = sorted(((fitness(sizes, p), k, p) for k, p in enumerate(population)), key=lambda x: x[:2])
    for _ in range(generations):
        if ranked[0][0][0] <= bound:
            break
        children = []
        for k in range(most):
            a, b = (ranked[int(i)][2] for i in np.minimum(rng.integers(0, len(ranked), 2), rng.integers(0, len(ranked), 2)))
            children.append(mutate(sizes, ranked[0][2], order, size, rng) if k == 0 else crossover(sizes, a, b, order, size, rng))
            if k % 2:
                children[-1] = mutate(sizes, children[-1], order, size, rng)
        found = {score: p for score, _, p in reversed(ranked)}
        for child in children:
            found.setdefault(fitness(sizes, child), child)
        ranked = [(score, k, p) for k, (score, p) in enumerate(sorted(found.items(), key=lambda x: x[0]))][:most]
    return [p for _, _, p in ranked]


def _packed(bin_of: np.ndarray) -> bytes:
    return bin_of.astype("<u4").tobytes()


def _row(block, island, migrant, bound, bins, rows, sizes, population) -> dict:
    return {
        "block": block, "island": island, "migrant": migrant, "bound": bound, "bins": bins,
        "rows": rows.astype("<i8").tobytes(), "sizes": sizes.astype("<i4").tobytes(), "population": [_packed(p) for p in population],
    }


def _seed(size: int, islands: int):
    """A block's best-fit decreasing packing, or the one it comes with; islands if neither meets the bound."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "row"], ascending=[False, True])
        rows, sizes, held = (group[c].to_numpy(np.int64) for c in ("row", "size", "held"))
        plain = np.zeros(len(sizes), np.int64)
        best_fit(sizes, plain, np.arange(len(sizes)), [], size)
        population = [plain]
        if (held >= 0).all():
            population.append(np.unique(held, return_inverse=True)[1])
        population.sort(key=lambda p: fitness(sizes, p))
        bound, bins = lower_bound(sizes, size), int(population[0].max()) + 1
        out = [_row(key[0], 0, False, bound, bins, rows, sizes, population)]
        if bins > bound:
            out += [_row(key[0], i, False, bound, len(sizes), rows, sizes, []) for i in range(1, islands)]
        return pd.DataFrame(out)

    return run


def _epoch(size: int, islands: int, number: int, generations: int, most: int):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        block, island = (int(k) for k in key)
        own = group[~group["migrant"]].iloc[0]
        rows, sizes = np.frombuffer(own["rows"], "<i8"), np.frombuffer(own["sizes"], "<i4").astype(np.int64)
        coming = [p for blobs in group.loc[group["migrant"], "population"] for p in blobs]
        population = [np.frombuffer(p, "<u4").astype(np.int64) for p in [*own["population"], *coming]]
        rng = np.random.default_rng([number, island, block])
        best = evolve(sizes, population, int(own["bound"]), size, rng, generations, most)
        bins = int(best[0].max()) + 1
        out = [_row(block, island, False, own["bound"], bins, rows, sizes, best)]
        if islands > 1:
            nothing = np.empty(0)
            out.append(_row(block, (island + 1) % islands, True, own["bound"], bins, nothing, nothing, best[:1]))
        return pd.DataFrame(out)

    return run


PLACED = "row long, size int, held long, sequence_id long, offset long, emptiest boolean"


def _expand(level: int):
    """Places of the pieces of a block's best packing."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for state in frame.itertuples():
                rows, sizes = np.frombuffer(state.rows, "<i8"), np.frombuffer(state.sizes, "<i4")
                bin_of = np.frombuffer(state.population[0], "<u4").astype(np.int64)
                by = np.argsort(bin_of, kind="stable")
                ends = np.cumsum(sizes[by])
                fills = _fills(sizes, bin_of)
                yield pd.DataFrame({
                    "row": rows[by], "size": sizes[by], "held": state.block,
                    "sequence_id": (level << 56) + (state.block << 24) + bin_of[by],
                    "offset": ends - sizes[by] - (np.cumsum(fills) - fills)[bin_of[by]],
                    "emptiest": bin_of[by] == int(np.argmin(fills)),
                })

    return run


def _solve(items: DataFrame, blocks: int, level: int, size: int, islands: int, epochs: int, generations: int, most: int) -> DataFrame:
    """Places of ``items`` (``row``, ``size``, ``held``, ``block``)."""
    seeded = items.repartition(blocks, "block").groupBy("block").applyInPandas(_seed(size, islands), STATE)
    state = staged(seeded, "packings")
    for number in range(epochs):
        best = state.filter("not migrant").groupBy("block").agg(F.min("bins").alias("least"), F.max("bound").alias("least_possible"))
        going = staged(best.filter("least > least_possible").select("block"), "unfinished")
        left = going.count()
        if not left:
            break
        active = state.join(going, "block", "left_semi").repartition(left * islands, "block", "island")
        following = active.groupBy("block", "island").applyInPandas(_epoch(size, islands, number, generations, most), STATE)
        state = staged(following.unionByName(state.join(going, "block", "left_anti").filter("not migrant")), "packings")
    # An island's number is unique in its block, so one row is left for each block.
    own = state.filter("not migrant")
    first = own.groupBy("block").agg(F.min(F.struct("bins", "island")).alias("first"))
    chosen = own.join(first.select("block", "first.bins", "first.island"), ["block", "bins", "island"], "left_semi")
    return staged(chosen.mapInPandas(_expand(level), PLACED), "places")


def _tokens(docs: DataFrame, path: str, pattern: str, size: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = _encoder(path, pattern)
        kind = np.uint16 if use.fast.n_vocab <= 1 << 16 else np.uint32
        part = TaskContext.get().partitionId()
        row, whole = part << 33, WHOLE + (part << 40)
        for batch in batches:
            ids = [np.append(use.encode(text.as_py()), END_ID).astype(kind) for text in batch.column(1)]
            n = np.array([len(x) for x in ids], dtype=np.int64)
            after = np.cumsum(n // size)
            columns = [np.arange(row, row + len(ids)), batch.column(0), n, whole + after - n // size, [x.tobytes() for x in ids]]
            row, whole = row + len(ids), whole + int(after[-1] if len(ids) else 0)
            kinds = [pa.int64()] * 4 + [pa.binary()]
            arrays = [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "doc_id", "n", "first_whole", "ids"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, TOKENS)


PIECES = "doc_id long, piece int, start long, length long, sequence_id long, offset long, ids binary"


def _cut(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, n, whole, blob, sequence, offset in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(blob, np.uint16 if len(blob) == 2 * n else np.uint32).astype("<u4")
                start, piece = n % size, 0
                if start:
                    out.append((doc_id, 0, 0, start, sequence, offset, ids[:start].tobytes()))
                    piece = 1
                for k in range(n // size):
                    out.append((doc_id, piece + k, start, size, whole + k, 0, ids[start : start + size].tobytes()))
                    start += size
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.binary()]
            columns = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in PIECES.split(", ")])

    return run


def best_fit_pack(
    docs: DataFrame,
    path: str,
    pattern: str,
    *,
    size: int = SEQUENCE,
    block_pieces: int = BLOCK_PIECES,
    islands: int = ISLANDS,
    epochs: int = EPOCHS,
    generations: int = GENERATIONS,
    population: int = POPULATION,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of the packed sequences, with their ids (little-endian unsigned 32-bit); nothing is padded.

    A document of at most ``size`` tokens is one piece. A longer one has a
    first piece of what is left after whole sequences. A null or empty text is
    END_ID alone. Rows that repeat are packed as often as they occur, null ids
    too; other columns are ignored. An empty table has no pieces.
    """
    tokens = staged(_tokens(docs, path, pattern, size, id_col, text_col), "tokens")
    rest = F.col("n") % size
    items = tokens.filter(rest > 0).select("row", rest.cast("int").alias("size"), F.lit(-1).cast("long").alias("held"))
    blocks = max(1, math.ceil(items.count() / block_pieces))
    key, level, places = "row", 0, None
    while True:
        dealt = items.withColumn("block", F.pmod(F.xxhash64(key), F.lit(blocks)))
        solved = _solve(dealt, blocks, level, size, islands, epochs, generations, population)
        done = solved if blocks == 1 else solved.filter("not emptiest")
        places = done if places is None else places.unionByName(done)
        if blocks == 1:
            break
        # One sequence of each block: at most size - 1 pieces for block_pieces before.
        items = solved.filter("emptiest").select("row", "size", "held")
        following = math.ceil(items.count() / block_pieces)
        blocks, key, level = max(1, min(following, blocks - 1)), "held", level + 1
    placed = tokens.join(places.select("row", "sequence_id", "offset"), "row", "left")
    return placed.select("doc_id", "n", "first_whole", "ids", "sequence_id", "offset").mapInArrow(_cut(size), PIECES)
