import zlib

from helpers import SF, awkward_docs, clashing, empty_docs
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from supplyspark.llm import bestfit
from supplyspark.llm.bestfit import best_fit, best_fit_pack, crossover, evolve, fitness, lower_bound, mutate

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, docs, size):
    """Every id lies in one piece, cuts are where they have to be, sequences are gapless and not too long."""
    tokenizer = Tokenizer.from_file(PATH)
    wanted = []
    for i, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        starts = [0, *range(len(ids) % size or size, len(ids), size)] if len(ids) > size else [0]
        for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
            wanted.append((str(i), piece, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(wanted)
    place = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert place.get(r["sequence_id"], 0) == r["offset"]
        place[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(place.values(), default=0) <= size
    return len(place), lower_bound(np.array([w[3] for w in wanted]), size)


def packed(docs, **options):
    pieces = best_fit_pack(docs, PATH, public_tokenizers.PATTERN, **options)
    return pieces.selectExpr("*", "crc32(ids) AS ids_crc32").collect()


def test_contract(spark):
    out = corpus_pipeline.QUERIES["op13_best_fit_packing"](spark, SF)
    assert out.dtypes == [
        ("doc_id", "bigint"), ("piece", "int"), ("start", "bigint"), ("length", "bigint"),
        ("ids_crc32", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint"),
    ]
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    n, bound = check(out.collect(), [(r["doc_id"], r["text"]) for r in docs], 2048)
    assert n <= bound + 1


def test_many_blocks_and_rounds(spark):
    """Small blocks: the emptiest sequences of all blocks meet in further rounds."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packed(docs, block_pieces=12, size=1024)
    n, bound = check(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], 1024)
    assert len({r["sequence_id"] >> 56 for r in rows if r["sequence_id"] < bestfit.WHOLE}) > 1
    assert n <= bound * 1.06


def test_awkward(spark):
    docs = clashing(awkward_docs(spark))
    check(packed(docs), [(r["doc_id"], r["text"]) for r in docs.collect()], 2048)
    check(packed(docs, size=8, block_pieces=3), [(r["doc_id"], r["text"]) for r in docs.collect()], 8)
    assert packed(empty_docs(spark)) == []


def test_every_length_about_the_size(spark):
    """Documents of exactly, nearly and twice a sequence; each "a" is a token."""
    docs = spark.createDataFrame([(n, " a" * n) for n in (*range(14), 14, 15, 16, 29, 30, 31, 32, 45)], "doc_id long, text string")
    check(packed(docs, size=16), [(r["doc_id"], r["text"]) for r in docs.collect()], 16)


def plain_best_fit(sizes, size):
    rooms = []
    for s in sizes:
        fitting = [r for r in rooms if r >= s]
        if fitting:
            rooms[rooms.index(min(fitting))] -= s
        else:
            rooms.append(size - s)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_against_search(seed):
    sizes = np.random.default_rng(seed).integers(1, 101, 300)
    bin_of = np.empty(300, np.int64)
    bins = best_fit(sizes, bin_of, np.arange(300), [], 100)
    fills = np.bincount(bin_of, weights=sizes)
    assert len(fills) == bins and sorted((100 - fills).astype(int).tolist()) == plain_best_fit(sizes.tolist(), 100)


def fewest(sizes, size):
    """By trying everything."""

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for i in range(len(rooms)):
            if rooms[i] >= sizes[k]:
                place(k + 1, [*rooms[:i], rooms[i] - sizes[k], *rooms[i + 1 :]])
        place(k + 1, [*rooms, size - sizes[k]])

    best = len(sizes) + 1
    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(12))
def test_bound_and_search_against_all_packings(seed):
    rng = np.random.default_rng(seed)
    sizes = -np.sort(-rng.integers(1, 21, 9))
    least = fewest(sizes.tolist(), 20)
    assert -(-int(sizes.sum()) // 20) <= lower_bound(sizes, 20) <= least
    found = evolve(sizes, [], lower_bound(sizes, 20), 20, rng, 20, 6)
    assert fitness(sizes, found[0])[0] == least


def valid(sizes, bin_of, size):
    fills = np.bincount(bin_of, weights=sizes)
    return (bin_of >= 0).all() and (fills > 0).all() and fills.max() <= size


def test_crossover_keeps_bins_whole():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 101, 400)
    order = np.argsort(-sizes, kind="stable")
    a, b = evolve(sizes, [], 0, 100, rng, 0, 4)[:2]
    child = crossover(sizes, a, b, order, 100, rng)
    assert valid(sizes, child, 100) and valid(sizes, mutate(sizes, a, order, 100, rng), 100)
    groups = lambda p: {frozenset(np.flatnonzero(p == k).tolist()) for k in range(p.max() + 1)}
    assert len(groups(child) & groups(b)) > 5 and len(groups(child) & groups(a)) > 5


@pytest.mark.parametrize("low, high, n, size", [(20, 101, 250, 150), (350, 900, 1000, 2048)])
def test_search_beats_best_fit(low, high, n, size):
    rng = np.random.default_rng(11)
    sizes = rng.integers(low, high, n)
    bin_of = np.empty(n, np.int64)
    plain = best_fit(sizes, bin_of, np.argsort(-sizes, kind="stable"), [], size)
    bound = lower_bound(sizes, size)
    found = evolve(sizes, [bin_of], bound, size, rng, 30, 8)
    assert bound <= fitness(sizes, found[0])[0] < plain
    assert all(valid(sizes, p, size) for p in found)
    again = evolve(sizes, found, bound, size, rng, 5, 8)
    assert fitness(sizes, again[0]) <= fitness(sizes, found[0])


def test_islands_migrate(spark):
    """An island without packings of its own gets at least what its neighbour sends."""
    sizes = np.tile([500, 300, 200], 30)
    rows = np.arange(len(sizes))
    good = np.repeat(np.arange(30), 3)
    own = bestfit._row(5, 1, False, 30, len(sizes), rows, sizes, [])
    guest = bestfit._row(5, 1, True, 30, 30, np.empty(0), np.empty(0), [good])
    out = bestfit._epoch(1000, 3, 0, 0, 4)((5, 1), pd.DataFrame([own, guest]))
    assert out["bins"].tolist() == [30, 30] and out["island"].tolist() == [1, 2]
