import random

from helpers import SF, awkward_docs, clashing, empty_docs, near_components, shingles
import numpy as np
import pytest

from supplyspark.llm import sketch
from supplyspark.llm.common import components
from supplyspark.llm.sketch import drop_near_copies, near_duplicates


def found_in(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def families(seed=5):
    """Chains and stars of copies whose links are near the threshold."""
    rng = random.Random(seed)
    docs = []
    for family in range(6):
        base = [f"f{family}w{rng.randrange(10_000)}" for _ in range(120)]
        for _ in range(12):
            text = list(base)
            for _ in range(rng.choice([1, 2, 3, 4])):
                text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
            docs.append(" ".join(text))
            if rng.random() < 0.3:
                base = text
    rng.shuffle(docs)
    return list(enumerate(docs))


def test_families_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(sketch, "BROADCAST_IDS", 0)
    docs = families()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert found_in(near_duplicates(df)) == near_components(docs)


def test_documents_against_all_pairs(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    found = near_duplicates(df)
    assert found_in(found) == near_components([(r["doc_id"], r["text"]) for r in df.collect()])
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found.collect())


def test_awkward(spark):
    df = clashing(awkward_docs(spark))
    rows = near_duplicates(df).collect()
    assert len(rows) == df.count()
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows}
    assert found[1] == found[1] and found[2] == (3, 1, False) and found[8] == (3, 1, False)
    assert [found[i] for i in (3, 4, 5)] == [(0, 3, True), (0, 4, True), (0, 5, True)]
    assert found[6][1] == found[7][1] == 6 and found[10] == (1, 10, True)
    assert found[None][2] is False
    kept = drop_near_copies(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 3, 4, 5, 6, 9, 10, None], key=str)


def test_empty(spark):
    assert near_duplicates(empty_docs(spark)).count() == 0


def test_shingle_sets():
    texts = ["", " ", "a b", "A b", "b a", "a b c d e", "a b c d e a b c d e", "é É x\vy z w"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    values, starts = sketch.shingle_sets(data, offsets)
    sets = [frozenset(values[a:b].tolist()) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    assert sets[2] == sets[3] != sets[4] and sets[5] < sets[6]


@pytest.mark.parametrize("similarity", [0.2, 0.5, 0.8, 0.95])
def test_estimate(similarity):
    """Registers of known overlaps: the likeliest similarity is close, and pairs from the threshold on are kept."""
    rng = np.random.default_rng(3)
    guesses, kept = [], 0
    for _ in range(40):
        common = round(800 * similarity / (1 + similarity))
        a, b = (rng.integers(0, 1 << 63, 400, dtype=np.uint64) for _ in range(2))
        b[:common] = a[:common]
        r = sketch.registers(np.concatenate([a, b]), np.array([0, 400, 800]))
        guess, possible = sketch.likelihood((r[:1] > r[1:]).sum(axis=1), (r[:1] < r[1:]).sum(axis=1), np.array([400.0]), np.array([400.0]))
        guesses.append(guess[0])
        kept += bool(possible[0])
    assert abs(np.mean(guesses) - similarity) < 0.04
    assert kept == 40 if similarity >= 0.8 else kept < 40 if similarity <= 0.5 else True


def test_registers_of_a_union():
    rng = np.random.default_rng(4)
    a, b = (rng.integers(0, 1 << 63, 50, dtype=np.uint64) for _ in range(2))
    one, other = sketch.registers(np.concatenate([a, b]), np.array([0, 50, 100]))
    both = sketch.registers(np.concatenate([a, b]), np.array([0, 100]))[0]
    assert (both == np.maximum(one, other)).all()


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(200 + rng.randrange(80), 200 + rng.randrange(80)) for _ in range(60)]
    from helpers import components as plain

    wanted = plain({n for link in links for n in link}, links)
    found = components(spark.createDataFrame(links, "a long, b long"))
    assert {r["node"]: r["component"] for r in found.collect()} == {n: c for n, c in wanted.items() if n != c}


def test_pairs_of_a_block_take_few_likelihoods(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(3)
    n = 60
    base = rng.integers(0, 1 << 16, sketch.REGISTERS, dtype=np.uint16)
    rows = np.repeat(base[None, :], n, axis=0)
    for row in rows[1:]:
        row[rng.integers(sketch.BAND_SIZE, sketch.REGISTERS, 15)] = rng.integers(0, 1 << 16, 15, dtype=np.uint16)
    zeros = np.zeros(n, dtype=np.int64)
    table = pa.table({
        "i": zeros, "j": zeros, "own": zeros, "band": zeros.astype(np.int32), "n": np.full(n, 100), "component": np.arange(n),
        "node": np.arange(n), "sketch": pa.array([r.tobytes() for r in rows], pa.binary()),
    })
    calls, real = [], sketch.likelihood
    monkeypatch.setattr(sketch, "likelihood", lambda *a: calls.append(len(a[0])) or real(*a))
    found = {(k, int(b)) for k, at in sketch._undecided(table) for b in at}
    assert len(calls) == 1
    expected = set()
    for a in range(n):
        for b in range(a + 1, n):
            larger, smaller = (rows[a] > rows[b]).sum(), (rows[a] < rows[b]).sum()
            if sketch.REGISTERS - larger - smaller >= sketch.LEAST_EQUAL:
                if real(np.array([larger]), np.array([smaller]), np.array([100.0]), np.array([100.0]))[1][0]:
                    expected.add((a, b))
    assert found == expected and expected
    monkeypatch.setattr(sketch, "PAIRS_AT_ONCE", 7)
    assert {(k, int(b)) for k, at in sketch._undecided(table) for b in at} == expected
