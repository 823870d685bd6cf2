import numpy as np
from pyspark.sql import functions as F

from supplyspark.llm import neighbours
from supplyspark.llm.neighbours import GraphIndex, build_graph, robust_prune

SF = "/root/testdata/sf0.01"


def brute(rows, queries, k=10):
    out = {}
    for q, v in queries:
        near = sorted((float(np.sqrt(((np.array(v, "f8") - np.array(x, "f8")) ** 2).sum())), i) for i, x in rows if i != q)
        out[q] = near[:k]
    return out


def found_in(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(found, wanted):
    return np.mean([len({i for _, i in found[q]} & {i for _, i in wanted[q]}) / len(wanted[q]) for q in wanted])


def test_recall_on_embeddings(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    for shard_rows in (4000, 120):
        found = found_in(GraphIndex(df, shard_rows=shard_rows).search(F.col("vec_id") % 20 == 0))
        wanted = brute(rows, [r for r in rows if r[0] % 20 == 0])
        assert found.keys() == wanted.keys()
        assert recall(found, wanted) >= 0.95
        for q in found:
            assert found[q] == sorted(found[q])


def test_recall_in_one_graph():
    rng = np.random.default_rng(2)
    data = rng.normal(size=(1500, 16)).astype("f4")
    graph, start = build_graph(data)
    ids, _, _ = neighbours.beam_search(data, graph, start, data[:200], 64)
    wanted = ((data[:200, None] - data[None]) ** 2).sum(-1).argsort(1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(ids, wanted, strict=True)]) > 0.95


def test_pruning_by_hand():
    """On a line: 1 hides 2 and 3 behind it, -4 stays as the other direction."""
    data = np.array([[0.0], [1.0], [2.0], [3.0], [-4.0]], "f4")
    kept = robust_prune(data, np.array([0]), np.array([[1, 2, 3, 4, 2, -1]]), 1.2, 3)
    assert kept.tolist() == [[1, 4, -1]]


def test_ties_copies_and_rows_left_out(spark):
    """Hundreds of copies of one vector; nulls, zeros, non-finite components, other lengths, repeated rows."""
    rng = np.random.default_rng(6)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(300)] + [(i, rng.normal(size=3).tolist()) for i in range(300, 420)]
    rows += [(420, rows[-1][1]), rows[310]]
    odd = [(1000, None), (1020, [0.0, 0.0, 0.0]), (1040, [1.0, None, 2.0]), (1060, [float("nan"), 1.0, 1.0]), (1080, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (1100, [1.0, 1.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("node", F.lit("x"))
    found = found_in(GraphIndex(df, shard_rows=50).search(F.col("vec_id") % 20 == 0))
    plain = list({(i, tuple(v)) for i, v in rows})
    wanted = brute(plain, [r for r in plain if r[0] % 20 == 0])
    assert found.keys() == wanted.keys()
    for q in found:
        assert [i for _, i in found[q]] == [i for _, i in wanted[q]]
        assert np.allclose([s for s, _ in found[q]], [s for s, _ in wanted[q]], rtol=1e-12)


def test_few_and_no_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BATCH", 2)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 1)
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (20, [1.0, 1.0])], "vec_id long, embedding array<float>")
    found = found_in(GraphIndex(few).search(F.col("vec_id") % 20 == 0))
    assert {q: [i for _, i in v] for q, v in found.items()} == {0: [20, 1], 20: [0, 1]}
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert GraphIndex(none).search(F.col("vec_id") % 20 == 0).count() == 0


def test_large_and_small_vectors(spark):
    """Magnitudes whose squares overflow or vanish, one at a time and together."""
    rng = np.random.default_rng(8)
    for scale in (1e20, 1e-20, 1e200, 1e-200):
        rows = [(i, (rng.normal(size=4) * scale).tolist()) for i in range(60)]
        found = found_in(GraphIndex(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard_rows=25).search(F.col("vec_id") % 20 == 0))
        wanted = brute([(i, [x / scale for x in v]) for i, v in rows], [(i, [x / scale for x in v]) for i, v in rows if i % 20 == 0])
        for q in wanted:
            assert [i for _, i in found[q]] == [i for _, i in wanted[q]]
            assert np.allclose([s / scale for s, _ in found[q]], [s for s, _ in wanted[q]])
    rows = [(i, (rng.normal(size=4) * (1e20 if i % 2 else 1e-20)).tolist()) for i in range(60)]
    found = found_in(GraphIndex(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).search(F.col("vec_id") % 20 == 0))
    assert {len(v) for v in found.values()} == {10}


def test_one_partition_for_each_shard(spark):
    df = spark.createDataFrame([(i, [float(i % 7), float(i)]) for i in range(130)], "vec_id long, embedding array<double>")
    index = GraphIndex(df, shard_rows=10)
    assert index.shards.count() == 13 and sum(len(r["ids"]) for r in index.shards.collect()) == 129 * 8  # the zero vector takes no part
