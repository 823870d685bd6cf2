import random

from helpers import SF, awkward_docs, clashing, empty_docs, held_out
import numpy as np
from pyspark.sql import functions as F

from supplyspark.llm import toxicity
from supplyspark.llm.toxicity import BlockMaxIndex, drop_toxic, fit, score_texts


def test_index_is_exact():
    """Block-max search against all cosines, ties included."""
    rng = np.random.default_rng(5)
    vectors = []
    for _ in range(700):
        terms = tuple(sorted(rng.choice(30, rng.integers(1, 6), replace=False).tolist()))
        w = rng.integers(1, 3, len(terms)).astype(float)
        vectors.append((terms, w / np.linalg.norm(w)))
    labels = rng.integers(0, 2, 700).tolist()
    index = BlockMaxIndex(vectors, labels, list(range(700)), 30)
    dense = np.zeros((index.size, 30))
    for row, (terms, w) in enumerate(vectors):
        dense[index.entry_of[row], list(terms)] = w
    assert index.votes[:, 0].sum() == 700 and index.votes[:, 1].sum() == sum(labels)
    for terms, w in vectors[:150]:
        found, similarity = index.nearest(terms, w, 9)
        query = np.zeros(30)
        query[list(terms)] = w
        every = dense @ query
        wanted = np.sort(every)[::-1][:9]
        assert np.allclose(similarity, wanted) and np.allclose(every[found], wanted)


def labelled(spark, n=400, seed=1):
    """Texts of which a tenth hold an insult; all of these are labelled toxic."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        text = [f"{rng.choice('abcdefgh')}{rng.choice('uvwxyz')}{rng.choice('kl')}o{rng.randrange(50)}" for _ in range(40)]
        toxic = i % 10 == 0
        if toxic:
            for _ in range(3):
                text[rng.randrange(40)] = rng.choice(["Blorgish", "blorgs", "zaxxed"])
        docs.append((i, " ".join(text), "en", "s", 0))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = labelled(spark)
    model = fit(docs, labels)
    rows = score_texts(docs, model).collect()
    apart = [r for r in rows if held_out(r["doc_id"], 5, 0)]
    assert len(apart) > 40
    assert all(r["predicted"] == int(r["doc_id"] % 10 == 0) for r in apart)
    assert all(0 <= r["score"] <= 1 and r["evidence"] for r in rows)
    kept = drop_toxic(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i in range(400) if i % 10}


def test_labels_of_held_out_rows_are_not_used(spark):
    docs, labels = labelled(spark)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((r["doc_id"], r["score"]) for r in score_texts(docs, fit(docs, x)).collect()) for x in (labels, flipped))
    assert a == b


def test_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    assert score_texts(docs, fit(docs, labels)).count() == docs.count()


def test_awkward(spark):
    docs = awkward_docs(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in score_texts(docs, fit(docs, none)).collect()} == {0.0}
    odd = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (999, 1), (6, 0)], "doc_id long, toxic int")
    clash = clashing(docs).drop("score")
    model = fit(clashing(docs), odd)
    assert score_texts(clash, model).count() == docs.count()
    assert drop_toxic(clashing(docs), model).columns == clashing(docs).columns
    assert score_texts(empty_docs(spark), fit(empty_docs(spark), odd)).count() == 0
