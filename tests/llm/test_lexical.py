from collections import Counter
import math
import re

from compare import connect, differences
from helpers import SF, awkward_docs, clashing, empty_docs, lower_ascii
import numpy as np
import pytest

import corpus_pipeline
from supplyspark.llm import lexical
from supplyspark.llm.lexical import LexicalIndex, Shard, _unpack


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower_ascii(text or ""))


def plain_python(docs, items, k=10):
    counts = [(i, Counter(terms_of(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        wanted = set(terms_of(text)) & set(df)
        found = []
        for i, c, n in counts:
            m = 100 - 90 + (90 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in wanted)
            if score > 0:
                found.append((-score, math.inf if i is None else i, i))
        out += [(item, rank, i, -score) for rank, (score, _, i) in enumerate(sorted(found, key=lambda x: x[:2])[:k], 1)]
    return out


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("shard_postings", [lexical.SHARD_POSTINGS, 3000])
def test_documents(spark, shard_postings):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    found = LexicalIndex(docs, shard_postings=shard_postings).search(items)
    wanted = plain_python([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert rows(found) == sorted(wanted, key=str)


def test_awkward(spark, monkeypatch):
    """Clashing names, ties, repeated rows and items, a null id, terms of every kind, items in several blocks."""
    monkeypatch.setattr(lexical, "QUERY_BLOCK", 2)
    docs = clashing(awkward_docs(spark))
    items = spark.createDataFrame(
        [(1, "One two, NAÏVE"), (1, "seven"), (2, None), (3, ""), (4, "nothing_here"), (5, "Ï漢字 end W7"), (6, "x x X"), (None, "table")],
        "item_id long, text string",
    ).selectExpr("*", "1 AS term", "2 AS item", "3 AS weight", "4 AS doc_id")
    for k in (1, 3, 10):
        found = LexicalIndex(docs, shard_postings=5).search(items, k)
        wanted = plain_python([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()], k)
        assert rows(found) == sorted(wanted, key=str) and wanted


def test_empty(spark):
    docs, items = awkward_docs(spark), spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert rows(LexicalIndex(empty_docs(spark)).search(items)) == []
    assert rows(LexicalIndex(docs).search(items.limit(0))) == []


def test_many_ties(spark):
    """Equal texts: the smallest ids win, whatever shard they are in."""
    docs = spark.createDataFrame([((i * 7919) % 500, "same words here") for i in range(500)] + [(1000, "other")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "words")], "item_id long, text string")
    found = LexicalIndex(docs.repartition(5), shard_postings=60).search(items)
    assert [r[2] for r in sorted(rows(found), key=lambda r: r[1])] == list(range(10))


def test_strata_are_skipped(spark):
    """The bounds hold, and a search leaves strata unvisited."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    index = LexicalIndex(docs)
    row = index.shards.first().asDict()
    shard = Shard(row, *index.totals)
    assert (np.diff(shard.m) > 0).all()
    rising = shard.impact[1:] > shard.impact[:-1]
    assert set(np.flatnonzero(rising) + 1) <= set(shard.run_start)  # falls within each term and stratum
    df = _unpack(row["df"], "<u4", row["n_terms"])
    rare = shard.terms[np.argsort(df, kind="stable")[:3]]
    opened = []
    shard.doc, real = _Watched(shard.doc, opened), shard.doc
    best = shard.search(rare, np.array([5000, 4000, 3000]), (np.empty(0, np.int64), np.empty(0, np.int64)), 2)
    assert len(best[0]) == 2 and sum(opened) < len(real)


class _Watched:
    def __init__(self, array, seen):
        self.array, self.seen = array, seen

    def __getitem__(self, at):
        self.seen.append(len(at))
        return self.array[at]


def test_contract(spark):
    out = corpus_pipeline.QUERIES["op11_lexical_search"](spark, SF)
    assert out.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert differences(out, connect(SF), corpus_pipeline.ORACLE["op11_lexical_search"]) == []
