from collections import defaultdict
import hashlib

from helpers import SF, awkward_docs, clashing, empty_docs
import pytest

from supplyspark.llm.exact import drop_exact_copies, exact_groups

COLUMNS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        same = groups[t or ""]
        keep = max((x for x in same if x is not None), default=None)
        kept = len(same) == 1 or i is not None and i == keep
        out.append((i, keep if keep is not None else i, len(same), kept, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [500_000, 0])
def test_groups(spark, limit):
    """With and without broadcasting the groups of a level."""
    docs = awkward_docs(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = exact_groups(clashing(docs), broadcast_groups=limit).select(*COLUMNS).collect()
    assert sorted(map(tuple, found), key=str) == expected(rows)


def test_same_length_and_prefix(spark):
    """Texts that differ only after the prefix aren't copies."""
    texts = ["p" * 100 + end for end in "abca"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_groups(docs).collect()}
    assert found == {0: (3, 2), 1: (1, 1), 2: (2, 1), 3: (3, 2)}


@pytest.mark.parametrize("limit", [500_000, 0])
def test_drop(spark, limit):
    docs = clashing(awkward_docs(spark))
    kept = drop_exact_copies(docs, broadcast_groups=limit)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([2, 4, 5, 6, 7, 8, 9, 10, None], key=str)


def test_empty(spark):
    assert exact_groups(empty_docs(spark)).count() == 0
    assert drop_exact_copies(empty_docs(spark)).count() == 0


def test_no_python_in_plan(spark):
    plan = exact_groups(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
