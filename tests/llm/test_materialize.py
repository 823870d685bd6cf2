from helpers import SF, awkward_docs, clashing, empty_docs
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from supplyspark.llm.common import prepare
from supplyspark.llm.materialize import Permutation, read_records, read_shards, write_shards

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation(n):
    order, other = Permutation(n, 5), Permutation(n, 6)
    slots = order.slot(np.arange(n))
    assert sorted(slots) == list(range(n))
    assert (order.index(slots) == np.arange(n)).all()
    if n >= 1000:
        assert (slots != other.slot(np.arange(n))).mean() > 0.9
        assert abs(np.corrcoef(slots, np.arange(n))[0, 1]) < 0.1


def stream(docs):
    """Ids of all texts in scan order, partition by partition."""
    tokenizer = Tokenizer.from_file(PATH)
    parts = docs.select("text").rdd.glom().collect()
    return [np.concatenate([[*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in part]).astype("<u4") for part in parts if part]


def check(spark, docs, size=128, shard_sequences=10):
    prepare(spark)
    manifest = write_shards(docs, PATH, public_tokenizers.PATTERN, size=size, shard_sequences=shard_sequences, key=3)
    rows = {r["slot"]: np.frombuffer(bytes(r["ids"]), "<u4") for r in read_shards(manifest).collect()}
    n = len(rows)
    assert sorted(rows) == list(range(n))
    wanted = [part[a : a + size] for part in stream(docs) for a in range(0, len(part), size)]
    assert len(wanted) == n
    slots = Permutation(n, 3).slot(np.arange(n))
    assert all((rows[s] == w).all() and len(rows[s]) == len(w) for s, w in zip(slots.tolist(), wanted, strict=True))
    for row in manifest.collect():
        assert row["first_slot"] == row["shard"] * shard_sequences and row["sequences"] <= shard_sequences
        assert row["stride"] == 4 + 2 * size
    return manifest, rows


def test_documents_and_resuming(spark):
    manifest, rows = check(spark, spark.read.parquet(f"{SF}/documents.parquet"))
    from_slot = len(rows) // 2
    later = {r["slot"]: bytes(r["ids"]) for r in read_shards(manifest, from_slot).collect()}
    assert sorted(later) == list(range(from_slot, len(rows)))
    row = manifest.filter("shard = 1").first()
    assert next(read_records(row["path"], row["first_slot"], row["stride"], row["width"], 13))[0] == 13


def test_awkward(spark):
    check(spark, clashing(awkward_docs(spark)), size=1024, shard_sequences=7)
    assert write_shards(empty_docs(spark), PATH, public_tokenizers.PATTERN).count() == 0
