import zlib

from helpers import SF, awkward_docs, clashing, empty_docs
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from supplyspark.llm import packing
from supplyspark.llm.packing import curve_keys, hilbert_keys, pack, sequences

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(pieces, docs):
    """Every id lies in exactly one piece; sequences have no gaps and no padding. Docs may repeat."""
    tokenizer = Tokenizer.from_file(PATH)
    wanted = sorted((str(i), (*tokenizer.encode(t or "", add_special_tokens=False).ids, 0)) for i, t in docs)
    rows = sorted(pieces.collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    place, joined = {}, []
    for r in rows:
        assert place.get(r["sequence_id"], 0) == r["offset"]
        place[r["sequence_id"]] = r["offset"] + r["length"]
        ids = np.frombuffer(bytes(r["ids"]), "<u4")
        assert len(ids) == r["length"] > 0
        joined.append((str(r["doc_id"]), r["start"], r["doc_tokens"], ids))
    # Pieces of one document follow each other in the packed order.
    found, open_ = [], []
    for i, start, n, ids in joined:
        assert start == sum(map(len, open_))
        open_.append(ids)
        if start + len(ids) == n:
            found.append((i, tuple(np.concatenate(open_).tolist())))
            open_ = []
    assert not open_ and sorted(found) == wanted
    assert all(n == 1024 or n & (n - 1) == 0 for n in place.values())


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pieces = pack(docs, PATH, public_tokenizers.PATTERN, partition_tokens=20_000)
    check(pieces, [(r["doc_id"], r["text"]) for r in docs.collect()])
    whole = {r["sequence_id"]: len(r["ids"]) // 4 for r in sequences(pieces).collect()}
    assert sum(whole.values()) == pieces.groupBy().sum("length").first()[0]


def test_awkward(spark, monkeypatch):
    docs = clashing(awkward_docs(spark))
    check(pack(docs, PATH, public_tokenizers.PATTERN), [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert pack(empty_docs(spark), PATH, public_tokenizers.PATTERN).count() == 0


def test_long_text_library(monkeypatch):
    """The path for long texts gives the same ids."""
    use = packing._encoder(PATH, public_tokenizers.PATTERN)
    text = "Ein Text, and réeux 123 <|endoftext|>  \n\n x" * 3
    short = use.encode(text).tolist()
    monkeypatch.setattr(packing, "LONG_TEXT", 1)
    assert use.encode(text).tolist() == short == use.exact.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("dimensions, bits", [(2, 4), (3, 3)])
def test_hilbert_curve(dimensions, bits):
    """A bijection whose successive points are neighbours."""
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions, indexing="ij"), -1).reshape(-1, dimensions)
    keys = hilbert_keys(grid, bits)
    assert sorted(keys) == list(range(len(grid)))
    walk = grid[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_similar_documents_are_near():
    rng = np.random.default_rng(1)
    topics = [rng.integers(0, 50_000, 60) for _ in range(8)]
    docs = [rng.choice(topics[k % 8], 400) for k in range(160)]
    order = np.argsort(curve_keys(docs), kind="stable")
    same = np.mean([order[i] % 8 == order[i + 1] % 8 for i in range(159)])
    assert same > 0.6  # 1/8 by chance
    assert zlib.crc32(curve_keys(docs).tobytes()) == zlib.crc32(curve_keys(docs).tobytes())
