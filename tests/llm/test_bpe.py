import hashlib
import random

from helpers import awkward_docs, clashing, empty_docs
from hypothesis import given, settings
from hypothesis import strategies as st
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from supplyspark.llm.bpe import BytePairCodec, codec, decode_documents, encode_documents, load_ranks

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(PATH), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="aeinrst \n-=", max_size=200))
def test_random_texts(text):
    use = codec(PATH, public_tokenizers.PATTERN)
    wanted = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=use.ranks, special_tokens={}) if not hasattr(test_random_texts, "own") else test_random_texts.own
    test_random_texts.own = wanted
    ids = use.encode(text)
    assert ids.tolist() == wanted.encode_ordinary(text)
    assert use.decode(ids) == text.encode()


def test_small_vocabulary():
    """Merges by rank, by hand: 'ab' first, then 'abc', so 'bc' only where no 'ab' is."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"aa": 259}
    use = BytePairCodec(ranks, r"\S+|\s+")
    assert use.encode_piece(b"abcbc") == [258, 257]
    assert use.encode_piece(b"aabc") == [97, 258]
    rng = random.Random(2)
    own = tiktoken.Encoding("small", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    for _ in range(500):
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 20)))
        assert use.encode(text).tolist() == own.encode_ordinary(text)


def test_long_runs(reference):
    use = codec(PATH, public_tokenizers.PATTERN)
    for text in ("a" * 3000, "ab" * 2000, " " * 2000, "\n \n" * 300, "é" * 1000, "-=" * 1500):
        assert use.encode(text).tolist() == reference.encode_ordinary(text)


def test_documents(spark, reference):
    docs = clashing(awkward_docs(spark))
    rows = decode_documents(encode_documents(docs, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN).collect()
    texts = sorted((r["text"] or "" for r in docs.collect()))
    assert sorted(bytes(r["decoded"]).decode() for r in rows) == texts
    for r in rows:
        wanted = np.array(reference.encode_ordinary(bytes(r["decoded"]).decode()), dtype="<u4").tobytes()
        assert hashlib.sha256(bytes(r["ids"])).digest() == hashlib.sha256(wanted).digest() and r["n_tokens"] == len(wanted) // 4
    assert encode_documents(empty_docs(spark), PATH, public_tokenizers.PATTERN).count() == 0
