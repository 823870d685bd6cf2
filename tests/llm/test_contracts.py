"""The registered queries over sf0.001: names, types and values against plain Python."""

from collections import Counter
import hashlib
import math
import zlib

from helpers import SF, held_out, near_components, words
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from supplyspark.llm.common import read

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in read(spark, SF, "documents").collect()}


@pytest.fixture(scope="module")
def ids(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return {i: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], dtype="<u4") for i, t in texts.items()}


def run(spark, name, types):
    out = corpus_pipeline.QUERIES[name](spark, SF)
    assert {c: t for c, t in out.dtypes if c in types} == types
    return out.collect()


def test_op1(spark, ids):
    rows = run(spark, "op1_token_output", {"slot": "bigint", "shard": "bigint", "byte_offset": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"})
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert sum(r.n_tokens for r in rows) == sum(map(len, ids.values()))
    assert all(r.byte_offset % (4 + 2 * 1024) == 0 and 0 < r.n_tokens <= 1024 for r in rows)


def test_op2(spark, texts):
    rows = run(spark, "op2_minhash_near_dedup", {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"})
    wanted = near_components(list(texts.items()))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == wanted and len(rows) == len(texts)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_op3(spark, ids):
    types = dict.fromkeys(("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"), "bigint")
    rows = run(spark, "op3_packing", types)
    place, seen = {}, Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert place.get(r.sequence_id, 0) == r.offset
        place[r.sequence_id] = r.offset + r.length
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        seen[r.doc_id] += r.length
    assert seen == {i: len(x) for i, x in ids.items()} and max(place.values()) <= 1024


def test_op5(spark, texts):
    rows = run(spark, "op5_toxicity", {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"})
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(r.held_out == held_out(r.doc_id, 5, 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    labels = {r["doc_id"]: r["toxic"] for r in read(spark, SF, "labels").collect()}
    toxic, clean = ([r.score for r in rows if labels.get(r.doc_id) == k] for k in (1, 0))
    assert np.mean(toxic) > np.mean(clean) + 0.3


def test_op6(spark, texts):
    types = {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"}
    rows = run(spark, "op6_lm_scoring", types)
    tokens = {i: [*words(t), None] for i, t in texts.items()}
    counts = Counter(w for i, t in tokens.items() if not held_out(i, 7, 2) for w in t)
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        t = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held_out(r.doc_id, 7, 2), len(t), sum(counts[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), rel=1e-9)
        assert r.score < 0
    assert len(rows) == len(texts)


def test_op7(spark, texts):
    rows = run(spark, "op7_byte_bpe", {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"})
    import base64

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in rows:
        t = plain.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(t), hashlib.sha256(np.array(t, dtype="<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert len(rows) == len(texts)


def test_op8(spark, texts):
    from supplyspark.llm import pii

    types = dict.fromkeys(("doc_id", "n_email", "n_ip", "n_card", "n_phone"), "bigint") | {"base_sha256": "string", "spans": "string"}
    rows = run(spark, "op8_pii", types)
    for r in rows:
        kinds = Counter(s.split(":")[0] for s in r.spans.split(",") if s)
        assert all(kinds[k] >= r[f"n_{k}"] for k in pii.BASE_KINDS) and len(r.base_sha256) == 64
        assert all(0 <= int(a) < int(b) <= len(texts[r.doc_id]) for _, a, b in (s.split(":") for s in r.spans.split(",") if s))
    assert sorted(r.doc_id for r in rows) == sorted(texts)


def test_op10(spark):
    rows = run(spark, "op10_graph_ann", {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"})
    data = {r["vec_id"]: np.array(r["embedding"], "f8") for r in read(spark, SF, "embeddings").collect() if r["embedding"] is not None}
    found = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append(r.vec_id)
        assert r.rank == len(found[r.query_id]) and r.query_id % 100 == 0
        assert r.score == pytest.approx(float(np.linalg.norm(data[r.query_id] - data[r.vec_id])), rel=1e-12)
    hits = [len(set(v) & set(sorted((i for i in data if i != q), key=lambda i: (np.linalg.norm(data[q] - data[i]), i))[:10])) for q, v in found.items()]
    assert np.mean(hits) >= 9.5
