from collections import Counter, defaultdict
import math

from helpers import SF, awkward_docs, clashing, empty_docs, held_out, words
import pytest

from supplyspark.llm import language_model
from supplyspark.llm.language_model import score, train


class Plain:
    """The model with dictionaries."""

    def __init__(self, texts):
        self.word, self.pair = Counter(), Counter()
        for text in texts:
            last = "<s>"
            for w in [*words(text), None]:
                self.word[w] += 1
                self.pair[last, w] += 1
                last = w
        self.n, self.v = sum(self.word.values()), len(self.word)
        self.before = Counter(w for _, w in self.pair)
        self.d, self.u = self.discounts(self.pair), self.discounts(self.before)
        self.rest = sum(self.u[min(k, 3)] for k in self.before.values())
        self.total, self.kinds = Counter(), defaultdict(Counter)
        for (c, _), k in self.pair.items():
            self.total[c] += k
            self.kinds[c][min(k, 3)] += 1

    @staticmethod
    def discounts(counts):
        n1, n2, n3, n4 = (Counter(counts.values())[k] for k in (1, 2, 3, 4))
        if not (n1 and n2 and n3 and n4):
            return {0: 0, 1: 0.5, 2: 1.0, 3: 1.5}
        y = n1 / (n1 + 2 * n2)
        d = {1: 1 - 2 * y * n2 / n1, 2: 2 - 3 * y * n3 / n2, 3: 3 - 4 * y * n4 / n3}
        return {0: 0} | {k: min(max(x, 0), k) for k, x in d.items()}

    def one(self, w):
        if not self.pair:
            return 1 / (self.v + 1)
        k = self.before[w]
        return max(k - self.u[min(k, 3)], 0) / len(self.pair) + self.rest / len(self.pair) / (self.v + 1)

    def two(self, c, w):
        if c not in self.total:
            return self.one(w)
        k = self.pair[c, w]
        rest = sum(self.d[j] * n for j, n in self.kinds[c].items())
        return max(k - self.d[min(k, 3)], 0) / self.total[c] + rest / self.total[c] * self.one(w)

    def row(self, text):
        tokens = [*words(text), None]
        before = ["<s>", *tokens[:-1]]
        return (
            len(tokens),
            sum(self.word[w] > 0 for w in tokens),
            sum(math.log10((self.word[w] + 1) / (self.n + self.v + 1)) for w in tokens),
            sum(math.log10(self.two(c, w)) for c, w in zip(before, tokens, strict=True)),
        )


@pytest.mark.parametrize("shard_bytes", [32 << 20, 20_000])
def test_against_dictionaries(spark, monkeypatch, shard_bytes):
    """One shard, and many with spread contexts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    learned = [i for i in rows if not held_out(i, 7, 2)]
    model = train(docs.filter("crc32(cast(cast(doc_id as string) as binary)) % 7 <> 2"), shard_bytes=shard_bytes)
    plain = Plain([rows[i] for i in learned])
    assert (model.tokens, model.vocabulary, model.pair_types) == (plain.n, plain.v, len(plain.pair))
    assert shard_bytes > 20_000 or model.shards > 10
    for r in score(docs, model).collect():
        assert (r["n_tokens"], r["n_known"], r["base_score"], r["score"]) == pytest.approx(plain.row(rows[r["doc_id"]]), rel=1e-9)
    assert sum(plain.two("the", w) for w in [*plain.word, "no such word"]) == pytest.approx(1)


def test_awkward(spark, monkeypatch):
    monkeypatch.setattr(language_model, "BUFFER", 1000)
    docs = clashing(awkward_docs(spark))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    plain = Plain([t for _, t in rows])
    found = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in score(docs, train(docs)).collect())
    assert found == sorted((str(i), n, k, round(b, 6), round(s, 6)) for i, t in rows for n, k, b, s in [plain.row(t)])


def test_empty(spark):
    model = train(empty_docs(spark))
    assert score(empty_docs(spark), model).count() == 0
    assert {r["score"] for r in score(awkward_docs(spark), model).collect()} == {0.0}


def test_other_stores(tmp_path):
    """A store without local paths is read through a copy."""
    import numpy as np

    uri = language_model.save(str(tmp_path), np.arange(5, dtype=np.uint64))
    assert language_model.load(uri).tolist() == [0, 1, 2, 3, 4]
    empty = language_model.save(str(tmp_path), np.empty(0, np.uint8))
    assert len(language_model.load(empty)) == 0
