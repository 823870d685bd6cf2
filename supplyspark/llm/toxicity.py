"""Toxicity by the nearest labelled examples.

Terms are words and word prefixes; those that tell the classes apart best on a
bounded sample of labelled rows are kept, and one more term counts the words of
a text. The examples' TF-IDF vectors over these terms are an inverted index
whose lists know the largest weight in each block of examples. A query opens
blocks in the order of their bounds and stops when no other block can reach the
k-th similarity, so its k nearest examples are exact. Their votes, weighted by
distance, are mapped to probabilities by an isotonic fit to the votes that
examples get when they are left out themselves.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
import regex

from supplyspark.llm.common import staged, texts_of, trimmed

# Labelled rows the classifier is fitted on; those with the smallest hash of their id.
SAMPLE_ROWS = 8000
TERMS = 256
LEAST_ROWS = 3  # of the sample in which a term occurs
PREFIXES = range(3, 8)
NEIGHBOURS = 15
BLOCK = 64
WORDS_WEIGHT = 1.0  # in place of an IDF, for the count of words
KNOWN = 5000  # vectors whose scores a worker remembers
NEAR = 0.02  # a vote weighs 1 / (NEAR + distance)

_WORD = regex.compile(r"\p{L}+")


def word_counts(text: str) -> Counter:
    return Counter(_WORD.findall(text.lower()))


def terms_of(word: str) -> list[str]:
    """The word itself, marked by ``$``, and its prefixes."""
    return [word + "$", *(word[:n] for n in PREFIXES if len(word) >= n)]


def term_counts(text: str) -> Counter:
    found: Counter = Counter()
    for word, n in word_counts(text).items():
        for term in terms_of(word):
            found[term] += n
    return found


def choose_terms(sample: DataFrame, n_rows: int, n_toxic: int) -> dict[str, int]:
    """Terms by chi-square, with the rows they occur in. ``sample`` has text and label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, toxic = Counter(), Counter()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                terms = term_counts(text).keys()
                rows.update(terms)
                if label:
                    toxic.update(terms)
            names = list(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([rows[t] for t in names], pa.int64()), pa.array([toxic[t] for t in names], pa.int64())],
                ["term", "rows", "toxic"],
            )

    counts = sample.select("text", "label").mapInArrow(run, "term string, rows long, toxic long")
    counts = counts.groupBy("term").agg(F.sum("rows").alias("rows"), F.sum("toxic").alias("toxic"))
    kept = counts.filter((F.col("rows") >= LEAST_ROWS) & (F.col("toxic") * n_rows > F.col("rows") * n_toxic))
    a, b = F.col("toxic"), F.col("rows") - F.col("toxic")
    c, d = n_toxic - a, n_rows - n_toxic - b
    cross = a.cast("double") * d - b * c
    chi = n_rows * cross * cross / F.greatest(F.lit(1.0), a.cast("double") + b) / F.greatest(F.lit(1.0), c.cast("double") + d)
    ranked = kept.withColumn("chi", chi).orderBy(F.desc("chi"), F.desc(F.length("term")), "term").limit(8 * TERMS)
    chosen: dict[str, int] = {}
    stats: dict[tuple, list[str]] = {}
    for row in ranked.collect():
        # A prefix of a chosen term in just the same rows adds nothing.
        same = stats.setdefault((row["rows"], row["toxic"]), [])
        if not any(t.startswith(row["term"]) for t in same) and len(chosen) < TERMS:
            chosen[row["term"]] = row["rows"]
            same.append(row["term"])
    return chosen


@dataclass
class Vectorizer:
    """Unit TF-IDF vectors as (term numbers, weights); the last term is the count of words."""

    numbers: dict[str, int]
    idf: np.ndarray

    def __post_init__(self):
        self.stems = {term.rstrip("$")[: PREFIXES[0]] for term in self.numbers}
        self.cut = PREFIXES[0]

    def vector(self, text: str) -> tuple[tuple[int, ...], np.ndarray]:
        counts: dict[int, int] = {}
        total = 0
        for word, n in word_counts(text).items():
            total += n
            if word[: self.cut] in self.stems:
                for term in terms_of(word):
                    number = self.numbers.get(term)
                    if number is not None:
                        counts[number] = counts.get(number, 0) + n
        terms = tuple(sorted(counts))
        tf = np.array([counts[t] for t in terms] + [1 + total], dtype=np.float64)
        terms += (len(self.numbers),)
        weights = (1 + np.log(tf)) * self.idf[list(terms)]
        return terms, weights / np.sqrt((weights**2).sum())


class BlockMaxIndex:
    """Inverted lists over examples in a fixed order, with each block's largest weight for each term.

    Examples with the same vector are one entry with their counts.
    """

    def __init__(self, vectors: list[tuple[tuple[int, ...], np.ndarray]], labels: list[int], ids: list[int], n_terms: int):
        entries: dict[tuple, list[int]] = {}
        for row, (terms, weights) in enumerate(vectors):
            entries.setdefault((terms, tuple(np.round(weights, 12))), []).append(row)
        # Neighbours in this order share terms, which keeps the bounds tight.
        keys = sorted(entries)
        self.votes = np.array([[len(entries[k]), sum(labels[r] for r in entries[k])] for k in keys], dtype=np.float64).reshape(-1, 2)
        self.example = np.array([min(ids[r] for r in entries[k]) for k in keys], dtype=np.int64)
        self.entry_of = {r: i for i, k in enumerate(keys) for r in entries[k]}
        n, self.blocks = len(keys), -(-len(keys) // BLOCK)
        postings: list[list[tuple[int, float]]] = [[] for _ in range(n_terms)]
        for i, (terms, weights) in enumerate(keys):
            for t, w in zip(terms, weights, strict=True):
                postings[t].append((i, w))
        self.lists = [(np.array([p[0] for p in ps], dtype=np.int64), np.array([p[1] for p in ps])) for ps in postings]
        self.largest = np.zeros((n_terms, self.blocks))
        self.bounds = np.zeros((n_terms, self.blocks + 1), dtype=np.int64)
        for t, (at, w) in enumerate(self.lists):
            np.maximum.at(self.largest[t], at // BLOCK, w)
            self.bounds[t] = np.searchsorted(at, np.arange(self.blocks + 1) * BLOCK)
        self.size = n

    def nearest(self, terms: tuple[int, ...], weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Entries and similarities of the k nearest, nearest first, ties to the smaller entry."""
        terms_list = list(terms)
        bound = weights @ self.largest[terms_list] + 1e-9
        order = np.argsort(-bound, kind="stable")
        found_at, found = np.empty(0, np.int64), np.empty(0)
        done, step, least = 0, 4, -np.inf
        while done < self.blocks and bound[order[done]] >= least:
            opened = np.sort(order[done : done + step])
            opened = opened[bound[opened] >= least]
            scores = np.zeros((len(opened), BLOCK))
            place = np.full(self.blocks, -1)
            place[opened] = np.arange(len(opened))
            for t, w in zip(terms_list, weights, strict=True):
                at, value = self.lists[t]
                low, high = self.bounds[t, opened[0]], self.bounds[t, opened[-1] + 1]
                at, value = at[low:high], value[low:high]
                row = place[at // BLOCK]
                hit = row >= 0
                scores[row[hit], at[hit] % BLOCK] += w * value[hit]
            entries = (opened[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            real = entries < self.size
            found_at, found = np.concatenate([found_at, entries[real]]), np.concatenate([found, scores.ravel()[real]])
            best = np.lexsort((found_at, -found))[:k]
            found_at, found = found_at[best], found[best]
            if len(found) == k:
                least = found[-1]
            done += step
            step *= 2
        return found_at, found


class Classifier:
    def __init__(self, vectorizer: Vectorizer, index: BlockMaxIndex, prior: float):
        self.vectorizer, self.index, self.prior = vectorizer, index, prior
        self.steps = np.array([0.0, 1.0]), np.array([prior, prior])
        self.known: dict[tuple, tuple[float, list]] = {}

    def vote(self, at: np.ndarray, similarity: np.ndarray, leave: tuple[int, int] | None = None) -> float:
        """Share of toxic votes. ``leave`` is (entry, label) of an example that does not vote."""
        votes = self.index.votes[at]
        if leave is not None:
            votes = votes - np.where((at == leave[0])[:, None], [[1, leave[1]]], 0)
        weight = 1 / (NEAR + np.maximum(0.0, 1 - similarity))
        return float((weight @ votes[:, 1] + self.prior) / (weight @ votes[:, 0] + 1.0))

    def calibrate(self, vectors: list, labels: list[int]) -> None:
        """Isotonic fit (pool adjacent violators) of labels to left-out votes."""
        left_out: dict[tuple[int, int], list] = {}
        for row, label in enumerate(labels):
            left_out.setdefault((self.index.entry_of[row], label), []).append(row)
        points = []
        for (entry, label), rows in left_out.items():
            found = self.index.nearest(*vectors[rows[0]], NEIGHBOURS)
            points.append((self.vote(*found, leave=(entry, label)), label, len(rows)))
        pools: list[list[float]] = []
        for x, y, n in sorted(points):
            pools.append([x * n, y * n, n])
            while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
        x = np.array([0.0, *(p[0] / p[2] for p in pools), 1.0])
        y = np.array([p[1] / p[2] for p in pools])
        self.steps = x, np.clip(np.concatenate([y[:1], y, y[-1:]]), 0.001, 0.999)

    def score(self, text: str) -> tuple[float, list[tuple[int, float, float]]]:
        """Score and evidence: nearest examples as (id, similarity, share of toxic labels)."""
        if not self.index.size:
            return self.prior, []
        terms, weights = self.vectorizer.vector(text)
        key = terms, tuple(np.round(weights, 12))
        if key not in self.known:
            if len(self.known) > KNOWN:
                self.known.clear()
            at, similarity = self.index.nearest(terms, weights, NEIGHBOURS)
            score = float(np.interp(self.vote(at, similarity), *self.steps))
            evidence = [
                (int(self.index.example[i]), float(s), float(self.index.votes[i, 1] / self.index.votes[i, 0]))
                for i, s in zip(at[:3], similarity[:3], strict=True)
            ]
            self.known[key] = score, evidence
        return self.known[key]


def held_out(doc_id: str = "doc_id"):
    """The id's hash remainder is 0. A null id is not held out and never labelled."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Classifier:
    """Fit on at most ``sample_rows`` labelled rows that are not held out.

    Without labelled rows every score is 0. Rows with a null label or id are
    not used; of contradicting labels for one id the larger counts.
    """
    texts = texts_of(docs)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    present = known.join(texts.select("doc_id"), "doc_id", "left_semi")
    chosen = staged(present.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows), "labelled")
    # At most sample_rows rows of 12 bytes; of repeated ids one text.
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    sample = staged(sample, "sample")
    n_rows, n_toxic = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not n_rows:
        return Classifier(Vectorizer({}, np.ones(1)), BlockMaxIndex([], [], [], 1), 0.0)
    chosen_terms = choose_terms(sample, n_rows, n_toxic)
    idf = np.array([*(np.log(n_rows / rows) for rows in chosen_terms.values()), WORDS_WEIGHT])
    vectorizer = Vectorizer({term: i for i, term in enumerate(chosen_terms)}, idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [vectorizer.vector(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([v[0] for v in vectors], pa.list_(pa.int32())), pa.array([v[1] for v in vectors], pa.list_(pa.float64()))],
                ["doc_id", "label", "terms", "weights"],
            )

    rows = sample.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label int, terms array<int>, weights array<double>").collect()
    rows.sort(key=lambda r: r["doc_id"])
    vectors = [(tuple(r["terms"]), np.array(r["weights"])) for r in rows]
    truth = [r["label"] for r in rows]
    index = BlockMaxIndex(vectors, truth, [r["doc_id"] for r in rows], len(idf))
    model = Classifier(vectorizer, index, n_toxic / n_rows)
    model.calibrate(vectors, truth)
    return model


def score_texts(docs: DataFrame, model: Classifier, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score``, ``predicted`` and ``evidence`` (nearest examples), whatever its other columns.

    ``docs`` must not have columns of these names. A null text is empty.
    """
    at = docs.columns.index(text_col)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.score(t or "") for t in batch.column(at).to_pylist()]
            evidence = [[dict(zip(("doc_id", "similarity", "toxic"), e, strict=True)) for e in f[1]] for f in found]
            added = [pa.array([f[0] for f in found], pa.float64()), pa.array([int(f[0] >= 0.5) for f in found], pa.int32()), pa.array(evidence, kind)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "score", "predicted", "evidence"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    schema = ", ".join([*fields, "score double, predicted int, evidence array<struct<doc_id:long,similarity:double,toxic:double>>"])
    return docs.mapInArrow(trimmed(run), schema)


def drop_toxic(docs: DataFrame, model: Classifier, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't predicted to be toxic; same columns, whatever their names."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [model.score(t or "")[0] < 0.5 for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)
