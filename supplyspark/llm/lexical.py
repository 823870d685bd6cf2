"""Ranked lexical search with a length-stratified index.

A document's score for a term depends on its length only through the whole
number ``m``, so documents of a shard are grouped into strata of equal ``m``.
Within a stratum the postings of a term lie by falling frequency, so the impact
of a frequency is computed once for all documents that share it, and the first
one bounds the stratum. A query adds the bounds of its terms, visits strata from
the highest bound down and stops where no bound reaches its k-th score.

Terms are compared by 64-bit hashes. A search meets a false match with
probability (terms of the queries) x (terms of the corpus) / 2^64.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from supplyspark.llm.common import chunks, shared_dir, staged, texts_of, word_hashes
from supplyspark.llm.language_model import _place as place

K = 10
SHARD_POSTINGS = 1_000_000
QUERY_BLOCK = 512  # queries a worker reads at once
NO_ID = np.iinfo(np.int64).max

# Terms are runs of ASCII digits, ASCII letters and all characters beyond ASCII.
SEPARATORS = np.ones(256, dtype=bool)
SEPARATORS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def _pack(array: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(array).tobytes(), codec="zstd", asbytes=True)


def _unpack(blob: bytes, kind: np.dtype, n: int) -> np.ndarray:
    kind = np.dtype(kind)
    return np.frombuffer(pa.decompress(blob, decompressed_size=n * kind.itemsize, codec="zstd", asbytes=True), dtype=kind)


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    sizes = ends - starts
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Rows at which a run of equal values begins."""
    if not len(columns[0]):
        return np.empty(0, np.int64)
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def term_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(term, text, times) of the texts, by term and text, and each text's number of terms with repeats."""
    hashes, first = word_hashes(data, offsets, separators=SEPARATORS)
    length = np.diff(first)
    text = np.repeat(np.arange(len(length)), length)
    by = np.argsort(hashes, kind="stable")
    hashes, text = hashes[by], text[by]
    at = _changes(hashes, text)
    return hashes[at], text[at], np.diff(at, append=len(hashes)), length


COUNTED = "n_docs long, n_terms long, n_postings long, ids binary, lengths binary, terms binary, df binary, docs binary, tf binary"
NAMES = [f.split()[0] for f in COUNTED.split(", ")]


def _counted(ids: list, lengths: list, parts: list) -> pa.RecordBatch:
    """One shard: its documents by (length, id), postings by (term, document)."""
    ids_, lengths_ = np.concatenate(ids), np.concatenate(lengths)
    by = np.lexsort((ids_, lengths_))
    place_of = np.empty(len(by), dtype=np.int64)
    place_of[by] = np.arange(len(by))
    terms, docs, tf = (np.concatenate(c) for c in zip(*parts, strict=True))
    docs = place_of[docs]
    order = np.lexsort((docs, terms))
    terms, docs, tf = terms[order], docs[order], tf[order]
    at = _changes(terms)
    row = [
        len(ids_), len(at), len(docs), _pack(ids_[by].astype("<i8")), _pack(lengths_[by].astype("<i8")), _pack(terms[at].astype("<u8")),
        _pack(np.diff(at, append=len(docs)).astype("<u4")), _pack(docs.astype("<u4")), _pack(tf.astype("<u4")),
    ]
    kinds = [pa.int64()] * 3 + [pa.binary()] * 6
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], NAMES)


def _count(shard_postings: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, parts, docs, postings = [], [], [], 0, 0
        for batch in batches:
            for part, data, offsets in chunks(batch):
                terms, text, tf, length = term_counts(data, offsets)
                own = part.column(0).fill_null(NO_ID).to_numpy()
                held = length > 0  # a text without terms is in no posting and not counted
                number = docs + np.cumsum(held) - 1
                ids.append(own[held])
                lengths.append(length[held])
                parts.append((terms, number[text], tf))
                docs += int(held.sum())
                postings += len(terms)
                if postings >= shard_postings:
                    yield _counted(ids, lengths, parts)
                    ids, lengths, parts, docs, postings = [], [], [], 0, 0
        if docs:
            yield _counted(ids, lengths, parts)

    return run


class Shard:
    """Strata, and postings as runs: one for each (term, stratum), by falling frequency."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        docs, terms, postings = row["n_docs"], row["n_terms"], row["n_postings"]
        self.ids = _unpack(row["ids"], "<i8", docs)
        # In whole numbers, as the weights are; documents lie by length, so strata are ranges of them.
        m = 100 - 90 + (90 * _unpack(row["lengths"], "<i8", docs) * n_docs) // n_terms
        self.starts = _changes(m)
        self.m = m[self.starts]
        stratum_of = np.repeat(np.arange(len(self.m)), np.diff(self.starts, append=docs))
        self.terms = _unpack(row["terms"], "<u8", terms)
        df = _unpack(row["df"], "<u4", terms).astype(np.int64)
        term = np.repeat(np.arange(terms), df)
        doc, tf = _unpack(row["docs"], "<u4", postings).astype(np.int64), _unpack(row["tf"], "<u4", postings).astype(np.int64)
        stratum = stratum_of[doc]
        order = np.lexsort((-tf, term * len(self.m) + stratum))
        self.doc, tf, stratum = doc[order].astype(np.int32), tf[order], stratum[order]  # terms keep their places
        groups = _changes(term, stratum, tf)
        impact = (1_000_000_000 * tf[groups]) // (1000 * tf[groups] + 8 * self.m[stratum[groups]])
        self.impact = np.repeat(impact, np.diff(groups, append=postings))
        self.run_start = _changes(term, stratum)
        self.run_end = np.append(self.run_start[1:], postings)
        self.run_stratum = stratum[self.run_start]
        self.run_bound = self.impact[self.run_start]
        self.term_run = np.searchsorted(self.run_start, np.concatenate([[0], np.cumsum(df)]))

    def search(self, terms: np.ndarray, weights: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """``best`` (scores, ids; highest first, ties by id) with this shard's documents."""
        at = np.searchsorted(self.terms, terms)
        known = at < len(self.terms)
        known[known] = self.terms[at[known]] == terms[known]
        at, weights = at[known], weights[known]
        if not len(at):
            return best
        low, high = self.term_run[at], self.term_run[at + 1]
        runs = _ranges(low, high)
        weight = np.repeat(weights, high - low)
        stratum = self.run_stratum[runs]
        bound = np.zeros(len(self.m), dtype=np.int64)
        np.add.at(bound, stratum, weight * self.run_bound[runs])
        order = np.argsort(-bound, kind="stable")
        done, step = 0, 4
        ends = np.append(self.starts[1:], len(self.ids))
        while done < len(order):
            least = best[0][k - 1] if len(best[0]) >= k else 1
            # A document with the k-th score still counts if its id is smaller.
            visited = order[done : done + step]
            visited = visited[bound[visited] >= least]
            if not len(visited):
                break
            opened = np.zeros(len(self.m), dtype=bool)
            opened[visited] = True
            chosen = opened[stratum]
            first, last = self.run_start[runs[chosen]], self.run_end[runs[chosen]]
            postings = _ranges(first, last)
            scores = np.zeros(len(self.ids), dtype=np.int64)
            np.add.at(scores, self.doc[postings], np.repeat(weight[chosen], last - first) * self.impact[postings])
            docs = _ranges(self.starts[visited], ends[visited])
            docs = docs[scores[docs] >= least]
            score, ids = np.concatenate([best[0], scores[docs]]), np.concatenate([best[1], self.ids[docs]])
            if len(score) > 4 * k:  # leave out what is surely below before sorting
                floor = np.partition(score, len(score) - k)[len(score) - k]
                score, ids = score[score >= floor], ids[score >= floor]
            top = np.lexsort((ids, -score))[:k]
            best = score[top], ids[top]
            done, step = done + step, 2 * step
        return best


def _blocks(folder: str) -> Iterator[pa.RecordBatch]:
    """The queries, always in the same order."""
    fs, path = place(folder)
    yield from pads.dataset(path, filesystem=fs, format="parquet").to_batches(batch_size=QUERY_BLOCK, columns=["item", "terms", "weights"], use_threads=False)


class LexicalIndex:
    """Index over all rows of ``docs``.

    Null texts and texts without terms are never found and not counted. Rows
    that repeat are found as often as they occur. A null id counts as the
    largest. Other columns are ignored. An empty table gives an index that
    finds nothing.
    """

    def __init__(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shard_postings: int = SHARD_POSTINGS):
        self.spark = docs.sparkSession
        self.shards = staged(texts_of(docs, id_col, text_col).mapInArrow(_count(shard_postings), COUNTED), "postings")

        def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    lengths = _unpack(row["lengths"], "<i8", row["n_docs"])
                    terms, df = _unpack(row["terms"], "<u8", row["n_terms"]), _unpack(row["df"], "<u4", row["n_terms"])
                    # A shard's documents and their terms are counted under the null term.
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([None, *terms.view(np.int64).tolist()], pa.int64()),
                            pa.array([row["n_docs"], *df.tolist()], pa.int64()),
                            pa.array([int(lengths.sum())] + [0] * len(df), pa.int64()),
                        ],
                        ["term", "df", "length"],
                    )

        slim = self.shards.select("n_docs", "n_terms", "lengths", "terms", "df")
        counts = slim.mapInArrow(entries, "term long, df long, length long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("length").alias("length"))
        self.dictionary = staged(counts, "dictionary")

    @cached_property
    def totals(self) -> tuple[int, int]:
        """Documents with a term, and all their terms."""
        row = self.dictionary.filter("term is null").select("df", "length").first()
        return (row[0], row[1]) if row else (0, 0)

    def _queries(self, items: DataFrame, text_col: str) -> DataFrame:
        """``item``, ``terms``, ``weights`` of the rows of ``items`` that have a term in the index."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, data, offsets in chunks(batch):
                    terms, text, _, _ = term_counts(data, offsets)
                    keys = part.column(0).to_numpy()[text]
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(terms.view(np.int64))], ["item", "term"])

        n, _ = self.totals
        texts = items.select("item", F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        found = texts.mapInArrow(run, "item long, term long").join(self.dictionary, "term")
        share = F.lit(float(2 * n + 2)) / (2 * F.col("df") + 1).cast("double")
        weighed = found.withColumn("weight", F.floor(F.lit(1000.0) * F.log(share)))
        pairs = weighed.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("pairs"))
        return pairs.select("item", F.col("pairs.term").alias("terms"), F.col("pairs.weight").alias("weights"))

    def search(self, items: DataFrame, k: int = K, *, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
        """``item_id``, ``rank``, ``doc_id``, ``score``: the ``k`` best documents with a score above 0 for every row of ``items``.

        Null texts find nothing; rows that repeat are answered each. Workers
        hold the best documents of all queries, 16 ``k`` bytes for each, and
        read the queries themselves in blocks from the shared folder.
        """
        keyed = staged(items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).withColumn("item", F.monotonically_increasing_id()), "items")
        n_docs, n_terms = self.totals
        folder = f"{shared_dir(self.spark)}/queries-{uuid.uuid4().hex}"
        self._queries(keyed, "text").write.parquet(folder)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            nothing = np.empty(0, np.int64), np.empty(0, np.int64)
            for batch in batches:
                for at in range(batch.num_rows):
                    shard = Shard(batch.slice(at, 1).to_pylist()[0], n_docs, n_terms)
                    for block in _blocks(folder):
                        for item, terms, weights in zip(block.column(0).to_pylist(), block.column(1), block.column(2), strict=True):
                            hashes = terms.values.to_numpy().view(np.uint64)
                            found = shard.search(hashes, weights.values.to_numpy(), best.get(item, nothing), k)
                            if len(found[0]):
                                best[item] = found
            for item, (score, ids) in best.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), item)), pa.array(ids), pa.array(score)], ["item", "doc_id", "score"])

        found = self.shards.mapInArrow(run, "item long, doc_id long, score long")
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))).filter(F.col("rank") <= k)
        doc_id = F.when(F.col("doc_id") < NO_ID, F.col("doc_id")).alias("doc_id")
        return ranked.join(keyed.select("item", "item_id"), "item").select("item_id", "rank", doc_id, "score")
