"""Interpolated modified Kneser-Ney bigram model, counted in Spark, read from mapped files.

Tokens are 64-bit word hashes. Tasks count their own part in sorted arrays;
shards of those are merged into sorted key arrays with counts and written to
the shared folder. A word's number is its place in the sorted hashes of all
shards, so a bigram is one exact 64-bit key. Shards go by context; the few
contexts with a large share of all tokens are spread by the whole key. Workers
map the files they need and look up the distinct keys of a chunk in sorted
order. Nothing of the size of the vocabulary passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
import math
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplyspark.llm.common import chunks, mix, shared_dir, texts_of, word_hashes

SHARD_BYTES = 32 << 20  # of training text to a shard
BUFFER = 2_000_000  # keys a task sorts at once
LOOKUP_BYTES = 1 << 20  # of text whose keys are looked up together
END = np.uint64(0x656E646F66746578)  # the hash that stands for the end of a text
DEFAULT_DISCOUNTS = (0.5, 1.0, 1.5)  # where the counts of counts have gaps


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def save(folder: str, array: np.ndarray) -> str:
    """Write an array under a new name, so that a repeated task never meets the file of another attempt."""
    fs, path = _place(folder)
    fs.create_dir(path, recursive=True)
    name = f"{uuid.uuid4().hex}.{array.dtype.str[1:]}"
    with fs.open_output_stream(f"{path}/{name}") as out:
        out.write(memoryview(np.ascontiguousarray(array)).cast("B") if len(array) else b"")
    return f"{folder}/{name}"


_mapped: dict[str, np.ndarray] = {}


def load(uri: str) -> np.ndarray:
    """Map an array. From a store without local paths it is copied first, to an unnamed temporary file."""
    if uri not in _mapped:
        kind = np.dtype(uri.rsplit(".", 1)[1])
        fs, path = _place(uri)
        if fs.get_file_info(path).size == 0:
            _mapped[uri] = np.empty(0, kind)
        elif isinstance(fs, pafs.LocalFileSystem):
            _mapped[uri] = np.memmap(path, dtype=kind, mode="r")
        else:
            with fs.open_input_stream(path) as source, tempfile.TemporaryFile() as copy:
                while block := source.read(1 << 22):
                    copy.write(block)
                copy.flush()
                _mapped[uri] = np.memmap(copy, dtype=kind, mode="r")
    return _mapped[uri]


def _spread(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shard of a hash, rising with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def _smallest(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.min_scalar_type(int(counts.max()) if len(counts) else 0))


def _squeeze(keys: np.ndarray) -> bytes:
    """Sorted keys as compressed differences."""
    return pa.compress(np.diff(keys, prepend=np.uint64(0)).astype("<u8").tobytes(), codec="zstd", asbytes=True)


def _stretch(blob: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(pa.decompress(blob, decompressed_size=8 * n, codec="zstd", asbytes=True), dtype="<u8"), dtype=np.uint64)


def _counts_blob(counts: np.ndarray) -> bytes:
    return pa.compress(counts.astype("<u4").tobytes(), codec="zstd", asbytes=True)


def _counts_of(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, decompressed_size=4 * n, codec="zstd", asbytes=True), dtype="<u4").astype(np.int64)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sum counts of equal keys."""
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


@dataclass
class Model:
    """Where the arrays are, and the numbers that hold for the whole corpus."""

    shards: int
    words: list[tuple[str, str]] = field(default_factory=list)  # hashes and counts of each shard
    word_offsets: list[int] = field(default_factory=lambda: [0])
    tokens: int = 0
    hot: list[int] = field(default_factory=list)
    pairs: dict[int, tuple[str, str]] = field(default_factory=dict)
    stats: list[dict[str, str]] = field(default_factory=list)
    stat_rows: int = 1
    pair_types: int = 0
    discounts: tuple[float, float, float] = DEFAULT_DISCOUNTS
    word_discounts: tuple[float, float, float] = DEFAULT_DISCOUNTS
    word_rest: float = 0.0  # discounted mass of the continuation distribution

    @property
    def vocabulary(self) -> int:
        return self.word_offsets[-1]

    def word_ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number (-1: unknown) and count of sorted distinct hashes."""
        ids, counts = np.full(len(hashes), -1, dtype=np.int64), np.zeros(len(hashes), dtype=np.int64)
        cuts = np.searchsorted(_spread(hashes, self.shards), np.arange(self.shards + 1))
        for s in range(self.shards):
            a, b = cuts[s], cuts[s + 1]
            keys = load(self.words[s][0]) if a < b else ()
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashes[a:b]), len(keys) - 1)
                hit = keys[at] == hashes[a:b]
                ids[a:b][hit] = at[hit] + self.word_offsets[s]
                counts[a:b][hit] = load(self.words[s][1])[at[hit]]
        return ids, counts

    def pair_shards(self, keys: np.ndarray) -> np.ndarray:
        context = keys >> np.uint64(32)
        hot = np.isin(context, np.array(self.hot, dtype=np.uint64))
        return _spread(mix(np.where(hot, keys, context) + np.uint64(1)), self.shards).astype(np.int64)

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of distinct (context, word) keys."""
        out = np.zeros(len(keys), dtype=np.int64)
        shard = self.pair_shards(keys)
        order = np.argsort(shard, kind="stable")  # keys stay sorted in each shard
        cuts = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s in range(self.shards):
            mine = order[cuts[s] : cuts[s + 1]]
            have = load(self.pairs[s][0]) if len(mine) and s in self.pairs else ()
            if len(have):
                at = np.minimum(np.searchsorted(have, keys[mine]), len(have) - 1)
                hit = have[at] == keys[mine]
                out[mine[hit]] = load(self.pairs[s][1])[at[hit]]
        return out

    def stat(self, name: str, ids: np.ndarray) -> np.ndarray:
        """A statistic of sorted distinct word numbers."""
        out = np.zeros(len(ids), dtype=np.int64)
        cuts = np.searchsorted(ids, np.arange(len(self.stats) + 1) * self.stat_rows)
        for s, files in enumerate(self.stats):
            if cuts[s] < cuts[s + 1] and name in files:
                out[cuts[s] : cuts[s + 1]] = load(files[name])[ids[cuts[s] : cuts[s + 1]] - s * self.stat_rows]
        return out


def _discounts(counts_of_counts: list[int]) -> tuple[float, float, float]:
    n1, n2, n3, n4 = counts_of_counts
    if not (n1 and n2 and n3 and n4):
        return DEFAULT_DISCOUNTS
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.0), k + 1.0) for k, d in enumerate(found))  # type: ignore[return-value]


def _off(counts: np.ndarray, discounts: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *discounts])[np.minimum(counts, 3)]


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of each text with its end, and where each text begins."""
    hashes, first = word_hashes(data, offsets)
    return np.insert(hashes, first[1:], END), first + np.arange(len(first))


class _Counter:
    """Sorted counts of one task, flushed to rows of each shard."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, keys: np.ndarray) -> None:
        self.parts.append(np.unique(keys, return_counts=True))
        self.size += len(self.parts[-1][0])
        if self.size > BUFFER:
            self.parts = [_merged(self.parts)]
            self.size = len(self.parts[0][0])

    def full(self) -> bool:
        return self.size > BUFFER

    def rows(self, shard_of) -> Iterator[pa.RecordBatch]:
        keys, counts = _merged(self.parts)
        self.parts, self.size = [], 0
        shard = shard_of(keys).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        keys, counts, shard = keys[order], counts[order], shard[order]
        if not len(keys):
            return
        starts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
        for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard[a]]), pa.array([b - a]), pa.array([_squeeze(keys[a:b])], pa.binary()), pa.array([_counts_blob(counts[a:b])], pa.binary())],
                ["shard", "n", "keys", "counts"],
            )


COUNTED = "shard long, n long, keys binary, counts binary"


def _merge_rows(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return _merged([(_stretch(k, n), _counts_of(c, n)) for n, k, c in zip(rows["n"], rows["keys"], rows["counts"], strict=True)])


def _vocabulary(texts: DataFrame, model: Model, folder: str) -> None:
    shards = model.shards

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Counter()
        for batch in batches:
            for _, data, offsets in chunks(batch, size=LOOKUP_BYTES):
                found.add(_tokens(data, offsets)[0])
                if found.full():
                    yield from found.rows(lambda keys: _spread(keys, shards))
        yield from found.rows(lambda keys: _spread(keys, shards))

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _merge_rows(rows)
        top = np.argsort(-counts, kind="stable")[:64]
        files = save(folder, keys), save(folder, _smallest(counts))
        return pd.DataFrame(
            {"shard": [rows["shard"].iloc[0]], "keys": [files[0]], "counts": [files[1]], "n": [len(keys)], "total": [int(counts.sum())], "top": [top.tolist()], "top_n": [counts[top].tolist()]}
        )

    done = texts.mapInArrow(count, COUNTED).groupBy("shard").applyInPandas(
        write, "shard long, keys string, counts string, n long, total long, top array<long>, top_n array<long>"
    )
    found = {row["shard"]: row for row in done.collect()}  # one row for each shard
    empty = save(folder, np.empty(0, np.uint64)), save(folder, np.empty(0, np.uint8))
    for s in range(shards):
        row = found.get(s)
        model.words.append((row["keys"], row["counts"]) if row else empty)
        model.word_offsets.append(model.word_offsets[-1] + (row["n"] if row else 0))
        model.tokens += row["total"] if row else 0
    if model.vocabulary >= 1 << 32:
        raise ValueError("more than 2^32 words: bigram keys need more than 64 bits")
    limit = model.tokens / (4 * shards)
    model.hot = sorted(model.word_offsets[s] + i for s, row in found.items() for i, n in zip(row["top"], row["top_n"], strict=True) if n > limit)
    # The start of a text is a context like any other, numbered after the last word.
    model.hot.append(model.vocabulary)


def _numbered(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Word numbers of all tokens, those before them, token counts, and where texts begin."""
    hashes, first = _tokens(data, offsets)
    distinct, place = np.unique(hashes, return_inverse=True)
    ids, counts = model.word_ids(distinct)
    ids, counts = ids[place], counts[place]
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[first[:-1]] = model.vocabulary
    return ids, before, counts, first


def _pairs(texts: DataFrame, model: Model, folder: str) -> None:
    stat_rows, stat_shards = model.stat_rows, len(model.stats)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Counter()
        for batch in batches:
            for _, data, offsets in chunks(batch, size=LOOKUP_BYTES):
                ids, before, _, _ = _numbered(model, data, offsets)
                found.add((before.astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64))
                if found.full():
                    yield from found.rows(model.pair_shards)
        yield from found.rows(model.pair_shards)

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        """Write a shard of bigrams; return its part of the statistics of each range of words."""
        keys, counts = _merge_rows(rows)
        files = save(folder, keys), save(folder, _smallest(counts))
        context = keys >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        parts = {"total": np.add.reduceat(counts, first)}
        for k in (1, 2, 3):
            parts[f"n{k}"] = np.add.reduceat((np.minimum(counts, 3) == k).astype(np.int64), first)
        word, n = np.unique(keys & np.uint64(0xFFFFFFFF), return_counts=True)
        out = []
        for names, ids, values in ((list(parts), context[first], list(parts.values())), (["before"], word, [n])):
            shard = (ids // np.uint64(stat_rows)).astype(np.int64)
            cuts = np.searchsorted(shard, np.arange(stat_shards + 1))
            for s in range(stat_shards):
                a, b = cuts[s], cuts[s + 1]
                if a < b:
                    out += [(s, name, int(b - a), _squeeze(ids[a:b]), _counts_blob(v[a:b])) for name, v in zip(names, values, strict=True)]
        tops = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
        out.append((-1, f"{rows['shard'].iloc[0]} {files[0]} {files[1]} {len(keys)} {' '.join(map(str, tops))}", 0, b"", b""))
        return pd.DataFrame(out, columns=["range", "name", "n", "keys", "counts"])

    shards = texts.mapInArrow(count, COUNTED).groupBy("shard").applyInPandas(write, "range long, name string, n long, keys binary, counts binary")
    # Written out, since it is read twice and its tasks write files.
    path = f"{folder}/statistics"
    shards.write.parquet(path)
    shards = texts.sparkSession.read.schema(shards.schema).parquet(path)
    tops = np.zeros(4, dtype=np.int64)
    for row in shards.filter("range < 0").select("name").collect():  # one row for each shard
        shard, keys, counts, n, *few = row["name"].split(" ")
        model.pairs[int(shard)] = keys, counts
        model.pair_types += int(n)
        tops += np.array(few, dtype=np.int64)
    model.discounts = _discounts(tops.tolist())

    def dense(rows: pd.DataFrame) -> pd.DataFrame:
        start = int(rows["range"].iloc[0]) * stat_rows
        out, tops = [], [0] * 4
        for name, part in rows.groupby("name"):
            values = np.zeros(stat_rows, dtype=np.int64)
            for n, k, c in zip(part["n"], part["keys"], part["counts"], strict=True):
                values[_stretch(k, n).astype(np.int64) - start] += _counts_of(c, n)
            if name == "before":
                tops = [int((values == k).sum()) for k in (1, 2, 3)] + [int((values == 4).sum())]
                more = int((values >= 3).sum())
            out.append((rows["range"].iloc[0], name, save(folder, _smallest(values)), *(tops if name == "before" else [0] * 4), more if name == "before" else 0))
        return pd.DataFrame(out, columns=["range", "name", "file", "n1", "n2", "n3", "n4", "more"])

    made = shards.filter("range >= 0").groupBy("range").applyInPandas(
        dense, "range long, name string, file string, n1 long, n2 long, n3 long, n4 long, more long"
    )
    tops, more = np.zeros(4, dtype=np.int64), 0
    for row in made.collect():  # five rows for each range
        model.stats[row["range"]][row["name"]] = row["file"]
        tops += np.array([row["n1"], row["n2"], row["n3"], row["n4"]])
        more += row["more"]
    model.word_discounts = _discounts(tops.tolist())
    d1, d2, d3 = model.word_discounts
    model.word_rest = d1 * int(tops[0]) + d2 * int(tops[1]) + d3 * more


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> Model:
    """Count the texts of ``docs`` and write the model's arrays. A null text is an empty one, a lone end."""
    texts = texts_of(docs, id_col, text_col)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    model = Model(shards=max(1, math.ceil(size / shard_bytes)))
    folder = f"{shared_dir(docs.sparkSession)}/language-model-{uuid.uuid4().hex}"
    _vocabulary(texts, model, folder)
    model.stat_rows = max(1, math.ceil((model.vocabulary + 1) / model.shards))
    model.stats = [{} for _ in range(model.shards)]
    if model.tokens:
        _pairs(texts, model, folder)
    return model


def _word_chances(model: Model, ids: np.ndarray) -> np.ndarray:
    """Continuation probability of distinct sorted numbers (-1: unknown)."""
    size = model.vocabulary + 1
    if not model.pair_types:
        return np.full(len(ids), 1.0 / size)
    before = np.zeros(len(ids), dtype=np.int64)
    known = ids >= 0
    before[known] = model.stat("before", ids[known])
    kept = np.maximum(before - _off(before, model.word_discounts), 0.0)
    return kept / model.pair_types + model.word_rest / model.pair_types / size


def _chunk_scores(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    ids, before, counts, first = _numbered(model, data, offsets)
    words, place = np.unique(ids, return_inverse=True)
    chance = _word_chances(model, words)[place]
    use = before >= 0
    contexts, at = np.unique(before[use], return_inverse=True)
    total = model.stat("total", contexts)
    rest = sum(d * model.stat(f"n{k + 1}", contexts) for k, d in enumerate(model.discounts))
    total, rest = total[at], rest[at]
    both = ids[use] >= 0
    keys = (before[use][both].astype(np.uint64) << np.uint64(32)) | ids[use][both].astype(np.uint64)
    distinct, back = np.unique(keys, return_inverse=True)
    seen = np.zeros(int(use.sum()), dtype=np.int64)
    seen[both] = model.pair_counts(distinct)[back]
    kept = np.maximum(seen - _off(seen, model.discounts), 0.0)
    some = np.maximum(total, 1)
    chance[use] = np.where(total > 0, kept / some + rest / some * chance[use], chance[use])
    base = np.log10((counts + 1) / (model.tokens + model.vocabulary + 1))
    starts = first[:-1]
    return np.diff(first), np.add.reduceat((counts > 0).astype(np.int64), starts), np.add.reduceat(base, starts), np.add.reduceat(np.log10(chance), starts)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens``, ``n_known``, ``base_score``, ``score`` (log10) and ``perplexity`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch, size=LOOKUP_BYTES):
                n, known, base, logs = _chunk_scores(model, data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n), pa.array(known), pa.array(base), pa.array(logs), pa.array(10 ** (-logs / n))],
                    ["doc_id", "n_tokens", "n_known", "base_score", "score", "perplexity"],
                )

    schema = "doc_id long, n_tokens long, n_known long, base_score double, score double, perplexity double"
    return texts_of(docs, id_col, text_col).mapInArrow(run, schema)
