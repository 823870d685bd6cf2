"""Pack token sequences along a space-filling curve.

Every document becomes a hashed bag-of-tokens vector, projected to three
dimensions by a fixed random matrix. Its place on the Hilbert curve through
that cube is its sort key, so similar documents become neighbours. The range
partitions of that order are packed independently: documents follow each other
without gaps and are cut where a sequence is full. The rest of a partition is
cut into sequences of power-of-two lengths, so no sequence needs padding.
"""

from __future__ import annotations

from collections.abc import Iterator
import functools
import json
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
import tiktoken
import tokenizers

from supplyspark.llm.common import staged, texts_of, trimmed

SEQUENCE = 1024
END_ID = 0
HASHED, DIMENSIONS, BITS = 256, 3, 16
# Tokens in a range partition, about 16 MB of ids.
PARTITION_TOKENS = 4_000_000
# Longer texts go to the tokenizers library itself: it is slower, but its pattern
# matching has no limit on the length of a run.
LONG_TEXT = 200_000


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as characters from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Ids as the tokenizers library gives them for a byte-level BPE file whose ids are merge ranks."""

    def __init__(self, path: str, pattern: str):
        self.path = path
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        special = {token["content"]: token["id"] for token in spec["added_tokens"]}
        as_bytes = _byte_of_char()
        ranks = {bytes(as_bytes[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if token not in special}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    @functools.cached_property
    def exact(self) -> tokenizers.Tokenizer:
        """Loaded when a long text needs it; it takes more memory than the ranks."""
        return tokenizers.Tokenizer.from_file(self.path)

    def encode(self, text: str) -> np.ndarray:
        if len(text) > LONG_TEXT:
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return self.fast.encode_to_numpy(text, allowed_special="all")


_encoders: dict[tuple[str, str], Encoder] = {}


def _encoder(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of each point, given as rows of ``bits``-bit integers."""
    axes = points.astype(np.int64).T.copy()
    n = len(axes)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            set_ = (axes[i] & q) != 0
            swap = np.where(set_, 0, (axes[0] ^ axes[i]) & p)
            axes[0] ^= np.where(set_, p, swap)
            axes[i] ^= swap
        q >>= 1
    for i in range(1, n):
        axes[i] ^= axes[i - 1]
    t = np.zeros_like(axes[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((axes[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    axes ^= t
    key = np.zeros_like(axes[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((axes[i] >> bit) & 1)
    return key


_rng = np.random.Generator(np.random.PCG64(7))
_SLOT = _rng.integers(0, HASHED, 1 << 16)
_SIGN = _rng.choice([-1.0, 1.0], 1 << 16)
_PROJECTION = _rng.normal(size=(HASHED, DIMENSIONS))


def curve_keys(documents: list[np.ndarray]) -> np.ndarray:
    """Hilbert key of each document's ids."""
    vectors = np.zeros((len(documents), HASHED))
    for row, ids in enumerate(documents):
        ids = ids & 0xFFFF
        vectors[row] = np.bincount(_SLOT[ids], weights=_SIGN[ids], minlength=HASHED)
    vectors = np.sign(vectors) * np.log1p(np.abs(vectors))
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    # A projected unit vector is about standard normal in each dimension.
    unit = 0.5 + 0.5 * np.tanh(0.8 * (vectors @ _PROJECTION))
    return hilbert_keys(np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def tokenized(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``curve``, ``n`` and ``ids`` (16 bits each if they fit, else 32, with END_ID last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = _encoder(path, pattern)
        kind = np.uint16 if use.fast.n_vocab <= 1 << 16 else np.uint32
        for batch in batches:
            ids = [np.append(use.encode(text.as_py()), END_ID) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(curve_keys(ids)),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([x.astype(kind).tobytes() for x in ids], pa.binary()),
                ],
                ["doc_id", "curve", "n", "ids"],
            )

    return texts_of(docs, id_col, text_col).mapInArrow(trimmed(run), "doc_id long, curve long, n long, ids binary")


PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def _packer(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 40
        held: list[tuple] = []  # pieces of the sequence that is not full yet
        filled = 0

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*pieces, strict=True)) if pieces else [[]] * 7
            kinds = [pa.int64()] * 6 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in PIECES.split(", ")])

        for batch in batches:
            out: list[tuple] = []
            for doc_id, n, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ids = np.frombuffer(blob, dtype=np.uint16 if len(blob) == 2 * n else np.uint32).astype("<u4")
                start = 0
                while start < n:
                    length = min(n - start, size - filled)
                    held.append((doc_id, start, length, n, sequence, filled, ids[start : start + length].tobytes()))
                    start += length
                    filled += length
                    if filled == size:
                        out += held
                        held, filled, sequence = [], 0, sequence + 1
            if out:
                yield rows(out)
        # The rest: one sequence for each power of two in its length.
        out, room = [], 0
        for doc_id, start, length, n, _, _, blob in held:
            at = 0
            while at < length:
                if room == 0:
                    room = used = 1 << (filled.bit_length() - 1)
                    filled -= room
                    sequence += 1
                take = min(room, length - at)
                out.append((doc_id, start + at, take, n, sequence - 1, used - room, blob[4 * at : 4 * (at + take)]))
                at += take
                room -= take
        if out:
            yield rows(out)

    return run


def pack(
    docs: DataFrame,
    path: str,
    pattern: str,
    *,
    size: int = SEQUENCE,
    partition_tokens: int = PARTITION_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of the packed sequences, with their ids (little-endian unsigned 32-bit).

    ``offset`` is the place of a piece in its sequence. A null or empty text is
    packed as END_ID alone. Rows with equal texts and ids are packed as often
    as they occur; other columns are ignored. An empty table has no pieces.
    """
    tokens = staged(tokenized(docs, path, pattern, id_col, text_col), "tokens")
    total = tokens.agg(F.sum("n")).first()[0] or 0
    parts = max(1, math.ceil(total / partition_tokens))
    order = ["curve", "doc_id", "n"]
    laid = tokens.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return laid.select("doc_id", "n", "ids").mapInArrow(trimmed(_packer(size)), PIECES)


def sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id`` and ``ids`` of whole sequences; a sequence has a bounded number of pieces."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    hexed = F.concat_ws("", F.transform(parts, lambda part: F.hex(part["ids"])))
    return pieces.groupBy("sequence_id").agg(F.unhex(hexed).alias("ids"))
