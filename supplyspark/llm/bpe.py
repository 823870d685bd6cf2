"""Byte-level BPE by backtracking over longest matches.

Bytes are mapped to Latin-1 so that an Aho-Corasick automaton over the
vocabulary finds, for every start, all tokens that begin there. The encoder
walks from left to right with the longest token first. Two neighbouring tokens
are compatible if merging their bytes by rank gives back just these two; the
answer is memoised for each pair. A sequence of compatible neighbours is
exactly what the merges produce, so an incompatible match gives way to the next
shorter one, and a dead end steps back. Every start is left for good once,
hence linear time.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
import regex

from supplyspark.llm.common import texts_of

# Distinct pieces that a worker remembers. It forgets all of them beyond that.
CACHE_PIECES = 1_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of ``base64 rank`` lines."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class BytePairCodec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pieces = regex.compile(pattern)
        self.token_bytes = {rank: token for token, rank in ranks.items()}
        # The pair of tokens each token is merged from, None for single bytes.
        # A token that its own bytes do not merge to can only be a whole piece.
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
            if len(token) == 1:
                self.parts[rank] = None
            else:
                pair = self._last_merge(token)
                if pair is None:
                    continue
                self.parts[rank] = pair
            self.automaton.add_word(token[::-1].decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}

    def _last_merge(self, token: bytes) -> tuple[int, int] | None:
        """The two tokens left before the last merge of ``token``."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            rank, at = min(
                ((self.ranks.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1)),
            )
            if rank == 1 << 62:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        pair = self.ranks.get(parts[0]), self.ranks.get(parts[1])
        return None if None in pair else pair  # type: ignore[return-value]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both gives these two tokens again."""
        key = (left, right)
        known = self.fits.get(key)
        if known is None:
            known = self.fits[key] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        """Undo the merges on the two facing sides, latest first.

        A merge across that ranks below the undone one would have come before
        it. Of equal ranks the left one comes first, hence the ``+ 1``.
        """
        limit = 1 << 62
        while True:
            across = self.ranks.get(self.token_bytes[left] + self.token_bytes[right])
            if across is not None and across < limit:
                return False
            from_left = self.parts[left] is not None and (self.parts[right] is None or left > right)
            if self.parts[left] is None and self.parts[right] is None:
                return True
            if from_left:
                limit = left
                left = self.parts[left][1]
            else:
                limit = right + 1
                right = self.parts[right][0]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Tokens of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        matches: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        # Of the matches that end (here: start) at one place the longest comes first.
        for end, match in self.automaton.iter(piece[::-1].decode("latin-1")):
            matches[n - 1 - end].append(match)
        out: list[int] = []
        starts: list[int] = []
        tried = [0] * (n + 1)  # matches of a start that are used up
        at = 0
        while at < n:
            options, k = matches[at], tried[at]
            while k < len(options):
                token, length = options[k]
                k += 1
                if at + length < n and tried[at + length] >= len(matches[at + length]) > 0:
                    continue  # nothing fits from there
                if not out or self.compatible(out[-1], token):
                    break
            else:
                tried[at] = k
                if not out:
                    raise ValueError("the vocabulary lacks a byte of the text")
                out.pop()
                at = starts.pop()
                continue
            tried[at] = k
            out.append(token)
            starts.append(at)
            at += length
        return out

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, as unsigned 32-bit integers."""
        known, out = self.known, []
        if len(known) > CACHE_PIECES:
            known.clear()
        for piece in self.pieces.findall(text):
            ids = known.get(piece)
            if ids is None:
                ids = np.array(self.encode_piece(piece.encode()), dtype="<u4").tobytes()
                if len(piece) <= 64:
                    known[piece] = ids
            out.append(ids)
        return np.frombuffer(b"".join(out), dtype="<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        get = self.token_bytes.__getitem__
        return b"".join(map(get, ids.tolist()))


_codecs: dict[tuple[str, str], BytePairCodec] = {}


def codec(path: str, pattern: str) -> BytePairCodec:
    """One codec for each worker process and vocabulary."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = BytePairCodec(load_ranks(path), pattern)
    return _codecs[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` (little-endian unsigned 32-bit integers), ``n_tokens``; a null text is empty and has no ids.

    Control strings in a text are ordinary text. Works row by row: repeated
    rows, other columns and null ids pass through unchanged.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(path, pattern)
        for batch in batches:
            ids = [use.encode(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([len(x) for x in ids], pa.int64())],
                ["doc_id", "ids", "n_tokens"],
            )

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary, n_tokens long")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The columns of ``encode_documents`` and ``decoded``, the bytes of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(path, pattern)
        for batch in batches:
            texts = [use.decode(np.frombuffer(ids.as_py(), dtype="<u4")) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], [*batch.schema.names, "decoded"])

    return encoded.select("doc_id", "ids", "n_tokens").mapInArrow(run, "doc_id long, ids binary, n_tokens long, decoded binary")


