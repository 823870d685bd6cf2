"""Token ids in training order, as shards of fixed-stride records.

Documents are tokenised and their ids cut into sequences of one length. A
keyed Feistel network over the smallest even number of bits, walked until it
falls inside the range, permutes sequence numbers to global slots; slots are
dealt to shards by range, so a shard is a contiguous stretch of the training
order. A record is its token count and its ids at a fixed stride: a reader finds
any slot by arithmetic and resumes there.

Slots need the number of sequences before each scan partition, so the sequences
are staged as compressed blocks first, and dealt to slots when they are read
again. A block's records for one shard travel together and compressed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplyspark.llm.common import mix, shared_dir, staged, texts_of
from supplyspark.llm.language_model import _place as place
from supplyspark.llm.packing import END_ID, SEQUENCE, _encoder

SHARD_SEQUENCES = 8192  # about 16 MB of 16-bit ids
ROUNDS = 6


@dataclass(frozen=True)
class Permutation:
    """Keyed bijection of 0 ... n-1."""

    n: int
    key: int

    def _walk(self, x: np.ndarray, rounds: range) -> np.ndarray:
        half = max(1, math.ceil(max(1, (self.n - 1).bit_length()) / 2))
        mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
        x = x.astype(np.uint64)
        outside = np.ones(len(x), dtype=bool)
        while outside.any():
            left, right = x[outside] >> shift, x[outside] & mask
            for r in rounds:
                salt = np.uint64((self.key * 0x9E3779B97F4A7C15 + r * 0xC2B2AE3D27D4EB4F) & ((1 << 64) - 1))
                if rounds.step > 0:
                    left, right = right, left ^ (mix(right ^ salt) & mask)
                else:
                    left, right = right ^ (mix(left ^ salt) & mask), left
            x[outside] = (left << shift) | right
            outside = x >= self.n
        return x.astype(np.int64)

    def slot(self, index: np.ndarray) -> np.ndarray:
        """Slots of sequence numbers. A number outside the range is sent on until it falls inside."""
        return self._walk(index, range(ROUNDS))

    def index(self, slot: np.ndarray) -> np.ndarray:
        """Sequence numbers of slots."""
        return self._walk(slot, range(ROUNDS - 1, -1, -1))


def stride(size: int, width: int) -> int:
    """Bytes of a record: a 32-bit token count and ``size`` ids."""
    return 4 + size * width


def _as_binary(rows: np.ndarray) -> pa.Array:
    """A binary array with one value for each row of bytes."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _lengths(block: bytes | memoryview, stride_: int) -> np.ndarray:
    return np.ndarray(memoryview(block).nbytes // stride_, dtype="<u4", buffer=block, strides=(stride_,)).astype(np.int64)


BLOCK = 1024  # sequences that are staged together
BLOCKS = "part int, first long, tokens long, ids binary"
DEALT = "shard int, n long, slots binary, records binary"


def _squeezed(data: np.ndarray, level: int = 7) -> bytes:
    return pa.Codec("zstd", compression_level=level).compress(memoryview(np.ascontiguousarray(data)).cast("B"), asbytes=True)


def _stretched(blob: bytes, n: int, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, decompressed_size=n * kind.itemsize, codec="zstd", asbytes=True), dtype=kind)


MANIFEST = "shard long, path string, first_slot long, sequences long, stride long, width int, tokens long"


def write_shards(
    docs: DataFrame,
    path: str,
    pattern: str,
    *,
    key: int = 20240229,
    size: int = SEQUENCE,
    shard_sequences: int = SHARD_SEQUENCES,
    text_col: str = "text",
) -> DataFrame:
    """Write the shards to the shared folder; one manifest row for each.

    Ids of a scan partition follow each other without gaps, END_ID after every
    text; only the last sequence of a partition is padded (with END_ID, not
    counted). A null text is empty. Repeated rows are written as often as they
    occur; other columns and ids of rows play no part. No rows give no shards.
    """
    spark = docs.sparkSession
    texts = texts_of(docs.withColumn("_row", F.lit(0)), "_row", text_col).select("text")
    width = np.dtype(np.uint16 if _encoder(path, pattern).fast.n_vocab <= 1 << 16 else np.uint32)
    record_bytes = stride(size, width.itemsize)

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, part = _encoder(path, pattern), TaskContext.get().partitionId()
        first, held, held_n = 0, [], 0

        def block(stream: np.ndarray) -> pa.RecordBatch:
            row = [[part], [first], [len(stream)], [_squeezed(stream)]]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], [f.split()[0] for f in BLOCKS.split(", ")])

        for batch in batches:
            for text in batch.column(0):
                held.append(np.append(use.encode(text.as_py()), END_ID).astype(width))
                held_n += len(held[-1])
                if held_n >= BLOCK * size:
                    stream = np.concatenate(held)
                    whole = len(stream) // (BLOCK * size) * BLOCK
                    for at in range(0, whole, BLOCK):
                        yield block(stream[at * size : (at + BLOCK) * size])
                        first += BLOCK
                    held = [stream[whole * size :]]
                    held_n = len(held[0])
        if held_n:
            yield block(np.concatenate(held))

    blocks = staged(texts.mapInArrow(tokenise, BLOCKS), "blocks")
    # A row of two numbers for each scan partition.
    counted = {row["part"]: row["tokens"] for row in blocks.groupBy("part").agg(F.sum("tokens").alias("tokens")).collect()}
    parts = max(counted, default=-1) + 1
    starts = np.concatenate([[0], np.cumsum([-(-counted.get(p, 0) // size) for p in range(parts)])]).astype(np.int64)
    n = int(starts[-1])
    if n == 0:
        return spark.createDataFrame([], MANIFEST)
    order = Permutation(n, key)
    shards = math.ceil(n / shard_sequences)
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, tokens, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n_out = -(-tokens // size)
                padded = np.full(n_out * size, END_ID, dtype=width)
                padded[:tokens] = _stretched(blob, tokens, width)
                lengths = np.full(n_out, size, dtype="<u4")
                lengths[-1] = tokens - (n_out - 1) * size
                records = np.concatenate([lengths.view(np.uint8).reshape(n_out, 4), padded.view(np.uint8).reshape(n_out, -1)], axis=1)
                slots = order.slot(np.arange(starts[part] + first, starts[part] + first + n_out))
                by = np.argsort(slots, kind="stable")
                shard = slots[by] // shard_sequences
                at = np.flatnonzero(np.diff(shard, prepend=-1))
                rows = [(shard[a], b - a, slots[by[a:b]].tobytes(), _squeezed(records[by[a:b]])) for a, b in zip(at, [*at[1:], n_out], strict=True)]
                kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in DEALT.split(", ")])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition is one shard."""
        shard, body = None, None
        for batch in batches:
            for shard, k, slots, records in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if body is None:
                    body = np.zeros((min(shard_sequences, n - shard * shard_sequences), record_bytes), dtype=np.uint8)
                places = np.frombuffer(slots, np.int64) - shard * shard_sequences
                body[places] = _stretched(records, k * record_bytes, np.dtype(np.uint8)).reshape(k, record_bytes)
        if body is None:
            return
        fs, root = place(folder)
        fs.create_dir(root, recursive=True)
        # A new name for every attempt; only finished tasks report theirs.
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.bin"
        with fs.open_output_stream(f"{root}/{name}") as file:
            file.write(memoryview(body).cast("B"))
        tokens = int(_lengths(body.data, record_bytes).sum())
        row = [[v] for v in (shard, f"{folder}/{name}", shard * shard_sequences, len(body), record_bytes, width.itemsize, tokens)]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], [f.split()[0] for f in MANIFEST.split(", ")])

    return staged(blocks.mapInArrow(deal, DEALT).repartitionById(shards, "shard").mapInArrow(write, MANIFEST), "manifest")


def _blocks(path: str, offset: int, stride_: int, slot: int) -> Iterator[tuple[int, bytes]]:
    """(first slot, bytes) of a file from a byte offset on, a bounded number of whole records at a time."""
    fs, name = place(path)
    with fs.open_input_file(name) as file:
        file.seek(offset)
        while block := file.read(256 * stride_):
            yield slot, block
            slot += len(block) // stride_


def read_records(path: str, first_slot: int, stride_: int, width: int, from_slot: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, ids) of a shard in order, from ``from_slot`` on."""
    kind = np.uint16 if width == 2 else np.uint32
    start = first_slot if from_slot is None else max(first_slot, from_slot)
    for slot, block in _blocks(path, (start - first_slot) * stride_, stride_, start):
        for k, n in enumerate(_lengths(block, stride_).tolist()):
            yield slot + k, np.frombuffer(block, kind, n, k * stride_ + 4).astype("<u4")


def read_shards(manifest: DataFrame, from_slot: int = 0) -> DataFrame:
    """``slot``, ``shard``, ``byte_offset``, ``n_tokens``, ``ids`` of all records from ``from_slot`` on, read from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                step, first = row["stride"], max(row["first_slot"], from_slot)
                for slot, block in _blocks(row["path"], (first - row["first_slot"]) * step, step, first):
                    n = len(block) // step
                    lengths = _lengths(block, step)
                    bodies = np.frombuffer(block, np.uint8).reshape(n, step)[:, 4:]
                    ids = np.ascontiguousarray(bodies).view(np.uint16 if row["width"] == 2 else np.uint32).astype("<u4")
                    whole = (lengths == ids.shape[1]).all()
                    blobs = _as_binary(ids.view(np.uint8)) if whole else pa.array([r[:k].tobytes() for r, k in zip(ids, lengths, strict=True)], pa.binary())
                    slots = np.arange(slot, slot + n)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(slots), pa.array(np.full(n, row["shard"])), pa.array((slots - row["first_slot"]) * step), pa.array(lengths), blobs],
                        ["slot", "shard", "byte_offset", "n_tokens", "ids"],
                    )

    wanted = manifest.filter(F.col("first_slot") + F.col("sequences") > from_slot)
    return wanted.mapInArrow(run, "slot long, shard long, byte_offset long, n_tokens long, ids binary")
