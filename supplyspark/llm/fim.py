"""Fill-in-the-middle by arithmetic on whole machine words.

Texts are cut into units: runs of ASCII letters and single other characters. A
chunk's UTF-8 is viewed as 64-bit words, and the last byte of every unit is
marked in its high bit by word arithmetic, eight bytes at a time. Population
counts of the marks and their running sum turn "the k-th unit of this text"
into a search for the word and a select inside it, so a text is cut at two units
without making an object for each of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplyspark.llm.common import chunks

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM = 90  # of 100: texts from here on stay plain
SPM_BELOW = 20  # of 100: of the others, those below have the suffix first

_ONES = np.uint64(0x0101010101010101)
_HIGH = np.uint64(0x8080808080808080)
_BYTE, _ONE = np.uint64(8), np.uint64(1)


def _following(marks: np.ndarray) -> np.ndarray:
    """Each byte's mark moved to the byte before it."""
    moved = marks >> _BYTE
    moved[:-1] |= marks[1:] << np.uint64(56)
    return moved


class Marks:
    """Marked bytes (high bits) of little-endian 64-bit words, with rank and select."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marks before byte ``at``."""
        word, byte = at >> 3, (at & 7).astype(np.uint64)
        inside = self.words[word] & ((_ONE << (byte * _BYTE)) - _ONE)
        return self.before[word] + np.bitwise_count(inside)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Byte of the k-th mark, counted from 1."""
        word = np.searchsorted(self.before, k, side="left") - 1
        left = (k - self.before[word]).astype(np.uint64)
        running = (self.words[word] >> np.uint64(7)) * _ONES  # byte i: marks in bytes 0 to i
        reached = ((running | _HIGH) - left * _ONES) & _HIGH
        return word * 8 + 8 - np.bitwise_count(reached)


def unit_marks(data: np.ndarray, offsets: np.ndarray) -> tuple[Marks, Marks]:
    """Marks of the last byte of every unit and of the first byte of every character of the texts."""
    size = len(data)
    padded = np.zeros((size // 8 + 1) * 8, dtype=np.uint8)
    padded[:size] = data
    words = padded.view("<u8")
    folded = (words | (np.uint64(0x20) * _ONES)) & ~_HIGH
    # From "a" on, not beyond "z", no byte of a longer character.
    letter = (folded + np.uint64(0x80 - 0x61) * _ONES) & ~(folded + np.uint64(0x80 - 0x7B) * _ONES) & ~words & _HIGH
    inner = words & ~(words << _ONE) & _HIGH  # bytes 10xxxxxx
    ends = _HIGH & ~_following(inner) & ~(letter & _following(letter))
    firsts = _HIGH & ~inner
    stops = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    by_byte = ends.view(np.uint8)
    by_byte[stops] = 0x80  # a unit never reaches into the next text
    by_byte[size:] = 0
    firsts.view(np.uint8)[size:] = 0
    return Marks(ends), Marks(firsts)


def cuts(data: np.ndarray, offsets: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each text: its units, the bytes where the middle begins and ends, and the characters of prefix and middle."""
    ends, firsts = unit_marks(data, offsets)
    start = offsets[:-1]
    base = ends.rank(start)
    n = ends.rank(offsets[1:]) - base
    a, b = h1 % (n + 1), h2 % (n + 1)

    def byte_after(units: np.ndarray) -> np.ndarray:
        out = start.copy()
        some = units > 0
        out[some] = ends.select(base[some] + units[some]) + 1
        return out

    low, high = byte_after(np.minimum(a, b)), byte_after(np.maximum(a, b))
    chars = [firsts.rank(x) for x in (start, low, high)]
    return n, low, high, chars[1] - chars[0], chars[2] - chars[1]


def _hash_group(group: int, seed: int, id_col: str) -> Column:
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(key, 256), 8 * group - 7, 8), 16, 10).cast("long")


def fill_in_middle(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 1,
    plain_from: int = PLAIN_FROM,
    spm_below: int = SPM_BELOW,
) -> DataFrame:
    """``doc_id``, ``n``, ``form``, ``prefix_chars``, ``middle_chars``, ``output``; one row for each row of ``docs``.

    ``form`` is ``psm`` (prefix, suffix, middle), ``spm`` (suffix first) or
    ``plain``, which empty texts and texts holding a marker always are. Cuts
    and form depend on the id alone, so rows that repeat are cut alike. A null
    text is empty, a null id hashes as the empty string; other columns are
    ignored, and an empty table gives an empty result.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    plain = (F.col("text") == "") | marked | (_hash_group(3, seed, "doc_id") % 100 >= plain_from)
    form = F.when(plain, "plain").when(_hash_group(4, seed, "doc_id") % 100 < spm_below, "spm").otherwise("psm")
    rows = slim.select("doc_id", "text", _hash_group(1, seed, "doc_id").alias("h1"), _hash_group(2, seed, "doc_id").alias("h2"), form.alias("form"))
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch):
                n, low, high, before, inside = cuts(data, offsets, part.column(2).to_numpy(), part.column(3).to_numpy())
                forms = part.column(4).to_pylist()
                is_plain = np.array([f == "plain" for f in forms], dtype=bool)
                whole = memoryview(data)
                out = []
                for f, start, a, b, stop in zip(forms, offsets[:-1].tolist(), low.tolist(), high.tolist(), offsets[1:].tolist(), strict=True):
                    if f == "plain":
                        out.append(bytes(whole[start:stop]))
                    elif f == "psm":
                        out.append(b"".join([b"<P>", whole[start:a], b"<S>", whole[b:stop], b"<M>", whole[a:b]]))
                    else:
                        out.append(b"".join([b"<S>", whole[b:stop], b"<P>", whole[start:a], b"<M>", whole[a:b]]))
                columns = [
                    part.column(0),
                    pa.array(n.astype(np.int64)),
                    part.column(4),
                    pa.array(before.astype(np.int64), mask=is_plain),
                    pa.array(inside.astype(np.int64), mask=is_plain),
                    pa.array(out, pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = slim.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: str = "output", form: str = "form") -> Column:
    """The text, from output and form alone.

    Texts that are cut hold no marker, and no marker begins with the end of
    another, so the first marker of each kind is the one that was put in.
    """
    whole, after = F.col(output), F.substr(F.col(output), F.lit(4))

    def parts(marker: str) -> tuple[Column, Column, Column]:
        first = F.substring_index(after, marker, 1)
        rest = F.substr(after, F.length(first) + 4)
        second = F.substring_index(rest, MIDDLE, 1)
        return first, second, F.substr(rest, F.length(second) + 4)

    prefix, suffix, middle = parts(SUFFIX)
    suffix_, prefix_, middle_ = parts(PREFIX)
    psm, spm = F.concat(prefix, middle, suffix), F.concat(prefix_, middle_, suffix_)
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(whole)
