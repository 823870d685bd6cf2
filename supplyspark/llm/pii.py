"""Personal data: exact rules, and a linear-chain conditional random field that adds to them.

The field labels words that hold a digit or ``@``; all other words are outside
by definition, so the chain falls into runs of such words whose best labelling
is found independently and exactly. Features are shapes of a word and its
neighbours. Weights are learned from a small labelled table by full-batch
gradient steps on the conditional likelihood. Runs are decoded by Viterbi, many
of them at once.
"""

from __future__ import annotations

from collections.abc import Iterator
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from supplyspark.llm.common import texts_of, trimmed

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
LABELS = ("O", *(f"{position}-{kind}" for kind in KINDS for position in "BI"))
LABELLED = os.path.join(os.path.dirname(os.path.abspath(__file__)), "pii_labelled.txt")
ROUNDS, STEP, PENALTY = 150, 0.5, 0.02

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Starting inside a run of digits could not succeed where its first digit fails.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HAS_DIGIT = re.compile(r"[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part and domain, found from each ``@`` to the left, hence in linear time."""
    last = 0
    for match in _DOMAIN.finditer(text):
        at = start = match.start()
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at:
            yield start, match.end()
            last = match.end()


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all matches of the fixed rules, by start and kind."""
    found = []
    if "@" in text:
        found += [(a, b, "email") for a, b in _emails(text)]
    if _HAS_DIGIT.search(text):
        for match in _IP.finditer(text):
            if all(len(part.lstrip("0")) <= 3 and int(part[-3:]) <= 255 for part in match[0].split(".")):
                found.append((*match.span(), "ip"))
        for match in _CARD.finditer(text):
            digits = _NO_DIGIT.sub("", match[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((*match.span(), "card"))
        if "+" in text:
            for match in _PHONE.finditer(text):
                if 9 <= len(_NO_DIGIT.sub("", match[0])) <= 15:
                    found.append((*match.span(), "phone"))
    return sorted(found, key=lambda span: (span[0], KINDS.index(span[2])))


_WORD = re.compile(r"\S+")
_CORE = re.compile(r"[+(]*\w(?:.*\w)?\)?", re.DOTALL)
_SHAPES = ((re.compile(r"[0-9]"), "d"), (re.compile(r"[^\W\d_]"), "x"))
_RUNS = re.compile(r"(.)\1+", re.DOTALL)
_HEX = re.compile(r"[0-9a-fA-F]+\Z")


def _size(n: int) -> str:
    return str(n) if n <= 4 else "5-8" if n <= 8 else "9-11" if n <= 11 else "12-19" if n <= 19 else "20+"


def shape(word: str) -> str:
    """Digits as d, letters as x, runs shortened, other characters as they are; only the first 40 count."""
    for pattern, mark in _SHAPES:
        word = pattern.sub(mark, word[:40])
    return _RUNS.sub(r"\1+", word)


def features(words: list[str], i: int) -> list[str]:
    """Feature names of word ``i``, a candidate."""
    word = words[i]
    digits = sum(c.isdigit() for c in word)
    last = words[i - 1] if i else ""
    after = words[i + 1] if i + 1 < len(words) else ""
    mixed = digits < len(word) and word.isalnum()
    return [
        "1",
        f"shape={shape(word)}",
        f"digits={_size(digits)}",
        f"dots={min(word.count('.'), 4)}",
        f"at={'@' in word[1:-1] and '.' in word}",
        f"first={word[:1] if not word[:1].isalnum() else shape(word[:1])}",
        f"hex={len(word) >= 20 and bool(_HEX.match(word))}",
        f"long mixed={mixed and len(word) >= 10}",
        f"last={shape(last)[:6] if _HAS_DIGIT.search(last) else '-'},{_size(sum(c.isdigit() for c in last))}",
        f"after={shape(after)[:6] if _HAS_DIGIT.search(after) else '-'},{_size(sum(c.isdigit() for c in after))}",
        f"cue={last.lower().strip(':.=\"') if last.isascii() and 2 < len(last) < 12 and not _HAS_DIGIT.search(last) else ''}",
    ]


def candidate_runs(text: str) -> Iterator[tuple[list[tuple[int, int]], list[list[str]]]]:
    """Runs of words with a digit or ``@``: their places, and their features."""
    if "@" not in text and not _HAS_DIGIT.search(text):
        return
    words, spans = [], []
    for match in _WORD.finditer(text):
        core = _CORE.search(match[0])
        a, b = core.span() if core else (0, len(match[0]))
        words.append(match[0][a:b])
        spans.append((match.start() + a, match.start() + b))
    run: list[int] = []
    for i, word in enumerate([*words, ""]):
        if "@" in word or _HAS_DIGIT.search(word):
            run.append(i)
        elif run:
            yield [spans[k] for k in run], [features(words, k) for k in run]
            run = []


class ChainField:
    """Weights: one vector over LABELS for each feature, and transitions; every run starts and ends outside."""

    def __init__(self, weights: dict[str, np.ndarray], transitions: np.ndarray):
        self.weights, self.transitions = weights, transitions

    def emissions(self, run: list[list[str]]) -> np.ndarray:
        zero = np.zeros(len(LABELS))
        return np.array([sum((self.weights.get(f, zero) for f in word), zero) for word in run])

    def decode(self, runs: list[np.ndarray]) -> list[np.ndarray]:
        """Best labels of each run. Runs of about the same length are decoded together."""
        out: list[np.ndarray] = [np.empty(0, int)] * len(runs)
        order = sorted(range(len(runs)), key=lambda k: len(runs[k]))
        at = 0
        while at < len(order):
            # At most twice the length of the first, and a bounded number of cells.
            least = len(runs[order[at]])
            stop = at
            while stop < len(order) and len(runs[order[stop]]) <= 2 * least and (stop - at + 1) * len(runs[order[stop]]) <= 1 << 18 or stop == at:
                stop += 1
            group = order[at:stop]
            at = stop
            longest = max(len(runs[k]) for k in group)
            scores = np.zeros((len(group), longest, len(LABELS)))
            scores[:, :, 1:] = -1e9  # padding is outside
            for row, k in enumerate(group):
                scores[row, : len(runs[k])] = runs[k]
            back = np.zeros(scores.shape, dtype=np.int8)
            best = scores[:, 0] + self.transitions[0]
            for t in range(1, longest):
                through = best[:, :, None] + self.transitions[None]
                back[:, t] = through.argmax(axis=1)
                best = through.max(axis=1) + scores[:, t]
            state = (best + self.transitions[:, 0]).argmax(axis=1)
            path = np.empty((len(group), longest), dtype=np.int8)
            rows = np.arange(len(group))
            for t in range(longest - 1, -1, -1):
                path[:, t] = state
                state = back[rows, t, state]
            for row, k in enumerate(group):
                out[k] = path[row, : len(runs[k])]
        return out


def _allowed() -> np.ndarray:
    """I-k only after B-k or I-k."""
    ok = np.ones((len(LABELS), len(LABELS)), dtype=bool)
    for j, label in enumerate(LABELS):
        if label.startswith("I-"):
            ok[:, j] = [before[2:] == label[2:] and before != "O" for before in LABELS]
    return ok


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def parse_labelled(line: str) -> tuple[str, list[tuple[int, int, str]]]:
    """Text and spans of a line in which ``{kind|text}`` marks a span."""
    text, spans, at = "", [], 0
    for match in re.finditer(r"\{(\w+)\|([^}]*)\}", line):
        text += line[at : match.start()]
        spans.append((len(text), len(text) + len(match[2]), match[1]))
        text += match[2]
        at = match.end()
    return text + line[at:], spans


def train(lines: list[str]) -> ChainField:
    """Fit the field to labelled lines."""
    runs, truths = [], []
    for line in lines:
        text, spans = parse_labelled(line)
        for places, names in candidate_runs(text):
            labels = []
            for a, b in places:
                inside = next((s for s in spans if a < s[1] and b > s[0]), None)
                labels.append(0 if inside is None else LABELS.index(f"{'B' if a <= inside[0] else 'I'}-{inside[2]}"))
            runs.append(names)
            truths.append(labels)
    names = sorted({name for run in runs for word in run for name in word})
    index = {name: i for i, name in enumerate(names)}
    coded = [np.array([[index[name] for name in word] for word in run]) for run in runs]
    weights, transitions = np.zeros((len(names), len(LABELS))), np.zeros((len(LABELS), len(LABELS)))
    barred = np.where(_allowed(), 0.0, -1e6)
    seen_w, seen_t = np.full_like(weights, 1e-6), np.full_like(transitions, 1e-6)
    for _ in range(ROUNDS):
        grad_w, grad_t = -PENALTY * weights, -PENALTY * transitions
        moves = transitions + barred
        for code, truth in zip(coded, truths, strict=True):
            emit = weights[code].sum(axis=1)
            n = len(code)
            ahead, behind = np.empty((n, len(LABELS))), np.empty((n, len(LABELS)))
            ahead[0] = moves[0] + emit[0]
            for t in range(1, n):
                ahead[t] = _log_sum(ahead[t - 1][:, None] + moves, 0) + emit[t]
            behind[-1] = moves[:, 0]
            for t in range(n - 2, -1, -1):
                behind[t] = _log_sum(moves + (emit[t + 1] + behind[t + 1])[None], 1)
            total = _log_sum(ahead[-1] + moves[:, 0], 0)
            off = -np.exp(ahead + behind - total)
            off[np.arange(n), truth] += 1
            for t in range(n):
                np.add.at(grad_w, code[t], off[t])
            pairs = -np.exp(ahead[:-1, :, None] + moves[None] + (emit[1:] + behind[1:])[:, None, :] - total).sum(axis=0)
            grad_t += pairs
            grad_t[0] += off[0]
            grad_t[:, 0] += off[-1]
            for a, b in zip(truth[:-1], truth[1:], strict=True):
                grad_t[a, b] += 1
        seen_w += grad_w**2
        seen_t += grad_t**2
        weights += STEP * grad_w / np.sqrt(seen_w)
        transitions += STEP * grad_t / np.sqrt(seen_t)
    return ChainField({name: weights[i] for name, i in index.items()}, transitions + barred)


def labelled_lines(path: str = LABELLED) -> list[str]:
    with open(path, encoding="utf-8") as file:
        return [line.rstrip("\n") for line in file if line.strip()]


def all_spans(texts: list[str], field: ChainField) -> Iterator[tuple[list, list]]:
    """Base spans and all spans of each text. A learned span that meets a base span is left out."""
    places, names, owner = [], [], []
    for k, text in enumerate(texts):
        for where, run in candidate_runs(text):
            places.append(where)
            names.append(field.emissions(run))
            owner.append(k)
    learned: dict[int, list] = {}
    for where, labels, k in zip(places, field.decode(names), owner, strict=True):
        start = None
        for i, label in enumerate([*labels.tolist(), 0]):
            if start is not None and (i == len(labels) or not LABELS[label].startswith("I-")):
                learned.setdefault(k, []).append((where[start][0], where[i - 1][1], LABELS[labels[start]][2:]))
                start = None
            if i < len(labels) and LABELS[label].startswith("B-"):
                start = i
    for k, text in enumerate(texts):
        base = base_spans(text)
        extra = []
        if k in learned:
            taken = sorted((a, b) for a, b, _ in base)
            extra = [s for s in learned[k] if not any(a < s[1] and s[0] < b for a, b in taken)] if len(taken) < 64 else _apart(learned[k], taken)
        yield base, sorted({*base, *extra}, key=lambda span: (span[0], KINDS.index(span[2])))


def _apart(spans: list[tuple[int, int, str]], taken: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """Spans that meet none of ``taken`` (sorted); for texts with many of both."""
    starts = np.array([a for a, _ in taken])
    reach = np.maximum.accumulate(np.array([b for _, b in taken]))
    out = []
    for span in spans:
        before = int(np.searchsorted(starts, span[1], side="left"))
        if before == 0 or reach[before - 1] <= span[0]:
            out.append(span)
    return out


SCHEMA = "doc_id long, base array<struct<start:int,end:int,kind:string>>, spans array<struct<start:int,end:int,kind:string>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))


def find_personal_data(docs: DataFrame, labelled: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``base`` and ``spans`` (all, base ones included) of each row, in code points.

    A null or empty text has none. Works row by row, so repeated rows and null
    ids pass through; other columns are ignored.
    """
    field = train(labelled_lines() if labelled is None else labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = list(all_spans(batch.column(1).to_pylist(), field))
            columns = [[[dict(zip(("start", "end", "kind"), s, strict=True)) for s in spans] for spans in side] for side in zip(*both, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, _SPANS) for c in columns or [[], []])], ["doc_id", "base", "spans"]
            )

    return texts_of(docs, id_col, text_col).mapInArrow(trimmed(run), SCHEMA)


def redact(docs: DataFrame, labelled: list[str] | None = None, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; same rows and columns.

    Where spans meet, the merged stretch takes the kind of its first. A null
    text stays null. ``count_col`` (a number of characters) is set anew where
    the text changes.
    """
    field = train(labelled_lines() if labelled is None else labelled)
    at = docs.columns.index(text_col)
    count_at = docs.columns.index(count_col) if count_col else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = all_spans([t or "" for t in texts], field)
            changed = [t if not spans else _replaced(t, spans) for t, (_, spans) in zip(texts, found, strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array(changed, batch.schema.field(at).type)
            if count_at is not None:
                counts = [n if new is old else len(new) for n, old, new in zip(batch.column(count_at).to_pylist(), texts, changed, strict=True)]
                columns[count_at] = pa.array(counts, batch.schema.field(count_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(trimmed(run), docs.schema)


def _replaced(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])
