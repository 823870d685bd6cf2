"""Chat formatting with typed content parts.

A turn's content is a text or a list of typed parts. A visitor per kind turns
each part into escaped text or a placeholder, and records what it stands for
and how many tokens it will take. Turns become segments of a template whose
control strings cannot occur in content: their first character is followed by
an escape there, and the escape itself is doubled, which the reader undoes.

Segments stay rows of their own until they are written, so a conversation of
any length is streamed in order and never gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
import functools
import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "␛"


@dataclass(frozen=True)
class Template:
    """Control strings of a format. None may contain ESCAPE or be one character long."""

    begin: str = "<|im_start|>"
    role_end: str = "<|im_sep|>"
    end: str = "<|im_end|>"
    image: str = "<|image|>"
    audio: str = "<|audio|>"
    document: str = "<|document|>"
    foreign: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.begin, self.role_end, self.end, self.image, self.audio, self.document, *self.foreign)


@dataclass(frozen=True)
class Expansion:
    """Tokens that an attachment stands for."""

    image_patch: int = 14  # pixels of a patch's side
    audio_rate: float = 25.0  # tokens a second
    document_page: int = 800  # tokens a page


def escape(text: Column, template: Template) -> Column:
    """Text in which no control string occurs."""
    text = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + ESCAPE))
    for control in template.controls:
        text = F.replace(text, F.lit(control), F.lit(control[0] + ESCAPE + control[1:]))
    return text


def unescape(text: str) -> str:
    return re.sub(ESCAPE + "(.)", r"\1", text, flags=re.DOTALL)


PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


class PartVisitor:
    """Flattens an array of parts (PART). One method for each kind gives its text and its expanded tokens."""

    def __init__(self, template: Template, expansion: Expansion):
        self.template, self.expansion = template, expansion

    def text(self, part: Column) -> tuple[Column, Column]:
        return escape(F.coalesce(part["text"], F.lit("")), self.template), F.lit(0)

    def image(self, part: Column) -> tuple[Column, Column]:
        side = self.expansion.image_patch
        tokens = F.ceil(F.coalesce(part["width"], F.lit(0)) / side) * F.ceil(F.coalesce(part["height"], F.lit(0)) / side)
        return F.lit(self.template.image), tokens

    def audio(self, part: Column) -> tuple[Column, Column]:
        return F.lit(self.template.audio), F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * self.expansion.audio_rate)

    def document(self, part: Column) -> tuple[Column, Column]:
        return F.lit(self.template.document), F.coalesce(part["pages"], F.lit(0)) * self.expansion.document_page

    def visit(self, part: Column) -> Column:
        """``content``, ``ref``, ``kind`` and ``tokens`` of a part; an unknown kind is read as text."""
        text, none = self.text(part)
        content, tokens = text, none.cast("long")
        for kind in ("image", "audio", "document"):
            found, n = getattr(self, kind)(part)
            content = F.when(part["type"] == kind, found).otherwise(content)
            tokens = F.when(part["type"] == kind, n.cast("long")).otherwise(tokens)
        attached = part["type"].isin("image", "audio", "document")
        return F.struct(
            content.alias("content"),
            F.when(attached, F.coalesce(part["ref"], F.lit(""))).alias("ref"),
            F.when(attached, part["type"]).alias("kind"),
            tokens.alias("tokens"),
        )


def text_parts(text: Column) -> Column:
    """A plain text as a list of one text part."""
    nothing = [F.lit(None).cast(kind).alias(name) for name, kind in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *nothing))


def format_turns(
    turns: DataFrame,
    parts: Column,
    *,
    template: Template = Template(),
    expansion: Expansion = Expansion(),
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
) -> DataFrame:
    """One row for each turn: ``conv_id``, ``turn``, ``segment``, ``loss``, ``loss_start``, ``loss_end``, ``attachments``.

    ``segment`` is the formatted turn; a conversation's text is its segments by
    turn, role and content. The assistant's content is under the loss mask, at
    characters [loss_start, loss_end) of the segment. ``attachments`` are in the
    order of the placeholders, with their expanded token counts. Null roles,
    parts and texts are empty; repeated rows are turns of their own; other
    columns are ignored.
    """
    visitor = PartVisitor(template, expansion)
    role = F.coalesce(F.col(role_col), F.lit(""))
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        role.alias("role"),
        F.transform(F.coalesce(parts, F.array().cast(f"array<{PART}>")), visitor.visit).alias("visited"),
    )
    head = F.concat(F.lit(template.begin), escape(F.col("role"), template), F.lit(template.role_end))
    content = F.array_join(F.transform("visited", lambda v: v["content"]), "")
    rows = rows.withColumn("head", head).withColumn("content", content)
    attached = F.filter("visited", lambda v: v["kind"].isNotNull())
    return rows.select(
        "conv_id",
        "turn",
        F.concat("head", "content", F.lit(template.end)).alias("segment"),
        (F.col("role") == "assistant").alias("loss"),
        F.char_length("head").cast("long").alias("loss_start"),
        (F.char_length("head") + F.char_length("content")).cast("long").alias("loss_end"),
        F.transform(attached, lambda v: F.struct(v["kind"].alias("kind"), v["ref"].alias("ref"), v["tokens"].alias("tokens"))).alias("attachments"),
    )


def in_order(segments: DataFrame) -> DataFrame:
    """Segments so that each conversation is in one partition and in order (null turns first)."""
    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment")


def parse_segment(segment: str, template: Template = Template()) -> tuple[str, str]:
    """Role and content of a formatted turn, unescaped. Placeholders stay as they are."""
    head, content = segment.removeprefix(template.begin).removesuffix(template.end).split(template.role_end, 1)
    return unescape(head), unescape(content)


SUMMARY = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """Digests of each conversation's turns and of all text under the loss mask, parsed from the formatted text.

    Streams over ordered segments; of a conversation only running digests are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        names = [f.split()[0] for f in SUMMARY.split(", ")]

        def row() -> list:
            conv, n, turns, chars, loss, size = state
            return [conv, n, turns.hexdigest(), chars, loss.hexdigest(), size]

        def as_batch(done: list[list]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)

        for batch in batches:
            done = []
            for conv, segment, masked, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(row())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, content = parse_segment(segment, template)
                state[1] += 1
                state[2].update(f"{role}\n{content}\n".encode())
                if masked:
                    text = unescape(segment[start:end])
                    state[3] += len(text)
                    state[4].update(text.encode())
                state[5] += len(segment)
            if done:
                yield as_batch(done)
        if state is not None:
            yield as_batch([row()])

    ordered = in_order(segments).select("conv_id", "segment", "loss", "loss_start", "loss_end")
    return ordered.mapInArrow(run, SUMMARY)


def attachments(segments: DataFrame) -> DataFrame:
    """One row for each attachment: conversation, turn, place in the turn, kind, reference and tokens."""
    return segments.select("conv_id", "turn", F.posexplode("attachments").alias("place", "a")).select("conv_id", "turn", "place", "a.*")


def with_turns(turns: DataFrame, added: list[tuple[int, int, str, str]]) -> DataFrame:
    """``turns`` and a few more, as (conv_id, turn, role, text)."""
    spark = turns.sparkSession
    more = spark.createDataFrame(added, "conv_id long, turn long, role string, text string")
    return functools.reduce(DataFrame.unionByName, [turns.select("conv_id", "turn", "role", "text"), more])
