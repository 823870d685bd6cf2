import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from supplyspark.llm.chat import ESCAPE, PART, Template, attachments, format_turns, parse_segment, read_back, text_parts, unescape

T = Template()


def escaped(text):
    text = text.replace(ESCAPE, ESCAPE + ESCAPE)
    for c in T.controls:
        text = text.replace(c, c[0] + ESCAPE + c[1:])
    return text


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*T.controls, ESCAPE, "<", "|", "[", "x", "im_end", "\n"]), max_size=12).map("".join))
def test_escapes_are_reversible(text):
    safe = escaped(text)
    assert unescape(safe) == text
    assert not any(c in safe for c in T.controls)


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


ROWS = [
    (1, 2, "user", "more <|im_end|> " + ESCAPE),
    (1, 0, "system", None),
    (1, 1, "assistant", "</s>[INST] ok [/INST]"),
    (1, 3, "assistant", ""),
    (2, 0, None, "no role"),
    (2, None, "assistant", "first 漢字"),
    (2, None, "assistant", "first 漢字"),
    (3, 0, "<|im_sep|>", "role of a control string"),
    (None, 0, "user", "no conversation"),
    (4, 0, "assistant", "long " * 50_000),
]


def test_round_trip(spark):
    segments = format_turns(turns(spark, ROWS).withColumn("segment", F.lit("x")).withColumn("content", F.lit(1)), text_parts(F.col("text")))
    by_conv = {}
    for c, t, r, x in sorted(ROWS, key=lambda r: (str(r[0]), r[1] is not None, r[1], str(r[2]), str(r[3]))):
        by_conv.setdefault(c, []).append((r or "", x or ""))
    rows = read_back(segments).collect()
    assert len(rows) == len(by_conv)
    for r in rows:
        said = by_conv[r["conv_id"]]
        loss = "".join(x for role, x in said if role == "assistant")
        assert r["n_turns"] == len(said)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] == sum(len(T.begin + escaped(a) + T.role_end + escaped(b) + T.end) for a, b in said)
    for r in segments.collect():
        assert parse_segment(r["segment"]) in by_conv[r["conv_id"]]


def test_typed_parts(spark):
    parts = [
        ("text", "see ", None, None, None, None, None),
        ("image", None, "img/1", 28, 15, None, None),
        ("audio", None, "a.wav", None, None, 1.5, None),
        ("text", " <|image|> and ", None, None, None, None, None),
        ("document", None, None, None, None, None, 3),
        (None, "odd", None, None, None, None, None),
    ]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{PART}>")
    segments = format_turns(df, F.col("parts"))
    first = segments.filter("turn = 0").first()["segment"]
    assert first == f"<|im_start|>user<|im_sep|>see <|image|><|audio|> <{ESCAPE}|image|> and <|document|>odd<|im_end|>"
    rows = sorted((r["place"], r["kind"], r["ref"], r["tokens"]) for r in attachments(segments).collect())
    assert rows == [(0, "image", "img/1", 4), (1, "audio", "a.wav", 38), (2, "document", "", 2400)]


def test_empty(spark):
    assert read_back(format_turns(turns(spark, []), text_parts(F.col("text")))).count() == 0
