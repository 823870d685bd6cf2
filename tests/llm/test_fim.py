import hashlib
import re

from compare import connect, differences
from helpers import SF, awkward_docs, clashing, empty_docs
import numpy as np

import corpus_pipeline
from supplyspark.llm.fim import fill_in_middle, restored, unit_marks


def plain_python(doc_id, text, seed=1):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * g : 8 * g + 8], 16) for g in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def check(docs):
    out = fill_in_middle(docs).withColumn("again", restored())
    key = lambda r: tuple(str(x) for x in r)
    found = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["again"]) for r in out.collect()), key=key)
    wanted = [(r["doc_id"], *plain_python(r["doc_id"], r["text"]), r["text"] or "") for r in docs.collect()]
    assert found == sorted(wanted, key=key)
    return {r[2] for r in found}


def test_documents(spark):
    assert check(spark.read.parquet(f"{SF}/documents.parquet")) == {"plain", "psm", "spm"}


def test_awkward(spark):
    check(clashing(awkward_docs(spark)))
    assert fill_in_middle(empty_docs(spark)).count() == 0


def test_markers_at_the_cuts(spark):
    """Halves of markers, markers themselves, every width of character, letters around 8-byte words."""
    pieces = ["<", "<P", "P>", "<S", "S>", ">", "<M", "<<", "é", "漢", "🙂", "\x00", "\x7f", "@", "[", "`", "{", "Zz", "aA9", " ", "abcdefgh", "a" * 17]
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(pieces, rng.integers(0, 30))) for _ in range(400)]
    texts += [m + t for m, t in zip(("<P>", "<S>", "<M>"), texts, strict=False)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert check(docs) == {"plain", "psm", "spm"}


def test_marks_at_text_borders():
    """Letters that meet across a border belong to two units."""
    data = np.frombuffer("abcdeféé9".encode(), np.uint8)
    ends, firsts = unit_marks(data, np.array([0, 3, 3, 6, 8, 11]))
    assert ends.select(np.arange(1, 6)).tolist() == [2, 5, 7, 9, 10]
    assert firsts.rank(np.array([0, 6, 8, 11])).tolist() == [0, 6, 7, 9]


def test_contract(spark):
    out = corpus_pipeline.QUERIES["op12_fill_in_middle"](spark, SF)
    assert out.dtypes == [
        ("doc_id", "bigint"), ("n", "bigint"), ("form", "string"), ("prefix_chars", "bigint"), ("middle_chars", "bigint"),
        ("output_sha256", "string"), ("restored_sha256", "string"),
    ]
    assert differences(out, connect(SF), corpus_pipeline.ORACLE["op12_fill_in_middle"]) == []
