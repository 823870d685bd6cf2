"""Registration, the SQL oracles, and the pipeline against plain Python."""

from compare import connect, differences
from helpers import SF, awkward_docs, clashing, near_components
import pytest

import __spark_entry__
import corpus_pipeline
from supplyspark.llm import pii, toxicity
from supplyspark.llm.common import read


def test_registered():
    names = __spark_entry__.queries()
    assert {name.split("_")[0] for name in corpus_pipeline.QUERIES} == {f"op{n}" for n in range(1, 14)} | {"pipeline"}
    assert set(corpus_pipeline.QUERIES) <= set(names)
    assert set(corpus_pipeline.ORACLE) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(corpus_pipeline.ORACLE))
def test_oracle(spark, name):
    df = corpus_pipeline.QUERIES[name](spark, SF)
    assert differences(df, connect(SF), corpus_pipeline.ORACLE[name]) == []


def test_pipeline_against_plain_python(spark):
    docs = read(spark, SF, "documents")
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    model = toxicity.fit(docs, read(spark, SF, "labels"))
    rows = {i: t for i, t in rows.items() if model.score(t)[0] < 0.5}
    last = {t: max(i for i, x in rows.items() if x == t) for t in set(rows.values())}
    rows = {i: t for t, i in last.items()}
    rows = {i: rows[i] for i, (_, c) in near_components(list(rows.items())).items() if i == c}
    field = pii.train(pii.labelled_lines())
    rows = {i: pii._replaced(t, spans) if spans else t for (i, t), (_, spans) in zip(rows.items(), pii.all_spans(list(rows.values()), field), strict=True)}
    from supplyspark.llm import packing
    import public_tokenizers

    use = packing._encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    wanted = {i: (*use.encode(t).tolist(), 0) for i, t in rows.items()}
    found = {}
    for r in sorted(corpus_pipeline.run(spark, SF).collect(), key=lambda r: (r["doc_id"], r["start"])):
        ids = memoryview(bytes(r["ids"])).cast("I").tolist()
        found[r["doc_id"]] = (*found.get(r["doc_id"], ()), *ids)
    assert found == wanted


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_columns(spark, name, stage):
    docs = clashing(awkward_docs(spark))
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns and out.count() >= 7
    none = stage(spark, docs.limit(0), SF)
    assert none.columns == docs.columns and none.count() == 0
