import random
import re

from helpers import awkward_docs, clashing, empty_docs

from supplyspark.llm import pii


def plain(text):
    """The rules with the patterns as given."""
    found = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((*m.span(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and pii.luhn(digits):
            found.append((*m.span(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((*m.span(), "phone"))
    return sorted(found, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_rules_against_plain_patterns():
    rng = random.Random(8)
    for alphabet in ("ab@@..1205+- ()%", "0123456789- .+", "a@b.-"):
        for _ in range(4000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
            assert pii.base_spans(text) == plain(text), text


def test_long_texts_are_linear():
    for text in ("a" * 500_000 + "@", "1" * 500_000, "1." * 300_000, "+1 " * 200_000, "a@" * 200_000):
        pii.base_spans(text)


def test_viterbi_against_all_paths():
    rng = pii.np.random.default_rng(0)
    field = pii.ChainField({}, pii.np.where(pii._allowed(), rng.normal(size=(11, 11)), -1e6))
    runs = [rng.normal(size=(n, 11)) for n in (1, 2, 3, 3, 1, 4)]
    for run, path in zip(runs, field.decode(runs), strict=True):
        best = max(
            pii.np.ndindex(*[11] * len(run)),
            key=lambda p: sum(run[t, s] for t, s in enumerate(p))
            + field.transitions[0, p[0]]
            + sum(field.transitions[a, b] for a, b in zip(p, p[1:], strict=False))
            + field.transitions[p[-1], 0],
        )
        assert tuple(path.tolist()) == best


def test_field_learns_and_holds_out():
    """Trained on four fifths of the labelled lines it finds most spans of the others."""
    lines = pii.labelled_lines()
    right = total = wrong = 0
    for fold in range(5):
        field = pii.train([x for k, x in enumerate(lines) if k % 5 != fold])
        for line in lines[fold::5]:
            text, spans = pii.parse_labelled(line)
            ((_, found),) = pii.all_spans([text], field)
            total += len(spans)
            right += sum(any(a < s[1] and s[0] < b for a, b, _ in found) for s in spans)
            wrong += sum(not any(a < s[1] and s[0] < b for s in spans) for a, b, _ in found)
    assert right >= 0.8 * total and wrong <= 0.25 * total


def test_base_spans_stay():
    field = pii.train(pii.labelled_lines())
    text = "mail a.b@c.example.org or +1 (459) 555-9246, token = \"cb1a9fee807a05366fcb8b6c95c7c565ede51a72\" and 10.0.0.17"
    ((base, found),) = pii.all_spans([text], field)
    assert set(base) <= set(found)
    assert {kind for _, _, kind in found} == {"email", "phone", "secret", "ip"}


def test_documents(spark):
    docs = clashing(awkward_docs(spark))
    rows = pii.find_personal_data(docs).collect()
    assert len(rows) == docs.count()
    assert pii.find_personal_data(empty_docs(spark)).count() == 0


def test_redact(spark):
    docs = clashing(awkward_docs(spark)).unionByName(
        clashing(spark.createDataFrame([(20, "hi a.b@c.example.org, 10.0.0.17!", "en", "a", 32)], docs_schema()))
    )
    out = pii.redact(docs, count_col="n_chars")
    assert out.columns == docs.columns and out.count() == docs.count()
    row = out.filter("doc_id = 20").first()
    assert row["text"] == "hi <email>, <ip>!" and row["n_chars"] == len(row["text"])
    assert out.filter("doc_id = 3").first()["text"] is None


def docs_schema():
    from helpers import DOCS

    return DOCS
