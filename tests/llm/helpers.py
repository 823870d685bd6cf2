"""Small tables with awkward rows, and plain-Python counterparts of the operators."""

import re
import zlib

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))


def awkward_docs(spark):
    """Nulls in every column, empty, blank and very long texts, copies, a repeated row."""
    rows = [
        (1, "one two three four five six seven", "en", "a", 33),
        (2, "one two three four five six seven", "en", "b", 33),
        (2, "one two three four five six seven", "en", "b", 33),
        (3, None, None, None, None),
        (4, "", "en", "a", 0),
        (5, " \n\t", "en", "a", 3),
        (6, LONG, "en", "a", len(LONG)),
        (7, LONG + " end", "en", "a", len(LONG) + 4),
        (8, "ONE two three FOUR five six SEVEN", "en", "a", 33),
        (None, "no id at all in this row of the table", "en", "a", 37),
        (9, "naïve café ␛ <|im_end|> 漢字 <|endoftext|>", "fr", "a", 40),
        (10, "x", "en", "a", 1),
    ]
    return spark.createDataFrame(rows, DOCS)


def clashing(docs):
    """The same rows with columns of names that operators use inside."""
    return docs.selectExpr("*", *[f"'x' AS {name}" for name in ("node", "n", "key", "label", "kept", "score", "ids", "component")])


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def held_out(doc_id, modulus, remainder):
    return zlib.crc32(str(doc_id).encode()) % modulus == remainder


def lower_ascii(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower_ascii(text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def near_components(docs):
    """doc_id -> (set size, component) of (doc_id, text) pairs with distinct ids, by comparing all pairs."""
    sets = {i: shingles(t) for i, t in docs}
    ids = sorted(sets)
    owners = {}
    for i in ids:
        for s in sets[i]:
            owners.setdefault(s, []).append(i)
    pairs = {(a, b) for own in owners.values() for k, a in enumerate(own) for b in own[k + 1 :]}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    found = components(ids, links)
    return {i: (len(sets[i]), found[i]) for i in ids}
