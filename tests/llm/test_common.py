import numpy as np
import pyarrow as pa

from supplyspark.llm.common import by_groups, chunks, trimmed, word_hashes


def test_groups_across_batches():
    keys = [0, 0, 1, 1, 1, 2, 5, 5]
    batches = [pa.RecordBatch.from_pydict({"k": keys[a:b], "v": list(range(a, b))}) for a, b in ((0, 3), (3, 3), (3, 4), (4, 7), (7, 8))]
    sums = lambda t: pa.table({"k": [t["k"][0].as_py()], "s": [sum(t["v"].to_pylist())]})
    out = [r for b in trimmed(by_groups(sums, ["k"]))(iter(batches)) for r in b.to_pylist()]
    assert out == [{"k": 0, "s": 1}, {"k": 1, "s": 9}, {"k": 2, "s": 5}, {"k": 5, "s": 13}]
    assert list(by_groups(sums, ["k"])(iter([]))) == []


def test_chunks_hold_whole_rows():
    texts = ["a" * 10, None, "", "b" * 500, "c", "d" * 90]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    parts = [(part.num_rows, bytes(data)) for part, data, _ in chunks(batch, size=100)]
    assert sum(n for n, _ in parts) == 6 and b"".join(d for _, d in parts) == "".join(t or "" for t in texts).encode()
    assert len(parts) > 2


def test_own_separators():
    dash = np.zeros(256, dtype=bool)
    dash[45] = True
    data = np.frombuffer(b"a b-A B--c", np.uint8)
    hashes, first = word_hashes(data, np.array([0, 10]), separators=dash)
    assert len(hashes) == 3 and hashes[0] == hashes[1] != hashes[2] and first.tolist() == [0, 3]
