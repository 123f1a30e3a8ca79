"""Symbol indexes in files: byte ranges of whole documents, against decoding an index at once."""

import random
from collections import Counter

import pytest

from tidemark.sources import scip, scip_files


def message(number, value):
    if isinstance(value, int):
        return bytes([number << 3, value])
    n, size = len(value), b""
    while n > 127:
        n, size = n >> 7, size + bytes([n & 127 | 128])
    return bytes([number << 3 | 2]) + size + bytes([n]) + value


def document(k, n):
    own = b"".join(message(2, message(1, bytes([j % 120, 0, 3])) + message(2, f"m/f{j}é().".encode()) + message(3, j % 2)) for j in range(n))
    return message(2, message(1, f"src/{k}.rs".encode()) + own)


def index(seed):
    """Documents of very different lengths, fields that are unknown in between, one document longer than what is read ahead."""
    r = random.Random(seed)
    parts = [message(1, b"metadata")]
    for k in range(r.randrange(1, 40)):
        parts.append(document(k, r.choice([0, 1, 3, 200, 5000 if k == 3 else 5])))
        parts += r.choice([[], [message(7, 5)], [message(3, b"symbols" * 40)], [bytes([9 << 3 | 1]) + b"12345678"]])
    return b"".join(parts)


def rows(frame):
    return Counter(tuple(r) for r in frame.select("file", "line", "symbol", "roles", "doc_idx", "occ_idx").collect())


@pytest.mark.parametrize("split", [1, 1000, 1 << 20])
def test_ranges_hold_every_document_once(tmp_path, split):
    for seed in range(8):
        data = index(seed)
        path = tmp_path / f"{split}-{seed}.scip"
        path.write_bytes(data)
        spans = scip_files.spans(str(path), split)
        assert [s.start for s in spans] == [0, *(s.end for s in spans[:-1])] and spans[-1].end == len(data)
        reader = scip_files.SymbolIndexReader(str(path), ".scip", split)
        found = [tuple(r.values())[1:] for s in spans for batch in reader.read(s) for r in batch.to_pylist()]
        assert found == list(scip.occurrences(data))


def test_a_folder_of_indexes(spark, tmp_path):
    texts = {f"a/{k}.scip": index(k) for k in range(4)} | {"cut.scip": index(5)[:-7], "empty.scip": b"", "other.txt": b"\x12\x7f"}
    for name, data in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    want = Counter(r for name, data in texts.items() if name.endswith(".scip") for r in scip.occurrences(data))
    for path in (str(tmp_path), f"file://{tmp_path}", f"file:{tmp_path}"):
        found = scip_files.read(spark, path, split=2000)
        assert rows(found) == want
    assert found.rdd.getNumPartitions() > 8  # each index is read by several tasks
    assert {r["index"].rsplit("/", 1)[1] for r in found.select("index").distinct().collect()} <= {"0.scip", "1.scip", "2.scip", "3.scip", "cut.scip"}


def test_a_tail_that_is_cut_off_ends_the_index(tmp_path):
    data = index(6) + document(90, 3) + document(91, 30)
    for cut in (1, 2, 5, 400):
        path = tmp_path / f"cut{cut}.scip"
        path.write_bytes(data[:-cut])
        spans = scip_files.spans(str(path), 500)
        reader = scip_files.SymbolIndexReader(str(path), ".scip", 500)
        found = [tuple(r.values())[1:] for s in spans for batch in reader.read(s) for r in batch.to_pylist()]
        whole = [r for r in scip.occurrences(data[: -len(document(91, 30))])]
        assert found == whole


def test_saved_indexes_come_back(spark, tmp_path):
    docs = [("x", [document(0, 3), document(1, 0), document(2, 9)]), ("y", [document(5, 1)]), ("none", [])]
    frame = spark.createDataFrame(docs, "name string, documents array<binary>")
    saved = {r.name: r.bytes for r in scip_files.save(frame, str(tmp_path / "out")).collect()}
    assert saved == {n: sum(map(len, d)) for n, d in docs}
    assert rows(scip_files.read(spark, str(tmp_path / "out"), split=1)) == Counter(r for _, d in docs for r in scip.occurrences(b"".join(d)))
    none = tmp_path / "none"
    none.mkdir()
    assert scip_files.read(spark, str(none)).count() == 0
