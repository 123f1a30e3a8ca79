"""Logs that come in slices, in any order and over restarts, against the batch operators on whole files."""

import random
import time
from collections import Counter
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidemark.operators import report
from tidemark.sources import coverage_files, files, run_logs
from tidemark.streaming import logs


def run_text(k):
    r = random.Random(k)
    out = ["started", "  1) not a failure yet"]
    for j in range(r.randrange(5)):
        n = r.randrange(4)
        out += [f"  Running:{r.choice([' ', '  ', chr(10)])}spec{k}_{j}.cy.js", "STEP: pay", "\x1b[32mSTEP: wait\x1b[0m", f" x-request-id -> id-{j}", '{"message": "no é"}']
        out += r.choice([["  (Results)", f" │ Tests:  {n} │", f" │ Passing:  {n or '-'} │", " │ Duration:  3 seconds │"], ["  crashed"]])
        out += r.choice([["  2 failing", "", f"  1) pays {j}", "     refuses:", f"  2)  is é {j}  ", "  3) "], []])
    return "\n".join(out) + r.choice(["", "\n", "\n\n"])


def trace_text(k):
    r = random.Random(100 + k)
    out = []
    for j in range(r.randrange(4)):
        out += ["TN:", f"SF:/src/f{r.randrange(3)}.rs ", *(f"DA:{r.randrange(9)},{r.randrange(5)}" for _ in range(r.randrange(6))), "LF:1", "end_of_record"]
    if k % 4 == 0:
        out += ["SF:cut.rs", "DA:1,1"]  # a trace that was cut off
    return "\n".join(out) + r.choice(["", "\n"])


def batch_rows(spark, reader, texts):
    frame = spark.createDataFrame(texts, "file string, text string")
    if isinstance(reader, logs.FailedNames):
        found = report.failed_names(files.lines(frame).withColumnRenamed("file", "file_id"))
        return Counter((r.file_id, r.line_no, r.test) for r in found.collect())
    if isinstance(reader, logs.Segments):
        return Counter(str((f, *row)) for f, t in texts for row in run_logs.segments(t))
    return Counter(tuple(r) for r in coverage_files.lcov_lines(frame).select("file", "rec", "source", "pos", "line", "hits").collect())


def stream_rows(reader, frame):
    rows = [tuple(r) for r in frame.collect()]
    return Counter(map(str, rows)) if isinstance(reader, logs.Segments) else Counter(rows)


READERS = [(logs.FailedNames(), run_text), (logs.Segments(), run_text), (logs.Trace(), trace_text)]


@pytest.mark.parametrize("reader,text", READERS, ids=["failed names", "segments", "traces"])
def test_slices_over_a_restart(spark, tmp_path, reader, text):
    texts = [(f"f{k}", text(k)) for k in range(30)] + [("empty", "")]
    slices = logs.slices_of(spark.createDataFrame(texts, "file string, text string"), 7).withColumn("part", F.pmod(F.xxhash64("file", "ordinal"), F.lit(5)))
    source, state, out = (str(tmp_path / x) for x in ("in", "state", "out"))
    slices.where("part < 2").drop("part").write.parquet(source)
    first = stream_rows(reader, logs.run_to_end(spark, source, reader, state, out, 2))
    # a second run, after the first has ended, gets the rest, and some slices a second time
    slices.where("part >= 1").drop("part").write.mode("append").parquet(source)
    found = stream_rows(reader, logs.run_to_end(spark, source, reader, state, out, 2))
    want = batch_rows(spark, reader, texts)
    assert found == want and sum(first.values()) < sum(want.values())


@pytest.mark.parametrize("reader,text", READERS, ids=["failed names", "segments", "traces"])
@pytest.mark.parametrize("size", [1, 3, 50])
def test_readers_give_the_same_rows_however_lines_come(reader, text, size):
    for k in range(40):
        own = text(k)
        state, found, lines = {}, [], (own + "\n").splitlines(keepends=True) if "\r" not in own else []
        for lo in range(0, len(lines), size):
            found += reader.feed(state, "".join(lines[lo : lo + size]))
        found += reader.end(state)
        whole = {}
        assert found == [*reader.feed(whole, own + "\n"), *reader.end(whole)]


def test_a_quiet_file_ends(spark, tmp_path):
    """Without a last slice the rest comes when nothing was heard for a while, but not while a slice is missing."""
    text = "  1 failing\n  1) first\n  2) second"
    rows = [("a", 0, text[:20], False), ("a", 1, text[20:], False), ("b", 0, text[:20], False), ("b", 2, "never", False)]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, logs.SLICES).write.parquet(source)
    stream = spark.readStream.schema(logs.SLICES).parquet(source)
    frame = logs.read_slices(stream, logs.FailedNames(), quiet_ms=1500)
    query = frame.writeStream.format("memory").queryName("quiet").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="500 milliseconds").start()
    try:
        stop = time.time() + 90
        while spark.table("quiet").count() < 2 and time.time() < stop:
            time.sleep(1)
        assert sorted((r.file, r.line_no, r.test) for r in spark.table("quiet").collect()) == [("a", 2, "first"), ("a", 3, "second")]
    finally:
        query.stop()


def test_slices_by_one_pass(spark):
    texts = [("a", "x\né\U0001f600y\r\nz" * 5), ("b", ""), ("c", None), ("d", "1234567"), ("e", "12345678")]
    found = logs.slices_of(spark.createDataFrame(texts, "file string, text string"), 7)
    assert "substring" not in found._jdf.queryExecution().optimizedPlan().toString()
    rows = sorted(map(tuple, found.collect()))
    cuts = {f: [t[k : k + 7] for k in range(0, len(t), 7)] if t else [t] for f, t in texts}
    assert rows == sorted((f, k, x, k == len(c) - 1) for f, c in cuts.items() for k, x in enumerate(c))


class _State(dict):
    """A state variable that counts what is asked of it."""

    calls = 0

    def get(self, key=()):
        self.calls += 1
        return dict.get(self, key)

    getValue = get

    def update(self, value):
        self.calls += 1
        self[()] = value

    def containsKey(self, key):
        self.calls += 1
        return key in self

    def updateValue(self, key, value):
        self.calls += 1
        self[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self[key]


def test_state_is_asked_twice_a_batch(spark):
    text = trace_text(3) * 4
    slices = [(k, text[k * 5 : k * 5 + 5]) for k in range(-(-len(text) // 5))]
    reader = logs.SliceReader(logs.Trace(), None)
    reader.at, reader.early = _State(), _State()
    rows = [SimpleNamespace(ordinal=k, text=t, last=k == len(slices) - 1) for k, t in slices]
    random.Random(1).shuffle(rows)
    found = list(reader.handleInputRows(("f",), iter(rows), None))
    assert [tuple(r)[1:] for r in found] == list(logs.Trace().feed({}, text + "\n"))
    assert reader.at.calls == 2 and reader.early.calls == 0


def test_early_slices_beyond_what_is_held(spark, monkeypatch):
    monkeypatch.setattr(logs, "HELD_CHARS", 12)
    text = trace_text(3) * 4
    slices = [SimpleNamespace(ordinal=k, text=text[k * 5 : k * 5 + 5], last=k * 5 + 5 >= len(text)) for k in range(-(-len(text) // 5))]
    reader = logs.SliceReader(logs.Trace(), None)
    reader.at, reader.early = _State(), _State()
    rows = slices[1:] + slices[4:9]
    random.Random(2).shuffle(rows)
    assert list(reader.handleInputRows(("f",), iter(rows), None)) == [] and len(reader.early) == len(slices) - 1
    found = list(reader.handleInputRows(("f",), iter(slices[:1]), None))
    assert [tuple(r)[1:] for r in found] == list(logs.Trace().feed({}, text + "\n")) and not reader.early
