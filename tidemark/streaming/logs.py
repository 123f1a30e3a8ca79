"""Logs and traces that arrive in slices: the rows of the batch operators, with state kept from slice to slice.

A stream of slices (file, ordinal from 0, text, last) is keyed by file. State holds the number of
the slice that comes next, the line that is not finished yet, what the reader of the format carries
over, and slices that came early. The state of a file is read and written once for all that comes of
it together, and early slices are put into it only if they still wait then, or are too many to hold. Slices may come in any order and more than once; one that is
behind is dropped, one that is ahead waits for those before it. A file ends with the slice that says
so, or, with quiet, when nothing came for so long (in processing time) while no slice is missing.

A reader is fed whole lines and gives rows as soon as nothing that follows can change them. What it
carries is bounded by one unit of its format: the output of one spec, one record of a trace. State
lies in the state store, so a query that is started again goes on where it stopped.
"""

from __future__ import annotations

import json
import re
from collections.abc import Generator, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.sources import run_logs
from tidemark.storage import shared_path

SLICES = "file string, ordinal long, text string, last boolean"
#: Characters of the slices that slices_of cuts.
SLICE_CHARS = 4096
#: Characters of early slices that a task holds before it puts them into the state.
HELD_CHARS = 1 << 22
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FailedNames:
    """line_no, test: the numbered lines after the first one that says how many are failing."""

    columns = "line_no long, test string"
    _FAILING = re.compile(r"^\s*\d+\s+failing", re.ASCII)
    _NUMBERED = re.compile(r"^\s+\d+\)\s*(.*)$", re.ASCII)

    def feed(self, state: dict, text: str) -> Iterator[tuple]:
        for line in text.split("\n")[:-1]:
            state["no"] = state.get("no", 0) + 1
            if state.get("failing"):
                if (m := self._NUMBERED.match(line)) and (name := m[1].strip(" \t\n\x0b\f\r")):
                    yield state["no"], name
            elif self._FAILING.match(line):
                state["failing"] = True

    def end(self, state: dict) -> Iterator[tuple]:
        return iter(())


class Segments:
    """The spec segments of a run: each is given when the next one starts, the last one at the end."""

    columns = (
        "spec string, tests int, passing int, failing int, duration string, status string, request_ids array<string>,"
        " steps array<string>, messages array<string>, statuses array<string>, failed array<string>"
    )
    _START = re.compile(r"Running:\s+\S+\.cy\.js")
    _BEGUN = re.compile(r"Running:\s*$")

    def feed(self, state: dict, text: str) -> Iterator[tuple]:
        block = state.get("block", "") + text
        starts = [m.start() for m in self._START.finditer(block)]
        begun = self._BEGUN.search(block)
        kept = starts[-1] if starts else begun.start() if begun else len(block)
        yield from run_logs.segments(block[:kept])
        state["block"] = block[kept:]

    def end(self, state: dict) -> Iterator[tuple]:
        return run_logs.segments(state.pop("block", ""))


class Trace:
    """rec, source, pos, line, hits of an lcov trace, record by record; one row, without pos, where a record has no lines."""

    columns = "rec int, source string, pos int, line int, hits long"
    #: A stream's rows are records, which the JVM takes apart again.
    packed = "rec int, source string, lines array<int>, hits array<long>"
    _END, _SOURCE, _HITS = "end_of_record", re.compile(r"(?m)^SF:(.*)$"), re.compile(r"(?m)^DA:(\d+),(\d+)")

    @staticmethod
    def spread(found: DataFrame) -> DataFrame:
        """file and columns of packed rows."""
        at = F.posexplode_outer(F.arrays_zip("lines", "hits")).alias("pos", "h")
        return found.select("file", "rec", "source", at).select("file", "rec", "source", "pos", "h.lines", "h.hits").withColumnRenamed("lines", "line")

    def _record(self, state: dict, body: str) -> Iterator[tuple]:
        rec = state["rec"] = state.get("rec", -1) + 1
        source = (m := self._SOURCE.search(body)) and m[1].strip(" ")
        if source:
            found = self._HITS.findall(body)
            yield rec, source, [int(line) for line, _ in found], [int(hits) for _, hits in found]

    def feed(self, state: dict, text: str) -> Iterator[tuple]:
        *whole, state["body"] = (state.get("body", "") + text).split(self._END)
        for body in whole:
            yield from self._record(state, body)

    def end(self, state: dict) -> Iterator[tuple]:
        yield from self._record(state, state.pop("body", ""))


class SliceReader(StatefulProcessor):
    """Feeds a reader with the lines of one file, in order, however its slices come."""

    def __init__(self, reader, quiet_ms: int | None):
        self.reader, self.quiet_ms = reader, quiet_ms
        self.row = Row("file", *(c.strip().split(" ")[0] for c in packed_columns(reader).split(", ")))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "next long, carry string, state string, ended boolean, waiting long")
        self.early = handle.getMapState("early", "ordinal long", "text string, last boolean")

    def _end(self, carry: str, state: dict) -> Iterator[tuple]:
        # the last line may have no line end
        yield from self.reader.feed(state, carry + "\n")
        yield from self.reader.end(state)

    def _put(self, held: dict) -> int:
        """Puts held slices into the state; how many it didn't have."""
        fresh = 0
        for ordinal, slice_ in held.items():
            fresh += not self.early.containsKey((ordinal,))
            self.early.updateValue((ordinal,), slice_)
        held.clear()
        return fresh

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        next_, carry, state, ended, waiting = self.at.get() or (0, "", "{}", False, 0)
        # missing: the slice that is known to be in neither place
        held, chars, came, missing, state = {}, 0, False, None, json.loads(state)
        for r in rows:
            if ended or r.ordinal < next_:
                continue
            came = True
            if r.ordinal not in held:
                held[r.ordinal] = (r.text or "", bool(r.last))
                chars += len(r.text or "")
            texts = []
            while not ended:
                if next_ in held:
                    text, ended = held.pop(next_)
                    chars -= len(text)
                elif waiting and missing != next_ and self.early.containsKey((next_,)):
                    text, ended = self.early.getValue((next_,))
                    self.early.removeKey((next_,))
                    waiting -= 1
                else:
                    missing = next_
                    break
                texts.append(text)
                next_ += 1
                if sum(map(len, texts)) > HELD_CHARS:
                    carry = yield from self._fed(key, texts, carry, state)
            if texts:
                carry = yield from self._fed(key, texts, carry, state)
            if chars > HELD_CHARS:
                waiting, chars = waiting + self._put(held), 0
        if not came:
            return
        if ended:
            yield from (self.row(key[0], *r) for r in self._end(carry, state))
            if waiting:
                self.early.clear()
            carry, state, waiting = "", {}, 0
        else:
            waiting += self._put(held)
        self.at.update((next_, carry, json.dumps(state), ended, waiting))
        if self.quiet_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if not ended:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)

    def _fed(self, key: tuple, texts: list[str], carry: str, state: dict) -> Generator[Row, None, str]:
        """The rows of carry and texts; returns the line that isn't finished. texts are empty then."""
        whole, at, carry = (carry + "".join(texts)).rpartition("\n")
        texts.clear()
        if at:
            yield from (self.row(key[0], *r) for r in self.reader.feed(state, whole + at))
        return carry

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        next_, carry, state, ended, waiting = self.at.get()
        if ended or waiting:  # a file with a slice missing has not ended
            return
        yield from (self.row(key[0], *r) for r in self._end(carry, json.loads(state)))
        self.at.update((next_, "", "{}", True, 0))

    def close(self) -> None:
        pass


def packed_columns(reader) -> str:
    """The columns in which a reader's rows leave the stream's state."""
    return getattr(reader, "packed", reader.columns)


def read_slices(slices: DataFrame, reader, quiet_ms: int | None = None) -> DataFrame:
    """file and the reader's columns, of a stream of slices."""
    slices.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    found = slices.select("file", "ordinal", "text", "last").groupBy("file").transformWithState(
        statefulProcessor=SliceReader(reader, quiet_ms),
        outputStructType=f"file string, {packed_columns(reader)}",
        outputMode="Append",
        timeMode="None" if quiet_ms is None else "ProcessingTime",
    )
    return reader.spread(found) if hasattr(reader, "spread") else found


def slices_of(files: DataFrame, chars: int = SLICE_CHARS) -> DataFrame:
    """The slices of files (file, text)."""
    # a pattern goes through a text once; cuts by position would each count from its start
    cut = F.when(F.length("text") > 0, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chars}}}"), F.lit(0))).otherwise(F.array("text"))
    n = F.greatest(F.ceil(F.length("text") / chars), F.lit(1))
    rows = files.select("file", n.alias("n"), F.posexplode(cut).alias("ordinal", "text"))
    return rows.select("file", F.col("ordinal").cast("long").alias("ordinal"), "text", (F.col("ordinal") == F.col("n") - 1).alias("last"))


def run_to_end(spark: SparkSession, path: str, reader, checkpoint: str, out: str, per_batch: int = 4) -> DataFrame:
    """All that the slices in the Parquet files at path give by now, per_batch files at a time; goes on from checkpoint."""
    stream = spark.readStream.schema(SLICES).option("maxFilesPerTrigger", per_batch).parquet(path)
    query = read_slices(stream, reader).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(f"file string, {reader.columns}").parquet(out)


def read_files(files: DataFrame, reader, chars: int = SLICE_CHARS, parts: int = 8) -> DataFrame:
    """The rows of files (file, text), read as a stream: their slices lie in parts files at least, in no order, and come in two batches."""
    spark = files.sparkSession
    parts = max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    base = shared_path(spark, "slices")
    slices_of(files, chars).repartition(parts, F.xxhash64("file", "ordinal")).write.parquet(f"{base}/in")
    return run_to_end(spark, f"{base}/in", reader, f"{base}/state", f"{base}/out", per_batch=max(1, parts // 2))
