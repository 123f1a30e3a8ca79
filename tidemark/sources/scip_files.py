"""Symbol indexes in files as a data source whose partitions are byte ranges: spark.read.format("symbol_index").

An index is a sequence of messages, each with its length before it. The driver hops from length to
length and reads no document; runs of whole documents of about splitBytes each are the partitions.
A task opens the file where its range begins and reads one document after the other, so neither a
task nor a row ever holds an index. A document that is cut off ends its index.

Options: the path of a file or a folder (any file system that pyarrow opens: local, HDFS, S3, ...),
suffix of the files in a folder (.scip), splitBytes (4 MB).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.sources.scip import PART_ROWS, document_rows

SCHEMA = "index string, file string, line int, symbol string, roles int, doc_idx int, occ_idx int"
_ARROW = pa.schema([(c.split()[0], {"string": pa.string(), "int": pa.int32()}[c.split()[1]]) for c in SCHEMA.split(", ")])
SPLIT_BYTES = 4 << 20
#: What is read to find a message's number and length; documents shorter than this are seen in passing.
_PEEK = 1 << 16
#: Files whose lengths are followed at a time.
_THREADS = 16


@dataclass
class Span(InputPartition):
    """Whole messages of a file; the first document among them has the number doc_idx in its index."""

    path: str
    start: int
    end: int
    doc_idx: int


def _uri(path: str) -> str:
    """A path as pyarrow wants it: Hadoop also writes file:/x for file:///x."""
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


class _Window:
    """A file's bytes by position, read _PEEK at a time."""

    def __init__(self, source, size: int):
        self.source, self.size, self.at, self.data = source, size, 0, b""

    def byte(self, k: int) -> int:
        if not self.at <= k < self.at + len(self.data):
            if k >= self.size:
                raise IndexError
            self.source.seek(k)
            self.at, self.data = k, self.source.read(_PEEK)
            if not self.data:
                raise IndexError
        return self.data[k - self.at]

    def varint(self, at: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            b = self.byte(at)
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out, at
            shift += 7


def messages(source, start: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(number, start, start of its content, end) of the messages in a range of a file; stops at one that is cut off."""
    window, at = _Window(source, end), start
    try:
        while at < end:
            key, body = window.varint(at)
            kind = key & 7
            if kind == 0:
                _, stop = window.varint(body)
            elif kind == 2:
                n, body = window.varint(body)
                stop = body + n
            elif kind in (1, 5):
                stop = body + (8 if kind == 1 else 4)
            else:
                return
            if stop > end:
                return
            yield key >> 3, at, body, stop
            at = stop
    except IndexError:
        return


def spans(path: str, split: int) -> list[Span]:
    """Runs of whole messages of an index, of about split bytes each."""
    system, inner = fs.FileSystem.from_uri(path)
    out, doc_idx, first, start, end = [], 0, 0, 0, 0
    with system.open_input_file(inner) as source:
        for number, _, _, stop in messages(source, 0, source.size()):
            end = stop
            doc_idx += number == 2
            if end - start >= split:
                out.append(Span(path, start, end, first))
                start, first = end, doc_idx
    return [*out, Span(path, start, end, first)] if end > start else out


class SymbolIndexReader(DataSourceReader):
    def __init__(self, path: str, suffix: str, split: int):
        self.path, self.suffix, self.split = path, suffix, split

    def partitions(self) -> list[InputPartition]:
        base = _uri(self.path)
        system, inner = fs.FileSystem.from_uri(base)
        head = base[: len(base) - len(inner)]
        if system.get_file_info(inner).type == fs.FileType.File:
            found = [inner]
        else:
            every = system.get_file_info(fs.FileSelector(inner, recursive=True))
            found = sorted(f.path for f in every if f.type == fs.FileType.File and f.path.endswith(self.suffix))
        with ThreadPoolExecutor(_THREADS) as pool:
            return [s for own in pool.map(lambda f: spans(head + f, self.split), found) for s in own]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        if span is None:  # Spark asks so where there is no partition
            return
        system, inner = fs.FileSystem.from_uri(span.path)
        with system.open_input_file(inner) as source:
            rows = self._rows(source, span)
            while part := list(islice(rows, PART_ROWS)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), _ARROW.types)], schema=_ARROW)

    def _rows(self, source, span: Span) -> Iterator[tuple]:
        doc_idx = span.doc_idx
        for number, _, body, stop in messages(source, span.start, span.end):
            if number == 2:
                source.seek(body)
                for row in document_rows(memoryview(source.read(stop - body)), doc_idx):
                    yield (span.path, *row)
                doc_idx += 1


class SymbolIndexSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "symbol_index"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return SymbolIndexReader(self.options["path"], self.options.get("suffix", ".scip"), int(self.options.get("splitbytes", SPLIT_BYTES)))


def read(spark: SparkSession, path: str, split: int = SPLIT_BYTES, suffix: str = ".scip") -> DataFrame:
    """The occurrences of the index at path, or of all indexes in that folder; index says which."""
    spark.dataSource.register(SymbolIndexSource)
    return spark.read.format("symbol_index").option("splitBytes", split).option("suffix", suffix).load(path)


def save(indexes: DataFrame, folder: str) -> DataFrame:
    """Writes indexes (name, documents: their encoded documents in order) as files of folder; name, bytes of each.

    A file appears whole or not at all, under its last name, so a task that runs again does no harm.
    """

    def write(batches):
        system, inner = fs.FileSystem.from_uri(_uri(folder))
        system.create_dir(inner, recursive=True)
        for batch in batches:
            sizes = []
            for name, documents in zip(batch["name"], batch["documents"]):
                fresh = f"{inner}/{name}.{uuid.uuid4().hex}.part"
                with system.open_output_stream(fresh) as out:
                    sizes.append(sum(out.write(bytes(d)) for d in documents))
                system.move(fresh, f"{inner}/{name}.scip")
            yield pd.DataFrame({"name": batch["name"], "bytes": sizes})

    return indexes.select("name", "documents").mapInPandas(write, "name string, bytes long")
