"""Symbol indexes: the public protobuf format of code indexes, decoded field by field.

Index.documents = 2; Document.relative_path = 1, occurrences = 2; Occurrence.range = 1 (packed),
symbol = 2, symbol_roles = 3. Unknown fields are skipped; a truncated tail ends the file.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The definition bit of symbol_roles.
DEFINITION = 1
#: Occurrences that one frame of the decoder holds.
PART_ROWS = 50_000


def _varint(data: memoryview, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        at += 1
        out |= (b & 127) << shift
        if b < 128:
            return out, at
        shift += 7


def fields(data: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """(number, value) of a message's fields; stops at a truncated one."""
    at = 0
    try:
        while at < len(data):
            key, at = _varint(data, at)
            kind = key & 7
            if kind == 0:
                value, at = _varint(data, at)
            elif kind == 2:
                n, at = _varint(data, at)
                if at + n > len(data):
                    return
                value, at = data[at : at + n], at + n
            elif kind in (1, 5):
                n = 8 if kind == 1 else 4
                value, at = data[at : at + n], at + n
            else:
                return
            yield key >> 3, value
    except IndexError:
        return


def document_rows(doc: memoryview, doc_idx: int) -> Iterator[tuple]:
    """(file, line from 1, symbol, roles, doc_idx, occ_idx) of every occurrence of a document."""
    path, found = "", []
    for n, value in fields(doc):
        if n == 1:
            path = bytes(value).decode()
        elif n == 2:
            own = dict(fields(value))
            line = _varint(own[1], 0)[0] if len(own.get(1, b"")) else 0
            found.append((line + 1, bytes(own.get(2, b"")).decode(), own.get(3, 0)))
    for k, (line, symbol, roles) in enumerate(found):
        yield path, line, symbol, roles, doc_idx, k


def occurrences(content: bytes) -> Iterator[tuple]:
    """The rows of every document of an index."""
    docs = (doc for number, doc in fields(memoryview(content)) if number == 2)
    for doc_idx, doc in enumerate(docs):
        yield from document_rows(doc, doc_idx)


def decoded(indexes: DataFrame) -> DataFrame:
    """file, line, symbol, roles, doc_idx, occ_idx of indexes that rows hold (content); those in files are read by read()."""

    def run(batches):
        for batch in batches:
            for content in batch["content"]:
                rows = occurrences(content)
                while part := list(islice(rows, PART_ROWS)):
                    yield pd.DataFrame(part, columns=["file", "line", "symbol", "roles", "doc_idx", "occ_idx"])

    return indexes.select("content").mapInPandas(run, "file string, line int, symbol string, roles int, doc_idx int, occ_idx int")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The occurrences of the index at path, or of all in that folder, in byte ranges."""
    from tidemark.sources import scip_files

    return scip_files.read(spark, path).drop("index")


def call_graph(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(functions, call sites) of occurrences: functions are symbols that end with '().', without local ones."""
    from tidemark.operators.graph import display_name, enclosing, first_definitions

    calls = found.where(~F.startswith("symbol", F.lit("local ")) & F.endswith("symbol", F.lit(").")))
    defs = calls.where(F.col("roles").bitwiseAND(F.lit(DEFINITION)) == DEFINITION)
    nodes = first_definitions(defs).select("symbol", display_name(F.col("symbol")).alias("name"), "file", F.col("line").alias("def_line"))
    refs = calls.where(F.col("roles").bitwiseAND(F.lit(DEFINITION)) == 0).select("file", "line", F.col("symbol").alias("callee"))
    own = defs.select("file", F.col("line").alias("def_line"), "symbol")
    sites = enclosing(own, refs).where("def_symbol IS NOT NULL").select(F.col("def_symbol").alias("caller"), "callee", "file", "line")
    return nodes, sites
