"""Packing into sequences by shortest-pack-first over the length histogram.

Documents are cut into full pieces of max_len tokens and one rest. The histogram of piece lengths
(at most max_len rows) goes to the driver, which places lengths longest first: each goes to the
pack that is shortest at that moment, if that has room, else to a new one; packs with the same
pattern are counted, not listed, and move together. Pieces are ranked within their length, and a rank says which sequence and offset of
which pattern a piece gets. Ranks come from counts of small groups, so a length that a third of
all pieces share is spread over many tasks.

Defined results. A null text is empty; an empty text is its end token alone. Repeated rows are
packed each. An empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import whole_text, written
from tidemark.llm.word_bpe import Encoder

MAX_LEN = 4096
#: Rows that one group of the ranking holds on average.
RANK_ROWS = 100_000


def pack_histogram(histogram: dict[int, int], max_len: int) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of every packing pattern, by shortest-pack-first.

    The same packs as if pieces were placed one at a time, longest first, each into the pack that
    is shortest at that moment if it has room, else into a new one; alike packs are moved together.
    """
    packs: dict[int, list[tuple[int, tuple | None]]] = defaultdict(list)  # by room left: count, (pattern before, length)
    rooms: list[int] = []  # heap, most room first

    def put(room: int, n: int, pattern: tuple) -> None:
        if not packs[room]:
            heappush(rooms, -room)
        packs[room].append((n, pattern))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not rooms or -rooms[0] < length:  # a new pack is the shortest until it has no room
                each = max_len // length
                for n, k in ((left // each, each), (1, left % each)):
                    if n and k:
                        pattern = None
                        for _ in range(k):
                            pattern = (pattern, length)
                        put(max_len - k * length, n, pattern)
                break
            room = -rooms[0]
            n, pattern = packs[room].pop()
            if not packs[room]:
                heappop(rooms)
            take = min(n, left)
            left -= take
            if n > take:
                put(room, n - take, pattern)
            put(room - length, take, (pattern, length))
    return [(n, _lengths(pattern)) for room in sorted(packs) for n, pattern in packs[room]]


def _lengths(pattern: tuple | None) -> tuple[int, ...]:
    out = []
    while pattern is not None:
        pattern, length = pattern
        out.append(length)
    return tuple(reversed(out))


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[list[int], list[int], list[int]]]:
    """For each length the first rank, first sequence and offset of each of its places in the patterns."""
    out: dict[int, tuple[list[int], list[int], list[int]]] = {}
    used: dict[int, int] = defaultdict(int)
    first = 0
    for n, pattern in patterns:
        offset = 0
        for length in pattern:
            ranks, sequences, offsets = out.setdefault(length, ([], [], []))
            ranks.append(used[length])
            sequences.append(first)
            offsets.append(offset)
            used[length] += n
            offset += length
        first += n
    return out


def pieces(docs: DataFrame, path: str, end_id: int, max_len: int = MAX_LEN) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece: full ones of max_len, then the rest."""
    rows = docs.select("doc_id", whole_text().alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.of(path)
        tail = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                at: list[int] = []
                out: list[tuple[int, int, int, int]] = []
                for k, blob in enumerate(enc.ids(part.column(1).to_pylist())):
                    blob += tail
                    total = len(blob) // 4
                    for start in range(0, total, max_len):
                        n = min(max_len, total - start)
                        at.append(k)
                        out.append((start, n, zlib.crc32(blob[4 * start : 4 * (start + n)]), total))
                cols = [pa.array(c, pa.int64()) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), *cols], names)

    return rows.mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def ranked(rows: DataFrame, rank_rows: int = RANK_ROWS) -> DataFrame:
    """rows with length_rank: 0, 1, ... within each length.

    A length is split into groups by a hash of its rows; ranks within a group are shifted by the
    counts of the groups before it, so no task ever holds a length.
    """
    from pyspark.sql import Window

    groups = max(16, rows.count() // rank_rows)
    own = rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", "start"), F.lit(groups)))
    counts = own.groupBy("length", "grp").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("length", "grp", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    order = Window.partitionBy("length", "grp").orderBy("doc_id", "start")
    own = own.withColumn("own_rank", F.row_number().over(order) - 1).join(shifts, ["length", "grp"])
    return own.withColumn("length_rank", F.col("own_rank") + F.col("shift")).drop("grp", "own_rank", "shift")


def pack(docs: DataFrame, path: str, end_id: int, max_len: int = MAX_LEN) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    found = written(pieces(docs, path, end_id, max_len), "pieces")
    names = found.columns
    counted = found.groupBy("length").count().collect()  # at most max_len rows
    places = spark.sparkContext.broadcast(slots(pack_histogram({r["length"]: r["count"] for r in counted}, max_len)))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = {k: tuple(np.array(x, dtype=np.int64) for x in v) for k, v in places.value.items()}
        for batch in batches:
            lengths = batch.column(batch.schema.get_field_index("length")).to_numpy()
            ranks = batch.column(batch.schema.get_field_index("length_rank")).to_numpy()
            sequence, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                first, sequences, offsets = arrays[int(length)]
                k = np.searchsorted(first, ranks[at], side="right") - 1
                sequence[at], offset[at] = sequences[k] + ranks[at] - first[k], offsets[k]
            keep = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema) + ", sequence_id long, offset long"
    return ranked(found).mapInArrow(place, schema)
