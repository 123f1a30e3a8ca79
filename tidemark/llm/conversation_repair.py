r"""Conversation structure repair: a forward Viterbi search over four grammar states.

The roles of a repaired conversation, by their initials, read (s?(ua)+)?. The states are START
(nothing yet), SYSTEM, USER and ASSISTANT (after such a row). Each row is kept (0), given the role
user or assistant (3) or deleted (4); rows with the role user or assistant and no text can be
inserted anywhere (3 each). Blank rows and repeats must be deleted, and a truncated row that stays
costs 3 more. For each state the search carries the least (cost, audit), where the audit is the
edits' initials so far; after each row the layer is closed with at most three rounds of inserts.
Two audits of equal cost at one state never begin one another, as the longer one would have cost
more, so the order of the smaller of them holds whatever is appended.

A conversation may hold any share of all rows. Rows are sorted by conversation and turn over all
tasks and numbered in that order; a conversation is cut into segments of neighbouring numbers. The
search over a segment from each of the four states gives a four by four matrix of (cost, audit),
and the matrices of a conversation are multiplied, FAN segments at a time and in as many rounds as
that takes. The audit is then cut up again along the segments, so its edits meet their rows there.
All that Python sees of a row is one letter: its role's initial and its fault; equal segments of
a batch are searched once.

Defined results. Null roles and texts are one space. Rows are taken by turn, null turns first; rows
of one turn by role and text (the first 32 characters, then a hash). A role counts by its first
letter, so one that begins with s is a system row; other roles can only be given a new one or be
deleted. A null conv_id is a conversation. A conversation of which no row is left has no faults, no
cost and no edits. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, stable, written

#: Numbers that one segment spans at most, and segments that are put together at a time.
SEGMENT, FAN = 1024, 64

START, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT = "KRDI"
RENAME_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
#: A row as the search sees it: its role's initial, in upper case if it is truncated, or MUST if it must go.
MUST, OTHER = "-", "o"

#: For every state what a user or assistant row leads to.
_NEXT = ((START, "u", USER), (SYSTEM, "u", USER), (ASSISTANT, "u", USER), (USER, "a", ASSISTANT))
_BLANKS = " \t\n\x0b\f\r"

Layer = list[tuple[int, str] | None]


def _closed(layer: Layer) -> Layer:
    """A layer with what inserts reach: at most three of them lead from any state to any other."""
    for _ in range(3):
        for source, _, target in _NEXT:
            if layer[source] is not None:
                cost, audit = layer[source]
                new = (cost + INSERT_COST, audit + INSERT)
                if layer[target] is None or new < layer[target]:
                    layer[target] = new
    return layer


def _step(layer: Layer, symbol: str) -> Layer:
    """The layer after one more row."""
    out: Layer = [None] * 4

    def reach(target: int, cost: int, audit: str) -> None:
        if out[target] is None or (cost, audit) < out[target]:
            out[target] = (cost, audit)

    own, extra = symbol.lower(), TRUNCATED_COST if symbol.isupper() else 0
    for state, best in enumerate(layer):
        if best is None:
            continue
        cost, audit = best
        reach(state, cost + DELETE_COST, audit + DELETE)
        if symbol == MUST:
            continue
        if own == "s" and state == START:
            reach(SYSTEM, cost + extra, audit + KEEP)
        for source, initial, target in _NEXT:
            if source == state:
                if own == initial:
                    reach(target, cost + extra, audit + KEEP)
                reach(target, cost + RENAME_COST + extra, audit + REROLE)
    return _closed(out)


@lru_cache(maxsize=4096)
def segment_matrix(symbols: str) -> tuple[tuple[tuple[int, str] | None, ...], ...]:
    """From each state the least (cost, audit) to each state, over the rows of a segment."""
    out = []
    for state in range(4):
        layer: Layer = [None] * 4
        layer[state] = (0, "")
        for symbol in symbols:
            layer = _step(layer, symbol)
        out.append(tuple(layer))
    return tuple(out)


def product(a, b) -> list[list[tuple[int, str] | None]]:
    """The matrix of two segments in a row."""
    out = []
    for row in a:
        ends: Layer = [None] * 4
        for middle, best in enumerate(row):
            if best is None:
                continue
            for end, more in enumerate(b[middle]):
                if more is not None:
                    new = (best[0] + more[0], best[1] + more[1])
                    if ends[end] is None or new < ends[end]:
                        ends[end] = new
        out.append(ends)
    return out


def cheapest(matrix) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    # inserts before the first row come first; afterwards every layer is closed
    start = product([_closed([(0, ""), None, None, None])], matrix)[0]
    return min(x for x in (start[START], start[ASSISTANT]) if x is not None)


_MATRIX = "costs array<long>, audits array<string>"


def _flat(matrix) -> tuple[list, list]:
    cells = [c for row in matrix for c in row]
    return [None if c is None else c[0] for c in cells], [None if c is None else c[1] for c in cells]


def _square(costs, audits):
    cells = [None if a is None else (int(c), a) for c, a in zip(costs, audits)]
    return [cells[4 * k : 4 * k + 4] for k in range(4)]


def _matrices(segments: DataFrame) -> DataFrame:
    """conv, at, costs, audits of segments (conv, at, symbols)."""

    def find(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            flat = [_flat(segment_matrix(s)) for s in batch["symbols"]]
            yield pd.DataFrame({"conv": batch["conv"], "at": batch["at"], "costs": [c for c, _ in flat], "audits": [a for _, a in flat]})
        segment_matrix.cache_clear()

    return segments.select("conv", "at", "symbols").mapInPandas(find, f"conv string, at long, {_MATRIX}")


def _together(matrices: DataFrame) -> DataFrame:
    """FAN neighbouring matrices of a conversation as one: at is divided by FAN."""
    cell = F.struct("at", "costs", "audits")
    rows = matrices.groupBy("conv", F.expr(f"at div {FAN}").alias("up")).agg(F.sort_array(F.collect_list(cell)).alias("parts"))

    def find(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            flat = []
            for parts in batch["parts"]:
                whole = None
                for p in parts:
                    own = _square(p["costs"], p["audits"])
                    whole = own if whole is None else product(whole, own)
                flat.append(_flat(whole))
            yield pd.DataFrame({"conv": batch["conv"], "at": batch["up"], "costs": [c for c, _ in flat], "audits": [a for _, a in flat]})

    return rows.mapInPandas(find, f"conv string, at long, {_MATRIX}")


def _cheapest(matrices: DataFrame) -> DataFrame:
    """conv, cost, audit of conversations that are one matrix."""

    def find(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            best = [cheapest(_square(c, a)) for c, a in zip(batch["costs"], batch["audits"])]
            yield pd.DataFrame({"conv": batch["conv"], "cost": [c for c, _ in best], "audit": [a for _, a in best]})

    return matrices.select("conv", "costs", "audits").mapInPandas(find, "conv string, cost long, audit string")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults put in, by crc32 of conv_id:turn modulo 20.

    0 drops the row, 1 empties its text, 2 takes its full stops, question and exclamation marks
    away, 3 gives it twice, 4 makes its role user. A null in the key, as in role and text, is one space.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20).cast("int")
    rows = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("__kind")).where("__kind <> 0")
    kind = F.col("__kind")
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("__copy")).drop("__copy")


def numbered(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as conv (a key that is never null), no, turn, role, text.

    no goes up with conversation and turn over all rows.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"))
    # equal rows are told apart by a number, so that they do not pile up in one task
    rows = stable(rows, "turns").withColumn("__salt", F.monotonically_increasing_id())
    conv = F.when(F.col("conv_id").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
    rows = rows.withColumn("conv", conv).withColumn("__head", F.left("text", F.lit(32))).withColumn("__hash", F.unhex(F.sha2("text", 256)))
    order = ["conv", F.asc_nulls_first("turn"), "role", "__head", "__hash", "__salt"]
    rows = rows.drop("conv_id").repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.withColumn("no", F.monotonically_increasing_id())
    return written(rows.select("conv", "no", "turn", "role", "text"), "numbered-turns")


def with_faults(rows: DataFrame) -> DataFrame:
    """conv, no, turn, role, fault (blank, duplicate, truncated or null) of numbered rows."""
    end = F.rtrim("text", F.lit(_BLANKS))
    own = F.when(end == "", "blank").when(~F.right(end, F.lit(1)).isin(".", "!", "?"), "truncated")
    thin = rows.select("conv", "no", "turn", "role", own.alias("own"))
    first = rows.groupBy("conv", "role", F.unhex(F.sha2("text", 256)).alias("hash")).agg(F.min("no").alias("first")).select("first")
    fault = F.when((F.col("own").eqNullSafe("blank")) | F.col("first").isNotNull(), F.col("own")).otherwise("duplicate")
    found = thin.join(first, F.col("no") == F.col("first"), "left").withColumn("fault", fault)
    return written(found.select("conv", "no", "turn", "role", "fault"), "turns-with-faults")


def _symbol() -> Column:
    initial = F.left("role", F.lit(1))
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise(OTHER)
    return F.when(F.col("fault").isin("blank", "duplicate"), MUST).when(F.col("fault") == "truncated", F.upper(initial)).otherwise(initial)


def _segments(rows: DataFrame) -> DataFrame:
    """conv, segment, at (its place in the conversation), nos, symbols: at most SEGMENT rows each."""
    cell = F.sort_array(F.collect_list(F.struct("no", _symbol().alias("symbol"))))
    found = rows.groupBy("conv", F.shiftright("no", SEGMENT.bit_length() - 1).alias("segment")).agg(cell.alias("cells"))
    found = found.select("conv", "segment", F.col("cells.no").alias("nos"), F.array_join("cells.symbol", "").alias("symbols"))
    found = written(found, "conversation-segments")
    # places among a conversation's segments: their numbers alone, which are one in SEGMENT rows
    places = found.groupBy("conv").agg(F.sort_array(F.collect_list("segment")).alias("all")).where("size(all) > 1")
    places = places.select(F.col("conv").alias("c"), F.posexplode("all").alias("place", "s"))
    found = found.join(places, (F.col("conv") == F.col("c")) & (F.col("segment") == F.col("s")), "left")
    return written(found.select("conv", F.coalesce("place", F.lit(0)).cast("long").alias("at"), "nos", "symbols"), "segments")


def _audits(segments: DataFrame) -> DataFrame:
    """conv, cost, audit of every conversation that has rows."""
    matrices = written(_matrices(segments), "segment-matrices")
    most = segments.agg(F.max("at")).first()[0] or 0
    while most > 0:
        before, matrices = matrices, written(_together(matrices), "segment-matrices")
        discard(before)
        most //= FAN
    return written(_cheapest(matrices), "audits")


def _edits(segments: DataFrame, audits: DataFrame) -> DataFrame:
    """conv, place, no (null if inserted), edit, role (null where the row keeps its own): one row for each letter of the audits."""
    # each segment's share of the audit: as many letters as it has rows, without those of inserts
    cut = segments.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("at", F.size("nos").alias("n")))).alias("sizes"))
    cut = cut.join(audits, "conv")

    def pieces(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: dict[str, list] = {"conv": [], "at": [], "piece": [], "before": [], "kept": [], "odd": []}
            for conv, sizes, audit in zip(batch["conv"], batch["sizes"], batch["audit"]):
                odd = (len(audit) - audit.count(DELETE)) % 2
                lo = before = kept = 0
                for k, s in enumerate(sizes):
                    hi, left = lo, s["n"]
                    while left:
                        left -= audit[hi] != INSERT
                        hi += 1
                    hi = len(audit) if k == len(sizes) - 1 else hi
                    piece = audit[lo:hi]
                    for c, v in zip(out, (conv, s["at"], piece, before, kept, odd)):
                        out[c].append(v)
                    lo, before, kept = hi, before + len(piece), kept + len(piece) - piece.count(DELETE)
            yield pd.DataFrame(out)

    cut = cut.select("conv", "sizes", "audit").mapInPandas(pieces, "conv string, at long, piece string, before long, kept long, odd int")
    # which row a letter is about, and its place among the rows that stay, count letters within the piece
    upto = F.substring("piece", F.lit(1), F.col("k"))
    count = lambda x, letter: F.length(x) - F.length(F.replace(x, F.lit(letter), F.lit("")))
    letters = segments.select("conv", "at", "nos").join(cut, ["conv", "at"])
    letters = letters.select("conv", "nos", "piece", "before", "kept", "odd", F.posexplode(F.split("piece", "")).alias("k", "edit"))
    letters = letters.where("edit <> ''")
    no = F.when(F.col("edit") != INSERT, F.get("nos", F.col("k") - count(upto, INSERT)))
    among = F.col("kept") + F.col("k") - count(upto, DELETE)
    # roles alternate after a system row, which there is if an odd number of rows stays
    role = F.when(F.pmod(among - F.col("odd"), F.lit(2)) == 0, "user").otherwise("assistant")
    role = F.when(F.col("edit").isin(REROLE, INSERT), role)
    return letters.select("conv", (F.col("before") + F.col("k")).alias("place"), no.alias("no"), "edit", role.alias("new_role"))


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is wrong with conversations, and their repaired rows, of rows (conv_id, turn, role, text).

    First: conv_id, gaps (turns missing between the least and the largest), blank, duplicate,
    truncated (rows by their first fault), illegal (neighbours whose roles may not follow each
    other), cost, audit. Second: conv_id, place (from 0, deleted rows count), edit, turn (null if
    inserted), role, text; deleted rows are left out.
    """
    texts = numbered(rows)
    turns = with_faults(texts)
    segments = _segments(turns)
    audits = _audits(segments)

    # neighbours: within a segment side by side in its symbols, across segments the last and the first
    initial = F.left("role", F.lit(1))
    seen = turns.select("conv", "no", F.when(initial.isin("s", "u", "a"), initial).otherwise(OTHER).alias("initial"))
    seen = seen.groupBy("conv", F.shiftright("no", SEGMENT.bit_length() - 1).alias("segment"))
    seen = seen.agg(F.array_join(F.sort_array(F.collect_list(F.struct("no", "initial")))["initial"], "").alias("initials"))
    size = F.length("initials")
    legal = F.size(F.filter(F.sequence(F.lit(1), size), lambda k: F.substring("initials", k, F.lit(2)).isin("su", "ua", "au")))
    seen = seen.select("conv", "segment", (size - 1 - legal).alias("bad"), F.left("initials", F.lit(1)).alias("a"), F.right("initials", F.lit(1)).alias("z"))
    joints = F.sort_array(F.collect_list(F.struct("segment", "a", "z")))
    seen = seen.groupBy("conv").agg(F.sum("bad").alias("bad"), joints.alias("joints"))
    across = F.transform("joints", lambda x, i: (i > 0) & ~F.concat(F.get("joints", i - 1)["z"], x["a"]).isin("su", "ua", "au"))
    illegal = seen.select(F.col("conv").alias("c"), (F.col("bad") + F.size(F.filter(across, lambda x: x))).cast("long").alias("illegal"))

    distinct = turns.where("turn IS NOT NULL").groupBy("conv", "turn").agg(F.lit(1).alias("one"))
    distinct = distinct.groupBy("conv").agg(F.count(F.lit(1)).alias("distinct_turns"), F.min("turn").alias("low"), F.max("turn").alias("high"))
    span = (F.col("high") - F.col("low") + 1 - F.col("distinct_turns")).cast("long")
    gaps = distinct.select(F.col("conv").alias("c"), span.alias("gaps"))
    faults = [F.count_if(F.col("fault").eqNullSafe(k)).alias(k) for k in ("blank", "duplicate", "truncated")]
    found = turns.groupBy("conv").agg(*faults).join(audits, "conv")
    for more in (gaps, illegal):
        found = found.join(more, F.col("conv") == F.col("c"), "left").drop("c")
    key = F.when(F.col("conv") != "", F.substring("conv", F.lit(2), F.length("conv")).cast(rows.schema["conv_id"].dataType)).alias("conv_id")
    names = [key, F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

    edits = _edits(segments, audits).where(F.col("edit") != DELETE)
    own = texts.select(F.col("no").alias("row"), "turn", "role", "text")
    fixed = edits.join(own, F.col("no") == F.col("row"), "left")
    text = F.when(F.col("edit") == INSERT, F.lit("")).otherwise(F.col("text"))
    fixed = fixed.select(key, "place", "edit", "turn", F.coalesce("new_role", "role").alias("role"), text.alias("text"))
    return found.select(*names), fixed
