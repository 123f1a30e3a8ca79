"""Encoding and decoding with a word-level BPE, by tree concatenation for long texts.

Texts up to LEAF characters are encoded by their executor as they are. Longer ones are cut into
leaves that other executors encode in parallel: at white space where the text has some, and inside
a pre-token where it runs on without. Leaves of one pre-token are joined pairwise as a tree: a
growing window around each join is encoded again until its first token is the one the left side
had there and its last token the one the right side had. Every adjacent pair of tokens is then a
pair of some valid encoding, and a BPE sequence whose adjacent pairs are all valid is the encoding
of the whole, so the result is exactly the library's.

Within a leaf, ids are found once per distinct white-space-free chunk (and, of those, once per
distinct pre-token) and looked up after that: white space never reaches a token here, so the ids
of a text are those of its chunks in order.

Defined results. A null text is empty and has no ids. Repeated rows give repeated results. Other
columns are ignored. Special strings inside a text become their own ids, as the library does by
default.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from tidemark.llm.common import keeps, make_room, stable, whole_text

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks already use every core

#: Characters of a leaf. Only the split of work depends on it, never the ids.
LEAF = 16_384
#: Distinct chunks a worker keeps; beyond that, new ones are encoded each time they come.
CACHE_ENTRIES = 320_000
#: Distinct pre-tokens it keeps besides: they matter only where a chunk is new.
WORD_ENTRIES = 100_000
CACHE_CHARS = 48
SLICE_ROWS = 256
#: Control characters that Python splits at and the tokenizer doesn't.
_ODD_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")
SUFFIX = "</w>"
#: Chunks of these characters are already normal but for case, and split by the pattern below.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
# The tokenizer's pre-token pattern over those characters, and the byte-level alphabet.
_PRE_TOKEN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
_BYTE_LEVEL = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b < 127 or 161 <= b < 173 or b >= 174))}


class _Words(dict):
    """Ids of pre-tokens (lower-case), by the model alone, kept up to a bound."""

    def __init__(self, model):
        self.tokenize = model.tokenize

    def __missing__(self, word: str) -> bytes:
        mapped = word if word.isascii() else word.encode().decode("latin1").translate(_BYTE_LEVEL)
        out = np.array([t.id for t in self.tokenize(mapped)], dtype="<u4").tobytes()
        if len(self) < WORD_ENTRIES and len(word) <= CACHE_CHARS:
            self[word] = out
        return out


class _Chunks(dict):
    """Ids of white-space-free chunks, kept up to a bound: plain ones by their pre-tokens, the rest by the library."""

    def __init__(self, lib: Tokenizer):
        self.lib = lib
        self.word = _Words(lib.model).__getitem__

    def __missing__(self, chunk: str) -> bytes:
        if _PLAIN.fullmatch(chunk) and "<|" not in chunk:
            out = b"".join(map(self.word, _PRE_TOKEN.findall(chunk.lower())))
        else:
            out = np.array(self.lib.encode(chunk, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(self) < CACHE_ENTRIES and len(chunk) <= CACHE_CHARS:
            self[chunk] = out
        return out


class Encoder:
    """The tokenizer of one file with a bounded cache; one for each worker process."""

    _open: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        size = self.lib.get_vocab_size(with_added_tokens=True)
        self.tokens = [self.lib.id_to_token(i) for i in range(size)]
        self.chunks = _Chunks(self.lib)
        self.specials = {t.content: i for i, t in self.lib.get_added_tokens_decoder().items()}
        self._inner: models.BPE | None = None

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in cls._open:
            make_room("word_bpe")
            cls._open[path] = cls(path)
        return cls._open[path]

    @property
    def inner(self) -> models.BPE:
        """The same merges without the word-end suffix, for the inside of a pre-token."""
        if self._inner is None:
            model = json.loads(self.lib.to_str())["model"]
            merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
            self._inner = models.BPE(vocab=model["vocab"], merges=merges)
        return self._inner

    def said(self, ids: Iterable[int]) -> str:
        """The decoded form of ids: this tokenizer's library joins their tokens by a blank."""
        return " ".join([self.tokens[i] for i in ids])

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        get = self.chunks.__getitem__
        return [b"".join(map(get, [x] if _odd(x) else x.split())) for x in texts]

    def cut(self, text: str, leaf: int) -> Iterator[tuple[str, str]]:
        """(kind, payload) of the leaves of text, in order.

        text: encode as it is. tokens: byte-level pre-tokens, blank-separated. part / last: a
        slice of one pre-token, the last of which carries the word end. special: one id.
        """
        if _odd(text):
            pieces = [text]
        else:
            pieces = text.split()
        room: list[str] = []
        held = 0
        for piece in pieces:
            if len(piece) <= leaf and not _odd(piece):
                if held + len(piece) > leaf and room:
                    yield "text", " ".join(room)
                    room, held = [], 0
                room.append(piece)
                held += len(piece) + 1
                continue
            if room:
                yield "text", " ".join(room)
                room, held = [], 0
            yield from self._cut_run(piece, leaf)
        if room:
            yield "text", " ".join(room)

    def _cut_run(self, run: str, leaf: int) -> Iterator[tuple[str, str]]:
        pattern = "(" + "|".join(map(re.escape, sorted(self.specials))) + ")" if self.specials else "(?!)()"
        for piece in re.split(pattern, run):
            if piece in self.specials:
                yield "special", str(self.specials[piece])
                continue
            if not piece:
                continue
            room: list[str] = []
            held = 0
            for token, _ in self.lib.pre_tokenizer.pre_tokenize_str(self.lib.normalizer.normalize_str(piece)):
                if held + len(token) > leaf and room:
                    yield "tokens", " ".join(room)
                    room, held = [], 0
                if len(token) <= leaf:
                    room.append(token)
                    held += len(token) + 1
                    continue
                slices = list(_halves(token, leaf))
                for k, x in enumerate(slices):
                    yield ("last" if k == len(slices) - 1 else "part"), x
            if room:
                yield "tokens", " ".join(room)

    def leaf_ids(self, kind: str, payload: str) -> list[int]:
        if kind == "text":
            return np.frombuffer(self.ids([payload])[0], dtype="<u4").tolist()
        if kind == "special":
            return [int(payload)]
        if kind == "part":
            return [t.id for t in self.inner.tokenize(payload)]
        return [t.id for x in payload.split(" ") for t in self.lib.model.tokenize(x)]

    def join(self, left: list[int], right: list[int], ends: bool) -> list[int]:
        """The encoding of one pre-token's two neighbouring slices; ends: right holds its word end."""
        w = 4
        while True:
            a, b = min(w, len(left)), min(w, len(right))
            text = "".join([self.tokens[i] for i in left[len(left) - a :]] + [self.tokens[i] for i in right[:b]])
            if ends and b == len(right):
                ids = [t.id for t in self.lib.model.tokenize(text.removesuffix(SUFFIX))]
            else:
                ids = [t.id for t in self.inner.tokenize(text)]
            if (a == len(left) or ids[0] == left[-a]) and (b == len(right) or ids[-1] == right[b - 1]):
                return left[: len(left) - a] + ids + right[b:]
            w *= 2

    def tree(self, leaves: list[tuple[str, list[int]]]) -> list[int]:
        """The ids of a text from those of its leaves, in order: (kind, ids)."""
        out: list[int] = []
        run: list[tuple[list[int], bool]] = []
        for kind, ids in leaves:
            if kind not in ("part", "last"):
                out += ids
                continue
            run.append((ids, kind == "last"))
            if kind == "last":
                while len(run) > 1:
                    run = [
                        (self.join(run[k][0], run[k + 1][0], run[k + 1][1]), run[k + 1][1]) if k + 1 < len(run) else run[k]
                        for k in range(0, len(run), 2)
                    ]
                out += run[0][0]
                run = []
        return out


keeps("word_bpe", Encoder._open.clear)


def _odd(text: str) -> bool:
    return any(c in text for c in _ODD_SPACE)


def _halves(token: str, leaf: int) -> Iterator[str]:
    if len(token) <= leaf:
        yield token
        return
    mid = len(token) // 2
    yield from _halves(token[:mid], leaf)
    yield from _halves(token[mid:], leaf)


def _id_lists(blobs: list[bytes]) -> pa.Array:
    ends = [0, *accumulate(len(b) // 4 for b in blobs)]
    values = pa.array(np.frombuffer(b"".join(blobs), dtype="<u4").astype(np.int32), pa.int32())
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def encode(docs: DataFrame, path: str, leaf: int = LEAF) -> DataFrame:
    """doc_id, ids array<int>, decoded string: one row per row of docs (doc_id, text)."""
    rows = stable(docs.select("doc_id", "text"), "bpe-texts").select("doc_id", whole_text().alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, ids array<int>, decoded string"

    def short(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.of(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(lo, SLICE_ROWS)
                blobs = enc.ids(part.column(1).to_pylist())
                said = pa.array([enc.said(np.frombuffer(x, dtype="<u4").tolist()) for x in blobs], pa.string())
                ids = _id_lists(blobs)
                yield pa.RecordBatch.from_arrays([part.column(0), ids, said], ["doc_id", "ids", "decoded"])

    def leaves(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.of(path)
        names = ["doc_id", "row_key", "leaf_no", "leaves", "kind", "payload"]
        for batch in batches:
            for r in range(batch.num_rows):
                cut = list(enc.cut(batch.column(2)[r].as_py(), leaf)) or [("text", "")]
                n = len(cut)
                same = [pa.repeat(batch.column(k)[r], n) for k in (0, 1)]
                cols = [*same, pa.array(range(n), pa.int32()), pa.array([n] * n, pa.int32())]
                cols += [pa.array([c[k] for c in cut], pa.string()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(cols, names)

    def encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.of(path)
        for batch in batches:
            kinds, payloads = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            ids = _id_lists([np.array(enc.leaf_ids(k, x), dtype="<u4").tobytes() for k, x in zip(kinds, payloads)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in range(5)] + [ids], ["doc_id", "row_key", "leaf_no", "leaves", "kind", "ids"]
            )

    def joined(table: pa.Table) -> pa.Table:
        enc = Encoder.of(path)
        table = table.sort_by("leaf_no")
        ids = enc.tree(list(zip(table["kind"].to_pylist(), table["ids"].to_pylist())))
        blob = np.array(ids, dtype="<u4").tobytes()
        return pa.table(
            {"doc_id": table["doc_id"].slice(0, 1), "ids": _id_lists([blob]), "decoded": pa.array([enc.said(ids)], pa.string())}
        )

    near = rows.where(F.length("text") <= leaf).mapInArrow(short, out)
    far = rows.where(F.length("text") > leaf).select("doc_id", F.monotonically_increasing_id().alias("row_key"), "text")
    far = far.mapInArrow(leaves, f"doc_id {kind}, row_key long, leaf_no int, leaves int, kind string, payload string")
    far = far.repartition(F.col("row_key"), F.col("leaf_no"))  # the halves of one text go to different tasks
    far = far.mapInArrow(encoded, f"doc_id {kind}, row_key long, leaf_no int, leaves int, kind string, ids array<int>")
    return near.unionByName(far.groupBy("row_key").applyInArrow(joined, out))


def decode(rows: DataFrame, path: str) -> DataFrame:
    """rows with a column decoded: the text of its ids (null ids: empty), special ids included."""

    @F.pandas_udf("string")
    def said(ids):
        enc = Encoder.of(path)
        return ids.map(lambda x: "" if x is None else " ".join([enc.tokens[i] for i in x]))

    return rows.withColumn("decoded", said("ids"))
