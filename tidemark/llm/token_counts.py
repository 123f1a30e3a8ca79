r"""Token counts without ids: pieces are counted once per distinct pre-token.

Every text is split into pre-tokens by the tokenizer's own pattern, in the JVM. The distinct
pre-tokens of the corpus are counted into pieces by the tokenizers library, once each. Those
counts are joined to the pre-token frequencies of each document and summed. The join has two
tiers: the most frequent pre-tokens, HOT at most, go to every executor (HOT rows of HOT_BYTES each at most,
whatever the corpus), where a document's occurrences of them fold into one row;
all others stay rows (document, pre-token, frequency) and meet their counts in a shuffled join.

A text with a code point that the JVM's Unicode tables don't know yet is counted by the library
directly, since the two might split it differently.

Defined results. A null text is empty and has no tokens. Special strings in a text count as one
token, as the library does by default. Repeated rows give repeated results; null ids are kept.
Other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.common import keeps, make_room, stable, whole_text, written

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bound of the broadcast tier, in rows and in bytes of one pre-token.
HOT = 200_000
HOT_BYTES = 64

# The byte-level pre-token pattern, with white space as Unicode defines it.
_SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
PRE_TOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
UNKNOWN = r"\p{Cn}|\p{Co}"


_OPEN: dict[str, Tokenizer] = {}


def _open(path: str) -> Tokenizer:
    if path not in _OPEN:
        make_room("token_counts")
        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        _OPEN[path] = tok
    return _OPEN[path]


keeps("token_counts", _OPEN.clear)


def library_counts(rows: DataFrame, column: str, path: str, out: str) -> DataFrame:
    """rows with a column out: how many tokens the library gives for the text in column."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{out}` long"
    names = rows.columns
    at = names.index(column)

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _open(path)
        for batch in batches:
            n: list[int] = []
            for lo in range(0, batch.num_rows, 1024):
                texts = batch.column(at).slice(lo, 1024).to_pylist()
                n += [len(e) for e in tok.encode_batch(texts, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], [*names, out])

    return rows.mapInArrow(counted, schema)


def pre_tokens(text: Column, specials: list[str]) -> Column:
    """All pre-tokens of a text, in order, without the special strings."""
    found = lambda x: F.regexp_extract_all(x, F.lit(PRE_TOKEN), F.lit(0))
    out = found(text)
    for special in specials:  # rare: the text is split at the special strings first
        parts = F.flatten(F.transform(_parts(text, specials), found))
        out = F.when(text.contains(special), parts).otherwise(out)
    return out


def _parts(text: Column, specials: list[str]) -> Column:
    pattern = "|".join("".join("\\" + c if not c.isalnum() else c for c in x) for x in specials)
    return F.split(text, pattern, -1)


def _cutoff(pieces: DataFrame, hot: int) -> int:
    """A frequency that at most hot pieces reach: from the counts of frequency classes, a few hundred rows."""
    step = F.floor(F.log2("freq") * 16)
    classes = pieces.groupBy(step.alias("class")).agg(F.count(F.lit(1)).alias("n"), F.min("freq").alias("least"))
    least, held = 2**62, 0
    for row in sorted(classes.collect(), key=lambda r: -r["class"]):
        held += row["n"]
        if held > hot:
            break
        least = row["least"]
    return least


def count(docs: DataFrame, path: str, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_tokens: one row per row of docs (doc_id, text)."""
    specials = [t.content for t in Tokenizer.from_file(path).get_added_tokens_decoder().values()]
    text = F.col("text")
    docs = stable(docs.select("doc_id", "text"), "token-count-texts")
    rows = docs.select("doc_id", whole_text().alias("text"), F.octet_length(whole_text()).cast("long").alias("n_bytes"))
    known = rows.where(~text.rlike(UNKNOWN))

    # each distinct pre-token of the corpus, its frequency and, once, its pieces
    pieces = known.select(F.explode(pre_tokens(text, specials)).alias("piece"))
    pieces = pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("freq"))
    pieces = written(library_counts(pieces, "piece", path, "n"), "piece-counts")
    short = pieces.where(F.octet_length("piece") <= HOT_BYTES)
    frequent = short.where(F.col("freq") >= _cutoff(short, hot))
    frequent = written(frequent.select("piece", F.col("n").alias("hot_n")), "piece-counts-hot")

    # frequencies of each document: hot pre-tokens folded into one row, the others one row each
    row = ["row_key", "doc_id", "n_bytes", "n_special"]
    n_special = F.size(_parts(text, specials)) - 1 if specials else F.lit(0)
    split = known.withColumn("row_key", F.monotonically_increasing_id()).withColumn("n_special", n_special)
    split = split.select(*row, F.explode_outer(pre_tokens(text, specials)).alias("piece"))
    split = split.join(F.broadcast(frequent), "piece", "left")
    rare = F.when(F.col("hot_n").isNull(), F.col("piece")).alias("piece")
    freq = split.groupBy(*row, rare).agg(F.sum("hot_n").alias("hot_sum"), F.count(F.lit(1)).alias("times"))
    # rows of folded pre-tokens have no counts to meet: a second key of their own spreads them over all tasks
    freq = freq.withColumn("apart", F.when(F.col("piece").isNull(), F.col("row_key") + 1).otherwise(F.lit(0))).withColumn("piece", F.coalesce("piece", F.lit("")))
    summed = (
        freq.join(pieces.select("piece", "n", F.lit(0).cast("long").alias("apart")), ["piece", "apart"], "left")
        .groupBy(*row)
        .agg(F.sum(F.coalesce("hot_sum", F.col("times") * F.col("n"), F.lit(0))).alias("n_split"))
        .select("doc_id", "n_bytes", (F.col("n_split") + F.col("n_special")).alias("n_tokens"))
    )
    direct = library_counts(rows.where(text.rlike(UNKNOWN)), "text", path, "n_tokens")
    return summed.unionByName(direct.select("doc_id", "n_bytes", "n_tokens"))
