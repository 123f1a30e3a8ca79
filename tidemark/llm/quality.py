"""Quality classifier: supervised subword embeddings.

A token's vector is the mean of learned vectors of hashed features: the token itself and its
character n-grams, with marks for its start and end. Every pair of neighbouring tokens has a learned
vector as well, hashed from the first STEM characters of both: word bigrams of stems, since whole
ones are mostly new in a new text. A document is the mean of its tokens' vectors and of
its pairs' (PRIOR empty tokens are added, so that very short texts stay near the bias; pairs count
PAIR times),
and a softmax layer turns it into class probabilities. All of it is trained by stochastic gradient
descent in numpy.

The fit takes a bounded sample: at most MAX_ROWS labelled documents with at most MAX_CHARS
characters together, by the hash of their id, and of each its whole text. One that does not fit into
what is left of the characters is skipped; a sample that misses a label which exists gives a warning. Everything
else covers all rows and all of their text. A fitted model is linear in tokens and pairs, so scoring
looks up one number for each of them, for many documents at once.

Defined results. A null text is empty; an empty text gets the score of the bias alone. Labels that
are null count as missing, several labels of one id as their mean rounded, labels without a document
are ignored. With no labelled row, or those of one class only, the score is the share of label 1
among them (0.5 without any). Rows that repeat an id get a result each. No column but the text goes
into a score; a column that is called as the score's gives way to it, all others are passed on.
"""

from __future__ import annotations

import re
import warnings
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import make_room, whole_text

#: Bounds of the sample that the fit takes.
MAX_ROWS, MAX_CHARS = 2500, 8_000_000
#: Vectors of tokens and n-grams, and those of pairs.
SIZE, PAIRS = 1 << 16, 1 << 17
DIM = 12
GRAMS = (3, 4)
#: Characters of a token that its pairs are hashed from, and how much the pairs' mean counts beside the tokens'.
STEM, PAIR = 2, 3.0
PRIOR = 5
#: Distinct tokens a worker keeps before it starts anew, and texts it scores at once.
CACHE_ENTRIES = 150_000
SLICE_ROWS = 128
#: Distinct tokens the driver keeps while it fits.
FIT_ENTRIES = 50_000
#: Rounds over the sample, at least, and steps: a small sample is gone over more often.
EPOCHS, STEPS = 6, 7000
RATE = 0.5
SEED = 7

_TOKEN = re.compile(r"\S+|\n")


def _stem(token: str) -> int:
    return crc32(token[:STEM].encode("utf-8", "surrogatepass"))


def features(token: str) -> list[int]:
    """Hashed features of a token: itself and its character n-grams."""
    marked = f"<{token}>"
    grams = [marked[k : k + n] for n in GRAMS for k in range(len(marked) - n + 1)]
    return [crc32(g.encode("utf-8", "surrogatepass")) % SIZE for g in (f"={token}", *grams)]


def pairs(stems: np.ndarray) -> np.ndarray:
    """The vector's number of each pair of neighbours, from the hashes of tokens' stems."""
    h = stems.astype(np.uint64)
    mixed = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(64 - PAIRS.bit_length() + 1)).astype(np.int64) + SIZE


@dataclass
class Model:
    vectors: np.ndarray  # SIZE + PAIRS x DIM
    weights: np.ndarray  # DIM x 2
    bias: np.ndarray  # 2

    def feature_scores(self) -> tuple[np.ndarray, float]:
        """What a feature adds to the difference of the two logits, and the bias."""
        w = self.weights[:, 1] - self.weights[:, 0]
        return self.vectors @ w, float(self.bias[1] - self.bias[0])


def weights_of(text: str, known: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The vectors that a document's mean is made of, and the share of each; known keeps features of tokens."""
    tokens = _TOKEN.findall(text)
    total = len(tokens) + PRIOR
    weight: dict[int, float] = {}
    for token, n in Counter(tokens).items():
        own = known.get(token)
        if own is None:
            own = np.array(features(token), dtype=np.int32)
            if len(known) < FIT_ENTRIES:
                known[token] = own
        for f in own.tolist():
            weight[f] = weight.get(f, 0.0) + n / (total * len(own))
    if len(tokens) > 1:
        at, n = np.unique(pairs(np.fromiter(map(_stem, tokens), np.uint32, len(tokens))), return_counts=True)
        weight.update(zip(at.tolist(), (PAIR * n / total).tolist()))
    return np.fromiter(weight, np.int32, len(weight)), np.fromiter(weight.values(), np.float32, len(weight))


def step(model: Model, at: np.ndarray, share: np.ndarray, label: int, rate: float) -> None:
    """One step against the gradient of a document's log loss.

    A feature's share of a text is small, so the vectors' steps are scaled up by the inverse of the
    shares' length.
    """
    mean = share @ model.vectors[at]
    logit = mean @ model.weights + model.bias
    p = np.exp(logit - logit.max())
    p /= p.sum()
    p[label] -= 1.0
    p *= rate
    back = model.weights @ p
    model.weights -= np.outer(mean, p)
    model.bias -= p
    model.vectors[at] -= np.outer(share / max(np.sqrt(share @ share), 1e-9), back)


def fit(texts: list[str], labels: list[int], seed: int = SEED) -> Model:
    """Stochastic gradient descent on the log loss, one document a step, with a falling rate."""
    rng = np.random.default_rng(seed)
    vectors = np.concatenate([rng.uniform(-1 / DIM, 1 / DIM, (SIZE, DIM)), np.zeros((PAIRS, DIM))])
    model = Model(vectors, np.zeros((DIM, 2)), np.zeros(2))
    if len(set(labels)) < 2:
        share = np.mean(labels) if labels else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        model.bias[:] = [0.0, np.log(share / (1 - share))]
        return model
    known: dict[str, np.ndarray] = {}
    rows = [weights_of(text, known) for text in texts]
    known.clear()
    epochs = max(EPOCHS, -(-STEPS // len(rows)))
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            step(model, *rows[k], labels[k], RATE * (1 - done / steps))
            done += 1
    return model


class _Tokens(dict):
    """Numbers of tokens, with what each adds to a score and the hash of its stem."""

    def __init__(self, per_feature: list[float]):
        self.per_feature = per_feature
        self.adds, self.stems = array("d"), array("L")

    def __missing__(self, token: str) -> int:
        own = [self.per_feature[f] for f in features(token)]
        self.adds.append(sum(own) / len(own))
        self.stems.append(_stem(token))
        self[token] = len(self)
        return self[token]


class Scorer:
    """Texts -> probabilities of label 1."""

    def __init__(self, per_feature: np.ndarray, bias: float):
        self.table, self.bias = per_feature, bias
        self.singles = per_feature[:SIZE].tolist()
        self.tokens = _Tokens(self.singles)

    def __call__(self, texts: list[str]) -> np.ndarray:
        if len(self.tokens) > CACHE_ENTRIES:
            self.tokens = _Tokens(self.singles)
        found = [_TOKEN.findall(t) for t in texts]
        sizes = np.array([len(x) for x in found], dtype=np.int64)
        number = self.tokens.__getitem__
        at = np.fromiter((k for x in found for k in map(number, x)), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(texts)), sizes)
        total = np.bincount(owner, np.array(self.tokens.adds)[at] if len(at) else None, minlength=len(texts))
        if len(at) > 1:
            adds = PAIR * self.table[pairs(np.array(self.tokens.stems, dtype=np.uint64)[at])]
            total += np.bincount(owner[1:], adds * (owner[1:] == owner[:-1]), minlength=len(texts))
        z = self.bias + total / (sizes + PRIOR)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30.0, 30.0)))


def sample(
    docs: DataFrame, labels: DataFrame, trainable: Column, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS
) -> tuple[list[str], list[int]]:
    """The texts and labels of the fit's sample, among the documents that trainable (a condition on doc_id) allows."""
    spark = docs.sparkSession
    named = labels.where(F.col("quality").isNotNull() & trainable).groupBy("doc_id")
    named = named.agg(F.round(F.avg("quality")).cast("int").alias("quality"))
    sized = docs.where(trainable).groupBy("doc_id").agg(F.sum(F.length(whole_text())).alias("n"))
    order = F.xxhash64("doc_id")
    found = named.join(sized, "doc_id")
    rows = found.where(F.col("n") <= max_chars).orderBy(order, "doc_id").limit(max_rows).collect()
    chosen, room = [], max_chars
    for r in rows:
        if r["n"] <= room:  # one that does not fit is skipped, the next may fit
            chosen.append((r["doc_id"], r["quality"]))
            room -= r["n"]
    classes = {q for _, q in chosen}
    if len(classes) < 2 and found.where(~F.col("quality").isin(*classes)).limit(1).count() > 0:
        warnings.warn(f"the fit's sample holds the labels {sorted(classes)} only, others exist: every score is the same")
    if not chosen:
        return [], []
    table = spark.createDataFrame(chosen, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, quality int")
    texts = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(table), "doc_id").collect()
    texts = sorted((r["doc_id"], r["text"], r["quality"]) for r in texts)
    return [t for _, t, _ in texts], [q for _, _, q in texts]


def train(docs: DataFrame, labels: DataFrame, trainable: Column) -> Model:
    return fit(*sample(docs, labels, trainable))


def score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """docs with a column out: the probability of label 1, from the whole text alone."""
    shipped = docs.sparkSession.sparkContext.broadcast(model.feature_scores())

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        make_room("quality")
        own = Scorer(*shipped.value)
        for texts in batches:
            parts = [own(texts.iloc[lo : lo + SLICE_ROWS].tolist()) for lo in range(0, len(texts), SLICE_ROWS)]
            yield pd.Series(np.concatenate([np.empty(0), *parts]))

    return docs.withColumn(out, scored(whole_text()))


def trainable_ids() -> Column:
    """Rows whose labels may be learned from: all but those held out, a third by the crc32 of the id."""
    return ~held_out()


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
