r"""License scans by an exact set-similarity join. Native: DataFrame and SQL functions only.

Text blocks are windows of words that overlap by half; their length is a power of two times BLOCK,
so long that any passage of a template's length lies whole in one. Templates are sets of words. A
block matches a template if it holds at least THRESHOLD of its words.

The words of all templates are ordered by how often the whole corpus has them, rarest first. A
block with enough of a template's words must hold one of the first of them (prefix filter), so
only pairs of a block and a template that share a prefix word become candidates, and only blocks
with a candidate are made at all. The block itself must be long enough (length filter). Of a
candidate the rarest common word is known: at most the template's words from there on and the
block's words from there on can be common (positional filter). What is left is counted exactly.

Phrases are looked for word by word besides: consecutive words of the text.

Defined results. Words are runs of a-z, 0-9 and non-ASCII characters, lower-cased. A null text is
empty: no words, no labels, score 0. Rows are told apart by a key of their own, so repeated rows
and null ids are fine. Other columns are ignored. Templates may be of any length.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import whole_text, written

#: Words of the shortest blocks; the next one starts half a block on.
BLOCK = 64
THRESHOLD = 0.9

# Phrases that count wherever their words stand consecutively, and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# The wording by which well-known licenses are referred to, as templates.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under cc by 4 0"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
        " the software to deal in the software without restriction including without limitation the rights to use copy modify merge"
        " publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do"
        " so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or"
        " substantial portions of the software the software is provided as is without warranty of any kind express or implied including"
        " but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the"
        " authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or"
        " otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that"
        " the above copyright notice and this permission notice appear in all copies the software is provided as is and the author"
        " disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no"
        " event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting"
        " from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in"
        " connection with the use or performance of this software",
    ),
)


def block_words(template: str) -> int:
    """How long blocks are for a template: any run of as many words as it has lies whole in one."""
    out = BLOCK
    while out // 2 < len(template.split()):
        out *= 2
    return out


def _words(text: Column) -> Column:
    """All words of a text, A-Z lower-cased, blank-separated."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def _n_words(joined: Column) -> Column:
    return F.when(joined == "", F.lit(0)).otherwise(F.length(joined) - F.length(F.replace(joined, F.lit(" "), F.lit(""))) + 1)


def _phrase(phrase: str) -> Column:
    """Of the words in __w: how often the phrase stands there, its first and its last start (null without)."""
    padded = F.concat(F.lit(" "), F.col("__w"), F.lit(" "))
    gaps = F.split(padded, f"(?<= ){phrase}(?= )", -1)
    n = F.size(gaps) - 1
    before = lambda gap: F.length(gap) - F.length(F.replace(gap, F.lit(" "), F.lit(""))) - 1
    first = before(F.get(gaps, F.lit(0)))
    last = F.col("n_words") - before(F.element_at(gaps, -1)) - len(phrase.split())
    found = F.struct(n.cast("long").alias("n"), first.cast("long").alias("first"), last.cast("long").alias("last"))
    return F.when(padded.contains(f" {phrase} "), found)


def _ordered(texts: DataFrame, templates: tuple[tuple[str, str], ...]) -> dict[str, int]:
    """The rank of every word of the templates by how often the corpus has it, rarest first.

    As large as the templates, whatever the corpus.
    """
    known = sorted({w for _, text in templates for w in text.split()})
    table = texts.sparkSession.range(1).select(F.explode(F.array(*[F.lit(w) for w in known])).alias("word"))
    seen = texts.select(F.explode(F.split("__w", " ")).alias("word")).join(F.broadcast(table), "word", "left_semi")
    freq = {r["word"]: r["n"] for r in seen.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {w: k for k, w in enumerate(sorted(known, key=lambda w: (freq.get(w, 0), w)))}


def _literal_table(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A small table that stands in the plan; it is as large as the templates."""
    cells = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rows])
    return spark.range(1).select(F.explode(cells).alias("t")).select("t.*")


def _fits(suspects: DataFrame, templates: tuple[tuple[str, str], ...], rank: dict[str, int]) -> DataFrame:
    """__row, block (its number), template, found: the words that a block and a template have in common, if enough."""
    spark = suspects.sparkSession
    sets = [sorted({rank[w] for w in text.split()}) for _, text in templates]
    needs = [ceil(THRESHOLD * len(own) - 1e-9) for own in sets]
    lengths = [block_words(text) for _, text in templates]
    sizes = sorted(set(lengths))
    vocabulary = _literal_table(spark, ["word", "rank"], list(rank.items()))
    prefix = _literal_table(
        spark,
        ["rank", "template", "at", "size", "need", "length"],
        [(r, t, at, len(own), needs[t], lengths[t]) for t, own in enumerate(sets) for at, r in enumerate(own[: len(own) - needs[t] + 1])],
    )
    words = suspects.select("__row", "n_words", F.posexplode(F.split("__w", " ")).alias("pos", "word"))
    at = words.join(F.broadcast(vocabulary), "word").select("__row", "n_words", "pos", "rank")
    at = written(at, "license-words")

    def blocked(rows: DataFrame) -> DataFrame:
        """Each row once for each block that holds its word: the one that starts last before it, and the one before that."""
        last = (F.col("pos") / (F.col("length") / 2)).cast("long")
        return rows.withColumn("block", F.explode(F.array(last, last - 1))).where("block >= 0").drop("pos")

    # candidates: blocks that share a prefix word with a template, and the rarest word they share
    candidates = blocked(at.join(F.broadcast(prefix), "rank"))
    long_enough = F.least(F.col("length"), F.col("n_words") - F.col("block") * (F.col("length") / 2).cast("long")) >= F.col("need")
    candidates = candidates.where(long_enough).groupBy("__row", "length", "block", "template", "size", "need")
    candidates = written(candidates.agg(F.min(F.struct("at", "rank")).alias("first")), "license-candidates")

    # the blocks that have a candidate, as sets of template words
    wanted = candidates.select("__row", "length", "block").distinct()
    length = F.explode(F.array(*[F.lit(x) for x in sizes])).alias("length")
    held = blocked(at.select("__row", "pos", "rank", length)).join(wanted, ["__row", "length", "block"], "left_semi")
    held = held.groupBy("__row", "length", "block").agg(F.sort_array(F.collect_set("rank")).alias("held"))
    from_first = F.size("held") - F.array_position("held", F.col("first.rank")) + 1
    possible = (F.col("size") - F.col("first.at") >= F.col("need")) & (from_first >= F.col("need"))
    own = _literal_table(spark, ["template", "own"], [(t, ",".join(map(str, x))) for t, x in enumerate(sets)])
    own = own.withColumn("own", F.split("own", ",").cast("array<int>"))
    pairs = candidates.join(held, ["__row", "length", "block"]).where(possible).join(F.broadcast(own), "template")
    pairs = pairs.withColumn("found", F.size(F.array_intersect("held", "own")))
    return pairs.where("found >= need").select("__row", "length", "block", "template", "found", "size")


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """One row per row of docs (doc_id, text).

    doc_id, n_words, n_base, first_word, last_word (of the phrases), base_labels, labels (with those
    of matching templates; comma-joined), score (largest share of a template's words in one block
    that matches, 1 where a phrase stands), blocks (array of start word, label and share).
    """
    texts = docs.select("doc_id", _words(whole_text()).alias("__w"))
    rank = _ordered(texts, templates)
    prefix = set()
    for _, text in templates:
        own = sorted(set(text.split()), key=rank.get)
        prefix.update(own[: len(own) - ceil(THRESHOLD * len(own) - 1e-9) + 1])

    # one pass over the texts: what the phrases give, and the words of those that hold any prefix word
    texts = texts.withColumn("n_words", _n_words(F.col("__w")).cast("long"))
    texts = texts.withColumns({f"__p{k}": _phrase(p) for k, (p, _) in enumerate(PHRASES)})
    phrases = [F.col(f"__p{k}") for k in range(len(PHRASES))]
    labels = [F.when(p.isNotNull(), F.lit(label)) for p, (_, label) in zip(phrases, PHRASES)]
    base = {
        "n_base": sum((F.coalesce(p["n"], F.lit(0)) for p in phrases), F.lit(0).cast("long")),
        "first_word": F.least(*[p["first"] for p in phrases]),
        "last_word": F.greatest(*[p["last"] for p in phrases]),
        "base_set": F.array_compact(F.array(*labels)),
    }
    keep = ["doc_id", "n_words", *base]
    suspect = F.arrays_overlap(F.split("__w", " "), F.array(*[F.lit(w) for w in sorted(prefix)]))
    found = texts.withColumns(base).select(*keep, F.when(suspect, F.col("__w")).alias("__w"), F.monotonically_increasing_id().alias("__row"))
    found = written(found, "license-texts")
    suspects = found.where("__w IS NOT NULL")

    kind = "array<struct<start:long,label:string,share:double>>"
    label = F.get(F.array(*[F.lit(x) for x, _ in templates]), F.col("template"))
    start = F.col("block") * (F.col("length") / 2).cast("long")
    match = F.struct(start.alias("start"), label.alias("label"), (F.col("found") / F.col("size")).alias("share"))
    fits = _fits(suspects, templates, rank).groupBy("__row").agg(F.sort_array(F.collect_list(match)).cast(kind).alias("blocks"))
    matched = suspects.join(fits, "__row", "left").select(*keep, F.coalesce("blocks", F.array().cast(kind)).alias("blocks"))
    out = found.where("__w IS NULL").select(*keep, F.array().cast(kind).alias("blocks")).unionByName(matched)

    every = F.array_sort(F.array_union("base_set", F.transform("blocks", lambda b: b["label"])))
    best = F.coalesce(F.array_max(F.transform("blocks", lambda b: b["share"])), F.lit(0.0))
    return out.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("base_set"), ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(best).alias("score"),
        "blocks",
    )
