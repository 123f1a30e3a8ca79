r"""Secret scans with multipart credential linking. Native: DataFrame and SQL functions only.

Strong kinds are reported wherever they stand: assign, access, hex. Weak parts (an identifier, a
key-like token, an endpoint) are reported only when a complementary part stands within the same
scope: an interval of SCOPE code points around the part, outside of it. A weak key needs an identifier or an
endpoint there, a weak identifier or an endpoint needs a secret. The interval join puts parts into
tiles of one scope's length, joins each weak part to its own and the two neighbouring tiles, and
asks only whether a partner exists, so no pairs come out of it; a tile holds as many parts as fit
into SCOPE code points and no more.

Positions of all matches come from the lengths of the matches and of what stands between them.

Defined results. A null text is empty; a text without parts has no spans. Rows are told apart by a
key of their own, so repeated rows and null ids are fine. All columns of the input are passed on;
a column called base_spans or spans gives way to the scan's own (redact keeps it).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import free, whole_text, written

#: How far apart the parts of one credential may stand, in code points.
SCOPE = 200


@dataclass(frozen=True)
class Kind:
    name: str
    part: str  # identifier, secret or endpoint
    regex: str
    weak: bool = False
    group: int = 0  # whose length counts
    least: int = 1


# The kinds in the order in which spans of one start are listed.
KINDS = (
    Kind(
        "assign",
        "secret",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=8,
    ),
    Kind("access", "identifier", "AKIA[A-Z0-9]{12,}"),
    Kind("hex", "secret", "[0-9a-f]{32,}"),
    Kind(
        "weak_id",
        "identifier",
        r"""(?i)(?:user_?name|user_?id|login|account_?id|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@+-]{3,}""",
        weak=True,
    ),
    Kind(
        "weak_key",
        "secret",
        r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{20,}",
        weak=True,
    ),
    Kind("endpoint", "endpoint", r"""[a-z][a-z0-9+.-]{1,20}://[^\s"'<>]{4,}""", weak=True),
)
COMPLEMENTS = {"identifier": ("secret",), "secret": ("identifier", "endpoint"), "endpoint": ("secret",)}
SPAN = "array<struct<start:int,kind:int,stop:int>>"


def _suspect(text: Column) -> Column:
    """Whether a text can have any span: a strong part, or a weak key with something to go with it."""
    rx = {k.name: k.regex for k in KINDS}
    strong = text.rlike(rx["assign"]) | text.rlike(rx["access"]) | text.rlike(rx["hex"])
    return strong | (text.rlike(rx["weak_key"]) & (text.contains("://") | text.rlike(rx["weak_id"])))


def _lengths(text: Column, kind: Kind) -> Column:
    """For every match: the code points between the match before and it, its length, and that of its group."""
    long = lambda xs: F.transform(xs, lambda x: F.length(x))
    gaps = long(F.split(text, kind.regex, -1))
    hits = long(F.regexp_extract_all(text, F.lit(kind.regex), F.lit(0)))
    counts = long(F.regexp_extract_all(text, F.lit(kind.regex), F.lit(kind.group))) if kind.group else hits
    return F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"), counts.alias("counts"))


def _parts(suspects: DataFrame) -> DataFrame:
    """__row, kind, start, stop of every match that is long enough."""
    kinds = [
        F.struct(F.lit(k).alias("kind"), _lengths(F.col("__text"), kind).alias("matches")) for k, kind in enumerate(KINDS)
    ]
    each = suspects.select("__row", F.explode(F.array(*kinds)).alias("k")).select("__row", "k.kind", F.posexplode("k.matches"))
    upto = Window.partitionBy("__row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stop = F.sum(F.col("col.gap") + F.col("col.hit")).over(upto).cast("int")
    least = F.get(F.array(*[F.lit(k.least) for k in KINDS]), F.col("kind"))
    found = each.select("__row", "kind", stop.alias("stop"), F.col("col.hit").alias("n"), (F.col("col.counts") >= least).alias("ok"))
    return found.where("ok").select("__row", "kind", (F.col("stop") - F.col("n")).alias("start"), "stop")


def _linked(parts: DataFrame) -> DataFrame:
    """The weak parts with a complementary part in scope."""
    part_of = F.get(F.array(*[F.lit(k.part) for k in KINDS]), F.col("kind"))
    is_weak = F.get(F.array(*[F.lit(k.weak) for k in KINDS]), F.col("kind"))
    tile = (F.col("start") / SCOPE).cast("int")
    needs = [F.when(F.col("part") == p, F.array(*[F.lit(x) for x in xs])) for p, xs in COMPLEMENTS.items()]
    weak = parts.where(is_weak).withColumn("part", part_of).withColumn("need", F.explode(F.coalesce(*needs)))
    # a part may be longer than a scope: it reaches every tile from one before its start to one after its end
    reach = F.sequence(tile - 1, (F.col("stop") / SCOPE).cast("int") + 1)
    weak = weak.withColumn("at", F.explode(reach))
    other = parts.select(
        F.col("__row").alias("o_row"), part_of.alias("o_part"), F.col("start").alias("o_start"), F.col("stop").alias("o_stop")
    )
    other = other.withColumn("o_at", F.explode(F.sequence((F.col("o_start") / SCOPE).cast("int"), (F.col("o_stop") / SCOPE).cast("int"))))
    near = (F.col("o_start") < F.col("stop") + SCOPE) & (F.col("o_stop") > F.col("start") - SCOPE)
    near = near & ((F.col("o_start") >= F.col("stop")) | (F.col("o_stop") <= F.col("start")))  # a URL's own path is no partner
    on = (F.col("__row") == F.col("o_row")) & (F.col("at") == F.col("o_at")) & (F.col("need") == F.col("o_part")) & near
    return weak.join(other, on, "left_semi").select("__row", "kind", "start", "stop").distinct()


def _scanned(docs: DataFrame, base: str, spans: str, texts: bool = True) -> DataFrame:
    """docs with columns base and spans (names that docs doesn't have); without texts, texts without spans come back null.

    The patterns go over every text once: the result with its flag is written, and both branches read it.
    """
    row, flag = free("__row", docs.columns), free("__suspect", docs.columns)
    none = F.array().cast(SPAN)
    rows = docs.withColumn(flag, _suspect(whole_text()))
    if not texts:
        rows = rows.withColumn("text", F.when(F.col(flag), F.col("text")))
    rows = written(rows.withColumn(row, F.monotonically_increasing_id()), "scanned")
    clean = rows.where(~F.col(flag)).select(*docs.columns, none.alias(base), none.alias(spans))
    suspects = rows.where(F.col(flag))
    parts = written(_parts(suspects.select(F.col(row).alias("__row"), whole_text().alias("__text"))), "credential-parts")
    is_weak = F.get(F.array(*[F.lit(k.weak) for k in KINDS]), F.col("kind"))
    every = parts.where(~is_weak).withColumn("base", F.lit(True)).unionByName(_linked(parts).withColumn("base", F.lit(False)))
    span = F.struct("start", "kind", "stop")
    by_row = every.groupBy(F.col("__row").alias(row)).agg(
        F.sort_array(F.collect_list(F.when(F.col("base"), span))).cast(SPAN).alias(base),
        F.sort_array(F.collect_list(span)).cast(SPAN).alias(spans),
    )
    found = suspects.join(by_row, row, "left")
    found = found.select(*docs.columns, F.coalesce(base, none).alias(base), F.coalesce(spans, none).alias(spans))
    return clean.unionByName(found)


def scan(docs: DataFrame) -> DataFrame:
    """docs with base_spans and spans: sorted arrays of (start, kind number in KINDS, stop), code points, stop exclusive."""
    own = ("base_spans", "spans")
    return _scanned(docs.select(*[c for c in docs.columns if c.lower() not in own]), *own)


def spans_of(docs: DataFrame) -> DataFrame:
    """doc_id, base_spans, spans of docs (doc_id, text), as in scan(); texts without spans are not carried along."""
    return _scanned(docs.select("doc_id", "text"), "base_spans", "spans", texts=False).drop("text")


def as_string(spans: Column) -> Column:
    """kind:start:stop of every span, comma-joined."""
    name = lambda s: F.get(F.array(*[F.lit(k.name) for k in KINDS]), s["kind"])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["stop"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    number = next(k for k, x in enumerate(KINDS) if x.name == kind)
    return F.size(F.filter(spans, lambda s: s["kind"] == number)).cast("long")


def redact(docs: DataFrame, mask: str = "[REDACTED]") -> DataFrame:
    """docs with every reported span replaced by mask, n_chars (if there) following; texts without spans stay as they are."""
    base, spans, new = (free(c, docs.columns) for c in ("__base_spans", "__spans", "__new"))
    found = _scanned(docs, base, spans)
    text = whole_text()
    # what stands between the spans: from the furthest stop so far to the next start
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("kept"))

    def step(s: Column, x: Column) -> Column:
        piece = F.when(x["start"] >= s["at"], F.substring(text, s["at"] + 1, x["start"] - s["at"]))
        return F.struct(
            F.greatest(s["at"], x["stop"]).alias("at"),
            F.when(piece.isNotNull(), F.array_append(s["kept"], piece)).otherwise(s["kept"]).alias("kept"),
        )

    end = F.aggregate(spans, state, step)
    masked = F.concat(F.array_join(end["kept"], mask), F.lit(mask), F.substring(text, end["at"] + 1, F.length(text)))
    any_span = F.size(spans) > 0
    rows = found.withColumn(new, F.when(any_span, masked).otherwise(F.col("text")))
    own = {"text": F.col(new).alias("text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(any_span, F.length(new).cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return rows.select(*[own.get(c, F.col(c)) for c in docs.columns])
