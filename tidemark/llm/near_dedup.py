"""MinHash near-dedup: SuperMinHash signatures, banding, verification, union-find grouping.

SuperMinHash gives every shingle a random order of all slots; the slot that comes at rank j gets
the value j + r with r random in [0, 1), and a slot keeps its smallest. Ranks of one shingle are
all different, which lowers the variance against independent slots. The orders are shuffles
(Fisher-Yates) by the shingle's own random numbers, made one rank at a time for all shingles of a
batch of documents at once; a document is done as soon as no later rank can lower any of its slots.

Documents with equal shingle sets form a class, and only its representative goes on. Slots are
cut into bands; documents that agree in a whole band share a bucket. Within a bucket each member
is first paired with its centre only: the member that meets the most others over all its buckets
(of equal ones the smallest id). In a family of near copies that is one close to what they were
made of, which is linked with all that are linked with anything, or nearly so; a member picked by
its id may be far out and leave most of the family to the next step, whose pairs grow with the
square of what is left. Those pairs are checked on full sets and grouped; then
the pairs of one bucket that are still in different groups and can reach the threshold are checked
as well, and grouped with the rest. Whether a pair can reach it is told by the sizes and by odd
sketches: every shingle of a set flips one of PARITY bits, so the bits in which two sketches differ
are at most as many as the shingles in which the sets do. That bound is exact; it spares a family
of half-alike documents from being compared pair by pair on full sets. In so few bits long sets
differ by chance in about half of them, whatever they share; so sets of more than PARITY shingles
have a second sketch, with a bit for each shingle, up to the next power of two. A sketch folds onto
half its length by exclusive or, so sets of different lengths can be compared. Members of a bucket's largest group need not meet each other again: the others meet all.
Both sides are cut into parts of about PART_ROWS, and any two parts meet in a group of rows of
their own, so the work on a large bucket spreads over many tasks. No cap anywhere: the band shape makes the chance of missing a
pair at the threshold less than MISS, and everything that is reported as a link has been verified.

Groups come from union-find inside the partitions, which shrinks the links to forests, and rounds
of exchanging least labels between them. Nothing about single documents reaches the driver.

Defined results. A null text is empty; a text without words has an empty set and is linked with
nothing. A text with fewer words than a shingle is one shingle. Rows that repeat an id are one
document for the grouping and each get its result; where their texts differ, the group is that of
the one whose set has the least hash. A null id is linked with nothing and is its own group (null).
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, free, make_room, whole_text, written

#: Slots of a signature; a slot's number fits one byte.
SLOTS = 240
#: Largest chance of missing a pair that is just at the threshold.
MISS = 1e-6
#: Bits of an odd sketch.
PARITY = 1024
#: Shingles of two sets together up to which the short sketches tell enough.
SHORT = 4096
#: Rows of one part of a large bucket; a long set counts as a row for each of its PARITY shingles.
PART_ROWS = 2048
WORD_CACHE = 100_000
#: Rows, and bytes of text, that a worker takes together; a longer text is taken on its own.
SLICE_ROWS, SLICE_BYTES = 256, 1 << 21
#: Shingles whose orders are shuffled at once: their number times SLOTS is what a worker holds in bytes.
SLICE_SHINGLES = 16_384


def band_shape(threshold: float, slots: int = SLOTS) -> tuple[int, int]:
    """(bands, rows): the longest bands for which a pair at threshold shares one with a chance over 1 - MISS."""
    for rows in range(8, 1, -1):
        bands = slots // rows
        if (1 - threshold**rows) ** bands <= MISS:
            return bands, rows
    return slots, 1


class _Hashes(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < WORD_CACHE:
            self[word] = h
        return h


def shingle_set(text: str, words: int, hashes: dict[bytes, int] | None = None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles; hashes keeps those of words for the texts of one task."""
    hashes = _Hashes() if hashes is None else hashes
    # bytes.lower() and bytes.split() know ASCII only: A-Z, and \\x20 and \\x09-\\x0D
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    h = np.array([hashes[w] for w in found], dtype=np.uint64)
    n = len(h) - words + 1 if len(h) >= words else 1
    width = min(words, len(h))
    out = np.full(n, np.uint64(0x9E3779B97F4A7C15 + width), dtype=np.uint64)
    for k in range(width):
        out = _mixed((out ^ h[k : k + n]) * np.uint64(0xD6E8FEB86659FD93))
    return np.unique(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash values, one row per (non-empty) set: rank in the high 32 bits, random part in the low."""
    sig = np.full(len(sets) * slots, np.uint64(2**64 - 1), dtype=np.uint64)
    every = np.concatenate([np.empty(0, dtype=np.uint64), *sets])
    owner = np.repeat(np.arange(len(sets)), np.array([len(s) for s in sets], dtype=np.int64))
    for lo in range(0, len(every), SLICE_SHINGLES):
        _lower(sig, every[lo : lo + SLICE_SHINGLES], owner[lo : lo + SLICE_SHINGLES], slots)
    return sig.reshape(-1, slots)


def _lower(sig: np.ndarray, h: np.ndarray, doc: np.ndarray, slots: int) -> None:
    """Takes the shingles h of documents doc into their slots' least values."""
    order = np.empty((len(h), slots), dtype=np.uint8)
    order[:] = np.arange(slots, dtype=np.uint8)
    order = order.reshape(-1)
    row = np.arange(len(h)) * slots
    table = sig.reshape(-1, slots)
    for rank in range(slots):
        draw = _mixed(h + np.uint64((rank + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        # one step of the shuffle: any of the slots not yet given a rank, and the present one takes its place
        pick = rank + ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(slots - rank) >> np.uint64(32)).astype(np.int64)
        at = order[row + pick]
        order[row + pick] = order[row + rank]
        np.minimum.at(sig, doc * slots + at, (draw >> np.uint64(32)) | np.uint64(rank << 32))
        # later ranks bring larger values only
        live = (table.max(axis=1) >= np.uint64((rank + 1) << 32))[doc]
        if not live.any():
            break
        if 2 * np.count_nonzero(live) < live.size:
            doc, h, row = doc[live], h[live], row[live]


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per row and band."""
    cut = sig[:, : bands * rows].reshape(len(sig), bands, rows)
    out = np.broadcast_to(np.arange(bands, dtype=np.uint64) + np.uint64(1), cut.shape[:2]) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(rows):
        out = _mixed((out ^ cut[:, :, k]) * np.uint64(0xD6E8FEB86659FD93))
    return out


def odd_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """For each set which of PARITY bits an odd number of its shingles fall on, packed into 64-bit words."""
    doc = np.repeat(np.arange(len(sets)), np.array([len(s) for s in sets], dtype=np.int64))
    h = np.concatenate([np.empty(0, dtype=np.uint64), *sets])
    odd = np.bincount(doc * PARITY + _place(h, PARITY), minlength=len(sets) * PARITY) & 1
    return _words(odd.reshape(len(sets), PARITY))


def wide_sketch(own: np.ndarray) -> np.ndarray:
    """The odd sketch of one set in as many bits as it has shingles, up to the next power of two; empty up to PARITY shingles."""
    if len(own) <= PARITY:
        return np.empty(0, dtype=np.int64)
    bits = 1 << (len(own) - 1).bit_length()
    return _words((np.bincount(_place(own, bits), minlength=bits) & 1)[None, :])[0]


def _place(h: np.ndarray, bits: int) -> np.ndarray:
    return (_mixed(h ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(bits)).astype(np.int64)


def _words(odd: np.ndarray) -> np.ndarray:
    return np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)


def _wide_differ(a: Column, b: Column) -> Column:
    """In how many bits two wide sketches differ, the longer one folded; 0 where they can't be compared."""

    def folded(x: Column, n: Column) -> Column:
        # sizes that can be similar enough are less than a factor of four apart: two folds at most
        def half(y: Column) -> Column:
            n = F.floor(F.size(y) / 2).cast("int")
            return F.zip_with(F.slice(y, F.lit(1), n), F.slice(y, n + 1, n), lambda u, v: u.bitwiseXOR(v))

        return F.when(F.size(x) == n, x).when(F.size(x) == 2 * n, half(x)).when(F.size(x) == 4 * n, half(half(x)))

    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(folded(a, n), folded(b, n), lambda u, v: F.bit_count(u.bitwiseXOR(v)))
    return F.when(n > 0, F.coalesce(F.aggregate(pairs, F.lit(0), lambda acc, x: acc + x), F.lit(0))).otherwise(0)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch (doc_id, text) in parts of SLICE_ROWS rows and about SLICE_BYTES of text at most."""
    sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
    lo = total = 0
    for k, size in enumerate(sizes):
        if k > lo and (total + size > SLICE_BYTES or k - lo == SLICE_ROWS):
            yield batch.slice(lo, k - lo)
            lo, total = k, 0
        total += size
    if batch.num_rows:
        yield batch.slice(lo)


def sketches(docs: DataFrame, words: int, threshold: float) -> DataFrame:
    """doc_id, n_shingles, set_key (of the whole set; null if empty), bands (array of band keys), bits and wide (odd sketches)."""
    bands, rows = band_shape(threshold)
    base = docs.select("doc_id", whole_text().alias("text"))

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room("near_dedup")
        hashes = _Hashes()
        for batch in batches:
            for part in _slices(batch):
                sets = [shingle_set(t, words, hashes) for t in part.column(1).to_pylist()]
                full = [k for k, s in enumerate(sets) if len(s)]
                some = [sets[k] for k in full]
                none = np.empty(0, dtype=np.int64)
                lists = []
                for each in (band_keys(signatures(some), bands, rows).view(np.int64), odd_sketches(some), map(wide_sketch, some)):
                    own = iter(each)
                    found = [next(own) if len(s) else none for s in sets]
                    offsets = pa.array(np.cumsum([0] + [len(x) for x in found]), pa.int32())
                    lists.append(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([none, *found]), pa.int64())))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        *lists,
                    ],
                    ["doc_id", "n_shingles", "set_key", "bands", "bits", "wide"],
                )
            pa.default_memory_pool().release_unused()  # two workers share an executor with the JVM

    return base.mapInArrow(sketch, "doc_id long, n_shingles long, set_key binary, bands array<long>, bits array<long>, wide array<long>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, shingles: the full sets."""

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room("near_dedup")
        hashes = _Hashes()
        for batch in batches:
            for part in _slices(batch):
                found = [shingle_set(t, words, hashes) for t in part.column(1).to_pylist()]
                offsets = pa.array(np.cumsum([0] + [len(x) for x in found]), pa.int32())
                values = pa.array(np.concatenate(found).view(np.int64), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, values)], ["doc_id", "shingles"])
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(sets, "doc_id long, shingles array<long>")


def _enough(common: Column, a: Column, b: Column, percent: int) -> Column:
    return 100 * common >= percent * (a + b - common)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(_enough(common, F.size("sa"), F.size("sb"), percent)).select("a", "b")


def _forest(links: DataFrame) -> DataFrame:
    """The links (a, b) of each partition by union-find: (node, least node reached there)."""

    def shrink(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while parent.setdefault(top, top) != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = root(x), root(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        nodes = [n for n in parent if parent[n] != n]
        for lo in range(0, len(nodes), 65_536):
            some = nodes[lo : lo + 65_536]
            yield pa.RecordBatch.from_arrays([pa.array([root(n) for n in some], pa.int64()), pa.array(some, pa.int64())], ["a", "b"])

    return links.select("a", "b").mapInArrow(shrink, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, label: the least node of each group that the links (a, b) form. Nodes without links have no row.

    Each round shrinks the links within every partition, then replaces both ends of a link by the
    least neighbour of either; it ends when every link leads from a node straight to its label.
    """
    links = written(_forest(links.where("a <> b")), "links")
    while True:
        # least neighbour of every node, itself included; a is less than b in every link
        least = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("low"))
        # b's other neighbours hang on b's least one, and so does b
        hung = links.join(least, links["b"] == least["node"]).select(F.col("low").alias("a"), F.col("b"), F.col("a").alias("c"))
        pairs = hung.select(F.explode(F.array(F.struct("a", "b"), F.struct("a", F.col("c").alias("b")))).alias("p"))
        up = pairs.select("p.a", "p.b").where("a <> b").distinct()
        # a node that is a label of some and hangs on another itself isn't one yet
        low = up.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("low"))
        moved = up.join(low, up["a"] == low["node"], "left").select(F.coalesce("low", "a").alias("a"), "b")
        before, links = links, written(_forest(moved.distinct()), "links")
        discard(before)
        tops = links.select(F.col("a").alias("x")).distinct()
        several = links.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1)
        unsettled = links.select("b").distinct().join(tops, F.col("b") == F.col("x"), "left_semi").limit(1)
        if several.isEmpty() and unsettled.isEmpty():
            return links.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(
                tops.select(F.col("x").alias("node"), F.col("x").alias("label"))
            )


def _stars(members: DataFrame) -> DataFrame:
    """The pairs (a, b) of each bucket's centre with its other members. members: key, rep, n (how many are in the bucket)."""
    met = members.groupBy("rep").agg(F.sum("n").alias("met"))
    centre = F.bitwise_not(F.max(F.struct("met", F.bitwise_not("rep").alias("c")))["c"])  # the least id of those that meet most
    centres = members.select("key", "rep").join(met, "rep").groupBy("key").agg(centre.alias("centre"))
    pairs = members.select("key", "rep").join(centres, "key").where("rep <> centre")
    return pairs.select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct()


def _apart(named: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of a bucket that are in different groups so far and may be similar enough.

    named: key, rep, rows (as how many it counts), label; classes: rep, size, bits, wide. Members of a bucket's largest group
    need not meet each other, so the work is its other members times all of them.
    """
    by_group = named.groupBy("key", "label").agg(F.sum("rows").alias("n"))
    mixed = by_group.groupBy("key").agg(F.max_by("label", "n").alias("main"), F.max("n").alias("most"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"))
    parts = lambda n: F.ceil(n / PART_ROWS).cast("int")
    mixed = mixed.where("groups > 1").select("key", "main", parts(F.col("n") - F.col("most")).alias("few"), parts(F.col("n")).alias("all"))
    mixed = named.drop("rows").join(mixed, "key").join(classes.select("rep", "size", "bits"), "rep").withColumn("rest", F.col("label") != F.col("main"))
    mixed = written(mixed.drop("main"), "mixed-buckets")
    # both sides are cut into parts, and each part of one meets each part of the other in a group of rows of its own
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def pairs(mixed: DataFrame, more: list[str]) -> DataFrame:
        sides = []
        for x, rows, p, q in (("a", mixed.where("rest"), own("few"), each("all")), ("b", mixed, each("few"), own("all"))):
            rows = rows.withColumn("p", p).withColumn("q", q)
            sides.append(rows.select("key", "p", "q", *[F.col(c).alias(f"{c}_{x}") for c in ("rep", "size", "bits", "label", "rest", *more)]))
        return sides[0].join(sides[1], ["key", "p", "q"])

    def few(differ: Column) -> Column:
        return (100 + percent) * differ <= (100 - percent) * (F.col("size_a") + F.col("size_b"))

    differ = sum((F.bit_count(F.get("bits_a", F.lit(k)).bitwiseXOR(F.get("bits_b", F.lit(k)))) for k in range(PARITY // 64)), F.lit(0))
    fits = (
        (~F.col("rest_b") | (F.col("rep_a") < F.col("rep_b")))
        & (F.col("label_a") != F.col("label_b"))
        & (100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b"))
        & few(differ)
    )
    both = F.col("size_a") + F.col("size_b")
    # rows that cannot be in a long pair, or in a short one, stay out of its join
    short = pairs(mixed.where(f"size <= {SHORT}"), []).where(fits & (both <= SHORT))
    long = mixed.where(f"(100 + {percent}) * size > {percent} * {SHORT}").join(classes.select("rep", "wide"), "rep")
    long = pairs(long, ["wide"]).where(fits & (both > SHORT)).where(few(_wide_differ(F.col("wide_a"), F.col("wide_b"))))
    ends = [F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")]
    return short.select(*ends).unionByName(long.select(*ends)).distinct()


def group(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, n_checked, kept: one row per row of docs (doc_id, text).

    component_id is the least doc_id reachable by links, kept whether the document stays.
    n_checked counts the links of its class that were verified on the way: not all it has, since
    pairs within a group that is already formed need no check (copies of one set are no links).
    """
    found = written(sketches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), words, percent / 100), "sketches")
    classes = found.where("set_key IS NOT NULL").groupBy("set_key").agg(
        F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("bits").alias("bits"), F.first("wide").alias("wide"), F.first("n_shingles").alias("size")
    )
    classes = written(classes.where("rep IS NOT NULL"), "classes")

    rows = (1 + F.floor(F.col("size") / PARITY)).cast("int").alias("rows")
    keyed = classes.select("rep", rows, F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = written(keyed.join(shared, "key"), "buckets")  # key, rep, rows, n

    candidates = members.select(F.col("rep").alias("doc_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    sets = _sets(texts.join(candidates, "doc_id", "left_semi"), words)
    sets = sets.groupBy("doc_id").agg(F.min_by("shingles", F.xxhash64("shingles")).alias("shingles"))
    sets = written(sets, "shingle-sets")

    stars = written(_stars(members), "pairs")
    links = written(_verified(stars, sets, percent), "links")
    labels = written(components(links), "labels")

    named = members.join(labels, members["rep"] == labels["node"], "left").select(
        "key", "rep", "rows", F.coalesce("label", "rep").alias("label")
    )
    rest = written(_apart(named, classes, percent).join(stars, ["a", "b"], "left_anti"), "pairs")
    more = written(_verified(rest, sets, percent), "links")
    every = links.unionByName(more)
    labels = written(components(every), "labels")

    ends = every.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_checked"))
    reps = classes.select("set_key", "rep").join(labels, F.col("rep") == F.col("node"), "left").join(ends, "rep", "left")
    reps = reps.select(F.col("set_key").alias("own_key"), F.coalesce("label", "rep").alias("label"), "n_checked")
    out = found.select("doc_id", "n_shingles", "set_key").join(reps, F.col("set_key") == F.col("own_key"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce("n_checked", F.lit(0)).alias("n_checked"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay: one document of each group, with all their columns."""
    own = free("__id", docs.columns)
    gone = group(docs, words, percent).where("NOT kept").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(written(gone, "near-copies"), F.col("doc_id").cast("long") == F.col(own), "left_anti")
