r"""Document fingerprints by one-permutation MinHash. Native: DataFrame and SQL functions only.

Every shingle of five words is hashed once. The top bits of a hash choose one of BINS bins and the
rest is its rank there; a bin keeps its smallest. Empty bins are filled by optimal densification:
each probes the other bins in an order of its own, the same for every document, and takes the
first that isn't empty. BITS low-order bits of each bin are stored, packed into 64-bit words.
Likeness is the share of equal bins, corrected for those that are equal by chance (2^-BITS).

The smallest rank of every bin comes from one sort: a largest possible rank is added for each
bin, so in sorted order a bin's smallest stands right after the bin before has ended.

Defined results. A null text is empty. Words are what stands between blanks, tabs and line ends,
lower-cased; a text of fewer words than a shingle, the empty one too, is one shingle. Equal texts
have equal fingerprints. Rows that repeat an id are ordered by a hash of their text, a null id
comes before all others, and a single row is its own next document. Other columns are ignored.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import whole_text

WORDS = 5
BINS = 512
BITS = 4
#: Probes written out before the closed form takes over; only the speed depends on it.
PROBES = 12
#: Rows of one block of neighbouring ids on average, at least; and about how many blocks there are at most.
BLOCK_ROWS, BLOCKS = 2000, 1 << 18

_RANK_BITS = 64 - BINS.bit_length() + 1
_LAST = (1 << _RANK_BITS) - 1
_PER_WORD = 64 // BITS


def _mix(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & (2**64 - 1)
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
    return x ^ (x >> 31)


# the order in which bin p probes the bins: by (SCALE[p] * bin + SHIFT[p]) mod PRIME
PRIME = 2**31 - 1
SCALE = [_mix(2 * p) % (PRIME - 1) + 1 for p in range(BINS)]
SHIFT = [_mix(2 * p + 1) % PRIME for p in range(BINS)]


def probe_order(p: int) -> list[int]:
    return sorted(range(BINS), key=lambda j: (SCALE[p] * j + SHIFT[p]) % PRIME)


def _array(values: list[int]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def with_fingerprint(rows: DataFrame, text: str, out: str) -> DataFrame:
    """rows with a column out: the packed fingerprint (array of 64-bit words) of the column text."""
    names = [*rows.columns]
    words = F.array_remove(F.split(F.lower(F.col(text)), "[ \t-\r]+"), "")
    rows = rows.withColumn("__w", F.transform(words, lambda w: F.xxhash64(w)))
    starts = F.slice("__w", 1, F.greatest(F.size("__w") - (WORDS - 1), F.lit(0)))
    shingle = lambda x, i: F.xxhash64(x, *[F.get("__w", i + k) for k in range(1, WORDS)])
    own = F.when(F.size("__w") < WORDS, F.array(F.xxhash64("__w"))).otherwise(F.transform(starts, shingle))
    ends = _array([(p - BINS // 2) * (_LAST + 1) + _LAST for p in range(BINS)])
    rows = rows.withColumn("__s", F.sort_array(F.concat(own, ends)))

    is_end = lambda x: x.bitwiseAND(F.lit(_LAST)) == F.lit(_LAST)
    firsts = F.filter("__s", lambda x, i: (i == 0) | is_end(F.get("__s", i - 1)))
    rows = rows.withColumn("__b", F.transform(firsts, lambda x: F.when(~is_end(x), x)))
    full = F.filter(F.transform("__b", lambda x, p: F.when(x.isNotNull(), p)), lambda p: p.isNotNull())
    rows = rows.withColumn("__f", F.when(F.exists("__b", lambda x: x.isNull()), full))

    orders = [probe_order(p)[:PROBES] for p in range(BINS)]
    probes = [_array([o[t] for o in orders]) for t in range(PROBES)]
    scale, shift = _array(SCALE), _array(SHIFT)

    def filled(x: Column, p: Column) -> Column:
        # the first full bin in the order of p; ranks are below 2^31, so rank and bin fit one number
        ranked = F.transform("__f", lambda j: (F.get(scale, p) * j.cast("long") + F.get(shift, p)) % PRIME * BINS + j)
        # the second mention of __f keeps Spark from computing it anew inside this lambda
        last = F.when(F.size("__f") > 0, F.array_min(ranked) % BINS).cast("int")
        taken = F.coalesce(*[F.get("__b", F.get(q, p)) for q in probes], F.get("__b", last))
        # a rank taken over is mixed with its new bin: else one rank in many bins would be alike by chance in all of them
        return F.coalesce(x, F.xxhash64(taken, p)).bitwiseAND(F.lit((1 << BITS) - 1))

    rows = rows.withColumn("__d", F.transform("__b", filled))
    word = F.lit(0).cast("long")
    at = F.sequence(F.lit(0), F.lit(BINS - _PER_WORD), F.lit(_PER_WORD))

    def packed(i: Column) -> Column:
        acc = word
        for k in range(_PER_WORD):
            acc = F.shiftleft(acc, BITS).bitwiseOR(F.get("__d", i + k))
        return acc

    return rows.select(*names, F.transform(at, packed).alias(out))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles, 0 to 1, of two packed fingerprints."""
    ones = int("1".rjust(BITS, "0") * _PER_WORD, 2)
    differ = lambda x, y: x.bitwiseXOR(y)
    any_bit = lambda d: d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseOR(F.shiftrightunsigned(d, 3))  # noqa: E731,E501
    unlike = F.zip_with(a, b, lambda x, y: F.bit_count(any_bit(differ(x, y)).bitwiseAND(F.lit(ones))))
    share = 1 - F.aggregate(unlike, F.lit(0), lambda s, n: s + n) / F.lit(float(BINS))
    chance = 2.0**-BITS
    return F.greatest(F.lit(0.0), (share - chance) / (1 - chance))


def as_string(packed: Column) -> Column:
    """A packed fingerprint as lower-case hexadecimal digits."""
    return F.array_join(F.transform(packed, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, packed, fingerprint: one row per row of docs (doc_id, text)."""
    rows = with_fingerprint(docs.select("doc_id", whole_text().alias("text")), "text", "packed")
    return rows.select("doc_id", "packed", as_string(F.col("packed")).alias("fingerprint"))


def _texts(values: list[str]) -> Column:
    """A constant array, however long, as one literal."""
    return F.split(F.lit(",".join(values)), ",")


def _count_up_to(bounds: list[str], key: Column) -> Column:
    """How many of the sorted bounds are at most key (which the first is), in about 3 * len(bounds) ** (1 / 3) steps."""
    wide = max(1, ceil(len(bounds) ** (1 / 3)))
    below = lambda xs: F.size(F.filter(xs, lambda b: b <= key))
    high = F.greatest(below(_texts(bounds[:: wide * wide])) - 1, F.lit(0)) * wide
    part = (high + F.greatest(below(F.slice(_texts(bounds[::wide]), high + 1, F.lit(wide))) - 1, F.lit(0))) * wide
    return part + below(F.slice(_texts(bounds), part + 1, F.lit(wide)))


def _ordered(value: Column) -> Column:
    """A long as 16 hexadecimal digits that sort as it does."""
    return F.lpad(F.hex(value.bitwiseXOR(F.lit(-(2**63)))), 16, "0")


def with_next(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows (doc_id, text, ...) with next_<c> for each c in columns: its value in the next document by ascending doc_id.

    Documents are ordered by a key of their id and, for those of one id, a hash of their text.
    Blocks of neighbouring keys start at the least key and at every key that a hash picks, one in
    BLOCK_ROWS, or fewer so that there are about BLOCKS: ids that many rows share, or lack, fill
    many blocks too. The first row of a block is sent to the block before it as well (that of the
    first block to the last), so each block finds the next of all its rows on its own. The driver
    only ever holds the blocks' first keys.
    """
    key = F.concat(_ordered(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))), _ordered(F.xxhash64("text")))
    keys = rows.select(key.alias("key"))
    n, least = keys.agg(F.count(F.lit(1)), F.min("key")).first()
    one_in = max(BLOCK_ROWS, n // BLOCKS)
    picked = keys.where(F.pmod(F.xxhash64("key"), F.lit(one_in)) == 0).distinct().collect()
    starts = sorted({least or "", *(r["key"] for r in picked)})

    keyed = rows.withColumn("__key", key).withColumn("__block", _count_up_to(starts, F.col("__key")) - 1)
    home = lambda b, late: F.struct(b.cast("int").alias("block"), F.lit(late).alias("late"))
    own = home(F.col("__block"), 0)
    also = home(F.pmod(F.col("__block") - 1, F.lit(len(starts))), 1)
    is_first = F.col("__key") == F.get(_texts(starts), F.col("__block"))
    sent = keyed.withColumn("__home", F.explode(F.when(is_first, F.array(own, also)).otherwise(F.array(own))))
    order = Window.partitionBy("__home.block").orderBy("__home.late", "__key")
    found = sent.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return found.where("__home.late = 0").drop("__key", "__block", "__home")
