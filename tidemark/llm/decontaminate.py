r"""Benchmark decontamination by winnowing. Native: DataFrame and SQL functions only.

A window is a run of WINDOW words of a benchmark item; an item of fewer words, but not none, is one
window as a whole. Every run of GRAM words is hashed, and of the hashes in a window the least is
kept. A window that stands in a document has the same least hash there, so no shared window can be
missed. In a document the same least hash serves several windows in a row; those make one
fingerprint: where the first of them starts, how many they are, the hash. Only fingerprints whose
hash the benchmark has too go on. Such a hit is then extended over the windows it stands for: their
words must be a window's words, all of them. Items of fewer than WINDOW words get windows, grams
and least hashes of their own length.

Windows are told apart by their words, not by their items, and items by the lists of windows they
share: a phrase that all items begin with is one row. Documents with the same lists get their items
from one row, too. The benchmark's windows are broadcast while there are BROADCAST_WINDOWS of them
at most. Beyond that, fingerprints without texts are joined by shuffle, and only the texts of
documents with a hit are moved.

Defined results. Words are runs of letters a-z (A-Z lower-cased), 0-9 and non-ASCII characters. A
null text has no words. Rows that repeat an id get a result each. Items that repeat an id are one
item; an item without an id counts for the hits and isn't listed. Without items, or without
documents, nothing is hit. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stable, whole_text, written

WINDOW = 10
GRAM = 5
#: Windows of the benchmark that are broadcast at most: some 30 MB.
BROADCAST_WINDOWS = 200_000

#: Words of one part of a document, so that a hit moves a part and not a long text.
PART_WORDS = 128

_RUN = "struct<length:int,start:int,n:int,least:bigint>"
_SPAN = "struct<start:int,end:int>"


def words(text: Column) -> Column:
    """All words of a text, in an array."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _neighbours(of: str, width: int, join) -> Column:
    """One value for each run of width elements of the array column of: join(the elements)."""
    starts = F.slice(of, 1, F.greatest(F.size(of) - (width - 1), F.lit(0)))
    if width == 1:
        return F.transform(starts, lambda x: join(x))
    return F.transform(starts, lambda x, i: join(x, *[F.get(of, i + k) for k in range(1, width)]))


def _with_least(rows: DataFrame, lengths: list[int], gram: int) -> DataFrame:
    """rows (__words) with __least<n> for each length n: the least gram hash of every window of n words."""
    rows = rows.withColumn("__hash", F.transform("__words", lambda w: F.xxhash64(w)))
    for k in sorted({min(gram, n) for n in lengths}):
        rows = rows.withColumn(f"__gram{k}", _neighbours("__hash", k, F.xxhash64))
    for n in lengths:
        k = min(gram, n)
        least = (lambda x: x) if n == k else F.least
        rows = rows.withColumn(f"__least{n}", _neighbours(f"__gram{k}", n - k + 1, least))
    return rows


def _with_fingerprints(rows: DataFrame, lengths: list[int], gram: int) -> DataFrame:
    """rows (__words) with __runs: windows in a row that have the same least hash."""
    names = rows.columns
    rows = _with_least(rows, lengths, gram)

    def changes(least: str) -> Column:
        first = F.transform(least, lambda x, i: F.when((i == 0) | (x != F.get(least, i - 1)), i))
        return F.filter(first, lambda i: i.isNotNull())

    rows = rows.withColumns({f"__first{n}": changes(f"__least{n}") for n in lengths})

    def runs(n: int) -> Column:
        first, least = f"__first{n}", f"__least{n}"
        end = lambda j: F.coalesce(F.get(first, j + 1), F.size(least))
        run = lambda i, j: F.struct(F.lit(n), i, end(j) - i, F.get(least, i)).cast(_RUN)
        return F.transform(first, run)

    return rows.select(*names, F.concat(F.array().cast(f"array<{_RUN}>"), *[runs(n) for n in lengths]).alias("__runs"))


def index(items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame, list[int]]:
    """The distinct windows of a benchmark (window, length, least, list), the lists of items (list, items), all lengths.

    A window is its words, joined by blanks; least is the least hash of its grams; its list names all
    items that hold it. Rows (item_id, text).
    """
    rows = items.select(F.col("item_id").cast("string").alias("item"), words(whole_text()).alias("__all"))
    rows = rows.where(F.size("__all") > 0).withColumn("length", F.least(F.size("__all"), F.lit(window)))
    rows = written(rows, "benchmark-words")
    lengths = sorted(r["length"] for r in rows.select("length").distinct().collect())  # as many as a window has words at most
    starts = F.explode(F.sequence(F.lit(1), F.size("__all") - F.col("length") + 1)).alias("__at")
    rows = rows.select("item", "length", "__all", starts)
    found = rows.select("item", "length", F.array_join(F.slice("__all", F.col("__at"), F.col("length")), " ").alias("window"))
    found = found.groupBy("window", "length").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = _with_least(found.withColumn("__words", F.split("window", " ")), lengths, gram)
    own = [F.when(F.col("length") == n, F.get(f"__least{n}", F.lit(0))) for n in lengths]
    least = F.coalesce(F.lit(None).cast("long"), *own).alias("least")
    found = found.select("window", "length", least, F.sha2(F.to_json("items"), 256).alias("list"), "items")
    found = written(found, "benchmark-windows")
    return found.drop("items"), found.select("list", "items").dropDuplicates(["list"]), lengths


def _in_parts(rows: DataFrame, window: int) -> DataFrame:
    """rows (__all) in parts of PART_WORDS words and those of the windows that start there: __part, __words, n_words."""
    parts = F.sequence(F.lit(0), F.floor((F.greatest(F.size("__all"), F.lit(1)) - 1) / PART_WORDS).cast("int"))
    cut = F.transform(parts, lambda k: F.slice("__all", k * PART_WORDS + 1, F.lit(PART_WORDS + window - 1)))
    return rows.select("__row", "doc_id", F.size("__all").cast("long").alias("n_words"), F.posexplode(cut).alias("__part", "__words"))


def _occurrences(rows: DataFrame, windows: DataFrame, lengths: list[int], gram: int, small: bool) -> DataFrame:
    """Per row one line without a place, and one for each window that stands in it (start, end, list)."""
    marks = windows.select(F.col("least").alias("mark")).distinct()
    keep = ["__row", "doc_id", "n_words", "__part", "__words"]
    rows = _in_parts(rows, max(lengths))
    printed = _with_fingerprints(rows, lengths, gram)
    none = F.array(F.struct(F.lit(0), F.lit(-1), F.lit(0), F.lit(None).cast("long"))).cast(f"array<{_RUN}>")
    none = F.when(F.col("__part") == 0, none).otherwise(F.array().cast(f"array<{_RUN}>"))
    run = F.explode(F.concat(none, F.col("__runs"))).alias("run")
    if small:
        every = printed.select(*keep, run)
        hits = every.join(F.broadcast(marks), F.col("run.least") == F.col("mark"), "left")
        hits = hits.where("run.start < 0 OR mark IS NOT NULL")
    else:
        thin = printed.select("__row", "__part", run).where("run.least IS NOT NULL")
        thin = thin.join(marks.hint("merge"), F.col("run.least") == F.col("mark"), "left_semi")
        thin = thin.groupBy("__row", "__part").agg(F.collect_list("run").alias("__runs"))
        hits = rows.join(thin, ["__row", "__part"], "left")
        hits = hits.select(*keep, F.explode(F.concat(none, F.coalesce("__runs", F.array().cast(f"array<{_RUN}>")))).alias("run"))

    # the hit is extended: each of the windows it stands for is looked up by all its words
    start, n, length = (F.col(f"run.{c}") for c in ("start", "n", "length"))
    at = F.when(start < 0, F.array(F.lit(-1))).otherwise(F.sequence(start, start + n - 1))
    hits = hits.select(*keep, length.alias("length"), F.explode(at).alias("at"))
    # rows without a place have a key of their own that no window has
    text = F.when(F.col("at") >= 0, F.array_join(F.slice("__words", F.col("at") + 1, F.col("length")), " "))
    start = F.when(F.col("at") >= 0, F.col("at") + F.col("__part") * PART_WORDS)
    text = F.coalesce(text, F.concat(F.lit("\n"), F.col("__row")))
    hits = hits.select("__row", "doc_id", "n_words", start.alias("start"), (start + F.col("length")).alias("end"), text.alias("text"))
    known = windows.select("window", "list")
    known = F.broadcast(known) if small else known.hint("merge")
    return hits.join(known, F.col("text") == F.col("window"), "left").where("start IS NULL OR list IS NOT NULL")


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, broadcast: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row per row of docs (doc_id, text), against items (item_id, text).

    doc_id, n_words, n_hit (words inside of a shared window), spans (array of start and end, the end
    exclusive, of the stretches of such words), items (sorted ids of the items that share a window).
    """
    windows, lists, lengths = index(items.select("item_id", "text"), window, gram)
    rows = docs.select("doc_id", whole_text().alias("text"))
    rows = stable(rows, "documents").withColumn("__row", F.monotonically_increasing_id())
    rows = rows.select("__row", "doc_id", words(F.col("text")).alias("__all"))

    if lengths:
        found = _occurrences(rows, windows, lengths, gram, windows.count() <= broadcast)
        place = F.when(F.col("start").isNotNull(), F.struct("start", "end")).cast(_SPAN)
        found = found.groupBy("__row").agg(
            F.max("doc_id").alias("doc_id"),
            F.max("n_words").alias("n_words"),
            F.array_sort(F.collect_set(place)).alias("places"),
            F.array_sort(F.collect_set("list")).alias("lists"),
        )
    else:
        found = rows.select("doc_id", F.size("__all").cast("long").alias("n_words"), F.array().cast(f"array<{_SPAN}>").alias("places"))
        found = found.withColumn("lists", F.array().cast("array<string>"))
    found = written(_with_spans(found).select("doc_id", "n_words", "spans", "lists"), "contaminated-spans")

    # each combination of lists is put together once, however many documents have it
    hit = found.where(F.size("lists") > 0).withColumn("key", F.sha2(F.array_join("lists", ","), 256))
    sets = hit.select("key", "lists").dropDuplicates(["key"]).select("key", F.explode("lists").alias("list")).join(lists, "list")
    sets = sets.select("key", F.explode_outer("items").alias("item")).groupBy(F.col("key").alias("set"))
    sets = sets.agg(F.array_sort(F.collect_set("item")).alias("items"))
    hit = hit.join(sets, F.col("key") == F.col("set")).select("doc_id", "n_words", "spans", "items")
    clean = found.where(F.size("lists") == 0).select("doc_id", "n_words", "spans", F.array().cast("array<string>").alias("items"))
    length = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return clean.unionByName(hit).select("doc_id", "n_words", length.alias("n_hit"), "spans", "items")


def _with_spans(rows: DataFrame) -> DataFrame:
    """rows (places, sorted) with spans: the stretches of words that the places cover."""

    def own(x: Column, i: Column) -> Column:
        start = F.greatest(x["start"], F.get("places", i - 1)["end"])  # what the place before covers needn't be listed again
        return F.when(start < x["end"], F.sequence(start, x["end"] - 1)).otherwise(F.array().cast("array<int>"))

    rows = rows.withColumn("__hit", F.array_sort(F.array_distinct(F.flatten(F.transform("places", own)))))
    kept = lambda found: F.filter(found, lambda x: x.isNotNull())
    first = F.transform("__hit", lambda x, i: F.when((i == 0) | (F.get("__hit", i - 1) < x - 1), x))
    last = F.transform("__hit", lambda x, i: F.when((i == F.size("__hit") - 1) | (F.get("__hit", i + 1) > x + 1), x + 1))
    return rows.withColumn("spans", F.arrays_zip(kept(first).alias("start"), kept(last).alias("end")).cast(f"array<{_SPAN}>")).drop("__hit")


def drop_contaminated(docs: DataFrame, items: DataFrame, share: float = 0.0) -> DataFrame:
    """The rows of docs, with all their columns, of which at most this share of the words is hit.

    Rows are told apart by doc_id: where several rows share one, the worst of them decides.
    """
    bad = scan(docs, items).where(F.col("n_hit") > share * F.col("n_words")).select(F.col("doc_id").alias("__contaminated")).distinct()
    return docs.join(written(bad, "contaminated"), F.col("doc_id").eqNullSafe(F.col("__contaminated")), "left_anti")
