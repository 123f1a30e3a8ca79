"""Exact dedup: a persistent digest index, bucketed and sorted by hash.

New rows are compared with the index by a sort-merge anti-join on the SHA-256 digest, and only
digests not seen before are appended. Native: DataFrame and SQL functions only.

Defined results. A null text is an empty text. Of equal texts the row with the largest doc_id
stays (null ids come last); rows that repeat both id and text count in group_size, and exactly one
of them is kept. Digests that an earlier batch indexed keep the id stored then, and no row of the
new batch is kept for them. A batch that comes again under its name gets the same result again.
An empty table gives an empty result. Other columns are ignored, so names such as digest or
keep_id in the input do no harm.
"""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import free, mark, names_in, shared_path, whole_text, written

#: Digests that one bucket is to hold (about 100 MB), and the least number of buckets.
BUCKET_ROWS, LEAST_BUCKETS = 2_000_000, 32
_WHOLE = re.compile(r"generation-(\d+)-of-(\d+)\.whole")


class DigestIndex:
    """A Parquet table of seen digests, clustered and sorted by digest, at a path that outlives sessions.

    Give path to continue an index; without it a new one starts in the shared folder. The number
    of buckets sets how many tasks an anti-join with the index can use. It follows from
    expected_rows unless given and keeps; asking for another one is an error. compact() changes it.

    A generation is a folder whose name holds its number and its buckets, and it counts from the
    moment that an empty file of its name is put beside it. Nothing is ever replaced or renamed, so
    wherever a driver stops, the highest generation that counts is whole. A path that holds
    generations of which none counts is no index, and opening it is an error.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, expected_rows: int = 0):
        self.spark = spark
        self.path = path or shared_path(spark, "digest-index")
        self.name = "digest_index_" + hashlib.sha256(self.path.encode()).hexdigest()[:16]
        names = names_in(spark, self.path)
        whole = sorted((int(m[1]), int(m[2])) for m in map(_WHOLE.fullmatch, names) if m)
        if whole:
            self.generation, self.buckets = whole[-1]
            if buckets not in (None, self.buckets):
                raise ValueError(f"the index at {self.path} has {self.buckets} buckets, not {buckets}; compact() changes that")
        elif names:
            raise ValueError(f"{self.path} holds files, but no generation of a digest index that is whole")
        else:
            self.generation, self.buckets = 0, buckets or max(LEAST_BUCKETS, -(-expected_rows // BUCKET_ROWS))
            mark(spark, self._folder(0, self.buckets) + ".whole")
        self._open()

    def _folder(self, generation: int, buckets: int) -> str:
        return f"{self.path}/generation-{generation}-of-{buckets}"

    def _open(self) -> None:
        # only the catalogue's entry goes: the files lie at a location of their own
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        self.spark.sql(self._definition(self.name, self.generation, self.buckets))

    def _definition(self, name: str, generation: int, buckets: int) -> str:
        return (
            f"CREATE TABLE {name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet CLUSTERED BY (digest) "
            f"SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self._folder(generation, buckets)}'"
        )

    def seen(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, rows: DataFrame) -> None:
        """Adds rows (digest, keep_id, batch), one file for each bucket."""
        rows = rows.select("digest", "keep_id", "batch").repartition(self.buckets, "digest")
        rows.write.insertInto(self.name)

    def compact(self, buckets: int | None = None) -> None:
        """Rewrites the index with one sorted file for each bucket, in another number of buckets if given.

        Every append adds a file to each bucket; while a bucket has one file only, joins read it
        in order. The new files count once they are whole; the old ones stay for whoever reads them.
        What a compaction that stopped has left is written over. One index has one writer at a time.
        """
        buckets, generation = buckets or self.buckets, self.generation + 1
        fresh = f"{self.name}_{generation}"
        self.spark.sql(f"DROP TABLE IF EXISTS {fresh}")
        self.spark.sql(self._definition(fresh, generation, buckets))
        self.seen().repartition(buckets, "digest").write.insertInto(fresh, overwrite=True)
        self.spark.sql(f"DROP TABLE {fresh}")
        mark(self.spark, self._folder(generation, buckets) + ".whole")
        self.generation, self.buckets = generation, buckets
        self._open()


def decisions(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, digest, copies.

    Appends the new digests to index under the name batch (a fresh one unless given). A name that
    the index knows means that its rows come again, after a restart for instance: what that batch
    put into the index still counts as new; a batch that stopped on the way must come again under its
    name, as parts of it may stand in the index. copies counts the rows with this id and this text,
    group_size those of this batch with this text.
    """
    keyed = docs.select("doc_id", F.unhex(F.sha2(whole_text(), 256)).alias("digest"))
    keyed = written(keyed.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("copies")), "digests")
    groups = keyed.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))

    batch = batch or uuid.uuid4().hex
    unseen = groups.join(index.seen().select("digest").hint("merge"), "digest", "left_anti")
    index.append(unseen.select("digest", "keep_id", F.lit(batch).alias("batch")))

    # written without buckets: the join below then exchanges both sides, and Spark can split a
    # digest that a third of all rows share
    settled = index.seen().select("digest", "keep_id", (F.col("batch") == batch).alias("fresh"))
    settled = written(groups.drop("keep_id").join(settled.hint("merge"), "digest"), "digest-groups")
    copy = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    return (
        keyed.join(settled, "digest")
        .select("doc_id", "keep_id", "group_size", "fresh", "digest", "copies", copy)
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("fresh") & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
            "digest",
            "copies",
        )
    )


def decisions_in_turn(docs: DataFrame, index: DigestIndex, parts: list, batch: str | None = None) -> DataFrame:
    """decisions() over docs in several batches against one index, one for each condition in parts, in their order.

    The conditions split the rows; group_size counts the rows of all batches. batch is the first
    part of the batches' names.
    """
    rows, batch = None, batch or uuid.uuid4().hex
    for k, condition in enumerate(parts):
        some = decisions(docs.where(condition), index, f"{batch}-{k}")
        rows = some if rows is None else rows.unionByName(some)
    rows = written(rows.drop("group_size"), "digest-decisions")
    sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    return rows.join(sizes, "digest").select("doc_id", "keep_id", "group_size", "kept", "digest", "copies")


def drop_copies(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns as they came.

    Rows that repeat both id and text are one document; any one of them is returned.
    """
    own, count = free("__own", docs.columns), free("__copies", docs.columns)
    keep = decisions(docs, index, batch).where("kept").select(
        F.col("doc_id").alias(free("__id", docs.columns)), F.col("digest").alias(free("__digest", docs.columns)), F.col("copies").alias(count)
    )
    named = docs.withColumn(own, F.unhex(F.sha2(whole_text(), 256)))
    on = named["doc_id"].eqNullSafe(keep[keep.columns[0]]) & (named[own] == keep[keep.columns[1]])
    stays = named.join(keep, on)
    single = stays.where(F.col(count) == 1)
    repeated = stays.where(F.col(count) > 1).dropDuplicates(["doc_id", own])
    return single.unionByName(repeated).select(*docs.columns)
