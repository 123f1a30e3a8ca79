"""Written intermediate tables: they cut the lineage and survive the loss of executors."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that spark.checkpoint.dir names.

    A local folder serves only where the setting is missing and driver and executors are one
    process; on a cluster each machine would write to a disk of its own, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "/tmp/checkpoints"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet in the shared folder, and read again."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def bucketed(df: DataFrame, label: str, key: str) -> DataFrame:
    """df written in the shared folder in as many buckets by key as shuffles have partitions, and read again: a join by key doesn't move it."""
    spark = df.sparkSession
    path, n = shared_path(spark, label), int(spark.conf.get(_PARTITIONS))
    name = re.sub(r"\W", "_", path.rsplit("/", 1)[-1])
    df.repartition(n, key).write.bucketBy(n, key).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out.written_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a written table that nothing will read again."""
    delete(df.sparkSession, df.written_path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Bytes of input files for each shuffle partition, and of a shuffle's data that one task reads at most: some hundred MB in a hash table or a sort.
INPUT_BYTES, TASK_BYTES = 4 << 20, 8 << 20
_PARTITIONS, _ADVISORY = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
_UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}


def fit_shuffles(spark: SparkSession, paths: list[str]) -> None:
    """Makes the session's shuffles fine enough for the files at paths, so that what one task holds doesn't grow with them.

    There are more partitions for more input, and adaptive execution puts them together up to
    TASK_BYTES, not up to an equal share of all for each core. What is finer already stays.
    """
    size = 0
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        size += at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    if -(-size // INPUT_BYTES) > int(spark.conf.get(_PARTITIONS)):
        spark.conf.set(_PARTITIONS, str(-(-size // INPUT_BYTES)))
    number, unit = re.fullmatch(r"(\d+)\s*([a-z]*)", spark.conf.get(_ADVISORY).strip().lower()).groups()
    if int(number) * _UNITS.get(unit, 1 << 40) > TASK_BYTES:
        spark.conf.set(_ADVISORY, f"{TASK_BYTES}b")


def escaped(value: str) -> str:
    """A partition's value as it stands in its folder's name: control characters and the marks that Spark escapes as %XX."""
    return "".join(f"%{ord(c):02X}" if c < " " or c in "\"#%'*/:=?\\\x7f{[]^" else c for c in value)
