"""What the operators share: the folder every executor sees, written tables, whole texts."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


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
    """df written as Parquet in the shared folder and read again.

    Cuts the lineage: whatever reads the result survives the loss of any executor, and several
    branches can read it without computing it again.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a written table that nothing will read again."""
    _path(df.sparkSession, df.written_path)[0].delete(_path(df.sparkSession, df.written_path)[1], True)


def _path(spark: SparkSession, path: str):
    """The file system of a path, and the path as that system has it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder of the shared folder; none if it isn't there."""
    fs, at = _path(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def mark(spark: SparkSession, path: str) -> None:
    """Puts an empty file into the shared folder, where its name says all there is to say.

    One call of the file system creates it and nothing ever replaces it, so it is there or it isn't.
    """
    fs, at = _path(spark, path)
    fs.create(at, False).close()


def stable(rows: DataFrame, label: str) -> DataFrame:
    """rows such that reading them again gives the same rows in the same order.

    A scan with projections and filters does; what comes out of a shuffle may be ordered
    differently when a lost executor's part is computed again, so that is written first. Row
    numbers given to the result stay with their rows.
    """
    plan = rows._jdf.queryExecution().executedPlan().toString()
    return written(rows, label) if re.search("Exchange|Join|Aggregate|Window|Python|InArrow|InPandas|RDD", plan) else rows


def free(name: str, taken: list[str]) -> str:
    """name, with underscores before it until no column of taken is called so (columns ignore case)."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name = "_" + name
    return name


_KEPT: dict[str, Callable[[], None]] = {}


def keeps(name: str, drop: Callable[[], None]) -> None:
    """Says that an operator keeps something in a Python worker from task to task, and how it is dropped."""
    _KEPT[name] = drop


def make_room(name: str) -> None:
    """Drops what operators other than name keep in this Python worker: Spark hands a worker on from stage to stage."""
    for other, drop in _KEPT.items():
        if other != name:
            drop()


def whole_text(column: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))
