"""Text files as frames, and parsers over whole files: file -> rows, many files in parallel.

Where a format needs state from line to line (braces, scopes), a parser sees one whole file on an
executor; no shuffle is needed and the driver never sees a text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SKIPPED_FOLDERS = ("target", ".git", "node_modules")


def file_path(column: str = "_metadata.file_path") -> Column:
    """A file's path as it is named: Spark gives it as a URL, blanks and such as %XX."""
    return F.url_decode(F.replace(F.col(column), F.lit("+"), F.lit("%2B")))


def whole_files(spark: SparkSession, root: str, glob: str = "*.rs", skip: Iterable[str] = SKIPPED_FOLDERS) -> DataFrame:
    """file (relative to root), text of every matching file under root, without the skipped folders."""
    found = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    base = "^.*?" + re.escape(root.rstrip("/").split("://")[-1]) + "/"
    out = found.select(F.regexp_replace(file_path(), base, "").alias("file"), F.col("value").alias("text"))
    for folder in skip:
        out = out.where(~F.array_contains(F.split("file", "/"), folder))
    return out


#: Rows, and characters of texts read, after which a parser's rows are handed on.
ROWS, CHARS = 4096, 4_000_000


def frames(batches: Iterator[pd.DataFrame], parser: Callable[[str], Iterable[tuple]], names: list[str], keep: Sequence[str] = ()) -> Iterator[pd.DataFrame]:
    """file, the columns to keep and the named columns of what parser makes of the texts of batches (file, text): many small files are one frame."""
    own = ["file", *keep]
    rows, chars = [], 0
    for batch in batches:
        for text, *of_file in zip(batch["text"], *(batch[c] for c in own)):
            chars += len(text or "")
            for row in parser(text or ""):
                rows.append((*of_file, *row))
                if len(rows) >= ROWS or chars >= CHARS:
                    yield pd.DataFrame(rows, columns=[*own, *names], dtype=object)
                    rows, chars = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=[*own, *names], dtype=object)


def parsed(files: DataFrame, parser: Callable[[str], Iterable[tuple]], columns: str, keep: Sequence[str] = ()) -> DataFrame:
    """file and the columns of every row that parser makes of a file's text; keep: columns of files, strings, that go with each row."""
    names = [c.strip().split(" ")[0] for c in columns.split(", ")]
    kept = "".join(f", {c} string" for c in keep)
    return files.select("file", "text", *keep).mapInPandas(lambda batches: frames(batches, parser, names, keep), f"file string{kept}, {columns}")


def lines(files: DataFrame) -> DataFrame:
    """file, line_no (from 1), txt."""
    return files.select("file", F.posexplode(F.split("text", "\n")).alias("p", "txt")).select("file", (F.col("p") + 1).alias("line_no"), "txt")


def matching_lines(files: DataFrame, needle: str) -> DataFrame:
    """The lines that contain needle."""
    return lines(files).where(F.contains("txt", F.lit(needle)))


def builds(spark: SparkSession, root: str) -> DataFrame:
    """tag of coverage_<tag>.json files under root, last first. A root that is one file has one tag: its name, or local for an index."""
    if root.endswith(".json"):
        name = F.regexp_extract("path", r"([^/]+)[.]json$", 1)
        found = spark.read.format("binaryFile").load(root).select("path")
        return found.select(F.when(name == "index", "local").otherwise(name).alias("tag"))
    found = spark.read.format("binaryFile").option("pathGlobFilter", "coverage_*.json").load(root).select("path")
    return found.select(F.regexp_extract("path", r"coverage_(.+)\.json$", 1).alias("tag")).orderBy(F.desc("tag"))


def runs(paths: DataFrame) -> DataFrame:
    """paths (run, name): runs that hold a final or a coverage report, with their numbers of files, last first."""
    report = F.col("name").isin("final_report.json", "coverage_run_report.json")
    out = paths.groupBy("run").agg(F.count(F.lit(1)).alias("files"), F.bool_or(report).alias("complete"))
    return out.where("complete").drop("complete").orderBy(F.desc("run"))


def tree(paths: DataFrame, collapsed: Iterable[str] = SKIPPED_FOLDERS) -> DataFrame:
    """paths (run, path: of its files, relative) as what a listing shows: run, path, is_folder, files (in it, at any depth), collapsed.

    Folders are shown with their files' number; of those that are collapsed nothing inside is shown.
    """
    parts = F.split("path", "/")
    hidden = F.filter(F.sequence(F.lit(1), F.size(parts)), lambda k: F.element_at(parts, k).isin(*collapsed) & (k < F.size(parts)))
    rows = paths.select("run", parts.alias("parts"), F.get(hidden, F.lit(0)).alias("cut"))
    upto = F.explode(F.sequence(F.lit(1), F.coalesce("cut", F.size("parts")))).alias("depth")
    rows = rows.select("run", "parts", "cut", upto)
    shown = rows.select("run", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("path"), (F.col("depth") < F.size("parts")).alias("is_folder"), (F.col("depth") == F.col("cut")).alias("collapsed"))
    return shown.groupBy("run", "path").agg(F.bool_or("is_folder").alias("is_folder"), F.count_if("is_folder").alias("files"), F.coalesce(F.bool_or("collapsed"), F.lit(False)).alias("collapsed"))
