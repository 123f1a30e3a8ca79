"""Coverage formats: directory trees of JSON, LLVM export JSON, lcov traces, line-hit tables."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.files import parsed

_STAT = "struct<count:long,covered:long,notcovered:long,percent:double>"
_SUMMARY = f"struct<lines:{_STAT},functions:{_STAT},regions:{_STAT}>"
LLVM = (
    f"data array<struct<files:array<struct<filename:string,summary:{_SUMMARY}>>,"
    f"functions:array<struct<name:string,count:long,filenames:array<string>>>,totals:{_SUMMARY}>>"
)


def is_llvm(text: Column) -> Column:
    """Whether a report is an LLVM export: a list under data whose first entry has files or functions."""
    return F.get_json_object(text, "$.data[0].files").isNotNull() | F.get_json_object(text, "$.data[0].functions").isNotNull()


def tree_leaves(text: str) -> Iterator[tuple]:
    """(filename, covered, missed, total, percent, coverage) of every file in a tree report; a leaf has a coverage list."""
    todo = [("", json.loads(text))]
    while todo:
        path, node = todo.pop()
        if "coverage" in node:
            yield (path, node.get("linesCovered", 0), node.get("linesMissed", 0), node.get("linesTotal", 0), float(node.get("coveragePercent", 0.0)), list(node["coverage"]))
        for name, child in (node.get("children") or {}).items():
            todo.append((f"{path}/{name}" if path else name, child))


def tree_files(files: DataFrame) -> DataFrame:
    """One row per covered file of the tree reports in files (file, text), with its uncovered line numbers (from 1)."""
    rows = parsed(files, tree_leaves, "filename string, covered long, missed long, total long, percent double, coverage array<int>")
    zero = F.filter(F.transform("coverage", lambda v, i: F.when(v == 0, i + 1)), lambda i: i.isNotNull())
    return rows.withColumn("uncovered", zero)


def _stat(s: str) -> F.Column:
    """covered of a summary: derived from count and notcovered where only those are filled."""
    covered = F.coalesce(F.col(f"{s}.covered"), F.lit(0))
    return F.when(F.col(f"{s}.notcovered").isNotNull() & (covered == 0), F.col(f"{s}.count") - F.col(f"{s}.notcovered")).otherwise(covered)


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def llvm_rows(files: DataFrame) -> DataFrame:
    """file, filename with covered and total of lines, functions and regions, of LLVM exports (file, text)."""
    rows = files.select("file", F.explode(F.from_json("text", LLVM)["data"][0]["files"]).alias("f")).select("file", "f.filename", "f.summary")
    stats = [c for m in ("lines", "functions", "regions") for c in (_stat(f"summary.{m}").alias(f"{m}_covered"), F.col(f"summary.{m}.count").alias(f"{m}_total"))]
    return rows.select("file", "filename", *stats)


def llvm_function_rows(files: DataFrame) -> DataFrame:
    """file, name, count, filename (the first) of every function of LLVM exports (file, text)."""
    rows = files.select("file", F.explode(F.from_json("text", LLVM)["data"][0]["functions"]).alias("f"))
    return rows.select("file", "f.name", "f.count", F.get("f.filenames", F.lit(0)).alias("filename"))


def llvm_files(spark: SparkSession, path: str) -> DataFrame:
    """filename with covered and total of lines, functions and regions."""
    return llvm_rows(_whole(spark, path)).drop("file")


def llvm_functions(spark: SparkSession, path: str) -> DataFrame:
    """name, count, filename (the first) of every function."""
    return llvm_function_rows(_whole(spark, path)).drop("file")


def report_rows(files: DataFrame) -> DataFrame:
    """file, filename, covered, missed, total, percent, uncovered of reports (file, text) of either form.

    An LLVM export has line counts only: its uncovered lines are an empty list.
    """
    llvm = F.coalesce(is_llvm(F.col("text")), F.lit(False))
    tree = tree_files(files.where(~llvm)).select("file", "filename", "covered", "missed", "total", "percent", "uncovered")
    share = F.coalesce(F.round(100.0 * F.try_divide(F.col("lines_covered").cast("double"), F.col("lines_total").cast("double")), 2), F.lit(0.0))
    own = llvm_rows(files.where(llvm)).select(
        "file", "filename", F.col("lines_covered").alias("covered"), (F.col("lines_total") - F.col("lines_covered")).alias("missed"), F.col("lines_total").alias("total"),
        share.alias("percent"), F.array().cast("array<int>").alias("uncovered"),
    )
    return tree.unionByName(own)


def lcov_lines(files: DataFrame) -> DataFrame:
    """file, rec (from 0, in its trace), source, pos, line, hits of the traces in files (file, text).

    A record without lines is one row, without pos, line and hits.
    """
    recs = files.select("file", F.posexplode(F.split("text", "end_of_record")).alias("rec", "body"))
    source = F.trim(F.regexp_extract("body", r"(?m)^SF:(.*)$", 1))
    recs = recs.select("file", "rec", source.alias("source"), "body").where("source <> ''")
    das = recs.select("file", "rec", "source", F.posexplode_outer(F.regexp_extract_all("body", F.lit(r"(?m)^DA:(\d+,\d+)"), F.lit(1))).alias("pos", "da"))
    return das.select("file", "rec", "source", "pos", F.split("da", ",")[0].cast("int").alias("line"), F.split("da", ",")[1].cast("long").alias("hits"))


def lcov_merged(das: DataFrame, dup: str = "sum", root: str = "") -> DataFrame:
    """file (source, relative to root), line, hits of lcov_lines.

    Lines that a record repeats are summed (dup="sum") or the last one counts (dup="last"). Of
    several records of one source the last one counts when summing, as a later record replaces it.
    """
    das = das.withColumn("source", F.regexp_replace("source", f"^{re.escape(root.rstrip('/'))}/" if root else "^$", "")).where("source <> ''")
    if dup == "last":
        best = F.max_by("hits", F.struct("file", "rec", "pos"))
        return das.where("line IS NOT NULL").groupBy(F.col("source").alias("file"), "line").agg(best.alias("hits"))
    # sums of each record first, then the last record's
    sums = das.where("line IS NOT NULL").groupBy("source", "line", "file", "rec").agg(F.sum("hits").alias("hits"))
    last = das.groupBy("source").agg(F.max(F.struct("file", "rec")).alias("l")).select("source", F.col("l.file").alias("file"), F.col("l.rec").alias("rec"))
    return sums.join(last, ["source", "file", "rec"], "left_semi").select(F.col("source").alias("file"), "line", "hits")


def lcov(files: DataFrame, dup: str = "sum", root: str = "") -> DataFrame:
    """file (source, relative to root), line, hits from lcov traces in files (file, text)."""
    return lcov_merged(lcov_lines(files), dup, root)


def lcov_of(hits: DataFrame, file: str) -> DataFrame:
    """The lines of one source, named exactly or by a suffix of its path."""
    return hits.where((F.col("file") == file) | F.endswith(F.col("file"), F.lit("/" + file.lstrip("/"))))


def line_table(files: DataFrame) -> DataFrame:
    """file, line, hits of '<line> <hits> <source>' tables; the last of repeated lines counts, lines without data are left out."""
    rows = files.select("file", F.posexplode(F.split("text", "\n")).alias("pos", "txt"))
    m = lambda k: F.regexp_extract("txt", r"^\s*(\d+)\s+(\d+)\s+(.*)$", k)
    rows = rows.where(F.col("txt").rlike(r"^\s*\d+\s+\d+\s+")).select("file", "pos", m(1).cast("int").alias("line"), m(2).cast("long").alias("hits"))
    order = Window.partitionBy("file", "line").orderBy(F.desc("pos"))
    return rows.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("file", "line", "hits")
