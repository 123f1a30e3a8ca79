"""Tables at rest: a root folder with one Parquet table per name, rewritten whole or by source file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.storage import delete, discard, escaped, written

# The tables that each half of the data owns; a rewrite of one half leaves the other alone.
CODE_TABLES = ("fn", "calls", "implements", "guard_span", "routes", "gate")
TEST_TABLES = (
    "connector", "flow", "flow_config", "supports_flow", "endpoint", "maps_to", "spec_file", "test_case", "tests_flow", "calls_endpoint", "feature_list", "in_list",
)


class Catalog:
    """Table name -> frame under root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def replace(self, name: str, rows: DataFrame, by: str | None = None) -> None:
        """The whole table anew, in a folder for each value of by if given.

        rows may be made from the table itself: they are written beside it first.
        """
        fresh = written(rows, name)
        out = fresh.write.mode("overwrite")
        (out.partitionBy(by) if by else out).parquet(self.path(name))
        discard(fresh)

    def replace_files(self, name: str, rows: DataFrame, by: str = "source_file", files: DataFrame | None = None) -> None:
        """Only the rows of some source files: those of files (a column by), or else those that rows speak of; all others stay.

        A file that gives no rows any more has none afterwards.
        """
        fresh = written(rows, name)
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(self.path(name))
        if files is not None:
            held = self.spark.read.schema(f"`{by}` string").option("basePath", self.path(name)).parquet(self.path(name)).select(by).distinct()
            empty = files.select(by).distinct().join(held, by).join(fresh.select(by).distinct(), by, "left_anti")
            for row in empty.collect():  # at most the files that were handed in
                delete(self.spark, f"{self.path(name)}/{by}={escaped(row[0])}")
        discard(fresh)

    def save_edges(self, name: str, edges: DataFrame, nodes: DataFrame, key: str = "symbol") -> None:
        """Edges (caller, callee, ...) between known nodes only."""
        known = nodes.select(F.col(key).alias("__known")).distinct()
        kept = edges.join(known, F.col("caller") == F.col("__known"), "left_semi").join(known, F.col("callee") == F.col("__known"), "left_semi")
        self.replace(name, kept)


def save_documents(rows: DataFrame, path: str, key: str | None = None) -> None:
    """One JSON object per row, sorted by key if there is one."""
    (rows.sortWithinPartitions(key) if key else rows).select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def save_listing(rows: DataFrame, path: str) -> None:
    """Lines (line, shown, txt) of one function as text: number, hits, source, in order."""
    text = F.format_string("%6d %10s  %s", "line", "shown", F.coalesce("txt", F.lit("")))
    rows.orderBy("line").select(text.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def artifact_kind(name: F.Column) -> F.Column:
    """What a run's file is, by its name."""
    low = F.lower(name)
    return (
        F.when(F.contains(low, F.lit("final_report")), "final_report").when(F.contains(low, F.lit("coverage_run_report")), "coverage_report")
        .when(F.contains(low, F.lit("line_hits")), "line_hits").when(F.endswith(low, F.lit(".info")) | F.contains(low, F.lit("lcov")), "lcov")
        .when(F.contains(low, F.lit("source_index")), "source_index").when(F.endswith(low, F.lit(".log")) | F.contains(low, F.lit("terminal")), "log")
        .when(F.contains(low, F.lit("input")) | F.contains(low, F.lit("flow")), "path_flow").otherwise("other")
    )
