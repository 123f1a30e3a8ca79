"""Coverage questions by name, over reports at rest, as a client asks them: a name and arguments in, rows out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import coverage as C


class Reports:
    """Coverage tables (files, funcs, lines, each with a column tag), the parts of a tag kept in memory once asked for.

    Tables partitioned by tag are read for the tag alone.
    """

    def __init__(self, files: DataFrame, funcs: DataFrame, lines: DataFrame):
        self.all = {"files": files, "funcs": funcs, "lines": lines}
        self._kept: dict[tuple[str, str], DataFrame] = {}

    def part(self, name: str, tag: str) -> DataFrame:
        if (name, tag) not in self._kept:
            self._kept[name, tag] = self.all[name].where(F.col("tag") == tag).persist()
        return self._kept[name, tag]

    def forget(self, tag: str | None = None) -> None:
        """Lets go of a tag's parts, or of all."""
        for key in [k for k in self._kept if tag in (None, k[1])]:
            self._kept.pop(key).unpersist()


def _files_of(r: Reports, tag: str, **more) -> DataFrame:
    return C.list_files(r.part("files", tag), tag, **more)


TOOLS: dict[str, Callable[..., DataFrame]] = {
    "list_builds": lambda r: C.summary(r.all["files"]).orderBy(F.desc("tag")),
    "summarize_report": lambda r, tag: C.summary(r.part("files", tag)),
    "get_folder_coverage": lambda r, tag, folder, sort_by="missed", top_n=10: _files_of(r, tag, folder=folder, sort_by=sort_by, limit=top_n),
    "get_file_coverage": lambda r, tag, file: C.uncovered_lines(r.part("lines", tag).where(F.contains("file", F.lit(file)))),
    "get_uncovered_lines": lambda r, tag, file="", folder="", limit=10: C.uncovered_topk(r.part("files", tag), r.part("lines", tag), tag, file, folder, limit),
    "list_files": lambda r, tag, prefix="", sort_by="missed", limit=20: _files_of(r, tag, folder=prefix, sort_by=sort_by, limit=limit, prefix=True),
    "get_overall_coverage": lambda r, tag: C.overall(r.part("files", tag), r.part("funcs", tag), tag),
    "get_connector_coverage": lambda r, tag, connector, show_files=False: (C.connector_files if show_files else C.connector)(r.part("files", tag), r.part("funcs", tag), tag, connector),
    "is_function_tested": lambda r, tag, function_name, limit=20: C.function_tested(r.part("funcs", tag), tag, function_name, limit),
    "get_uncovered_functions": lambda r, tag, limit=10: C.uncovered_functions(r.part("files", tag), r.part("funcs", tag), tag, limit),
    "get_zero_coverage_files": lambda r, tag, prefix="", limit=20: C.zero_coverage(r.part("files", tag), r.part("funcs", tag), tag, prefix, limit),
    "search_function": lambda r, tag, name: C.search_function(r.part("funcs", tag), tag, name),
    "compare_builds": lambda r, base_tag, head_tag, changed_files=None: C.comparison_lists(C.compare(
        r.part("files", base_tag).unionByName(r.part("files", head_tag)), base_tag, head_tag,
        None if changed_files is None else r.all["files"].sparkSession.createDataFrame([(f,) for f in changed_files], "file string"),
        r.part("funcs", base_tag).unionByName(r.part("funcs", head_tag)),
    )),
    "get_test_priority": lambda r, tag, prefix="", limit=15: C.test_priority(r.part("files", tag), r.part("funcs", tag), tag, prefix, limit),
}


def call_tool(spark: SparkSession, reports: Reports, name: str, arguments: dict) -> DataFrame:
    """The rows of the tool of that name, or one row with a column error that says what is wrong."""
    said = lambda text: spark.createDataFrame([(text,)], "error string")
    if name not in TOOLS:
        return said(f"Unknown tool: {name}")
    tags = [arguments[k] for k in ("tag", "base_tag", "head_tag") if k in arguments]
    try:
        for tag in tags:
            if reports.part("files", tag).isEmpty():
                return said(f"[Not Found] no report for tag {tag}")
        return TOOLS[name](reports, **arguments)
    except (TypeError, ValueError, AnalysisException) as e:
        return said(f"[Error] {type(e).__name__}: {e}")
