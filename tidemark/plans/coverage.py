"""Queries over coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import coverage as C
from tidemark.operators import coverage_tools as K
from tidemark.plans.views import oracle, select, view
from tidemark.registry import register

_PCT = "coalesce(round(100.0::DOUBLE * {0}::DOUBLE / nullif({1}, 0)::DOUBLE, 2), 0.0)"
_FILES = f"files AS (SELECT *, {_PCT.format('line_covered', 'line_total')} AS pct FROM v_cov_file)"
_STATS = (
    "stats AS (SELECT f.*, coalesce(g.func_total, 0) AS func_total, coalesce(g.func_missed, 0) AS func_missed, coalesce(g.func_missed, 0) * 3 + f.line_missed AS impact"
    " FROM v_cov_file f LEFT JOIN (SELECT tag, file, count(*) AS func_total, count(*) FILTER (WHERE cnt = 0) AS func_missed FROM v_cov_func GROUP BY ALL) g USING (tag, file))"
)
_SUMS = "count(*) AS files, sum(line_covered)::BIGINT AS covered, sum(line_missed)::BIGINT AS missed, sum(line_total)::BIGINT AS total, " + _PCT.format("sum(line_covered)", "sum(line_total)") + " AS pct"


def _files(spark, sf):
    return view(spark, sf, "v_cov_file")


def _funcs(spark, sf):
    return view(spark, sf, "v_cov_func")


def _lines(spark, sf):
    return view(spark, sf, "v_cov_line")


@register("coverage_summary", oracle(f"SELECT tag, {_SUMS} FROM v_cov_file GROUP BY tag"))
def coverage_summary(spark, sf):
    return C.summary(_files(spark, sf))


@register("list_builds", oracle(f"SELECT tag, count(*) AS files, {_PCT.format('sum(line_covered)', 'sum(line_total)')} AS line_pct FROM v_cov_file GROUP BY tag ORDER BY tag DESC"))
def list_builds(spark, sf):
    return C.summary(_files(spark, sf)).select("tag", "files", F.col("pct").alias("line_pct")).orderBy(F.desc("tag"))


@register("folder_coverage", oracle(f"SELECT {_SUMS} FROM v_cov_file WHERE tag = 'F' AND contains(file, 'n1')"))
def folder_coverage(spark, sf):
    return C.folder_totals(_files(spark, sf), "F", "n1")


@register("folder_top_files", oracle("SELECT file, line_total, line_missed, pct FROM files WHERE tag = 'F' AND contains(file, 'n1') ORDER BY line_missed DESC, file LIMIT 10", _FILES))
def folder_top_files(spark, sf):
    return C.list_files(_files(spark, sf), "F", "n1", limit=10).select("file", "line_total", "line_missed", "pct")


@register(
    "file_uncovered_lines",
    oracle(
        "SELECT tag, file, array_to_string(a[1:30], ',') AS missed, greatest(len(a) - 30, 0) AS more FROM"
        " (SELECT tag, file, list(line ORDER BY line) AS a FROM v_cov_line WHERE hits = 0 GROUP BY tag, file)"
    ),
)
def file_uncovered_lines(spark, sf):
    return C.uncovered_lines(_lines(spark, sf)).select("tag", "file", F.array_join("missed", ",").alias("missed"), F.col("more").cast("long").alias("more"))


@register(
    "uncovered_lines_topk",
    oracle(
        "SELECT file, line_missed, array_to_string(a[1:20], ',') AS missed FROM (SELECT file, line_missed FROM v_cov_file WHERE tag = 'O' AND starts_with(file, 'crates/n') AND line_missed > 0"
        " ORDER BY line_missed DESC, file LIMIT 10) LEFT JOIN (SELECT file, list(line ORDER BY line) AS a FROM v_cov_line WHERE tag = 'O' AND hits = 0 GROUP BY file) USING (file)"
    ),
)
def uncovered_lines_topk(spark, sf):
    out = C.uncovered_topk(_files(spark, sf), _lines(spark, sf), "O", folder="crates/n")
    return out.select("file", "line_missed", F.array_join("missed", ",").alias("missed"))


@register("list_files_sorted", oracle("SELECT file, line_total, pct FROM files WHERE tag = 'O' AND starts_with(file, 'crates/n2') ORDER BY pct, file LIMIT 20", _FILES))
def list_files_sorted(spark, sf):
    return C.list_files(_files(spark, sf), "O", "crates/n2", "percent", 20, prefix=True).select("file", "line_total", "pct")


_OVERALL = (
    "SELECT 'lines' AS metric, sum(line_covered)::BIGINT AS covered, sum(line_total)::BIGINT AS total FROM v_cov_file WHERE tag = '{0}' UNION ALL"
    " SELECT 'functions', count(*) FILTER (WHERE cnt > 0), count(*) FROM v_cov_func WHERE tag = '{0}' UNION ALL SELECT 'regions', sum(region_covered)::BIGINT, sum(region_total)::BIGINT FROM v_cov_file WHERE tag = '{0}'"
)


@register(
    "overall_coverage",
    oracle(
        f"SELECT metric, covered, total, total - covered AS missed, {_PCT.format('covered', 'total')} AS pct, (SELECT count(*) FROM v_cov_file WHERE tag = 'F') AS files, (SELECT count(*) FROM v_cov_func WHERE tag = 'F') AS functions"
        f" FROM ({_OVERALL.format('F')})"
    ),
)
def overall_coverage(spark, sf):
    return C.overall(_files(spark, sf), _funcs(spark, sf), "F")


@register(
    "connector_coverage",
    oracle(
        f"SELECT *, {_PCT.format('line_covered', 'line_total')} AS line_pct, {_PCT.format('func_covered', 'func_total')} AS func_pct, {_PCT.format('region_covered', 'region_total')} AS region_pct FROM"
        " (SELECT count(*) AS files, sum(line_covered)::BIGINT AS line_covered, sum(line_total)::BIGINT AS line_total, sum(region_covered)::BIGINT AS region_covered, sum(region_total)::BIGINT AS region_total FROM v_cov_file WHERE tag = 'F' AND contains(lower(file), 'n7/')),"
        " (SELECT count(*) FILTER (WHERE cnt > 0) AS func_covered, count(*) AS func_total FROM v_cov_func WHERE tag = 'F' AND contains(lower(file), 'n7/'))"
    ),
)
def connector_coverage(spark, sf):
    return C.connector(_files(spark, sf), _funcs(spark, sf), "F", "N7/")


@register(
    "connector_coverage_files",
    oracle(
        f"SELECT f.file, line_covered, line_total, {_PCT.format('line_covered', 'line_total')} AS line_pct, coalesce(c, 0) AS func_covered, coalesce(n, 0) AS func_total, {_PCT.format('coalesce(c, 0)', 'coalesce(n, 0)')} AS func_pct FROM v_cov_file f LEFT JOIN"
        " (SELECT file, count(*) FILTER (WHERE cnt > 0) AS c, count(*) AS n FROM v_cov_func WHERE tag = 'O' GROUP BY file) g ON f.file = g.file WHERE tag = 'O' AND contains(lower(f.file), 'n1')"
    ),
)
def connector_coverage_files(spark, sf):
    return C.connector_files(_files(spark, sf), _funcs(spark, sf), "O", "N1")


@register(
    "function_tested",
    oracle(
        "SELECT tested, pos, func_name, file, matches FROM (SELECT cnt > 0 AS tested, func_name, file, row_number() OVER (PARTITION BY cnt > 0 ORDER BY func_name, file) AS pos,"
        " count(*) OVER (PARTITION BY cnt > 0) AS matches FROM v_cov_func WHERE tag = 'F' AND contains(lower(func_name), 'red widget')) WHERE pos <= 5"
    ),
)
def function_tested(spark, sf):
    return C.function_tested(_funcs(spark, sf), "F", "Red Widget")


@register(
    "uncovered_functions",
    oracle(
        "SELECT file, func_missed, pos, func_name, start_line FROM (SELECT g.file, t.func_missed, left(string_split(func_name, '::')[-1], 80) AS func_name, start_line,"
        " row_number() OVER (PARTITION BY g.file ORDER BY start_line, g.func_name) AS pos FROM v_cov_func g JOIN"
        " (SELECT file, func_missed FROM stats WHERE tag = 'F' AND func_missed > 0 ORDER BY func_missed DESC, file LIMIT 10) t ON g.file = t.file WHERE g.tag = 'F' AND cnt = 0) WHERE pos <= 15",
        _STATS,
    ),
)
def uncovered_functions(spark, sf):
    return C.uncovered_functions(_files(spark, sf), _funcs(spark, sf), "F")


@register(
    "zero_coverage_files",
    oracle("SELECT file, line_total, func_total FROM stats WHERE tag = 'O' AND line_total > 0 AND line_covered = 0 ORDER BY line_total DESC, file LIMIT 20", _STATS),
)
def zero_coverage_files(spark, sf):
    return C.zero_coverage(_files(spark, sf), _funcs(spark, sf), "O")


@register("search_function", oracle("SELECT file, func_name, start_line FROM v_cov_func WHERE tag = 'O' AND cnt = 0 AND contains(lower(func_name), 'small ring')"))
def search_function(spark, sf):
    return C.search_function(_funcs(spark, sf), "O", "Small Ring")


@register(
    "compare_builds",
    oracle(
        "SELECT *, CASE WHEN base_pct IS NULL THEN 'new' WHEN head_pct IS NULL THEN 'removed' WHEN delta < 0 THEN 'regression' WHEN delta > 0 THEN 'improvement' ELSE 'same' END AS change FROM"
        " (SELECT coalesce(b.file, h.file) AS file, b.pct AS base_pct, h.pct AS head_pct, round(h.pct - b.pct, 2) AS delta FROM"
        " (SELECT * FROM files WHERE tag = 'F') b FULL JOIN (SELECT * FROM files WHERE tag = 'O') h ON b.file = h.file)",
        _FILES,
    ),
)
def compare_builds(spark, sf):
    return C.compare(_files(spark, sf), "F", "O")


_CHANGED = "SELECT concat('crates/n', s_nationkey, '/s', s_suppkey, '.rs') AS file FROM supplier WHERE s_acctbal > 1000"


@register(
    "compare_builds_lists",
    oracle(
        "SELECT change, pos, file, base_pct, head_pct, delta, base_func, head_func, func_delta, matches FROM (SELECT *, count(*) OVER (PARTITION BY change) AS matches, row_number() OVER (PARTITION BY change ORDER BY"
        " CASE change WHEN 'improvement' THEN -delta WHEN 'regression' THEN delta ELSE 0.0 END, file) AS pos FROM (SELECT *, CASE WHEN base_pct IS NULL THEN 'new' WHEN head_pct IS NULL THEN 'removed'"
        " WHEN delta < 0 OR func_delta < 0 THEN 'regression' WHEN delta > 0 THEN 'improvement' ELSE 'same' END AS change FROM (SELECT coalesce(b.file, h.file) AS file, b.pct AS base_pct, h.pct AS head_pct, round(h.pct - b.pct, 2) AS delta,"
        " b.func AS base_func, h.func AS head_func, round(h.func - b.func, 2) AS func_delta FROM (SELECT * FROM both_ WHERE tag = 'F') b FULL JOIN (SELECT * FROM both_ WHERE tag = 'O') h ON b.file = h.file)) WHERE change <> 'same')"
        " WHERE pos <= CASE change WHEN 'regression' THEN 20 ELSE 10 END",
        _FILES,
        "both_ AS (SELECT f.tag, f.file, f.pct, coalesce(g.func, 0.0) AS func FROM files f LEFT JOIN (SELECT tag, file, " + _PCT.format("count(*) FILTER (WHERE cnt > 0)", "count(*)")
        + f" AS func FROM v_cov_func GROUP BY ALL) g ON f.tag = g.tag AND f.file = g.file WHERE f.file IN (SELECT file FROM ({_CHANGED})))",
    ),
)
def compare_builds_lists(spark, sf):
    return C.comparison_lists(C.compare(_files(spark, sf), "F", "O", select(spark, sf, _CHANGED), _funcs(spark, sf)))


@register(
    "build_delta_totals",
    oracle(
        "SELECT metric, b.pct AS base_pct, h.pct AS head_pct, round(h.pct - b.pct, 2) AS delta FROM"
        f" (SELECT metric, {_PCT.format('covered', 'total')} AS pct FROM ({_OVERALL.format('F')})) b JOIN (SELECT metric, {_PCT.format('covered', 'total')} AS pct FROM ({_OVERALL.format('O')})) h USING (metric)"
    ),
)
def build_delta_totals(spark, sf):
    return C.build_delta(_files(spark, sf), _funcs(spark, sf), "F", "O")


@register(
    "test_priority",
    oracle("SELECT row_number() OVER (ORDER BY impact DESC, file) AS rank, file, impact, func_missed, line_missed FROM stats WHERE tag = 'F' ORDER BY impact DESC, file LIMIT 15", _STATS),
)
def test_priority(spark, sf):
    return C.test_priority(_files(spark, sf), _funcs(spark, sf), "F")


@register("coverage_tool_call", oracle(f"SELECT file, line_total, {_PCT.format('line_covered', 'line_total')} AS pct FROM v_cov_file WHERE tag = 'O' AND contains(file, 'n1') ORDER BY line_missed DESC, file LIMIT 10"))
def coverage_tool_call(spark, sf):
    reports = K.Reports(_files(spark, sf), _funcs(spark, sf), _lines(spark, sf))
    out = K.call_tool(spark, reports, "get_folder_coverage", {"tag": "O", "folder": "n1"})
    return out.select("file", "line_total", "pct")


@register(
    "playbook_test_plan",
    oracle(
        "SELECT 'priority' AS part, file, impact AS n FROM (SELECT file, impact FROM stats WHERE tag = 'F' ORDER BY impact DESC, file LIMIT 15)"
        " UNION ALL SELECT 'zero', file, line_total FROM (SELECT file, line_total FROM stats WHERE tag = 'F' AND line_total > 0 AND line_covered = 0 ORDER BY line_total DESC, file LIMIT 20)"
        " UNION ALL SELECT 'summary', tag, sum(line_total)::BIGINT FROM v_cov_file WHERE tag = 'F' GROUP BY tag",
        _STATS,
    ),
)
def playbook_test_plan(spark, sf):
    parts = C.playbook("test_plan", _files(spark, sf), _lines(spark, sf), _funcs(spark, sf), "F")
    row = lambda name, file, n: parts[name].select(F.lit(name).alias("part"), F.col(file).alias("file"), F.col(n).cast("long").alias("n"))
    return row("priority", "file", "impact").unionByName(row("zero", "file", "line_total")).unionByName(row("summary", "tag", "total"))
