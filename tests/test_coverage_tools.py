"""Coverage questions by name: every tool answers, what is wrong is said in a row."""

from tidemark.operators import coverage_tools as K


def test_tools(spark):
    files = spark.createDataFrame([("a", "x/f.rs", 4, 1, 3), ("a", "y/g.rs", 2, 2, 0), ("b", "x/f.rs", 4, 3, 1)], "tag string, file string, line_total long, line_covered long, line_missed long")
    funcs = spark.createDataFrame([("a", "x/f.rs", "m::go", 1, 0), ("a", "y/g.rs", "m::run", 1, 2), ("b", "x/f.rs", "m::go", 1, 1)], "tag string, file string, func_name string, start_line long, cnt long")
    lines = spark.createDataFrame([("a", "x/f.rs", k, h) for k, h in ((1, 0), (2, 1), (3, 0), (4, 0))], "tag string, file string, line long, hits long")
    reports = K.Reports(files, funcs, lines)
    asked = {
        "list_builds": {}, "summarize_report": {"tag": "a"}, "get_folder_coverage": {"tag": "a", "folder": "x"}, "get_file_coverage": {"tag": "a", "file": "f.rs"}, "get_uncovered_lines": {"tag": "a"},
        "list_files": {"tag": "a", "prefix": "y/"}, "get_overall_coverage": {"tag": "a"}, "get_connector_coverage": {"tag": "a", "connector": "X", "show_files": True},
        "is_function_tested": {"tag": "a", "function_name": "GO"}, "get_uncovered_functions": {"tag": "a"}, "get_zero_coverage_files": {"tag": "a"}, "search_function": {"tag": "a", "name": "go"},
        "compare_builds": {"base_tag": "a", "head_tag": "b", "changed_files": ["x/f.rs"]}, "get_test_priority": {"tag": "a"},
    }
    rows = {name: K.call_tool(spark, reports, name, args).collect() for name, args in asked.items()}
    assert set(asked) == set(K.TOOLS)
    assert {n: len(r) for n, r in rows.items()} == {
        "list_builds": 2, "summarize_report": 1, "get_folder_coverage": 1, "get_file_coverage": 1, "get_uncovered_lines": 1, "list_files": 1, "get_overall_coverage": 3, "get_connector_coverage": 1,
        "is_function_tested": 1, "get_uncovered_functions": 1, "get_zero_coverage_files": 0, "search_function": 1, "compare_builds": 1, "get_test_priority": 2}
    assert rows["get_file_coverage"][0].missed == [1, 3, 4] and rows["compare_builds"][0].change == "improvement"
    assert [(r.metric, r.covered, r.pct) for r in rows["get_overall_coverage"]] == [("lines", 3, 50.0), ("functions", 1, 50.0), ("regions", None, None)]
    said = lambda name, args: K.call_tool(spark, reports, name, args).first().error
    assert said("nothing", {}) == "Unknown tool: nothing" and said("summarize_report", {"tag": "z"}).startswith("[Not Found]") and said("list_files", {"wrong": 1}).startswith("[Error] TypeError")
    assert reports.part("files", "a").is_cached
    reports.forget("a")
    assert not reports._kept.get(("files", "a"))
