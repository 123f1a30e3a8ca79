"""Texts, labels and tables at rest."""

from pyspark.sql import functions as F

from tidemark.operators import context as X
from tidemark.operators.flows import FLOW
from tidemark.sources.catalog_store import Catalog, artifact_kind, save_documents, save_listing


def test_prompts(spark):
    chain = [("h", "a.rs", 1, "handler", "x" * 900), ("t", "b.rs", 2, "target", "y" * 900)]
    row = (7, "d", "top", [("GET", "/x", "h")], [("auth", "f", None)], None, None, None, None, chain, None, 0)
    text = X.flow_prompt(spark.createDataFrame([row], FLOW)).first().prompt
    assert text.startswith("Flow 7: d\n\nEndpoints:\n- GET /x -> h\n\nPrerequisites:\n- auth f\n") and "x" * 801 not in text and "(truncated)" in text and "y" * 900 in text
    row = spark.range(1).select(X.condition_label(F.lit("if"), F.lit("a")), X.condition_label(F.lit(None).cast("string"), F.lit("a")), X.role_label(F.lit("target")), X.gap_label(F.lit("partial")), X.tone(F.lit(50.0))).first()
    assert tuple(row) == ("if: a", "unconditional", "Leaf", "Partly covered", "warn")


def test_finding_context(spark):
    rows = [("f", 1, "fn", 2, "h2", ["h2", "b", "fn"], "is_ok(x); is_ok(y)"), ("f", 1, "fn", 1, "h1", ["h1", "a", "b", "fn"], "check_it (z)")]
    out = X.finding_context(spark.createDataFrame(rows, "file string, line int, function string, ord int, handler string, chain array<string>, source string")).first()
    assert (out.callers, out.helpers, out.handlers) == (["b", "a", "h1"], ["check_it", "is_ok"], ["h1", "h2"])


def test_references_and_sections(spark):
    specs = spark.createDataFrame([("b", "/p", "pay"), ("a", "/r", "ref"), ("c", "/p", "pay")], "spec_file string, path string, group string")
    wanted = spark.createDataFrame([(1, "/p", "pay"), (2, "/q", "pay"), (3, "/z", "z")], "flow_id int, path string, group string")
    assert {r.flow_id: r.reference for r in X.style_reference(specs, wanted).collect()} == {1: "b", 2: "b", 3: "a"}
    tests = spark.createDataFrame([("s", f"t{k:02}", 20 - k, k == 19) for k in range(20)], "spec_file string, test_name string, line int, skipped boolean")
    section = X.it_block_section(tests).first().section.split("\n")
    assert len(section) == 15 and section[0] == "- t19 [skipped] (line 1)"
    blocks = spark.createDataFrame([("r", 0, "target", "a"), ("r", 1, "x", "b"), ("q", 0, "x", "c"), ("q", 1, "x", "d")], "run_id string, pos int, role string, function string")
    assert {r.run_id: r.function for r in X.leaf_block(blocks).collect()} == {"r": "a", "q": "d"}
    lines = spark.createDataFrame([("f", k, f"l{k}") for k in range(1, 9)], "file string, line int, txt string")
    assert X.source_of(spark.createDataFrame([("s", "f", 3)], "symbol string, file string, def_line int"), lines, 2).first().source == "l3\nl4"


def test_catalog_rewrites_only_what_changed(spark, tmp_path):
    store = Catalog(spark, str(tmp_path))
    rows = lambda *x: spark.createDataFrame(list(x), "source_file string, test_name string")
    store.replace_files("test_case", rows(("a", "one"), ("b", "two")))
    store.replace_files("test_case", rows(("a", "three")))
    assert sorted(tuple(r) for r in store.table("test_case").select("source_file", "test_name").collect()) == [("a", "three"), ("b", "two")]
    nodes = spark.createDataFrame([("x",), ("y",)], "symbol string")
    store.save_edges("calls", spark.createDataFrame([("x", "y"), ("x", "std")], "caller string, callee string"), nodes)
    assert [tuple(r) for r in store.table("calls").collect()] == [("x", "y")]
    save_documents(nodes, store.path("json"), "symbol")
    assert sorted(r.value for r in spark.read.text(store.path("json")).collect()) == ['{"symbol":"x"}', '{"symbol":"y"}']
    save_listing(spark.createDataFrame([(2, "(no DA)", None), (1, "3", "let x")], "line int, shown string, txt string"), store.path("text"))
    assert [r.value for r in spark.read.text(store.path("text")).collect()] == ["     1          3  let x", "     2    (no DA)  "]
    kinds = spark.createDataFrame([("final_report.json",), ("x.info",), ("input.json",), ("z",)], "n string").select(artifact_kind(F.col("n")).alias("k"))
    assert [r.k for r in kinds.collect()] == ["final_report", "lcov", "path_flow", "other"]
