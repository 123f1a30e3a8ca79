"""Texts put together from rows: prompts for flows and findings, sections of specs, labels of the viewer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How much source a prompt shows: of a target or its direct caller, and of any other step.
CLOSE_CHARS, FAR_CHARS = 2000, 800
#: How many callers, helpers and handlers stand for a finding.
CALLERS, HELPERS, HANDLERS = 3, 4, 8
# Names that sound like a guard.
GUARD_NAMES = r"\b((?:is|has|should|can|validate|check|verify|ensure|require)_\w+)\s*\("


def cut(text: Column, most: int) -> Column:
    """text, or its first most characters and a mark."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("\n... (truncated)"))).otherwise(text)


def condition_label(kind: Column, text: Column) -> Column:
    """'if: x', or unconditional."""
    return F.when(kind.isNull() | (kind == ""), "unconditional").otherwise(F.concat(kind, F.lit(": "), F.coalesce(text, F.lit(""))))


def chain_section(flows: DataFrame) -> DataFrame:
    """flow_id, section: every chain step (function, file, def_line, role, source) of a flow as text, in order."""
    step = lambda c: F.concat(
        F.lit("### "), F.coalesce(c["function"], F.lit("?")), F.lit(" ("), F.coalesce(c["role"], F.lit("?")), F.lit(") "), F.coalesce(c["file"], F.lit("")),
        F.lit(":"), F.coalesce(c["def_line"].cast("string"), F.lit("?")),
        F.when(c["source"].isNotNull(), F.concat(F.lit("\n"), F.when(c["role"].isin("target", "direct_caller"), cut(c["source"], CLOSE_CHARS)).otherwise(cut(c["source"], FAR_CHARS)))).otherwise(F.lit("")),
    )
    return flows.select("flow_id", F.array_join(F.transform("chain", step), "\n\n").alias("section"))


def flow_prompt(flows: DataFrame) -> DataFrame:
    """flow_id, prompt: what a flow is, its endpoints, prerequisites and chain."""
    listed = lambda items, f: F.coalesce(F.array_join(F.transform(items, f), "\n"), F.lit(""))
    ends = listed(F.col("endpoints"), lambda e: F.concat(F.lit("- "), F.concat_ws(" ", e["method"], e["path"]), F.lit(" -> "), F.coalesce(e["handler"], F.lit("?"))))
    needs = listed(F.col("prerequisites"), lambda p: F.concat(F.lit("- "), F.concat_ws(" ", p["kind"], p["field"], p["required_value"])))
    rows = flows.select("flow_id", "description", ends.alias("ends"), needs.alias("needs")).join(chain_section(flows), "flow_id")
    text = F.concat(
        F.lit("Flow "), F.col("flow_id").cast("string"), F.lit(": "), F.coalesce("description", F.lit("")), F.lit("\n\nEndpoints:\n"), "ends",
        F.lit("\n\nPrerequisites:\n"), "needs", F.lit("\n\nCall chain:\n"), F.coalesce("section", F.lit("")),
    )
    return rows.select("flow_id", text.alias("prompt"))


def finding_context(findings: DataFrame) -> DataFrame:
    """findings (file, line, function, ord, handler, chain, source) as one row per function: nearest callers, guard-like helpers, handlers, first seen first."""
    callers = F.slice(F.reverse(F.slice("chain", 1, F.greatest(F.size("chain") - 1, F.lit(0)))), 1, CALLERS)
    helpers = F.regexp_extract_all(F.coalesce("source", F.lit("")), F.lit(GUARD_NAMES), F.lit(1))
    rows = findings.select("file", "line", "function", "ord", "handler", callers.alias("callers"), helpers.alias("helpers"))
    merged = lambda c, n: F.slice(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", c))), lambda x: x[c]))), 1, n)
    heads = F.slice(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "handler"))), lambda x: x["handler"])), 1, HANDLERS)
    return rows.groupBy("file", "line", "function").agg(merged("callers", CALLERS).alias("callers"), merged("helpers", HELPERS).alias("helpers"), heads.alias("handlers"))


def source_of(nodes: DataFrame, source_lines: DataFrame, lines: int = 70) -> DataFrame:
    """nodes (symbol, file, def_line) with the lines that follow their definition, as text."""
    hit = nodes.join(source_lines, "file").where((F.col("line") >= F.col("def_line")) & (F.col("line") < F.col("def_line") + lines))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "txt"))), lambda x: x["txt"]), "\n")
    return hit.groupBy("symbol").agg(text.alias("source"))


def source_index(chains: DataFrame, source_lines: DataFrame) -> DataFrame:
    """file, first_flow, first_pos, line_count, functions (line and name of public ones) of the files that chains (flow_id, pos, file) go through.

    source_lines (file, line, txt); a file without lines is missing: its line_count is null.
    """
    seen = chains.where("file IS NOT NULL").groupBy("file").agg(F.min(F.struct("flow_id", "pos")).alias("at"))
    name = F.regexp_extract("txt", r"^\s*pub(?:\([^)]*\))?\s+(?:async\s+)?fn\s+(\w+)", 1)
    public = F.when((name != "") & F.endswith("file", F.lit(".rs")), F.struct("line", name.alias("name")))
    held = source_lines.groupBy("file").agg(F.count(F.lit(1)).alias("line_count"), F.array_sort(F.collect_list(public)).alias("functions"))
    rows = seen.join(held, "file", "left")
    return rows.select("file", F.col("at.flow_id").alias("first_flow"), F.col("at.pos").alias("first_pos"), "line_count", "functions")


def style_reference(specs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (flow_id, path, group) with a spec to imitate: one of the same path, else of the same group, else any; the least name."""
    rank = lambda c: F.min(F.when(c, F.col("spec_file")))
    by_path = specs.groupBy("path").agg(F.min("spec_file").alias("same_path"))
    by_group = specs.groupBy("group").agg(F.min("spec_file").alias("same_group"))
    anywhere = specs.agg(rank(F.lit(True)).alias("any_spec"))
    rows = wanted.join(by_path, "path", "left").join(by_group, "group", "left").crossJoin(F.broadcast(anywhere))
    return rows.select("flow_id", "path", "group", F.coalesce("same_path", "same_group", "any_spec").alias("reference"))


def it_block_section(blocks: DataFrame, most: int = 15) -> DataFrame:
    """blocks (spec_file, test_name, line, skipped) as one text per spec, its first tests by line."""
    order = Window.partitionBy("spec_file").orderBy("line", "test_name")
    row = F.concat(F.lit("- "), "test_name", F.when(F.col("skipped"), F.lit(" [skipped]")).otherwise(F.lit("")), F.lit(" (line "), F.col("line").cast("string"), F.lit(")"))
    first = blocks.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= most).select("spec_file", "pos", row.alias("row"))
    return first.groupBy("spec_file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "row"))), lambda x: x["row"]), "\n").alias("section"))


def _lines(items: Column, line) -> Column:
    return F.coalesce(F.array_join(F.transform(items, line), "\n"), F.lit(""))


def flow_sections(flows: DataFrame) -> DataFrame:
    """flow_id, triggers, setup, needs: a flow's trigger cases (handler -> case -> payload), setup calls and prerequisites as text."""
    text = lambda x, default="": F.coalesce(x.cast("string"), F.lit(default))
    case = lambda e: F.concat(
        F.lit("  "), e["key"], F.lit(":\n    endpoint: "), text(e["value"]["endpoint"]), F.lit("\n    body: "), text(e["value"]["body"], "{}"), F.lit("\n    expected: "), text(e["value"]["expected_result"]))
    handler = lambda h: F.concat(F.lit("### Handler: "), h["key"], F.lit("\n"), _lines(F.map_entries(h["value"]), case), F.lit("\n"))
    step = lambda s: F.concat(F.lit("  endpoint: "), text(s["endpoint"]), F.lit("\n  body: "), text(s["body"], "{}"), F.lit("\n"))
    need = lambda p: F.concat(F.lit("  ["), text(p["kind"]), F.lit("] "), text(p["field"]), F.lit(" = "), text(p["required_value"]))
    return flows.select(
        "flow_id", _lines(F.map_entries("trigger_payloads"), handler).alias("triggers"), _lines(F.col("setup_payloads"), step).alias("setup"), _lines(F.col("prerequisites"), need).alias("needs"))


def run_summary_text(runs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """run_id, text: what a run was about and where its files are, from runs (run_id, flow_id, description, changed_function, target_leaf, request_ids) and artifacts (run_id, kind, path)."""
    listed = artifacts.groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- "), "kind", F.lit(": "), "path"))), "\n").alias("files"))
    head = [("Run ID: ", "run_id"), ("Flow ID: ", "flow_id"), ("Description: ", "description"), ("Changed function: ", "changed_function"), ("Target leaf: ", "target_leaf")]
    said = [F.concat(F.lit(name), F.coalesce(F.col(c).cast("string"), F.lit(""))) for name, c in head]
    ids = F.when(F.size("request_ids") > 0, F.array_join("request_ids", ", ")).otherwise("none")
    text = F.concat_ws("\n", *said, F.concat(F.lit("Request IDs: "), ids), F.lit(""), F.lit("Artifacts:"), F.coalesce("files", F.lit("")))
    return runs.join(listed, "run_id", "left").select("run_id", text.alias("text"))


def path_flows(artifacts: DataFrame) -> DataFrame:
    """run_id, source, document of runs' files (run_id, name, text): the flow document, else what a coverage report says of reachability."""
    low = F.lower("name")
    own = F.contains(low, F.lit("path_flow")) | F.contains(low, F.lit("create_organization")) | (low == "input.json")
    report = F.contains(low, F.lit("coverage_run_report"))
    context = F.coalesce(F.get_json_object("text", "$.reachability_context"), F.get_json_object("text", "$.d.reachability_context"))
    rows = artifacts.groupBy("run_id").agg(F.min_by("text", F.when(own, F.col("name"))).alias("flow"), F.min_by(context, F.when(report & context.isNotNull(), F.col("name"))).alias("context"))
    source = F.when(F.col("flow").isNotNull(), "path_flow").when(F.col("context").isNotNull(), "reachability_context")
    return rows.select("run_id", source.alias("source"), F.coalesce("flow", "context").alias("document")).where("document IS NOT NULL")


def role_label(role: Column) -> Column:
    return F.when(role == "target", "Leaf").when(role == "handler", "Handler").when(role == "direct_caller", "Direct caller").otherwise("Intermediate")


def gap_label(status: Column) -> Column:
    return (
        F.when(status == "all_probed_lines_hit", "Fully covered").when(status == "all_probed_lines_zero", "Not reached").when(status == "partial", "Partly covered")
        .when(status == "no_lcov_da_in_span", "Not instrumented").otherwise("Unknown")
    )


def tone(percent: Column) -> Column:
    return F.when(percent.isNull(), "muted").when(percent >= 80, "good").when(percent >= 40, "warn").otherwise("bad")


def leaf_block(blocks: DataFrame) -> DataFrame:
    """Per run the block of the leaf, else the last one (run_id, pos, role, function)."""
    best = F.max_by(F.struct("pos", "function"), F.struct((F.col("role") == "target").alias("leaf"), "pos"))
    return blocks.groupBy("run_id").agg(best.alias("b")).select("run_id", "b.pos", "b.function")
