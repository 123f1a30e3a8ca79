"""Test-catalogue queries: which flow of which connector is covered by which test.

Frames: flow_config (connector, flow, raw_block), in_list (connector, list_key), tests_flow
(spec, flow), test_case (spec_file, test_name, line, skipped), spec_path (spec_file, path).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.storage import written


def norm_path(path: Column) -> Column:
    """{x} and :name segments as :id."""
    return F.regexp_replace(F.regexp_replace(path, r"\{[^}]*\}", ":id"), ":[a-z_]+", ":id")


def detect_flow(texts: DataFrame, dictionary: list[tuple[str, str]]) -> DataFrame:
    """texts (id, txt) with the flow of the first key, in dictionary order, that the text contains."""
    flow = F.coalesce(*[F.when(F.contains("txt", F.lit(k)), F.lit(v)) for k, v in dictionary])
    return texts.select("id", flow.alias("flow"))


def grid_status(connectors: DataFrame, flow_config: DataFrame, in_list: DataFrame, flow_list: DataFrame, tests_flow: DataFrame) -> DataFrame:
    """connector, flow, status, allowlist_key of every pair of a connector and a flow; the grid is as large as its result.

    flow_list (flow, include_key, exclude_key) says which lists a flow has, if any; flows come from
    it, from flow_config and from tests_flow, connectors from connectors and flow_config. The
    ladder: no configuration; in the flow's exclude list (left out on purpose: covered); the flow has
    an include list and the connector isn't in it; no test of the flow; covered.
    """
    # both are read more than once, and may be made of parsed texts
    pairs = written(flow_config.select("connector", "flow").distinct(), "configured")
    tested = written(tests_flow.select("flow").distinct(), "tested-flows")
    names = connectors.select("connector").union(pairs.select("connector")).distinct()
    flows = pairs.select("flow").union(tested).union(flow_list.select("flow")).distinct()
    grid = names.crossJoin(flows)
    has_config = pairs.withColumn("has_config", F.lit(True))
    has_test = tested.withColumn("has_test", F.lit(True))
    lists = flow_list.groupBy("flow").agg(F.min("include_key").alias("include_key"), F.min("exclude_key").alias("exclude_key"))
    keys = in_list.groupBy("connector").agg(F.collect_set("list_key").alias("keys"))
    rows = grid.join(has_config, ["connector", "flow"], "left").join(has_test, "flow", "left").join(lists, "flow", "left").join(keys, "connector", "left")
    listed = lambda key: F.coalesce(F.array_contains("keys", F.col(key)), F.lit(False))
    gated_out = F.col("include_key").isNotNull() & ~listed("include_key")
    status = (
        F.when(F.col("has_config").isNull(), "MISSING_CONFIG").when(listed("exclude_key"), "COVERED").when(gated_out, "NOT_IN_ALLOWLIST")
        .when(F.col("has_test").isNull(), "MISSING_TEST").otherwise("COVERED")
    )
    rows = rows.withColumn("status", status)
    return rows.select("connector", "flow", "status", F.when(F.col("status") == "NOT_IN_ALLOWLIST", F.col("include_key")).alias("allowlist_key"))


def reference_config(flow_config: DataFrame) -> DataFrame:
    """connector, flow, ref_connector, ref_block of every pair: the block of the first other connector that can serve as a model.

    Blocks that are only a brace's content or commented out don't. The two first usable connectors
    of a flow are found once; a connector that is the first itself gets the second. Pairs of a
    connector without a configuration get the first: join them by flow with rank 1 (see usable_blocks).
    """
    first = usable_blocks(flow_config).where("pos <= 2")
    rows = flow_config.select("connector", "flow").distinct().join(first.withColumnsRenamed({"connector": "ref_connector", "raw_block": "ref_block"}), "flow")
    rows = rows.where("ref_connector <> connector")
    best = F.min_by(F.struct("ref_connector", "ref_block"), "pos")
    return rows.groupBy("connector", "flow").agg(best.alias("b")).select("connector", "flow", "b.*")


def usable_blocks(flow_config: DataFrame, comment: str = "// commenting out") -> DataFrame:
    """flow, pos (1, 2, ... by name), connector, raw_block of the blocks that can serve as a model."""
    ok = flow_config.where(~F.startswith("raw_block", F.lit("{")) & ~F.contains("raw_block", F.lit(comment)))
    order = Window.partitionBy("flow").orderBy("connector")
    return ok.select("flow", F.row_number().over(order).cast("long").alias("pos"), "connector", "raw_block")


def reference_blocks(flow_config: DataFrame, exclude: str = "", limit: int = 3, least: int = 50, comment: str = "//") -> DataFrame:
    """Per flow the shortest usable blocks of others than exclude: longer than least, no comment, not a bare brace."""
    ok = flow_config.where((F.length("raw_block") > least) & ~F.startswith("raw_block", F.lit("{")) & ~F.contains("raw_block", F.lit(comment)))
    ok = ok.where(F.col("connector") != exclude)
    order = Window.partitionBy("flow").orderBy(F.length("raw_block"), "connector")
    return ok.withColumn("pos", F.row_number().over(order).cast("long")).where(F.col("pos") <= limit).select("flow", "pos", "connector", "raw_block")


def match_endpoints(spec_paths: DataFrame, wanted: list[str]) -> DataFrame:
    """spec_file, path of the specs whose path equals a wanted one, or shares the part before /:id with it either way."""
    stem = lambda x: F.split_part(x, F.lit("/:id"), F.lit(1))
    hit = F.lit(False)
    for w in wanted:
        hit = hit | (F.col("path") == w) | F.contains("path", stem(F.lit(w))) | F.contains(F.lit(w), stem(F.col("path")))
    # paths are few: each distinct one is judged once
    good = spec_paths.select("path").distinct().where(hit)
    return spec_paths.join(good, "path", "left_semi").select("spec_file", "path")


def it_blocks(test_case: DataFrame, spec_path: DataFrame) -> DataFrame:
    """spec_file, endpoints (sorted), tests (distinct names by their first line)."""
    first = test_case.groupBy("spec_file", "test_name").agg(F.min("line").alias("line"))
    tests = first.groupBy("spec_file").agg(F.array_sort(F.collect_list(F.struct("line", "test_name"))).alias("t"))
    ends = spec_path.groupBy("spec_file").agg(F.array_sort(F.collect_set("path")).alias("endpoints"))
    return ends.join(tests, "spec_file").select("spec_file", "endpoints", F.transform("t", lambda x: x["test_name"]).alias("tests"))


def covering_specs(spec_path: DataFrame, required: list[str]) -> DataFrame:
    """Specs that call all required paths; if there are none, those that call any. matched says how many."""
    hits = spec_path.where(F.col("path").isin(required)).groupBy("spec_file").agg(F.countDistinct("path").alias("matched"))
    best = hits.agg(F.max(F.col("matched") == len(required)).alias("some_full"))
    return hits.crossJoin(F.broadcast(best)).where(~F.col("some_full") | (F.col("matched") == len(required))).select("spec_file", "matched")


def coverage_gap(flow_config: DataFrame, tests_flow: DataFrame) -> DataFrame:
    """Per flow: connectors with a configuration, whether a test exists, connectors without one."""
    cfg = flow_config.groupBy("flow").agg(F.countDistinct("connector").alias("has_config"))
    tested = tests_flow.groupBy("flow").agg(F.count(F.lit(1)).alias("tests"))
    n = F.coalesce("tests", F.lit(0))
    return cfg.join(tested, "flow", "left").select("flow", "has_config", n.alias("tests"), F.when(n == 0, F.col("has_config")).otherwise(0).cast("long").alias("missing_test"))


def connector_profile(flow_config: DataFrame, tests_flow: DataFrame, in_list: DataFrame) -> DataFrame:
    """Per connector: all flows, tested and untested ones, the lists that it is in (each sorted). A connector in a list needs no flow."""
    tested = tests_flow.select("flow").distinct().withColumn("t", F.lit(True))
    rows = flow_config.select("connector", "flow").distinct().join(tested, "flow", "left")
    of_flows = rows.groupBy("connector").agg(
        F.count(F.lit(1)).alias("flows"), F.array_sort(F.collect_list(F.when(F.col("t"), F.col("flow")))).alias("tested"),
        F.array_sort(F.collect_list(F.when(F.col("t").isNull(), F.col("flow")))).alias("untested"),
    )
    of_lists = in_list.groupBy("connector").agg(F.array_sort(F.collect_set("list_key")).alias("in_lists"))
    none = F.array().cast("array<string>")
    return of_flows.join(of_lists, "connector", "full").select(
        "connector", F.coalesce("flows", F.lit(0).cast("long")).alias("flows"), *[F.coalesce(c, none).alias(c) for c in ("tested", "untested", "in_lists")]
    )


def next_number(names: DataFrame, default: int = 41) -> DataFrame:
    """One row: the number for a new spec, five digits, one more than the largest leading number."""
    n = F.max(F.try_to_number(F.regexp_extract("spec_file", r"^(\d+)", 1), F.lit("9999999999")).cast("long"))
    return names.agg(F.format_string("%05d", F.coalesce(n + 1, F.lit(default))).alias("spec_number"))


#: Weights of a candidate spec's features, greatest first; a skipped spec loses PENALTY.
WEIGHTS = (("exact", 600), ("all_paths", 500), ("flow", 400), ("connector", 200), ("suite", 150), ("prefix", 100), ("recent", 50))
PENALTY = 300


def rank_candidates(features: DataFrame) -> DataFrame:
    """features (group, spec, ord, tests, skipped, one boolean per weight): the best spec of each group; the first wins ties."""
    score = F.col("tests") - F.when(F.col("skipped"), PENALTY).otherwise(0)
    for name, weight in WEIGHTS:
        score = score + F.when(F.col(name), weight).otherwise(0)
    scored = features.withColumn("score", score.cast("long"))
    best = F.max_by(F.struct("spec", "score"), F.struct("score", (-F.col("ord")).alias("o")))
    return scored.groupBy("group").agg(best.alias("b")).select("group", "b.spec", "b.score")


def changed_files(now: DataFrame, before: DataFrame) -> DataFrame:
    """Files (path, content) whose 16-digit content hash the snapshot (path, hash) doesn't have."""
    hashed = now.select("path", F.left(F.sha2("content", 256), F.lit(16)).alias("hash"))
    return hashed.join(before.select("path", "hash"), ["path", "hash"], "left_anti")


def blocks_with_fields(blocks: DataFrame, required: list[str]) -> DataFrame:
    """Configuration blocks (connector, flow, raw_block) whose text holds every required field."""
    hit = F.lit(True)
    for r in required:
        hit = hit & F.contains("raw_block", F.lit(r))
    return blocks.where(hit)


def specs_with_blocks(specs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Specs (spec_file, word) that mention any of blocks (flow), by equi-join on the mentioned word."""
    return specs.join(blocks.select(F.col("flow").alias("word")).distinct(), "word", "left_semi").select("spec_file").distinct()


def longest_prefix(paths: DataFrame, groups: list[tuple[str, str]]) -> DataFrame:
    """paths (path) with the group of the longest prefix that fits."""
    ordered = sorted(groups, key=lambda g: (-len(g[0]), g[0]))
    group = F.coalesce(*[F.when(F.startswith("path", F.lit(p)), F.lit(g)) for p, g in ordered], F.lit("other"))
    return paths.select("path", group.alias("group"))


def safe_path(path: Column) -> Column:
    """Whether a proposed file's path stays inside the repository."""
    return ~(F.startswith(path, F.lit("/")) | F.contains(path, F.lit("..")))


def similar_spec(spec_path: DataFrame, part: str = "/payments") -> DataFrame:
    """One row: the least spec that calls an endpoint with part in its path."""
    return spec_path.where(F.contains("path", F.lit(part))).agg(F.min("spec_file").alias("spec_file"))


def specs_of_flows(tests_flow: DataFrame) -> DataFrame:
    """flow with its first spec by name."""
    return tests_flow.groupBy("flow").agg(F.min("spec_file").alias("spec_file"))
