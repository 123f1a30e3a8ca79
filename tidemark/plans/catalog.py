"""Queries over the test catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import catalog as T
from tidemark.operators import flows as W
from tidemark.plans.views import oracle, select, view
from tidemark.registry import register

_SPEC_PATH = "SELECT DISTINCT t.spec_file, e.path FROM v_test_case t JOIN v_calls_endpoint e ON t.o_orderkey = e.o_orderkey"
_DICT = [("small", "Authorize"), ("widget", "Capture"), ("red", "Refund"), ("ring", "Void"), ("blue", "Sync")]


def _case(column: str, dictionary) -> str:
    return "CASE " + " ".join(f"WHEN contains({column}, '{k}') THEN '{v}'" for k, v in dictionary) + " END"


@register("spec_flow_detection", oracle(f"SELECT flow, count(*) AS n FROM (SELECT {_case('p_name', _DICT)} AS flow FROM part) GROUP BY flow"))
def spec_flow_detection(spark, sf):
    texts = select(spark, sf, "SELECT p_partkey AS id, p_name AS txt FROM part")
    return T.detect_flow(texts, _DICT).groupBy("flow").agg(F.count(F.lit(1)).alias("n"))


# the rule by rule, one decision for each pair: configuration, the flow's own exclude list, the flow's own include list, tests
_STATUS = (
    "SELECT g.connector, g.flow, CASE WHEN NOT EXISTS (SELECT 1 FROM v_flow_config c WHERE c.connector = g.connector AND c.flow = g.flow) THEN 'MISSING_CONFIG'"
    " WHEN EXISTS (SELECT 1 FROM v_flow_list l JOIN v_in_list i ON i.list_key = l.exclude_key WHERE l.flow = g.flow AND i.connector = g.connector) THEN 'COVERED'"
    " WHEN EXISTS (SELECT 1 FROM v_flow_list l WHERE l.flow = g.flow AND l.include_key IS NOT NULL)"
    " AND NOT EXISTS (SELECT 1 FROM v_flow_list l JOIN v_in_list i ON i.list_key = l.include_key WHERE l.flow = g.flow AND i.connector = g.connector) THEN 'NOT_IN_ALLOWLIST'"
    " WHEN NOT EXISTS (SELECT 1 FROM v_tests_flow t WHERE t.flow = g.flow) THEN 'MISSING_TEST' ELSE 'COVERED' END AS status"
    " FROM (SELECT s_name AS connector, flow FROM supplier, (SELECT DISTINCT flow FROM v_flow_list)) g"
)


@register(
    "connector_flow_status",
    oracle(
        "SELECT connector, flow, status, CASE WHEN status = 'NOT_IN_ALLOWLIST' THEN include_key END AS allowlist_key FROM status JOIN v_flow_list USING (flow)",
        f"status AS ({_STATUS})",
    ),
)
def connector_flow_status(spark, sf):
    names = select(spark, sf, "SELECT s_name AS connector FROM supplier")
    return T.grid_status(names, *(view(spark, sf, v) for v in ("v_flow_config", "v_in_list", "v_flow_list", "v_tests_flow")))


@register(
    "reference_blocks",
    oracle(
        "SELECT flow, pos, connector, raw_block FROM (SELECT *, row_number() OVER (PARTITION BY flow ORDER BY length(raw_block), connector) AS pos FROM v_flow_config"
        " WHERE length(raw_block) > 22 AND NOT starts_with(raw_block, '{') AND NOT contains(raw_block, '//')) WHERE pos <= 3"
    ),
)
def reference_blocks(spark, sf):
    return T.reference_blocks(view(spark, sf, "v_flow_config"), least=22)


@register(
    "reference_config",
    oracle(
        "SELECT connector, flow, ref_connector, ref_block FROM (SELECT a.connector, a.flow, b.connector AS ref_connector, b.raw_block AS ref_block,"
        " row_number() OVER (PARTITION BY a.connector, a.flow ORDER BY b.connector) AS n FROM v_flow_config a JOIN v_flow_config b ON a.flow = b.flow AND a.connector <> b.connector"
        " WHERE NOT starts_with(b.raw_block, '{') AND NOT contains(b.raw_block, '// commenting out')) WHERE n = 1"
    ),
)
def reference_config(spark, sf):
    return T.reference_config(view(spark, sf, "v_flow_config"))


@register(
    "endpoint_fuzzy_match",
    oracle(
        f"SELECT path, count(DISTINCT spec_file) AS specs FROM ({_SPEC_PATH}) WHERE path = '/refunds' OR contains(path, '/refunds') OR contains('/refunds', split_part(path, '/:id', 1))"
        " OR path = '/payments/:id/capture' OR contains(path, '/payments') OR contains('/payments/:id/capture', split_part(path, '/:id', 1)) GROUP BY path"
    ),
)
def endpoint_fuzzy_match(spark, sf):
    hit = T.match_endpoints(select(spark, sf, _SPEC_PATH), ["/refunds", "/payments/:id/capture"])
    return hit.groupBy("path").agg(F.countDistinct("spec_file").alias("specs"))


@register(
    "it_blocks_by_spec",
    oracle(
        "SELECT spec_file, array_to_string(endpoints, ',') AS endpoints, array_to_string(tests, ',') AS tests FROM"
        f" (SELECT spec_file, list(path ORDER BY path) AS endpoints FROM ({_SPEC_PATH}) GROUP BY spec_file) JOIN"
        " (SELECT spec_file, list(test_name ORDER BY line, test_name) AS tests FROM (SELECT spec_file, test_name, min(line) AS line FROM v_test_case GROUP BY ALL) GROUP BY spec_file) USING (spec_file)"
    ),
)
def it_blocks_by_spec(spark, sf):
    out = T.it_blocks(view(spark, sf, "v_test_case"), select(spark, sf, _SPEC_PATH))
    return out.select("spec_file", F.array_join("endpoints", ",").alias("endpoints"), F.array_join("tests", ",").alias("tests"))


_REQUIRED = ["/payments", "/payments/:id/capture", "/refunds/:id"]


@register(
    "covering_specs",
    oracle(
        "SELECT spec_file, matched FROM (SELECT spec_file, count(DISTINCT path) AS matched, max(count(DISTINCT path)) OVER () = 3 AS some_full FROM"
        f" ({_SPEC_PATH}) WHERE path IN ('/payments', '/payments/:id/capture', '/refunds/:id') GROUP BY spec_file) WHERE NOT some_full OR matched = 3"
    ),
)
def covering_specs(spark, sf):
    return T.covering_specs(select(spark, sf, _SPEC_PATH), _REQUIRED)


@register(
    "coverage_gap",
    oracle(
        "SELECT flow, has_config, coalesce(tests, 0) AS tests, CASE WHEN coalesce(tests, 0) = 0 THEN has_config ELSE 0 END AS missing_test FROM"
        " (SELECT flow, count(DISTINCT connector) AS has_config FROM v_flow_config GROUP BY flow) LEFT JOIN (SELECT flow, count(*) AS tests FROM v_tests_flow GROUP BY flow) USING (flow)"
    ),
)
def coverage_gap(spark, sf):
    return T.coverage_gap(view(spark, sf, "v_flow_config"), view(spark, sf, "v_tests_flow"))


_SOME_TESTS = "SELECT t.* FROM v_tests_flow t JOIN v_test_case c ON t.o_orderkey = c.o_orderkey WHERE c.skipped"


@register(
    "connector_profile",
    oracle(
        "SELECT coalesce(p.connector, l.connector) AS connector, coalesce(flows, 0) AS flows, coalesce(tested, '') AS tested, coalesce(untested, '') AS untested, coalesce(in_lists, '') AS in_lists FROM"
        " (SELECT connector, count(*) AS flows, string_agg(flow, ',' ORDER BY flow) FILTER (WHERE t) AS tested, string_agg(flow, ',' ORDER BY flow) FILTER (WHERE NOT t) AS untested FROM"
        f" (SELECT DISTINCT connector, flow, flow IN (SELECT flow FROM ({_SOME_TESTS})) AS t FROM v_flow_config) GROUP BY connector) p"
        " FULL JOIN (SELECT connector, string_agg(DISTINCT list_key, ',' ORDER BY list_key) AS in_lists FROM v_in_list GROUP BY connector) l ON p.connector = l.connector"
    ),
)
def connector_profile(spark, sf):
    out = T.connector_profile(view(spark, sf, "v_flow_config"), select(spark, sf, _SOME_TESTS), view(spark, sf, "v_in_list"))
    return out.select("connector", "flows", *[F.array_join(c, ",").alias(c) for c in ("tested", "untested", "in_lists")])


@register("next_spec_number", oracle(r"SELECT printf('%05d', coalesce(max(CAST(regexp_extract(spec_file, '^(\d+)', 1) AS BIGINT)) + 1, 41)) AS spec_number FROM v_test_case"))
def next_spec_number(spark, sf):
    return T.next_number(view(spark, sf, "v_test_case"))


_SCORES = (
    "SELECT o_orderkey AS flow_id, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 2 ELSE 0 END) AS BIGINT) AS core, CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS connector,"
    " bool_or(l_quantity > 45) AS has_core, bool_or(l_tax = 0.0 AND l_returnflag = 'A') AS has_connector FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey"
)


@register(
    "flow_classifier",
    oracle(
        "SELECT flow_type, count(*) AS n, sum(core)::BIGINT AS core, sum(connector)::BIGINT AS connector FROM (SELECT *, CASE WHEN connector = 0 THEN 'CORE_ONLY' WHEN core = 0 AND NOT (has_core AND has_connector)"
        " THEN 'CONNECTOR_ONLY' WHEN (has_core AND has_connector) OR (has_core AND connector >= 2) THEN 'CORE_THEN_CONNECTOR' WHEN core > connector AND connector < 2 THEN 'CORE_ONLY'"
        f" WHEN core > connector THEN 'CORE_THEN_CONNECTOR' ELSE 'CONNECTOR_ONLY' END AS flow_type FROM ({_SCORES})) GROUP BY flow_type"
    ),
)
def flow_classifier(spark, sf):
    out = W.classify(select(spark, sf, _SCORES))
    return out.groupBy("flow_type").agg(F.count(F.lit(1)).alias("n"), F.sum("core").alias("core"), F.sum("connector").alias("connector"))


_FLOW_ENDPOINTS = "SELECT 'Intent' AS flow, '/payments' AS path, 1 AS ord UNION ALL SELECT 'Capture', '/payments/:id/capture', 2 UNION ALL SELECT 'Refund', '/refunds', 3"


@register(
    "derived_flow_names",
    oracle(
        f"SELECT path, flow, count(*) AS n FROM v_calls_endpoint LEFT JOIN (SELECT path, arg_min(flow, o) AS flow FROM (SELECT e.path, k.flow, (CASE WHEN e.path = k.path THEN 0 ELSE 10 END) + k.ord AS o FROM"
        f" (SELECT DISTINCT path FROM v_calls_endpoint) e JOIN ({_FLOW_ENDPOINTS}) k ON e.path = k.path OR contains(e.path, split_part(k.path, '/:id', 1))) GROUP BY path) USING (path) GROUP BY path, flow"
    ),
)
def derived_flow_names(spark, sf):
    out = W.derive_flow_name(view(spark, sf, "v_calls_endpoint"), select(spark, sf, _FLOW_ENDPOINTS))
    return out.groupBy("path", "flow").agg(F.count(F.lit(1)).alias("n"))


_CHECKED = (
    "SELECT s_suppkey AS flow_id, CASE s_suppkey % 3 WHEN 0 THEN 'CORE_ONLY' WHEN 1 THEN 'CONNECTOR_ONLY' ELSE 'CORE_THEN_CONNECTOR' END AS flow_type, s_name AS connector, concat('Brand#', 1 + s_nationkey) AS flow,"
    " CASE s_nationkey % 3 WHEN 0 THEN '/payments' WHEN 1 THEN '/nowhere' ELSE '/refunds/:id' END AS trigger_path FROM supplier"
)
_GRID = "SELECT s_name AS connector, concat('Brand#', 1 + s_nationkey) AS flow, CASE WHEN s_acctbal < 3000 THEN 'MISSING_CONFIG' WHEN s_acctbal < 5000 THEN 'NOT_IN_ALLOWLIST' ELSE 'COVERED' END AS status FROM supplier"


@register(
    "flow_strategies",
    oracle(
        "SELECT status, strategy, count(*) AS n FROM (SELECT status, CASE WHEN status = 'NOT_IN_ALLOWLIST' THEN 'allowlist_update' WHEN status = 'MISSING_CONFIG' THEN 'insert_flow_block'"
        " WHEN status IN ('MISSING', 'MISSING_TEST') THEN 'full_file_rewrite' ELSE 'run_existing' END AS strategy FROM (SELECT CASE WHEN f.flow_type <> 'CORE_ONLY' AND g.status <> 'COVERED' THEN g.status"
        f" WHEN f.trigger_path NOT IN (SELECT path FROM v_calls_endpoint) THEN 'MISSING' ELSE 'NEEDS_LLM_CHECK' END AS status FROM ({_CHECKED}) f JOIN ({_GRID}) g USING (connector, flow))) GROUP BY ALL"
    ),
)
def flow_strategies(spark, sf):
    out = W.strategy(W.check_flows(select(spark, sf, _CHECKED), select(spark, sf, _GRID), select(spark, sf, _SPEC_PATH)))
    return out.groupBy("status", "strategy").agg(F.count(F.lit(1)).alias("n"))


_RAW_PATHS = "SELECT concat('/n/', n_nationkey % 3, '/{order_id}/items/:item') AS path FROM nation UNION ALL SELECT path FROM v_calls_endpoint"


@register(
    "normalised_paths",
    oracle(rf"SELECT regexp_replace(regexp_replace(path, '\{{[^}}]*\}}', ':id', 'g'), ':[a-z_]+', ':id', 'g') AS path, count(*) AS n FROM ({_RAW_PATHS}) GROUP BY 1"),
)
def normalised_paths(spark, sf):
    return select(spark, sf, _RAW_PATHS).groupBy(T.norm_path(F.col("path")).alias("path")).agg(F.count(F.lit(1)).alias("n"))


_FEATURES = (
    "SELECT o_custkey % 200 AS grp, concat('spec_', o_orderkey) AS spec, o_orderkey AS ord, CAST(count(*) AS BIGINT) AS tests, o_orderstatus = 'F' AS skipped, bool_or(l_quantity = 1.0) AS exact,"
    " bool_and(l_discount < 0.09) AS all_paths, bool_or(l_returnflag = 'R') AS flow, bool_or(l_tax = 0.0) AS connector, o_totalprice > 100000 AS suite, o_orderpriority < '3' AS prefix, bool_or(l_linestatus = 'O') AS recent"
    " FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, o_orderkey, o_orderstatus, o_totalprice, o_orderpriority"
)


@register(
    "candidate_ranking",
    oracle(
        "SELECT grp AS group_id, spec, score FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, ord) AS rn FROM (SELECT *, tests - CASE WHEN skipped THEN 300 ELSE 0 END"
        " + CASE WHEN exact THEN 600 ELSE 0 END + CASE WHEN all_paths THEN 500 ELSE 0 END + CASE WHEN flow THEN 400 ELSE 0 END + CASE WHEN connector THEN 200 ELSE 0 END + CASE WHEN suite THEN 150 ELSE 0 END"
        f" + CASE WHEN prefix THEN 100 ELSE 0 END + CASE WHEN recent THEN 50 ELSE 0 END AS score FROM ({_FEATURES}))) WHERE rn = 1"
    ),
)
def candidate_ranking(spark, sf):
    return T.rank_candidates(select(spark, sf, _FEATURES).withColumnRenamed("grp", "group")).withColumnRenamed("group", "group_id")


@register("changed_files", oracle("SELECT concat('doc/', doc_id) AS path, left(sha256(text), 16) AS hash FROM documents WHERE lang <> 'en' OR source = 'src1'"))
def changed_files(spark, sf):
    now = select(spark, sf, "SELECT concat('doc/', doc_id) AS path, text AS content FROM documents")
    # the snapshot knows the English files, and an older text of those from src1
    old = select(spark, sf, "SELECT concat('doc/', doc_id) AS path, left(sha2(concat(text, CASE WHEN source = 'src1' THEN ' old' ELSE '' END), 256), 16) AS hash FROM documents WHERE lang = 'en'")
    return T.changed_files(now, old)


@register("blocks_with_fields", oracle("SELECT connector, flow, raw_block FROM v_flow_config WHERE contains(raw_block, 'red') AND contains(raw_block, 'g')"))
def blocks_with_fields(spark, sf):
    return T.blocks_with_fields(view(spark, sf, "v_flow_config"), ["red", "g"])


_GROUPS = [("/payments", "payments"), ("/payments/:id/capture", "capture"), ("/refunds", "refunds")]


@register(
    "endpoint_groups",
    oracle(
        "SELECT path, CASE WHEN starts_with(path, '/payments/:id/capture') THEN 'capture' WHEN starts_with(path, '/payments') THEN 'payments' WHEN starts_with(path, '/refunds') THEN 'refunds' ELSE 'other' END AS \"group\","
        " count(*) AS n FROM v_calls_endpoint GROUP BY ALL"
    ),
)
def endpoint_groups(spark, sf):
    return T.longest_prefix(view(spark, sf, "v_calls_endpoint"), _GROUPS).groupBy("path", "group").agg(F.count(F.lit(1)).alias("n"))
