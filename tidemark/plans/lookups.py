r"""Queries over flows, findings and what is looked up around the impact of a change."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import catalog as T
from tidemark.operators import context as X
from tidemark.operators import flows as W
from tidemark.operators import impact as I
from tidemark.operators import report as R
from tidemark.plans.views import oracle, select, view
from tidemark.registry import register

# ---- flows: one per order, its steps from the order's items

_ORDERS = "SELECT o_orderkey AS o, o_custkey AS c, o_orderstatus AS st, o_orderkey % 4 AS m FROM orders"
_BODY = "CASE m WHEN 0 THEN '{\"connector\":\"aDYEN\",\"confirm\":true}' WHEN 1 THEN '{\"amount_to_capture\":5,\"customer_id\":\"x\"}' WHEN 2 THEN '{\"customer_id\":\"x\"}' ELSE '{}' END"
_EXPECTED = "CASE st WHEN 'F' THEN 'HTTP 401 Unauthorized' WHEN 'O' THEN 'status succeeded' ELSE 'fine' END"


def _flows(spark, sf):
    """Flow documents as frames: setup calls, a trigger, prerequisites, handlers."""
    rows = select(spark, sf, f"SELECT *, {_BODY} AS body, {_EXPECTED} AS expected FROM ({_ORDERS}) t")
    o, c, m = F.col("o"), F.col("c"), F.col("m")
    step = lambda path, body: F.struct(F.lit(path).alias("endpoint"), (F.lit(body) if isinstance(body, str) else body).alias("body"))
    pay = F.concat(F.lit('{"confirm":true,"card_number":"4","connector_name":"set'), c % 4, F.lit('"}'))
    setup = F.when(c % 3 == 0, F.array(step("POST /payments/{id}", '{"confirm":false,"customer_id":"z"}'), step("GET /customers/:name", "{}"))).when(
        c % 3 == 1, F.array(step("POST /payments", pay))).otherwise(F.array().cast("array<struct<endpoint:string,body:string>>"))
    need = F.when(o % 5 == 0, F.array(F.struct(F.lit("concrete_type").alias("kind"), F.lit("connector").alias("field"), F.concat(F.lit("Conn"), c % 3).alias("required_value")))).otherwise(
        F.array(F.struct(F.lit("auth_context").alias("kind"), F.lit("f").alias("field"), F.lit("").alias("required_value"))))
    ends = F.array(F.struct(F.lit("POST").alias("method"), F.concat(F.lit("/p/"), c).alias("path"), F.when(m == 3, "payments_capture").otherwise("check_things").alias("handler")))
    chain = F.array(*[F.struct(F.concat(F.lit(n), c).alias("function"), F.concat(F.lit("src/"), c % 7, F.lit(".rs")).alias("file"), (o % 90).cast("int").alias("def_line"), F.lit(r).alias("role"), F.lit("fn x() {}").alias("source"))
                      for n, r in (("h", "handler"), ("d", "direct_caller"), ("t", "target"))])
    return rows.select(
        "body", "expected", o.cast("int").alias("flow_id"), F.concat(F.lit("flow "), o).alias("description"), F.concat(F.lit("fn"), c % 40).alias("changed_function"), ends.alias("endpoints"), need.alias("prerequisites"),
        setup.alias("setup_payloads"), F.struct(F.lit("POST /payments/{id}/capture").alias("endpoint"), "body", F.col("expected").alias("expected_result")).alias("trigger_payload"),
        F.struct(F.when(o % 7 == 0, F.concat(F.lit("Spec"), c % 3)).alias("connector")).alias("specialization"), chain.alias("chain"),
    )


@register(
    "normalised_flows",
    oracle(
        "SELECT o::INT AS flow_id, CASE WHEN o % 7 = 0 THEN 'Spec' || c % 3 WHEN o % 5 = 0 THEN 'Conn' || c % 3 WHEN m = 0 THEN 'Adyen' WHEN c % 3 = 1 THEN 'set' || c % 4 ELSE '' END AS connector, '/payments/:id/capture' AS trigger_path,"
        f" CASE c % 3 WHEN 0 THEN '/customers/:id,/payments/:id' WHEN 1 THEN '/payments' ELSE '' END AS setup_paths, CASE WHEN m = 3 THEN 'payments_capture' ELSE 'check_things' END AS handlers FROM ({_ORDERS})"
    ),
)
def normalised_flows(spark, sf):
    out = W.normalise(_flows(spark, sf))
    return out.select("flow_id", "connector", "trigger_path", F.array_join("setup_paths", ",").alias("setup_paths"), F.array_join("handlers", ",").alias("handlers"))


@register(
    "flow_scores",
    oracle(
        # setup: not confirmed 2, with a customer 1; expected texts 2; a customer without anything of a connector's 1; kinds 1; handlers 1
        "SELECT o::INT AS flow_id, (CASE c % 3 WHEN 0 THEN 3 ELSE 0 END + CASE st WHEN 'F' THEN 2 ELSE 0 END + CASE m WHEN 2 THEN 1 ELSE 0 END + CASE WHEN o % 5 = 0 THEN 0 ELSE 1 END + CASE WHEN m = 3 THEN 0 ELSE 1 END)::INT AS core,"
        # setup: confirmed 3, with a card 2; expected texts 2; fields of the trigger's body 1 each; kinds 3; handlers 1
        " (CASE c % 3 WHEN 1 THEN 5 ELSE 0 END + CASE st WHEN 'O' THEN 2 ELSE 0 END + CASE WHEN m IN (0, 1) THEN 1 ELSE 0 END + CASE WHEN o % 5 = 0 THEN 3 ELSE 0 END + CASE WHEN m = 3 THEN 1 ELSE 0 END)::INT AS connector,"
        f" c % 3 = 0 AS has_core, c % 3 = 1 AS has_connector FROM ({_ORDERS})"
    ),
)
def flow_scores(spark, sf):
    return W.scores(_flows(spark, sf))


@register("flow_leaves", oracle(f"SELECT 'fn' || c % 40 AS changed_function, arg_min('t' || c, o) AS function, arg_min('src/' || c % 7 || '.rs', o) AS file, arg_min(o % 90, o)::INT AS def_line, 'fn x() {{}}' AS source FROM ({_ORDERS}) GROUP BY c % 40"))
def flow_leaves(spark, sf):
    return W.leaves(_flows(spark, sf))


@register("flow_hints", oracle(f"SELECT o::INT AS flow_id, 'POST' AS method, '/p/' || c AS path, CASE WHEN m = 3 THEN 'payments_capture' ELSE 'check_things' END AS handler, 'h' || c || '>d' || c || '>t' || c AS chain FROM ({_ORDERS})"))
def flow_hints(spark, sf):
    return W.hints(_flows(spark, sf)).withColumn("chain", F.array_join("chain", ">"))


_LIST_KEYS = "SELECT o_orderkey AS o, CASE o_orderkey % 4 WHEN 0 THEN '/payments/:id/incremental_authorization' WHEN 1 THEN '/payments/:id/capture' WHEN 2 THEN '/payments/:id/cancel' ELSE '/other' END AS path, concat('h', o_custkey % 9) AS handler FROM orders"


@register("allow_list_keys", oracle(f"SELECT key, count(*) AS n FROM (SELECT CASE o % 4 WHEN 0 THEN 'INCREMENTAL_AUTH' WHEN 1 THEN 'OVERCAPTURE' WHEN 2 THEN 'VOID' ELSE upper(handler) END AS key FROM ({_LIST_KEYS})) GROUP BY key"))
def allow_list_keys(spark, sf):
    return select(spark, sf, _LIST_KEYS).groupBy(W.list_key(F.col("path"), F.col("handler")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


_STEPS = "SELECT l_orderkey AS flow_id, l_linenumber AS pos, CASE l_partkey % 5 WHEN 0 THEN 'POST /accounts' WHEN 1 THEN 'GET /customers/x' WHEN 2 THEN 'POST /account/y/connectors' WHEN 3 THEN 'POST /connectors' ELSE '/none' END AS endpoint FROM lineitem"


@register(
    "setup_specs",
    oracle(
        "SELECT flow_id, string_agg(spec, ',' ORDER BY first, spec) AS specs FROM (SELECT flow_id, spec, min(pos) AS first FROM (SELECT *, CASE endpoint WHEN 'POST /accounts' THEN '00001-AccountCreate' WHEN 'POST /account/y/connectors' THEN '00001-AccountCreate'"
        f" WHEN 'GET /customers/x' THEN '00002-CustomerCreate' WHEN 'POST /connectors' THEN 'missing' END AS spec FROM ({_STEPS})) WHERE spec LIKE '0%' GROUP BY flow_id, spec) GROUP BY flow_id"
    ),
)
def setup_specs(spark, sf):
    known = select(spark, sf, "SELECT '00001-AccountCreate' AS spec UNION ALL SELECT '00002-CustomerCreate'")
    return W.setup_specs(select(spark, sf, _STEPS), known).withColumn("specs", F.array_join("specs", ","))


@register("spec_file_names", oracle("SELECT lpad((o_orderkey % 1000)::VARCHAR, 5, '0') || '-' || CASE WHEN o_custkey % 2 = 0 THEN 'PaymentsCaptureRefunds' ELSE 'VoidAll' END || '.cy.js' AS name, count(*) AS n FROM orders GROUP BY 1"))
def spec_file_names(spark, sf):
    handlers = F.when(F.col("c") % 2 == 0, F.array(F.lit("payments_capture"), F.lit("refunds"), F.lit("third"))).otherwise(F.array(F.lit("VOID_all")))
    rows = select(spark, sf, "SELECT o_orderkey % 1000 AS n, o_custkey AS c FROM orders")
    return rows.groupBy(W.spec_name(F.col("n"), handlers).alias("name")).agg(F.count(F.lit(1)).alias("n"))


_CANDIDATES = (
    "SELECT o_custkey AS flow_id, CASE o_orderkey % 6 WHEN 0 THEN 'a/Incremental.cy.js' WHEN 1 THEN 'a/Overcapture.cy.js' WHEN 2 THEN 'a/NoThreeDSAutoCapture.cy.js' WHEN 3 THEN 'a/Refund.cy.js' WHEN 4 THEN 'a/Wallet.cy.js' ELSE 'a/Mandate.cy.js' END AS spec_file,"
    " o_orderkey AS ord, CASE o_custkey % 4 WHEN 0 THEN 'incremental_auth' WHEN 1 THEN 'payments_confirm' WHEN 2 THEN 'refunds' ELSE 'x' END AS handler, o_custkey % 3 AS b, o_orderkey % 50 = 0 AS matched, o_orderkey AS o FROM orders"
)


@register(
    "candidate_scores",
    oracle(
        "SELECT flow_id, arg_max(spec_file, (score, -ord)) AS spec_file, max(score)::INT AS score FROM (SELECT *, CASE WHEN matched THEN 600 ELSE 0 END"
        " + CASE WHEN handler = 'incremental_auth' AND k = 0 THEN 500 WHEN handler = 'refunds' AND k = 3 THEN 500 ELSE 0 END + CASE WHEN b = 0 AND k = 2 THEN 200 ELSE 0 END + CASE WHEN b = 0 THEN 50 ELSE 0 END"
        " + CASE WHEN b = 1 AND k = 1 THEN 400 ELSE 0 END + CASE WHEN b = 1 AND k = 2 THEN 200 ELSE 0 END + CASE WHEN b = 2 AND k = 5 THEN 100 ELSE 0 END"
        " - CASE WHEN NOT max(matched) OVER (PARTITION BY flow_id) AND b <> 2 AND handler <> 'incremental_auth' AND k IN (4, 5) THEN 300 ELSE 0 END + 2 AS score"
        f" FROM (SELECT *, o % 6 AS k FROM ({_CANDIDATES}))) GROUP BY flow_id"
    ),
)
def candidate_scores(spark, sf):
    body = F.when(F.col("b") == 0, '{"confirm":"true"}').when(F.col("b") == 1, '{"amount_to_capture":1}').otherwise('{"customer_id":"x"}')
    rows = select(spark, sf, _CANDIDATES).withColumns({"body": body, "test_names": F.array(F.lit("it confirms"), F.lit("two"))})
    return W.best_candidates(rows)


# ---- what is told about a run and its leaf

_LEAVES = "SELECT s_suppkey AS s, concat('crates/n', s_nationkey, '/s', s_suppkey, '.rs') AS file FROM supplier"


@register(
    "gap_lookup",
    oracle(
        "SELECT s, file, CASE WHEN s % 4 = 0 THEN 'exact' WHEN s % 4 IN (1, 2) THEN 'suffix' END AS status, CASE WHEN s % 4 < 3 THEN (s / 10.0)::DOUBLE END AS ratio FROM"
        f" (SELECT s, CASE WHEN s % 4 = 2 THEN '/root/' || file ELSE file END AS file FROM ({_LEAVES}))"
    ),
)
def gap_lookup(spark, sf):
    rows = select(spark, sf, _LEAVES)
    steps = rows.select("s", F.when(F.col("s") % 4 == 2, F.concat(F.lit("/root/"), "file")).otherwise(F.col("file")).alias("file"))
    ratio = F.col("s") / F.lit(10.0)
    gaps = rows.where("s % 4 < 3").select(
        F.when(F.col("s") % 4 == 1, F.concat(F.lit("/abs/"), "file")).otherwise(F.col("file")).alias("file"), F.when(F.col("s") % 4 == 0, "exact").otherwise("suffix").alias("status"), ratio.alias("ratio"))
    noise = rows.where("s % 4 = 0").select(F.concat(F.lit("/abs/"), "file").alias("file"), F.lit("worse").alias("status"), ratio.alias("ratio"))
    return W.pick_gap(steps, gaps.unionByName(noise))


_GAPS = "SELECT o_orderkey AS o, CASE o_orderkey % 4 WHEN 0 THEN 'all_probed_lines_hit' WHEN 1 THEN 'all_probed_lines_zero' WHEN 2 THEN 'no_lcov_da_in_span' ELSE 'partial' END AS status, CAST(o_custkey % 5 AS INT) AS zero, CAST(o_custkey % 5 + 3 AS INT) AS probed FROM orders"


@register(
    "gap_explanations",
    oracle(
        "SELECT said, label, count(*) AS n FROM (SELECT CASE o % 4 WHEN 0 THEN 'Every probed line was hit.' WHEN 1 THEN 'None of the ' || probed || ' probed lines was hit: the function was not reached.' WHEN 2 THEN 'No line of the function is instrumented.'"
        f" ELSE zero || ' of ' || probed || ' probed lines were not hit.' END AS said, CASE o % 4 WHEN 0 THEN 'Fully covered' WHEN 1 THEN 'Not reached' WHEN 2 THEN 'Not instrumented' ELSE 'Partly covered' END AS label FROM ({_GAPS})) GROUP BY ALL"
    ),
)
def gap_explanations(spark, sf):
    rows = select(spark, sf, _GAPS)
    return rows.groupBy(W.explain_gap(F.col("status"), F.col("zero"), F.col("probed")).alias("said"), X.gap_label(F.col("status")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


_RUNS = "SELECT o_orderkey AS run_id, o_orderkey % 3 > 0 AS test_passed, CASE WHEN o_orderkey % 3 = 0 THEN 'boom' END AS error FROM orders"


@register(
    "run_reports",
    oracle(
        "SELECT verdict, count(*) AS n, count(*) FILTER (WHERE unavailable) AS unavailable FROM (SELECT CASE WHEN o_custkey % 4 = 0 AND (o_orderkey % 7 = 0 OR o_custkey % 8 = 0) THEN 'service_error' WHEN o_orderkey % 3 = 0 THEN 'test_failure'"
        " WHEN o_orderkey % 2 = 0 AND o_orderkey % 5 = 0 THEN 'covered' ELSE 'investigate' END AS verdict, o_orderkey % 2 > 0 AS unavailable FROM orders) GROUP BY verdict"
    ),
)
def run_reports(spark, sf):
    gaps = select(spark, sf, "SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 5 = 0 THEN 'all_probed_lines_hit' ELSE 'partial' END AS gap_status FROM orders WHERE o_orderkey % 2 = 0")
    logs = select(spark, sf, "SELECT o_orderkey AS run_id, o_orderkey % 7 = 0 AS has_error, CASE WHEN o_custkey % 8 = 0 THEN 503 ELSE 200 END AS status_code FROM orders WHERE o_custkey % 4 = 0")
    runs = select(spark, sf, _RUNS)
    out = W.run_report(runs, gaps, logs).drop("report")
    kept = R.without_coverage(out, gaps.select("run_id", F.col("gap_status").alias("report")))
    missing = F.col("report") == '{"status":"coverage_unavailable"}'
    return kept.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.count_if(missing).alias("unavailable"))


_SOURCE_LINES = (
    "SELECT concat('f', k) AS file, CAST(4 * (rn - 1) + l.n AS INT) AS line, CASE l.n WHEN 1 THEN concat('fn go_', s, '(') WHEN 2 THEN ') {' WHEN 3 THEN '  if x { y }' ELSE '}' END AS txt"
    " FROM (SELECT s_nationkey AS k, s_suppkey AS s, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rn FROM supplier) p, (SELECT 1 AS n UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) l"
)


@register("backfilled_sources", oracle("SELECT s_suppkey AS id, 'fn go_' || s_suppkey || '(' || chr(10) || ') {' || chr(10) || '  if x { y }' || chr(10) || '}' AS source FROM supplier"))
def backfilled_sources(spark, sf):
    # each function is said to stand a few lines off
    chain = select(spark, sf, "SELECT s_suppkey AS id, concat('f', s_nationkey) AS file, CAST(s_suppkey % 7 + 2 AS INT) AS def_line, concat('go_', s_suppkey) AS name FROM supplier")
    return W.backfill_sources(chain, select(spark, sf, _SOURCE_LINES))


@register("sources_of_nodes", oracle(f"SELECT 'n' || file AS symbol, string_agg(txt, chr(10) ORDER BY line) AS source FROM ({_SOURCE_LINES}) WHERE line BETWEEN 3 AND 72 GROUP BY file"))
def sources_of_nodes(spark, sf):
    nodes = select(spark, sf, "SELECT DISTINCT concat('nf', s_nationkey) AS symbol, concat('f', s_nationkey) AS file, 3 AS def_line FROM supplier")
    return X.source_of(nodes, select(spark, sf, _SOURCE_LINES))


_VIEWER_BLOCKS = "SELECT l_orderkey AS run_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS INT) AS pos, CASE WHEN l_partkey % 6 = 0 THEN 'target' WHEN l_partkey % 6 = 1 THEN 'handler' WHEN l_partkey % 6 = 2 THEN 'direct_caller' ELSE 'other' END AS role, concat('P', l_partkey) AS function, l_tax * 1000 AS share FROM lineitem"


@register("leaf_blocks", oracle(f"SELECT run_id, arg_max(pos, (role = 'target', pos)) AS pos, arg_max(function, (role = 'target', pos)) AS function FROM ({_VIEWER_BLOCKS}) GROUP BY run_id"))
def leaf_blocks(spark, sf):
    return X.leaf_block(select(spark, sf, _VIEWER_BLOCKS))


@register(
    "viewer_labels",
    oracle(
        "SELECT label, tone, count(*) AS n FROM (SELECT CASE role WHEN 'target' THEN 'Leaf' WHEN 'handler' THEN 'Handler' WHEN 'direct_caller' THEN 'Direct caller' ELSE 'Intermediate' END AS label,"
        f" CASE WHEN share >= 80 THEN 'good' WHEN share >= 40 THEN 'warn' ELSE 'bad' END AS tone FROM ({_VIEWER_BLOCKS})) GROUP BY ALL"
    ),
)
def viewer_labels(spark, sf):
    return select(spark, sf, _VIEWER_BLOCKS).groupBy(X.role_label(F.col("role")).alias("label"), X.tone(F.col("share")).alias("tone")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "run_overviews",
    oracle(
        "SELECT status, worked, causes, count(*) AS n FROM (SELECT CASE WHEN failing > 0 THEN 'failed' WHEN passing > 0 THEN 'ok' ELSE 'partial' END AS status,"
        " array_to_string(list_filter([CASE WHEN passing > 0 THEN passing || ' tests passed' END, CASE WHEN hit > 0 THEN hit || ' lines were reached' END], lambda x: x IS NOT NULL), '|') AS worked,"
        " array_to_string(list_filter([CASE WHEN e = 0 THEN 'service unreachable' END, CASE WHEN e = 1 THEN 'credentials' END, CASE WHEN e = 2 THEN 'missing entity' END, CASE WHEN probed > 0 AND hit = 0 THEN 'target not reached' END], lambda x: x IS NOT NULL), '|') AS causes"
        " FROM (SELECT o_orderkey % 3 AS passing, o_custkey % 2 AS failing, o_orderkey % 4 AS e, o_custkey % 5 AS probed, o_orderkey % 2 AS hit FROM orders)) GROUP BY ALL"
    ),
)
def run_overviews(spark, sf):
    rows = select(spark, sf, "SELECT o_orderkey AS run_id, o_orderkey % 3 AS passing, o_custkey % 2 AS failing, o_orderkey % 4 AS e, o_custkey % 5 AS probed, o_orderkey % 2 AS hit FROM orders")
    text = F.when(F.col("e") == 0, "connect ECONNREFUSED").when(F.col("e") == 1, "got 401").when(F.col("e") == 2, "Not Found").otherwise("other")
    out = R.overview(rows.withColumn("errors", F.array(text)))
    return out.groupBy("status", F.array_join("worked", "|").alias("worked"), F.array_join("causes", "|").alias("causes")).agg(F.count(F.lit(1)).alias("n"))


# ---- around the impact query

_NAMED = "SELECT concat('S', p_partkey) AS symbol, concat('fn', p_partkey % 300) AS name, CASE p_size % 4 WHEN 0 THEN 'crates/tests/x.rs' WHEN 1 THEN 'crates/openapi/y.rs' ELSE concat('crates/z', p_size, '.rs') END AS file FROM part"


@register("best_function_by_name", oracle(f"SELECT name, symbol, file FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY contains(file, 'test') OR contains(file, 'openapi'), symbol) AS rn FROM ({_NAMED})) WHERE rn = 1"))
def best_function_by_name(spark, sf):
    return I.best_by_name(select(spark, sf, _NAMED))


_IMPL_NAMES = "SELECT concat('S#', s_suppkey) AS symbol, CASE WHEN s_suppkey % 5 = 0 THEN concat('T', s_suppkey, '#Tr#m') ELSE concat('fn', s_suppkey) END AS name, concat('crates/n', s_nationkey, '.rs') AS file FROM supplier"


@register(
    "relevant_files",
    oracle(
        f"SELECT DISTINCT target, file FROM (SELECT c.callee AS target, n.file, contains(n.name, '#') AS concrete, bool_or(contains(n.name, '#')) OVER (PARTITION BY c.callee) AS any_one FROM v_calls c JOIN ({_IMPL_NAMES}) n ON n.symbol = c.caller WHERE c.callee LIKE 'P#%')"
        " WHERE concrete OR NOT any_one"
    ),
)
def relevant_files(spark, sf):
    targets = select(spark, sf, "SELECT concat('P#', p_partkey) AS symbol FROM part")
    return I.relevant_files(targets, view(spark, sf, "v_calls"), select(spark, sf, _IMPL_NAMES))


_IMPL_ROWS = "SELECT concat('f', s_nationkey) AS file, concat('T', s_suppkey % 30) AS type, CAST(s_suppkey AS INT) AS line FROM supplier"
_CALLS_IN = "SELECT concat('f', s_nationkey) AS file, CAST(l_suppkey AS INT) AS function_line, concat('go_', l_partkey % 40) AS callee FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"


@register("calling_types", oracle(f"SELECT DISTINCT type FROM ({_IMPL_ROWS}) i JOIN ({_CALLS_IN}) c ON c.file = i.file AND c.function_line = i.line WHERE callee = 'go_7' AND type IN (SELECT 'T' || n_nationkey FROM nation)"))
def calling_types(spark, sf):
    known = select(spark, sf, "SELECT concat('T', n_nationkey) AS type FROM nation")
    return I.calling_types(select(spark, sf, _IMPL_ROWS), select(spark, sf, _CALLS_IN), "go_7", known)


@register(
    "handler_operations",
    oracle("SELECT o_orderkey AS handler, CASE o_orderkey % 4 WHEN 0 THEN 'PaymentStart' WHEN 1 THEN 'PaymentOnlyData' WHEN 2 THEN 'CompleteIt' END AS op FROM orders"),
)
def handler_operations(spark, sf):
    text = "CASE o_orderkey % 4 WHEN 0 THEN 'a(payments::PaymentThingData, payments::operations::PaymentStart)' WHEN 1 THEN 'payments::PaymentOnlyData' WHEN 2 THEN 'x payments::CompleteIt; payments::PaymentLater' ELSE 'payments::Other' END"
    return I.operation_of(select(spark, sf, f"SELECT o_orderkey AS handler, {text} AS body FROM orders"))


_HANDLED = "SELECT o_orderkey AS o, concat('h', o_orderkey) AS handler, o_orderkey % 3 AS k, o_custkey AS c FROM orders"


@register("false_edges", oracle(f"SELECT o FROM ({_HANDLED}) WHERE k = 0 OR c % 4 <> 1"))
def false_edges(spark, sf):
    rows = select(spark, sf, _HANDLED)
    ends = rows.select("o", "handler", F.array("handler", F.concat(F.lit("Trait#step"), "c"), F.lit("t")).alias("chain"))
    bodies = rows.where("k > 0").select("handler", F.when(F.col("c") % 4 == 1, "nothing of it").otherwise(F.concat(F.lit("calls step"), "c", F.lit("(x)"))).alias("body"))
    return I.prune_false_edges(ends, bodies).select("o")


@register(
    "gated_endpoints",
    oracle(
        # through the gate where c is even; the operation by o: known to the gate, exact but unknown, mentioned only, found along the way, none
        "SELECT o, CASE WHEN c % 2 = 1 THEN NULL ELSE gate END AS connector_gate FROM (SELECT o, c, CASE o % 5 WHEN 0 THEN 'always_false' WHEN 1 THEN NULL WHEN 2 THEN 'conditional' WHEN 3 THEN 'conditional' ELSE 'conditional' END AS gate FROM"
        f" ({_HANDLED})) WHERE c % 2 = 1 OR gate IS NULL OR gate <> 'always_false'"
    ),
)
def gated_endpoints(spark, sf):
    rows = select(spark, sf, _HANDLED)
    inside = F.when(F.col("c") % 2 == 0, "call_connector_service").otherwise("plain")
    ends = rows.select("o", "handler", F.array(F.col("handler"), F.concat(F.lit("mid"), "o"), inside, F.lit("t")).alias("chain"))
    k = F.col("o") % 5
    ops = rows.where("o % 5 < 3").select(F.col("handler").alias("function"), F.when(k == 0, "Start").when(k == 1, "Unheard").otherwise("Unheard").alias("op"), (k < 2).alias("exact"))
    way = rows.where("o % 5 = 3").select(F.concat(F.lit("mid"), "o").alias("function"), F.lit("Sync").alias("op"), F.lit(True).alias("exact"))
    gates = select(spark, sf, "SELECT 'Start' AS op, 'always_false' AS gate UNION ALL SELECT 'Sync', 'conditional' UNION ALL SELECT '_default', 'always_true'")
    return I.gate(ends, gates, ops.unionByName(way)).select("o", "connector_gate")


@register(
    "trigger_bodies",
    oracle(
        "SELECT body, count(*) AS n FROM (SELECT CASE o_orderkey % 3 WHEN 0 THEN '{\"amount\":1000,\"currency\":\"USD\",\"setup_future_usage\":\"off_session\",\"payment_method\":\"card\"}' WHEN 1 THEN '{\"amount\":500,\"payment_id\":\"pay_test_001\",\"reason\":\"customer_request\"}'"
        " ELSE '{\"customer_id\":\"cust_test_001\",\"amount\":1000,\"currency\":\"USD\",\"payout_type\":\"bank\"}' END AS body FROM orders) GROUP BY body"
    ),
)
def trigger_bodies(spark, sf):
    k = F.col("o") % 3
    path = F.when(k == 0, "/payments/:id").when(k == 1, "/refunds").otherwise("/payouts")
    said = F.when(k == 0, F.array(F.lit("req.mandate_id"))).when(k == 1, F.array(F.lit("x"))).otherwise(F.array(F.lit("req.customer_id.is_some()")))
    return select(spark, sf, "SELECT o_orderkey AS o FROM orders").groupBy(I.trigger_body(path, said).alias("body")).agg(F.count(F.lit(1)).alias("n"))


_FOUND = "SELECT o_custkey % 60 AS t, o_orderkey % 25 AS e, o_orderkey % 3 AS g, o_custkey % 4 AS sp, o_orderkey % 2 AS l FROM orders"


def _found(spark, sf):
    """Endpoints as the impact query finds them: some by a longer way, some under a condition, some by a connector."""
    rows = select(spark, sf, f"SELECT DISTINCT * FROM ({_FOUND})")
    n = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    chain = F.when(F.col("l") == 0, F.array(n("h", "e"), n("m", "g"), n("T", "t"))).otherwise(F.array(n("h", "e"), F.lit("far"), n("m", "g"), n("T", "t")))
    hop = F.concat(n("h", "e"), F.lit(" → "), F.when(F.col("l") == 0, n("m", "g")).otherwise(F.lit("far")))
    guard = F.struct(hop.alias("at_hop"), F.lit("if").alias("guard_type"), n("c", "g").alias("condition"))
    guards = F.when(F.col("g") == 1, F.array(guard)).otherwise(F.array().cast(I.GUARDS))
    spec = F.when(F.col("sp") == 0, "Tr|Acme||m").when(F.col("sp") == 1, "Wrapper")
    return rows.select(
        n("T", "t").alias("target"), F.lit("POST").alias("http_method"), n("/p/", "e").alias("http_path"), n("h", "e").alias("handler"), spec.alias("spec"), chain.alias("chain"), guards.alias("guards"), (F.col("g") == 2).alias("infeasible"))


_ENDS_SQL = (
    # one way for each target, endpoint and specialisation: the shorter, of equal ones the least
    "ends AS (SELECT t, e, spec, g, l FROM (SELECT *, row_number() OVER (PARTITION BY t, e, spec ORDER BY l, g) AS rn FROM"
    f" (SELECT DISTINCT *, CASE sp WHEN 0 THEN 'Tr|Acme||m' WHEN 1 THEN 'Wrapper' END AS spec FROM ({_FOUND}))) WHERE rn = 1)"
)


@register(
    "impact_dedup",
    oracle("SELECT 'T' || t AS target, '/p/' || e AS http_path, spec, 'h' || e || CASE l WHEN 0 THEN '' ELSE '>far' END || '>m' || g || '>T' || t AS chain, g = 2 AS infeasible FROM ends", _ENDS_SQL),
)
def impact_dedup(spark, sf):
    return I.dedup_endpoints(_found(spark, sf)).select("target", "http_path", "spec", F.array_join("chain", ">").alias("chain"), "infeasible")


# endpoints of one flow share all but their start, and their guards (those name the start, so a guarded way is a flow of its own)
_FLOWS_SQL = (
    "flows AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY first) AS flow_id FROM (SELECT t, g, l, CASE g WHEN 1 THEN e END AS own, min(struct_pack(p := '/p/' || e, s := coalesce(spec, ''))) AS first,"
    " arg_min(struct_pack(e := e, spec := spec), struct_pack(p := '/p/' || e, s := coalesce(spec, ''))) AS r, list(DISTINCT '/p/' || e ORDER BY '/p/' || e) AS paths FROM ends GROUP BY t, g, l, CASE g WHEN 1 THEN e END))"
)


@register(
    "impact_flows",
    oracle(
        "SELECT 'T' || t AS target, array_to_string(paths, ',') AS paths, CASE WHEN g = 1 THEN 'c1' WHEN r.spec IS NOT NULL THEN 'via ' || r.spec ELSE 'path through h' || r.e || ' → ' || CASE l WHEN 0 THEN 'm' || g || ' → T' || t ELSE 'far → m' || g END END AS description,"
        " (CASE g WHEN 1 THEN 1 ELSE 0 END)::INT AS conditions_high FROM flows",
        _ENDS_SQL, _FLOWS_SQL,
    ),
)
def impact_flows(spark, sf):
    out = I.build_flows(I.dedup_endpoints(_found(spark, sf)))
    return out.select("target", F.array_join(F.transform("endpoints", lambda e: e["path"]), ",").alias("paths"), "description", "conditions_high")


@register(
    "impact_matrix",
    oracle(
        "SELECT impact_status, spec, count(*) AS n FROM (SELECT CASE WHEN f.g <> 1 THEN 'Impacted' WHEN f.r.spec = 'Tr|Acme||m' THEN 'Conditionally Impacted (via Acme)' ELSE 'Conditionally Impacted' END AS impact_status,"
        " CASE WHEN f.r.spec = 'Tr|Acme||m' THEN f.r.spec END AS spec FROM ends d JOIN (SELECT t, path, arg_min(struct_pack(g := g, r := r), flow_id) AS f FROM (SELECT t, flow_id, g, r, unnest(paths) AS path FROM flows) GROUP BY t, path) x"
        " ON x.t = d.t AND x.path = '/p/' || d.e) GROUP BY ALL",
        _ENDS_SQL, _FLOWS_SQL,
    ),
)
def impact_matrix(spark, sf):
    ends = I.dedup_endpoints(_found(spark, sf))
    known = spark.createDataFrame([("Acme",)], "connector string")
    return I.reachability(ends, I.build_flows(ends), known).groupBy("impact_status", "spec").agg(F.count(F.lit(1)).alias("n"))


@register(
    "impact_document",
    oracle(
        "SELECT 'head' AS section, 1 AS n, (SELECT count(*) FROM ends) AS counted UNION ALL SELECT 'endpoints', count(*), NULL FROM ends UNION ALL SELECT 'flows', count(*), NULL FROM flows UNION ALL SELECT 'reachability_matrix', count(*), NULL FROM ends",
        _ENDS_SQL, _FLOWS_SQL,
    ),
)
def impact_document(spark, sf):
    ends = I.dedup_endpoints(_found(spark, sf))
    flows = I.build_flows(ends)
    out = I.document("fn", ends, flows, I.reachability(ends, flows, spark.createDataFrame([], "connector string")))
    return out.groupBy("section").agg(F.count(F.lit(1)).alias("n"), F.max(F.get_json_object("value", "$.endpoint_count").cast("long")).alias("counted"))


@register("pruned_flows", oracle("SELECT l_orderkey AS flow_id, string_agg(p, ',' ORDER BY pos) AS paths FROM (SELECT l_orderkey, l_linenumber AS pos, min('/p/' || l_partkey % 50) AS p FROM lineitem GROUP BY l_orderkey, l_linenumber) WHERE p IN (SELECT '/p/' || n_nationkey FROM nation) GROUP BY l_orderkey"))
def pruned_flows(spark, sf):
    rows = select(spark, sf, "SELECT l_orderkey AS flow_id, l_linenumber AS pos, min(concat('/p/', l_partkey % 50)) AS p FROM lineitem GROUP BY l_orderkey, l_linenumber")
    flows = rows.groupBy("flow_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "p"))), lambda x: F.struct(F.lit("GET").alias("method"), x["p"].alias("path"))).alias("endpoints"))
    left = select(spark, sf, "SELECT 'GET' AS method, concat('/p/', n_nationkey) AS path FROM nation")
    return I.prune_flows(flows, left).select("flow_id", F.array_join(F.transform("endpoints", lambda e: e["path"]), ",").alias("paths"))


_FINDINGS = "SELECT concat('f', o_custkey % 30) AS file, CAST(o_custkey % 30 AS INT) AS line, concat('fn', o_custkey % 30) AS function, o_orderkey AS ord, concat('h', o_orderkey % 12) AS handler, o_orderkey % 6 AS a FROM orders"


@register(
    "finding_contexts",
    oracle(
        "SELECT file, line, function, array_to_string(list_transform(list_sort(callers)[1:3], lambda x: x.v), ',') AS callers, array_to_string(list_transform(list_sort(helpers)[1:4], lambda x: x.v), ',') AS helpers, array_to_string(list_transform(list_sort(handlers)[1:8], lambda x: x.v), ',') AS handlers FROM"
        " (SELECT file, line, function, list(struct_pack(o := o, v := v)) FILTER (WHERE kind = 'caller') AS callers, list(struct_pack(o := o, v := v)) FILTER (WHERE kind = 'helper') AS helpers, list(struct_pack(o := o, v := v)) FILTER (WHERE kind = 'handler') AS handlers FROM"
        " (SELECT file, line, function, kind, v, min(ord * 10 + k) AS o FROM (SELECT file, line, function, ord, 0 AS k, 'caller' AS kind, 'b' || a AS v FROM f UNION ALL SELECT file, line, function, ord, 1, 'caller', 'a' || a FROM f UNION ALL SELECT file, line, function, ord, 0, 'helper', 'is_ok_' || a FROM f"
        " UNION ALL SELECT file, line, function, ord, 1, 'helper', 'check_it' FROM f UNION ALL SELECT file, line, function, ord, 0, 'handler', handler FROM f) GROUP BY ALL) GROUP BY ALL)",
        f"f AS ({_FINDINGS})",
    ),
)
def finding_contexts(spark, sf):
    n = lambda p: F.concat(F.lit(p), F.col("a").cast("string"))
    rows = select(spark, sf, _FINDINGS).withColumns({"chain": F.array(n("a"), n("b"), F.lit("target")), "source": F.concat(F.lit("if is_ok_"), F.col("a").cast("string"), F.lit("(x) { check_it (y); other(z) }"))})
    out = X.finding_context(rows)
    return out.select("file", "line", "function", *[F.array_join(c, ",").alias(c) for c in ("callers", "helpers", "handlers")])


@register(
    "flow_prompts",
    oracle(
        "SELECT o::INT AS flow_id, 'Flow ' || o || ': flow ' || o || chr(10) || chr(10) || 'Endpoints:' || chr(10) || '- POST /p/' || c || ' -> ' || CASE WHEN m = 3 THEN 'payments_capture' ELSE 'check_things' END || chr(10) || chr(10) || 'Prerequisites:' || chr(10) || '- '"
        " || CASE WHEN o % 5 = 0 THEN 'concrete_type connector Conn' || c % 3 ELSE 'auth_context f ' END || chr(10) || chr(10) || 'Call chain:' || chr(10) || array_to_string(list_transform([['h', 'handler'], ['d', 'direct_caller'], ['t', 'target']],"
        f" lambda x: '### ' || x[1] || c || ' (' || x[2] || ') src/' || c % 7 || '.rs:' || o % 90 || chr(10) || 'fn x() {{}}'), chr(10) || chr(10)) AS prompt FROM ({_ORDERS})"
    ),
)
def flow_prompts(spark, sf):
    return I.ask(X.flow_prompt(_flows(spark, sf)), F.col("prompt")).select("flow_id", "prompt")


_SPEC_PATHS = "SELECT DISTINCT concat(CAST(10000 + o_custkey AS VARCHAR(10)), '-Spec.cy.js') AS spec_file, CASE o_orderkey % 5 WHEN 0 THEN '/payments' WHEN 1 THEN '/refunds' ELSE concat('/x/', o_orderkey % 40) END AS path, concat('g', o_orderkey % 5) AS \"group\" FROM orders"


@register("similar_spec", oracle(f"SELECT min(spec_file) AS spec_file FROM ({_SPEC_PATHS}) WHERE contains(path, '/payments')"))
def similar_spec(spark, sf):
    return T.similar_spec(select(spark, sf, _SPEC_PATHS.replace('"group"', "`group`")))


@register("first_specs_of_flows", oracle("SELECT flow, min(concat(CAST(10000 + o_custkey AS VARCHAR), '-Spec.cy.js')) AS spec_file FROM v_tests_flow t JOIN orders o ON t.o_orderkey = o.o_orderkey GROUP BY flow"))
def first_specs_of_flows(spark, sf):
    rows = select(spark, sf, "SELECT t.flow, concat(CAST(10000 + o.o_custkey AS VARCHAR(10)), '-Spec.cy.js') AS spec_file FROM v_tests_flow t JOIN orders o ON t.o_orderkey = o.o_orderkey")
    return T.specs_of_flows(rows)


@register(
    "style_references",
    oracle(
        "SELECT w.flow_id, w.path, w.grp, coalesce(p.spec_file, g.spec_file, (SELECT min(spec_file) FROM sp)) AS reference FROM (SELECT s_suppkey AS flow_id, CASE WHEN s_suppkey % 2 = 0 THEN '/payments' ELSE '/unheard' END AS path, concat('g', s_suppkey % 9) AS grp FROM supplier) w"
        " LEFT JOIN (SELECT path, min(spec_file) AS spec_file FROM sp GROUP BY path) p ON p.path = w.path LEFT JOIN (SELECT \"group\", min(spec_file) AS spec_file FROM sp GROUP BY \"group\") g ON g.\"group\" = w.grp",
        f"sp AS ({_SPEC_PATHS})",
    ),
)
def style_references(spark, sf):
    wanted = select(spark, sf, "SELECT s_suppkey AS flow_id, CASE WHEN s_suppkey % 2 = 0 THEN '/payments' ELSE '/unheard' END AS path, concat('g', s_suppkey % 9) AS grp FROM supplier").withColumnRenamed("grp", "group")
    return X.style_reference(select(spark, sf, _SPEC_PATHS.replace('"group"', "`group`")), wanted).withColumnRenamed("group", "grp")


@register(
    "it_block_sections",
    oracle(
        "SELECT spec_file, string_agg('- ' || test_name || CASE WHEN skipped THEN ' [skipped]' ELSE '' END || ' (line ' || line || ')', chr(10) ORDER BY rn) AS section FROM (SELECT *, row_number() OVER (PARTITION BY spec_file ORDER BY line, test_name) AS rn FROM v_test_case) WHERE rn <= 15 GROUP BY spec_file"
    ),
)
def it_block_sections(spark, sf):
    return X.it_block_section(view(spark, sf, "v_test_case"))


@register("specs_with_blocks", oracle("SELECT DISTINCT spec_file FROM (SELECT concat('spec', o_custkey) AS spec_file, concat('w', o_orderkey % 400) AS word FROM orders) WHERE word IN (SELECT concat('w', n_nationkey) FROM nation)"))
def specs_with_blocks(spark, sf):
    specs = select(spark, sf, "SELECT concat('spec', o_custkey) AS spec_file, concat('w', o_orderkey % 400) AS word FROM orders")
    return T.specs_with_blocks(specs, select(spark, sf, "SELECT concat('w', n_nationkey) AS flow FROM nation"))


@register("safe_paths", oracle("SELECT o_orderkey % 3 = 0 AS safe, count(*) AS n FROM orders GROUP BY 1"))
def safe_paths(spark, sf):
    path = F.when(F.col("o") % 3 == 0, "cypress/a.js").when(F.col("o") % 3 == 1, "/etc/x").otherwise("a/../../b")
    return select(spark, sf, "SELECT o_orderkey AS o FROM orders").groupBy(T.safe_path(path).alias("safe")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "specialisation_algebra",
    oracle(
        "SELECT s_suppkey AS id, NOT (s_suppkey % 2 = 0 AND s_suppkey % 3 > 0) AS compatible, CASE WHEN s_suppkey % 2 = 0 THEN 'A' WHEN s_suppkey % 3 = 0 THEN 'A' ELSE 'B' END AS impl_type, 'Tr|' || CASE WHEN s_suppkey % 2 = 0 THEN 'A' WHEN s_suppkey % 3 = 0 THEN 'A' ELSE 'B' END"
        " || '|' || CASE WHEN s_suppkey % 4 < 2 THEN 'X,Y' ELSE 'Z' END || '|m' AS spec FROM supplier"
    ),
)
def specialisation_algebra(spark, sf):
    s = F.col("s")
    a = F.struct(F.when(s % 2 == 0, "A").alias("impl_type"), F.lit(None).cast("string").alias("trait"), F.when(s % 4 < 2, F.array(F.lit("X"), F.lit("Y"))).otherwise(F.array().cast("array<string>")).alias("args"), F.lit("m").alias("method")).cast(I.SPEC)
    b = F.struct(F.when(s % 3 == 0, "A").otherwise("B").alias("impl_type"), F.lit("Tr").alias("trait"), F.when(s % 4 < 2, F.lit(None).cast("array<string>")).otherwise(F.array(F.lit("Z"))).alias("args"), F.lit(None).cast("string").alias("method")).cast(I.SPEC)
    both = I.merged(a, b)
    return select(spark, sf, "SELECT s_suppkey AS s FROM supplier").select(s.alias("id"), I.compatible(a, b).alias("compatible"), both["impl_type"].alias("impl_type"), I.spec_text(both).alias("spec"))


_SEEDED = "SELECT concat('S', s_suppkey) AS symbol, concat('/f', s_nationkey) AS file, CAST(s_suppkey AS INT) AS def_line, CASE WHEN s_suppkey % 3 > 0 THEN concat('T', s_suppkey) END AS impl_type, 'Tr' AS impl_trait, 'A, B' AS impl_trait_args, 'm' AS impl_method FROM supplier"


@register(
    "seed_specialisations",
    oracle(
        f"SELECT p.file, p.line, symbol, CASE WHEN impl_type IS NULL THEN NULL ELSE 'Tr|' || impl_type || '|A,B|m' END AS seed FROM (SELECT DISTINCT 'f' || s_nationkey AS file, (s_suppkey + 2)::INT AS line FROM supplier) p ASOF JOIN ({_SEEDED}) d ON ltrim(d.file, '/') = p.file AND p.line >= d.def_line"
    ),
)
def seed_specialisations(spark, sf):
    places = select(spark, sf, "SELECT DISTINCT concat('/f', s_nationkey) AS file, CAST(s_suppkey + 2 AS INT) AS line FROM supplier")
    out = I.seeds(select(spark, sf, _SEEDED), places)
    return out.select("file", "line", "symbol", I.spec_text(F.col("seed")).alias("seed"))


# ---- several trigger cases, sections, what a viewer draws


def _with_cases(spark, sf):
    """The flows with two handlers' cases: one as above, one that is a capture without an answer."""
    rows = _flows(spark, sf)
    own = F.struct(F.lit("POST /payments/{id}/capture").alias("endpoint"), F.col("body"), F.col("expected").alias("expected_result"))
    more = F.struct(F.lit("GET /a/{x}").alias("endpoint"), F.lit('{"wallet":1}').alias("body"), F.lit("not found").alias("expected_result"))
    return rows.drop("trigger_payload").withColumn("trigger_payloads", F.create_map(F.lit("h1"), F.create_map(F.lit("works"), own), F.lit("h2"), F.create_map(F.lit("fails"), more)))


@register(
    "flow_case_types",
    oracle(
        "SELECT flow_type, hint, trigger_paths, count(*) AS n FROM (SELECT CASE WHEN core = 0 AND NOT mixed THEN 'CONNECTOR_ONLY' WHEN mixed OR (has_core AND connector >= 2) THEN 'CORE_THEN_CONNECTOR' WHEN core > connector AND connector < 2 THEN 'CORE_ONLY'"
        " WHEN core > connector THEN 'CORE_THEN_CONNECTOR' ELSE 'CONNECTOR_ONLY' END AS flow_type, CASE WHEN has_core AND connector >= 2 THEN '00006-NoThreeDSManualCapture' END AS hint, '/a/:id,/payments/:id/capture' AS trigger_paths FROM ("
        "SELECT (CASE c % 3 WHEN 0 THEN 3 ELSE 0 END + CASE st WHEN 'F' THEN 2 ELSE 0 END + CASE m WHEN 2 THEN 1 ELSE 0 END + CASE WHEN o % 5 = 0 THEN 0 ELSE 1 END + CASE WHEN m = 3 THEN 0 ELSE 1 END) + 2 AS core,"
        " (CASE c % 3 WHEN 1 THEN 5 ELSE 0 END + CASE st WHEN 'O' THEN 2 ELSE 0 END + CASE WHEN m IN (0, 1) THEN 1 ELSE 0 END + CASE WHEN o % 5 = 0 THEN 3 ELSE 0 END + CASE WHEN m = 3 THEN 1 ELSE 0 END) + 1 AS connector,"
        f" c % 3 = 0 AS has_core, false AS mixed FROM ({_ORDERS}))) GROUP BY ALL"
    ),
)
def flow_case_types(spark, sf):
    flows = _with_cases(spark, sf)
    kinds = W.core_spec_hint(W.classify(W.scores(flows)), flows).select("flow_id", "flow_type", F.col("core_spec_hint").alias("hint"))
    paths = W.normalise(flows).select("flow_id", F.array_join("trigger_paths", ",").alias("trigger_paths"))
    return kinds.join(paths, "flow_id").groupBy("flow_type", "hint", "trigger_paths").agg(F.count(F.lit(1)).alias("n"))


@register(
    "flow_sections",
    oracle(
        "SELECT o::INT AS flow_id, '### Handler: h1' || chr(10) || '  works:' || chr(10) || '    endpoint: POST /payments/{id}/capture' || chr(10) || '    body: ' || body || chr(10) || '    expected: ' || expected || chr(10) || chr(10)"
        " || '### Handler: h2' || chr(10) || '  fails:' || chr(10) || '    endpoint: GET /a/{x}' || chr(10) || '    body: {\"wallet\":1}' || chr(10) || '    expected: not found' || chr(10) AS triggers,"
        " CASE WHEN o % 5 = 0 THEN '  [concrete_type] connector = Conn' || c % 3 ELSE '  [auth_context] f = ' END AS needs"
        f" FROM (SELECT *, {_BODY} AS body, {_EXPECTED} AS expected FROM ({_ORDERS}))"
    ),
)
def flow_sections(spark, sf):
    return X.flow_sections(_with_cases(spark, sf)).select("flow_id", "triggers", "needs")


_SNIPPETS = "SELECT o_orderkey AS id, o_orderkey % 4 AS k, CAST(o_custkey % 5 + 3 AS INT) AS def_line FROM orders"


@register(
    "snippet_rows",
    oracle(
        # a snippet; a file with a span; a file whose braces close four lines on; a text shorter than the line it should start at
        "SELECT id, count(*) AS n, min(line)::INT AS first, max(line)::INT AS last FROM (SELECT id, unnest(CASE k WHEN 0 THEN range(def_line, def_line + 3) WHEN 1 THEN range(def_line, 11) WHEN 2 THEN range(def_line, 14) ELSE range(def_line + 50, def_line + 52) END) AS line"
        f" FROM ({_SNIPPETS})) GROUP BY id"
    ),
)
def snippet_rows(spark, sf):
    rows = select(spark, sf, _SNIPPETS)
    file = "use x;\n" + "let a = 1;\n" * 8 + "fn g() {\n  if a {\n  }\n}\nfn h() {}\n"
    text = F.when(F.col("k") == 0, "\n  pub async fn f() {\n}").when(F.col("k") == 3, "a\nb").otherwise(file)
    rows = rows.withColumns({"text": text, "span_stop": F.when(F.col("k") == 1, 10), "def_line": F.when(F.col("k") == 3, F.col("def_line") + 50).otherwise(F.col("def_line"))})
    return R.snippet_rows(rows).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first"), F.max("line").alias("last"))


@register(
    "flow_nodes",
    oracle(
        "SELECT role, status, unreached, count(*) AS n FROM (SELECT unnest(CASE WHEN o % 7 = 0 THEN ['api'] ELSE ['api', 'handler', 'target'] END) AS role, o, k FROM (SELECT o_orderkey AS o, o_custkey % 4 AS k FROM orders)) r,"
        " LATERAL (SELECT CASE WHEN r.role = 'api' THEN CASE WHEN r.k > 0 AND (r.o % 7 = 0 OR r.k = 1) THEN 'error' WHEN r.o % 2 = 1 THEN 'warn' ELSE 'ok' END WHEN r.k = 1 THEN 'warn' WHEN r.k > 1 AND r.role = 'target' THEN 'error' ELSE 'ok' END AS status,"
        " r.role <> 'api' AND r.k = 1 AS unreached) GROUP BY ALL"
    ),
)
def flow_nodes(spark, sf):
    rows = select(spark, sf, "SELECT o_orderkey AS run_id, o_custkey % 4 AS k FROM orders")
    step = lambda f, r: F.struct(F.lit(f).alias("function"), F.lit(r).alias("role"))
    chain = F.when(F.col("run_id") % 7 == 0, F.array().cast("array<struct<function:string,role:string>>")).otherwise(F.array(step("a", "handler"), step("b", "target")))
    runs = rows.select(
        "run_id", F.lit("POST").alias("method"), F.lit("/x").alias("path"), chain.alias("chain"), F.when(F.col("run_id") % 2 == 1, 404).otherwise(200).alias("http_status"),
        F.when(F.col("k") > 0, "boom").alias("error"), F.when(F.col("k") == 1, "Rejected before leaf execution").otherwise("other").alias("verdict"))
    return R.flow_nodes(runs).groupBy("role", "status", "unreached").agg(F.count(F.lit(1)).alias("n"))


_KEPT = "SELECT o_custkey AS run_id, o_orderkey AS o FROM orders"


@register(
    "run_summaries",
    oracle(
        "SELECT r.run_id, 'Run ID: ' || r.run_id || chr(10) || 'Flow ID: ' || r.run_id % 9 || chr(10) || 'Description: d' || chr(10) || 'Changed function: f' || chr(10) || 'Target leaf: ' || chr(10) || 'Request IDs: ' || CASE WHEN r.run_id % 2 = 0 THEN 'a, b' ELSE 'none' END || chr(10) || chr(10) || 'Artifacts:' || chr(10) || files AS text"
        f" FROM (SELECT run_id, string_agg('- log: /out/' || o, chr(10) ORDER BY '- log: /out/' || o) AS files FROM ({_KEPT}) GROUP BY run_id) r"
    ),
)
def run_summaries(spark, sf):
    rows = select(spark, sf, _KEPT)
    ids = F.when(F.col("run_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    runs = rows.select("run_id").distinct().withColumns({"flow_id": F.col("run_id") % 9, "description": F.lit("d"), "changed_function": F.lit("f"), "target_leaf": F.lit(None).cast("string"), "request_ids": ids})
    return X.run_summary_text(runs, rows.select("run_id", F.lit("log").alias("kind"), F.concat(F.lit("/out/"), "o").alias("path")))


@register(
    "path_flow_documents",
    oracle("SELECT o_custkey AS run_id, CASE WHEN bool_or(o_orderkey % 3 = 0) THEN 'path_flow' ELSE 'reachability_context' END AS source FROM orders GROUP BY o_custkey HAVING bool_or(o_orderkey % 3 < 2)"),
)
def path_flow_documents(spark, sf):
    rows = select(spark, sf, "SELECT o_custkey AS run_id, o_orderkey AS o FROM orders")
    k = F.col("o") % 3
    name = F.when(k == 0, F.concat(F.lit("my_Path_Flow"), "o", F.lit(".json"))).when(k == 1, F.concat(F.lit("coverage_run_report"), "o", F.lit(".json"))).otherwise("coverage_run_report.json")
    text = F.when(k == 0, '{"flows":[]}').when(k == 1, '{"reachability_context":{"a":1}}').otherwise("{}")
    return X.path_flows(rows.select("run_id", name.alias("name"), text.alias("text"))).select("run_id", "source")
