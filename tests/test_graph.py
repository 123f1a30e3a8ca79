"""Call-graph operators on small graphs, and against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import graph as G
from tidemark.operators import impact as I

CALL = "caller string, callee string, line long, guard_type string, guard_condition string, match_arm string, type_param string"


def calls_of(spark, edges):
    return spark.createDataFrame([(a, b, k, *(list(x) + [None] * 4)[:4]) for k, (a, b, *x) in enumerate(edges)], CALL)


@pytest.mark.parametrize("seed", range(3))
def test_reachable_is_breadth_first(spark, seed):
    rng = random.Random(seed)
    edges = {(rng.randrange(30), rng.randrange(30)) for _ in range(45)}
    want, level, depth = {0: 0, 1: 0}, {0, 1}, 0
    while level:
        depth += 1
        level = {b for a, b in edges if a in level} - set(want)
        want.update(dict.fromkeys(level, depth))
    calls = calls_of(spark, [(str(a), str(b)) for a, b in edges])
    seeds = spark.createDataFrame([("0",), ("1",), ("1",)], "symbol string")
    assert {int(r.symbol): r.depth for r in G.reachable(calls, seeds).collect()} == want
    assert {int(r.symbol) for r in G.reachable(calls, seeds, 1).collect()} == {k for k, d in want.items() if d <= 1}
    assert G.reachable(calls, seeds.limit(0)).count() == 0


def test_reachable_on_a_deep_graph(spark):
    """More levels than are kept apart: levels are merged on the way."""
    calls = calls_of(spark, [(str(k), str(k + 1)) for k in range(30)] + [("5", "0"), ("9", "40")])
    found = {int(r.symbol): r.depth for r in G.reachable(calls, spark.createDataFrame([("0",)], "symbol string")).collect()}
    assert found == {**{k: k for k in range(31)}, 40: 10}


def test_dead_ends_leave_out_tests_and_endpoints(spark):
    fn = spark.createDataFrame([("e", "a.rs", True), ("a", "a.rs", False), ("b", "a.rs", False), ("t", "tests/a.rs", False), ("o", "openapi/a.rs", False)], "symbol string, file string, is_endpoint boolean")
    assert [r.symbol for r in G.dead_ends(fn, calls_of(spark, [("e", "a"), ("b", "b")])).collect()] == ["b"]


def test_enclosing_takes_the_last_definition(spark):
    defs = spark.createDataFrame([("f", 5, "a"), ("f", 9, "b"), ("f", 9, "c"), ("g", 1, "d")], "file string, def_line long, symbol string")
    refs = spark.createDataFrame([("f", 3, 1), ("f", 5, 2), ("f", 8, 3), ("f", 9, 4), ("h", 9, 5)], "file string, line long, id long")
    assert {r.id: r.def_symbol for r in G.enclosing(defs, refs).collect()} == {1: None, 2: "a", 3: "a", 4: "c", 5: None}


def test_names(spark):
    row = spark.range(1).select(
        G.display_name(F.lit("rust x crate/mod/Type#Trait#go().")).alias("a"), G.short_name(F.lit("a::b::Type<X<Y>>")).alias("b"),
        G.spec_key(F.lit("Tr"), F.lit("Ty"), F.array(F.lit("A"), F.lit("B")), F.lit("m")).alias("c"), G.common_prefix(F.lit("abcx"), F.lit("abyz")).alias("d"),
        G.common_prefix(F.lit(""), F.lit("a")).alias("e"), G.common_prefix(F.lit("ab"), F.lit("abc")).alias("f"),
    ).first()
    assert tuple(row) == ("Type#Trait#go", "Type", "Tr|Ty|A,B|m", 2, 0, 2)


def test_infeasible_paths(spark):
    cases = [
        ([("match", "x"), ("match", "x")], True), ([("match", " x "), ("match", "x")], True), ([("match", ""), ("match", "")], False), ([("if", "c"), ("if", "!c")], True),
        ([("if", "c"), ("if", "! c")], True), ([("if", "c"), ("if", "!(c)")], True), ([("if", "c"), ("match", "!c")], False), ([], False),
    ]
    rows = spark.createDataFrame([(k, [("h", t, c) for t, c in g]) for k, (g, _) in enumerate(cases)], f"id int, guards {I.GUARDS}")
    assert {r.id: r.x for r in rows.select("id", G.infeasible(F.col("guards")).alias("x")).collect()} == {k: w for k, (_, w) in enumerate(cases)}


def test_innermost_guard(spark):
    spans = spark.createDataFrame([("f", 1, 200, 0, "stop"), ("f", 10, 100, 1, "if"), ("f", 20, 30, 2, "match")], "file string, lo long, hi long, depth int, kind string")
    points = spark.createDataFrame([(1, "f", 25), (2, "f", 31), (3, "f", 150), (4, "f", 300), (5, "g", 25)], "id int, file string, line long")
    assert {r.id: r.kind for r in G.innermost_guard(points, spans, cell=16).collect()} == {1: "match", 2: "if", 3: "stop", 4: None, 5: None}


def test_chains_end_at_endpoints(spark):
    calls = calls_of(spark, [("e1", "a"), ("e2", "e1"), ("a", "t", "if", "c"), ("b", "t"), ("e2", "b"), ("t", "a"), ("e3", "b")])
    one = lambda *x: spark.createDataFrame([(v,) for v in x], "symbol string")
    rows = G.chains_up(calls, one("t"), one("e1", "e2", "e3"), 8).collect()
    assert sorted((r.endpoint, tuple(r.chain), r.depth, len(r.guards)) for r in rows) == [
        ("e1", ("e1", "a", "t"), 2, 1), ("e2", ("e2", "b", "t"), 2, 0), ("e3", ("e3", "b", "t"), 2, 0)]
    roles = G.chain_roles(G.chains_up(calls, one("t"), one("e1"), 8)).collect()
    assert [r.role for r in sorted(roles, key=lambda r: r.pos)] == ["handler", "direct_caller", "target"]
    flows = G.flows(G.chains_up(calls, one("t"), one("e1", "e2", "e3"), 8)).collect()
    assert sorted(tuple(f.endpoints) for f in flows) == [("e1",), ("e2", "e3")]


def fns(spark, *names):
    return spark.createDataFrame([(n, n, n.startswith("h")) for n in names], "symbol string, name string, is_endpoint boolean")


IMPL = "concrete string, abstract string, impl_type string, trait_name string, trait_args array<string>, method string"


def endpoints(spark, functions, edges, implements, target, depth=8):
    out = I.impact(functions, calls_of(spark, edges), spark.createDataFrame(implements, IMPL), spark.createDataFrame([(target,)], "symbol string"), depth)
    return sorted((r.endpoint, ">".join(r.chain), r.impl_type) for r in out.collect())


def test_impact_bridges_to_the_abstract_method(spark):
    f = fns(spark, "h1", "Stripe#CI#go", "CI#go", "core")
    impl = [("Stripe#CI#go", "CI#go", "Stripe", I.CONNECTOR_TRAIT, ["Auth"], "go")]
    assert endpoints(spark, f, [("core", "CI#go"), ("h1", "core")], impl, "Stripe#CI#go") == [("h1", "h1>core>Stripe#CI#go", "Stripe")]


def test_impact_prunes_other_type_parameters(spark):
    f = fns(spark, "h1", "h2", "h3", "Stripe#CI#go", "CI#go")
    impl = [("Stripe#CI#go", "CI#go", "Stripe", I.CONNECTOR_TRAIT, ["Capture"], "go")]
    edges = [("h1", "CI#go", None, None, None, "Capture"), ("h2", "CI#go", None, None, None, "Refund"), ("h3", "CI#go", None, None, None, "_")]
    assert [e[0] for e in endpoints(spark, f, edges, impl, "Stripe#CI#go")] == ["h1", "h3"]


def test_impact_prunes_other_match_arms_and_callers(spark):
    f = fns(spark, "h1", "h2", "h3", "h4", "Stripe#CI#go", "CI#go", "Adyen#X#f", "Adyen#CI#go")
    impl = [("Stripe#CI#go", "CI#go", "Stripe", I.CONNECTOR_TRAIT, [], "go"), ("Adyen#CI#go", "CI#go", "Adyen", I.CONNECTOR_TRAIT, [], "go")]
    edges = [
        ("h1", "CI#go", "match", "c", "Connector::Stripe | Connector::Adyen"), ("h2", "CI#go", "match", "c", "Connector::Adyen"), ("h3", "CI#go", "match", "c", "_"),
        ("Adyen#X#f", "CI#go"), ("h4", "Adyen#X#f"),
    ]
    assert [e[0] for e in endpoints(spark, f, edges, impl, "Stripe#CI#go")] == ["h1", "h3"]


def test_impact_depth_cycles_and_shared_endpoints(spark):
    f = fns(spark, "h1", "a", "b", "t", "h0")
    edges = [("a", "t"), ("b", "t"), ("h1", "a"), ("h1", "b"), ("t", "a"), ("h0", "h1")]
    assert [e[1] for e in endpoints(spark, f, edges, [], "t")] == ["h1>a>t", "h1>b>t"]
    assert endpoints(spark, f, edges, [], "t", depth=1) == []
    assert endpoints(spark, f, [("h0", "h1")], [], "h1") == [("h0", "h0>h1", None)]


def test_impact_type_parameter_becomes_the_lock(spark):
    f = fns(spark, "h1", "a", "t")
    assert endpoints(spark, f, [("a", "t", None, None, None, "Refund"), ("h1", "a")], [], "t") == [("h1", "h1>a>t", "Refund")]


def test_gate_and_false_edges(spark):
    inside = "call_connector_service"
    ends = spark.createDataFrame(
        [("x", ["x", inside, "t"]), ("y", ["y", inside, "t"]), ("z", ["z", "t"]), ("w", ["w", inside, "t"]), ("v", ["v", "helper", inside, "t"]), ("u", ["u", "payments_operation_core", "helper", inside])],
        "handler string, chain array<string>")
    gates = spark.createDataFrame([("Start", "always_false"), ("Confirm", "conditional"), ("_default", "always_false")], "op string, gate string")
    ops = spark.createDataFrame([("x", "Start", True), ("y", "Confirm", False), ("z", "Start", True), ("w", "Other", False), ("helper", "Unheard", True)], "function string, op string, exact boolean")
    found = {r.handler: r.connector_gate for r in I.gate(ends, gates, ops).collect()}
    # x starts what never calls one; v hands on what no gate knows and takes the default; u's walk ends before the helper
    assert found == {"y": "conditional", "z": None, "w": "conditional", "u": "conditional"}
    bodies = spark.createDataFrame([("x", f"calls {inside}()"), ("y", "calls nothing")], "handler string, body string")
    assert sorted(r.handler for r in I.prune_false_edges(ends, bodies).collect()) == ["u", "v", "w", "x", "z"]
    placed = ends.withColumns({"file": F.lit("f"), "def_line": F.when(F.col("handler") == "x", 10).otherwise(50)})
    near = spark.createDataFrame([("f", 12, "nothing"), ("f", 54, "nothing")], "file string, def_line int, body string")
    assert sorted(r.handler for r in I.prune_false_edges(placed, near).collect()) == ["u", "v", "w", "y", "z"]


def test_flows_and_matrix(spark):
    guards = [("h1 → a", "if", "if x.is_some()")]
    rows = [
        ("t", "POST", "/b", "h1", "Tr|Conn|A|m", ["h1", "a", "t"], guards), ("t", "POST", "/b", "h1", "Tr|Conn|A|m", ["h1", "z", "a", "t"], []), ("t", "GET", "/a", "h2", None, ["h2", "t"], []),
        ("t", "PUT", "/c", "h3", None, ["h3", "t"], []), ("t", "PUT", "/c", "h4", None, ["h4", "t"], []),
    ]
    found = spark.createDataFrame([(*r, False) for r in rows], f"target string, http_method string, http_path string, handler string, spec string, chain array<string>, guards {I.GUARDS}, infeasible boolean")
    ends = I.dedup_endpoints(found)
    assert sorted((r.http_path, r.handler, len(r.chain)) for r in ends.collect()) == [("/a", "h2", 2), ("/b", "h1", 3), ("/c", "h3", 2), ("/c", "h4", 2)]
    flows = {r.flow_id: r for r in I.build_flows(ends).collect()}
    assert [(e.method, e.path, e.handler) for e in flows[1].endpoints] == [("GET", "/a", "h2"), ("PUT", "/c", "h3")] and flows[1].description == "path through h2 → t"
    assert (flows[2].description, flows[2].conditions_high, flows[2].conditions_missing, len(flows)) == ("x.is_some()", 1, 0, 2)
    assert [(n.function, n.role, n.condition_type) for n in flows[2].nodes] == [("h1", "handler", "if"), ("a", "direct_caller", "unconditional"), ("t", "target", None)]
    matrix = {r.endpoint: r for r in I.reachability(ends, I.build_flows(ends), spark.createDataFrame([("Conn",)], "connector string")).collect()}
    assert {k: r.impact_status for k, r in matrix.items()} == {"GET /a": "Impacted", "POST /b": "Conditionally Impacted (via Conn)", "PUT /c": "Impacted"}
    assert matrix["POST /b"].spec == "Tr|Conn|A|m" and [tuple(g) for g in matrix["POST /b"].guard_conditions] == [("h1", "if", "if x.is_some()")]


def test_prerequisites(spark):
    flows = spark.createDataFrame([(1, "ConnectorIntegration|Acme||m", "Acme", "ConnectorIntegration"), (2, "Op", "Op", None), (3, None, None, None)], "flow_id int, spec string, impl_type string, trait string")
    said = spark.createDataFrame([(1, "profile.is_auto_retries_enabled"), (1, "profile.webhook_url.is_some()"), (2, "request.get_email().is_some()"), (3, "config.unheard")], "flow_id int, condition string")
    ends = spark.createDataFrame(
        [("a", True, "POST", "/account/{id}/toggle-auto-retries"), ("b", True, "PUT", "/account/{id}/business_profile"), ("c", True, "POST", "/profile"), ("d", True, "GET", "/profile/auto/retries")],
        "symbol string, is_endpoint boolean, http_method string, http_path string")
    fields = spark.createDataFrame([("ProfileUpdate", "webhook_url"), ("Other", "unheard")], "struct string, field string")
    found = {(r.flow_id, r.rule): (r.kind, r.field, r.value) for r in I.prerequisites(flows, said, ends, fields).collect()}
    assert found == {
        (1, 1): ("profile_config", "is_auto_retries_enabled", "POST /account/{id}/toggle-auto-retries"), (1, 2): ("profile_config", "webhook_url", "PUT /account/{id}/business_profile"),
        (1, 3): ("concrete_type", "connector", "Acme"), (2, 3): ("concrete_type", "operation_type", "Op"), (2, 4): ("request_field", "email", "true")}


def test_dispatched_operations():
    from tidemark.sources import rust

    text = """fn a() { payments_core::<api::Capture, _>(state, payments::PaymentCapture, data) }
fn b() { x::payments_operation_core::<PaymentCreate>(s) }
fn c() { payments_core(PaymentUpdate::new(1), y) }
fn d() { payments_core(PaymentsRequestData { a }, CompleteAuthorize { x: 1 }) }
fn e() { other(PaymentX) }
"""
    assert list(rust.dispatched(text)) == [("a", 1, "PaymentCapture"), ("b", 2, "PaymentCreate"), ("c", 3, "PaymentUpdate"), ("d", 4, "CompleteAuthorize")]


def test_verdicts_prompts_and_bodies(spark):
    flows = spark.createDataFrame([(1, [("GET", "/a"), ("PUT", "/b")]), (2, [("PUT", "/b")])], "flow_id int, endpoints array<struct<method:string,path:string>>")
    left = spark.createDataFrame([("GET", "/a")], "method string, path string")
    assert [(r.flow_id, [tuple(e) for e in r.endpoints]) for r in I.prune_flows(flows, left).collect()] == [(1, [("GET", "/a")])]
    rows = spark.createDataFrame([("p",)], "x string")
    assert I.ask(rows, F.concat(F.lit("q:"), "x"), str.upper).first().answer == "Q:P" and I.ask(rows, F.col("x")).first().answer is None
    body = spark.range(1).select(I.trigger_body(F.lit("/refunds"), F.array(F.lit("x"))).alias("b")).first().b
    assert body == '{"amount":500,"payment_id":"pay_test_001","reason":"customer_request"}'


def test_lookups_of_the_impact_query(spark):
    f = spark.createDataFrame([("a", "n", "tests/x.rs"), ("b", "n", "src/y.rs"), ("c", "n", "src/z.rs"), ("i", "T#Tr#m", "src/i.rs"), ("t", "t", "src/t.rs"), ("u", "u", "src/u.rs")], "symbol string, name string, file string")
    assert {r.name: r.symbol for r in I.best_by_name(f).collect()} == {"n": "b", "T#Tr#m": "i", "t": "t", "u": "u"}
    calls = calls_of(spark, [("a", "t"), ("i", "t"), ("a", "u"), ("c", "u")])
    targets = spark.createDataFrame([("t",), ("u",)], "symbol string")
    assert sorted(tuple(r) for r in I.relevant_files(targets, calls, f).collect()) == [("t", "src/i.rs"), ("u", "src/z.rs"), ("u", "tests/x.rs")]
    impls = spark.createDataFrame([("f", "Stripe", 3), ("f", "Adyen", 9)], "file string, type string, line int")
    bodies = spark.createDataFrame([("f", 3, "go"), ("f", 9, "other"), ("g", 9, "go")], "file string, function_line int, callee string")
    assert [r.type for r in I.calling_types(impls, bodies, "go").collect()] == ["Stripe"]
    said = [("x", "a::<payments::PaymentData>(payments::PaymentCreate)"), ("y", "payments::operations::PaymentResponse"), ("z", "payments::Other"), ("w", "payments::CompleteAuthorize")]
    ops = I.operation_of(spark.createDataFrame(said, "handler string, body string"))
    assert {r.handler: r.op for r in ops.collect()} == {"x": "PaymentCreate", "y": "PaymentResponse", "z": None, "w": "CompleteAuthorize"}
    import json

    one = spark.createDataFrame([(1, "x")], "a int, b string")
    said = [(r.section, json.loads(r.value)) for r in I.document('f"', one, one.limit(0), one).collect()]
    assert said == [("head", {"changed_function": 'f"', "endpoint_count": 1, "flow_count": 0}), ("endpoints", {"a": 1, "b": "x"}), ("reachability_matrix", {"a": 1, "b": "x"})]


def test_small_catalogue_and_report_lookups(spark):
    from tidemark.operators import catalog as T
    from tidemark.operators import report as R

    specs = spark.createDataFrame([("b", "/payments"), ("a", "/payments/:id"), ("0", "/x")], "spec_file string, path string")
    assert T.similar_spec(specs).first().spec_file == "a"
    runs = spark.createDataFrame([("r", 2, 0, [], 3, 0), ("s", 0, 1, ["Error: 401 Unauthorized"], 0, 0)], "run_id string, passing int, failing int, errors array<string>, probed int, hit int")
    assert [tuple(r) for r in R.overview(runs).orderBy("run_id").collect()] == [("r", "ok", ["2 tests passed"], ["target not reached"]), ("s", "failed", [], ["credentials"])]
    reports = spark.createDataFrame([("r", "{}")], "run_id string, report string")
    assert {r.run_id: r.report for r in R.without_coverage(runs.select("run_id"), reports).collect()} == {"r": "{}", "s": '{"status":"coverage_unavailable"}'}
