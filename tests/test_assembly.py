"""From a small Rust tree and an index of it to the endpoints that a change reaches."""

from tidemark.operators import assembly as A
from tidemark.operators import impact as I

TREE = {
    "crates/conn/adyen.rs": """impl ConnectorIntegration<Authorize, Data> for Adyen {
    fn build_request(&self) {
        shared_leaf();
    }
}
impl ConnectorIntegration<Capture, Data> for Stripe {
    fn build_request(&self) {
        shared_leaf();
    }
}
""",
    "crates/core/flow.rs": """pub fn run_step(c: Connector) {
    match c {
        Connector::Adyen => {
            call_connector::<Authorize>(c);
        }
        Connector::Stripe => {
            call_connector::<Capture>(c);
        }
        _ => {}
    }
}
pub fn shared_leaf() {}
pub trait ConnectorIntegration {
    fn build_request(&self);
}
""",
    "crates/routes/app.rs": """fn server() {
    web::scope("/payments")
        .service(web::resource("/{id}/confirm").route(web::post().to(confirm)))
}
""",
    "crates/routes/handlers.rs": """pub async fn confirm() {
    if enabled {
        run_step(c);
    }
}
""",
}
# what an index knows: the methods' place in the first file is missing, as generated code often is
FUNCTIONS = [
    ("core/run_step", "run_step", "crates/core/flow.rs", 1), ("core/leaf", "shared_leaf", "crates/core/flow.rs", 12), ("core/abstract", "ConnectorIntegration#build_request", "crates/core/flow.rs", 14),
    ("core/dispatch", "call_connector", "crates/core/dispatch.rs", 1), ("routes/confirm", "confirm", "crates/routes/handlers.rs", 1), ("routes/server", "server", "crates/routes/app.rs", 1),
]
CALLS = [
    ("core/run_step", "core/abstract", "crates/core/flow.rs", 4), ("core/run_step", "core/dispatch", "crates/core/flow.rs", 7), ("routes/confirm", "core/run_step", "crates/routes/handlers.rs", 3),
]


def build(spark):
    files = spark.createDataFrame(list(TREE.items()), "file string, text string")
    functions = spark.createDataFrame(FUNCTIONS, "symbol string, name string, file string, def_line int")
    calls = spark.createDataFrame(CALLS, "caller string, callee string, file string, line int")
    return A.assemble(files, functions, calls)


def test_from_sources_to_impact(spark):
    graph = build(spark)
    nodes = {r.symbol: r for r in graph["functions"].collect()}
    adyen, stripe = "synthetic://crates/conn/adyen.rs::2", "synthetic://crates/conn/adyen.rs::7"
    assert nodes[adyen].name == "Adyen#ConnectorIntegration<Authorize,Data>#build_request" and nodes[stripe].impl_type == "Stripe"
    assert (nodes["routes/confirm"].is_endpoint, nodes["routes/confirm"].http_path) == (True, "/payments/{id}/confirm") and not nodes["core/leaf"].is_endpoint
    implements = {r.concrete: (r.abstract, r.impl_type, r.trait_args, r.method) for r in graph["implements"].collect()}
    assert implements == {adyen: ("core/abstract", "Adyen", ["Authorize", "Data"], "build_request"), stripe: ("core/abstract", "Stripe", ["Capture", "Data"], "build_request")}
    calls = {(r.caller, r.callee): r for r in graph["calls"].collect()}
    assert calls[adyen, "core/leaf"].synthetic and calls[stripe, "core/leaf"].line == 8
    step = calls["core/run_step", "core/abstract"]
    assert (step.guard_type, step.guard_condition, step.match_arm, step.synthetic) == ("match", "c", "Connector::Adyen", False)
    assert calls["core/run_step", "core/dispatch"].type_param == "Capture"
    found = I.impact(graph["functions"], graph["calls"], graph["implements"], spark.createDataFrame([("core/leaf",)], "symbol string"))
    (row,) = found.collect()  # the arm that leads to the trait's method is Adyen's: the path through Stripe ends there
    assert (row.endpoint, row.impl_type, row.depth) == ("routes/confirm", "Adyen", 3) and row.chain == ["routes/confirm", "core/run_step", adyen, "core/leaf"]
    assert [(g.at_hop, g.guard_type) for g in row.guards] == [(f"run_step → {nodes[adyen].name}", "match"), ("confirm → run_step", "if")]


def test_summary_and_traits(spark):
    graph = build(spark)
    assert {r.measure: r.n for r in A.summary(graph["functions"], graph["calls"], graph["implements"]).collect()} == {
        "functions_with_trait": 2, "implements": 2, "calls_with_type": 1, "synthetic_calls": 2}
    assert [tuple(r) for r in A.trait_map(graph["functions"]).collect()] == [("ConnectorIntegration", ["Adyen", "Stripe"])]
    assert sorted(r.type for r in A.concrete_types(graph["functions"]).collect()) == ["Adyen", "Stripe"]


def test_seeds(spark):
    graph = build(spark)
    places = spark.createDataFrame([("/crates/conn/adyen.rs", 3), ("crates/core/flow.rs", 12), ("crates/core/flow.rs", 0)], "file string, line int")
    found = {r.symbol: r.seed for r in I.seeds(graph["functions"], places).collect()}
    assert tuple(found["synthetic://crates/conn/adyen.rs::2"]) == ("Adyen", "ConnectorIntegration", ["Authorize", "Data"], "build_request") and found["core/leaf"] is None and len(found) == 2
