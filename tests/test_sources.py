"""Parsers on small inputs."""

import json

from pyspark.sql import functions as F

from tidemark.operators import report as R
from tidemark.sources import coverage_files as C
from tidemark.sources import files, js, run_logs, rust, scip

RUST = """// fn not_this() {
impl<T> ConnectorIntegration<Authorize, Data, Resp> for Stripe where T: X {
    fn build_request(&self, a: Vec<u8>) -> Option<String> {
        if let Some(x) = self.a { match x.kind { A => foo_bar(x), _ => other::call_it::<Refund>(x) } }
        let mut token = Token { a: 1 };
        helper_one(&token);
        for i in 0..3 { step_two(i); }
        "}}}{ // not";
    }
    async fn second(&self) { while self.go() { run_loop(); } }
}
type A = dyn Boxed<Capture, X>;
pub async fn top() {}
"""


def frame(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "file string, text string")


def test_rust():
    assert list(rust.impls(RUST)) == [("ConnectorIntegration", "Authorize,Data,Resp", "Stripe", "build_request", 3), ("ConnectorIntegration", "Authorize,Data,Resp", "Stripe", "second", 10)]
    assert list(rust.generic_calls(RUST)) == [("call_it", "Refund", 4)] and list(rust.aliases(RUST)) == [("A", "Capture", 0)]
    assert list(rust.bound_calls(RUST)) == [("helper_one", "Token", 6)]
    assert {c for _, _, c, _ in rust.body_calls(RUST)} == {"call_it", "foo_bar", "helper_one", "step_two", "run_loop"}
    guards = {(lo, kind, c) for lo, _, _, kind, c, _ in rust.guard_spans(RUST) if kind != "stop"}
    assert guards == {(4, "if_let", "let Some(x) = self.a"), (4, "match", "x.kind"), (7, "for", "i in 0..3"), (10, "while", "self.go()")}
    assert list(rust.public_functions(RUST)) == [("top", 13)] and rust.body_span("fn f(\n a: u8,\n) {\n x\n}\n", 124) == (126, 128)
    assert rust.body_span("no function", 1) is None and rust.snippet("fn f(\n a: u8,\n) {\n x\n}\nfn g() {}", 1) == "fn f(\n a: u8,\n) {\n x\n}"
    assert list(rust.struct_fields("pub struct A {\n x: u8,\n}\nstruct B { x: u8 }", "x:")) == [("A", 2), ("B", 4)]
    assert list(rust.generic_calls("run(Confirm { a: 1 }, x); match (Foo { a }) {}")) == [("run", "Confirm", 1)]


def test_guard_spans_with_arms_and_closures():
    text = """fn f() {
    match x {
        Connector::A | Connector::B => one(),
        Connector::C if y => {
            two();
        }
        E { a, .. } => three(Some(1), 2),
        _ => four(),
    }
    if a { b() } else if c {
        d()
    } else {
        e();
    }
    run(|item| {
        g(item)
    });
}
"""
    spans = list(rust.guard_spans(text))
    assert [(lo, hi, arm) for lo, hi, _, kind, _, arm in spans if kind == "match"] == [
        (2, 9, None), (3, 3, "Connector::A | Connector::B"), (4, 6, "Connector::C if y"), (7, 7, "E { a, .. }"), (8, 8, "_")]
    assert [(lo, hi, c) for lo, hi, _, kind, c, _ in spans if kind == "if"] == [(10, 14, "a"), (10, 14, "c")]
    assert [(lo, hi) for lo, hi, _, kind, _, _ in spans if kind == "stop"] == [(1, 18), (15, 17)]


def test_noise_is_no_call():
    names = "map_err into_iter spawn flatten try_from attach_printable change_context get_id push some_call"
    assert [c for _, _, c, _ in rust.body_calls("fn f() { " + "; ".join(f"x.{n}()" for n in names.split()) + " }")] == ["get_id", "some_call"]


def test_routes_and_gates():
    text = 'web::scope("/payments")\n  .service(\n    web::resource("/{id}/confirm")\n      .route(web::post().to(payments::confirm)))\n  .service(web::resource("").route(web::get().to(list)))\nweb::scope("/v2/x")\n  .route(web::get().to(gone))\n'
    assert list(rust.routes(text)) == [("POST", "/payments/{id}/confirm", "confirm", 0), ("GET", "/payments", "list", 1)]
    gate = 'pub fn gate() -> bool {\n  match format!("{o:?}").as_str() {\n    "A" => true,\n    "B" => { x && y },\n    "C" => false,\n    _ => true,\n  }\n}'
    assert dict(rust.gates(gate, "pub fn gate")) == {"A": "always_true", "B": "conditional", "C": "always_false", "_default": "always_true"} and not list(rust.gates(gate, "absent"))


def test_whole_files(spark, tmp_path):
    for name in ("a/x.rs", "target/y.rs", "a/z.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(RUST)
    found = files.whole_files(spark, str(tmp_path))
    assert [r.file for r in found.collect()] == ["a/x.rs"]
    assert files.parsed(found, rust.public_functions, "name string, line int").collect() == [("a/x.rs", "top", 13)]
    assert files.matching_lines(found, "pub async").first().line_no == 13
    (tmp_path / "coverage_v1.json").write_text("{}")
    (tmp_path / "coverage_v2.json").write_text("{}")
    assert [r.tag for r in files.builds(spark, str(tmp_path)).collect()] == ["v2", "v1"]
    listed = spark.createDataFrame([("r1", "final_report.json"), ("r1", "x"), ("r2", "x"), ("r3", "coverage_run_report.json")], "run string, name string")
    assert [tuple(r) for r in files.runs(listed).collect()] == [("r3", 1), ("r1", 2)]


def test_coverage_trees(spark):
    tree = {"children": {"src": {"children": {"a.rs": {"coverage": [-1, 0, 3, 0], "linesCovered": 1, "linesMissed": 2, "linesTotal": 3, "coveragePercent": 33.3}, "empty": {"children": {}}}}}}
    row = C.tree_files(frame(spark, r=json.dumps(tree))).first()
    assert (row.filename, row.missed, row.uncovered) == ("src/a.rs", 2, [2, 4])
    said = spark.createDataFrame([('{"data": [{"files": []}]}',), ('{"data": 1}',), ("x",)], "t string").select(F.coalesce(C.is_llvm(F.col("t")), F.lit(False)))
    assert [r[0] for r in said.collect()] == [True, False, False]


def test_llvm(spark, tmp_path):
    stat = lambda n, c: {"count": n, "covered": c, "percent": 1.0}
    summary = {"lines": stat(10, 4), "functions": stat(2, 1), "regions": {"count": 8, "covered": 0, "notcovered": 3}}
    (tmp_path / "c.json").write_text(json.dumps({"data": [{"files": [{"filename": "a.rs", "summary": summary}], "functions": [{"name": "f", "count": 2, "filenames": ["a.rs"]}]}]}))
    assert tuple(C.llvm_files(spark, str(tmp_path / "c.json")).first()) == ("a.rs", 4, 10, 1, 2, 5, 8)
    assert tuple(C.llvm_functions(spark, str(tmp_path / "c.json")).first()) == ("f", 2, "a.rs")


def test_lcov(spark):
    text = "SF:/r/a.rs\nDA:1,2\nDA:1,3\nDA:2,0\nend_of_record\nSF:/r/b.rs\nDA:1,1\nend_of_record\nSF:/r/a.rs\nDA:1,1\nDA:1,5\nend_of_record\n"
    summed = {(r.file, r.line): r.hits for r in C.lcov(frame(spark, t=text), root="/r").collect()}
    assert summed == {("a.rs", 1): 6, ("b.rs", 1): 1}
    last = C.lcov(frame(spark, t=text), "last", "/r/")
    assert {(r.file, r.line): r.hits for r in last.collect()} == {("a.rs", 1): 5, ("a.rs", 2): 0, ("b.rs", 1): 1}
    assert C.lcov_of(C.lcov(frame(spark, t=text)), "a.rs").count() == 1
    table = C.line_table(frame(spark, t=" 12  3 let x\n 13 (no DA) y\n 12 4 z"))
    assert [tuple(r) for r in table.collect()] == [("t", 12, 4)]


CONFIG = """export const connectorDetails = { card_pm: { Capture: { Request: { amount_to_capture: 100, currency: "USD", currency: "EUR" }, Response: { status: 200, body: {} } },
  Void: { Request: {} }, Capture: { Request: {x: 1}, Response: {} } } };"""


def test_js():
    ((flow, block, status, fields, has, over),) = js.flow_configs(CONFIG)
    assert (flow, status, fields, has, over) == ("Capture", 200, {"amount_to_capture": "100", "currency": '"EUR"'}, True, False) and block.startswith("{ Request")
    lists = 'const CONNECTOR_LISTS = { INCLUDE: { A: ["x", // no "y"\n "z"] }, EXCLUDE: { B_C: [] , D: ["q",] } }'
    assert list(js.connector_lists(lists)) == [("INCLUDE.A", 0, "x"), ("INCLUDE.A", 1, "z"), ("EXCLUDE.B_C", -1, None), ("EXCLUDE.D", 0, "q")]
    spec = 'describe("s", () => {\n it("one", f)\n xit(`two`, f)\n cy.incrementalAuthCallTest(x)["Refund"]["Nope"]\n})\nimport "../a"'
    assert list(js.tests(spec)) == [("one", 2, False), ("two", 3, True)] and js.suites(spec) == ["s"] and js.imports(spec) == ["../a"]
    assert js.flows_of(spec, frozenset(("Refund",)), [("incrementalauth", "Incremental"), ("auth", "Other")]) == ["Incremental", "Refund"]
    once = js.allow('x = {A: ["b"]}', "INCLUDE.A", "a")
    assert once == ('x = {A: ["a", "b"]}', True) == js.allow(once[0], "A", "a") and js.allow("x = {}", "A", "a") == ("x = {}", False)
    assert js.insert_after("x = {\n  A: { y: 1 },\n}", "A", "  B: { z: 2 },") == ("x = {\n  A: { y: 1 },\n  B: { z: 2 },\n}", True)
    assert js.insert_after("x = { card_pm: { C: {} } }", "A", "B: {},") == ("x = { card_pm: { C: {},\nB: {},\n  } }", True) and js.insert_after("x", "A", "B") == ("x", False)
    assert js.last_flow(CONFIG) == "Capture" and js.last_flow("x") is None


def test_js_strings_and_comments():
    """Braces, keys and tests in strings and comments are none."""
    text = """/* connectorDetails = { */ export const connectorDetails = { // {
      Auto: { Request: { note: "}", /* x: 1 */ call: fn({ c: 3 }), list: [1, 2] }, Response: { body: { status: "ok", t: `{` }, status: 201 } },
      // Dead: { Request: {}, Response: {} },
      Last: { Configs: {}, Request: {}, Response: {} } }"""
    found = {f: (s, r) for f, _, s, r, *_ in js.flow_configs(text)}
    assert found == {"Auto": (201, {"note": '"}"', "call": "fn({ c: 3 })", "c": "3", "list": "[1, 2]"}), "Last": (None, {})}
    assert js.last_flow(text) == "Last" and js.insert_after(text, "Auto", "New: {},")[0].index("New") > text.index("201")
    assert list(js.tests('// it("no")\nit(\n  "three) {", f); it(\'single\'); "it(`x`)"; fit("a")')) == [("three) {", 2, False)]


def test_js_answers():
    said = "Sure.\n<new_flow_block>\nA: {\n  x: 1 }\n</new_flow_block> <file path='a/b.cy.js'>it</file><allowlist_update connector=\"adyen\" list=\"INCLUDE.A\" />"
    assert js.new_block(said) == "A: {\n  x: 1 }" and js.new_file(said) == ("a/b.cy.js", "it") and js.new_allowance(said) == ("adyen", "INCLUDE.A")
    assert (js.new_block("x"), js.new_file("<file>x</file>"), js.new_allowance("<allowlist_update list='A'/>")) == (None, None, None)
    assert js.settled("A: {\n}") == "    A: {\n    }," and js.settled("  A: 1,") == "  A: 1,"


LOG = """  ✓ works (12ms)
  2 passing (1m 23s)
  1 failing

  1) suite
       fails here:
     Error: expected 1
      + expected - actual
      second line
      at foo (x.js:1)

  x-request-id -> abc-1
  {"a": {"b": 1}}
"""


def test_run_logs(spark):
    assert run_logs.bodies(LOG) == ['{"a": {"b": 1}}'] and run_logs.first_object('```json\n{"x": 1}\n``` and') == '{"x": 1}'
    assert json.loads(run_logs.first_object('verdict: FALSE_POSITIVE, "reason": "why not"')) == {"verdict": "FALSE_POSITIVE", "reason": "why not"} and run_logs.first_object("no") is None
    assert run_logs.bodies('x {"a": {"b": [1]}' + " {" * 50_000 + ' {"c": 2}') == ['{"b": [1]}', '{"c": 2}']  # unclosed braces are no work
    run = "Running: a.cy.js\n STEP: pay\n status_code: 404\n (Results)\n Tests: 2\n Passing: 1\n Failing: -\n Duration: 3 seconds\nRunning: b.cy.js\n  1) breaks\n (Results)\n Failing: 1\n"
    assert [(s[0], s[1], s[4], s[5], s[7], s[9], s[10]) for s in run_logs.segments(run)] == [
        ("a.cy.js", 2, "3 seconds", "ok", ["pay"], ["404"], []), ("b.cy.js", 0, "", "failed", [], [], ["breaks"])]
    log = spark.createDataFrame([("l", k + 1, x) for k, x in enumerate(LOG.split("\n"))], "file_id string, line_no int, txt string")
    assert [tuple(r) for r in R.failure_blocks(log).collect()] == [("l", 1, "fails here", "Error: expected 1 | second line")]
    assert [r.test for r in R.failed_names(log).collect()] == ["suite"]
    whole = spark.createDataFrame([("l", LOG)], "id string, txt string")
    assert tuple(R.run_summary(whole).first()) == ("l", 2, 1, 83000, ["works"], 3) and tuple(R.test_summary(whole).first()) == ("l", 2, 1, 0, 0, 3, False)
    assert R.error_messages(whole).first().errors == ["expected 1"]
    times = spark.createDataFrame([("8s",), ("1m 23s",), ("350ms",), ("1.5s",), ("soon",), ("",)], "t string").select(R.duration_ms(F.col("t")).alias("ms"))
    assert [r.ms for r in times.collect()] == [8000, 83000, 350, 1500, 0, 0]
    ids = ["x-request-id=abc", '"x-request-id": "q1"', '"request_id": "null"', "X-Request-Id : h", '"request_id":"b"']
    found = spark.createDataFrame([(x,) for x in ids], "t string").select(R.request_id_list(F.col("t")).alias("ids")).collect()
    assert [r.ids for r in found] == [["abc"], ["q1"], [], ["h"], ["b"]]


def test_listings(spark, tmp_path):
    (tmp_path / "a folder").mkdir()
    (tmp_path / "a folder" / "x+y 1.rs").write_text("fn a() {}")
    assert [r.file for r in files.whole_files(spark, str(tmp_path / "a folder")).collect()] == ["x+y 1.rs"]
    (tmp_path / "index.json").write_text("{}")
    assert [r.tag for r in files.builds(spark, f"{tmp_path}/index.json").collect()] == ["local"]
    paths = spark.createDataFrame([("r", "a.json"), ("r", "logs/b.log"), ("r", "logs/deep/c.log"), ("r", "target/x/y"), ("r", "target/z")], "run string, path string")
    assert sorted(map(tuple, files.tree(paths).collect())) == [
        ("r", "a.json", False, 0, False), ("r", "logs", True, 2, False), ("r", "logs/b.log", False, 0, False), ("r", "logs/deep", True, 1, False),
        ("r", "logs/deep/c.log", False, 0, False), ("r", "target", True, 2, True)]


def field(number, value):
    data = value if isinstance(value, bytes) else None
    return bytes([number << 3 | 2, len(data)]) + data if data is not None else bytes([number << 3, value])


def test_scip(spark, tmp_path):
    occ = lambda line, symbol, roles: field(2, field(1, bytes([line, 0, 3])) + field(2, symbol.encode()) + field(3, roles))
    doc = field(1, b"src/a.rs") + occ(4, "m/f().", 1) + occ(6, "m/g().", 0) + occ(2, "m/g().", 0) + occ(7, "local 1", 0)
    data = field(1, b"x") + field(2, doc) + field(2, field(1, b"src/b.rs") + occ(1, "m/g().", 1)) + b"\x12\x7f"
    (tmp_path / "index.scip").write_bytes(data)
    nodes, sites = scip.call_graph(scip.read(spark, str(tmp_path / "index.scip")))
    assert sorted((r.symbol, r.name, r.file, r.def_line) for r in nodes.collect()) == [("m/f().", "f", "src/a.rs", 5), ("m/g().", "g", "src/b.rs", 2)]
    assert [tuple(r) for r in sites.collect()] == [("m/f().", "m/g().", "src/a.rs", 7)]


def test_many_small_files_are_one_frame():
    """A frame for each file took longer than all parsing."""
    import pandas as pd

    from tidemark.sources import files as S

    texts = [f"{k} {k + 1}" if k % 3 else None for k in range(3000)]
    batches = [pd.DataFrame({"file": [f"f{k}" for k in part], "text": [texts[k] for k in part]}) for part in (range(1700), range(1700, 3000))]
    made = list(S.frames(iter(batches), lambda t: ((int(x),) for x in t.split()), ["n"]))
    rows = pd.concat(made)
    assert len(made) == 1 and list(rows["n"]) == [x for k in range(3000) if k % 3 for x in (k, k + 1)] and list(rows["file"][:3]) == ["f1", "f1", "f2"]
    long = [pd.DataFrame({"file": ["a"] * 5, "text": ["1 " * (S.CHARS // 4)] * 5})]
    assert sum(map(len, S.frames(iter(long), lambda t: [(len(t),)], ["n"]))) == 5
