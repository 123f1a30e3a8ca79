"""Table functions from SQL against the parsers' frame form."""

import pytest

from __spark_entry__ import queries
from tidemark.sources import table_functions as T
from tidemark.sources.files import parsed

RUST = """
pub fn open(a: u8) -> u8 { a }
impl<T> Flow<Auth, m::Data> for Bank<T> {
    async fn go(&self) -> u8 { helper() }
    // fn not_this() {}
}
pub type Router = dyn m::Boxed<First, u8>;
web::resource("/payments/{id}").route(web::get().to(pay::show))
"""
JS = """
export const connectorDetails = {
  card_pm: {
    Capture: { Request: { amount_to_capture: 6, currency: "EUR" }, Response: { status: 200 } },
    Refund: getCustomExchange({ Request: { amount: 5 }, Response: { status: 201 } }),
  },
};
describe("x", () => { it("pays", () => {}); xit("waits", () => {}); });
"""
TRACE = "SF:/src/a.rs\nDA:1,2\nDA:1,3\nend_of_record\nSF:/src/b.rs\nend_of_record\nSF:cut.rs\nDA:4,1"
LOG = "  Running:  a.cy.js\nSTEP: pay\n  (Results)\n Tests: 2 │\n Passing: 1 │\n Failing: 1 │\n  Running: b.cy.js\ncrashed\n"


@pytest.mark.parametrize("name", sorted(T.FUNCTIONS))
def test_sql_gives_what_the_frame_form_gives(spark, name):
    texts = [(f"f{k}", t) for k, t in enumerate([RUST, JS, TRACE, LOG, "", None, "}{ ( <", RUST * 3, "é fn x() {"])]
    files = spark.createDataFrame(texts, "file string, text string, t string".rsplit(",", 1)[0])
    T.install(spark)
    T.install(spark)  # again, by the same names
    found = spark.sql(f"SELECT f.file, t.* FROM {{files}} f, LATERAL {name}(f.text) t", files=files)
    parser, columns = T.FUNCTIONS[name]
    want = parsed(files, parser, columns)
    assert found.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect())) != []


def test_table_functions_run_on_arrow_without_a_shuffle(spark):
    T.install(spark)
    files = spark.createDataFrame([("f", RUST)], "file string, text string")
    plan = spark.sql("SELECT f.file, r.path FROM {files} f, LATERAL routes(f.text) r", files=files)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPythonUDTF" in plan and "Exchange" not in plan


def test_items_of_every_kind():
    found = list(T.items(RUST))
    assert [x[:2] for x in found] == [("function", "open"), ("function", "go"), ("method", "go"), ("alias", "Router")]
    assert found[2][3:] == ("Bank", "Flow", "Auth,Data") and found[3][3] == "First"


def test_trace_rows_are_made_once(spark, sf_dir):
    plan = queries()["sql_lcov_lines"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lcov_lines") == 1 and "Join" not in plan[: plan.index("lcov_lines")]
