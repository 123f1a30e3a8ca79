"""Texts are scanned once, and what a spec's tests have in common needs no shuffle."""

from collections import Counter

from pyspark.sql import functions as F

from tidemark.functions.catalog_values import COMMAND_FLOWS, KNOWN_FLOWS
from tidemark.operators import catalog
from tidemark.sources import js, test_catalog
from tidemark.sources.files import parsed

SPEC = 'import "../h";\ndescribe("d", () => {\n  it("a", () => { cy.captureCallTest(x); });\n  it("a", () => { get(x)["card_pm"]["Refund"]; });\n  xit(`b`, () => {});\n});\n'


def test_a_spec_is_scanned_once(monkeypatch):
    scans, scan = [], js._tokens
    monkeypatch.setattr(js, "_tokens", lambda text: scans.append(text) or scan(text))
    assert js.spec(SPEC, KNOWN_FLOWS, list(COMMAND_FLOWS)) == (["d"], ["../h"], ["Capture", "Refund"], [("a", 3, False), ("a", 4, False), ("b", 5, True)])
    assert len(scans) == 1


def test_tables_of_specs_need_no_shuffle(spark):
    files = spark.createDataFrame([(f"cypress/e2e/spec/Payment/{k}-Spec.cy.js", SPEC) for k in "12"], "file string, text string")
    found = test_catalog.spec_tables(test_catalog.spec_files(files))
    for name in ("test_case", "tests_flow", "calls_endpoint"):
        assert "Exchange" not in found[name]._jdf.queryExecution().executedPlan().toString(), name
    flows = Counter((r.id, r.flow) for r in found["tests_flow"].collect())
    assert flows == Counter((f"{k}-Spec::{t}", f) for k in "12" for t in "ab" for f in ("Capture", "Refund"))
    calls = Counter((r.id, r.path) for r in found["calls_endpoint"].collect())
    assert calls == Counter((f"{k}-Spec::{t}", p) for k in "12" for t in "ab" for p in ("/payments/:id/capture", "/refunds"))


def test_a_grid_reads_its_configurations_once(spark, tmp_path):
    log = str(tmp_path / "read")

    def one_flow(text):
        with open(log, "a") as f:
            f.write("x")
        yield (text,)

    files = spark.createDataFrame([("c1", "A"), ("c2", "B")], "file string, text string")
    config = parsed(files, one_flow, "flow string").withColumnRenamed("file", "connector")
    tested = parsed(files.where("text = 'A'"), one_flow, "flow string").select("flow")
    lists = spark.createDataFrame([], "connector string, list_key string")
    of_flow = spark.createDataFrame([], "flow string, include_key string, exclude_key string")
    rows = catalog.grid_status(spark.createDataFrame([("c3",)], "connector string"), config, lists, of_flow, tested)
    found = Counter(r[0] for r in rows.select(F.col("status")).collect())
    assert found == {"MISSING_CONFIG": 4, "COVERED": 1, "MISSING_TEST": 1}
    assert len(open(log).read()) == 3
