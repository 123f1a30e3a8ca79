"""From a small repository's JavaScript to the tables of the catalogue and the questions put to them."""

import pytest

from tidemark.functions import catalog_values as V
from tidemark.operators import catalog as T
from tidemark.sources import files, test_catalog
from tidemark.sources.catalog_store import Catalog

BLOCK = "{ Request: { amount_to_capture: 100 }, Response: { status: 200, body: {} } }"
REPO = {
    "cypress/e2e/configs/Payment/Adyen.js": f"export const connectorDetails = {{ card_pm: {{ Capture: {BLOCK}, Overcapture: {BLOCK}, Void: {{ Request: {{}} }} }} }};",
    "cypress/e2e/configs/Payment/Stripe.js": f"export const connectorDetails = {{ card_pm: {{ Capture: {BLOCK}, Overcapture: {BLOCK}, ConnectorAgnosticNTID: {BLOCK}, Pix: {BLOCK} }} }};",
    "cypress/e2e/configs/Payment/Commons.js": f"export const connectorDetails = {{ Refund: {BLOCK} }};",
    "cypress/e2e/configs/Payment/Utils.js": 'export const CONNECTOR_LISTS = { INCLUDE: { OVERCAPTURE: ["adyen", "worldpay"] }, EXCLUDE: { CONNECTOR_AGNOSTIC_NTID: ["stripe"] } };',
    "cypress/e2e/spec/Payment/00011-Capture.cy.js": 'describe("Capture", () => { it("captures", () => { cy.captureCallTest(a); });\n xit("again", () => { get()["card_pm"]["Overcapture"]; }); });',
    "cypress/e2e/spec/Payout/00001-Other.cy.js": 'describe("x", () => { it("odd name%=", () => {}); });',
    "cypress/e2e/spec/Other/00001-No.cy.js": 'it("no", f)',
    "node_modules/cypress/e2e/spec/Payment/x.cy.js": 'it("no", f)',
}


@pytest.fixture
def repository(spark, tmp_path):
    root = tmp_path / "the repo"
    for name, text in REPO.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return root


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_from_files_to_status(spark, repository, tmp_path):
    catalog = Catalog(spark, f"{tmp_path}/catalog")
    counts = test_catalog.index(catalog, files.whole_files(spark, str(repository), "*.js"))
    assert dict(rows(counts)) == {"connector": 3, "flow_config": 6, "spec_file": 2, "test_case": 3, "feature_list": 2}
    assert rows(catalog.table("connector").select("connector")) == [("Adyen",), ("Stripe",), ("WorldPay",)]
    assert rows(catalog.table("test_case").select("id", "suite", "line", "skipped")) == [
        ("00001-Other::odd name%=", "Payout", 1, False), ("00011-Capture::again", "Payment", 2, True), ("00011-Capture::captures", "Payment", 1, False),
    ]
    assert rows(catalog.table("calls_endpoint").select("path").distinct()) == [("/payments/:id/capture",)]
    assert rows(catalog.table("in_list")) == [("Adyen", "INCLUDE.OVERCAPTURE"), ("Stripe", "EXCLUDE.CONNECTOR_AGNOSTIC_NTID"), ("WorldPay", "INCLUDE.OVERCAPTURE")]
    assert rows(catalog.table("maps_to")) == [("Capture", "POST:/payments/:id/capture"), ("Overcapture", "POST:/payments/:id/capture"), ("Pix", "POST:/payments")]
    tests = catalog.table("tests_flow").select("flow", "spec_file")
    status = T.grid_status(catalog.table("connector"), catalog.table("flow_config"), catalog.table("in_list"), test_catalog.flow_list(spark), tests)
    found = {(r.connector, r.flow): r.status for r in status.collect()}
    assert found["Adyen", "Capture"] == found["Stripe", "Capture"] == "COVERED" and found["WorldPay", "Capture"] == "MISSING_CONFIG"
    assert (found["Adyen", "Overcapture"], found["Stripe", "Overcapture"]) == ("COVERED", "NOT_IN_ALLOWLIST")
    assert (found["Stripe", "ConnectorAgnosticNTID"], found["Stripe", "Pix"], found["Adyen", "PaymentWebhook"]) == ("COVERED", "MISSING_TEST", "MISSING_CONFIG")


def test_targeted_reindex(spark, repository, tmp_path):
    catalog = Catalog(spark, f"{tmp_path}/catalog")
    test_catalog.index(catalog, files.whole_files(spark, str(repository), "*.js"))
    changed = [
        ("cypress/e2e/configs/Payment/Stripe.js", "export const connectorDetails = {};"),
        ("cypress/e2e/spec/Payment/00012-New.cy.js", 'it("new", () => cy.refundTest(x))'),
    ]
    counts = test_catalog.reindex(catalog, spark.createDataFrame(changed, "file string, text string"))
    assert dict(rows(counts)) == {"connector": 3, "flow_config": 2, "spec_file": 3, "test_case": 4, "feature_list": 2}
    assert rows(catalog.table("flow_config").select("connector", "flow")) == [("Adyen", "Capture"), ("Adyen", "Overcapture")]
    assert rows(catalog.table("tests_flow").where("flow = 'Refund'").select("spec_file")) == [("cypress/e2e/spec/Payment/00012-New.cy.js",)]


def test_ladder_is_by_flow(spark):
    """A list gates only the flows that have it, and connectors without any list have rows."""
    config = spark.createDataFrame([(c, f, "b") for c in ("c1", "c2") for f in ("Refund", "Over")], "connector string, flow string, raw_block string")
    lists = spark.createDataFrame([("c1", "EXCLUDE.X")], "connector string, list_key string")
    gates = spark.createDataFrame([("Over", "INCLUDE.O", None), ("Agnostic", None, "EXCLUDE.X")], "flow string, include_key string, exclude_key string")
    found = T.grid_status(config.select("connector"), config, lists, gates, spark.createDataFrame([("Over",)], "flow string"))
    assert rows(found) == sorted([
        ("c1", "Refund", "MISSING_TEST", None), ("c2", "Refund", "MISSING_TEST", None), ("c1", "Over", "NOT_IN_ALLOWLIST", "INCLUDE.O"), ("c2", "Over", "NOT_IN_ALLOWLIST", "INCLUDE.O"),
        ("c1", "Agnostic", "MISSING_CONFIG", None), ("c2", "Agnostic", "MISSING_CONFIG", None)], key=str)


def test_values(spark):
    assert len(V.FLOW_ENDPOINTS) == 42 and len(V.CONNECTOR_NAMES) == 71 and len(V.KNOWN_FLOWS) == 40
    names = spark.createDataFrame([("adyen",), ("WELLSFARGO",), ("Own Name ",)], "n string").select(test_catalog.connector_name("n"))
    assert [r[0] for r in names.collect()] == ["Adyen", "WellsFargo", "Own Name"]
    paths = spark.createDataFrame([("a/b.js",), ("/a",), ("a/../b",)], "p string")
    from pyspark.sql import functions as F

    assert [r[0] for r in paths.select(T.safe_path(F.col("p"))).collect()] == [True, False, False]
