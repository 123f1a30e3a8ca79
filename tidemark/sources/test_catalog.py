"""The test catalogue from a repository's JavaScript: its files by kind, and the tables that they fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.catalog_values import COMMAND_FLOWS, CONNECTOR_NAMES, FLOW_ENDPOINTS, FLOW_EXCLUDE_LIST, FLOW_INCLUDE_LIST, KNOWN_FLOWS
from tidemark.sources import js
from tidemark.sources.catalog_store import Catalog
from tidemark.sources.files import parsed

# Where a repository keeps its configurations and specs, and which of the former are helpers.
CONFIGS, SPECS = "cypress/e2e/configs/Payment/", "cypress/e2e/spec/"
HELPERS = ("Commons.js", "Utils.js", "Modifiers.js")
SUITES = ("Payment", "Payout", "Routing")


def _named(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def connector_files(files: DataFrame) -> DataFrame:
    """Of files (file, text) the connectors' configurations."""
    return files.where(F.col("file").rlike(f"(^|/){CONFIGS}[^/]+[.]js$") & ~_named(F.col("file")).isin(*HELPERS))


def spec_files(files: DataFrame) -> DataFrame:
    """Of files (file, text) the specs, with their suite."""
    found = F.regexp_extract("file", f"(?:^|/){SPECS}({'|'.join(SUITES)})/[^/]+[.]cy[.]js$", 1)
    return files.withColumn("suite", found).where("suite <> ''")


def list_files(files: DataFrame) -> DataFrame:
    """Of files (file, text) the one with the connector lists."""
    return files.where(F.col("file").rlike(f"(^|/){CONFIGS}Utils[.]js$"))


def connector_name(name: Column) -> Column:
    """A connector's name as its table has it; unknown ones stay as they are."""
    known = F.create_map(*[F.lit(x) for pair in sorted(CONNECTOR_NAMES.items()) for x in pair])
    return F.coalesce(known[F.lower(F.trim(name))], F.trim(name))


def content_hash(text: Column) -> Column:
    return F.left(F.sha2(text, 256), F.lit(16))


def flow_endpoint(spark: SparkSession) -> DataFrame:
    """flow, method, path of the known flows."""
    return spark.createDataFrame(FLOW_ENDPOINTS, "flow string, method string, path string")


def flow_list(spark: SparkSession) -> DataFrame:
    """flow, include_key, exclude_key of the flows that have a list."""
    flows = sorted({*FLOW_INCLUDE_LIST, *FLOW_EXCLUDE_LIST})
    return spark.createDataFrame([(f, FLOW_INCLUDE_LIST.get(f), FLOW_EXCLUDE_LIST.get(f)) for f in flows], "flow string, include_key string, exclude_key string")


def connector_tables(files: DataFrame) -> dict[str, DataFrame]:
    """connector, flow_config, flow, supports_flow, endpoint, maps_to from configurations (file, text); source_file says which."""
    stem = F.regexp_replace(_named(F.col("file")), "[.]js$", "")
    source = files.select("file", "text", stem.alias("connector"))
    columns = "flow string, raw_block string, response_status int, request_fields map<string,string>, has_amount_to_capture boolean, has_enable_overcapture boolean"
    config = parsed(files, js.flow_configs, columns).withColumn("connector", stem).withColumnRenamed("file", "source_file")
    config = config.withColumn("id", F.concat_ws("::", "connector", "flow"))
    supports = config.select("connector", "flow", "source_file")
    known = flow_endpoint(files.sparkSession)
    used = config.select("flow").distinct()
    maps = known.join(used, "flow").select("flow", F.concat_ws(":", "method", "path").alias("endpoint_id"))
    return {
        "connector": source.select("connector", F.col("file").alias("source_file"), content_hash(F.col("text")).alias("file_hash")),
        "flow_config": config,
        "flow": used,
        "supports_flow": supports,
        "maps_to": maps,
        "endpoint": known.join(used, "flow").select(F.concat_ws(":", "method", "path").alias("id"), "method", "path").distinct(),
    }


def spec_tables(files: DataFrame) -> dict[str, DataFrame]:
    """spec_file, test_case, tests_flow, calls_endpoint from specs (file, text, suite); every test of a spec gets all its flows.

    A file is one row, so what its tests have in common is made distinct inside of it, without a shuffle.
    """
    name = F.regexp_replace(_named(F.col("file")), "([.]cy)?[.]js$", "")
    known, commands = KNOWN_FLOWS, list(COMMAND_FLOWS)

    def whole(text: str):
        suites, imports, flows, tests = js.spec(text, known, commands)
        yield suites, imports, flows, [dict(zip(("test_name", "line", "skipped"), t)) for t in tests]

    columns = "describes array<string>, imports array<string>, flows array<string>, tests array<struct<test_name:string,line:int,skipped:boolean>>"
    read = parsed(files.select("file", "text", "suite", content_hash(F.col("text")).alias("file_hash")), whole, columns, ["suite", "file_hash"])
    read = read.withColumn("spec_name", name).withColumnRenamed("file", "spec_file")
    tests = read.select("spec_name", "spec_file", "suite", F.explode("tests").alias("t")).select("*", "t.*").drop("t")
    tests = tests.withColumn("id", F.concat_ws("::", "spec_name", "test_name")).withColumn("source_file", F.col("spec_file"))
    ids = F.explode(F.array_distinct(F.transform("tests", lambda t: F.concat_ws("::", "spec_name", t["test_name"])))).alias("id")
    flows = read.select("spec_file", "flows", ids).select("id", "spec_file", F.explode("flows").alias("flow"), F.col("spec_file").alias("source_file"))
    ends: dict[str, list] = {}
    for flow, method, path in FLOW_ENDPOINTS:
        ends.setdefault(flow, []).append(F.struct(F.lit(method).alias("method"), F.lit(path).alias("path")))
    of_flow = F.create_map(*[x for flow, e in sorted(ends.items()) for x in (F.lit(flow), F.array(*e))])
    called = F.array_distinct(F.flatten(F.array_compact(F.transform("flows", lambda f: of_flow[f]))))
    calls = read.select("spec_file", called.alias("called"), ids).select("id", "spec_file", F.explode("called").alias("e"))
    calls = calls.select("id", "spec_file", "e.method", "e.path", F.col("spec_file").alias("source_file"))
    return {
        "spec_file": read.select("spec_name", "spec_file", "suite", "file_hash", "describes", "imports", F.col("spec_file").alias("source_file")),
        "test_case": tests,
        "tests_flow": flows,
        "calls_endpoint": calls,
    }


def list_tables(files: DataFrame) -> dict[str, DataFrame]:
    """feature_list (key, connectors) and in_list (connector, list_key) from the file with the lists; names as the connector table has them."""
    rows = parsed(files, js.connector_lists, "key string, ord int, connector string").withColumn("connector", connector_name(F.col("connector")))
    names = F.transform(F.array_sort(F.collect_list(F.when(F.col("connector").isNotNull(), F.struct("ord", "connector")))), lambda x: x["connector"])
    return {
        "feature_list": rows.groupBy("key").agg(names.alias("connectors")),
        "in_list": rows.where("connector IS NOT NULL").select("connector", F.col("key").alias("list_key")).distinct(),
    }


def tables(files: DataFrame) -> dict[str, DataFrame]:
    """All tables of the test catalogue from a repository's files (file, text). Connectors that only a list names are connectors too."""
    out = {**connector_tables(connector_files(files)), **spec_tables(spec_files(files)), **list_tables(list_files(files))}
    listed = out["in_list"].select("connector").distinct().join(out["connector"], "connector", "left_anti")
    out["connector"] = out["connector"].unionByName(listed, allowMissingColumns=True)
    return out


BY_FILE = ("flow_config", "supports_flow", "spec_file", "test_case", "tests_flow", "calls_endpoint")


def index(catalog: Catalog, files: DataFrame) -> DataFrame:
    """Fills the catalogue from files; kind, n: how many rows each table got."""
    for name, rows in tables(files).items():
        if name in BY_FILE:
            catalog.replace(name, rows, by="source_file")
        else:
            catalog.replace(name, rows)
    return counts(catalog)


def reindex(catalog: Catalog, files: DataFrame) -> DataFrame:
    """Brings the catalogue up to date with files (file, text) that are new or changed; all others' rows stay.

    kind, n as of index(). The lists are replaced if their file is among them.
    """
    fresh = {**connector_tables(connector_files(files)), **spec_tables(spec_files(files))}
    for name in BY_FILE:
        catalog.replace_files(name, fresh[name], "source_file", files.select(F.col("file").alias("source_file")))
    lists = list_files(files)
    if not lists.isEmpty():
        for name, rows in list_tables(lists).items():
            catalog.replace(name, rows)
    known = catalog.table("connector")
    kept = known.join(fresh["connector"].select("connector"), "connector", "left_anti")
    listed = catalog.table("in_list").select("connector").distinct().join(kept.select("connector").union(fresh["connector"].select("connector")), "connector", "left_anti")
    catalog.replace("connector", kept.unionByName(fresh["connector"]).unionByName(listed, allowMissingColumns=True))
    flows = catalog.table("flow_config").select("flow").distinct()
    known_flows = flow_endpoint(files.sparkSession).join(flows, "flow")
    catalog.replace("flow", flows)
    catalog.replace("maps_to", known_flows.select("flow", F.concat_ws(":", "method", "path").alias("endpoint_id")))
    catalog.replace("endpoint", known_flows.select(F.concat_ws(":", "method", "path").alias("id"), "method", "path").distinct())
    return counts(catalog)


def counts(catalog: Catalog) -> DataFrame:
    """kind, n: the rows of the catalogue's main tables."""
    out = None
    for name in ("connector", "flow_config", "spec_file", "test_case", "feature_list"):
        one = catalog.table(name).agg(F.lit(name).alias("kind"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out
