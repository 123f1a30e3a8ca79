"""Queries in SQL alone over the parsers' table functions, held against the same rows as their frame forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans import sources as P
from tidemark.registry import oracle_of, register
from tidemark.sources import test_catalog
from tidemark.sources.table_functions import install


def _sql(text: str, files: DataFrame) -> DataFrame:
    spark = files.sparkSession
    install(spark)
    return spark.sql(text, files=files)


@register("sql_routes", oracle_of("rust_routes"))
def sql_routes(spark, sf):
    return _sql("SELECT f.file, r.method, r.path, r.handler, r.ord FROM {files} f, LATERAL routes(f.text) r", P.route_texts(spark, sf))


@register("sql_rust_items", oracle_of("rust_impls"))
def sql_rust_items(spark, sf):
    return _sql(
        "SELECT f.file, i.trait, i.detail AS trait_args, i.of AS type, i.name AS method, i.line FROM {files} f, LATERAL rust_items(f.text) i WHERE i.kind = 'method'",
        P.impl_texts(spark, sf),
    )


@register("sql_js_blocks", oracle_of("js_flow_configs"))
def sql_js_blocks(spark, sf):
    return _sql(
        "SELECT regexp_extract(f.file, '([^/]+)[.]js$', 1) AS connector, b.flow, b.response_status, b.request_fields['amount'] AS amount, b.request_fields['currency'] AS currency, b.has_amount_to_capture"
        " FROM {files} f, LATERAL js_blocks(f.text) b",
        test_catalog.connector_files(P._configs(spark, sf)),
    )


@register("sql_spec_tests", oracle_of("js_tests"))
def sql_spec_tests(spark, sf):
    return _sql(
        "SELECT concat(regexp_replace(regexp_extract(f.file, '([^/]+)$', 1), '([.]cy)?[.]js$', ''), '::', t.test_name) AS id, t.line, t.skipped, f.suite FROM {files} f, LATERAL spec_tests(f.text) t",
        test_catalog.spec_files(P._specs(spark, sf)),
    )


@register("sql_lcov_lines", oracle_of("lcov_records"))
def sql_lcov_lines(spark, sf):
    return _sql(
        # sums come before what is moved by source, and the rows are made once
        "WITH sums AS (SELECT f.file AS trace, t.source, t.rec, t.line, sum(t.hits) AS hits FROM {files} f, LATERAL lcov_lines(f.text) t GROUP BY ALL),"
        " marked AS (SELECT *, max(struct(trace, rec)) OVER (PARTITION BY source) AS last FROM sums)"
        " SELECT regexp_replace(source, '^/src/', '') AS file, CAST(line AS BIGINT) AS line, hits FROM marked WHERE struct(trace, rec) = last AND line IS NOT NULL",
        P.traces(spark, sf, F.lit(1)),
    )


@register("sql_log_segments", oracle_of("run_segments"))
def sql_log_segments(spark, sf):
    lists = ", ".join(f"array_join(s.{c}, '|') AS {c}" for c in ("request_ids", "steps", "messages", "statuses"))
    return _sql(f"SELECT f.file, s.spec, s.tests, s.passing, s.failing, s.duration, s.status, {lists} FROM {{files}} f, LATERAL log_segments(f.text) s", P.run_texts(spark, sf))
