"""The driver tables in the shapes the analytics expect: function graph, coverage, test catalogue, logs.

Each view is one portable SELECT. The Spark side and the oracle inline the same text as common table
expressions, so a comparison can only differ in the operator under test.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import TABLES
from tidemark.storage import fit_shuffles

VIEWS: dict[str, str] = {
    "v_fn": """
SELECT concat('R#', r_regionkey) AS symbol, concat('route_', lower(replace(r_name, ' ', '_'))) AS name,
       'crates/router/src/routes/r.rs' AS file, CAST(10 + r_regionkey AS BIGINT) AS def_line,
       r_regionkey <> 2 AS is_endpoint, CASE WHEN r_regionkey % 2 = 0 THEN 'GET' ELSE 'POST' END AS http_method,
       concat('/', lower(replace(r_name, ' ', '-'))) AS http_path FROM region
UNION ALL SELECT concat('N#', n_nationkey), concat('nation_', n_nationkey),
       CASE WHEN n_nationkey % 7 = 3 THEN 'crates/openapi/src/n.rs' ELSE 'crates/router/src/core/n.rs' END,
       CAST(100 + n_nationkey AS BIGINT), false, CAST(NULL AS VARCHAR(10)), CAST(NULL AS VARCHAR(10)) FROM nation
UNION ALL SELECT concat('S#', s_suppkey), concat('supplier_', s_suppkey), concat('crates/router/src/core/s', s_suppkey % 5, '.rs'),
       CAST(s_suppkey AS BIGINT), false, CAST(NULL AS VARCHAR(10)), CAST(NULL AS VARCHAR(10)) FROM supplier
UNION ALL SELECT concat('P#', p_partkey), concat('part_', p_partkey),
       CASE WHEN p_size % 10 = 0 THEN 'crates/router/tests/p.rs' ELSE concat('crates/conn/src/', lower(replace(p_brand, '#', '')), '.rs') END,
       CAST(p_partkey AS BIGINT), false, CAST(NULL AS VARCHAR(10)), CAST(NULL AS VARCHAR(10)) FROM part""",
    "v_call_site": """
SELECT concat('R#', n_regionkey) AS caller, concat('N#', n_nationkey) AS callee, CAST(n_nationkey AS BIGINT) AS line, CASE WHEN n_nationkey % 4 = 0 THEN 'match' END AS guard_type, CASE WHEN n_nationkey % 4 = 0 THEN 'flagO' END AS guard_condition FROM nation
UNION ALL SELECT concat('N#', s_nationkey), concat('S#', s_suppkey), CAST(s_suppkey AS BIGINT), CASE WHEN s_acctbal < 0 THEN 'if' END, CASE WHEN s_acctbal < 0 THEN concat('acct', s_nationkey) END FROM supplier
UNION ALL SELECT concat('S#', l_suppkey), concat('P#', l_partkey), l_orderkey * 10 + l_linenumber, CASE l_returnflag WHEN 'R' THEN 'match' WHEN 'A' THEN 'if' END,
       CASE l_returnflag WHEN 'R' THEN concat('flag', l_linestatus) WHEN 'A' THEN concat('!acct', s_nationkey) END
       FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
UNION ALL SELECT concat('P#', p_partkey), concat('P#', (p_partkey * 7 + 3) % (SELECT count(*) FROM part)), CAST(p_partkey AS BIGINT), 'for', concat('x in p', p_size) FROM part""",
    "v_calls": """
SELECT caller, callee, line, guard_type, guard_condition FROM (
  SELECT *, row_number() OVER (PARTITION BY caller, callee ORDER BY line, coalesce(guard_type, ''), coalesce(guard_condition, '')) AS rn FROM v_call_site) t WHERE rn = 1""",
    "v_cov_line": """
SELECT l_linestatus AS tag, concat('crates/n', s_nationkey, '/s', l_suppkey, '.rs') AS file, l_partkey AS line,
       max(CASE WHEN l_suppkey % 9 = 0 THEN least(CAST(l_quantity AS BIGINT) % 4 - 1, 0) ELSE CAST(l_quantity AS BIGINT) % 4 - 1 END) AS hits
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_linestatus, s_nationkey, l_suppkey, l_partkey""",
    "v_cov_file": """
SELECT tag, file, count(*) FILTER (WHERE hits >= 0) AS line_total, count(*) FILTER (WHERE hits > 0) AS line_covered, count(*) FILTER (WHERE hits = 0) AS line_missed,
       count(*) FILTER (WHERE hits > 1) AS region_covered, count(*) AS region_total FROM v_cov_line GROUP BY tag, file""",
    "v_cov_func": """
SELECT l_linestatus AS tag, concat('crates/n', s_nationkey, '/s', l_suppkey, '.rs') AS file, concat('m::', p_brand, '::', p_name) AS func_name, p_partkey AS start_line,
       CAST(sum(CASE WHEN l_tax = 0.0 THEN 1 ELSE 0 END) AS BIGINT) AS cnt
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY l_linestatus, s_nationkey, l_suppkey, p_brand, p_name, p_partkey""",
    "v_flow_config": """
SELECT s_name AS connector, concat(p_brand, '.', p_size) AS flow, min(concat(CASE WHEN l_returnflag = 'R' THEN '{ ' ELSE '' END, p_name, ': ', p_type, CASE WHEN l_tax = 0.0 THEN ' // todo' ELSE '' END)) AS raw_block
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_name, concat(p_brand, '.', p_size)""",
    "v_in_list": """
SELECT s_name AS connector, CASE WHEN s_nationkey % 5 = 0 THEN 'EXCLUDE.A' ELSE concat('INCLUDE.L', s_nationkey % 3) END AS list_key FROM supplier
UNION ALL SELECT s_name, concat('INCLUDE.L', s_suppkey % 3) FROM supplier WHERE s_acctbal > 5000""",
    "v_flow_list": """
SELECT concat(p_brand, '.', p_size) AS flow, CASE WHEN min(p_retailprice) < 920 THEN concat('INCLUDE.L', p_size % 4) END AS include_key, CASE WHEN max(p_retailprice) > 1000 THEN 'EXCLUDE.A' END AS exclude_key
FROM part GROUP BY p_brand, p_size""",
    "v_test_case": """
SELECT concat('spec_', o_custkey, '::t', o_orderkey % 7) AS id, concat(CAST(10000 + o_custkey AS VARCHAR(10)), '-Spec.cy.js') AS spec_file, concat('t', o_orderkey % 7) AS test_name,
       o_orderkey AS line, o_orderstatus = 'F' AS skipped, o_orderkey FROM orders""",
    "v_tests_flow": """
SELECT DISTINCT o_orderkey, concat(p_brand, '.', p_size) AS flow FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE o_totalprice > 100 * p_retailprice""",
    "v_calls_endpoint": """
SELECT o_orderkey, CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN '/payments' WHEN '2' THEN '/payments/:id/capture' WHEN '3' THEN '/refunds/:id' WHEN '4' THEN '/customers' ELSE '/payments/:id' END AS path FROM orders""",
    "v_run_log": """
SELECT CAST(user_id AS BIGINT) AS file_id, event_id AS line_no,
       CASE event_id % 13 WHEN 0 THEN concat('  ', event_id % 7, ' failing') WHEN 1 THEN concat('  ', event_id % 5 + 1, ') pays by ', event_type) WHEN 2 THEN concat('POST /', event_type, ' answered ', 200 + event_id % 300)
       WHEN 3 THEN concat('AssertionError: expected ', event_id % 4) WHEN 4 THEN 'Error: API key create call failed' WHEN 5 THEN concat('     is refused ', event_id % 3, ':') WHEN 6 THEN '      + expected - actual'
       WHEN 7 THEN concat('      at step', event_id % 9, ' (spec.js:', event_id % 90, ')') WHEN 8 THEN concat('"request_id": "', CASE WHEN event_id % 2 = 0 THEN 'null' ELSE concat('b', event_id % 6) END, '"')
       WHEN 9 THEN concat('"x-request-id": "j', event_id % 8, '"') WHEN 10 THEN concat('X-Request-Id = h', event_id % 5) WHEN 11 THEN 'CypressError: the client_secret is missing'
       ELSE concat('  ✓ ', event_type, ' works (', event_id % 70, 'ms)') END AS txt FROM events""",
    "v_event_log": """
SELECT CAST(user_id AS BIGINT) AS file_id, event_id AS line_no,
       concat(event_type, ' x-request-id: u', user_id, '-', event_id % 50, ' status_code: ', CASE event_type WHEN 'error' THEN '500' WHEN 'view' THEN '404' ELSE '200' END, CASE WHEN event_id % 97 = 0 THEN ' IR_04' ELSE '' END) AS txt,
       CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END AS depth_delta FROM events""",
}


def needed(sql: str) -> list[str]:
    """Views that sql refers to, those they refer to first."""
    out: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in out and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name])
                if name not in out:
                    out.append(name)

    visit(sql)
    return out


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a frame; unused columns and rows are pruned down to the scans."""
    return select(spark, sf_dir, f"SELECT * FROM {name}")


def select(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """sql over the views and tables in sf_dir."""
    names = needed(sql)
    text = " ".join([sql, *(VIEWS[n] for n in names)])
    root = sf_dir.rstrip("/")
    used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]
    fit_shuffles(spark, [f"{root}/{t}.parquet" for t in used])
    tables = [f"{t} AS (SELECT * FROM parquet.`{root}/{t}.parquet`)" for t in used]
    parts = tables + [f"{n} AS ({VIEWS[n]})" for n in names]
    return spark.sql(("WITH " + ", ".join(parts) + " " if parts else "") + sql)


def oracle(body: str, *ctes: str) -> str:
    """DuckDB SQL: the views that body and ctes use, then ctes, then body."""
    text = " ".join([body, *ctes])
    parts = [f"{n} AS ({VIEWS[n]})" for n in needed(text)] + list(ctes)
    return ("WITH RECURSIVE " + ", ".join(parts) + " " if parts else "") + body