"""Queries of the run report and the viewer."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import report as R
from tidemark.plans.views import oracle, select, view
from tidemark.registry import register
from tidemark.storage import bucketed

_LCOV = "SELECT file, line, hits FROM v_cov_line WHERE tag = 'F' AND hits >= 0"
_SPANS = "SELECT concat(file, ':', start) AS id, file, start, start + 12 AS stop FROM (SELECT file, min(line) AS start FROM v_cov_line WHERE tag = 'F' GROUP BY file) t"
_JOINED = f"(SELECT s.id, s.file, s.line, l.hits FROM (SELECT id, file, unnest(range(start, stop + 1)) AS line FROM ({_SPANS})) s LEFT JOIN ({_LCOV}) l ON s.file = l.file AND s.line = l.line)"


@register(
    "leaf_gap",
    oracle(
        "SELECT id, file, n AS lines_in_span, probed, hit, n - probed AS no_da, round(hit / nullif(probed, 0)::DOUBLE, 4) AS ratio, zero_lines, CASE WHEN probed = 0 THEN 'no_lcov_da_in_span'"
        " WHEN hit = probed THEN 'all_probed_lines_hit' WHEN hit = 0 THEN 'all_probed_lines_zero' ELSE 'partial' END AS status FROM"
        " (SELECT id, file, count(*) AS n, count(hits) AS probed, count(*) FILTER (WHERE hits > 0) AS hit, coalesce(string_agg(line::VARCHAR, ',' ORDER BY line) FILTER (WHERE hits = 0), '') AS zero_lines"
        f" FROM {_JOINED} GROUP BY id, file)"
    ),
)
def leaf_gap(spark, sf):
    out = R.leaf_gap(select(spark, sf, _SPANS), select(spark, sf, _LCOV))
    return out.withColumn("zero_lines", F.array_join(F.col("zero_lines").cast("array<string>"), ","))


@register("line_hit_listing", oracle(f"SELECT id, file, line, coalesce(hits::VARCHAR, '(no DA)') AS shown FROM {_JOINED}"))
def line_hit_listing(spark, sf):
    return R.line_hits(select(spark, sf, _SPANS), select(spark, sf, _LCOV))


@register(
    "log_status_last",
    oracle(
        r"SELECT file_id, max_by(CAST(nullif(regexp_extract(txt, 'status_code\D*(\d{3})', 1), '') AS BIGINT), line_no) AS status, CASE WHEN bool_or(contains(txt, 'IR_04')) THEN 'IR_04' END AS error_code,"
        " CASE WHEN bool_or(contains(txt, 'Missing required param: Authorization')) THEN 'Missing required param: Authorization' END AS error_message,"
        " bool_or(contains(txt, 'IR_04') OR contains(txt, 'Missing required param: Authorization')) AS has_error, count(*) AS lines FROM v_event_log GROUP BY file_id"
    ),
)
def log_status_last(spark, sf):
    return R.last_status(view(spark, sf, "v_event_log"))


# what runs are made of, one per customer: a failing count, errors and failed tests by the customer's orders
_RUNS_OF = "SELECT c_custkey AS id, CAST(c_custkey % 4 AS BIGINT) AS failing, CAST(c_nationkey % 3 AS BIGINT) AS passing FROM customer"
_ERRORS_OF = (
    "SELECT o_custkey AS id, o_orderkey AS ord, CASE o_orderkey % 9 WHEN 0 THEN 'Unrecognized request URL (POST: /accounts)' WHEN 1 THEN 'API Key create call failed' WHEN 2 THEN 'Connector Create Call Failed with 400'"
    " WHEN 3 THEN 'no client_secret' WHEN 4 THEN 'Expecting valid response but got an error' ELSE concat('other ', o_orderkey % 50) END AS error FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 5 < 3"
)
_FAILED_OF = "SELECT o_custkey AS id, o_orderkey AS ord, CASE WHEN o_orderkey % 20 = 0 THEN 'Connector Account Create' ELSE concat('test ', o_orderkey % 30) END AS test FROM orders WHERE o_orderstatus = 'O' AND o_custkey % 5 <> 1"


def _frames(spark, sf):
    return [select(spark, sf, q) for q in (_RUNS_OF, _ERRORS_OF, _FAILED_OF)]


@register(
    "failure_rules",
    oracle(
        "SELECT id, CASE WHEN len(said) > 0 THEN array_to_string(said, ' ') WHEN errors IS NOT NULL THEN 'Cypress reported ' || failing || ' failing test(s). The first captured error was: ' || errors[1]"
        " WHEN tests IS NOT NULL THEN 'Cypress reported ' || failing || ' failing test(s), including: ' || array_to_string(tests, ', ') || '.'"
        " ELSE 'Cypress reported ' || failing || ' failing test(s), but no detailed failure text was captured.' END AS summary,"
        " array_to_string(CASE WHEN len(said) > 0 THEN said ELSE coalesce(errors, tests, []) END, '|') AS findings FROM ("
        " SELECT r.id, failing, errors[1:3] AS errors, tests[1:3] AS tests, list_filter(["
        "CASE WHEN len(list_filter(errors, lambda e: contains(lower(e), '/accounts') OR contains(lower(e), 'unrecognized request url'))) > 0 THEN 'Account setup is failing because the backend returns \"Unrecognized request URL\" for /accounts.' END,"
        "CASE WHEN len(list_filter(errors, lambda e: contains(lower(e), 'api key create call failed'))) > 0 THEN 'API key creation is failing after account setup, so test setup does not complete.' END,"
        "CASE WHEN len(list_filter(errors, lambda e: contains(lower(e), 'connector create call failed'))) > 0 OR len(list_filter(tests, lambda t: contains(lower(t), 'connector account create'))) > 0"
        " THEN 'Connector account creation is also failing, so the connector is not ready for the payment flow.' END,"
        "CASE WHEN len(list_filter(errors, lambda e: contains(lower(e), 'client_secret'))) > 0 THEN 'Payment steps later fail because the responses do not include the expected client secret.' END,"
        "CASE WHEN len(list_filter(errors, lambda e: contains(lower(e), 'expecting valid response'))) > 0 THEN 'Some Cypress checks are receiving error responses where a successful API response was expected.' END"
        f"], lambda x: x IS NOT NULL) AS said FROM ({_RUNS_OF}) r LEFT JOIN (SELECT id, list(error ORDER BY ord) AS errors FROM ({_ERRORS_OF}) GROUP BY id) USING (id)"
        f" LEFT JOIN (SELECT id, list(test ORDER BY ord) AS tests FROM ({_FAILED_OF}) GROUP BY id) USING (id))"
    ),
)
def failure_rules(spark, sf):
    out = R.failure_summary(*_frames(spark, sf))
    return out.select("id", "summary", F.array_join("findings", "|").alias("findings"))


@register(
    "test_errors",
    oracle(
        "SELECT id, coalesce(array_to_string(tests[1:5], '|'), '') AS failed_tests, coalesce(array_to_string(errors[1:3], '|'), '') AS errors, passing AS passing_count, failing AS failing_count"
        f" FROM ({_RUNS_OF}) LEFT JOIN (SELECT id, list(error ORDER BY ord) AS errors FROM ({_ERRORS_OF}) GROUP BY id) USING (id)"
        f" LEFT JOIN (SELECT id, list(test ORDER BY ord) AS tests FROM ({_FAILED_OF}) GROUP BY id) USING (id) WHERE NOT (failing = 0 AND passing > 0) AND (errors IS NOT NULL OR tests IS NOT NULL)"
    ),
)
def test_errors(spark, sf):
    out = R.test_errors(*_frames(spark, sf))
    return out.select("id", *[F.array_join(c, "|").alias(c) for c in ("failed_tests", "errors")], "passing_count", "failing_count")


_FACTS = "SELECT o_orderkey AS id, o_totalprice > 400000 AS log_error, o_orderstatus = 'F' AS test_error, CASE WHEN o_custkey % 3 = 0 THEN 'all_probed_lines_hit' ELSE 'partial' END AS gap_status FROM orders"


@register(
    "rca_decision",
    oracle(
        "SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN log_error THEN 'service_error' WHEN test_error THEN 'test_failure' WHEN gap_status = 'all_probed_lines_hit' THEN 'covered'"
        f" ELSE 'investigate' END AS verdict FROM ({_FACTS})) GROUP BY verdict"
    ),
)
def rca_decision(spark, sf):
    return R.root_cause(select(spark, sf, _FACTS)).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@register(
    "request_ids",
    oracle(
        "SELECT file_id, string_agg(rid, ',' ORDER BY rid) AS ids FROM (SELECT DISTINCT file_id, CASE line_no % 13 WHEN 8 THEN concat('b', line_no % 6) WHEN 9 THEN concat('j', line_no % 8) ELSE concat('h', line_no % 5) END AS rid"
        " FROM v_run_log WHERE line_no % 13 IN (9, 10) OR (line_no % 13 = 8 AND line_no % 2 = 1)) GROUP BY file_id"
    ),
)
def request_ids(spark, sf):
    return R.request_ids(view(spark, sf, "v_run_log")).select("file_id", F.array_join("ids", ",").alias("ids"))


_TOOK = "CASE o_orderkey % 5 WHEN 0 THEN concat(CAST(o_orderkey % 60 AS VARCHAR(20)), 's') WHEN 1 THEN concat('1m ', CAST(o_orderkey % 60 AS VARCHAR(20)), 's') WHEN 2 THEN concat(CAST(o_orderkey % 900 AS VARCHAR(20)), 'ms') WHEN 3 THEN concat(CAST(o_orderkey % 9 AS VARCHAR(20)), '.5s') ELSE 'soon' END"
_RUNS = (
    f"SELECT o_orderkey AS id, concat('  ', CAST(o_custkey % 20 AS VARCHAR(20)), ' passing (', {_TOOK}, ')  ', CASE WHEN o_orderstatus = 'F' THEN concat(CAST(o_custkey % 4 AS VARCHAR(20)), ' failing ') ELSE '' END,"
    " CASE WHEN o_orderstatus = 'P' THEN concat(CAST(o_custkey % 3 AS VARCHAR(20)), ' pending') ELSE '' END, ' ✓ pays once (12ms) ✔ asks ', CAST(o_custkey % 6 AS VARCHAR(20)), ' (1s)') AS txt FROM orders"
)
# the numbers that the texts were made of
_MADE = "o_custkey % 20 AS passing, CASE WHEN o_orderstatus = 'F' THEN o_custkey % 4 ELSE 0 END AS failing, CASE WHEN o_orderstatus = 'P' THEN o_custkey % 3 ELSE 0 END AS pending"


@register(
    "test_summary",
    oracle(
        "SELECT id, passing, failing, pending, duration_ms, passing + failing + pending AS total, failing = 0 AND passing > 0 AS passed FROM (SELECT o_orderkey AS id,"
        f" {_MADE}, CASE o_orderkey % 5 WHEN 0 THEN o_orderkey % 60 * 1000 WHEN 2 THEN o_orderkey % 900 ELSE 0 END AS duration_ms FROM orders)"
    ),
)
def test_summary(spark, sf):
    return R.test_summary(select(spark, sf, _RUNS))


_MS = "CASE o_orderkey % 5 WHEN 0 THEN o_orderkey % 60 * 1000 WHEN 1 THEN 60000 + o_orderkey % 60 * 1000 WHEN 2 THEN o_orderkey % 900 WHEN 3 THEN o_orderkey % 9 * 1000 + 500 ELSE 0 END"


@register(
    "run_summary",
    oracle(
        f"SELECT id, passing, failing, duration_ms, 'pays once|asks ' || asks AS passing_tests, passing + failing AS total FROM (SELECT o_orderkey AS id, {_MADE}, {_MS} AS duration_ms, o_custkey % 6 AS asks FROM orders)"
    ),
)
def run_summary(spark, sf):
    out = R.run_summary(select(spark, sf, _RUNS))
    return out.withColumn("passing_tests", F.array_join("passing_tests", "|"))


@register("duration_ms", oracle(f"SELECT {_TOOK} AS duration, {_MS} AS ms, count(*) AS n FROM orders GROUP BY ALL"))
def duration_ms(spark, sf):
    d = F.regexp_extract("txt", r"passing \(([^)]*)\)", 1)
    return select(spark, sf, _RUNS).groupBy(d.alias("duration"), R.duration_ms(d).alias("ms")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "failed_test_names",
    oracle(
        "SELECT l.file_id, line_no, 'pays by ' || event_type AS test FROM v_run_log l JOIN events ON event_id = line_no JOIN (SELECT file_id, min(line_no) AS first FROM v_run_log WHERE line_no % 13 = 0 GROUP BY file_id) f"
        " ON l.file_id = f.file_id AND line_no > first WHERE line_no % 13 = 1"
    ),
)
def failed_test_names(spark, sf):
    return R.failed_names(view(spark, sf, "v_run_log"))


# lines after the first failing count, in blocks from one numbered line to the next, as the plain rule has them
_BLOCK_LINES = (
    "SELECT *, sum(CASE WHEN line_no % 13 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY line_no) AS block, CASE WHEN line_no % 13 = 1 THEN trim(substr(txt, instr(txt, ')') + 1)) ELSE trim(txt) END AS said"
    " FROM v_run_log JOIN (SELECT file_id, min(line_no) AS first FROM v_run_log WHERE line_no % 13 = 0 GROUP BY file_id) USING (file_id) WHERE line_no > first"
)


@register(
    "failure_blocks",
    oracle(
        "SELECT file_id, block::BIGINT AS block, rtrim(test, ':') AS test, coalesce(array_to_string(said[1:3], ' | '), '') AS error FROM (SELECT h.file_id, h.block, any_value(h.said) AS test,"
        " list(l.said ORDER BY l.line_no) FILTER (WHERE l.line_no > h.line_no AND l.line_no < coalesce(t.stop, 1e18) AND l.line_no % 13 <> 6) AS said"
        " FROM (SELECT file_id, block, min(line_no) AS line_no, arg_min(said, line_no) AS said FROM lines WHERE block > 0 AND line_no % 13 = 5 GROUP BY file_id, block) h JOIN lines l ON h.file_id = l.file_id AND h.block = l.block"
        " LEFT JOIN (SELECT h2.file_id, h2.block, min(x.line_no) AS stop FROM (SELECT file_id, block, min(line_no) AS line_no FROM lines WHERE line_no % 13 = 5 GROUP BY file_id, block) h2 JOIN lines x"
        " ON x.file_id = h2.file_id AND x.block = h2.block AND x.line_no > h2.line_no AND x.line_no % 13 = 7 GROUP BY ALL) t ON t.file_id = h.file_id AND t.block = h.block GROUP BY h.file_id, h.block)",
        f"lines AS ({_BLOCK_LINES})",
    ),
)
def failure_blocks(spark, sf):
    return R.failure_blocks(view(spark, sf, "v_run_log"))


_LOG_TEXTS = "SELECT file_id AS id, string_agg(txt, chr(10) ORDER BY line_no) AS txt FROM v_run_log GROUP BY file_id"


def _log_texts(spark, sf):
    rows = view(spark, sf, "v_run_log").groupBy(F.col("file_id").alias("id"))
    lines = F.array_sort(F.collect_list(F.struct("line_no", "txt")))
    return rows.agg(F.array_join(F.transform(lines, lambda x: x["txt"]), "\n").alias("txt"))


@register(
    "error_messages",
    oracle(
        "SELECT id, array_to_string((a || list_filter(list_distinct_in_order, lambda x: NOT list_contains(a, x)) || c)[1:10], '|') AS errors FROM (SELECT id, regexp_extract_all(txt, 'AssertionError[:\\s]+([^\\n]+)', 1) AS a,"
        " list_distinct(list_transform(regexp_extract_all(txt, '(?i)error[:\\s]+([^\\n]+)', 1), lambda x: trim(x))) AS d,"
        " list_filter(d, lambda x: x <> '') AS e, list_transform(list_sort(list_transform(e, lambda x: {'at': list_position(list_transform(regexp_extract_all(txt, '(?i)error[:\\s]+([^\\n]+)', 1), lambda y: trim(y)), x), 'x': x})), lambda z: z.x) AS list_distinct_in_order,"
        f" list_transform(regexp_extract_all(txt, 'CypressError:[^\\n]*\\n([^\\n]+)', 1), lambda x: trim(x)) AS c FROM ({_LOG_TEXTS}))"
    ),
)
def error_messages(spark, sf):
    return R.error_messages(_log_texts(spark, sf)).select("id", F.array_join("errors", "|").alias("errors"))


_DOCUMENTS = (
    "SELECT o_orderkey AS id, CASE WHEN o_custkey % 3 > 0 THEN concat('fn', o_custkey) END AS changed_function, o_orderstatus, o_custkey FROM orders"
)


@register(
    "flow_info",
    oracle(
        "SELECT id, CASE WHEN o_custkey % 4 = 0 THEN 'UNKNOWN' ELSE 'POST' END AS method, CASE WHEN o_custkey % 4 = 0 THEN 'UNKNOWN' ELSE '/p/' || o_custkey END AS endpoint, CASE WHEN o_custkey % 4 = 0 THEN '' ELSE 'h' || o_custkey END AS handler,"
        " coalesce(changed_function, '') AS changed_function, CASE WHEN o_orderstatus = 'F' THEN 'leaf' || o_custkey END AS target_leaf, CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'what ' || o_custkey END AS description,"
        f" CASE WHEN o_orderstatus = 'P' THEN '?' ELSE (id % 9)::VARCHAR END AS flow_id FROM ({_DOCUMENTS})"
    ),
)
def flow_info(spark, sf):
    key, status = F.col("o_custkey"), F.col("o_orderstatus")
    end = F.struct(F.lit("POST").alias("method"), F.concat(F.lit("/p/"), key).alias("path"), F.concat(F.lit("h"), key).alias("handler"))
    step = lambda role, name: F.struct(F.lit(role).alias("role"), F.concat(F.lit(name), key).alias("function"))
    flow = F.struct(
        (F.col("id") % 9).alias("flow_id"), F.concat(F.lit("what "), key).alias("description"),
        F.when(status == "F", F.array(step("handler", "h"), step("target", "leaf"), step("target", "other"))).otherwise(F.array(step("handler", "h"))).alias("chain"),
    )
    docs = select(spark, sf, _DOCUMENTS).select(
        "id", "changed_function", F.when(key % 4 > 0, F.array(end, end)).otherwise(F.array().cast("array<struct<method:string,path:string,handler:string>>")).alias("endpoints"),
        F.when(status != "P", F.array(flow)).alias("flows"),
    )
    return R.flow_info(docs)


@register(
    "running_brace_depth",
    oracle("SELECT file_id, line_no, sum(depth_delta) OVER (PARTITION BY file_id ORDER BY line_no)::BIGINT AS depth FROM v_event_log"),
)
def running_brace_depth(spark, sf):
    return R.running_depth(view(spark, sf, "v_event_log").select("file_id", "line_no", "depth_delta")).select("file_id", "line_no", "depth")


_LINES = "SELECT DISTINCT file, line FROM v_cov_line"
_FIRST = "SELECT file, line, hits FROM v_cov_line WHERE tag = 'F' AND hits > 1"
_SECOND = "SELECT file, line, hits FROM v_cov_line WHERE tag = 'O' AND hits > 0"
# a body from a file's first line to the middle, whose lines without hits are listed
_BODIES = "SELECT file, min(line) AS start, CAST(floor((min(line) + max(line)) / 2) AS BIGINT) AS stop FROM v_cov_line WHERE tag = 'O' GROUP BY file"
_ZERO = "SELECT file, line FROM v_cov_line WHERE tag = 'O' AND hits = 0"


@register(
    "line_hits_priority",
    oracle(
        f"SELECT l.file, l.line, coalesce(a.hits, b.hits, CASE WHEN l.line BETWEEN g.start AND g.stop THEN CASE WHEN z.file IS NULL THEN 1 ELSE 0 END END) AS hits FROM ({_LINES}) l LEFT JOIN ({_FIRST}) a USING (file, line)"
        f" LEFT JOIN ({_SECOND}) b USING (file, line) LEFT JOIN ({_ZERO}) z USING (file, line) LEFT JOIN ({_BODIES}) g USING (file)"
    ),
)
def line_hits_priority(spark, sf):
    # the view once, by file: what is asked of it here then needs no more of its shuffles
    cov = bucketed(view(spark, sf, "v_cov_line"), "cov-lines", "file")
    first, second = cov.where("tag = 'F' AND hits > 1"), cov.where("tag = 'O' AND hits > 0")
    stop = F.floor((F.min("line") + F.max("line")) / 2).alias("stop")
    gaps = cov.where("tag = 'O'").groupBy("file").agg(F.min("line").alias("start"), stop, F.collect_list(F.when(F.col("hits") == 0, F.col("line"))).alias("zero"))
    return R.hits_by_priority(cov.select("file", "line").distinct(), first, second, gaps)


_FN_LINES = "SELECT split_part(file, '/', 2) AS fn, CASE WHEN hits >= 0 THEN hits END AS hits FROM v_cov_line WHERE tag = 'F'"
_ROLL = f"roll AS (SELECT fn, count(hits) AS measurable, count(*) FILTER (WHERE hits > 0) AS hit, count(*) FILTER (WHERE hits = 0) AS zero FROM ({_FN_LINES}) GROUP BY fn)"


@register("function_rollup", oracle("SELECT *, round(100.0::DOUBLE * hit / nullif(measurable, 0), 2) AS pct FROM roll", _ROLL))
def function_rollup(spark, sf):
    return R.function_rollup(select(spark, sf, _FN_LINES))


@register(
    "overall_rollup",
    oracle(
        "SELECT *, round(100.0::DOUBLE * hit / nullif(measured, 0), 2) AS pct FROM (SELECT sum(measurable)::BIGINT AS measured, sum(hit)::BIGINT AS hit, count(*) FILTER (WHERE measurable > 0 AND hit = measurable) AS \"full\","
        " count(*) FILTER (WHERE measurable > 0 AND hit = 0) AS uncovered, count(*) FILTER (WHERE measurable = 0) AS unmeasured FROM roll)",
        _ROLL,
    ),
)
def overall_rollup(spark, sf):
    return R.overall_rollup(R.function_rollup(select(spark, sf, _FN_LINES)))


_STEPS = "SELECT l_orderkey AS chain_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS pos, concat('P#', l_partkey) AS node, l_returnflag <> 'R' AS ok FROM lineitem"


@register(
    "flow_graph_edges",
    oracle(
        "SELECT chain_id, pos, source, target, CASE WHEN coalesce(broken, 0) = 1 THEN 'unreached' WHEN ok THEN 'ok' ELSE 'error' END AS status FROM (SELECT chain_id, pos, node AS target, ok,"
        " lag(node) OVER (PARTITION BY chain_id ORDER BY pos) AS source, max(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY chain_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS broken"
        f" FROM ({_STEPS})) WHERE source IS NOT NULL"
    ),
)
def flow_graph_edges(spark, sf):
    return R.chain_edges(select(spark, sf, _STEPS))


@register(
    "definition_line_score",
    oracle(
        "SELECT doc_id, line_no, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line_no) AS rn FROM (SELECT doc_id, line_no, txt, 200 - least(line_no - 1, 200)"
        " + max(CASE WHEN contains(txt, 'the') THEN 100 ELSE 0 END) OVER w + max(CASE WHEN contains(txt, 'and') THEN 100 ELSE 0 END) OVER w AS score FROM"
        " (SELECT doc_id, CAST(generate_subscripts(a, 1) AS BIGINT) AS line_no, unnest(a) AS txt FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents))"
        " WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 12 PRECEDING AND CURRENT ROW)) WHERE contains(txt, 'of')) WHERE rn = 1"
    ),
)
def definition_line_score(spark, sf):
    lines = select(spark, sf, "SELECT doc_id, CAST(pos + 1 AS BIGINT) AS line_no, col AS txt FROM (SELECT doc_id, split(text, '\\n') AS a FROM documents) LATERAL VIEW posexplode(a) pe AS pos, col")
    return R.definition_line(lines, "of", ["the", "and"])


@register(
    "log_correlation",
    oracle(
        "SELECT file_id, matches, array_to_string(s[1:8], ',') AS sample FROM (SELECT file_id, count(*) AS matches, list(line_no ORDER BY line_no) AS s FROM v_event_log WHERE contains(txt, '-7 ') GROUP BY file_id)"
    ),
)
def log_correlation(spark, sf):
    out = R.log_lines(view(spark, sf, "v_event_log"), "-7 ")
    return out.select("file_id", "matches", F.array_join(F.col("sample").cast("array<string>"), ",").alias("sample"))


@register(
    "http_status_map",
    oracle("SELECT 'POST /' || event_type AS request, arg_max(200 + event_id % 300, (user_id, event_id)) AS status FROM events WHERE event_id % 13 = 2 GROUP BY event_type"),
)
def http_status_map(spark, sf):
    return R.http_status_map(view(spark, sf, "v_run_log"))


@register(
    "events_tumbling",
    oracle("SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL"),
)
def events_tumbling(spark, sf):
    events = select(spark, sf, "SELECT ts, event_type, value FROM events")
    out = events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


@register(
    "events_session",
    oracle(
        "SELECT user_id, min(ts) AS session_start, count(*) AS n FROM (SELECT *, sum(CASE WHEN prev IS NULL OR ts - prev >= INTERVAL '30 minutes' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM"
        " (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)) GROUP BY user_id, s"
    ),
)
def events_session(spark, sf):
    events = select(spark, sf, "SELECT user_id, ts FROM events")
    out = events.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), "n")
