"""Queries over the call graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import assembly as A
from tidemark.operators import graph as G
from tidemark.plans.views import oracle, select, view
from tidemark.registry import register

_REACH = (
    "reach(symbol) AS (SELECT symbol FROM v_fn WHERE is_endpoint UNION SELECT c.callee FROM v_calls c JOIN reach r ON c.caller = r.symbol)"
)


@register(
    "dead_end_functions",
    oracle(
        "SELECT symbol, name, file, def_line FROM v_fn WHERE NOT is_endpoint AND NOT contains(file, 'test') AND NOT contains(file, 'openapi')"
        " AND symbol NOT IN (SELECT symbol FROM reach)",
        _REACH,
    ),
)
def dead_end_functions(spark, sf):
    out = G.dead_ends(view(spark, sf, "v_fn"), view(spark, sf, "v_calls"))
    return out.select("symbol", "name", "file", "def_line").orderBy("file", "def_line", "symbol")


@register("reachable_count", oracle("SELECT count(*) AS reachable_count FROM reach", _REACH))
def reachable_count(spark, sf):
    fn = view(spark, sf, "v_fn")
    found = G.reachable(view(spark, sf, "v_calls"), fn.where("is_endpoint").select("symbol"))
    return found.agg(F.count(F.lit(1)).alias("reachable_count"))


@register(
    "callers_at_depth",
    oracle(
        "SELECT depth, count(*) AS n FROM (SELECT symbol, min(depth) AS depth FROM up GROUP BY symbol) GROUP BY depth",
        "seed AS (SELECT symbol FROM v_fn WHERE contains(file, 'tests'))",
        "up(symbol, depth) AS (SELECT symbol, 0 FROM seed UNION SELECT c.caller, u.depth + 1 FROM v_calls c JOIN up u ON c.callee = u.symbol WHERE u.depth < 12)",
    ),
)
def callers_at_depth(spark, sf):
    seeds = view(spark, sf, "v_fn").where("contains(file, 'tests')")
    up = view(spark, sf, "v_calls").select(F.col("callee").alias("caller"), F.col("caller").alias("callee"))
    return G.reachable(up, seeds.select("symbol"), 12).groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


_TARGETS = "SELECT DISTINCT callee AS symbol FROM v_calls WHERE caller LIKE 'S#%' AND guard_type IS NOT NULL"
_GUARD = "CASE WHEN c.guard_type IS NULL THEN '' ELSE c.guard_type || '|' || coalesce(c.guard_condition, '') END"
_UP = (
    f"targets AS ({_TARGETS})",
    "up(target, cur, chain, guards, depth) AS (SELECT symbol, symbol, [symbol], CAST([] AS VARCHAR[]), 0 FROM targets UNION ALL"
    f" SELECT u.target, c.caller, list_prepend(c.caller, u.chain), CASE WHEN c.guard_type IS NULL THEN u.guards ELSE list_append(u.guards, {_GUARD}) END, u.depth + 1"
    " FROM up u JOIN v_calls c ON c.callee = u.cur WHERE u.depth < 12 AND NOT list_contains(u.chain, c.caller)"
    " AND (u.depth = 0 OR u.cur NOT IN (SELECT symbol FROM v_fn WHERE is_endpoint)))",
    "hits AS (SELECT cur AS endpoint, target, chain, guards, depth FROM up WHERE depth > 0 AND cur IN (SELECT symbol FROM v_fn WHERE is_endpoint))",
    "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY endpoint, target ORDER BY depth, array_to_string(chain, '>')) AS rn FROM hits) WHERE rn = 1)",
)


#: Calls from a target up to an endpoint, at most.
CHAIN_DEPTH = 12


def _ends(spark, sf):
    ends = view(spark, sf, "v_fn").where("is_endpoint").select("symbol")
    return view(spark, sf, "v_calls"), select(spark, sf, _TARGETS), ends, CHAIN_DEPTH


def _chains(spark, sf):
    return G.chains_up(*_ends(spark, sf))


def _shortest(spark, sf):
    return G.shortest_chains_up(*_ends(spark, sf))


def _guard_texts():
    return F.array_join(F.transform("guards", lambda g: F.concat_ws("|", g["guard_type"], g["condition"])), ";")


@register(
    "endpoint_chains",
    oracle("SELECT endpoint, target, array_to_string(chain, '>') AS chain, array_to_string(guards, ';') AS guards, depth FROM best", *_UP),
)
def endpoint_chains(spark, sf):
    return _shortest(spark, sf).select("endpoint", "target", F.array_join("chain", ">").alias("chain"), _guard_texts().alias("guards"), "depth")


@register("endpoint_dedup", oracle("SELECT endpoint, count(*) AS targets, max(depth) AS deepest FROM best GROUP BY endpoint", *_UP))
def endpoint_dedup(spark, sf):
    return _shortest(spark, sf).groupBy("endpoint").agg(F.count(F.lit(1)).alias("targets"), F.max("depth").alias("deepest"))


@register(
    "path_feasibility",
    oracle(
        "SELECT likely_infeasible, count(*) AS n FROM (SELECT len(ms) <> len(list_distinct(ms)) OR len(list_filter(ifs, lambda c: list_contains(ifs, '!' || c)"
        " OR list_contains(ifs, '! ' || c) OR list_contains(ifs, '!(' || c || ')'))) > 0 AS likely_infeasible FROM"
        " (SELECT list_filter(guards, lambda g: starts_with(g, 'match|') AND g <> 'match|') AS ms,"
        " list_transform(list_filter(guards, lambda g: starts_with(g, 'if|')), lambda g: substr(g, 4)) AS ifs FROM hits)) GROUP BY likely_infeasible",
        *_UP,
    ),
)
def path_feasibility(spark, sf):
    return G.feasibility(*_ends(spark, sf))


_FLOWS = "flows AS (SELECT array_to_string(chain[2:], '>') AS tail, array_to_string(guards, ';') AS guards, list_sort(list_distinct(list(endpoint))) AS endpoints FROM best GROUP BY ALL)"


@register(
    "flows_grouped",
    oracle("SELECT tail, guards, array_to_string(endpoints, ',') AS endpoints, len(endpoints) AS endpoint_count FROM flows", *_UP, _FLOWS),
)
def flows_grouped(spark, sf):
    out = G.flows(_shortest(spark, sf))
    return out.select("tail", "guards", F.array_join("endpoints", ",").alias("endpoints"), F.size("endpoints").cast("long").alias("endpoint_count"))


@register(
    "reachability_matrix",
    oracle(
        "SELECT endpoint, target, chain, CASE WHEN guards = '' THEN 'Impacted' ELSE 'Conditionally Impacted' END AS impact_status FROM ("
        "SELECT endpoint, target, array_to_string(chain, '>') AS chain, array_to_string(guards, ';') AS guards,"
        " row_number() OVER (PARTITION BY endpoint ORDER BY depth, array_to_string(chain, '>')) AS rn FROM best) WHERE rn = 1",
        *_UP,
    ),
)
def reachability_matrix(spark, sf):
    rows = _shortest(spark, sf).select("endpoint", "target", F.array_join("chain", ">").alias("chain"), _guard_texts().alias("guards"), "depth")
    first = rows.groupBy("endpoint").agg(F.min_by(F.struct("target", "chain", "guards"), F.struct("depth", "chain")).alias("f"))
    status = F.when(F.col("f.guards") == "", "Impacted").otherwise("Conditionally Impacted")
    return first.select("endpoint", "f.target", "f.chain", status.alias("impact_status"))


@register(
    "chain_roles",
    oracle(
        "SELECT role, count(*) AS n, count(DISTINCT symbol) AS symbols FROM (SELECT symbol, CASE WHEN pos = n THEN 'target' WHEN pos = n - 1 THEN 'direct_caller'"
        " WHEN pos = 1 THEN 'handler' ELSE 'intermediate' END AS role FROM (SELECT unnest(chain) AS symbol, generate_subscripts(chain, 1) AS pos, len(chain) AS n FROM best)) GROUP BY role",
        *_UP,
    ),
)
def chain_roles(spark, sf):
    return G.chain_roles(_shortest(spark, sf)).groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("symbol").alias("symbols"))


@register(
    "symbol_resolution",
    oracle(
        "SELECT symbol, name, rk AS rank FROM (SELECT *, min(rk) OVER () AS least FROM (SELECT symbol, name, CASE WHEN name = 'part_7' THEN 1"
        " WHEN ends_with(name, '#part_7') AND len(string_split(name, '#')) = 2 THEN 1 WHEN ends_with(name, '#part_7') THEN 2 END AS rk FROM fns) WHERE rk IS NOT NULL) WHERE rk = least",
        "fns AS (SELECT symbol, name FROM v_fn UNION ALL SELECT symbol || 'i', 'S' || def_line % 3 || '#Impl#' || name FROM v_fn UNION ALL SELECT symbol || 'a', 'Tr#' || name FROM v_fn WHERE NOT contains(file, 'core'))",
    ),
)
def symbol_resolution(spark, sf):
    fns = select(
        spark, sf,
        "SELECT symbol, name FROM v_fn UNION ALL SELECT symbol || 'i', 'S' || def_line % 3 || '#Impl#' || name FROM v_fn UNION ALL SELECT symbol || 'a', 'Tr#' || name FROM v_fn WHERE NOT contains(file, 'core')",
    )
    return G.resolve_symbol(fns, "part_7").select("symbol", "name", "rank")


_PLACES = "SELECT DISTINCT file, def_line + 3 AS line FROM v_fn"


@register(
    "seed_from_location",
    oracle(
        f"SELECT file, line, symbol FROM (SELECT p.file, p.line, f.symbol, row_number() OVER (PARTITION BY p.file, p.line ORDER BY f.def_line DESC, f.symbol DESC) AS rn"
        f" FROM ({_PLACES}) p JOIN v_fn f ON p.file = f.file AND f.def_line <= p.line) WHERE rn = 1"
    ),
)
def seed_from_location(spark, sf):
    # an as-of lookup: a sort within the file, not a range join
    found = G.enclosing(view(spark, sf, "v_fn"), select(spark, sf, _PLACES))
    return found.where("def_symbol IS NOT NULL").select("file", "line", F.col("def_symbol").alias("symbol"))


_REFS = (
    "SELECT concat('crates/conn/src/', lower(replace(p_brand, '#', '')), '.rs') AS file, l_orderkey % (SELECT count(*) FROM part) AS line, l_orderkey * 10 + l_linenumber AS ref_id"
    " FROM lineitem JOIN part ON l_partkey = p_partkey"
)


@register(
    "enclosing_function",
    oracle(
        f"SELECT symbol AS def_symbol, count(*) AS refs, sum(ref_id)::BIGINT AS ref_sum FROM ({_REFS}) r ASOF LEFT JOIN"
        " (SELECT file, def_line, max(symbol) AS symbol FROM v_fn GROUP BY ALL) d ON r.file = d.file AND r.line >= d.def_line GROUP BY symbol"
    ),
)
def enclosing_function(spark, sf):
    found = G.enclosing(view(spark, sf, "v_fn"), select(spark, sf, _REFS))
    return found.groupBy("def_symbol").agg(F.count(F.lit(1)).alias("refs"), F.sum("ref_id").alias("ref_sum"))


@register("call_edge_dedup", oracle("SELECT * FROM v_calls"))
def call_edge_dedup(spark, sf):
    return G.dedup_calls(view(spark, sf, "v_call_site"))


@register(
    "project_edges_only",
    oracle("SELECT caller, callee, line FROM v_call_site WHERE caller IN (SELECT symbol FROM v_fn WHERE NOT contains(file, 'test')) AND callee IN (SELECT symbol FROM v_fn WHERE NOT contains(file, 'test'))"),
)
def project_edges_only(spark, sf):
    known = view(spark, sf, "v_fn").where("NOT contains(file, 'test')")
    return G.project_calls(view(spark, sf, "v_call_site"), known).select("caller", "callee", "line")


_TRIPLES = "SELECT DISTINCT concat('crates/n', s_nationkey, '/s', l_suppkey, '.rs') AS file, l_partkey AS line FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag <> 'N'"


@register("missing_impl_nodes", oracle(f"SELECT file, line FROM ({_TRIPLES}) t WHERE (file, line) NOT IN (SELECT (file, line) FROM v_cov_line WHERE hits >= 0)"))
def missing_impl_nodes(spark, sf):
    return G.missing_nodes(select(spark, sf, _TRIPLES), view(spark, sf, "v_cov_line").where("hits >= 0"))


_CONCRETE = "SELECT s_suppkey AS id, concat('trait_', s_nationkey % 5) AS name, concat('crates/n', s_nationkey, '/s', s_suppkey, '.rs') AS file FROM supplier"
_ABSTRACT = "SELECT n_nationkey AS cand, concat('trait_', n_nationkey % 5) AS name, concat('crates/n', n_nationkey, '/trait.rs') AS cand_file, n_nationkey AS ord FROM nation"


@register(
    "best_abstract_candidate",
    oracle(
        "SELECT id, cand, score FROM (SELECT id, cand, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, cand) AS rn FROM ("
        "SELECT id, cand, len(list_filter(range(1, least(length(file), length(cand_file)) + 1), lambda i: left(file, i) = left(cand_file, i))) AS score"
        f" FROM ({_CONCRETE}) a JOIN ({_ABSTRACT}) b USING (name))) WHERE rn = 1"
    ),
)
def best_abstract_candidate(spark, sf):
    return G.best_abstract(select(spark, sf, _CONCRETE), select(spark, sf, _ABSTRACT)).select("id", "cand", F.col("score").cast("long").alias("score"))


_FN_NAMED = "SELECT concat('P#', p_partkey) AS symbol, concat(p_name, '_', p_size * 7 % 13, '_', p_partkey % 97) AS name FROM part"
_BODIES = "SELECT concat('S#', l_suppkey) AS caller, concat(p_name, '_', p_size * 7 % 13, '_', p_partkey % 97) AS callee_name FROM lineitem JOIN part ON l_partkey = p_partkey"


@register(
    "unique_name_edges",
    oracle(
        f"SELECT DISTINCT caller, symbol AS callee FROM ({_BODIES}) b JOIN (SELECT name, min(symbol) AS symbol FROM ({_FN_NAMED}) GROUP BY name HAVING count(*) = 1) f"
        " ON b.callee_name = f.name WHERE NOT contains(name, '#') AND (caller, symbol) NOT IN (SELECT (caller, callee) FROM v_calls)"
    ),
)
def unique_name_edges(spark, sf):
    return G.synthetic_edges(select(spark, sf, _BODIES), select(spark, sf, _FN_NAMED), view(spark, sf, "v_calls"))


_EDGES = "SELECT l_suppkey AS file, l_partkey AS line, concat(p_name, '::', p_type) AS callee FROM lineitem JOIN part ON l_partkey = p_partkey"
_NOTES = "SELECT l_suppkey AS file, l_partkey AS line, p_type AS callee, p_brand AS type_param, l_orderkey AS ord FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 25"


@register(
    "type_param_annotation",
    oracle(
        "SELECT e.file, e.line, e.callee, n.type_param, count(*) AS sites FROM"
        f" ({_EDGES}) e LEFT JOIN (SELECT file, line, callee, arg_max(type_param, ord) AS type_param FROM ({_NOTES}) GROUP BY ALL) n"
        " ON e.file = n.file AND e.line = n.line AND ends_with(e.callee, n.callee) GROUP BY ALL"
    ),
)
def type_param_annotation(spark, sf):
    out = G.annotate_types(select(spark, sf, _EDGES), select(spark, sf, _NOTES))
    return out.groupBy("file", "line", "callee", "type_param").agg(F.count(F.lit(1)).alias("sites"))


_SPANS = "SELECT o_custkey % 50 AS file, o_orderkey % 1000 AS lo, o_orderkey % 1000 + CAST(floor(o_totalprice) AS BIGINT) % 40 AS hi, o_orderkey AS depth, o_orderstatus AS kind FROM orders"
_POINTS = "SELECT DISTINCT l_suppkey % 50 AS file, l_orderkey % 1000 AS line, l_suppkey % 50 * 100000 + l_orderkey % 1000 AS id FROM lineitem"


@register(
    "guard_containment",
    oracle(
        "SELECT kind, count(*) AS n, sum(depth)::BIGINT AS depth_sum FROM (SELECT p.id, arg_max(s.kind, s.depth) AS kind, max(s.depth) AS depth"
        f" FROM ({_POINTS}) p LEFT JOIN ({_SPANS}) s ON p.file = s.file AND p.line BETWEEN s.lo AND s.hi GROUP BY p.id) GROUP BY kind"
    ),
)
def guard_containment(spark, sf):
    out = G.innermost_guard(select(spark, sf, _POINTS), select(spark, sf, _SPANS))
    return out.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("depth").alias("depth_sum"))


@register(
    "guard_distribution",
    oracle("SELECT coalesce(guard_type, 'unconditional') AS guard_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2)::DOUBLE AS pct FROM v_calls GROUP BY ALL"),
)
def guard_distribution(spark, sf):
    return G.guard_distribution(view(spark, sf, "v_calls"))


_ROUTES = "SELECT concat('supplier_', s_suppkey) AS handler, CASE WHEN s_nationkey % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, concat('/n', s_nationkey) AS path, s_suppkey AS ord FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT concat('supplier_', s_suppkey), 'PUT', concat('/x', s_suppkey), s_suppkey + 1000000 FROM supplier WHERE s_acctbal > 5000"


@register(
    "endpoint_tagging",
    oracle(
        "SELECT symbol, name, r.handler IS NOT NULL AS is_endpoint, r.method AS http_method, r.path AS http_path FROM v_fn LEFT JOIN"
        f" (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY handler ORDER BY ord) AS rn FROM ({_ROUTES})) WHERE rn = 1) r ON name = handler"
    ),
)
def endpoint_tagging(spark, sf):
    return G.tag_endpoints(view(spark, sf, "v_fn"), select(spark, sf, _ROUTES))


# connectors' request builders, helpers in their own or another's file, headers and authorisation; some connectors lack one or the other
_REPAIR_FN = (
    "SELECT concat('A', s_suppkey) AS symbol, concat('Acme', s_nationkey, '#ConnectorIntegration<Flow', s_suppkey % 3, '>#build_request') AS name, concat('crates/acme', s_nationkey, '.rs') AS file FROM supplier"
    " UNION ALL SELECT concat('B', n_nationkey), CASE WHEN n_nationkey % 5 = 4 THEN 'other_helper' WHEN n_nationkey % 2 = 0 THEN 'get_headers' ELSE 'get_content_type' END, concat('crates/acme', n_nationkey, '.rs') FROM nation"
    " UNION ALL SELECT concat('C', n_nationkey), concat('Acme', n_nationkey, '#ConnectorIntegration#get_headers'), 'crates/x.rs' FROM nation WHERE n_regionkey <> 3"
    " UNION ALL SELECT concat('D', n_nationkey), concat('Acme', n_nationkey, '#ConnectorCommon#get_auth_header'), 'crates/x.rs' FROM nation WHERE n_regionkey <> 1"
)
_REPAIR_CALLS = "SELECT concat('A', s_suppkey) AS caller, concat('B', (s_nationkey + s_suppkey % 3) % 25) AS callee FROM supplier UNION ALL SELECT concat('C', n_nationkey), concat('D', n_nationkey) FROM nation WHERE n_regionkey = 4"


@register(
    "edge_repair",
    oracle(
        "SELECT DISTINCT caller, callee FROM ("
        " SELECT a.symbol AS caller, h.symbol AS callee FROM c JOIN f a ON c.caller = a.symbol JOIN f b ON c.callee = b.symbol JOIN f h ON h.name = split_part(a.name, '#', 1) || '#ConnectorIntegration#get_headers'"
        " WHERE regexp_matches(a.name, '#ConnectorIntegration<.*>#build_request$') AND b.name IN ('get_headers', 'get_content_type') AND NOT contains(b.file, lower(split_part(a.name, '#', 1)))"
        " UNION ALL SELECT h.symbol, d.symbol FROM f h JOIN f d ON d.name = split_part(h.name, '#', 1) || '#ConnectorCommon#get_auth_header' WHERE regexp_matches(h.name, '#ConnectorIntegration#get_headers$'))"
        " WHERE (caller, callee) NOT IN (SELECT (caller, callee) FROM c)",
        f"f AS ({_REPAIR_FN})", f"c AS ({_REPAIR_CALLS})",
    ),
)
def edge_repair(spark, sf):
    return A.repair_edges(select(spark, sf, _REPAIR_FN), select(spark, sf, _REPAIR_CALLS))


# suppliers' methods as implementations of traits, some at places that no function of the index has
_IMPLS = (
    "SELECT concat('crates/n', s_nationkey, '/s.rs') AS file, concat('Trait', s_nationkey % 4) AS trait, CASE WHEN s_suppkey % 3 = 0 THEN 'Auth,Data' WHEN s_suppkey % 3 = 1 THEN 'T' ELSE '' END AS trait_args,"
    " concat('Type', s_suppkey % 9) AS type, concat('m', s_nationkey % 3) AS method, CAST(s_suppkey % 50 AS INT) AS line FROM supplier"
)
_IMPL_FN = (
    "SELECT concat('F', s_suppkey) AS symbol, concat('fn', s_suppkey % 40) AS name, concat('crates/n', s_nationkey, '/s.rs') AS file, CAST(min(s_suppkey % 50) AS INT) AS def_line FROM supplier WHERE s_acctbal > 2000 GROUP BY s_suppkey, s_nationkey"
    " UNION ALL SELECT concat('T', n_nationkey), concat('Trait', n_nationkey % 4, '#m', n_nationkey % 3), concat('crates/n', n_nationkey, '/t.rs'), 1 FROM nation"
)
_KEY = "trait || '|' || type || '|' || trait_args || '|' || method"
_RANKED = (
    f"i AS ({_IMPLS})", f"f AS ({_IMPL_FN})",
    "last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file, line ORDER BY type DESC, trait_args DESC) AS rn FROM i) WHERE rn = 1)",
    "miss AS (SELECT 'synthetic://' || file || '::' || line AS symbol, type || '#' || trait || CASE WHEN trait_args = '' THEN '' ELSE '<' || trait_args || '>' END || '#' || method AS name, file, line AS def_line FROM"
    " (SELECT *, row_number() OVER (PARTITION BY file, line ORDER BY type, trait_args) AS rn FROM i) WHERE rn = 1 AND (file, line) NOT IN (SELECT (file, def_line) FROM f))",
    "fs AS (SELECT * FROM f UNION ALL SELECT * FROM miss)",
)


def _impl_frames(spark, sf):
    rows = A.triples(select(spark, sf, _IMPLS))
    functions = select(spark, sf, _IMPL_FN)
    return A.with_missing_nodes(functions, rows), rows


@register(
    "annotated_nodes",
    oracle(
        f"SELECT fs.symbol, fs.name, fs.file, def_line, trait AS impl_trait, type AS impl_type, trait_args AS impl_trait_args, method AS impl_method, {_KEY} AS impl_spec_key"
        " FROM fs LEFT JOIN last ON fs.file = last.file AND fs.def_line = last.line", *_RANKED,
    ),
)
def annotated_nodes(spark, sf):
    return A.annotate_nodes(*_impl_frames(spark, sf))


_BEST = (
    "best AS (SELECT aname, file, symbol AS abstract FROM (SELECT x.aname, x.file, fs.symbol, row_number() OVER (PARTITION BY x.aname, x.file ORDER BY"
    " len(list_filter(range(1, least(length(x.file), length(fs.file)) + 1), lambda k: left(x.file, k) = left(fs.file, k))) DESC, fs.symbol) AS rn"
    " FROM (SELECT DISTINCT trait || '#' || method AS aname, file FROM i) x JOIN fs ON fs.name = x.aname) WHERE rn = 1)",
    "impl_edges AS (SELECT concrete, abstract, type AS impl_type, trait AS trait_name, trait_args, method, spec_key FROM (SELECT fs.symbol AS concrete, b.abstract, i.*,"
    f" {_KEY} AS spec_key, row_number() OVER (PARTITION BY fs.symbol, b.abstract ORDER BY i.type DESC, i.trait_args DESC) AS rn"
    " FROM i JOIN best b ON b.aname = i.trait || '#' || i.method AND b.file = i.file JOIN fs ON fs.file = i.file AND fs.def_line = i.line) WHERE rn = 1)",
)


@register("implements_edges", oracle("SELECT * FROM impl_edges", *_RANKED, *_BEST))
def implements_edges(spark, sf):
    return A.implements(*_impl_frames(spark, sf)).withColumn("trait_args", F.array_join("trait_args", ","))


@register("trait_map", oracle("SELECT trait, array_to_string(list_sort(list_distinct(list(type))), ',') AS types FROM fs JOIN last ON fs.file = last.file AND fs.def_line = last.line GROUP BY trait", *_RANKED))
def trait_map(spark, sf):
    return A.trait_map(A.annotate_nodes(*_impl_frames(spark, sf))).withColumn("types", F.array_join("types", ","))


# notes of types at places: some by a turbofish, some by a bound variable; bodies of implemented methods with names they call
_GENERIC = "SELECT concat('f', l_suppkey % 40) AS file, concat('go', l_partkey % 30) AS callee, concat('Ty', l_linenumber) AS type_param, CAST(l_orderkey % 400 AS INT) AS line FROM lineitem WHERE l_returnflag = 'R'"
_BOUND = "SELECT concat('f', l_suppkey % 40) AS file, concat('go', l_partkey % 30) AS callee, concat('Al', l_linenumber) AS type_param, CAST(l_orderkey % 400 AS INT) AS line FROM lineitem WHERE l_returnflag = 'N'"
_ALIASES = "SELECT concat('f', n_nationkey) AS file, concat('Al', n_nationkey % 5) AS alias, concat('Real', n_nationkey) AS type, CAST(n_nationkey AS INT) AS ord FROM nation"


@register(
    "merged_call_notes",
    oracle(
        "SELECT file, callee, type_param, line, count(*) AS n FROM (SELECT * FROM g UNION ALL SELECT file, callee, type_param, line FROM (SELECT *, row_number() OVER (PARTITION BY file, line ORDER BY callee, type_param) AS rn"
        " FROM (SELECT b.file, callee, coalesce(a.type, type_param) AS type_param, line FROM b LEFT JOIN (SELECT alias, arg_max(type, (file, ord)) AS type FROM al GROUP BY alias) a ON a.alias = b.type_param)"
        " WHERE (file, line) NOT IN (SELECT (file, line) FROM g)) WHERE rn = 1) GROUP BY ALL",
        f"g AS ({_GENERIC})", f"b AS ({_BOUND})", f"al AS ({_ALIASES})",
    ),
)
def merged_call_notes(spark, sf):
    generic, bound, aliases = (select(spark, sf, q) for q in (_GENERIC, _BOUND, _ALIASES))
    return A.merge_calls(generic, A.resolve_aliases(bound, aliases)).groupBy("file", "callee", "type_param", "line").agg(F.count(F.lit(1)).alias("n"))


_METHOD_BODIES = "SELECT concat('crates/n', s_nationkey, '/s.rs') AS file, CAST(s_suppkey % 50 AS INT) AS function_line, concat('fn', (s_suppkey * 7 + n_nationkey) % 60) AS callee, CAST(100 + n_nationkey AS INT) AS line FROM supplier, nation"
_KNOWN_CALLS = "SELECT concat('F', s_suppkey) AS caller, concat('F', s_suppkey % 10) AS callee, 'x.rs' AS file, CAST(s_suppkey AS INT) AS line FROM supplier"


@register(
    "synthetic_calls",
    oracle(
        "SELECT caller, callee, file, line, false AS synthetic FROM k UNION ALL SELECT caller, callee, file, line, true FROM (SELECT c.symbol AS caller, u.symbol AS callee, b.file, min(b.line) AS line FROM b"
        " JOIN fs c ON c.file = b.file AND c.def_line = b.function_line JOIN (SELECT name, min(symbol) AS symbol FROM fs WHERE NOT contains(name, '#') GROUP BY name HAVING count(*) = 1) u ON u.name = b.callee"
        " WHERE (b.file, b.function_line) IN (SELECT (file, line) FROM i) GROUP BY ALL) WHERE (caller, callee) NOT IN (SELECT (caller, callee) FROM k)",
        *_RANKED, f"b AS ({_METHOD_BODIES})", f"k AS ({_KNOWN_CALLS})",
    ),
)
def synthetic_calls(spark, sf):
    functions, rows = _impl_frames(spark, sf)
    return A.synthetic_calls(functions, rows, select(spark, sf, _METHOD_BODIES), select(spark, sf, _KNOWN_CALLS))


_PLACED_CALLS = "SELECT concat('S', l_suppkey) AS caller, concat('P', l_partkey) AS callee, concat('f', l_suppkey % 50) AS file, CAST(min(l_orderkey % 1000) AS INT) AS line FROM lineitem GROUP BY l_suppkey, l_partkey"
_GUARD_SPANS = (
    "SELECT concat('f', o_custkey % 50) AS file, CAST(o_orderkey % 1000 AS INT) AS lo, CAST(o_orderkey % 1000 + CAST(floor(o_totalprice) AS BIGINT) % 40 AS INT) AS hi, CAST(o_orderkey AS INT) AS depth,"
    " CASE o_orderkey % 4 WHEN 0 THEN 'stop' WHEN 1 THEN 'match' ELSE 'if' END AS kind, concat('c', o_custkey % 9) AS condition, CASE WHEN o_orderkey % 4 = 1 THEN concat('Connector::C', o_custkey % 5) END AS arm FROM orders"
)


@register(
    "guarded_calls",
    oracle(
        "SELECT caller, callee, c.file, c.line, CASE WHEN g.kind <> 'stop' THEN g.kind END AS guard_type, CASE WHEN g.kind <> 'stop' THEN g.condition END AS guard_condition, CASE WHEN g.kind <> 'stop' THEN g.arm END AS match_arm"
        " FROM c LEFT JOIN (SELECT p.file, p.line, arg_max({'kind': kind, 'condition': condition, 'arm': arm}, (depth, lo)) AS g FROM (SELECT DISTINCT file, line FROM c) p JOIN s ON p.file = s.file AND p.line BETWEEN lo AND hi GROUP BY ALL) t"
        " ON t.file = c.file AND t.line = c.line",
        f"c AS ({_PLACED_CALLS})", f"s AS ({_GUARD_SPANS})",
    ),
)
def guarded_calls(spark, sf):
    return A.guard_calls(select(spark, sf, _PLACED_CALLS), select(spark, sf, _GUARD_SPANS))


@register(
    "graph_summary",
    oracle(
        "SELECT 'functions_with_trait' AS measure, count(*) AS n FROM fs JOIN last ON fs.file = last.file AND fs.def_line = last.line UNION ALL SELECT 'implements', count(*) FROM impl_edges"
        " UNION ALL SELECT 'calls_with_type', count(*) FILTER (WHERE l_returnflag = 'R') FROM lineitem UNION ALL SELECT 'synthetic_calls', count(*) FILTER (WHERE l_linenumber > 3) FROM lineitem",
        *_RANKED, *_BEST,
    ),
)
def graph_summary(spark, sf):
    functions, rows = _impl_frames(spark, sf)
    calls = select(spark, sf, "SELECT CASE WHEN l_returnflag = 'R' THEN 'T' END AS type_param, l_linenumber > 3 AS synthetic FROM lineitem")
    return A.summary(A.annotate_nodes(functions, rows), calls, A.implements(functions, rows))


@register(
    "trait_summary_topk",
    oracle("SELECT trait, count(*) AS impls FROM fs JOIN last ON fs.file = last.file AND fs.def_line = last.line GROUP BY trait ORDER BY impls DESC, trait LIMIT 10", *_RANKED),
)
def trait_summary_topk(spark, sf):
    return A.top_traits(A.annotate_nodes(*_impl_frames(spark, sf)))


_OCCURRENCES = "SELECT concat('S', l_partkey) AS symbol, concat('f', l_suppkey) AS file, l_orderkey AS doc_idx, l_linenumber AS occ_idx FROM lineitem"


@register("first_definitions", oracle(f"SELECT symbol, doc_idx, min(occ_idx) AS occ_idx FROM (SELECT *, min(doc_idx) OVER (PARTITION BY symbol) AS d FROM ({_OCCURRENCES})) WHERE doc_idx = d GROUP BY symbol, doc_idx"))
def first_definitions(spark, sf):
    return G.first_definitions(select(spark, sf, _OCCURRENCES)).select("symbol", "doc_idx", "occ_idx")
