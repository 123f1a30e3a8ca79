"""Queries over sources: texts rendered from the tables, read by the parsers, held against the tables they were made of.

A base is one portable SELECT. The Spark side turns its rows into the lines of files; the oracle
says in SQL what the parser must find again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.catalog_values import FLOW_ENDPOINTS, FLOW_INCLUDE_LIST
from tidemark.operators import catalog as T
from tidemark.operators import context as X
from tidemark.operators import report as R
from tidemark.plans.views import oracle, select, view
from tidemark.registry import oracle_of, register
from tidemark.sources import coverage_files as C
from tidemark.sources import files as S
from tidemark.sources import js, run_logs, rust, scip, scip_files, test_catalog
from tidemark.sources.catalog_store import artifact_kind
from tidemark.storage import shared_path


def files_of(rows: DataFrame, file: Column, order: list[str], line: Column) -> DataFrame:
    """file, text: the lines of each file, in order."""
    kept = rows.select(file.alias("file"), F.struct(*order).alias("o"), line.alias("t")).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("o", "t"))).alias("x"))
    return kept.select("file", F.array_join(F.transform("x", lambda r: r["t"]), "\n").alias("text"))


def said(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) and not p.startswith("$") else F.col(p[1:]).cast("string") if isinstance(p, str) else p for p in parts])


# ---- coverage formats: a text holds the files of some suppliers in one build

_OF_TEXT = 20
_PART = "CAST(regexp_extract(file, '/s([0-9]+)', 1) AS BIGINT)"
_BUILD = f"tag || '-' || ({_PART} // {_OF_TEXT})"


def _per_text(spark, sf, name: str) -> DataFrame:
    """The view's rows, with tag saying which text of which build they go to."""
    part = F.floor(F.expr(_PART) / _OF_TEXT).cast("string")
    return view(spark, sf, name).withColumn("tag", F.concat("tag", F.lit("-"), part))


def traces(spark, sf, second: Column) -> DataFrame:
    """One record per file, each line twice: its hits, then second."""
    rows = _per_text(spark, sf, "v_cov_line").withColumn("hits", F.greatest("hits", F.lit(0).cast("long")))
    line = F.concat(said("DA:", F.col("line").cast("string"), ",", F.col("hits").cast("string")), said("\nDA:", F.col("line").cast("string"), ",", second.cast("string")))
    records = rows.groupBy("tag", "file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", line.alias("t")))), lambda x: x["t"]), "\n").alias("das"))
    return files_of(records, F.col("tag"), ["file"], F.concat(F.lit("TN:\nSF:/src/"), "file", F.lit("\n"), "das", F.lit("\nend_of_record")))


_LAST_TRACE = "SELECT file, line, greatest(hits, 0) AS hits FROM v_cov_line WHERE (file, tag) IN (SELECT (file, max(tag)) FROM v_cov_line GROUP BY file)"


@register("lcov_records", oracle(f"SELECT file, line, hits + 1 AS hits FROM ({_LAST_TRACE})"))
def lcov_records(spark, sf):
    return C.lcov(traces(spark, sf, F.lit(1)), root="/src").select("file", F.col("line").cast("long").alias("line"), "hits")


@register(
    "lcov_last_record",
    oracle("SELECT file, line, 2 * arg_max(greatest(hits, 0), tag) AS hits FROM v_cov_line WHERE file = 'crates/n3/s3.rs' OR ends_with(file, '/n5/s5.rs') GROUP BY file, line"),
)
def lcov_last_record(spark, sf):
    hits = C.lcov(traces(spark, sf, F.col("hits") * 2), "last", "/src/")
    out = C.lcov_of(hits, "crates/n3/s3.rs").unionByName(C.lcov_of(hits, "n5/s5.rs"))
    return out.select("file", F.col("line").cast("long").alias("line"), "hits")


@register("line_hit_table", oracle("SELECT tag || ':' || file AS file, line, hits + 10 AS hits FROM v_cov_line WHERE hits >= 0"))
def line_hit_table(spark, sf):
    rows = view(spark, sf, "v_cov_line")
    own = F.when(F.col("hits") < 0, said("  ", "$line", "  (no DA) text")).otherwise(F.concat(said(" ", "$line", "  ", "$hits", "  first\n"), said(" ", "$line", " ", (F.col("hits") + 10).cast("string"), "   let x = 1;")))
    out = C.line_table(files_of(rows, F.concat_ws(":", "tag", "file"), ["line"], own))
    return out.select("file", F.col("line").cast("long").alias("line"), "hits")


def _tree_texts(spark, sf) -> DataFrame:
    """Folders in folders, files with their lines' hits."""
    rows = _per_text(spark, sf, "v_cov_line").groupBy("tag", "file").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "hits"))), lambda x: x["hits"]).alias("coverage"))
    n = lambda f: F.size(F.filter("coverage", f))
    leaf = F.struct("coverage", n(lambda h: h > 0).alias("linesCovered"), n(lambda h: h == 0).alias("linesMissed"), n(lambda h: h >= 0).alias("linesTotal"), F.lit(12.5).alias("coveragePercent"))
    part = F.split("file", "/")
    rows = rows.select("tag", part[0].alias("a"), part[1].alias("b"), part[2].alias("c"), leaf.alias("leaf"))
    folder = lambda name, inner: F.struct(F.map_from_entries(F.collect_list(F.struct(name, inner))).alias("children"))
    rows = rows.groupBy("tag", "a", "b").agg(folder("c", "leaf").alias("x")).groupBy("tag", "a").agg(folder("b", "x").alias("y")).groupBy("tag").agg(folder("a", "y").alias("z"))
    return rows.select(F.concat("tag", F.lit(".json")).alias("file"), F.to_json("z").alias("text"))


_TREE_SQL = (
    f"SELECT {_BUILD} || '.json' AS file, file AS filename, count(*) FILTER (WHERE hits > 0) AS covered, count(*) FILTER (WHERE hits = 0) AS missed, count(*) FILTER (WHERE hits >= 0) AS total, 12.5::DOUBLE AS percent,"
    " coalesce(string_agg(pos::VARCHAR, ',' ORDER BY pos) FILTER (WHERE hits = 0), '') AS uncovered FROM (SELECT *, row_number() OVER (PARTITION BY tag, file ORDER BY line) AS pos FROM v_cov_line) GROUP BY tag, file"
)


@register("tree_report", oracle(_TREE_SQL))
def tree_report(spark, sf):
    out = C.tree_files(_tree_texts(spark, sf))
    return out.select("file", "filename", "covered", "missed", "total", "percent", F.array_join("uncovered", ",").alias("uncovered"))


def _llvm_texts(spark, sf) -> DataFrame:
    """Files' summaries (of regions only what is not covered) and functions."""
    stat = lambda total, covered: F.struct(F.col(total).alias("count"), F.col(covered).alias("covered"))
    regions = F.struct(F.col("region_total").alias("count"), F.lit(0).alias("covered"), (F.col("region_total") - F.col("region_covered")).alias("notcovered"))
    files = _per_text(spark, sf, "v_cov_file").select("tag", F.struct(
        F.col("file").alias("filename"), F.struct(stat("line_total", "line_covered").alias("lines"), stat("line_missed", "line_missed").alias("functions"), regions.alias("regions")).alias("summary")).alias("f"))
    funcs = _per_text(spark, sf, "v_cov_func").select("tag", F.struct(F.col("func_name").alias("name"), F.col("cnt").alias("count"), F.array("file", F.lit("other")).alias("filenames")).alias("g"))
    both = files.groupBy("tag").agg(F.collect_list("f").alias("files")).join(funcs.groupBy("tag").agg(F.collect_list("g").alias("functions")), "tag")
    return both.select(F.concat("tag", F.lit(".llvm.json")).alias("file"), F.to_json(F.struct(F.array(F.struct("files", "functions")).alias("data"))).alias("text"))


@register(
    "llvm_export_files",
    oracle(f"SELECT {_BUILD} || '.llvm.json' AS file, file AS filename, line_covered AS lines_covered, line_total AS lines_total, line_missed AS functions_covered, line_missed AS functions_total, region_covered AS regions_covered, region_total AS regions_total FROM v_cov_file"),
)
def llvm_export_files(spark, sf):
    return C.llvm_rows(_llvm_texts(spark, sf))


@register("llvm_export_functions", oracle(f"SELECT {_BUILD} || '.llvm.json' AS file, func_name AS name, cnt AS count, file AS filename FROM v_cov_func"))
def llvm_export_functions(spark, sf):
    return C.llvm_function_rows(_llvm_texts(spark, sf))


@register(
    "coverage_reports",
    oracle(
        f"{_TREE_SQL} UNION ALL SELECT {_BUILD} || '.llvm.json', file, line_covered, line_total - line_covered, line_total, coalesce(round(100.0::DOUBLE * line_covered / nullif(line_total, 0), 2), 0.0), '' FROM v_cov_file"
    ),
)
def coverage_reports(spark, sf):
    out = C.report_rows(_tree_texts(spark, sf).unionByName(_llvm_texts(spark, sf)))
    return out.withColumn("uncovered", F.array_join("uncovered", ","))


# ---- Rust: some lines per supplier

# the files' numbers: a nation's, and 25 more for every 250 suppliers, so there are more of them where there is more
_FILE = "s_nationkey + 25 * CAST(floor(s_suppkey / 250) AS INT)"
_SUPPLIERS = f"SELECT k, s, CAST(row_number() OVER (PARTITION BY k ORDER BY s) AS INT) AS rn FROM (SELECT {_FILE} AS k, s_suppkey AS s FROM supplier) t"


def _rust(spark, sf, line: Column, head: str | None = None) -> DataFrame:
    rows = select(spark, sf, _SUPPLIERS)
    out = files_of(rows, said("n", "$k", ".rs"), ["rn"], line)
    return out if head is None else out.withColumn("text", F.concat(F.lit(head + "\n"), "text"))


@register(
    "rust_routes",
    oracle(
        "SELECT 'n' || k || '.rs' AS file, upper(CASE WHEN s % 2 = 0 THEN 'get' ELSE 'post' END) AS method, '/n/s' || s || '/{id}/r' AS path, 'h' || s AS handler, rn - 1 - v2 AS ord FROM"
        f" (SELECT *, count(*) FILTER (WHERE s % 11 = 3) OVER (PARTITION BY k ORDER BY rn)::INT AS v2 FROM ({_SUPPLIERS})) WHERE s % 11 <> 3"
    ),
)
def rust_routes(spark, sf):
    return S.parsed(route_texts(spark, sf), rust.routes, "method string, path string, handler string, ord int")


def route_texts(spark, sf) -> DataFrame:
    line = F.concat(
        said('    .service(\n      web::resource("/', F.when(F.col("s") % 11 == 3, F.lit("v2/")).otherwise(F.lit("")), "s", "$s", '/{id}/r")\n        .route(web::'),
        F.when(F.col("s") % 2 == 0, "get").otherwise("post"), said("().to(mod::h", "$s", ")))"),
    )
    return _rust(spark, sf, line, '  web::scope("/n")')


@register(
    "rust_impls",
    oracle(f"SELECT 'n' || k || '.rs' AS file, 'Trait' || k % 5 AS trait, CASE WHEN s % 3 = 0 THEN 'Auth,Data' ELSE '' END AS trait_args, 'Type' || s AS type, 'go' || s % 4 AS method, (4 * rn - 2)::INT AS line FROM ({_SUPPLIERS})"),
)
def rust_impls(spark, sf):
    return S.parsed(impl_texts(spark, sf), rust.impls, "trait string, trait_args string, type string, method string, line int")


def impl_texts(spark, sf) -> DataFrame:
    line = F.concat(
        said("impl<T> Trait", (F.col("k") % 5).cast("string"), F.when(F.col("s") % 3 == 0, F.lit("<Auth, a::Data<X>>")).otherwise(F.lit("")), " for Type", "$s", "<T> {\n"),
        said("    async fn go", (F.col("s") % 4).cast("string"), '(&self, a: Vec<u8>) -> Option<String> { let x = "}"; { x } }\n    // fn not_this() {}\n}'),
    )
    return _rust(spark, sf, line)


@register(
    "rust_generic_calls",
    oracle(
        f"SELECT 'n' || k || '.rs' AS file, 'run_' || s % 6 AS callee, 'Ty' || s AS type_param, (2 * rn)::INT AS line FROM ({_SUPPLIERS}) UNION ALL"
        f" SELECT 'n' || k || '.rs', 'take_' || s % 6, 'Made' || s % 3, (2 * rn + 1)::INT FROM ({_SUPPLIERS})"
    ),
)
def rust_generic_calls(spark, sf):
    six = (F.col("s") % 6).cast("string")
    line = F.concat(said("    a::run_", six, "::<Ty", "$s", ", _>(x, y);\n"), said("    self.take_", six, "(Made", (F.col("s") % 3).cast("string"), " { a: 1 }, z);"))
    return S.parsed(_rust(spark, sf, line, "fn f() {"), rust.generic_calls, "callee string, type_param string, line int")


@register("rust_bound_calls", oracle(f"SELECT 'n' || k || '.rs' AS file, 'send_' || s % 7 AS callee, 'Ty' || s % 9 AS type_param, (5 * rn - 2)::INT AS line FROM ({_SUPPLIERS}) WHERE s % 4 <> 1"))
def rust_bound_calls(spark, sf):
    kind = F.when(F.col("s") % 4 == 0, said(": Ty", (F.col("s") % 9).cast("string"), " = make")).when(F.col("s") % 4 == 1, F.lit(" = make")).otherwise(said(" = Ty", (F.col("s") % 9).cast("string"), "::new"))
    line = F.concat(said("fn f", "$s", "(c: u8) {\n    let mut v"), kind, said("(c);\n    m::send_", (F.col("s") % 7).cast("string"), "(&v, c);\n    other(c);\n}"))
    return S.parsed(_rust(spark, sf, line), rust.bound_calls, "callee string, type_param string, line int")


@register("rust_aliases", oracle(f"SELECT 'n' || k || '.rs' AS file, 'Alias' || s AS alias, 'First' || s % 8 AS type, (rn - 1 - gone)::INT AS ord FROM (SELECT *, count(*) FILTER (WHERE s % 5 = 2) OVER (PARTITION BY k ORDER BY rn) AS gone FROM ({_SUPPLIERS})) WHERE s % 5 <> 2"))
def rust_aliases(spark, sf):
    # short names are placeholders and no types
    first = F.when(F.col("s") % 5 == 2, F.lit("Op")).otherwise(said("First", (F.col("s") % 8).cast("string")))
    return S.parsed(_rust(spark, sf, F.concat(said("pub type Alias", "$s", "<T> = dyn m::Boxed<"), first, F.lit(", T>;"))), rust.aliases, "alias string, type string, ord int")


@register(
    "rust_body_calls",
    oracle(
        f"SELECT 'n' || k || '.rs' AS file, 'f' || s AS function, (4 * rn - 3)::INT AS function_line, callee, (4 * rn - 3 + l)::INT AS line FROM ({_SUPPLIERS}), (VALUES ('helper', 1), ('call_it', 2)) v(callee, l)"
    ),
)
def rust_body_calls(spark, sf):
    line = said("fn f", "$s", "() {\n    x.helper().unwrap().map_err(go);\n    a::call_it::<T>(spawn(y), abc(z)); // other()\n}")
    return S.parsed(_rust(spark, sf, line), rust.body_calls, "function string, function_line int, callee string, line int")


@register(
    "rust_guards",
    oracle(
        f"SELECT 'n' || k || '.rs' AS file, (9 * rn - 9 + lo)::INT AS lo, (9 * rn - 9 + hi)::INT AS hi, depth::INT AS depth, kind, condition || CASE WHEN kind = 'stop' THEN '' ELSE s::VARCHAR END AS condition, arm FROM ({_SUPPLIERS}),"
        " (VALUES (1, 9, 0, 'stop', '', NULL), (2, 5, 1, 'match', 'c', NULL), (3, 3, 1, 'match', 'c', 'Connector::A | Connector::B'), (4, 4, 1, 'match', 'c', '_'), (6, 8, 1, 'if_let', 'let Some(x) = y', NULL)) v(lo, hi, depth, kind, condition, arm)"
    ),
)
def rust_guards(spark, sf):
    line = F.concat(
        said("fn f", "$s", "() {\n    match c", "$s", " {\n        Connector::A | Connector::B => one(),\n        _ => { two() }\n    }\n"), said("    if let Some(x) = y", "$s", " {\n        go();\n    } else { no() }\n}"),
    )
    return S.parsed(_rust(spark, sf, line), rust.guard_spans, "lo int, hi int, depth int, kind string, condition string, arm string")


@register("rust_public_functions", oracle(f"SELECT 'n' || k || '.rs' AS file, 'open' || s AS name, (2 * rn - 1)::INT AS line FROM ({_SUPPLIERS}) WHERE s % 3 > 0"))
def rust_public_functions(spark, sf):
    line = F.concat(F.when(F.col("s") % 3 == 0, "fn").when(F.col("s") % 3 == 1, "pub fn").otherwise("  pub(crate) async fn"), said(" open", "$s", "() {\n}"))
    return S.parsed(_rust(spark, sf, line), rust.public_functions, "name string, line int")


@register("rust_struct_fields", oracle(f"SELECT 'n' || k || '.rs' AS file, 'Config' || s AS struct, (3 * rn - 1)::INT AS line FROM ({_SUPPLIERS}) WHERE s % 2 = 0"))
def rust_struct_fields(spark, sf):
    line = F.concat(said("pub struct Config", "$s", " {\n    pub "), F.when(F.col("s") % 2 == 0, "webhook_url").otherwise("other"), F.lit(": Option<String>,\n}"))
    return S.parsed(_rust(spark, sf, line), lambda text: rust.struct_fields(text, "webhook_url"), "struct string, line int")


@register(
    "rust_gates",
    oracle(
        f"SELECT 'n' || k || '.rs' AS file, 'Op' || s AS op, CASE s % 3 WHEN 0 THEN 'always_true' WHEN 1 THEN 'always_false' ELSE 'conditional' END AS gate FROM ({_SUPPLIERS})"
        f" UNION ALL SELECT DISTINCT 'n' || k || '.rs', '_default', 'always_true' FROM ({_SUPPLIERS})"
    ),
)
def rust_gates(spark, sf):
    line = F.concat(said('        "Op', "$s", '" => '), F.when(F.col("s") % 3 == 0, "true,").when(F.col("s") % 3 == 1, "false,").otherwise("{ a && b },"))
    text = _rust(spark, sf, line).withColumn("text", F.concat(F.lit('pub fn may_call(o: Op) -> bool {\n    match format!("{o:?}").as_str() {\n'), "text", F.lit("\n        _ => true,\n    }\n}")))
    return S.parsed(text, lambda t: rust.gates(t, "pub fn may_call"), "op string, gate string")


@register("rust_dispatch", oracle(f"SELECT 'n' || k || '.rs' AS file, 'f' || s AS function, (3 * rn - 2)::INT AS function_line, 'Payment' || s AS op FROM ({_SUPPLIERS}) WHERE s % 3 < 2"))
def rust_dispatch(spark, sf):
    call = F.when(F.col("s") % 3 == 0, said("payments_core::<api::Flow, _>(state, payments::Payment", "$s", ", data)")).when(F.col("s") % 3 == 1, said("x::payments_operation_core::<Payment", "$s", ", _>(state)"))
    line = F.concat(said("fn f", "$s", "() {\n    "), F.coalesce(call, F.lit("payments_core(state, PaymentsData { a })")), F.lit("\n}"))
    return S.parsed(_rust(spark, sf, line), rust.dispatched, "function string, function_line int, op string")


def _body(text: str):
    found = rust.body_span(text, 10)
    yield (*(found or (None, None)), rust.snippet(text, 1))


@register(
    "rust_body_span",
    oracle("SELECT 's' || s_suppkey AS file, CASE WHEN s_suppkey % 5 > 0 THEN 10 + s_suppkey % 3 END::INT AS first, CASE WHEN s_suppkey % 5 > 0 THEN 12 + s_suppkey % 3 END::INT AS last, length(CASE WHEN s_suppkey % 5 = 0 THEN 'no function' ELSE 'fn f(' || repeat(chr(10), s_suppkey % 3) || ') {' || chr(10) || ' x' || chr(10) || '}' END)::INT AS chars FROM supplier"),
)
def rust_body_span(spark, sf):
    rows = select(spark, sf, "SELECT s_suppkey AS s FROM supplier")
    text = F.when(F.col("s") % 5 == 0, "no function").otherwise(F.concat(F.lit("fn f("), F.repeat(F.lit("\n"), (F.col("s") % 3).cast("int")), F.lit(") {\n x\n}\nfn g() {}")))
    out = S.parsed(rows.select(said("s", "$s").alias("file"), text.alias("text")), _body, "first int, last int, source string")
    return out.select("file", "first", "last", F.length("source").alias("chars"))


@register(
    "source_index",
    oracle(
        "SELECT c.file, flow AS first_flow, pos AS first_pos, l.line_count, l.functions FROM (SELECT 'n' || k || '.rs' AS file, min(s) AS flow, arg_min(s % 4, s) AS pos FROM"
        f" ({_SUPPLIERS}) GROUP BY k UNION ALL SELECT 'gone.rs', 0, 9) c LEFT JOIN"
        f" (SELECT 'n' || k || '.rs' AS file, 2 * count(*) AS line_count, string_agg((2 * rn - 1) || ':open' || s, ',' ORDER BY rn) FILTER (WHERE s % 2 = 0) AS functions FROM ({_SUPPLIERS}) GROUP BY k) l ON l.file = c.file"
    ),
)
def source_index(spark, sf):
    line = F.concat(F.when(F.col("s") % 2 == 0, "pub fn").otherwise("fn"), said(" open", "$s", "() {\n}"))
    chains = select(spark, sf, f"SELECT concat('n', k, '.rs') AS file, s AS flow_id, s % 4 AS pos FROM ({_SUPPLIERS}) UNION ALL SELECT 'gone.rs', 0, 9")
    lines = S.lines(_rust(spark, sf, line)).withColumnRenamed("line_no", "line")
    out = X.source_index(chains, lines)
    listed = F.array_join(F.transform("functions", lambda f: F.concat_ws(":", f["line"].cast("string"), f["name"])), ",")
    return out.withColumn("functions", F.when(F.size("functions") > 0, listed))


# ---- the index of symbols: documents of suppliers' definitions and of calls to them, as the binary format has them

# documents of at most 50 suppliers, so that line numbers fit one byte
_SYMBOLS = (
    "SELECT concat(s_nationkey, '_', CAST(floor((n - 1) / 50.0) AS INT)) AS k, s_suppkey AS s, CAST((n - 1) % 50 + 1 AS INT) AS rn FROM"
    " (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier) t"
)


@register(
    "symbol_index_calls",
    oracle(
        f"SELECT 'm/f' || d.s || '().' AS caller, 'm/f' || d.s % 7 || '().' AS callee, 'n' || d.k || '.rs' AS file, (2 * d.rn + 1)::INT AS line FROM ({_SYMBOLS}) d"
    ),
)
def symbol_index_calls(spark, sf):
    return scip.call_graph(scip.decoded(_symbol_documents(spark, sf)))[1]


@register("symbol_index_files", oracle_of("symbol_index_calls"))
def symbol_index_files(spark, sf):
    # an index per nation, with all its documents, in files that are read in ranges of some hundred bytes
    docs = _symbol_documents(spark, sf).select(F.split("k", "_")[0].alias("name"), F.split("k", "_")[1].cast("int").alias("n"), "content")
    indexes = docs.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "content"))), lambda x: x["content"]).alias("documents"))
    folder = shared_path(spark, "symbol-indexes")
    scip_files.save(indexes, folder).write.parquet(shared_path(spark, "saved-indexes"))
    return scip.call_graph(scip_files.read(spark, folder, split=512).drop("index"))[1]


def _symbol_documents(spark, sf) -> DataFrame:
    # each supplier: a definition in an even line, a call in the line after it
    field = lambda number, text: F.concat(F.unhex(F.lit(f"{number << 3 | 2:02X}")), F.unhex(F.lpad(F.hex(F.octet_length(text)), 2, "0")), text)
    wide = lambda number, data: F.concat(  # noqa: E731  lengths of two bytes
        F.unhex(F.lit(f"{number << 3 | 2:02X}")), F.unhex(F.lpad(F.hex(F.octet_length(data) % 128 + 128), 2, "0")), F.unhex(F.lpad(F.hex(F.floor(F.octet_length(data) / 128)), 2, "0")), data)

    def occurrence(line: Column, symbol: Column, roles: int) -> Column:
        at = F.concat(F.unhex(F.lpad(F.hex(line), 2, "0")), F.unhex(F.lit("0003")))
        return field(2, F.concat(field(1, at), field(2, F.encode(symbol, "utf-8")), F.unhex(F.lit(f"18{roles:02X}"))))

    rows = select(spark, sf, _SYMBOLS)
    both = F.concat(occurrence(2 * F.col("rn") - 1, said("m/f", "$s", "()."), 1), occurrence(2 * F.col("rn"), said("m/f", (F.col("s") % 7).cast("string"), "()."), 0))
    docs = rows.select("k", "rn", both.alias("b")).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("rn", "b"))).alias("x"))
    body = F.aggregate("x", F.lit(b""), lambda out, r: F.concat(out, r["b"]))
    return docs.select("k", wide(2, F.concat(field(1, F.encode(said("n", "$k", ".rs"), "utf-8")), body)).alias("content"))


# ---- JavaScript: a configuration per supplier, a spec per customer, the lists of a helper file

_BLOCKS = (
    "SELECT s_name AS connector, s_suppkey AS s, CASE p_size % 10 WHEN 0 THEN 'Overcapture' WHEN 1 THEN 'Capture' WHEN 2 THEN 'Refund' ELSE concat('Flow', p_size) END AS flow, CAST(max(p_partkey) AS BIGINT) AS amount, CAST(count(*) AS BIGINT) AS n"
    " FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_name, s_suppkey, CASE p_size % 10 WHEN 0 THEN 'Overcapture' WHEN 1 THEN 'Capture' WHEN 2 THEN 'Refund' ELSE concat('Flow', p_size) END"
)


def _configs(spark, sf) -> DataFrame:
    rows = select(spark, sf, _BLOCKS)
    line = F.concat(
        said("    ", "$flow", ": {\n      // Old: { Request: {}, Response: {} }\n      Request: { card: { amount: 1 }, amount: ", "$amount", ', note: "}", '), F.when(F.col("n") % 2 == 0, "amount_to_capture: 5, ").otherwise(""),
        said("currency: cur },\n      Response: { body: { status: \"ok\" }, status: ", (200 + F.col("n") % 100).cast("string"), " },\n    },"),
    )
    out = files_of(rows, F.concat(F.lit("cypress/e2e/configs/Payment/"), F.replace("connector", F.lit("#"), F.lit("")), F.lit(".js")), ["flow"], line)
    return out.withColumn("text", F.concat(F.lit("export const connectorDetails = {\n  card_pm: {\n"), "text", F.lit("\n    Half: { Request: {} },\n  },\n};\n")))


_CONNECTOR = "replace(connector, '#', '')"


@register(
    "js_flow_configs",
    oracle(f"SELECT {_CONNECTOR} AS connector, flow, (200 + n % 100)::INT AS response_status, amount::VARCHAR AS amount, 'cur' AS currency, n % 2 = 0 AS has_amount_to_capture FROM ({_BLOCKS})"),
)
def js_flow_configs(spark, sf):
    out = test_catalog.connector_tables(test_catalog.connector_files(_configs(spark, sf)))["flow_config"]
    return out.select("connector", "flow", "response_status", F.col("request_fields")["amount"].alias("amount"), F.col("request_fields")["currency"].alias("currency"), "has_amount_to_capture")


_SPECS = "SELECT o_custkey AS c, o_orderkey AS o, o_orderstatus AS st, o_orderpriority AS pr, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS rn FROM orders"


def _specs(spark, sf) -> DataFrame:
    call = F.when(F.startswith("pr", F.lit("1")), "cy.captureCallTest(x);").when(F.startswith("pr", F.lit("2")), 'get(x)["card_pm"]["Refund"];').otherwise("// cy.voidCallTest(x)")
    line = F.concat(F.when(F.col("st") == "F", "  xit(`").otherwise('  it("'), said("t", "$o"), F.when(F.col("st") == "F", "`").otherwise('"'), F.lit(", () => {\n    "), call, F.lit("\n  });"))
    out = files_of(select(spark, sf, _SPECS), said("cypress/e2e/spec/Payment/", F.lpad(F.col("c").cast("string"), 6, "0"), "-Spec.cy.js"), ["rn"], line)
    return out.withColumn("text", F.concat(F.lit("import \"../helper\";\ndescribe('x', () => {\n"), "text", F.lit("\n});\n")))


@register("js_tests", oracle(f"SELECT lpad(c::VARCHAR, 6, '0') || '-Spec::t' || o AS id, (3 * rn)::INT AS line, st = 'F' AS skipped, 'Payment' AS suite FROM ({_SPECS})"))
def js_tests(spark, sf):
    out = test_catalog.spec_tables(test_catalog.spec_files(_specs(spark, sf)))["test_case"]
    return out.select("id", "line", "skipped", "suite")


@register(
    "js_tested_endpoints",
    oracle(
        f"SELECT path, count(*) AS tests FROM (SELECT o, CASE f.flow WHEN 'Capture' THEN '/payments/:id/capture' ELSE '/refunds' END AS path FROM ({_SPECS}) s JOIN (SELECT DISTINCT c, CASE WHEN starts_with(pr, '1') THEN 'Capture' ELSE 'Refund' END AS flow"
        f" FROM ({_SPECS}) WHERE pr[1] IN ('1', '2')) f ON s.c = f.c) GROUP BY path"
    ),
)
def js_tested_endpoints(spark, sf):
    out = test_catalog.spec_tables(test_catalog.spec_files(_specs(spark, sf)))["calls_endpoint"]
    return out.groupBy("path").agg(F.count(F.lit(1)).alias("tests"))


def _helper(spark, sf) -> DataFrame:
    """The helper file: who may overcapture, by some suppliers' names in lower case."""
    names = select(spark, sf, "SELECT s_name, s_suppkey FROM supplier").where("s_suppkey % 3 = 0").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda x: F.concat(F.lit('"'), F.replace(x["s_name"], F.lit("#"), F.lit("")), F.lit('"'))), ", // next\n      ").alias("x"))
    text = F.concat(F.lit("export const CONNECTOR_LISTS = {\n  INCLUDE: {\n    OVERCAPTURE: ["), "x", F.lit(", // \"none\"\n    ],\n    EMPTY: [],\n  },\n  EXCLUDE: { AGNOSTIC: [\"stripe\"] },\n};"))
    return names.select(F.lit("cypress/e2e/configs/Payment/Utils.js").alias("file"), text.alias("text"))


@register(
    "js_lists",
    oracle("SELECT 'INCLUDE.OVERCAPTURE' AS key, coalesce(string_agg(replace(s_name, '#', ''), ',' ORDER BY s_suppkey), '') AS connectors FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT 'INCLUDE.EMPTY', '' UNION ALL SELECT 'EXCLUDE.AGNOSTIC', 'Stripe'"),
)
def js_lists(spark, sf):
    out = test_catalog.list_tables(_helper(spark, sf))["feature_list"]
    return out.select("key", F.array_join("connectors", ",").alias("connectors"))


@register(
    "js_catalog_status",
    oracle(
        f"SELECT status, count(*) AS n FROM (SELECT CASE WHEN (c.connector, f.flow) NOT IN (SELECT ({_CONNECTOR}, flow) FROM b) THEN 'MISSING_CONFIG' WHEN f.flow IN ('Overcapture', 'IncrementalAuth', 'ManualRetryPaymentEnabled',"
        " 'ManualRetryPaymentDisabled', 'ManualRetryPaymentCutoffExpired', 'MandatesUsingNTIDProxy', 'DDCRaceConditionClientSide', 'DDCRaceConditionServerSide', 'PaymentWebhook') AND NOT (f.flow = 'Overcapture' AND c.connector IN"
        " (SELECT replace(s_name, '#', '') FROM supplier WHERE s_suppkey % 3 = 0)) THEN 'NOT_IN_ALLOWLIST' WHEN f.flow NOT IN ('Capture', 'Refund') THEN 'MISSING_TEST' ELSE 'COVERED' END AS status"
        f" FROM (SELECT DISTINCT {_CONNECTOR} AS connector FROM b UNION SELECT replace(s_name, '#', '') FROM supplier WHERE s_suppkey % 3 = 0 UNION SELECT 'Stripe') c,"
        " (SELECT flow FROM b UNION SELECT unnest(['Capture', 'Refund', 'Overcapture', 'IncrementalAuth', 'ManualRetryPaymentEnabled', 'ManualRetryPaymentDisabled', 'ManualRetryPaymentCutoffExpired', 'MandatesUsingNTIDProxy',"
        " 'DDCRaceConditionClientSide', 'DDCRaceConditionServerSide', 'PaymentWebhook', 'ConnectorAgnosticNTID'])) f) GROUP BY status",
        f"b AS ({_BLOCKS})",
    ),
)
def js_catalog_status(spark, sf):
    found = test_catalog.tables(_configs(spark, sf).unionByName(_specs(spark, sf)).unionByName(_helper(spark, sf)))
    status = T.grid_status(found["connector"], found["flow_config"], found["in_list"], test_catalog.flow_list(spark), found["tests_flow"].select("flow"))
    return status.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@register(
    "flow_endpoints",
    oracle(
        f"SELECT {_CONNECTOR} AS connector, path, method, count(*)::INT AS flows, string_agg(flow, ',' ORDER BY flow) AS names FROM ({_BLOCKS}) JOIN (VALUES "
        + ", ".join(f"('{f}', '{m}', '{p}')" for f, m, p in FLOW_ENDPOINTS)
        + ") v(flow, method, path) USING (flow) GROUP BY 1, 2, 3"
    ),
)
def flow_endpoints(spark, sf):
    blocks = test_catalog.connector_tables(test_catalog.connector_files(_configs(spark, sf)))["flow_config"].select("connector", "flow")
    called = blocks.join(test_catalog.flow_endpoint(spark), "flow").groupBy("connector", "path", "method")
    return called.agg(F.count(F.lit(1)).cast("int").alias("flows"), F.array_join(F.array_sort(F.collect_list("flow")), ",").alias("names"))


def _patched(text: str):
    grown, done = js.insert_after(text, "Capture", "    Fresh: { Request: {}, Response: {} },")
    yield done, js.last_flow(grown), [row[0] for row in js.flow_configs(grown)]


@register(
    "js_patched_configs",
    oracle(
        f"SELECT 'cypress/e2e/configs/Payment/' || {_CONNECTOR} || '.js' AS file, true AS done, max(flow) AS last, array_to_string(list_concat(list(flow ORDER BY flow) FILTER (WHERE flow <= 'Capture'), CASE WHEN bool_or(flow = 'Capture') THEN ['Fresh'] ELSE [] END,"
        f" list(flow ORDER BY flow) FILTER (WHERE flow > 'Capture'), CASE WHEN bool_or(flow = 'Capture') THEN [] ELSE ['Fresh'] END), ',') AS flows FROM ({_BLOCKS}) GROUP BY connector"
    ),
)
def js_patched_configs(spark, sf):
    out = S.parsed(_configs(spark, sf), _patched, "done boolean, last string, flows array<string>")
    return out.select("file", "done", F.when(F.array_contains("flows", "Capture"), F.col("last")).otherwise(F.element_at("flows", -2)).alias("last"), F.array_join("flows", ",").alias("flows"))


# ---- logs and listings

@register("log_matching_lines", oracle("SELECT 'run' || file_id AS file, row_number() OVER (PARTITION BY file_id ORDER BY line_no)::INT AS line_no, txt FROM v_run_log QUALIFY contains(txt, 'purchase')"))
def log_matching_lines(spark, sf):
    texts = files_of(view(spark, sf, "v_run_log"), said("run", "$file_id"), ["line_no"], F.col("txt"))
    return S.matching_lines(texts, "purchase")


_RUN = "SELECT o_custkey AS c, o_orderkey AS o, o_orderkey % 6 AS passing, CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 3 ELSE 0 END AS failing FROM orders"


@register(
    "run_segments",
    oracle(
        "SELECT 'c' || c AS file, 'spec' || o || '.cy.js' AS spec, (passing + failing)::INT AS tests, passing::INT AS passing, failing::INT AS failing, o % 50 || ' seconds' AS duration, CASE WHEN failing > 0 THEN 'failed' WHEN passing > 0 THEN 'ok' ELSE 'partial' END AS status,"
        f" 'id-' || o AS request_ids, 'pay|wait ' || o % 4 AS steps, 'no ' || o % 9 || '|Bad thing' AS messages, CASE WHEN o % 2 = 0 THEN '404' ELSE '' END AS statuses FROM ({_RUN}) WHERE o % 7 > 0"
    ),
)
def run_segments(spark, sf):
    return shown_segments(S.parsed(run_texts(spark, sf), run_logs.segments, _SEGMENT_COLUMNS))


_SEGMENT_COLUMNS = "spec string, tests int, passing int, failing int, duration string, status string, request_ids array<string>, steps array<string>, messages array<string>, statuses array<string>, failed array<string>"


def run_texts(spark, sf) -> DataFrame:
    """One log per customer, one spec per order."""
    dash = lambda c: F.when(F.col(c) == 0, "-").otherwise(F.col(c).cast("string"))
    line = F.concat(
        said("  Running:  spec", "$o", ".cy.js\n\x1b[32mSTEP: pay\x1b[0m\nSTEP: wait ", (F.col("o") % 4).cast("string"), "\nSTEP: pay\n x-request-id -> id-", "$o", '\n{"message": "no ', (F.col("o") % 9).cast("string"), '"}\nError: Bad thing\n'),
        F.when(F.col("o") % 2 == 0, "status_code: 404\n").otherwise(""), F.when(F.col("o") % 7 > 0, "  (Results)\n").otherwise("  crashed\n"),
        said(" │ Tests:  ", (F.col("passing") + F.col("failing")).cast("string"), " │\n │ Passing:  "), dash("passing"), F.lit(" │\n │ Failing:  "), dash("failing"), said(" │\n │ Duration:  ", (F.col("o") % 50).cast("string"), " seconds │"),
    )
    return files_of(select(spark, sf, _RUN), said("c", "$c"), ["o"], line)


def shown_segments(out: DataFrame) -> DataFrame:
    return out.select("file", "spec", "tests", "passing", "failing", "duration", "status", *[F.array_join(c, "|").alias(c) for c in ("request_ids", "steps", "messages", "statuses")])


@register("json_bodies", oracle("SELECT 'c' || o_custkey AS file, '{\"a\": {\"b\": ' || o_orderkey || '}, \"c\": \"}\"}' AS body FROM orders WHERE o_orderkey % 3 > 0"))
def json_bodies(spark, sf):
    rows = select(spark, sf, "SELECT o_custkey AS c, o_orderkey AS o FROM orders")
    line = F.when(F.col("o") % 3 == 0, said("not { json ", "$o", " [")).otherwise(said('got {"a": {"b": ', "$o", '}, "c": "}"} there'))
    return S.parsed(files_of(rows, said("c", "$c"), ["o"], line), lambda t: ((x,) for x in run_logs.bodies(t)), "body string")


@register(
    "verdict_answers",
    oracle("SELECT 'o' || o_orderkey AS file, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE 'V' || o_custkey % 5 END AS verdict FROM orders"),
)
def verdict_answers(spark, sf):
    rows = select(spark, sf, "SELECT o_orderkey AS o, o_custkey % 5 AS v FROM orders")
    fenced = said('Well:\n```json\n{"verdict": "V', "$v", '", "reason": "{"}\n``` so')
    text = F.when(F.col("o") % 4 == 0, fenced).when(F.col("o") % 4 == 1, said('{"verdict":"V', "$v", '"} and {"verdict":"no"}')).when(F.col("o") % 4 == 2, said("verdict: V", "$v", "\nreason: none {")).otherwise("nothing")
    out = S.parsed(rows.select(said("o", "$o").alias("file"), text.alias("text")), lambda t: [(run_logs.first_object(t),)], "found string")
    return out.select("file", F.get_json_object("found", "$.verdict").alias("verdict"))


@register("response_header_ids", oracle("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'r-' || o_custkey END AS request_id FROM orders"))
def response_header_ids(spark, sf):
    rows = select(spark, sf, "SELECT o_orderkey AS id, o_custkey AS c FROM orders")
    text = F.concat(F.lit("HTTP/2 200\r\ncontent-type: x-request-id: no\r\n"), F.when(F.col("id") % 3 > 0, said("X-Request-ID:  r-", "$c", "\r\n")).otherwise(""), F.lit("\r\n{}"))
    return rows.select("id", R.header_id(text).alias("request_id"))


_ARTIFACTS = (
    "SELECT concat('run', o_custkey) AS run, concat(CASE o_orderkey % 8 WHEN 0 THEN 'final_report.json' WHEN 1 THEN 'coverage_run_report.json' WHEN 2 THEN concat('logs/', o_orderkey, '/terminal.txt') WHEN 3 THEN 'line_hits.txt'"
    " WHEN 4 THEN 'trace.info' WHEN 5 THEN 'source_index.json' WHEN 6 THEN concat('node_modules/', o_orderkey, '.js') ELSE 'Input.json' END) AS path FROM orders"
)


@register("run_artifacts", oracle(f"SELECT kind, count(*) AS n FROM (SELECT CASE WHEN path = 'final_report.json' THEN 'final_report' WHEN path = 'coverage_run_report.json' THEN 'coverage_report' WHEN starts_with(path, 'logs/') THEN 'log' WHEN path = 'line_hits.txt' THEN 'line_hits' WHEN path = 'trace.info' THEN 'lcov' WHEN path = 'source_index.json' THEN 'source_index' WHEN path = 'Input.json' THEN 'path_flow' ELSE 'other' END AS kind FROM ({_ARTIFACTS})) GROUP BY kind"))
def run_artifacts(spark, sf):
    return select(spark, sf, _ARTIFACTS).groupBy(artifact_kind(F.col("path")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@register("run_listing", oracle(f"SELECT run, count(*) AS files FROM ({_ARTIFACTS}) GROUP BY run HAVING bool_or(path IN ('final_report.json', 'coverage_run_report.json'))"))
def run_listing(spark, sf):
    return S.runs(select(spark, sf, _ARTIFACTS).withColumnRenamed("path", "name"))


@register(
    "run_tree",
    oracle(
        "SELECT run, path, is_folder, sum(n)::BIGINT AS files, path = 'node_modules' AS collapsed FROM (SELECT run, path, false AS is_folder, 0 AS n FROM a WHERE NOT starts_with(path, 'node_modules/')"
        " UNION ALL SELECT run, split_part(path, '/', 1), true, 1 FROM a WHERE contains(path, '/') UNION ALL SELECT run, 'logs/' || split_part(path, '/', 2), true, 1 FROM a WHERE starts_with(path, 'logs/')) GROUP BY run, path, is_folder",
        f"a AS ({_ARTIFACTS})",
    ),
)
def run_tree(spark, sf):
    return S.tree(select(spark, sf, _ARTIFACTS))
