"""The call graph put together from what sources and symbol indexes say, ready for the impact query.

Frames: functions (symbol, name, file, def_line), calls (caller, callee, file, line), impls (file,
trait, trait_args, type, method, line) as the source scan gives them, and what it finds in bodies.
Every step is a join on keys (a place, a name); none looks at a whole graph at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.graph import common_prefix, innermost_guard, spec_key, tag_endpoints, unique_names
from tidemark.sources import rust
from tidemark.sources.files import parsed

# Helpers that a request is built with, by the names of the methods that link to each other.
CONNECTOR, COMMON = "ConnectorIntegration", "ConnectorCommon"
BUILDER, HELPERS, HEADERS, AUTH = "build_request", ("get_headers", "get_content_type"), "get_headers", "get_auth_header"


def triples(impls: DataFrame) -> DataFrame:
    """impls, one row per method, with the names and keys that nodes are known by, and ord: their order."""
    args = F.when(F.col("trait_args") != "", F.concat(F.lit("<"), "trait_args", F.lit(">"))).otherwise(F.lit(""))
    return impls.select(
        "file", F.col("line").cast("int").alias("def_line"), F.col("trait").alias("trait_name"), "trait_args", F.col("type").alias("type_name"), F.col("method").alias("method_name"),
        F.concat("type", F.lit("#"), "trait", args, F.lit("#"), "method").alias("concrete_name"), F.concat_ws("#", "trait", "method").alias("abstract_name"),
        spec_key(F.col("trait"), F.col("type"), F.split("trait_args", ","), F.col("method")).alias("spec_key"),
        F.concat(F.lit("synthetic://"), "file", F.lit("::"), F.col("line").cast("string")).alias("synthetic_symbol"), F.struct("file", "line", "type", "trait_args").alias("ord"),
    )


def with_missing_nodes(functions: DataFrame, triples_: DataFrame) -> DataFrame:
    """functions (symbol, name, file, def_line) and a node for each implemented method at whose place there is none."""
    there = functions.where(~F.startswith("symbol", F.lit("synthetic://"))).select("file", "def_line").distinct()
    missing = triples_.join(there, ["file", "def_line"], "left_anti").groupBy(F.col("synthetic_symbol").alias("symbol"))
    missing = missing.agg(F.min_by(F.struct(F.col("concrete_name").alias("name"), "file", "def_line"), "ord").alias("n")).select("symbol", "n.*")
    known = missing.join(functions.select("symbol"), "symbol", "left_anti")
    return functions.select("symbol", "name", "file", "def_line").unionByName(known)


def annotate_nodes(functions: DataFrame, triples_: DataFrame) -> DataFrame:
    """functions with impl_trait, impl_type, impl_trait_args, impl_method, impl_spec_key of what stands at their place; the last of several."""
    own = F.struct(
        F.col("trait_name").alias("impl_trait"), F.col("type_name").alias("impl_type"), F.col("trait_args").alias("impl_trait_args"),
        F.col("method_name").alias("impl_method"), F.col("spec_key").alias("impl_spec_key"),
    )
    last = triples_.groupBy("file", "def_line").agg(F.max_by(own, "ord").alias("i"))
    stale = [c for c in functions.columns if c.startswith("impl_")]
    return functions.drop(*stale).join(last, ["file", "def_line"], "left").select(*[c for c in functions.columns if c not in stale], "i.*")


def implements(functions: DataFrame, triples_: DataFrame) -> DataFrame:
    """concrete, abstract, impl_type, trait_name, trait_args (array), method, spec_key of every implemented method.

    The concrete node stands at the method's place; the abstract one has the trait's name for it,
    and of several the one whose file has the longest path in common (the least symbol of equal ones).
    """
    places = functions.select(F.col("symbol").alias("concrete"), "file", "def_line")
    named = functions.select(F.col("symbol").alias("abstract"), F.col("name").alias("abstract_name"), F.coalesce("file", F.lit("")).alias("abstract_file"))
    wanted = triples_.select("abstract_name", "file").distinct().join(named, "abstract_name")
    score = common_prefix(F.col("file"), F.col("abstract_file"))
    best = wanted.groupBy("abstract_name", "file").agg(F.min_by("abstract", F.struct((-score).alias("s"), "abstract")).alias("abstract"))
    rows = triples_.join(best, ["abstract_name", "file"]).join(places, ["file", "def_line"])
    args = F.filter(F.split("trait_args", ","), lambda x: x != "")
    own = F.struct(F.col("type_name").alias("impl_type"), "trait_name", args.alias("trait_args"), F.col("method_name").alias("method"), "spec_key")
    return rows.groupBy("concrete", "abstract").agg(F.max_by(own, "ord").alias("i")).select("concrete", "abstract", "i.*")


def trait_map(functions: DataFrame) -> DataFrame:
    """trait, types (sorted) of what annotated functions implement."""
    known = functions.where("impl_trait IS NOT NULL AND impl_type IS NOT NULL")
    return known.groupBy(F.col("impl_trait").alias("trait")).agg(F.array_sort(F.collect_set("impl_type")).alias("types"))


def concrete_types(functions: DataFrame) -> DataFrame:
    """type: every type that implements any trait."""
    return functions.where("impl_trait IS NOT NULL AND impl_type IS NOT NULL").select(F.col("impl_type").alias("type")).distinct()


def resolve_aliases(calls: DataFrame, aliases: DataFrame) -> DataFrame:
    """calls (..., type_param) with the type that an alias (file, alias, type, ord) stands for; the last of several aliases of a name."""
    last = aliases.groupBy(F.col("alias").alias("type_param")).agg(F.max_by("type", F.struct("file", "ord")).alias("stands_for"))
    return calls.join(last, "type_param", "left").withColumn("type_param", F.coalesce("stands_for", "type_param")).select(*calls.columns)


def merge_calls(generic: DataFrame, bound: DataFrame) -> DataFrame:
    """generic calls (file, callee, type_param, line), and of the bound ones the first of each line that generic has nothing on; with ord."""
    first = bound.join(generic.select("file", "line").distinct(), ["file", "line"], "left_anti")
    first = first.groupBy("file", "line").agg(F.min(F.struct("callee", "type_param")).alias("c")).select("file", "c.callee", "c.type_param", "line")
    both = generic.select("file", "callee", "type_param", "line").unionByName(first)
    return both.withColumn("ord", F.struct("line", "type_param"))


def annotate_calls(calls: DataFrame, functions: DataFrame, notes: DataFrame) -> DataFrame:
    """calls (caller, callee, file, line, ...) with the type_param noted (file, line, callee, type_param, ord) for their place.

    A note fits a call whose callee's name ends with the noted one; the last note counts.
    """
    names = functions.select(F.col("symbol").alias("callee"), F.col("name").alias("callee_name"))
    hit = calls.select("caller", "callee", "file", "line").join(names, "callee").join(notes.withColumnRenamed("callee", "said"), ["file", "line"])
    hit = hit.where(F.endswith("callee_name", F.col("said"))).groupBy("caller", "callee").agg(F.max_by("type_param", "ord").alias("type_param"))
    return calls.drop("type_param").join(hit, ["caller", "callee"], "left")


def synthetic_calls(functions: DataFrame, triples_: DataFrame, bodies: DataFrame, calls: DataFrame) -> DataFrame:
    """calls (caller, callee, file, line), and those found in the bodies (file, function_line, callee, line) of implemented methods; synthetic says which.

    Only callees whose bare name one function alone has; a call that is known already stays as it is.
    """
    own = bodies.join(triples_.select("file", F.col("def_line").alias("function_line")).distinct(), ["file", "function_line"], "left_semi")
    callers = functions.select(F.col("symbol").alias("caller"), "file", F.col("def_line").alias("function_line"))
    named = unique_names(functions).select(F.col("name").alias("name"), F.col("symbol").alias("callee_symbol"))
    found = own.join(named, own["callee"] == named["name"]).drop("callee").join(callers, ["file", "function_line"])
    found = found.groupBy("caller", F.col("callee_symbol").alias("callee")).agg(F.min(F.struct("file", "line")).alias("at"))
    new = found.join(calls.select("caller", "callee"), ["caller", "callee"], "left_anti").select("caller", "callee", "at.file", "at.line", F.lit(True).alias("synthetic"))
    return calls.select("caller", "callee", "file", "line", F.lit(False).alias("synthetic")).unionByName(new)


def guard_calls(calls: DataFrame, spans: DataFrame) -> DataFrame:
    """calls (caller, callee, file, line, ...) with guard_type, guard_condition, match_arm of the innermost condition around their place.

    What calls said of guards before is gone; a place straight inside a function or closure has none.
    """
    bare = calls.drop("guard_type", "guard_condition", "match_arm")
    places = bare.select("file", "line").distinct().withColumn("id", F.struct("file", "line"))
    found = innermost_guard(places, spans.select("file", "lo", "hi", "depth", "kind", "condition", "arm")).where("kind IS NOT NULL AND kind <> 'stop'")
    found = found.select("file", "line", F.col("kind").alias("guard_type"), F.col("condition").alias("guard_condition"), F.col("arm").alias("match_arm"))
    return bare.join(found, ["file", "line"], "left").select(*bare.columns, "guard_type", "guard_condition", "match_arm")


def repair_edges(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """caller, callee of edges that calls (caller, callee) lack.

    A connector's request builder that is linked to a helper in another connector's file is linked
    to its own connector's headers; every connector's headers are linked to its own authorisation.
    """
    named = functions.select("symbol", "name", "file")
    builders = named.where(F.col("name").rlike(f"#{CONNECTOR}<.*>#{BUILDER}$")).select(F.col("symbol").alias("caller"), F.split_part("name", F.lit("#"), F.lit(1)).alias("own"))
    helpers = named.where(F.col("name").isin(*HELPERS) & F.col("file").isNotNull()).select(F.col("symbol").alias("callee"), F.col("file").alias("helper_file"))
    wrong = calls.select("caller", "callee").join(builders, "caller").join(helpers, "callee").where(~F.contains("helper_file", F.lower("own")))
    headers = named.where(F.endswith("name", F.lit(f"#{CONNECTOR}#{HEADERS}"))).select(F.col("symbol").alias("headers"), F.split_part("name", F.lit("#"), F.lit(1)).alias("own"), "name")
    headers = headers.where(F.col("name") == F.concat("own", F.lit(f"#{CONNECTOR}#{HEADERS}"))).drop("name")
    auth = named.where(F.endswith("name", F.lit(f"#{COMMON}#{AUTH}"))).select(F.col("symbol").alias("auth"), F.split_part("name", F.lit("#"), F.lit(1)).alias("own"), "name")
    auth = auth.where(F.col("name") == F.concat("own", F.lit(f"#{COMMON}#{AUTH}"))).drop("name")
    added = wrong.join(headers, "own").select("caller", F.col("headers").alias("callee")).union(headers.join(auth, "own").select("headers", "auth")).distinct()
    return added.join(calls.select("caller", "callee"), ["caller", "callee"], "left_anti")


def summary(functions: DataFrame, calls: DataFrame, implements_: DataFrame) -> DataFrame:
    """measure, n: annotated functions, implementations, calls with a type, synthetic calls."""
    count = lambda rows, name: rows.agg(F.lit(name).alias("measure"), F.count(F.lit(1)).alias("n"))
    out = count(functions.where("impl_trait IS NOT NULL"), "functions_with_trait").unionByName(count(implements_, "implements"))
    return out.unionByName(count(calls.where("type_param IS NOT NULL"), "calls_with_type")).unionByName(count(calls.where("synthetic"), "synthetic_calls"))


def top_traits(functions: DataFrame, n: int = 10) -> DataFrame:
    """trait, impls of the n traits with the most implementing functions."""
    known = functions.where("impl_trait IS NOT NULL").groupBy(F.col("impl_trait").alias("trait")).agg(F.count(F.lit(1)).alias("impls"))
    return known.orderBy(F.desc("impls"), "trait").limit(n)


def assemble(files: DataFrame, functions: DataFrame, calls: DataFrame) -> dict[str, DataFrame]:
    """functions, calls, implements, guard_span and routes of a source tree (file, text), given an index's functions and calls (caller, callee, file, line)."""
    scan = lambda parser, columns: parsed(files, parser, columns)
    rows = triples(scan(rust.impls, "trait string, trait_args string, type string, method string, line int"))
    routes = scan(rust.routes, "method string, path string, handler string, ord int").withColumn("ord", F.struct("file", "ord"))
    spans = scan(rust.guard_spans, "lo int, hi int, depth int, kind string, condition string, arm string")
    nodes = annotate_nodes(with_missing_nodes(functions, rows), rows)
    tagged = tag_endpoints(nodes, routes).drop("name")
    nodes = nodes.join(tagged, "symbol")
    aliases = scan(rust.aliases, "alias string, type string, ord int")
    bound = resolve_aliases(scan(rust.bound_calls, "callee string, type_param string, line int"), aliases)
    notes = merge_calls(scan(rust.generic_calls, "callee string, type_param string, line int"), bound)
    edges = synthetic_calls(nodes, rows, scan(rust.body_calls, "function string, function_line int, callee string, line int"), calls)
    fixed = repair_edges(nodes, edges).select("caller", "callee", F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"), F.lit(True).alias("synthetic"))
    edges = guard_calls(annotate_calls(edges.unionByName(fixed), nodes, notes), spans)
    return {"functions": nodes, "calls": edges, "implements": implements(nodes, rows), "guard_span": spans, "routes": routes}
