"""The impact query and what is derived from its paths: constraints, gates, prerequisites, payloads, verdicts.

Frames: functions (symbol, name, file, is_endpoint, http_method, http_path), calls (caller, callee,
guard_type, guard_condition, match_arm, type_param), implements (concrete, abstract, impl_type,
trait_name, trait_args, method).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import target_sets as B
from tidemark.operators.graph import _union, enclosing, infeasible, numbered
from tidemark.storage import bucketed, discard, written

CONNECTOR_TRAIT = "ConnectorIntegration"
GUARDS = "array<struct<at_hop:string,guard_type:string,condition:string>>"
# The words that a toggle's name loses, and the methods that change a setting.
TOGGLE_PREFIXES, TOGGLE_SUFFIXES = ("is_", "enable_", "enabled_"), ("_enabled", "_enable")
CHANGING = ("POST", "PUT", "PATCH")
BATCH = 15
#: Calls times blocks of targets that are searched together at most: what bounds the rows of a level.
TOGETHER = 1 << 25


def variants(arm: Column) -> Column:
    """Lower-case names of the variants that a match arm lists (those with a path before them)."""
    listed = F.filter(F.split(F.lower(F.trim(arm)), r"[|,]"), lambda v: F.contains(v, F.lit("::")))
    return F.transform(listed, lambda v: F.substring_index(F.trim(v), "::", -1))


SPEC = "struct<impl_type:string,trait:string,args:array<string>,method:string>"


def spec_text(spec: Column) -> Column:
    """A specialisation's stable name: trait|type|arg,arg|method, or the bare type where the trait is unknown; null without any."""
    args = F.coalesce(F.array_join(spec["args"], ","), F.lit(""))
    full = F.concat_ws("|", spec["trait"], spec["impl_type"], args, F.coalesce(spec["method"], F.lit("")))
    return F.when((spec["trait"] != "") & (spec["impl_type"] != ""), full).otherwise(spec["impl_type"])


def _arrivals(calls: DataFrame, abstract: DataFrame, of: Callable[[str, str], DataFrame]) -> DataFrame:
    """Who calls what, under the number of every key by which a search looks callers up: key, caller and the call.

    A key is a function's symbol, or #Trait#method for the abstract methods of that name together
    (abstract: callee, to), where of several calls by one caller the first counts.
    """
    guard, param, arm = (F.when(F.col(c) != "", F.col(c)) for c in ("guard_type", "type_param", "match_arm"))
    names_of = variants(arm)
    listed = (guard == "match") & F.contains(F.lower(F.trim(arm)), F.lit("connector::")) & (F.size(names_of) > 0)
    what = ["guard_type", "guard_condition", "arms", "type_param"]
    rows = calls.select("caller", "callee", guard.alias("guard_type"), F.when(F.col("guard_condition") != "", F.col("guard_condition")).alias("guard_condition"), F.when(listed, names_of).alias("arms"), param.alias("type_param"))
    # both keys of a callee come with one join, so the calls move once
    keys = of("callee", "key").join(abstract.join(of("to", "to_key"), "to").select("callee", "to_key"), "callee", "left")
    rows = written(rows.join(keys, "callee").select("key", "to_key", F.when(F.col("to_key").isNotNull(), F.col("callee")).alias("callee"), "caller", *what), "arrivals")
    first = F.min_by(F.struct(*what), F.struct("callee", F.coalesce("type_param", F.lit("")).alias("o1"), F.coalesce("guard_type", F.lit("")).alias("o2")))
    bridged = rows.where("to_key IS NOT NULL").groupBy("to_key", "caller").agg(first.alias("e")).select(F.col("to_key").alias("key"), "caller", "e.*")
    return rows.select("key", "caller", *what).unionByName(bridged)


def _plain(spec: Column) -> Column:
    """A specialisation with no arguments rather than an empty list of them, so that equal ones look alike."""
    args = F.when(F.size(spec["args"]) > 0, spec["args"])
    whole = F.struct(spec["impl_type"].alias("impl_type"), spec["trait"].alias("trait"), args.alias("args"), spec["method"].alias("method"))
    return F.when(spec.isNotNull(), whole.cast(SPEC))


def _nodes(functions: DataFrame, implements: DataFrame, connectors: DataFrame) -> DataFrame:
    """cur, node: what a function is to a path that comes to it.

    node has its name, the key of the callers of what it implements, its specialisation, whether
    both are from implements (by_row; of several rows that of the least abstract symbol) or from its
    three-part name, and whether its type is a connector.
    """
    spec = F.struct(
        F.col("impl_type").alias("impl_type"), F.col("trait_name").alias("trait"), F.col("trait_args").alias("args"), F.col("method").alias("method")
    ).cast(SPEC)
    by_row = implements.groupBy(F.col("concrete").alias("cur")).agg(F.min_by(F.struct(F.col("abstract").alias("key"), _plain(spec).alias("spec")), "abstract").alias("row"))
    parts = F.split("name", "#")
    part = lambda k: F.get(parts, F.lit(k))
    own = F.struct(part(0).alias("impl_type"), part(1).alias("trait"), F.lit(None).cast("array<string>").alias("args"), part(2).alias("method")).cast(SPEC)
    by_name = F.when(F.size(parts) == 3, F.struct(F.concat_ws("#", F.lit(""), part(1), part(2)).alias("key"), own.alias("spec")))
    rows = functions.select(F.col("symbol").alias("cur"), "name").join(by_row, "cur", "full").withColumn("by_row", F.col("row").isNotNull())
    rows = rows.withColumn("n", F.when(F.col("by_row"), F.col("row")).otherwise(by_name)).withColumn("connector", F.col("n.spec.impl_type"))
    rows = rows.join(connectors.withColumn("is_connector", F.lit(True)), "connector", "left")
    return rows.select("cur", F.struct("name", F.col("n.key").alias("key"), F.col("n.spec").alias("spec"), "by_row", F.coalesce("is_connector", F.lit(False)).alias("is_connector")).alias("node"))


def _spec_id(spec: Column) -> Column:
    """What tells specialisations apart: type|trait|arguments|method, empty without any."""
    part = lambda c: F.coalesce(c, F.lit(""))
    return F.when(spec.isNull(), "").otherwise(F.concat_ws("|", part(spec["impl_type"]), part(spec["trait"]), part(F.array_join(spec["args"], ",")), part(spec["method"])))


def _numbered_specs(*of: DataFrame) -> DataFrame:
    """key (_spec_key), sp, spec: the specialisations in of (spec) and none, with a number in sp that sorts as _spec_id does.

    sp is what a search needs to know of one: no, given (whether there is one), type (if any), arg (the first argument unless it is a placeholder).
    """
    spec = F.col("spec")
    rows = _union([x.select("spec") for x in of]).withColumn("key", _spec_key(spec)).where("key <> ''").groupBy("key").agg(F.first("spec").alias("spec"))
    none = of[0].sparkSession.range(1).select(F.lit("").alias("key"), F.lit(None).cast(SPEC).alias("spec"))
    rows = rows.select("key", "spec").unionByName(none).orderBy(_spec_id(spec), "key").withColumn("no", F.monotonically_increasing_id())
    arg = F.get(spec["args"], F.lit(0))
    sp = F.struct("no", spec.isNotNull().alias("given"), F.when(spec["impl_type"] != "", spec["impl_type"]).alias("type"), F.when(F.length(arg) > 2, arg).alias("arg"))
    return written(rows.select("key", sp.alias("sp"), "spec"), "impact-specs")


def _spec_key(spec: Column) -> Column:
    """A text that only equal specialisations share, empty without any."""
    return F.coalesce(F.to_json(spec), F.lit(""))


def _locked(sp: Column, node: Column) -> Column:
    """What a path's specialisation is at a function: a row's locks a path without any, that of a three-part name each."""
    return F.when(node["sp"].isNull() | (node["by_row"] & sp["given"]), sp).otherwise(node["sp"])


def _goals_by_spec(specs: DataFrame, plain: DataFrame) -> DataFrame:
    """no, goal, goals: the specialisations that a path with that of no may ever have, and how many they are.

    Without any, all; else its own and those of three-part names, unless of a connector of another type.
    """
    sp, named = F.col("sp"), plain.where("NOT node.by_row AND node.sp IS NOT NULL").select("node.sp", "node.is_connector").distinct()
    named = named.select(F.col("sp.no").alias("goal"), F.col("sp.type").alias("goal_type"), "is_connector")
    locks = specs.where("sp.given").crossJoin(named).where(~F.coalesce(F.col("is_connector") & (F.col("goal_type") != sp["type"]), F.lit(False))).select("sp.no", "goal")
    own = specs.select("sp.no", F.col("sp.no").alias("goal"))
    any_ = specs.where("NOT sp.given").select("sp.no").crossJoin(specs.select(F.col("sp.no").alias("goal")))
    once = _union([locks, own, any_]).distinct()
    twice = once.withColumnRenamed("goal", "mid").join(once.withColumnRenamed("no", "mid"), "mid").select("no", "goal").distinct()
    return written(twice.withColumn("goals", F.count("goal").over(Window.partitionBy("no"))), "impact-goals")


def _finished(reached: list[DataFrame], goals: DataFrame, last: int) -> DataFrame:
    """no, sets: the targets that have come to each of the last functions before endpoints with every specialisation that no may lead to."""
    each = B.united(_union([x.select("cur", F.col("sp.no").alias("goal"), "block", *B.BITS) for x in reached]), ["cur", "goal"])
    whole = B.common(each, ["goal"], F.count("cur").alias("functions")).where(F.col("functions") == last).drop("functions")
    done = B.common(goals.join(whole, "goal"), ["no"], F.count("goal").alias("found"), F.first("goals").alias("goals"))
    return written(B._filled(done.where("found = goals").drop("found", "goals")), "impact-finished")


def _looked_up(state: DataFrame, *more: str) -> DataFrame:
    """state (cur, sp, node, sets, more) by the keys under which its callers are: key, sp as locked there, via, via_no."""
    sp, node = F.col("sp"), F.col("node")
    left = node["is_connector"] & (node["sp"]["type"] != sp["type"])
    at = state.where(~F.coalesce(left, F.lit(False)))
    keys = F.array_distinct(F.array_compact(F.array("cur", node["key"])))
    return at.select(F.explode(keys).alias("key"), _locked(sp, node).alias("sp"), F.col("cur").alias("via"), sp["no"].alias("via_no"), *more, "block", *B.BITS)


def _moved(at: DataFrame, edges: DataFrame) -> DataFrame:
    """at (key, sp, sets, more) one call up: cur, sp, node of the callers, the call's guard and type parameter, more."""
    sp, more = F.col("sp"), [c for c in at.columns if c not in ("key", "sp")]
    step = at.join(edges, "key")
    other_param = (F.col("type_param") != "_") & (F.col("type_param") != sp["arg"])
    step = step.where(~F.coalesce(other_param, F.lit(False)))
    step = step.withColumn("sp", F.when(~sp["given"] & F.col("type_param").isNotNull(), F.col("param_sp")).otherwise(sp))
    other_arm = ~F.array_contains("arms", F.lower(sp["type"]))
    step = step.where(~F.coalesce(other_arm, F.lit(False)) & ~F.coalesce(F.col("own") != sp["type"], F.lit(False)))
    return step.select(F.col("caller").alias("cur"), "sp", F.col("caller_node").alias("node"), "guard_type", "guard_condition", "type_param", *more)


def _parents(levels: list[DataFrame], hits: DataFrame, deepest: int, edges: DataFrame) -> list[DataFrame]:
    """For each level but the first cur, no, via, via_no, guard_type, guard_condition, sets: from where targets came first to what their hits came through.

    From the deepest level down, so that only those are looked at that a hit came through. A
    target is in one set only of those of a function and specialisation.
    """
    parents, need = [], None
    order = ["coalesce(type_param, '')", "coalesce(guard_type, '')", "via", "via_no", "coalesce(guard_condition, '')"]
    for depth in range(deepest - 1, 0, -1):
        through = hits.where(F.col("depth") == depth + 1)
        through = _union([x.selectExpr("via AS cur", "via_no AS no", "block", *B.BITS) for x in ([through] if need is None else [through, need])])
        some = edges.join(through.selectExpr("cur AS caller").distinct(), "caller", "left_semi")
        # under one key the first by via is first for each of the key's callers
        at = B.firsts(_looked_up(levels[depth - 1]), ["key", "sp"], ["via", "via_no"])
        came = B.within(_moved(at, some).withColumn("no", F.col("sp.no")), B.united(through, ["cur", "no"]), ["cur", "no"])
        first = B.firsts(came, ["cur", "no"], order)
        need = written(first.select("cur", "no", "via", "via_no", "guard_type", "guard_condition", "block", *B.BITS), "impact-parents")
        parents.insert(0, need)
    return parents


def _told(hits: DataFrame, parents: list[DataFrame], names: DataFrame, specs: DataFrame, numbers: DataFrame) -> DataFrame:
    """target, endpoint, chain, guards, depth, spec of the hits of each level, one row for each target in their sets.

    From the deepest level down, what has come to a function of a level goes on to the one it was
    reached from, so chains are put together for endpoints alone.
    """
    step = F.struct("symbol", "name", "guard_type", "guard_condition")
    by_no, paths = specs.select(F.col("sp.no").alias("no"), "spec"), None
    for depth in range(len(parents) + 1, 0, -1):
        found = hits.where(F.col("depth") == depth).join(by_no, "no").join(names, "cur").select("depth", "spec", F.array(step).alias("path"), "via", "via_no", "block", *B.BITS)
        found = B.members(found)
        if paths is not None:
            on = B.members(parents[depth - 1].join(names, "cur").select(
                F.col("cur").alias("at"), F.col("no").alias("at_no"), F.col("via").alias("next"), F.col("via_no").alias("next_no"), step.alias("s"), "block", *B.BITS))
            on = on.withColumnsRenamed({"at": "via", "at_no": "via_no"})
            further = paths.join(on, ["n", "via", "via_no"])
            found = found.unionByName(further.select("depth", "spec", F.array_append("path", F.col("s")).alias("path"), F.col("next").alias("via"), F.col("next_no").alias("via_no"), "n"))
        paths = found
    rows = paths.join(numbers, "n").join(names.select(F.col("symbol").alias("target"), F.col("name").alias("target_name")), "target")
    hop = lambda s, k: F.concat_ws(" → ", s["name"], F.coalesce(F.get("path", k + 1)["name"], F.col("target_name")))
    guard = lambda s, k: F.struct(hop(s, k).alias("at_hop"), s["guard_type"].alias("guard_type"), F.coalesce(s["guard_condition"], F.lit("")).alias("condition"))
    guards = F.reverse(F.filter(F.transform("path", guard), lambda g: g["guard_type"].isNotNull()))
    chain = F.array_append(F.transform("path", lambda s: s["symbol"]), F.col("target"))
    return rows.select("target", F.get(chain, F.lit(0)).alias("endpoint"), chain.alias("chain"), guards.cast(GUARDS).alias("guards"), "depth", "spec")


def impact(
    functions: DataFrame,
    calls: DataFrame,
    implements: DataFrame,
    targets: DataFrame,
    max_depth: int = 8,
    step_a: DataFrame | None = None,
    op_of: DataFrame | None = None,
) -> DataFrame:
    """Constrained reverse reachability: endpoint, target, chain (endpoint first), guards (target first), depth, impl_type, spec, infeasible.

    targets (symbol, and a column seed with the specialisation to start from, if any) do not
    depend on each other. A path carries a specialisation: type, trait, its arguments, method.

    A function that implements an abstract method is also reached by that one's callers: by
    implements, else by its own three-part name. Either locks a path that has no specialisation
    yet (a three-part name also one that has), for its direct callers as well; if the path is locked
    to another type and the function's own is a known connector, the function is left altogether.
    Calls are left out whose type parameter contradicts the first trait argument, whose match arm
    lists other connectors only, and whose caller is another connector's. A type parameter locks
    a path that has no specialisation.

    A function is gone on from once for each specialisation: of the arrivals of the earliest level
    the first by type parameter, guard, the function and the specialisation it comes from, and the
    guard's condition. Endpoints end a path and may be reached by many.
    With step_a (target, type), endpoints whose path is locked to a type that isn't listed for its
    target go (targets without any row are not judged); with op_of (handler, op) also those whose
    handler starts another operation than the connector that the path is locked to.

    Targets are searched at once, TOGETHER at most by what a level may come to: a level has, for each function and
    specialisation, the sets of targets that come to it there first (see target_sets; numbers sort by what targets start
    with, so sets of one specialisation lie together). Chains and guards are found afterwards, for what leads to endpoints.
    Each level is written; only emptiness tests, counts and a depth reach the driver.
    """
    spark = functions.sparkSession
    connectors = implements.where(F.col("trait_name") == CONNECTOR_TRAIT).select(F.col("impl_type").alias("connector")).where("connector <> ''").distinct()
    seed = F.col("seed").cast(SPEC) if "seed" in targets.columns else F.lit(None).cast(SPEC)
    starts = targets.select(F.col("symbol").alias("target"), _plain(seed).alias("spec")).distinct()
    nodes = written(_nodes(functions, implements, connectors), "nodes")
    # callers are looked up by what a path can come to: functions, what they implement, targets
    ids = numbered(_union([nodes.select(F.explode(F.array_compact(F.array("cur", "node.key"))).alias("symbol")), starts.select(F.col("target").alias("symbol"))]))
    of = lambda symbol, name: ids.select(F.col("symbol").alias(symbol), F.col("id").alias(name))
    abstract = functions.where(F.size(F.split("name", "#")) == 2).select(F.col("symbol").alias("callee"), F.concat(F.lit("#"), "name").alias("to"))
    arrivals = _arrivals(calls, abstract, of)
    param = F.struct(F.col("type_param").alias("impl_type"), *[F.lit(None).cast(t).alias(c) for c, t in (("trait", "string"), ("args", "array<string>"), ("method", "string"))])
    params = written(arrivals.where("type_param IS NOT NULL").select("type_param").distinct(), "impact-params").withColumn("spec", param.cast(SPEC))
    specs = _numbered_specs(nodes.select("node.spec"), params, starts)
    by_key = specs.select("key", "sp")

    # what is known of a function, by numbers; a call brings all of its caller, so a level is one join
    plain = nodes.select("cur", F.col("node.key").alias("to"), _spec_key(F.col("node.spec")).alias("key"), F.col("node.spec").isNotNull().alias("has"), "node.by_row", "node.is_connector")
    plain = plain.join(of("cur", "id"), "cur").join(of("to", "to_id"), "to", "left").join(by_key, "key")
    node = F.struct(F.col("to_id").alias("key"), F.when(F.col("has"), F.col("sp")).alias("sp"), "by_row", "is_connector")
    plain = written(plain.select(F.col("cur").alias("symbol"), "id", node.alias("node")), "nodes")
    # the caller's own type, where its name is Type#Trait#method and the type is a connector
    own = F.when(F.size(F.split("name", "#")) == 3, F.split_part("name", F.lit("#"), F.lit(1)))
    known = functions.select("symbol", "is_endpoint", own.alias("connector")).join(connectors.withColumn("own", F.col("connector")), "connector", "left")
    known = known.join(plain, "symbol").select(F.col("symbol").alias("caller"), "is_endpoint", "own", F.col("id").alias("up"), F.col("node").alias("caller_node"))
    of_param = written(params.withColumn("key", _spec_key(F.col("spec"))).join(by_key, "key").select("type_param", F.col("sp").alias("param_sp")), "impact-params")
    edges = arrivals.join(known, "caller").join(of_param, "type_param", "left")
    edges = edges.select("key", F.col("up").alias("caller"), "caller_node", "is_endpoint", "guard_type", "guard_condition", "arms", "type_param", "param_sp", "own")
    # in buckets: calls are joined by key level by level, and stay where they are
    edges = bucketed(edges, "edges", "key")
    ends = written(edges.where("is_endpoint").drop("is_endpoint"), "impact-ends")
    inner = edges.where("NOT is_endpoint").drop("is_endpoint")
    before = written(plain.select("id", F.explode(F.array_compact(F.array("id", "node.key"))).alias("key")).join(ends.select("key"), "key", "left_semi").select(F.col("id").alias("caller")).distinct(), "impact-before")
    to_last, last = written(inner.join(before, "caller", "left_semi"), "impact-last"), before.count()
    goals = _goals_by_spec(specs, plain)
    names = written(ids.join(functions.select("symbol", "name"), "symbol", "left").select(F.col("id").alias("cur"), "symbol", F.coalesce("name", "symbol").alias("name")), "impact-names")

    starts = starts.withColumn("key", _spec_key(F.col("spec"))).join(by_key, "key").join(of("target", "cur"), "target")
    starts = starts.join(plain.select(F.col("id").alias("cur"), "node"), "cur", "left").select("target", "cur", "sp", "node")
    numbers = starts.groupBy("target").agg(F.min(_locked(F.col("sp"), F.col("node"))["no"]).alias("first"))
    numbers = B.numbered_targets(numbers, "first", "target").select("target", "n")

    def searched(numbers: DataFrame) -> DataFrame:
        state = written(B.sets(starts.join(numbers, "target"), ["cur", "sp", "node"]), "impact-level")
        started = B.united(state.select("cur", F.col("sp.no").alias("no"), "block", *B.BITS), ["cur", "no"])
        levels, reached = [state], [state.join(before.withColumnRenamed("caller", "cur"), "cur", "left_semi")]
        for _ in range(max_depth - 1):
            at = _looked_up(state)
            further = written(B.united(_moved(at, to_last).select("cur", "sp", "node", "block", *B.BITS), ["cur", "sp", "node"]), "impact-reached")
            reached.append(further)
            # who has come to all that a specialisation can lead to needs not go on with it
            at = B.without(at.withColumn("no", F.col("sp.no")), _finished(reached, goals, last), ["no"])
            moved = _moved(B.united(at, ["key", "sp"]), inner).select("cur", "sp", "node", "block", *B.BITS)  # those that share callers once
            state = written(B.new(moved.unionByName(further), _union(levels), ["cur", "sp", "node"]), "impact-level")
            if state.isEmpty():
                break
            levels.append(state)
        came = _union([x.join(before.withColumnRenamed("caller", "cur"), "cur", "left_semi").withColumn("at", F.lit(k)) for k, x in enumerate(levels, 1)])
        arrived = _moved(_looked_up(came, "at"), ends).select(F.col("at").alias("depth"), "cur", F.col("sp.no").alias("no"), "via", "via_no", "guard_type", "guard_condition", "block", *B.BITS)
        hits = written(B.without(arrived, started, ["cur", "no"]), "impact-hits")
        deepest = hits.agg(F.max("depth")).first()[0] or 1
        found = written(_told(hits, _parents(levels, hits, deepest, inner), names, specs, numbers), "impact-found")
        for x in levels:
            discard(x)
        return found

    block = B.block_of(F.col("n"))
    blocks = [b for b, in numbers.select(block).distinct().orderBy(block).collect()]
    some = max(1, TOGETHER // max(1, edges.count()))
    out = _union([searched(numbers.where(block.between(blocks[k], blocks[min(k + some, len(blocks)) - 1]))) for k in range(0, len(blocks), some)] or [searched(numbers)])
    out = out.withColumn("impl_type", F.col("spec.impl_type"))
    if step_a is not None:
        found = step_a.groupBy("target").agg(F.collect_set("type").alias("types"))
        out = out.join(found, "target", "left").where("impl_type IS NULL OR types IS NULL OR array_contains(types, impl_type)")
        if op_of is not None:
            ops = op_of.groupBy(F.col("handler").alias("endpoint")).agg(F.min("op").alias("op"))
            out = out.join(ops, "endpoint", "left").join(connectors.withColumnRenamed("connector", "impl_type").withColumn("known", F.lit(True)), "impl_type", "left")
            out = out.where("types IS NULL OR impl_type IS NULL OR known IS NULL OR op IS NULL OR op = impl_type")
    return out.select("target", "endpoint", "chain", "guards", "depth", "impl_type", spec_text(F.col("spec")).alias("spec"), infeasible(F.col("guards")).alias("infeasible"))


def seeds(functions: DataFrame, places: DataFrame) -> DataFrame:
    """places (file, line) with the function that starts there or last before it and, as seed, what it implements.

    functions needs impl_type, impl_trait, impl_trait_args (comma-joined) and impl_method beside
    symbol, file and def_line. A place before the first function of its file has no row.
    """
    bare = lambda c: F.ltrim(c, F.lit("/"))
    defs = functions.withColumn("file", bare(F.col("file")))
    found = enclosing(defs.select("file", "def_line", "symbol"), places.select(bare(F.col("file")).alias("file"), "line")).where("def_symbol IS NOT NULL")
    args = F.filter(F.transform(F.split("impl_trait_args", ","), lambda x: F.trim(x)), lambda x: x != "")
    spec = F.struct(F.col("impl_type").alias("impl_type"), F.col("impl_trait").alias("trait"), args.alias("args"), F.col("impl_method").alias("method")).cast(SPEC)
    known = (F.col("impl_type") != "") | (F.col("impl_trait") != "")
    own = defs.select("symbol", F.when(known, spec).alias("seed"))
    return found.withColumnRenamed("def_symbol", "symbol").join(own, "symbol").select("file", "line", "symbol", "seed")


def compatible(a: Column, b: Column) -> Column:
    """Whether two specialisations may be the same one: no part that both have differs."""
    clash = F.lit(False)
    for part in ("impl_type", "trait", "method"):
        clash = clash | F.coalesce((a[part] != "") & (b[part] != "") & (a[part] != b[part]), F.lit(False))
    return ~(clash | F.coalesce((F.size(a["args"]) > 0) & (F.size(b["args"]) > 0) & (a["args"] != b["args"]), F.lit(False)))


def merged(a: Column, b: Column) -> Column:
    """Two compatible specialisations as one: each part of the first, else of the second."""
    args = F.when(F.size(a["args"]) > 0, a["args"]).otherwise(b["args"])
    parts = [F.coalesce(F.when(a[p] != "", a[p]), b[p]).alias(p) for p in ("impl_type", "trait")]
    return F.struct(*parts, args.alias("args"), F.coalesce(F.when(a["method"] != "", a["method"]), b["method"]).alias("method")).cast(SPEC)


def spec_json(spec: Column, is_connector: Column) -> Column:
    """A specialisation as JSON: its type under connector if it is one, under impl_type else; nulls stay out."""
    name = spec["impl_type"]
    return F.to_json(F.struct(
        F.when(is_connector, name).alias("connector"), F.when(~is_connector, name).alias("impl_type"), spec["trait"].alias("trait"),
        F.coalesce(spec["args"], F.array().cast("array<string>")).alias("trait_args"), spec["method"].alias("method"), spec_text(spec).alias("specialization_key"),
    ))


# Functions inside the gate that decides whether a connector is called, and where the walk for an operation ends.
GATED = ("get_connector_data_with_routing_decision", "call_connector_service", "complete_connector_service", "call_multiple_connectors_service")
WALK_ENDS = ("payments_operation_core", "get_connector_data_with_routing_decision")


def named(found: DataFrame, functions: DataFrame) -> DataFrame:
    """Endpoints of impact() as they are reported: http_method, http_path, handler, chain by names beside their other columns."""
    names = functions.select("symbol", "name")
    steps = found.withColumn("__id", F.struct("target", "endpoint", "chain", "spec")).select("__id", F.posexplode("chain").alias("pos", "symbol")).distinct()
    steps = steps.join(names, "symbol", "left").groupBy("__id").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("name", "symbol").alias("n")))).alias("steps"))
    ends = functions.select(F.col("symbol").alias("endpoint"), F.col("name").alias("handler"), "http_method", "http_path")
    rows = found.withColumn("__id", F.struct("target", "endpoint", "chain", "spec")).join(steps, "__id").join(ends, "endpoint")
    return rows.withColumn("chain", F.transform("steps", lambda x: x["n"])).drop("steps", "__id")


def dedup_endpoints(found: DataFrame) -> DataFrame:
    """named() endpoints, of those of one target, method, path, handler and specialisation the one with the shortest chain (the least of equal ones)."""
    keys = ["target", "http_method", "http_path", "handler", "spec"]
    rest = [c for c in found.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(F.size("chain").alias("n"), F.array_join("chain", ">").alias("c")))
    return found.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def gate(endpoints: DataFrame, gates: DataFrame, op_of: DataFrame) -> DataFrame:
    """endpoints (handler, chain by names, ...) through the gate that some chains pass, with connector_gate: null or 'conditional'.

    op_of (function, op, exact) says which operation a function starts, exact if it hands it on in a
    call rather than mentions it. The handler's operation counts, else that of the first function on
    the chain that has one, before the walk's ends. An exact operation that gates (op, gate) doesn't
    know takes the gate of _default; any other unknown one is conditional. What is always false goes.
    """
    default = gates.where("op = '_default'").agg(F.first("gate").alias("default_gate"))
    rows = endpoints.withColumn("__id", F.struct("handler", "chain"))
    ops = op_of.groupBy("function").agg(F.max_by(F.struct("op", "exact"), F.struct("exact", "op")).alias("o")).select("function", "o.*")
    passes = F.arrays_overlap("chain", F.array(*[F.lit(g) for g in GATED]))
    ends = F.array_position(F.transform("chain", lambda c: c.isin(*WALK_ENDS) & (c != F.get("chain", F.lit(0)))), True)
    walked = F.when(ends > 0, F.slice("chain", F.lit(1), (ends - 1).cast("int"))).otherwise(F.col("chain"))
    steps = rows.where(passes).select("__id", F.posexplode(F.concat(F.array("handler"), F.slice(walked, 2, F.greatest(F.size(walked) - 1, F.lit(0))))).alias("pos", "function")).distinct()
    found = steps.join(ops, "function").groupBy("__id").agg(F.min_by(F.struct("op", "exact"), "pos").alias("o")).select("__id", "o.*")
    rows = rows.join(found, "__id", "left").join(gates.where("op <> '_default'"), "op", "left").crossJoin(F.broadcast(default))
    value = F.when(~passes, None).when(F.col("exact"), F.coalesce("gate", "default_gate", F.lit("conditional"))).otherwise(F.coalesce("gate", F.lit("conditional")))
    rows = rows.withColumn("connector_gate", value)
    out = rows.where("connector_gate IS NULL OR connector_gate <> 'always_false'")
    return out.select(*endpoints.columns, F.when(F.col("connector_gate") == "conditional", "conditional").alias("connector_gate"))


def prune_false_edges(endpoints: DataFrame, bodies: DataFrame, tolerance: int = 3) -> DataFrame:
    """Endpoints (handler, chain, ...) whose handler's text does call the second step of the chain by its bare name.

    bodies (handler, body). Where endpoints say where the handler stands (file, def_line), bodies do
    so too, and one that starts at most tolerance lines off counts; those without a known text stay.
    """
    bare = F.element_at(F.split(F.get("chain", F.lit(1)), "#"), -1)
    if "def_line" in endpoints.columns:
        at = bodies.select("file", F.col("def_line").alias("body_line"), "body").withColumn("cell", F.explode(F.sequence(F.col("body_line") - tolerance, F.col("body_line") + tolerance)))
        near = endpoints.select("file", "def_line").distinct().join(at, (endpoints["file"] == at["file"]) & (endpoints["def_line"] == at["cell"])).drop(at["file"])
        near = near.groupBy("file", "def_line").agg(F.min_by("body", F.struct(F.abs(F.col("body_line") - F.col("def_line")).alias("d"), "body_line")).alias("body"))
        rows = endpoints.join(near, ["file", "def_line"], "left")
    else:
        rows = endpoints.join(bodies.select("handler", "body"), "handler", "left")
    return rows.where(F.col("body").isNull() | F.contains("body", bare) | (F.size("chain") < 2)).drop("body")


def chain_nodes(endpoints: DataFrame) -> DataFrame:
    """endpoints with nodes: function, role, condition_type, condition of every step of their chain by names; the last guard of a hop counts."""
    n = F.size("chain")

    def node(name: Column, i: Column) -> Column:
        role = F.when(i == n - 1, "target").when(i == n - 2, "direct_caller").when(i == 0, "handler").otherwise("intermediate")
        hop = F.concat_ws(" → ", name, F.get("chain", i + 1))
        own = F.element_at(F.filter("guards", lambda g: g["at_hop"] == hop), -1)
        has = F.exists("guards", lambda g: g["at_hop"] == hop)
        kind = F.when(i == n - 1, None).when(has, own["guard_type"]).otherwise("unconditional")
        text = F.when(i == n - 1, None).when(has, own["condition"]).otherwise("unconditional")
        return F.struct(name.alias("function"), role.alias("role"), kind.alias("condition_type"), text.alias("condition"))

    return endpoints.withColumn("nodes", F.transform("chain", node))


def build_flows(endpoints: DataFrame) -> DataFrame:
    """flow_id, description, endpoints, chain, nodes, spec, conditions_high, conditions_missing of dedup_endpoints() rows.

    Endpoints of one flow share all of the chain but its start, and the guards. Flows are numbered
    within their target in the order of their first endpoint by path, method and specialisation,
    and described by their first two conditions, else their specialisation, else their chain.
    """
    rows = chain_nodes(endpoints)
    order = F.struct("http_path", "http_method", F.coalesce("spec", F.lit("")).alias("s"), "handler", F.array_join("chain", ">").alias("c"))
    tail = F.slice("chain", 2, F.greatest(F.size("chain") - 1, F.lit(0)))
    ends = F.array_sort(F.collect_list(F.struct(order.alias("o"), "http_method", "http_path", "handler")))
    grouped = rows.groupBy("target", tail.alias("tail"), "guards").agg(
        F.min(order).alias("first"), F.min_by(F.struct("chain", "nodes", "spec"), order).alias("r"), ends.alias("ends")
    )
    key = lambda e: F.concat_ws(" ", e["http_method"], e["http_path"])
    once = F.filter("ends", lambda e, i: (i == 0) | ~F.array_contains(F.transform(F.slice("ends", F.lit(1), i), key), key(e)))
    said = F.filter("r.nodes", lambda x: x["condition"].isNotNull() & ~F.contains(x["condition"], F.lit("unconditional")))
    short = F.transform(F.slice(said, 1, 2), lambda x: F.left(F.trim(F.replace(x["condition"], F.lit("if "), F.lit(""))), F.lit(80)))
    description = (
        F.when(F.size(said) > 0, F.array_join(short, " + ")).when(F.col("r.spec").isNotNull(), F.concat(F.lit("via "), "r.spec"))
        .otherwise(F.concat(F.lit("path through "), F.array_join(F.slice("r.chain", 1, 3), " → ")))
    )
    number = F.row_number().over(Window.partitionBy("target").orderBy("first"))
    return grouped.select(
        "target", number.cast("long").alias("flow_id"), description.alias("description"),
        F.transform(once, lambda e: F.struct(e["http_method"].alias("method"), e["http_path"].alias("path"), e["handler"].alias("handler"))).alias("endpoints"),
        F.col("r.chain").alias("chain"), F.col("r.nodes").alias("nodes"), F.col("r.spec").alias("spec"),
        F.size(said).alias("conditions_high"), F.size(F.filter("r.nodes", lambda x: x["condition"].isNull() & (x["role"] != "target"))).alias("conditions_missing"),
    )


def reachability(endpoints: DataFrame, flows: DataFrame, connectors: DataFrame) -> DataFrame:
    """target, endpoint, handler, chain, guard_conditions, impact_status, spec of each of dedup_endpoints(), by the first flow with its method and path.

    connectors (connector): a flow whose specialisation is one of them makes the status say so.
    """
    of = flows.select("target", "flow_id", "nodes", F.col("spec").alias("flow_spec"), F.explode("endpoints").alias("e"))
    first = of.groupBy("target", F.col("e.method").alias("http_method"), F.col("e.path").alias("http_path")).agg(F.min_by(F.struct("nodes", "flow_spec"), "flow_id").alias("f"))
    rows = endpoints.join(first, ["target", "http_method", "http_path"], "left")
    kind = F.when(F.size(F.split("f.flow_spec", "[|]")) > 1, F.split_part("f.flow_spec", F.lit("|"), F.lit(2))).otherwise(F.col("f.flow_spec"))
    rows = rows.withColumn("connector", kind).join(connectors.withColumn("known", F.lit(True)), "connector", "left")
    said = F.filter("f.nodes", lambda x: x["condition"].isNotNull() & (x["condition"] != "") & ~F.contains(F.lower(x["condition"]), F.lit("unconditional")))
    said = F.transform(said, lambda x: F.struct(x["function"].alias("function"), x["condition_type"].alias("type"), F.left(x["condition"], F.lit(200)).alias("condition")))
    rows = rows.withColumn("guard_conditions", F.coalesce(said, F.array().cast("array<struct<function:string,type:string,condition:string>>")))
    status = (
        F.when(F.size("guard_conditions") == 0, "Impacted").when(F.col("known"), F.concat(F.lit("Conditionally Impacted (via "), "connector", F.lit(")")))
        .otherwise("Conditionally Impacted")
    )
    return rows.select(
        "target", F.concat_ws(" ", "http_method", "http_path").alias("endpoint"), "handler", "chain", "guard_conditions", status.alias("impact_status"),
        F.when(F.col("known"), F.col("f.flow_spec")).alias("spec"), "infeasible",
    )


def toggle_name(field: Column) -> Column:
    """A setting's name without the words that say it is a switch."""
    out = F.regexp_replace(field, "^(" + "|".join(TOGGLE_PREFIXES) + ")", "")
    return F.regexp_replace(out, "(" + "|".join(TOGGLE_SUFFIXES) + ")$", "")


def profile_fields(conditions: DataFrame) -> DataFrame:
    """flow_id, field, condition of every profile.field or config.field that a condition (flow_id, condition) reads."""
    found = F.regexp_extract_all("condition", F.lit(r"(?:profile|config|account)\.(\w+)"), F.lit(1))
    return conditions.select("flow_id", "condition", F.explode(F.array_distinct(found)).alias("field"))


def _path_words(path: Column) -> Column:
    """Every run of whole words that a path holds, words joined by _ as in a field's name."""
    words = F.filter(F.split(F.replace(path, F.lit("-"), F.lit("_")), "[^A-Za-z0-9]"), lambda w: w != "")
    runs = F.flatten(F.transform(words, lambda w, i: F.transform(F.sequence(i, F.size(words) - 1), lambda j: F.array_join(F.slice(words, i + 1, j - i + 1), "_"))))
    return F.array_distinct(F.when(F.size(words) > 0, runs).otherwise(F.array().cast("array<string>")))


def toggle_endpoints(fields: DataFrame, functions: DataFrame) -> DataFrame:
    """fields (flow_id, field) with the endpoint that switches them: a changing one under profile or account whose path has the field's name.

    A name is looked up among the runs of whole words of the paths, so this is a join on equal
    words; the least symbol of several endpoints.
    """
    ends = functions.where("is_endpoint").select("http_method", "http_path", "symbol")
    ends = ends.where(F.col("http_method").isin(*CHANGING) & (F.contains("http_path", F.lit("profile")) | F.contains("http_path", F.lit("account"))))
    ends = ends.withColumn("name", F.explode(_path_words(F.col("http_path"))))
    rows = fields.withColumn("name", toggle_name(F.col("field"))).join(ends, "name")
    best = F.min_by(F.concat_ws(" ", "http_method", "http_path"), "symbol")
    return rows.groupBy("flow_id", "field").agg(best.alias("config_endpoint"))


# What the structures are called that an update of a profile is made of.
UPDATE_STRUCTS = ("Update", "Create", "Request")


def prerequisites(flows: DataFrame, conditions: DataFrame, functions: DataFrame, struct_fields: DataFrame) -> DataFrame:
    """flow_id, rule, kind, field, value, reason, confidence: what must hold before a flow can be entered.

    conditions (flow_id, condition) are those along the flow's chain, but for its target's;
    struct_fields (struct, field) the fields of structures; flows (flow_id, spec, impl_type, trait).
    Rule 1: a profile's field that an endpoint switches. Rule 2: else one of an update's structure,
    by the profile endpoint with the longest path. Rule 3: the type a flow is specialised to.
    Rule 4: fields of the request. Rules 1 and 2 name each endpoint once per flow, the least field's.
    """
    read = profile_fields(conditions)
    text = read.groupBy("flow_id", "field").agg(F.left(F.max("condition"), F.lit(100)).alias("reason"))
    toggles = toggle_endpoints(text, functions)
    wanted = F.lit(False)
    for word in UPDATE_STRUCTS:
        wanted = wanted | F.contains("struct", F.lit(word))
    updates = struct_fields.where(wanted).select("field").distinct()
    ends = functions.where(F.col("is_endpoint") & F.col("http_method").isin(*CHANGING) & F.contains("http_path", F.lit("profile")))
    longest = ends.agg(F.min_by(F.concat_ws(" ", "http_method", "http_path"), F.struct((-F.length("http_path")).alias("n"), "symbol")).alias("config_endpoint"))
    rest = text.join(toggles, ["flow_id", "field"], "left_anti").join(updates, "field", "left_semi").crossJoin(F.broadcast(longest)).where("config_endpoint IS NOT NULL")
    both = text.join(toggles, ["flow_id", "field"]).select("flow_id", "field", "reason", "config_endpoint", F.lit(1).alias("rule"))
    both = both.unionByName(rest.select("flow_id", "field", "reason", "config_endpoint", F.lit(2).alias("rule")))
    once = both.groupBy("flow_id", "config_endpoint").agg(F.min(F.struct("rule", "field", "reason")).alias("r"))
    profile = once.select("flow_id", "r.rule", F.lit("profile_config").alias("kind"), "r.field", F.col("config_endpoint").alias("value"), "r.reason", F.lit("high").alias("confidence"))
    typed = flows.where("impl_type <> ''").select(
        "flow_id", F.lit(3).alias("rule"), F.lit("concrete_type").alias("kind"), F.when(F.col("trait") == CONNECTOR_TRAIT, "connector").otherwise("operation_type").alias("field"),
        F.col("impl_type").alias("value"), F.concat(F.lit("path only entered via "), F.coalesce("spec", "impl_type")).alias("reason"), F.lit("high").alias("confidence"),
    )
    asked = request_fields(conditions).select(
        "flow_id", F.lit(4).alias("rule"), F.lit("request_field").alias("kind"), "field", F.col("required").cast("string").alias("value"), "reason", "confidence"
    )
    return profile.unionByName(typed).unionByName(asked)


def request_fields(conditions: DataFrame) -> DataFrame:
    """flow_id, field, required, reason, confidence of the request fields that conditions read; each field once per flow."""
    found = F.regexp_extract_all("condition", F.lit(r"(?:request|req|payload)\.(?:get_)?(\w{3,})"), F.lit(1))
    rows = conditions.select("flow_id", "condition", F.explode(F.array_distinct(found)).alias("field"))
    required = F.contains("condition", F.lit(".is_some()")) | F.contains("condition", F.concat(F.lit("get_"), F.col("field")))
    rows = rows.select("flow_id", "field", required.alias("required"), F.left("condition", F.lit(120)).alias("reason"))
    first = rows.groupBy("flow_id", "field").agg(F.min_by(F.struct("required", "reason"), "reason").alias("r")).select("flow_id", "field", "r.*")
    return first.withColumn("confidence", F.when(F.col("required"), "high").otherwise("low"))


def trigger_body(path: Column, conditions: Column) -> Column:
    """JSON of the request body that triggers a flow: what its conditions (an array of texts) ask for, then the path's defaults."""
    has = lambda w: F.exists(conditions, lambda c: F.contains(c, F.lit(w)))
    is_payment, is_refund, is_payout = (F.contains(path, F.lit(p)) for p in ("/payments", "/refunds", "/payouts"))
    customer = F.exists(conditions, lambda c: F.contains(c, F.lit("customer_id")) & (F.contains(c, F.lit("is_some")) | F.contains(c, F.lit("get_customer"))))
    amount = F.when(has("amount"), 1000).when(is_payment | is_payout, 1000).when(is_refund, 500)
    return F.to_json(F.struct(
        F.when(customer, "cust_test_001").alias("customer_id"), amount.alias("amount"), F.when(has("amount") | is_payment | is_payout, "USD").alias("currency"),
        F.when(has("mandate"), "off_session").alias("setup_future_usage"), F.when(is_payment, "card").alias("payment_method"),
        F.when(is_refund, "pay_test_001").alias("payment_id"), F.when(is_refund, "customer_request").alias("reason"), F.when(is_payout & ~is_payment & ~is_refund, "bank").alias("payout_type"),
    ))


def batches(findings: DataFrame, size: int = BATCH) -> DataFrame:
    """findings (file, line, function, ord) numbered into batches of size within each function."""
    order = Window.partitionBy("file", "line", "function").orderBy("ord")
    return findings.withColumn("batch", F.ceil(F.row_number().over(order) / size))


def apply_verdicts(endpoints: DataFrame, verdicts: DataFrame) -> DataFrame:
    """endpoints (method, path, ...) without the false positives; without a verdict an endpoint counts as true."""
    rows = endpoints.join(verdicts.select("method", "path", "verdict", "reason"), ["method", "path"], "left")
    return rows.withColumn("verdict", F.coalesce("verdict", F.lit("TRUE_POSITIVE"))).where("verdict <> 'FALSE_POSITIVE'")


def ask(rows: DataFrame, prompt: Column, answer: Callable[[str], str] | None = None) -> DataFrame:
    """rows with prompt and answer: answer is called on the executors for each prompt; without it answers are null."""
    out = rows.withColumn("prompt", prompt)
    if answer is None:
        return out.withColumn("answer", F.lit(None).cast("string"))

    @F.pandas_udf("string")
    def asked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(answer)

    return out.withColumn("answer", asked("prompt"))


def prune_flows(flows: DataFrame, endpoints: DataFrame) -> DataFrame:
    """flows (flow_id, endpoints array<struct<method,path>>) with the endpoints that are left; flows without any go."""
    rows = flows.select("flow_id", F.posexplode("endpoints").alias("pos", "e")).select("flow_id", "pos", "e.method", "e.path")
    left = rows.join(endpoints.select("method", "path").distinct(), ["method", "path"], "left_semi")
    kept = left.groupBy("flow_id").agg(F.array_sort(F.collect_list(F.struct("pos", "method", "path"))).alias("k"))
    kept = kept.select("flow_id", F.transform("k", lambda x: F.struct(x["method"].alias("method"), x["path"].alias("path"))).alias("endpoints"))
    return flows.drop("endpoints").join(kept, "flow_id")


# Names of data structures that a handler mentions beside its operation.
DATA_SUFFIXES = ("Data", "Response", "Request", "Types")


def best_by_name(functions: DataFrame) -> DataFrame:
    """One function per name: one outside of tests and generated descriptions if there is one, the least symbol."""
    aside = F.contains("file", F.lit("test")) | F.contains("file", F.lit("openapi"))
    best = F.min(F.struct(F.coalesce(aside, F.lit(False)).alias("aside"), "symbol", "file"))
    return functions.where("name <> ''").groupBy("name").agg(best.alias("b")).select("name", "b.symbol", "b.file")


def relevant_files(targets: DataFrame, calls: DataFrame, functions: DataFrame) -> DataFrame:
    """target, file of the implementations' methods that call a target directly; of all its callers where no implementation does."""
    callers = calls.join(targets.select(F.col("symbol").alias("target")), F.col("callee") == F.col("target")).select("target", "caller")
    rows = callers.join(functions.select(F.col("symbol").alias("caller"), "name", "file"), "caller").where("file IS NOT NULL")
    rows = rows.withColumn("concrete", F.size(F.split("name", "#")) >= 3)
    any_concrete = rows.groupBy("target").agg(F.bool_or("concrete").alias("some"))
    return rows.join(any_concrete, "target").where("concrete OR NOT some").select("target", "file").distinct()


def calling_types(impls: DataFrame, body_calls: DataFrame, callee: str, known: DataFrame | None = None) -> DataFrame:
    """Types (file, type, line of method) whose implementation calls callee, among known (type) if given."""
    calls = body_calls.where(F.col("callee") == callee).select("file", F.col("function_line").alias("line"))
    out = impls.join(calls, ["file", "line"], "left_semi").select("type").distinct()
    return out if known is None else out.join(known.select("type"), "type", "left_semi")


def operation_of(bodies: DataFrame, module: str = "payments", prefixes: tuple[str, ...] = ("Payment", "Complete")) -> DataFrame:
    """bodies (handler, body) with op: the first operation of module the body names; the name of a data structure only if there is no other."""
    found = F.regexp_extract_all("body", F.lit(rf"{module}::(?:operations::)?(\w+)"), F.lit(1))
    named = F.filter(found, lambda n: n.rlike("^(" + "|".join(prefixes) + ")"))
    clean = F.filter(named, lambda n: ~n.rlike("(" + "|".join(DATA_SUFFIXES) + ")$"))
    return bodies.select("handler", F.coalesce(F.get(clean, F.lit(0)), F.get(named, F.lit(0))).alias("op"))


def document(changed: str, endpoints: DataFrame, flows: DataFrame, matrix: DataFrame) -> DataFrame:
    """section, ord, value: the impact of a changed function as JSON, one value per row.

    First the head with the counts, then the endpoints, flows and matrix rows. However many there
    are, no row holds more than one of them; joined in order they are one document.
    """
    head = endpoints.agg(F.count(F.lit(1)).alias("endpoint_count")).crossJoin(flows.agg(F.count(F.lit(1)).alias("flow_count")))
    out = head.select(F.lit("head").alias("section"), F.to_json(F.struct(F.lit(changed).alias("changed_function"), "endpoint_count", "flow_count")).alias("value"))
    for name, rows in (("endpoints", endpoints), ("flows", flows), ("reachability_matrix", matrix)):
        out = out.unionByName(rows.select(F.lit(name).alias("section"), F.to_json(F.struct("*")).alias("value")))
    return out
