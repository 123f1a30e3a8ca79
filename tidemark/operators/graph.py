"""Call-graph construction and reachability as DataFrame plans.

Frames: functions (symbol, name, file, def_line, is_endpoint, ...), calls (caller, callee, ...).
Loops over levels keep the frontier small and write it once a level, so a lost executor costs one
level at most; nothing of the frontier reaches the driver but whether it is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import target_sets as B
from tidemark.storage import discard, written


def display_name(symbol: Column) -> Column:
    """The last path segment of a symbol without the marks #().  at its end."""
    return F.rtrim(F.substring_index(symbol, "/", -1), F.lit("#()."))


def short_name(name: Column) -> Column:
    """A type's or function's bare name: no generics, last :: segment."""
    return F.rtrim(F.substring_index(F.regexp_replace(name, "<.*$", ""), "::", -1), F.lit(">()"))


def spec_key(trait: Column, type_: Column, args: Column, method: Column) -> Column:
    """trait|type|arg,arg|method, or the bare type when the trait is unknown."""
    joined = F.coalesce(F.array_join(args, ","), F.lit(""))
    return F.when(trait.isNotNull(), F.concat_ws("|", trait, type_, joined, method)).otherwise(type_)


def enclosing(defs: DataFrame, refs: DataFrame) -> DataFrame:
    """refs (file, line, ...) with def_symbol: the last definition at or before the line in its file.

    An as-of join: one sort of both sides within each file instead of a range join.
    """
    cols = [c for c in refs.columns if c not in ("file", "line")]
    left = defs.select(
        "file", F.col("def_line").alias("line"), F.lit(0).alias("is_ref"), "symbol", *[F.lit(None).cast(refs.schema[c].dataType).alias(c) for c in cols]
    )
    right = refs.select("file", "line", F.lit(1).alias("is_ref"), F.lit(None).cast("string").alias("symbol"), *cols)
    upto = Window.partitionBy("file").orderBy("line", "is_ref", "symbol").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("def_symbol", F.last("symbol", ignorenulls=True).over(upto))
    return both.where("is_ref = 1").select("file", "line", *cols, "def_symbol")


def first_definitions(occurrences: DataFrame) -> DataFrame:
    """One row per symbol: its first definition by (doc_idx, occ_idx)."""
    order = Window.partitionBy("symbol").orderBy("doc_idx", "occ_idx")
    return occurrences.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def dedup_calls(sites: DataFrame) -> DataFrame:
    """One edge per (caller, callee): that of the least line, ties by guard."""
    best = F.min(F.struct("line", F.coalesce("guard_type", F.lit("")).alias("g"), F.coalesce("guard_condition", F.lit("")).alias("c"), "guard_type", "guard_condition"))
    return sites.groupBy("caller", "callee").agg(best.alias("s")).select("caller", "callee", "s.line", "s.guard_type", "s.guard_condition")


def project_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Calls whose both ends are functions of the project."""
    known = functions.select(F.col("symbol").alias("known"))
    return calls.join(known, calls["caller"] == known["known"], "left_semi").join(known, calls["callee"] == known["known"], "left_semi")


def missing_nodes(triples: DataFrame, existing: DataFrame) -> DataFrame:
    """(file, line) of implemented methods that no node stands for."""
    return triples.select("file", "line").distinct().join(existing.select("file", "line"), ["file", "line"], "left_anti")


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix: the first position where the two differ, less one."""
    n = F.least(F.length(a), F.length(b))
    differs = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, F.lit(1), i) != F.substring(b, F.lit(1), i))
    return F.when(n == 0, F.lit(0)).otherwise(F.coalesce(F.get(differs, F.lit(0)) - 1, n))


def best_abstract(concrete: DataFrame, candidates: DataFrame) -> DataFrame:
    """concrete (id, name, file) with the candidate (cand, name, cand_file) of its name whose path shares most; ties by cand."""
    scored = concrete.join(candidates, "name").withColumn("score", common_prefix(F.col("file"), F.col("cand_file")))
    best = F.max_by(F.struct("cand", "score"), F.struct("score", (-F.col("ord")).alias("o")))
    return scored.groupBy("id").agg(best.alias("b")).select("id", "b.cand", "b.score")


def unique_names(functions: DataFrame) -> DataFrame:
    """Names that exactly one function has and that hold no '#'."""
    return functions.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("symbol").alias("symbol")).where("n = 1 AND NOT contains(name, '#')")


def synthetic_edges(bodies: DataFrame, functions: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls (caller, callee_name) found in bodies, for unique names, where no edge exists yet."""
    named = unique_names(functions).select(F.col("name").alias("callee_name"), F.col("symbol").alias("callee"))
    found = bodies.join(named, "callee_name").select("caller", "callee").distinct()
    return found.join(calls.select("caller", "callee"), ["caller", "callee"], "left_anti")


def annotate_types(edges: DataFrame, notes: DataFrame) -> DataFrame:
    """edges (file, line, callee, ...) with the type parameter noted for that place, if the callee's name ends with the noted one; the last note wins."""
    hit = edges.join(notes.withColumnRenamed("callee", "suffix"), ["file", "line"]).where(F.col("callee").endswith(F.col("suffix")))
    best = hit.groupBy("file", "line", "callee").agg(F.max_by("type_param", "ord").alias("type_param"))
    return edges.join(best, ["file", "line", "callee"], "left")


def innermost_guard(points: DataFrame, spans: DataFrame, cell: int = 64) -> DataFrame:
    """points (file, line, id) with what spans (file, lo, hi, depth, kind, ...) say of the deepest that holds their line.

    Of equally deep ones the one that starts last. A containment join without a per-file cross
    product: spans are filed under every cell of lines they touch, points under theirs.
    """
    more = [c for c in spans.columns if c not in ("file", "lo", "hi", "depth")]
    filed = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor(F.col("hi") / cell))))
    own = points.withColumn("cell", F.floor(F.col("line") / cell))
    hit = own.join(filed, ["file", "cell"]).where("line BETWEEN lo AND hi")
    best = hit.groupBy("id").agg(F.max(F.struct("depth", "lo", *more)).alias("g"))
    return points.join(best, "id", "left").select("id", "file", "line", *[F.col(f"g.{c}").alias(c) for c in more], "g.depth")


def guard_distribution(calls: DataFrame) -> DataFrame:
    """guard_type, n, pct of all calls; calls without a guard are unconditional."""
    counts = calls.groupBy(F.coalesce("guard_type", F.lit("unconditional")).alias("guard_type")).agg(F.count(F.lit(1)).alias("n"))
    total = calls.agg(F.count(F.lit(1)).alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("guard_type", "n", F.round(100.0 * F.col("n") / F.col("total"), 2).alias("pct"))


def tag_endpoints(functions: DataFrame, routes: DataFrame) -> DataFrame:
    """functions (symbol, name) with method and path of the first route that names them as handler."""
    first = routes.groupBy("handler").agg(F.min_by(F.struct("method", "path"), "ord").alias("r"))
    return functions.join(first, functions["name"] == first["handler"], "left").select(
        "symbol", "name", F.col("r").isNotNull().alias("is_endpoint"), F.col("r.method").alias("http_method"), F.col("r.path").alias("http_path")
    )


def reachable(calls: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """symbol, depth: all that seeds (symbol) reach along caller -> callee, seeds at depth 0.

    Walked level by level on all executors, whatever the graph's size.
    """
    edges = written(calls.select("caller", "callee").where("caller IS NOT NULL"), "edges")  # read once a level
    frontier = written(seeds.select("symbol").distinct().withColumn("depth", F.lit(0)), "frontier")
    parts, depth = [frontier], 0
    while not frontier.isEmpty() and (max_depth is None or depth < max_depth):
        depth += 1
        step = frontier.select(F.col("symbol").alias("caller")).join(edges, "caller").select(F.col("callee").alias("symbol")).distinct()
        seen = _union(parts)
        frontier = written(step.join(seen.select("symbol"), "symbol", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        parts.append(frontier)
        if len(parts) > 8:  # keeps the union of levels short on deep graphs
            merged = written(_union(parts), "reached")
            for part in parts:
                if part is not frontier:
                    discard(part)
            parts = [merged]
    return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def dead_ends(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """Functions no endpoint reaches, without endpoints and files of tests or generated API descriptions."""
    found = reachable(calls, functions.where("is_endpoint").select("symbol"))
    left = functions.join(found.select("symbol"), "symbol", "left_anti")
    return left.where("NOT is_endpoint AND NOT contains(file, 'test') AND NOT contains(file, 'openapi')")


GUARDS = "array<struct<at_hop:string,guard_type:string,condition:string>>"


def _guarded(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """callee, caller, g (the call's guard as a list of one or none), at_end (whether the caller is an endpoint)."""
    guard = F.struct(F.concat_ws(" -> ", "caller", "callee").alias("at_hop"), F.col("guard_type").alias("guard_type"), F.col("guard_condition").alias("condition"))
    own = F.when(F.col("guard_type").isNotNull(), F.array(guard)).otherwise(F.array().cast(GUARDS))
    ends = endpoints.select(F.col("symbol").alias("caller"), F.lit(True).alias("at_end")).distinct()
    return calls.select("caller", "callee", own.cast(GUARDS).alias("g")).join(ends, "caller", "left").withColumn("at_end", F.coalesce("at_end", F.lit(False)))


def chains_up(calls: DataFrame, targets: DataFrame, endpoints: DataFrame, max_depth: int) -> DataFrame:
    """All simple caller chains from targets (symbol) up to endpoints, of at most max_depth calls.

    endpoint, target, chain (endpoint first), guards (target side first), depth. Endpoints end a
    chain. Rows grow with the number of chains, so max_depth is required.
    """
    edges = written(_guarded(calls, endpoints), "edges")
    state = targets.select(
        F.col("symbol").alias("target"), F.col("symbol").alias("cur"), F.array("symbol").alias("chain"), F.array().cast(GUARDS).alias("guards"),
    )
    hits = []
    for depth in range(1, max_depth + 1):
        step = state.join(edges, state["cur"] == edges["callee"]).where(~F.array_contains("chain", F.col("caller")))
        step = step.select("target", F.col("caller").alias("cur"), F.array_prepend("chain", F.col("caller")).alias("chain"), F.concat("guards", "g").alias("guards"), "at_end")
        step = written(step, "chains")
        hits.append(step.where("at_end").select(F.col("cur").alias("endpoint"), "target", "chain", "guards", F.lit(depth).alias("depth")))
        state = step.where("NOT at_end").drop("at_end")
        if state.isEmpty():
            break
    return _union(hits)


def numbered(symbols: DataFrame) -> DataFrame:
    """symbol, id: a number for each distinct symbol; the numbers sort as the symbols do in a chain's text (with the > that follows).

    A sort by ranges and a number within each, so no task sees all symbols.
    """
    ordered = symbols.select("symbol").distinct().orderBy(F.concat("symbol", F.lit(">")))
    return written(ordered.withColumn("id", F.monotonically_increasing_id()), "symbols")


def shortest_chains_up(calls: DataFrame, targets: DataFrame, endpoints: DataFrame, max_depth: int, down: bool | None = None) -> DataFrame:
    """endpoint, target, chain, guards, depth: one chain of each pair, the shortest, of those the least as a text.

    As chains_up() with the best kept, but breadth first, from the side (down: from the endpoints)
    that has fewer rows for each function: one for each endpoint, or one for each block of targets.
    """
    calls = written(calls.select("caller", "callee", "guard_type", "guard_condition"), "calls")
    targets, endpoints = (written(x.select("symbol").distinct(), "chain-sides") for x in (targets, endpoints))
    if down is None:
        down = endpoints.count() <= -(-targets.count() // B.BLOCK)
    return (_shortest_down if down else _shortest_up)(calls, targets, endpoints, max_depth)


def _shortest_down(calls: DataFrame, targets: DataFrame, endpoints: DataFrame, max_depth: int) -> DataFrame:
    """As shortest_chains_up(), from the endpoints down: each pair of endpoint and function is come to once, with its chain.

    Chains of a level have ranks that sort as their texts do, so the least chain to a function is
    the one of the least rank before it. Calls of functions that every endpoint has come to are
    left out once most are such.
    """
    n_ends = endpoints.count()
    ends = endpoints.select(F.col("symbol").alias("cur"), F.lit(True).alias("at_end"))
    edges, n_open = calls, None
    start = endpoints.select(F.col("symbol").alias("endpoint"), F.col("symbol").alias("cur"), F.array("symbol").alias("chain"), F.array().cast(GUARDS).alias("guards"))
    frontier = written(start.withColumn("rank", F.monotonically_increasing_id()), "chains-frontier")
    seen, levels = [frontier.select("endpoint", "cur")], []
    for depth in range(1, max_depth + 1):
        step = frontier.select("endpoint", F.col("cur").alias("caller"), "rank").join(edges, "caller")
        best = F.min(F.struct("rank", "guard_type", "guard_condition")).alias("s")
        new = step.groupBy("endpoint", F.col("callee").alias("cur")).agg(best).join(_union(seen), ["endpoint", "cur"], "left_anti")
        new = written(new.select("endpoint", "cur", "s.*"), "chains-new")
        last = frontier.select("rank", "chain", "guards", F.col("cur").alias("caller"))
        own = F.array(F.struct(F.concat_ws(" -> ", "caller", "cur").alias("at_hop"), "guard_type", F.col("guard_condition").alias("condition"))).cast(GUARDS)
        guards = F.when(F.col("guard_type").isNotNull(), F.concat(own, "guards")).otherwise(F.col("guards")).alias("guards")
        told = new.join(last, "rank").join(ends, "cur", "left")
        told = told.select("endpoint", "cur", F.array_append("chain", F.col("cur")).alias("chain"), guards, "rank", F.coalesce("at_end", F.lit(False)).alias("at_end"))
        ordered = written(told, "chains-told").orderBy("rank", F.concat("cur", F.lit(">")))
        levels.append(written(ordered.withColumn("rank", F.monotonically_increasing_id()), "chains-level").withColumn("depth", F.lit(depth)))
        frontier = levels[-1].where("NOT at_end")
        if depth == max_depth or frontier.isEmpty():
            break
        seen.append(levels[-1].select("endpoint", "cur"))
        whole = _union(seen).groupBy("cur").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= n_ends)
        called = edges.select(F.col("callee").alias("cur")).distinct()
        open_ = written(called.join(whole, "cur", "left_anti"), "chains-open")
        if n_open is None or open_.count() * 4 < n_open:
            n_open = open_.count()
            edges = written(edges.join(open_.withColumnRenamed("cur", "callee"), "callee", "left_semi"), "chains-edges")
    rows = _union(levels).join(targets.withColumnRenamed("symbol", "cur"), "cur", "left_semi")
    return rows.select("endpoint", F.col("cur").alias("target"), "chain", "guards", "depth")


def _shortest_up(calls: DataFrame, targets: DataFrame, endpoints: DataFrame, max_depth: int) -> DataFrame:
    """As shortest_chains_up(), for all targets at once.

    A level has for each function the set of targets from which it is reached there first, as bits,
    so its rows grow with the calls and not with calls times targets. Chains are put together
    afterwards, for the endpoints alone: from an endpoint down, of the functions that it calls and
    that the target came to a level before, the least.
    """
    ids = numbered(calls.select(F.explode(F.array("caller", "callee")).alias("symbol")).unionByName(targets.select("symbol")))
    of = lambda name: ids.select(F.col("symbol").alias(f"{name}_symbol"), F.col("id").alias(name))
    edges = _guarded(calls, endpoints).join(of("up"), F.col("caller") == F.col("up_symbol")).join(of("at"), F.col("callee") == F.col("at_symbol"))
    edges = written(edges.select("up", "at", F.col("at_end").cast("int").alias("at_end"), "g"), "edges")
    light = edges.select("up", F.col("at").alias("cur"), "at_end")
    ends = written(light.where("at_end = 1").select(F.col("up").alias("cur")).distinct(), "chain-ends")
    n_ends = ends.count()

    starts = B.numbered_targets(targets.select("symbol").distinct().join(ids, "symbol"))
    state = written(B.sets(starts.select(F.col("id").alias("cur"), "n"), ["cur"]).withColumn("at_end", F.lit(0)), "chains-level")
    levels, seen = [state], state.drop("at_end")
    for _ in range(max_depth):
        step = B.united(state.drop("at_end").join(light, "cur").drop("cur").withColumnRenamed("up", "cur"), ["cur"], F.max("at_end").alias("at_end"))
        levels.append(written(B.without(step, seen, ["cur"]), "chains-level"))
        before, seen = seen, written(B.united(seen.unionByName(levels[-1].drop("at_end")), ["cur"]), "chains-seen")
        if len(levels) > 2:
            discard(before)
        # targets that have come to every endpoint there is need no search any more
        done = B.common(seen.join(ends, "cur"), [], F.count(F.lit(1)).alias("n")).where(F.col("n") >= n_ends)
        state = written(B.without(levels[-1].where("at_end = 0"), written(done, "chains-done"), []), "chains-state")
        if state.isEmpty():
            break

    # from the deepest level down: what has come to a function of a level goes on to its next
    pairs, steps = None, []
    for depth in range(len(levels) - 1, 0, -1):
        own = B.members(levels[depth].where("at_end = 1").drop("at_end").withColumn("endpoint", F.col("cur")))
        own = own.select("endpoint", "n", F.lit(depth).alias("depth"), "cur")
        pairs = own if pairs is None else own.unionByName(pairs)
        next_ = pairs.join(edges.select(F.col("up").alias("cur"), "at", "g"), "cur").select("endpoint", "n", "depth", F.col("at").alias("cur"), "g")
        came = levels[depth - 1].where("at_end = 0")
        next_ = next_.withColumn("block", B.block_of(F.col("n"))).join(came, ["cur", "block"]).where(B.holds(F.col("n")))
        best = F.min(F.struct("cur", "g")).alias("best")
        steps.append(written(next_.groupBy("endpoint", "n", "depth").agg(best).select("endpoint", "n", "depth", "best.cur", "best.g"), "chain-steps"))
        steps[-1] = steps[-1].withColumn("pos", F.col("depth") - (depth - 1))
        pairs = steps[-1].select("endpoint", "n", "depth", "cur")
    first = [x.where("pos = 1").select("endpoint", "n", "depth", F.col("endpoint").alias("cur"), F.lit(None).cast(GUARDS).alias("g"), F.lit(0).alias("pos")) for x in steps]
    rows = _union([*steps, *first]).join(ids, F.col("cur") == F.col("id"))
    rows = rows.groupBy("endpoint", "n", "depth").agg(F.array_sort(F.collect_list(F.struct("pos", "symbol", "g"))).alias("x"))
    chain = F.transform("x", lambda r: r["symbol"])
    guards = F.flatten(F.reverse(F.transform(F.filter("x", lambda r: r["g"].isNotNull()), lambda r: r["g"])))
    rows = rows.select(chain.alias("chain"), guards.cast(GUARDS).alias("guards"), "depth")
    return rows.select(F.get("chain", F.lit(0)).alias("endpoint"), F.element_at("chain", -1).alias("target"), "chain", "guards", "depth")


def _without_callers(edges: DataFrame, rounds: int) -> DataFrame:
    """caller: functions that nothing calls, those that only they call, and so on for so many rounds: none lies on a cycle, and no caller of one does."""
    degree = written(edges.groupBy("callee").agg(F.count(F.lit(1)).alias("n")), "chains-degree")
    parts = [written(edges.select("caller").distinct().join(degree.select(F.col("callee").alias("caller")), "caller", "left_anti"), "chains-peeled")]
    for _ in range(rounds):
        if parts[-1].isEmpty():
            break
        less = edges.join(parts[-1], "caller").groupBy("callee").agg(F.count(F.lit(1)).alias("less"))
        degree = written(degree.join(less, "callee", "left").select("callee", (F.col("n") - F.coalesce("less", F.lit(0))).alias("n"), "less"), "chains-degree")
        parts.append(written(degree.where("n = 0 AND less > 0").select(F.col("callee").alias("caller")), "chains-peeled"))
        degree = degree.drop("less")
    return _union(parts)


_MET = ["matches", "ifs", "bad"]


def _met() -> list[Column]:
    """What the guards of a path are after one more call (m: what it matches, c: what it asks): nothing but bad once they contradict each other."""
    m, c = F.col("m"), F.col("c")
    negates = lambda a, b: (a == F.concat(F.lit("!"), b)) | (a == F.concat(F.lit("! "), b)) | (a == F.concat(F.lit("!("), b, F.lit(")")))
    clash = F.coalesce(F.array_contains("matches", m), F.lit(False)) | F.coalesce(F.exists("ifs", lambda x: negates(x, c) | negates(c, x)), F.lit(False))
    bad = F.col("bad") | clash
    none = F.array().cast("array<string>")
    grown = lambda a, x: F.when(bad, none).when(x.isNull(), F.col(a)).otherwise(F.array_sort(F.array_union(a, F.array(x)))).alias(a)
    return [grown("matches", m), grown("ifs", c), bad.alias("bad")]


def feasibility(calls: DataFrame, targets: DataFrame, endpoints: DataFrame, max_depth: int) -> DataFrame:
    """likely_infeasible, n: how many of chains_up() contradict themselves, as infeasible() says, and how many do not.

    Chains are counted and not written: those that stand at one function and have met the same
    guards go on as one row. Which functions they came through matters only on cycles, so they are
    kept apart by those until they leave what cycles lead to; from there on a row has a count for
    each number of calls. Rows grow with the calls, and with the chains inside of cycles.
    """
    ends = endpoints.select(F.col("symbol").alias("caller"), F.lit(True).alias("at_end")).distinct()
    text = F.coalesce(F.trim("guard_condition"), F.lit(""))
    m, c = F.when((F.col("guard_type") == "match") & (text != ""), text), F.when(F.col("guard_type") == "if", text)
    edges = written(calls.select("caller", "callee", m.alias("m"), c.alias("c")), "edges")
    outer = _without_callers(edges.select("caller", "callee"), max_depth)
    edges = edges.join(ends, "caller", "left").withColumn("at_end", F.coalesce("at_end", F.lit(False))).withColumnRenamed("callee", "cur")
    inner = written(edges.join(outer, "caller", "left_anti"), "chains-inner")
    outside = edges.join(outer, "caller", "left_semi")

    none = F.array().cast("array<string>")
    start = targets.select(F.col("symbol").alias("cur")).groupBy("cur").agg(F.count(F.lit(1)).alias("n"))
    state = start.select("cur", F.array("cur").alias("path"), none.alias("matches"), none.alias("ifs"), F.lit(False).alias("bad"), "n")
    hits, left = [], []
    counts = [f"n{k}" for k in range(max_depth + 1)]
    for depth in range(max_depth + 1):
        zero = F.lit(0).cast("long")
        left.append(state.select("cur", *_MET, *[(F.col("n") if k == depth else zero).alias(x) for k, x in enumerate(counts)]))
        if depth == max_depth:
            break
        step = state.join(inner, "cur").where(~F.array_contains("path", F.col("caller")))
        step = step.select(F.col("caller").alias("cur"), F.array_sort(F.array_append("path", F.col("caller"))).alias("path"), *_met(), "at_end", "n")
        step = written(step.groupBy("cur", "path", *_MET, "at_end").agg(F.sum("n").alias("n")), "chains-counted")
        hits.append(step.where("at_end").select("bad", "n"))
        state = step.where("NOT at_end").drop("at_end")
        if state.isEmpty():
            break
    # outside of cycles: all numbers of calls at once
    sums = [F.sum(x).alias(x) for x in counts]
    state = written(_union(left).groupBy("cur", *_MET).agg(*sums), "chains-counted")
    for _ in range(max_depth):
        step = state.join(outside, "cur")
        step = step.select(F.col("caller").alias("cur"), *_met(), "at_end", F.lit(0).cast("long").alias(counts[0]), *[F.col(a).alias(b) for a, b in zip(counts, counts[1:])])
        step = written(step.groupBy("cur", *_MET, "at_end").agg(*sums), "chains-counted")
        hits.append(step.where("at_end").select("bad", sum((F.col(x) for x in counts[1:]), F.lit(0)).alias("n")))
        state = step.where("NOT at_end").drop("at_end")
        if state.isEmpty():
            break
    return _union(hits).where("n > 0").groupBy(F.col("bad").alias("likely_infeasible")).agg(F.sum("n").alias("n"))


def infeasible(guards: Column) -> Column:
    """Whether a path contradicts itself: one scrutinee matched twice, or a condition and its negation."""
    trimmed = F.transform(guards, lambda g: F.struct(g["guard_type"].alias("t"), F.trim(g["condition"]).alias("c")))
    matches = F.transform(F.filter(trimmed, lambda g: (g["t"] == "match") & (g["c"] != "")), lambda g: g["c"])
    ifs = F.transform(F.filter(trimmed, lambda g: g["t"] == "if"), lambda g: g["c"])
    negated = F.exists(ifs, lambda c: F.array_contains(ifs, F.concat(F.lit("!"), c)) | F.array_contains(ifs, F.concat(F.lit("! "), c)) | F.array_contains(ifs, F.concat(F.lit("!("), c, F.lit(")"))))
    return (F.size(matches) != F.size(F.array_distinct(matches))) | negated


def chain_roles(chains: DataFrame) -> DataFrame:
    """endpoint, target, pos, symbol, role of every step of every chain."""
    steps = chains.select("endpoint", "target", F.size("chain").alias("n"), F.posexplode("chain").alias("pos", "symbol"))
    role = F.when(F.col("pos") == F.col("n") - 1, "target").when(F.col("pos") == F.col("n") - 2, "direct_caller").when(F.col("pos") == 0, "handler").otherwise("intermediate")
    return steps.select("endpoint", "target", "pos", "symbol", role.alias("role"))


def flows(chains: DataFrame) -> DataFrame:
    """Chains that share all but their endpoint, and their guards: tail (the chain without its start), guards, endpoints (sorted)."""
    rest = F.slice("chain", 2, F.greatest(F.size("chain") - 1, F.lit(0)))
    rows = chains.select(
        "endpoint", F.array_join(rest, ">").alias("tail"), F.array_join(F.transform("guards", lambda g: F.concat_ws("|", g["guard_type"], g["condition"])), ";").alias("guards")
    )
    return rows.groupBy("tail", "guards").agg(F.array_sort(F.collect_set("endpoint")).alias("endpoints"))


def resolve_symbol(functions: DataFrame, name: str) -> DataFrame:
    """Functions that a bare name means: exact and abstract matches together, else concrete ones by suffix."""
    rank = (
        F.when(F.col("name") == name, 1).when(F.col("name").endswith(f"#{name}") & (F.size(F.split("name", "#")) == 2), 1).when(F.col("name").endswith(f"#{name}"), 2)
    )
    ranked = functions.withColumn("rank", rank).where("rank IS NOT NULL")
    least = ranked.agg(F.min("rank").alias("least"))
    return ranked.join(F.broadcast(least), ranked["rank"] == least["least"]).drop("least")
