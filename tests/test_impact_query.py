"""The impact query, rule by rule on small graphs and against a plain search that follows the rules one by one."""

import random
import re

import pytest

from tidemark.operators import impact as I
from tidemark.operators.impact import CONNECTOR_TRAIT

FUNCTIONS = "symbol string, name string, is_endpoint boolean"
CALLS = "caller string, callee string, guard_type string, guard_condition string, match_arm string, type_param string"
IMPLEMENTS = "concrete string, abstract string, impl_type string, trait_name string, trait_args array<string>, method string"
SEED = "struct<impl_type:string,trait:string,args:array<string>,method:string>"


def clean(spec):
    return None if spec is None else (spec[0], spec[1], tuple(spec[2] or ()), spec[3])


def spec_id(spec):
    return "" if spec is None else "|".join((spec[0] or "", spec[1] or "", ",".join(spec[2]), spec[3] or ""))


def plain_search(functions, calls, implements, target, max_depth, seed=None, step_a=(), ops=None):
    """One target's endpoints: (endpoint, chain, guards, depth, type)."""
    name = {s: n for s, n, _ in functions}
    ends = {s for s, _, e in functions if e}
    connectors = {i[2] for i in implements if i[3] == CONNECTOR_TRAIT and i[2]}
    rows = {}
    for i in sorted(implements, key=lambda i: i[1], reverse=True):
        rows[i[0]] = (i[1], clean(i[2:]))
    callers = {}
    for c in calls:
        if c[0] in name:
            callers.setdefault(c[1], []).append(c)
    visited, hits = {(target, seed)}, []
    level = [(target, (target,), (), seed)]
    for depth in range(1, max_depth + 1):
        arrivals = []
        for cur, chain, guards, spec in level:
            came = spec
            parts = name.get(cur, "").split("#")
            found = list(callers.get(cur, ()))
            held = spec[0] if spec else None
            if cur in rows:
                abstract, own = rows[cur]
                if held and own[0] and held != own[0] and own[0] in connectors:
                    continue
                spec = spec if spec is not None else own
                found += callers.get(abstract, ())
            elif len(parts) == 3:
                if held and held != parts[0] and parts[0] in connectors:
                    continue
                spec, once = (parts[0], parts[1], (), parts[2]), {}
                for other in sorted(s for s, n in name.items() if n == f"{parts[1]}#{parts[2]}"):
                    for c in sorted(callers.get(other, ()), key=lambda c: (c[5] or "", c[2] or "")):
                        once.setdefault(c[0], c)
                found += once.values()
            for caller, _, guard, condition, arm, param in dict.fromkeys(found):
                if param and param != "_" and spec and spec[2] and len(spec[2][0]) > 2 and param != spec[2][0]:
                    continue
                now = (param, None, (), None) if param and spec is None else spec
                held = now[0] if now else None
                if arm and guard == "match" and held and arm.lower().strip() not in ("_", "..") and "connector::" in arm.lower():
                    listed = {v.strip().split("::")[-1] for v in re.split("[|,]", arm.lower().strip()) if "::" in v}
                    if listed and held.lower() not in listed:
                        continue
                own = name[caller].split("#")
                if len(own) == 3 and held and own[0] != held and own[0] in connectors:
                    continue
                if (caller, now) in visited:
                    continue
                told = guards if not guard else (*guards, (f"{name[caller]} → {name.get(cur, cur)}", guard, condition or ""))
                arrivals.append(((param or "", guard or "", cur + ">", spec_id(came), condition or ""), caller, (caller, *chain), told, now))
        level, taken = [], set()
        for _, caller, chain, guards, spec in sorted(arrivals, key=lambda a: a[0]):
            if caller in ends:
                kind = spec[0] if spec else None
                if kind is not None and step_a:
                    if kind not in step_a or (kind in connectors and (ops or {}).get(caller) not in (None, kind)):
                        continue
                hits.append((caller, chain, guards, depth, kind))
            elif (caller, spec) not in taken:
                taken.add((caller, spec))
                level.append((caller, chain, guards, spec))
        visited |= taken
        if not level:
            break
    return sorted(hits, key=str)


def engine(spark, functions, calls, implements, targets, max_depth=8, step_a=None, ops=None):
    rows = [(t, None) if isinstance(t, str) else t for t in targets]
    out = I.impact(
        spark.createDataFrame(functions, FUNCTIONS), spark.createDataFrame(calls, CALLS), spark.createDataFrame(implements, IMPLEMENTS),
        spark.createDataFrame(rows, f"symbol string, seed {SEED}"), max_depth,
        None if step_a is None else spark.createDataFrame(step_a, "target string, type string"), None if ops is None else spark.createDataFrame(ops, "handler string, op string"),
    )
    found = {t: [] for t, _ in rows}
    for r in out.collect():
        found[r.target].append((r.endpoint, tuple(r.chain), tuple((g.at_hop, g.guard_type, g.condition) for g in r.guards), r.depth, r.impl_type))
    return {t: sorted(x, key=str) for t, x in found.items()}


def call(caller, callee, guard=None, condition=None, arm=None, param=None):
    return (caller, callee, guard, condition, arm, param)


# a.pay and b.pay implement t.pay; each of h1 to h3 is an endpoint
FN = [("t", "CI#pay", False), ("a", "A#CI#pay", False), ("b", "B#CI#pay", False), ("x", "leaf", False), ("core", "core", False), ("w", "Wrap#Other#pay", False),
      ("h1", "h1", True), ("h2", "h2", True), ("h3", "h3", True)]
IM = [("a", "t", "A", CONNECTOR_TRAIT, ["Authorize", "X"], "pay"), ("b", "t", "B", CONNECTOR_TRAIT, ["Capture", "X"], "pay")]

CASES = {
    "endpoints end a path, a target that is one is not reported": (FN, [call("h1", "x"), call("h2", "h1"), call("h1", "h1")], [], ["x", "h1"], {}),
    "depth ends the search": (FN, [call("core", "x"), call("h1", "core"), call("h2", "x")], [], ["x"], {"max_depth": 1}),
    "callers of the abstract method, locked by the row": (FN, [call("a", "x"), call("core", "t"), call("h1", "core")], IM, ["x"], {}),
    "direct callers of an implementation take its lock": (FN, [call("b", "x"), call("h1", "b")], IM, ["x"], {}),
    "another connector's method ends the path, direct callers too": (FN, [call("a", "x"), call("core", "a"), call("b", "core"), call("h1", "b"), call("h2", "t")], IM, ["x"], {}),
    "a locked path keeps its lock at a method that is no connector's": (
        [*FN, ("i", "Enum#Dyn#pay", False)], [call("a", "x"), call("i", "a"), call("h1", "i")], [*IM, ("i", "t", "Enum", "Dyn", [], "pay")], ["x"], {}),
    "a three-part name without a row bridges and takes the lock over": (
        [*FN, ("o", "Other#pay", False), ("o2", "Other#pay", False)], [call("w", "x"), call("h1", "o"), call("h1", "o2", param="P"), call("h2", "o2"), call("h3", "w")], IM, ["x"], {}),
    "type parameters contradict the first argument": (
        FN, [call("a", "x"), call("h1", "t", param="Capture"), call("h2", "t", param="Authorize"), call("h3", "t", param="_")], IM, ["x"], {}),
    "short arguments are placeholders": (FN, [call("a", "x"), call("h1", "t", param="Capture")], [("a", "t", "A", CONNECTOR_TRAIT, ["F"], "pay")], ["x"], {}),
    "a type parameter locks an unlocked path": (FN, [call("core", "x", param="B"), call("a", "core"), call("h1", "core"), call("h2", "core", param="Other")], IM, ["x"], {}),
    "match arms list connectors": (
        FN, [call("a", "x"), call("h1", "t", "match", "c", "Connector::A | Connector::B"), call("h2", "t", "match", "c", "Connector::B, A"), call("h3", "t", "match", "c", "_"),
             call("core", "t", "if", "c", "Connector::B"), call("h1", "core")], IM, ["x"], {}),
    "a caller that is another connector's": (FN, [call("a", "x"), call("b", "t"), call("w", "t"), call("h1", "w"), call("h2", "b")], IM, ["x"], {}),
    "paths that differ in arguments go on apart": (
        [*FN, ("a2", "A#CI#sync", False), ("t2", "CI#sync", False)],
        [call("a", "x"), call("a2", "x"), call("core", "t"), call("core", "t2"), call("h1", "core", param="Authorize"), call("h2", "core", param="Sync")],
        [IM[0], ("a2", "t2", "A", CONNECTOR_TRAIT, ["Sync"], "sync")], ["x"], {}),
    "an endpoint by many paths": (FN, [call("h1", "x", "if", "p"), call("core", "x"), call("h1", "core", "match", "q", "_")], [], ["x"], {}),
    "seeds": (FN, [call("core", "x"), call("b", "core"), call("a", "core"), call("h1", "a"), call("h2", "b")], IM, [("x", ("A", CONNECTOR_TRAIT, ["Authorize"], "pay"))], {}),
    "types that the scan of bodies found": (FN, [call("a", "x"), call("b", "x"), call("h1", "a"), call("h2", "b"), call("h3", "x")], IM, ["x", "core"], {"step_a": [("x", "B")]}),
    "handlers' operations": (
        FN, [call("a", "x"), call("b", "x"), call("h1", "a"), call("h2", "b"), call("h3", "a")], IM, ["x"], {"step_a": [("x", "A"), ("x", "B")], "ops": [("h1", "Sync"), ("h3", "A")]}),
}


def expected(functions, calls, implements, targets, max_depth=8, step_a=(), ops=()):
    rows = [(t, None) if isinstance(t, str) else t for t in targets]
    return {t: plain_search(functions, calls, implements, t, max_depth, clean(seed), {x for at, x in step_a or () if at == t}, dict(ops or ())) for t, seed in rows}


@pytest.mark.parametrize("case", CASES)
def test_rules(spark, case):
    functions, calls, implements, targets, more = CASES[case]
    assert engine(spark, functions, calls, implements, targets, **more) == expected(functions, calls, implements, targets, **more)


def test_rules_by_hand(spark):
    """Results stated outright, so that the search above can't share a mistake with the operator."""

    def ends(case):
        functions, calls, implements, targets, more = CASES[case]
        return {(t, r[0], r[4]) for t, rows in engine(spark, functions, calls, implements, targets, **more).items() for r in rows}

    assert ends("direct callers of an implementation take its lock") == {("x", "h1", "B")}
    assert ends("another connector's method ends the path, direct callers too") == {("x", "h2", "A")}
    assert ends("a three-part name without a row bridges and takes the lock over") == {("x", "h1", "Wrap"), ("x", "h2", "Wrap"), ("x", "h3", "Wrap")}
    assert ends("paths that differ in arguments go on apart") == {("x", "h1", "A"), ("x", "h2", "A")}
    assert ends("match arms list connectors") == {("x", "h1", "A"), ("x", "h3", "A")}
    assert ends("types that the scan of bodies found") == {("x", "h2", "B"), ("x", "h3", None)}
    assert ends("handlers' operations") == {("x", "h2", "B"), ("x", "h3", "A")}


def test_random_graphs(spark):
    rng = random.Random(8)
    for _ in range(3):
        types, args = ["A", "B", "Enum"], ["Authorize", "Capture", "F"]
        functions = [(f"t{k}", f"CI#m{k}", False) for k in range(4)] + [(f"p{k}", f"plain{k}", False) for k in range(14)] + [(f"h{k}", f"h{k}", True) for k in range(5)]
        functions += [(f"{t}{k}", f"{t}#CI#m{k}", False) for t in types for k in range(4)]
        implements = [(f"{t}{k}", f"t{k}", t, CONNECTOR_TRAIT if t != "Enum" else "Dyn", [rng.choice(args)], f"m{k}") for t in types for k in range(3)]
        names = [s for s, _, _ in functions]
        pairs = sorted({(rng.choice(names), rng.choice(names)) for _ in range(110)})
        calls = [
            call(a, b, rng.choice([None, None, "match", "if"]), rng.choice([None, "c1", "c2"]), rng.choice([None, "_", "Connector::A", "Connector::B | Connector::A"]),
                 rng.choice([None, None, None, "_", *args])) for a, b in pairs]
        targets = rng.sample(names, 8)
        assert engine(spark, functions, calls, implements, targets, 6) == expected(functions, calls, implements, targets, 6)
