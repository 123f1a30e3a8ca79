"""The registered chain queries against a plain search, where chains are longer than four calls."""

from tidemark import registry
from tidemark.plans import graph as P
from tidemark.plans.views import select


def plain_chains(calls, ends, targets, max_depth):
    into = {}
    for c in calls:
        into.setdefault(c.callee, []).append(c)
    state, out = [(t, (t,), ()) for t in targets], []
    for _ in range(max_depth):
        step = [
            (t, (c.caller, *chain), guards if c.guard_type is None else (*guards, f"{c.guard_type}|{c.guard_condition or ''}"))
            for t, chain, guards in state
            for c in into.get(chain[0], ())
            if c.caller not in chain
        ]
        out += [s for s in step if s[1][0] in ends]
        state = [s for s in step if s[1][0] not in ends]
    return out


def test_chains_are_whole(spark, sf_dir):
    rows = lambda q: select(spark, sf_dir, q).collect()
    ends = {r.symbol for r in rows("SELECT symbol FROM v_fn WHERE is_endpoint")}
    found = plain_chains(rows("SELECT * FROM v_calls"), ends, [r.symbol for r in rows(P._TARGETS)], 12)
    assert max(len(chain) - 1 for _, chain, _ in found) > 4
    got = P._chains(spark, sf_dir).collect()
    assert sorted((r.target, tuple(r.chain)) for r in got) == sorted((t, chain) for t, chain, _ in found)
    best = {}
    for t, chain, guards in found:
        key, row = (chain[0], t), (len(chain) - 1, ">".join(chain), ";".join(guards))
        best[key] = min(best.get(key, row), row)
    got = registry.queries()["endpoint_chains"](spark, sf_dir).collect()
    assert {(r.endpoint, r.target): (r.depth, r.chain, r.guards) for r in got} == best and len(got) == len(best)
