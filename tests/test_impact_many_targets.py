"""The impact query's search from many targets at once: its rows do not grow with the targets."""

import random
from collections import defaultdict

import pytest

from tidemark.operators import impact as I
from tidemark.operators import target_sets as B
from test_impact_query import CALLS, FUNCTIONS, IMPLEMENTS, SEED, call, engine, expected


def test_a_level_has_no_row_for_each_target(spark, monkeypatch):
    n = 300
    functions = [(f"t{k}", f"t{k}", False) for k in range(n)] + [("a", "a", False), ("b", "b", False), ("h", "h", True)]
    calls = [call("a", f"t{k}") for k in range(n)] + [call("b", "a"), call("h", "b", "if", "c")]
    rows, own = [], I.written

    def counted(df, label):
        out = own(df, label)
        if label == "impact-level":
            rows.append(out.count())
        return out

    monkeypatch.setattr(I, "written", counted)
    found = I.impact(
        spark.createDataFrame(functions, FUNCTIONS), spark.createDataFrame(calls, CALLS), spark.createDataFrame([], IMPLEMENTS),
        spark.createDataFrame([(f"t{k}", None) for k in range(n)], f"symbol string, seed {SEED}"),
    ).collect()
    assert sorted((r.target, *r.chain) for r in found) == sorted((f"t{k}", "h", "b", "a", f"t{k}") for k in range(n))
    # the level of the targets themselves has one row for each, those after it one for each function
    assert sorted(x for x in rows if x < n) and sum(x for x in rows if x < n) <= 3 and sum(x >= n for x in rows) <= 1


def test_ways_that_share_a_key(spark):
    """Several functions of one abstract name on one level: the first by name is gone on from, also by different guards."""
    functions = [("x", "leaf", False), ("w1", "W#T#m", False), ("w2", "W#T#m", False), ("o", "T#m", False), ("c", "c", False), ("h1", "h1", True), ("h2", "h2", True)]
    calls = [call("w1", "x"), call("w2", "x", "if", "p"), call("c", "o", "match", "q", "_"), call("h1", "c"), call("h2", "o")]
    assert engine(spark, functions, calls, [], ["x", "w2"]) == expected(functions, calls, [], ["x", "w2"])


@pytest.mark.parametrize("seed", [1, 2])
def test_sets_against_sets(spark, seed):
    r = random.Random(seed)
    many = [(r.randrange(4), r.randrange(3), r.choice([0, 63, 64, 1023, 1024, 5000, r.randrange(1500)])) for _ in range(400)]
    gone = [(k, n) for k, _, n in many if r.random() < 0.4]
    rows = B.sets(spark.createDataFrame(many, "k int, o int, n long"), ["k", "o"])
    other = B.sets(spark.createDataFrame(gone, "k int, n long"), ["k"])
    less = defaultdict(set)
    for k, n in gone:
        less[k].add(n)
    assert sorted((x.k, x.n) for x in B.members(B.new(rows, other, ["k"])).collect()) == sorted({(k, n) for k, _, n in many if n not in less[k]})
    assert sorted((x.k, x.o, x.n) for x in B.members(B.within(rows, other, ["k"])).collect()) == sorted({(k, o, n) for k, o, n in many if n in less[k]})
    least = {}
    for k, o, n in many:
        least[k, n] = min(o, least.get((k, n), o))
    assert sorted((x.k, x.n, x.o) for x in B.members(B.firsts(rows, ["k"], ["o"])).collect()) == sorted((k, n, o) for (k, n), o in least.items())


def test_a_target_that_has_come_to_all_is_not_gone_on_with(spark, monkeypatch):
    """Both functions before endpoints are met on level 2, so no other caller is gone on to, neither there nor further up."""
    functions = [(x, x, False) for x in ("x", "f", "g", *(f"u{k}" for k in range(9)))] + [("h1", "h1", True), ("h2", "h2", True)]
    calls = [call("f", "x"), call("g", "x", "if", "c"), call("h1", "f"), call("h2", "g"), call("u0", "x"), *(call(f"u{k + 1}", f"u{k}") for k in range(8)), call("f", "u8")]
    levels, own = [], I.written

    def counted(df, label):
        out = own(df, label)
        if label == "impact-level":
            levels.append(out.count())
        return out

    monkeypatch.setattr(I, "written", counted)
    assert engine(spark, functions, calls, [], ["x"]) == expected(functions, calls, [], ["x"])
    assert levels == [1, 2, 0]
