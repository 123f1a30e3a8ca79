"""Sets of targets as bits against Python's sets."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from tidemark.operators import graph as G
from tidemark.operators import target_sets as B


def as_sets(frame, key="k"):
    out = defaultdict(set)
    for r in B.members(frame).collect():
        assert r.n not in out[r[key]]
        out[r[key]].add(r.n)
    return dict(out)


def test_sets_of_numbers(spark):
    r = random.Random(1)
    numbers = [0, 1, 63, 64, 1023, 1024, 1087, 5000, 2**33, 2**33 + 1023, *(r.randrange(4000) for _ in range(200))]
    rows = [(r.randrange(5), n) for n in numbers for _ in range(2)]
    gone = [(k, n) for k, n in rows if r.random() < 0.4] + [(0, 77), (9, 1)] + [(4, n) for k, n in rows if k == 4]
    frame = lambda x: spark.createDataFrame(x, "k int, n long")
    want, less = defaultdict(set), defaultdict(set)
    for k, n in rows:
        want[k].add(n)
    for k, n in gone:
        less[k].add(n)
    made = B.sets(frame(rows), ["k"])
    assert as_sets(made) == dict(want)
    assert as_sets(B.united(made.unionByName(B.sets(frame(gone), ["k"])), ["k"])) == {k: want[k] | less[k] for k in {*want, *less}}
    left = B.without(made, B.sets(frame(gone), ["k"]), ["k"])
    assert as_sets(left) == {k: want[k] - less[k] for k in want if want[k] - less[k]}
    both = B.common(made, [], F.count(F.lit(1)).alias("k")).where("k = 5")
    assert set().union(*as_sets(both).values()) == set.intersection(*want.values())
    asked = frame([(k, n) for k in range(5) for n in numbers]).withColumn("block", B.block_of(F.col("n")))
    held = {(x.k, x.n) for x in asked.join(made, ["k", "block"]).where(B.holds(F.col("n"))).collect()}
    assert held == {(k, n) for k in want for n in want[k]}


def test_numbers_of_targets(spark):
    found = B.numbered_targets(spark.range(3000).repartition(7))
    assert sorted(r.n for r in found.collect()) == list(range(3000))  # few targets: one run of numbers


def test_shortest_chains_on_small_graphs(spark):
    """Against all simple chains, the best of each pair kept: cycles, targets that are endpoints, targets that call each other."""
    for seed in range(2):
        r = random.Random(seed)
        edges = sorted({(f"f{r.randrange(14)}", f"f{r.randrange(14)}") for _ in range(34)})
        calls = spark.createDataFrame([(a, b, r.choice([None, "if"]), "x") for a, b in edges if a != b], "caller string, callee string, guard_type string, guard_condition string")
        targets = spark.createDataFrame([(f"f{k}",) for k in (1, 2, 5, 9, 77)], "symbol string")
        ends = spark.createDataFrame([("f0",), ("f2",), ("f13",)], "symbol string")
        best = {}
        for c in G.chains_up(calls, targets, ends, 6).collect():
            key = (len(c.chain), ">".join(c.chain) + ">")
            if key < best.get((c.endpoint, c.target), ((99,),))[0]:
                best[c.endpoint, c.target] = (key, c.chain, c.guards, c.depth)
        found = {(c.endpoint, c.target): (c.chain, c.guards, c.depth) for c in G.shortest_chains_up(calls, targets, ends, 6).collect()}
        assert found == {k: v[1:] for k, v in best.items()} and found


def test_shortest_chains_from_either_side(spark):
    """From the endpoints down as from the targets up, and many targets are searched for from the few endpoints."""
    for seed in range(3):
        r = random.Random(seed)
        edges = sorted({(f"f{r.randrange(16)}", f"f{r.randrange(16)}") for _ in range(44)})
        calls = spark.createDataFrame([(a, b, r.choice([None, "if"]), "x") for a, b in edges if a != b], "caller string, callee string, guard_type string, guard_condition string")
        targets = spark.createDataFrame([(f"f{k}",) for k in (1, 2, 2, 5, 9, 77)], "symbol string")
        ends = spark.createDataFrame([("f0",), ("f2",), ("f13",), ("f99",)], "symbol string")
        up, down = (sorted(map(tuple, G.shortest_chains_up(calls, targets, ends, 5, down=d).collect())) for d in (False, True))
        assert up == down and up


def test_many_targets_make_no_sets(spark, monkeypatch):
    """Sets of many targets are nearly empty, so few endpoints are searched from instead."""
    monkeypatch.setattr(G, "_shortest_up", None)
    calls = spark.range(3000).selectExpr("'e' AS caller", "concat('t', id) AS callee", "CAST(NULL AS STRING) AS guard_type", "CAST(NULL AS STRING) AS guard_condition")
    found = G.shortest_chains_up(calls, calls.selectExpr("callee AS symbol"), spark.createDataFrame([("e",)], "symbol string"), 3)
    assert found.where("depth = 1 AND chain = array('e', target)").count() == found.count() == 3000
