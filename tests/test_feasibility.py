"""Counted chains against all chains, one by one."""

import random
from collections import Counter

from pyspark.sql import functions as F

from tidemark.operators import graph as G

CALLS = "caller string, callee string, guard_type string, guard_condition string"


def test_counts_of_chains(spark):
    """With cycles, functions above and below them, targets that are endpoints, guards that contradict each other in all ways."""
    guards = [(None, None), ("match", "a"), ("match", " a "), ("match", "b"), ("match", ""), ("if", "x"), ("if", "!x"), ("if", "! y"), ("if", "y"), ("if", "!(x)"), ("for", "x")]
    for seed in range(2):
        r = random.Random(seed)
        edges = {(f"f{r.randrange(10)}", f"f{r.randrange(10)}") for _ in range(20)} | {(f"up{r.randrange(4)}", f"f{r.randrange(10)}") for _ in range(8)} | {("top", f"up{k}") for k in range(4)}
        calls = spark.createDataFrame([(a, b, *r.choice(guards)) for a, b in sorted(edges) if a != b], CALLS).coalesce(1)
        targets = spark.createDataFrame([(f"f{k}",) for k in (1, 2, 5, 9)] + [("up1",), ("absent",)], "symbol string").coalesce(1)
        ends = spark.createDataFrame([("f2",), ("top",), ("up3",)], "symbol string").coalesce(1)
        want = Counter(x.bad for x in G.chains_up(calls, targets, ends, 6).select(G.infeasible(F.col("guards")).alias("bad")).collect())
        assert {x.likely_infeasible: x.n for x in G.feasibility(calls, targets, ends, 6).collect()} == dict(want) and len(want) == 2


def test_many_chains_are_few_rows(spark):
    """20 layers of 8 functions that all call the next: 8 ** 19 chains, more than can be written."""
    rows = [(f"{k}-{a}", f"{k + 1}-{b}", None, None) for k in range(19) for a in range(8) for b in range(8)]
    rows += [("end", f"0-{a}", "if", "x") for a in range(8)]
    target = spark.createDataFrame([("19-0",)], "symbol string")
    found = G.feasibility(spark.createDataFrame(rows, CALLS).coalesce(1), target, spark.createDataFrame([("end",)], "symbol string"), 20).collect()
    assert [(x.likely_infeasible, x.n) for x in found] == [(False, 8**19)]
