"""Conversation repair, hard negatives and decontamination against plain versions, with all the odd rows there may be."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import conversation_repair, decontaminate, hard_negatives, queries

BLANKS = " \t\n\x0b\f\r"


# ---- conversation repair


def plain_damage(rows):
    out = []
    said = lambda v: " " if v is None else str(v)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plain_edits(rows, faults):
    """(cost, audit, repaired rows) by a search for the cheapest path, whole audits compared."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, state, kept = heapq.heappop(heap)
        if at == len(rows) and state in ("", "a"):
            return cost, audit, kept
        if (at, state) in done:
            continue
        done.add((at, state))
        turn_of = "a" if state == "u" else "u"
        name = {"u": "user", "a": "assistant"}[turn_of]
        heapq.heappush(heap, (cost + 3, audit + "I", at, turn_of, (*kept, (name, ""))))
        if at < len(rows):
            role, text = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, state, kept))
            if faults[at] in ("blank", "duplicate"):
                continue
            more = 3 if faults[at] == "truncated" else 0
            if role[:1] == "s" and state == "":
                heapq.heappush(heap, (cost + more, audit + "K", at + 1, "s", (*kept, (role, text))))
            if role[:1] == turn_of:
                heapq.heappush(heap, (cost + more, audit + "K", at + 1, turn_of, (*kept, (role, text))))
            heapq.heappush(heap, (cost + 3 + more, audit + "R", at + 1, turn_of, (*kept, (name, text))))


def plain_repair(rows):
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired rows."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2][:32], hashlib.sha256(x[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in own:
            end = text.rstrip(BLANKS)
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        counts = [faults.count(k) for k in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *counts, illegal, *plain_edits([x[1:] for x in own], faults))
    return out


def repaired(frame):
    found, fixed = conversation_repair.repair(frame)
    texts = defaultdict(list)
    for r in sorted(fixed.collect(), key=lambda r: r.place):
        texts[r.conv_id].append((r.role, r.text))
    return {
        r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, tuple(texts[r.conv_id])) for r in found.collect()
    }


def test_op11(spark, sf_dir):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{sf_dir}/conversations.parquet'").fetchall()
    want = plain_repair(plain_damage(rows))
    found = queries.op11_conversation_repair(spark, sf_dir).collect()
    assert len(found) == len({r[0] for r in rows})
    for r in found:
        own = want.get(r.conv_id, (0, 0, 0, 0, 0, 0, "", ()))
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == own[:7]
        assert r.repaired_sha256 == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in own[7]).encode()).hexdigest()


CONVERSATION = "conv_id long, turn int, role string, text string"


def odd_conversations(n, seed):
    r = random.Random(seed)
    texts = ["Yes.", "No?", "no end", "", " \n", None, "Yes.", "Done! ", "1. é", "x" * 40 + "a.", "x" * 40 + "b."]
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "sage", "User"]
    return [(r.choice([None, 1, 1, 1, 2, 3, 4]), r.choice([None, *range(n // 3)]), r.choice(roles), r.choice(texts)) for _ in range(n)]


def test_long_conversations_are_cut_into_segments(spark, monkeypatch):
    monkeypatch.setattr(conversation_repair, "SEGMENT", 4)
    monkeypatch.setattr(conversation_repair, "FAN", 2)
    rows = odd_conversations(300, 1)
    # one conversation with half of all rows, a third of them equal
    rows += [(9, k, "user" if k % 3 else "assistant", f"turn {k}.") for k in range(200)] + [(9, 7, "user", "again.")] * 150
    frame = spark.createDataFrame(rows, CONVERSATION).repartition(5)
    segments = conversation_repair._segments(conversation_repair.with_faults(conversation_repair.numbered(frame)))
    assert segments.groupBy("conv").count().agg(F.max("count")).first()[0] > 64
    assert repaired(frame) == plain_repair(rows)


def test_conversations_of_odd_rows(spark):
    rows = odd_conversations(60, 2) + [(20, None, None, None), (21, None, "user", "a."), (22, 5, "system", "only."), (23, 1, "user", "cut off")]
    frame = spark.createDataFrame([(*r, "x", 0, "k") for r in rows], CONVERSATION + ", conv string, no int, fault string")
    assert repaired(frame) == plain_repair(rows)
    damaged = conversation_repair.damaged(frame)
    assert Counter(map(tuple, damaged.select("conv_id", "turn", "role", "text").collect())) == Counter(plain_damage(rows))
    found, fixed = conversation_repair.repair(frame.limit(0))
    assert found.count() == 0 and fixed.count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="suaoSUAO-", max_size=9), st.data())
def test_products_of_segments_are_the_search_over_all(symbols, data):
    rows = [({"s": "system", "u": "user", "a": "assistant"}.get(x.lower(), "other"), "t") for x in symbols]
    faults = ["blank" if x == "-" else "truncated" if x.isupper() else "" for x in symbols]
    cut = data.draw(st.integers(0, len(symbols)))
    whole = conversation_repair.segment_matrix(symbols[:cut])
    whole = conversation_repair.product(whole, conversation_repair.segment_matrix(symbols[cut:]))
    assert conversation_repair.cheapest(whole) == plain_edits(rows, faults)[:2]


# ---- hard negatives


def plain_negatives(rows, anchor, positives=5, negatives=5, window=(80, 100), scale=256):
    kept = []
    for k, (i, vec, label) in enumerate(rows):
        if vec is not None and label is not None and all(x is not None and math.isfinite(x) for x in vec):
            kept.append((k, i, [math.floor(scale * x) for x in vec], label))
    out = []
    order = lambda x: (-x[0], x[1] is None, x[1] or 0, x[2])
    for k, i, vec, label in kept:
        if not anchor(i):
            continue
        scored = [(sum(x * y for x, y in zip(vec, v)), j, n, lab) for n, j, v, lab in kept if n != k]
        for p in sorted((x for x in scored if x[3] == label), key=order)[:positives]:
            fits = [x for x in scored if x[3] != label and window[0] * p[0] <= 100 * x[0] <= window[1] * p[0]]
            for rank, x in enumerate(sorted(fits, key=order)[:negatives], 1):
                out.append((i, p[1], rank, x[1], p[0], x[0]))
    return Counter(out)


VECTORS = "vec_id long, embedding array<float>, label int"


def mined(frame, anchor, **more):
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return Counter(tuple(r[c] for c in names) for r in hard_negatives.mine(frame, anchor, **more).collect())


def clustered(n, labels, width, seed):
    """Vectors about one direction, labels about directions near to it: many negatives fall into the window."""
    r = np.random.default_rng(seed)
    base = r.normal(size=width)
    own = base + 0.5 * r.normal(size=(labels, width))
    out = [(own[k % labels] + 0.4 * r.normal(size=width)).astype(np.float32).tolist() for k in range(n)]
    return [(k, v, k % labels) for k, v in enumerate(out)]


def test_op12(spark, sf_dir):
    rows = duckdb.sql(f"SELECT vec_id, embedding, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END FROM '{sf_dir}/embeddings.parquet'").fetchall()
    found = Counter(tuple(r) for r in queries.op12_hard_negatives(spark, sf_dir).collect())
    assert found == plain_negatives(rows, lambda i: i % 100 == 0) and sum(found.values()) > 50


def test_negatives_over_many_parts_and_leaves(spark):
    rows = clustered(900, 3, 8, 1)
    rows += [(k, v, 2) for k, v, _ in rows[:60]]  # ids that come again, under another label
    rows += [(2000 + k, rows[5][1], 1) for k in range(200)]  # copies of one vector
    frame = spark.createDataFrame(rows, VECTORS).repartition(3)
    want = plain_negatives(rows, lambda i: i % 50 == 0)
    assert sum(want.values()) > 200
    some = frame.groupBy().agg(F.count("*")).first()[0] * 8 // 7
    assert mined(frame, F.col("vec_id") % 50 == 0) == want
    assert mined(frame, F.col("vec_id") % 50 == 0, part_cells=some) == want


def test_negatives_of_odd_rows(spark):
    rows = clustered(80, 2, 4, 2)
    rows += [(100, None, 1), (101, [1.0, 2.0, 3.0, 4.0], None), (102, [1.0, None, 0.0, 1.0], 1), (103, [math.nan, 1.0, 1.0, 1.0], 0)]
    rows += [(104, [math.inf, 1.0, 1.0, 1.0], 0), (105, [], 1), (106, [2.0], 0), (None, rows[0][1], 0), (None, rows[1][1], 1), (0, rows[0][1], 0)]
    rows += [(110, [3.0e6, 1.0, 1.0, 1.0], 0), (111, [3.0e6, 0.0, 1.0, 1.0], 1), (120, [2.9e6, 1.0, 1.0, 1.0], 0)]
    rows += [(200, [0.0, 90.0, 90.0, 90.0], 0), (None, [0.0, 80.0, 80.0, 80.0], 0), (201, [0.0, 75.0, 75.0, 75.0], 1)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS + ", q int, part string")
    want = plain_negatives([(i, v, y) for i, v, y in rows], lambda i: i is not None and i % 10 == 0)
    assert any(k[1] is None for k in want) and any(k[4] > 2**53 for k in want)
    assert mined(frame, F.col("vec_id") % 10 == 0) == want
    assert not mined(frame.limit(0), F.col("vec_id") % 10 == 0)
    assert not mined(frame.where("vec_id = 0").limit(1), F.col("vec_id") % 10 == 0)


def test_branch_and_bound_leaves_rows_out():
    r = np.random.default_rng(3)
    x = np.concatenate([(1000 * np.eye(8)[k] + 20 * r.normal(size=(512, 8))) for k in range(8)]).astype(np.int64)
    q = x[::100].copy()
    tree = hard_negatives.BallTree(x, np.arange(len(x)), np.arange(len(x)))
    ask = (np.full(len(q), -1), np.full(len(q), -(2**63)), np.full(len(q), 2**63 - 1))
    best = hard_negatives.Best(len(q), 5)
    scored = hard_negatives.search(tree, q, np.arange(len(q)), *ask, best)
    assert scored < 0.3 * q.shape[0] * x.shape[0]  # of eight clusters one holds what is best
    score = q @ x.T
    assert (best.score == -np.sort(-score, axis=1)[:, :5]).all()
    # a window far beneath all that the tree holds: the lower bounds shut every query out
    none = hard_negatives.Best(len(q), 5)
    assert hard_negatives.search(tree, q, np.arange(len(q)), ask[0], ask[1], np.full(len(q), -(10**9)), none) == 0 and (none.row < 0).all()


# ---- decontamination


def plain_words(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain_leaks(docs, items, window=10):
    """(doc_id, n_words, n_hit, items) of every document, window by window."""
    wanted = defaultdict(set)
    for i, text in items:
        w = plain_words(text)
        n = min(len(w), window)
        for s in range(len(w) - n + 1 if w else 0):
            wanted[tuple(w[s : s + n])].add(i)
    lengths = {len(k) for k in wanted}
    out = []
    for i, text in docs:
        w, hit, own = plain_words(text), set(), set()
        for n in lengths:
            for s in range(len(w) - n + 1):
                if (key := tuple(w[s : s + n])) in wanted:
                    hit.update(range(s, s + n))
                    own |= wanted[key]
        out.append((i, len(w), len(hit), tuple(sorted(str(x) for x in own if x is not None))))
    return Counter(out)


def leaks(docs, items, **more):
    found = decontaminate.scan(docs, items, **more).collect()
    assert all(r.n_hit == sum(s.end - s.start for s in r.spans) for r in found)
    assert all(a.end < b.start for r in found for a, b in zip(r.spans, r.spans[1:]))
    return Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in found)


def leaky(seed, n=60, vocabulary=6):
    """Few different words, so that grams and windows repeat within texts and are shared by chance."""
    r = random.Random(seed)
    word = lambda: r.choice(["the", "The", "a", "of", "é", "x1", "ok"][:vocabulary])
    items = [(k, " ".join(word() for _ in range(r.choice([0, 1, 3, 5, 7, 9, 10, 11, 14, 30])))) for k in range(25)]
    docs = []
    for k in range(n):
        w = [word() for _ in range(r.choice([0, 3, 12, 150, 400]))]
        for _ in range(r.choice([0, 1, 4])):
            at = r.randrange(len(w) + 1)
            w[at:at] = r.choice(items)[1].split()
        docs.append((k, r.choice([" ", ", ", "\n", " -- "]).join(w)))
    return docs, items


DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def test_op13(spark, sf_dir):
    docs, items = (duckdb.sql(f"SELECT * FROM '{sf_dir}/{t}.parquet'").fetchall() for t in ("documents", "benchmark"))
    want = plain_leaks([r[:2] for r in docs], [r[:2] for r in items])
    found = queries.op13_decontamination(spark, sf_dir).collect()
    sha = lambda own: hashlib.sha256(",".join(own).encode()).hexdigest()
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found) == Counter(
        (i, n, hit, len(own), sha(own), hit > 0) for i, n, hit, own in want.elements()
    )
    assert any(r.contaminated for r in found) and not all(r.contaminated for r in found)


@pytest.mark.parametrize("broadcast", [decontaminate.BROADCAST_WINDOWS, 0])
@pytest.mark.parametrize("vocabulary", [6, 2])
def test_windows_of_every_length(spark, broadcast, vocabulary):
    docs, items = leaky(vocabulary, vocabulary=vocabulary)
    for some in (items, [x for x in items if len(x[1].split()) >= 10], [x for x in items if len(x[1].split()) == 7]):
        frames = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(some, ITEMS)
        assert leaks(*frames, broadcast=broadcast) == plain_leaks(docs, some)


def test_leaks_of_odd_rows(spark):
    passage = " ".join(f"w{k}" for k in range(40))
    docs = [(1, None), (2, ""), (3, " -- "), (4, passage), (4, passage), (4, "other"), (None, passage + " tail"), (5, "head " + passage.upper().replace(" ", "-"))]
    docs += [(6, " ".join(passage.split()[:9])), (7, " ".join(passage.split()[3:13]))]
    docs += [(8, ("filler words " * 200 + passage + " ") * 100)]  # over many parts
    docs += [(100 + k, passage) for k in range(50)]
    items = [(1, passage), (2, passage + " more"), (1, "second text under the same id " + passage[:60]), (None, passage), (3, None), (4, ""), (5, " ?! ")]
    schema = ", list string, items int, __words string"
    frames = spark.createDataFrame([(*d, "x", 1, "w") for d in docs], DOCS + schema), spark.createDataFrame([(*i, "x", 1, "w") for i in items], ITEMS + schema)
    want = plain_leaks(docs, items)
    assert leaks(*frames) == leaks(*frames, broadcast=0) == want
    assert want[(8, 100 * 440, 100 * 40, ("1", "2"))] == 1
    none = frames[0].limit(0), frames[1].limit(0)
    assert leaks(frames[0], none[1]) == Counter((i, n, 0, ()) for i, n, _, _ in want.elements())
    assert leaks(none[0], frames[1]) == Counter()
    kept = decontaminate.drop_contaminated(*frames)
    assert kept.columns == frames[0].columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 6]
