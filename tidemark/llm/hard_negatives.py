"""Hard-negative mining: ball-tree branch and bound over per-partition trees.

Rows are dealt into parts of at most PART_CELLS numbers by a hash of their row, so no label, id or
copied vector makes a large part. Each part builds one ball tree for each label in it: a node knows
the centre and the radius of its rows. For an anchor q the inner products within a node lie between
q * centre - |q| * radius and q * centre + |q| * radius. A node is left out if these bounds miss the
score window, or if the upper one is strictly beneath the worst of the best rows found so far (one
that is equal could still win by its id). What is left at the leaves is scored exactly.

Two searches: an anchor's positives are its best rows of the same label; each (anchor, positive)
then looks for the best rows of other labels whose score lies in the window that the positive sets.
Every part gives its best few for each query, and the best of all parts are taken by a ranking that
keeps only those before it shuffles. Queries are streamed through the parts, a batch at a time, so
a worker holds one part and one batch. Nothing is approximate: each query meets every part.

Defined results. A row with a null label, a null vector or a null or non-finite component takes no
part. A component counts as floor(scale * x); shorter vectors count as filled up with zeros.
Better scores come first, ties by smaller id, a null id last. Another row is another row, even with
the same id or vector: rows that repeat an id are each an anchor, a positive or a negative of its
own. An anchor without positives, or a pair without rows in its window, gives no rows. Scores must
fit 64 bits. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import make_room, stable, written

SCALE = 256
#: Numbers in the vectors of one part, and rows of a leaf.
PART_CELLS, LEAF = 1 << 21, 64
#: Queries that go through a tree together.
BATCH = 512

_NONE, _LOW, _HIGH = 2**63 - 1, -(2**63), 2**63 - 1


def prepared(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """__row, vec_id, label (a string), vec (array of whole numbers) of the rows that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    taken = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    vec = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return taken.select("__row", F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), vec.alias("vec"))


class BallTree:
    """Rows of one label in a part, reordered so that each node's rows stand together."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        order = np.arange(len(x))
        points = x.astype(np.float64)
        self.nodes: list[tuple] = []  # centre, radius, first row, row after the last, left child, right child
        todo = [(0, len(x), None)]
        while todo:
            lo, hi, place = todo.pop()
            own = points[order[lo:hi]]
            centre = own.mean(axis=0)
            away = np.sqrt(((own - centre) ** 2).sum(axis=1))
            at = len(self.nodes)
            self.nodes.append([centre, float(away.max()), lo, hi, -1, -1])
            if place is not None:
                self.nodes[place[0]][place[1]] = at
            if hi - lo > LEAF and away.max() > 0:
                # by which of two rows far apart is nearer; at the median where that would leave one side with few
                far = own[away.argmax()]
                other = own[((own - far) ** 2).sum(axis=1).argmax()]
                along = (own - (far + other) / 2) @ (other - far)
                order[lo:hi] = order[lo:hi][np.argsort(along, kind="stable")]
                mid = lo + int((along < 0).sum())
                mid = mid if 10 * min(mid - lo, hi - mid) >= hi - lo else (lo + hi) // 2
                todo += [(mid, hi, (at, 5)), (lo, mid, (at, 4))]
        self.x, self.ids, self.rows = x[order], ids[order], rows[order]
        self.reach = float(np.sqrt((points**2).sum(axis=1)).max())


class Best:
    """The best top rows of each query so far, best first."""

    def __init__(self, n: int, top: int):
        self.score = np.full((n, top), _LOW, dtype=np.int64)
        self.id = np.full((n, top), _NONE, dtype=np.int64)
        self.row = np.full((n, top), -1, dtype=np.int64)

    def worst(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Candidates, one an entry; query says whose."""
        if not len(query):
            return
        some, top = np.unique(query), self.score.shape[1]
        query = np.concatenate([query, np.repeat(some, top)])
        score = np.concatenate([score, self.score[some].ravel()])
        ids = np.concatenate([ids, self.id[some].ravel()])
        rows = np.concatenate([rows, self.row[some].ravel()])
        # -1 - x turns the order of all 64-bit numbers round, without overflow
        order = np.lexsort((rows, ids, (rows < 0).astype(np.int8), -1 - score, query))
        query = query[order]
        first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        place = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
        kept = order[place < top]
        shape = (len(some), top)
        self.score[some], self.id[some], self.row[some] = score[kept].reshape(shape), ids[kept].reshape(shape), rows[kept].reshape(shape)


def search(tree: BallTree, q: np.ndarray, which: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray, best: Best) -> int:
    """Takes the rows of tree into best for the queries which (numbers in q); returns how many rows were scored.

    q holds all queries' vectors, own the row each must not find, low and high their score windows.
    Each query first goes down to the leaf whose centres are nearest to it, which raises its worst
    score; then all go through the tree together.
    """
    asked = q.astype(np.float64)
    length = np.sqrt((asked**2).sum(axis=1))
    exact = float(length.max(initial=0)) * tree.reach < 2.0**52  # then 64-bit floats hold every product and sum
    home = np.full(len(q), -1)

    def take(at: int, some: np.ndarray) -> int:
        rows = slice(tree.nodes[at][2], tree.nodes[at][3])
        score = (asked[some] @ tree.x[rows].astype(np.float64).T).astype(np.int64) if exact else q[some] @ tree.x[rows].T
        fits = (score >= np.maximum(best.worst(), low)[some][:, None]) & (score <= high[some][:, None])
        fits &= tree.rows[rows][None, :] != own[some][:, None]
        k, r = np.nonzero(fits)
        best.add(some[k], score[k, r], tree.ids[rows][r], tree.rows[rows][r])
        return score.size

    def possible(at: int, some: np.ndarray) -> np.ndarray:
        centre, radius = tree.nodes[at][:2]
        middle = asked[some] @ centre
        slack = length[some] * radius + 1e-9 * length[some] * (radius + np.sqrt(centre @ centre)) + 1e-3
        return some[(middle + slack >= np.maximum(best.worst(), low)[some]) & (middle - slack <= high[some])]

    scored, todo = 0, [(0, which)]
    while todo:
        at, some = todo.pop()
        some = possible(at, some)
        left, right = tree.nodes[at][4:]
        if len(some) and left < 0:
            home[some] = at
            scored += take(at, some)
        elif len(some):
            near = asked[some] @ (tree.nodes[left][0] - tree.nodes[right][0]) > 0
            todo += [(left, some[near]), (right, some[~near])]
    todo = [(0, which)]
    while todo:
        at, some = todo.pop()
        some = possible(at, some[home[some] != at])
        left, right = tree.nodes[at][4:]
        if len(some) and left < 0:
            scored += take(at, some)
        elif len(some):
            todo += [(left, some), (right, some)]
    return scored


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Lists as rows of a matrix, short ones filled up with zeros."""
    n = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(n) and (n == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(n), width), dtype=np.int64)
    out[np.arange(width)[None, :] < n[:, None]] = values
    return out


def _best_rows(vectors: DataFrame, queries: DataFrame, top: int, same: bool, parts: int, width: int) -> DataFrame:
    """q, place, score, id, row: the best top rows of every query (q, own, label, vec, low, high).

    same: among rows of the query's label, else among those of all others.
    """
    kind = "part int, kind int, q long, own long, label string, vec array<long>, low long, high long"
    null = F.lit(None).cast("long")
    # a row's id travels in q's place, and its number in own's
    held = vectors.select(
        F.pmod(F.xxhash64("__row"), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("kind"),
        F.coalesce("vec_id", F.lit(_NONE)).alias("q"), F.col("__row").alias("own"), "label", "vec", null.alias("low"), null.alias("high"),
    )
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    asked = queries.select(every, F.lit(1).alias("kind"), "q", "own", "label", "vec", "low", "high")
    dealt = held.unionByName(asked).repartition("part").sortWithinPartitions("part", "kind")

    def answer(forest: dict, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo in range(0, batch.num_rows, BATCH):
            some = batch.slice(lo, BATCH)
            own, low, high = (some.column(c).to_numpy(zero_copy_only=False) for c in ("own", "low", "high"))
            numbers, q = some.column("q").to_numpy(), _matrix(some.column("vec"), width)
            labels = np.array(some.column("label").to_pylist(), dtype=object)
            best = Best(len(q), top)
            for label, tree in forest.items():
                which = np.flatnonzero((labels == label) == same)
                if len(which):
                    search(tree, q, which, own, low, high, best)
            k, r = np.nonzero(best.row >= 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers[k]), pa.array(best.score[k, r]), pa.array(best.id[k, r]), pa.array(best.row[k, r])],
                ["q", "score", "id", "row"],
            )

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room("hard_negatives")
        part, rows, forest = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("part", "kind")])
            edges = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0), True])
            for lo, hi in zip(edges[:-1], edges[1:]):
                run = batch.slice(lo, hi - lo)
                if keys[0, lo] != part:
                    part, rows, forest = keys[0, lo], [], None
                if keys[1, lo] == 0:
                    rows.append(run)
                    continue
                if forest is None:
                    forest, rows = _forest(rows, width), []
                yield from answer(forest, run)

    found = dealt.select(*[F.col(c).cast(t) for c, t in (x.split() for x in kind.split(", "))])
    found = found.mapInArrow(find, "q long, score long, id long, row long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def _forest(rows: list[pa.RecordBatch], width: int) -> dict[str, BallTree]:
    """A tree for each label."""
    if not rows:
        return {}
    x = np.concatenate([_matrix(r.column("vec"), width) for r in rows])
    ids, own = (np.concatenate([r.column(c).to_numpy() for r in rows]) for c in ("q", "own"))
    labels = np.array([y for r in rows for y in r.column("label").to_pylist()], dtype=object)
    return {y: BallTree(x[labels == y], ids[labels == y], own[labels == y]) for y in sorted(set(labels))}


def mine(
    rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, window: tuple[int, int] = (80, 100),
    scale: int = SCALE, part_cells: int = PART_CELLS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, of rows (vec_id, embedding, label).

    anchor says of a row whether it is one. window: the least and largest percentage of the
    positive's score that a negative may have.
    """
    named = stable(rows.select("vec_id", "embedding", "label"), "vectors").withColumn("__row", F.monotonically_increasing_id())
    vectors = written(prepared(named, scale), "vectors")
    n, width = vectors.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    width = max(width or 0, 1)
    parts = max(1, -(-n * width // part_cells))

    anchors = vectors.where(anchor)
    free = {"low": F.lit(_LOW), "high": F.lit(_HIGH)}
    asked = anchors.select(F.col("__row").alias("q"), F.col("__row").alias("own"), "label", "vec").withColumns(free)
    near = _best_rows(vectors, asked, positives, True, parts, width)
    near = written(near.select(F.col("q").alias("own"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    pairs = near.withColumn("q", F.monotonically_increasing_id())

    score = F.col("positive_score").cast("decimal(20, 0)")  # times a hundred it need not fit 64 bits
    least, most = F.ceil(score * window[0] / 100).cast("long"), F.floor(score * window[1] / 100).cast("long")
    asked = pairs.withColumn("low", least).withColumn("high", most).where("low <= high")
    asked = asked.join(anchors.select(F.col("__row").alias("own"), "label", "vec"), "own")
    found = _best_rows(vectors, asked, negatives, False, parts, width)
    found = found.select("q", F.col("place").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))

    known = lambda c: F.when(F.col(c) != _NONE, F.col(c)).alias(c)
    out = found.join(pairs, "q").join(anchors.select(F.col("__row").alias("own"), F.col("vec_id").alias("anchor_id")), "own")
    return out.select("anchor_id", known("positive_id"), F.col("rank").cast("int").alias("rank"), known("negative_id"), "positive_score", "negative_score")
