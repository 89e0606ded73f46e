"""Hard negatives by search in multiway hyperplane trees (GNAT).

Vectors of a label are dealt by a hash of their id to trees of about ``TREE``. A node has up to ``DEGREE`` split points, chosen far
from each other; every vector goes to the nearest one, and for each split point i and subtree j the node stores the
range of distances between i and the vectors of j. Leaves hold exact whole numbers.

Scores are inner products, so vectors get one more component that brings all of a tree to its largest norm M; anchors get 0
there. Then |a - x|^2 = |a|^2 + M^2 - 2 score, and a window of scores is an annulus around the anchor. At a node the distances
d to the split points rule subtree j out as soon as for some i its range misses [max(d - outer, inner - d), d + outer].
A search first walks down to one leaf, which gives its k-th best score so far, then goes over the tree with the
annulus narrowed by it; many searches go side by side. Two rounds use the same trees:

1. Positives: each anchor in the trees of its label, the window open above.
2. Negatives: each anchor in the trees of other labels, with a window for each of its positives.

Anchors and trees meet in a grid of blocks and groups, both packed in rows; each pair is one group of a shuffle and returns at
most k rows per anchor and window.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from .whole_vectors import Best, frozen, narrowest, thawed, unpacked, whole_vectors

TREE, TREES = 4096, 64  # vectors of a tree, trees of a group
DEGREE, LEAF = 12, 64
ANCHORS, LEAST_ANCHORS = 4096, 256  # of a block
SALTS = 64


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances between the rows of two matrices."""
    return np.maximum(0, (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T))


def _split_points(wide: np.ndarray) -> np.ndarray:
    """Places of up to ``DEGREE`` different vectors, each far from those before it, out of three times as many."""
    tried = np.unique(np.linspace(0, len(wide) - 1, 3 * DEGREE).astype(np.int64))
    chosen, far = [0], _apart(wide, wide[:1])[:, 0]
    chosen.append(int(np.argmax(far)))  # the farthest of all, so that two are different where any are
    near = np.minimum(far[tried], _apart(wide[tried], wide[chosen[1:]])[:, 0])
    while len(chosen) < DEGREE and near.max() > 0:
        chosen.append(int(tried[np.argmax(near)]))
        near = np.minimum(near, _apart(wide[tried], wide[chosen[-1:]])[:, 0])
    return np.array(chosen)


class Tree:
    """A tree over whole-number vectors. Rows are kept so that each node's are side by side, a leaf's in order of id.

    ``first`` and ``last`` bound a node's rows; nodes ``child``[n] .. + ``degree``[n] are its subtrees (degree 0: a leaf), ``split``
    the rows of their split points, and ``near`` and ``far`` hold degree x degree ranges from place ``ranges``[n] on.
    """

    def __init__(self, **parts: np.ndarray):
        self.parts = parts
        self.__dict__.update(parts)
        self.exact = self.exact.astype(np.float64)
        self.square = float(self.norm[0])
        self.slack = 1e-6 * np.sqrt(self.square) + 1e-6

    @staticmethod
    def grown(ids: np.ndarray, whole: np.ndarray) -> "Tree":
        order = np.argsort(ids, kind="stable")
        norms = (whole * whole).sum(axis=1)
        most = norms.max(initial=0)
        wide = np.column_stack((whole, np.sqrt(most - norms)))
        first, last, child, degree, ranges, split, near, far = [0], [len(ids)], [0], [0], [0], [-1], [], []
        todo = [0]
        while todo:
            node = todo.pop()
            rows = order[first[node]:last[node]]
            if len(rows) <= LEAF:
                continue
            points = rows[_split_points(wide[rows])]
            d = np.sqrt(_apart(wide[rows], wide[points]))
            side = d.argmin(axis=1)
            size = np.bincount(side, minlength=len(points))
            points, d, size = points[size > 0], d[:, size > 0], size[size > 0]
            if len(size) < 2:
                continue
            by = np.argsort(side, kind="stable")  # ids stay in order within a side
            order[first[node]:last[node]] = rows[by]
            start = np.append(0, np.cumsum(size)[:-1])
            child[node], degree[node], ranges[node] = len(first), len(size), sum(map(len, near))
            near.append(np.minimum.reduceat(d[by], start, axis=0).T.ravel())  # row: split point, column: subtree
            far.append(np.maximum.reduceat(d[by], start, axis=0).T.ravel())
            for p, a, n in zip(points, start, size):
                todo.append(len(first))
                first.append(first[node] + int(a))
                last.append(first[-1] + int(n))
                split.append(int(p))
                for more in (child, degree, ranges):
                    more.append(0)
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        split = np.array(split)
        none = [np.zeros(0)]
        return Tree(ids=ids[order], exact=narrowest(whole[order]), norm=np.array([most]), first=np.array(first), last=np.array(last),
                    child=np.array(child), degree=np.array(degree), ranges=np.array(ranges),
                    split=np.where(split < 0, -1, place[split]), near=np.concatenate(near or none), far=np.concatenate(far or none))

    def _shell(self, norm: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inner and outer radius of the annulus in which scores between ``low`` and ``high`` lie."""
        with np.errstate(invalid="ignore"):
            inner, outer = (np.sqrt(np.maximum(0, norm + self.square - 2 * s)) for s in (high, low))
        return inner - self.slack, outer + self.slack

    def _from_points(self, node: int, anchor: np.ndarray, norm: np.ndarray) -> np.ndarray:
        points = self.split[self.child[node]:self.child[node] + self.degree[node]]
        return np.sqrt(np.maximum(0, norm[:, None] + self.square - 2 * (anchor @ self.exact[points].T)))

    def _leaf(self, node: int, search: np.ndarray, anchor: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray, best: Best) -> int:
        rows = slice(self.first[node], self.last[node])
        score = anchor[search] @ self.exact[rows].T
        least = np.maximum(low[search], best.worst()[search])[:, None]
        at, row = np.nonzero((score >= least) & (score <= high[search][:, None]) & (self.ids[rows][None, :] != own[search][:, None]))
        best.offer(search[at], score[at, row], self.ids[rows][row])
        return score.size

    def search(self, own: np.ndarray, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, best: Best,
               searches: np.ndarray | None = None) -> int:
        """Offers ``best`` the rows with a score from ``low`` to ``high`` that it may lack; how many scores were computed.

        Row s of the arguments is search s; ``own`` is the id it leaves out; only ``searches`` take part.
        """
        every = np.arange(len(own)) if searches is None else searches
        norm = (anchor * anchor).sum(axis=1)
        seen, seed = 0, np.zeros(len(own), np.int64)
        todo = [(0, every)]
        while todo:  # each to one leaf: the subtree whose split point is nearest to the inner rim
            node, s = todo.pop()
            if not self.degree[node]:
                seed[s] = node
                seen += self._leaf(node, s, anchor, own, low, high, best)
                continue
            inner, _ = self._shell(norm[s], low[s], high[s])
            to = np.abs(self._from_points(node, anchor[s], norm[s]) - np.maximum(inner, 0)[:, None]).argmin(axis=1)
            todo += [(self.child[node] + j, s[to == j]) for j in np.unique(to)]
        todo = [(0, every)]
        while todo:
            node, s = todo.pop()
            if not self.degree[node]:
                s = s[seed[s] != node]
                if len(s):
                    seen += self._leaf(node, s, anchor, own, low, high, best)
                continue
            n = self.degree[node]
            inner, outer = self._shell(norm[s], np.maximum(low[s], best.worst()[s]), high[s])
            d = self._from_points(node, anchor[s], norm[s])
            near, far = (x[self.ranges[node]:self.ranges[node] + n * n].reshape(n, n) for x in (self.near, self.far))
            alive = np.repeat((inner <= outer)[:, None], n, axis=1)
            least, most = np.maximum(d - outer[:, None], inner[:, None] - d), d + outer[:, None]
            for i in range(n):
                alive &= (far[i][None, :] >= least[:, i:i + 1]) & (near[i][None, :] <= most[:, i:i + 1])
            todo += [(self.child[node] + j, s[alive[:, j]]) for j in range(n - 1, -1, -1) if alive[:, j].any()]
        return seen


def _placed(rows: DataFrame, anchors: Column, cores: int) -> DataFrame:
    """``rows`` with the tree they belong to and, per label, the numbers of trees, groups and anchor blocks. Stored."""
    salt = F.pmod(F.xxhash64("vec"), F.lit(SALTS)).cast("int")
    sizes = rows.groupBy("dims", "label").agg(F.count("*").alias("n"), F.sum(anchors.cast("long")).alias("asked"))
    sizes = sizes.select("dims", "label", F.ceil(F.col("n") / TREE).alias("trees"), F.greatest(
        F.ceil(F.col("asked") / ANCHORS), F.least(F.ceil(F.col("asked") / LEAST_ANCHORS), F.lit(cores))).cast("int").alias("blocks"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))  # salted, as one label may hold a third of all rows
    joined = rows.withColumn("salt", salt).join(sizes, ["dims", "label", "salt"])
    return durable(joined.select("dims", "label", "vec", "v", F.pmod(F.xxhash64("vec", F.lit(2)), F.col("trees")).alias("tree"),
                                 F.ceil(F.col("trees") / TREES).cast("int").alias("groups"), "blocks"))


def _trees(placed: DataFrame) -> DataFrame:
    """(dims, label, tree, groups, blocks, data), stored."""
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        dims, label, tree, groups, blocks = (x.as_py() for x in key)
        grown = Tree.grown(rows.column("vec").to_numpy(), unpacked(rows.column("v"), dims))
        return pa.table({"dims": [dims], "label": [label], "tree": [tree], "groups": pa.array([groups], pa.int32()),
                         "blocks": pa.array([blocks], pa.int32()), "data": [frozen(**grown.parts)]})

    return durable(placed.groupBy("dims", "label", "tree", "groups", "blocks").applyInArrow(
        run, "dims long, label long, tree long, groups int, blocks int, data binary"))


def _each(n: Column | str) -> Column:
    """0 to n - 1, one row each; none for n = 0."""
    n = F.col(n) if isinstance(n, str) else n
    return F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)))


def _positives(anchors: DataFrame, trees: DataFrame, k: int) -> DataFrame:
    """(vec, positive, score): the ``k`` best other rows of each anchor's label."""
    key = ["dims", "label", "block", "group"]
    left = anchors.withColumn("block", F.pmod(F.xxhash64("vec", F.lit(3)), F.col("blocks")).cast("int")).withColumn("group", _each("groups"))
    right = trees.withColumn("group", F.pmod("tree", F.col("groups")).cast("int")).withColumn("block", _each("blocks"))

    def run(key: tuple, asked: pa.Table, trees: pa.Table) -> pa.Table:
        own, anchor = asked.column("vec").to_numpy(), unpacked(asked.column("v"), key[0].as_py())
        best, open_ = Best(len(own), k), np.full(len(own), np.inf)
        for data in trees.sort_by("tree").column("data") if len(own) else ():
            Tree(**thawed(data.as_py())).search(own, anchor, -open_, open_, best)
        search, score, found = best.found()
        return pa.table({"vec": own[search], "positive": found, "score": score})

    met = left.select(*key, "vec", "v").groupBy(*key).cogroup(right.select(*key, "tree", "data").groupBy(*key)).applyInArrow(
        run, "vec long, positive long, score long")
    rank = F.row_number().over(Window.partitionBy("vec").orderBy(F.desc("score"), "positive"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def _negatives(windows: DataFrame, trees: DataFrame, blocks: int, groups: int, k: int) -> DataFrame:
    """(vec, positive, score, negative, of): the ``k`` best rows of other labels in each window (vec, positive, score, low, high)."""
    key = ["dims", "block", "group"]
    left = windows.withColumn("block", F.pmod(F.xxhash64("vec", F.lit(3)), F.lit(blocks)).cast("int")).withColumn("group", _each(F.lit(groups)))
    right = trees.withColumn("group", F.pmod(F.xxhash64("label", "tree"), F.lit(groups)).cast("int")).withColumn("block", _each(F.lit(blocks)))

    def run(key: tuple, asked: pa.Table, trees: pa.Table) -> pa.Table:
        own, label, positive, of, low, high = (asked.column(c).to_numpy() for c in ("vec", "label", "positive", "score", "low", "high"))
        anchor, best = unpacked(asked.column("v"), key[0].as_py()), Best(len(own), k)
        trees = trees.sort_by([("label", "ascending"), ("tree", "ascending")])
        for kind, data in zip(trees.column("label").to_pylist(), trees.column("data")) if len(own) else ():
            others = np.flatnonzero(label != kind)
            if len(others):
                Tree(**thawed(data.as_py())).search(own, anchor, low.astype(float), high.astype(float), best, others)
        search, score, found = best.found()
        return pa.table({"vec": own[search], "positive": positive[search], "score": of[search], "negative": found, "of": score})

    met = left.select(*key, "vec", "label", "v", "positive", "score", "low", "high").groupBy(*key).cogroup(
        right.select(*key, "label", "tree", "data").groupBy(*key)).applyInArrow(
        run, "vec long, positive long, score long, negative long, of long")
    rank = F.row_number().over(Window.partitionBy("vec", "positive").orderBy(F.desc("of"), "negative"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchors: Column, label: Column, positives: int = 5, negatives: int = 3,
                   window: Sequence[int] = (50, 95), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` selects rows by ``vec``, ``label`` is an expression over ``vectors``. A component x counts as floor(256 x); a score is the
    inner product with the anchor, exact below 2 ** 46. An anchor's positives are the ``positives`` best other rows of its label. For
    each of them the first ``negatives`` rows of another label are returned whose score, times 100, is between ``window`` times the
    positive's. Higher scores come first, ties by smaller id. Rows without an id or a label, and vectors that are null or hold null
    or non-finite components, take no part; rows that share an id count once (see ``whole_vectors``); only vectors of one
    length are compared. Other columns aren't looked at; an empty table gives an empty table.
    """
    rows = whole_vectors(vectors, id_col, vector_col, label)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    placed = _placed(rows, anchors, cores)
    trees = _trees(placed.select("dims", "label", "vec", "v", "tree", "groups", "blocks"))
    chosen = placed.where(anchors)
    pairs = durable(_positives(chosen, trees, positives))
    floor_of = lambda x: F.expr(f"({x} - pmod({x}, 100)) div 100")
    a, b = f"(score * {int(window[0])})", f"(score * {int(window[1])})"
    windows = chosen.select("dims", "label", "vec", "v").join(pairs, "vec").withColumn("low", -floor_of(f"(-{a})")).withColumn("high", floor_of(b))
    windows = windows.where("low <= high")
    n, asked = trees.count(), chosen.count()
    blocks = max(1, -(-asked // ANCHORS), min(-(-asked // LEAST_ANCHORS), cores))
    found = _negatives(windows, trees, blocks, max(1, -(-n // TREES)), negatives)
    return found.select(F.col("vec").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("negative").alias("negative_id"),
                        F.col("score").alias("positive_score"), F.col("of").alias("negative_score"))
