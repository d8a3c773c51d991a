"""Nearest neighbours by vantage-point trees, one per shard.

Rows are dealt into shards of bounded size by a hash of their id.  A task sorts its shard
before the queries, builds the tree once, and lets the queries stream past it in Arrow
batches, so it holds one shard and one batch whatever the input.  Each query keeps its
nearest of every shard; the last step merges these few rows.

A node has a vantage point and two halves of its rows, with the least and the largest
distance of each half to the point.  By the triangle inequality a half is at least so far
from a query as the query's own distance to the point lies outside that range.  The bound
is multiplied by a factor before it is compared with the distance of the k-th nearest so
far: one gives exact search, more prunes more and may miss.  Distances themselves are
always those of the original vectors, in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import table

#: Rows of a leaf, and queries that are compared with one at once.
LEAF, BLOCK = 64, 1024
#: Bounds of a shard's rows; between them it grows with the square root of the table, so that queries are not dealt to too many shards.
SHARD_ROWS = (4_096, 131_072)
#: Factor of the query.  Recall falls as vectors have more dimensions; README has what was measured.
FACTOR = 6.0


def distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Euclidean distance of every row of ``left`` to every row of ``right``, components added in their order."""
    out = np.zeros((len(left), len(right)))
    for a, b in zip(left.T, right.T):
        gap = a[:, None] - b[None, :]
        out += gap * gap
    return np.sqrt(out)


class VantageTree:
    """``ids`` and ``rows`` in the order of the leaves; nodes are tuples of a span or of a vantage point and its halves."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        self.ids, self.rows, self.leaf = ids.copy(), rows.copy(), leaf
        self.root = self._grow(0, len(ids)) if len(ids) else None

    def _grow(self, lo: int, hi: int):
        if hi - lo <= self.leaf:
            return lo, hi
        here = self.rows[lo:hi]
        point = here[np.argmax(distances(here[:1], here)[0])].copy()  # a row far out splits better than one in the middle
        far = distances(point[None], here)[0]
        order = np.argsort(far, kind="stable")
        self.ids[lo:hi], self.rows[lo:hi], far = self.ids[lo:hi][order], here[order], far[order]
        half = (hi - lo) // 2
        return point, (far[0], far[half - 1]), (far[half], far[-1]), self._grow(lo, lo + half), self._grow(lo + half, hi)

    def nearest(self, ids: np.ndarray, rows: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, int]:
        """Per query the ids and distances of its k nearest rows with another id (distance infinite where there are fewer), and how many distances were taken."""
        self.seen = 0
        self.q, self.own = rows, ids
        self.near_id = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.near = np.full((len(ids), k), np.inf)
        if self.root is not None and len(ids):
            self.reach = np.full(len(ids), np.inf)
            self._first_leaf(self.root, np.arange(len(ids)), k)
            self._visit(self.root, np.arange(len(ids)), factor)
        return self.near_id, self.near, self.seen

    def _outside(self, node, which: np.ndarray) -> list[np.ndarray]:
        """Lower bounds of the distance from each query to either half."""
        at = distances(self.q[which], node[0][None])[:, 0]
        slack = 1e-12 * at  # rounding of the three distances
        return [np.maximum(np.maximum(at - hi, lo - at) - slack, 0.0) for lo, hi in node[1:3]]

    def _leaf(self, node, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = node
        self.seen += len(which) * (hi - lo)
        found = distances(self.q[which], self.rows[lo:hi])
        found[self.ids[None, lo:hi] == self.own[which][:, None]] = np.inf
        return found, self.ids[lo:hi]

    def _first_leaf(self, node, which: np.ndarray, k: int) -> None:
        """How far the k nearest reach at most, from the leaf that each query falls into."""
        if not len(which):
            return
        if len(node) == 2:
            found, _ = self._leaf(node, which)
            if found.shape[1] >= k:
                self.reach[which] = np.partition(found, k - 1, axis=1)[:, k - 1]
            return
        left, right = self._outside(node, which)
        self._first_leaf(node[3], which[left <= right], k)
        self._first_leaf(node[4], which[left > right], k)

    def _visit(self, node, which: np.ndarray, factor: float) -> None:
        if len(node) == 2:
            for k in range(0, len(which), BLOCK):
                self._take(node, which[k : k + BLOCK])
            return
        bounds = self._outside(node, which)
        for half in sorted((0, 1), key=lambda h: bounds[h].sum()):
            still = factor * bounds[half] <= self.reach[which]
            if still.any():
                self._visit(node[3 + half], which[still], factor)

    def _take(self, node, which: np.ndarray) -> None:
        found, ids = self._leaf(node, which)
        some = (found <= self.reach[which][:, None]).any(axis=1)
        which, found = which[some], found[some]
        if not len(which):
            return
        dist = np.concatenate([self.near[which], found], axis=1)
        name = np.concatenate([self.near_id[which], np.where(np.isinf(found), np.iinfo(np.int64).max, ids[None, :])], axis=1)
        order = np.lexsort((name, dist), axis=-1)[:, : self.near.shape[1]]
        self.near[which], self.near_id[which] = np.take_along_axis(dist, order, 1), np.take_along_axis(name, order, 1)
        self.reach[which] = np.minimum(self.reach[which], self.near[which][:, -1])


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _search(k: int, factor: float, leaf: int):
    """Shards before their queries, in order, to each query's nearest rows of the shard."""

    def run(batches):
        key, held, tree = None, [], None
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy() for c in ("shard", "dim", "kind")])
            cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                if a == b:
                    continue
                shard, dim, kind = (int(x) for x in marks[:, a])
                ids, rows = batch.column("vec_id").slice(a, b - a).to_numpy(), _matrix(batch.column("v").slice(a, b - a), dim)
                if kind == 0:
                    if key != (shard, dim):
                        key, held, tree = (shard, dim), [], None
                    held.append((ids, rows))
                    continue
                if key != (shard, dim):
                    continue  # no row of this length in the shard
                if tree is None:
                    all_ids = np.concatenate([i for i, _ in held])
                    once = np.ones(len(all_ids), dtype=bool)
                    once[1:] = all_ids[1:] != all_ids[:-1]
                    tree = VantageTree(all_ids[once], np.concatenate([r for _, r in held])[once], leaf)
                    held = []
                near_id, near, _ = tree.nearest(ids, rows, k, factor)
                some = np.isfinite(near)
                yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(ids[:, None], near.shape)[some]), pa.array(near_id[some]), pa.array(near[some])], names=["query_id", "vec_id", "score"])

    return run


def usable_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, v and its length dim, of rows with an id whose vector is neither null, empty nor zero and has finite components only."""
    kind = vectors.schema[embedding].dataType.simpleString()
    v = F.col(embedding) if kind in ("array<float>", "array<double>") else F.col(embedding).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0)).select("vec_id", "v", F.size("v").alias("dim"))


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, factor: float = FACTOR, leaf: int = LEAF, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` of each row of ``queries``: query_id, rank, vec_id, score.

    Score is the Euclidean distance; ties go to the smaller id; a query's own id is no
    candidate.  ``factor`` 1 is exact, larger ones may miss some neighbours.

    Vectors that are null, empty or zero or hold null or non-finite components take no
    part, nor do rows without an id.  Only vectors of one length are compared.  Of rows
    that share an id the one with the smallest vector counts, as candidate and as query.
    Empty tables give no rows.  Other columns are ignored, whatever their names.
    """
    rows, asked = usable_vectors(vectors, vec_id, embedding), usable_vectors(queries, vec_id, embedding)
    n = vectors.count()
    least, most = SHARD_ROWS
    shards = max(1, math.ceil(n / min(most, max(least, 16 * math.isqrt(n)))))
    asked = asked.groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", "v", F.size("v").alias("dim"))
    left = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), "dim", F.lit(0).alias("kind"), "vec_id", "v")
    right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "dim", F.lit(1).alias("kind"), "vec_id", "v")
    dealt = left.union(right).repartitionById(shards, "shard").sortWithinPartitions("shard", "dim", "kind", "vec_id", "v")
    found = dealt.mapInArrow(_search(k, factor, leaf), "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.select("query_id", place.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op12_neighbours(spark, sf_dir: str) -> DataFrame:
    """Ten nearest of every hundredth id among all ``embeddings``."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.where("vec_id % 100 = 0"))
