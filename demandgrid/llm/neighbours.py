"""Nearest neighbours by collision-counting hashing (operator 9).

Vectors are dealt into blocks by a hash of their id, queries into groups, and every group meets every block in a task of
its own.  A block holds one sorted array per random projection.  Around a query's own projection a window opens in
each array; virtual rehashing widens all windows by a factor until enough vectors collide with the query in at least
``threshold`` arrays.  Those are verified with exact inner products, and a query's best over all blocks remain.

The largest inner product is made a nearest-vector search by one more coordinate: vectors are scaled by the block's
longest and filled up to length one.

Defined results: vectors that are null, empty, zero or hold nulls, NaN or infinities, and rows without an id, take no
part; repeated rows count once, and of several vectors with one id the best counts; only vectors of the query's length
are candidates; equal scores are ordered by id; a query with fewer candidates than asked for gets them all."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROJECTIONS = 64
HALF_WINDOW = 0.67       # of the search radius
THRESHOLD = 30           # of PROJECTIONS; a vector at the search radius reaches it in most cases
GROWTH = 1.08            # of the radius from round to round
VERIFIED = 0.5           # of a block, at least, before the windows stop growing
LEAST_VERIFIED = 400
BLOCK = 16_384           # vectors
GROUP = 4_096            # queries
TOGETHER = 256           # queries of a group whose windows grow side by side


class Index:
    """The sorted projections of one block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projections: int = PROJECTIONS):
        self.ids, self.vectors = ids, vectors
        n, d = vectors.shape
        norms = np.linalg.norm(vectors, axis=1)
        self.longest = norms.max()
        lifted = np.empty((n, d + 1))
        lifted[:, :d] = vectors / self.longest
        lifted[:, d] = np.sqrt(np.maximum(0, 1 - (norms / self.longest) ** 2))
        self.axes = np.random.default_rng(d).standard_normal((projections, d + 1))
        along = (lifted @ self.axes.T).T
        self.order = np.argsort(along, axis=1, kind="stable")
        self.sorted = np.take_along_axis(along, self.order, axis=1)
        # windows open where those of some of the block's own vectors were about to close
        self.start = 0.5
        radii = [r for _, r in self.candidates(vectors[::-(-n // 8)], 1)]
        self.start = min(radii) / GROWTH

    def candidates(self, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, float]]:
        """For each query the rows that collide with it often enough, and the radius at which they are many enough."""
        n, m = len(self.ids), len(self.axes)
        wanted = min(n, max(LEAST_VERIFIED, k + 1, math.ceil(VERIFIED * n)))
        if wanted >= n:
            return [(np.arange(n), self.start)] * len(queries)
        out: list = [None] * len(queries)
        at = self.axes[:, :-1] @ (queries / np.linalg.norm(queries, axis=1, keepdims=True)).T
        low = np.stack([np.searchsorted(s, x) for s, x in zip(self.sorted, at)])
        high, counts, radius = low.copy(), np.zeros((len(queries), n), np.int16), self.start
        growing = np.arange(len(queries))
        while len(growing):
            reach = HALF_WINDOW * radius
            a = np.stack([np.searchsorted(s, x) for s, x in zip(self.sorted, at[:, growing] - reach)])
            b = np.stack([np.searchsorted(s, x, side="right") for s, x in zip(self.sorted, at[:, growing] + reach)])
            done = np.zeros(len(growing), bool)
            for j, i in enumerate(growing):
                new = [o[x:y] for o, x, y in zip(self.order, a[:, j].tolist(), low[:, i].tolist()) if x < y]
                new += [o[x:y] for o, x, y in zip(self.order, high[:, i].tolist(), b[:, j].tolist()) if x < y]
                if new:
                    counts[i] += np.bincount(np.concatenate(new), minlength=n).astype(np.int16)
                found = counts[i] >= THRESHOLD * m / PROJECTIONS
                if np.count_nonzero(found) >= wanted:
                    out[i], done[j] = (np.flatnonzero(found), radius), True
            low[:, growing], high[:, growing] = a, b
            growing, radius = growing[~done], radius * GROWTH
        return out

    def search(self, query_id: int, query: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The best ``k`` of the candidate rows, and their scores."""
        rows = rows[self.ids[rows] != query_id]
        # a sum per row, not a matrix product: equal vectors get equal scores
        scores = np.einsum("ij,j->i", self.vectors[rows], query)
        best = np.lexsort((self.ids[rows], -scores))[:k] if len(rows) <= 4 * k else None
        if best is None:
            edge = np.partition(scores, len(scores) - k)[len(scores) - k]
            near = np.flatnonzero(scores >= edge)
            best = near[np.lexsort((self.ids[rows[near]], -scores[near]))][:k]
        return self.ids[rows[best]], scores[best]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]).to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


def valid_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return (df.where(F.col(key).isNotNull() & v.isNotNull() & F.coalesce(finite & some, F.lit(False)))
            .select(F.col(key).cast("long").alias("id"), v.cast("array<double>").alias("v"), F.size(v).alias("d")).distinct())


def nearest(df: DataFrame, queries: DataFrame, *, key: str = "vec_id", vector: str = "embedding", k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of ``df`` for each row of ``queries``."""
    base, asked = valid_vectors(df, key, vector), valid_vectors(queries, key, vector)
    n_blocks = max(1, math.ceil(base.count() / BLOCK))
    n_groups = max(1, math.ceil(asked.count() / GROUP))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = base.select("id", "v", "d", part(n_blocks).alias("block"), all_of(n_groups).alias("group"))
    right = asked.select("id", "v", "d", all_of(n_blocks).alias("block"), part(n_groups).alias("group"))

    def search(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(vectors) and len(queries):
            order = np.argsort(ids := vectors["id"].to_numpy(), kind="stable")
            index = Index(ids[order], _matrix(vectors["v"])[order])
            names, asked = queries["id"].to_numpy(), _matrix(queries["v"])
            for at in range(0, len(names), TOGETHER):
                some = slice(at, at + TOGETHER)
                for q, v, (rows, _) in zip(names[some].tolist(), asked[some], index.candidates(asked[some], k)):
                    out.append((q, *index.search(q, v, rows, k)))
        whose = np.repeat(np.array([o[0] for o in out], np.int64), [len(o[1]) for o in out])
        join = lambda i, kind: np.concatenate([np.zeros(0, kind), *(o[i] for o in out)])
        return pa.table({"query_id": pa.array(whose), "vec_id": pa.array(join(1, np.int64)),
                         "score": pa.array(join(2, np.float64))})

    keys = ["d", "block", "group"]
    found = (left.groupBy(*keys).cogroup(right.groupBy(*keys))
             .applyInArrow(search, "query_id long, vec_id long, score double"))
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
