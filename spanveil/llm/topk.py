"""Exact top-k inner-product search with Fagin's threshold algorithm.

Vectors become integers (floor of 1024 times each component). They are dealt by
id into blocks of bounded size; each block keeps one sorted list per dimension.
A query walks down all lists at once, from the best end for its sign, scores
what it meets exactly, and stops when the threshold (the score of a fictive
vector with every list's current value) is below its kth result. The blocks' k
best are merged by a window of k rows a block.

Equal vectors in a block are scored once, with their k + 1 smallest ids, so a
vector that a third of all rows share costs no more than another.

Edge cases: vectors that are null, empty or hold null or non-finite components
take no part (an empty vector scores 0 with all: it does take part as a zero
vector); shorter vectors count as padded with zeros; ties go to the smaller id;
null ids take no part; repeated ids are rows of their own; an empty table or
query set gives no rows; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanveil.cluster import checkpoint

SCALE = 1024
BLOCK = 16384
QUERIES = 512
STEP = 16


def integers(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, v: whole-number vectors of the rows that take part."""
    x = F.transform(vec_col, lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & fine).select(
        F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * SCALE).cast("long")).alias("v")
    )


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    col = col.combine_chunks()
    lens = np.asarray(col.value_lengths().fill_null(0), np.int64)
    flat = np.asarray(col.flatten(), np.int64)
    d = int(lens.max(initial=0))
    out = np.zeros((len(lens), d), np.int64)
    out[np.repeat(np.arange(len(lens)), lens), np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    return out


class Lists:
    """A block's distinct vectors, sorted in every dimension."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int) -> None:
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        self.x, which = np.unique(x, axis=0, return_inverse=True)
        which = which.reshape(-1)
        at = np.argsort(which, kind="stable")
        count = np.bincount(which, minlength=len(self.x))
        start = np.cumsum(count) - count
        nth = np.arange(len(ids)) - np.repeat(start, count)
        fit = nth <= k
        self.ids = ids[at][fit]  # of each vector the k + 1 smallest
        self.count = np.minimum(count, k + 1)
        self.start = np.cumsum(self.count) - self.count
        self.order = np.argsort(self.x, axis=0, kind="stable")
        self.exact = self.x.astype(np.float64) if np.abs(self.x).max(initial=0) < 2**40 else None
        self.k = k

    def scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        if self.exact is not None and float(np.abs(q).max(initial=0)) * float(np.abs(self.x).max(initial=0)) * max(1, len(q)) < 2**53:
            return (self.exact[rows] @ q.astype(np.float64)).astype(np.int64)
        return self.x[rows] @ q

    def top(self, q: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best, without the query itself, and the sorted accesses that it took."""
        n, d = self.x.shape
        q = np.pad(q, (0, max(0, d - len(q))))[:d]
        dims = np.flatnonzero(q)
        seen = np.zeros(n, bool)
        rows, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, step = 0, STEP
        while depth < n:
            end = min(n, depth + step)
            if len(dims):
                walk = np.concatenate([self.order[depth:end, j] if q[j] < 0 else self.order[n - end : n - depth, j] for j in dims])
                new = np.unique(walk[~seen[walk]])
            else:
                new, end = np.arange(n), n
            seen[new] = True
            rows, score = np.concatenate([rows, new]), np.concatenate([score, self.scores(new, q)])
            depth, step = end, step * 2
            if depth >= n:
                break
            edge = [self.x[self.order[depth - 1 if q[j] < 0 else n - depth, j], j] for j in dims]
            bound = int(np.dot(np.array(edge, np.int64), q[dims]))
            if len(rows) > self.k:  # the query itself may be one of them
                best = np.argpartition(-score, self.k)[: self.k + 1]
                kth = int(score[best].min())
                keep = score >= kth
                rows, score = rows[keep], score[keep]
                if bound < kth:
                    break
        if not len(rows):
            return rows, score
        c = self.count[rows]
        ids = self.ids[np.repeat(self.start[rows], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)]
        s = np.repeat(score, c)
        other = ids != own
        ids, s = ids[other], s[other]
        best = np.lexsort((ids, -s))[: self.k]
        return ids[best], s[best]


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all vectors for each query; both inputs as made by ``integers``."""
    vectors = checkpoint(vectors)
    n = vectors.count()
    nq = queries.count()
    vb, qb = max(1, -(-n // block)), max(1, -(-nq // QUERIES))
    cell = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = queries.select(F.lit(True).alias("q"), "id", "v", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(qb)).cast("int").alias("a"), cell(vb).alias("b"))
    right = vectors.select(F.lit(False).alias("q"), "id", "v", cell(qb).alias("a"), F.pmod(F.xxhash64("id"), F.lit(vb)).cast("int").alias("b"))

    def run(t: pa.Table) -> pa.Table:
        ask = t["q"].combine_chunks()
        qs, vs = t.filter(ask), t.filter(pa.compute.invert(ask))
        out: list[list] = [[], [], []]
        if len(qs) and len(vs):
            lists = Lists(np.asarray(vs["id"]), _matrix(vs["v"]), k)
            for own, q in zip(np.asarray(qs["id"]), _matrix(qs["v"]), strict=True):
                ids, s = lists.top(q, int(own))
                for o, x in zip(out, (np.full(len(ids), own), ids, s), strict=True):
                    o.append(x)
        cols = [pa.array(np.concatenate(o) if o else np.zeros(0, np.int64), pa.int64()) for o in out]
        return pa.Table.from_arrays(cols, names=["query_id", "vec_id", "score"])

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        left.unionByName(right)
        .groupBy("a", "b")
        .applyInArrow(run, "query_id long, vec_id long, score long")
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
