"""Whitening of embeddings by their leading principal components, found by block Lanczos.

Every entry becomes a whole number (floor of 1024 times it, plus an offset). The
covariance is never built: a pass over all rows multiplies it with a block of
vectors, as the sum of d (d . B) over the rows' exact deviations d = (n x - S) / n.
Each task sums its rows; the sums of the tasks meet in a group-by of one row a
dimension, so the driver gets dimensions x block numbers, whatever the number of
rows. The block is made orthogonal to all earlier ones (twice: full
reorthogonalisation). Directions that vanish are a breakdown: they are replaced by
random ones orthogonal to the basis. The projected matrix gives the Ritz pairs,
and passes go on until the residuals of the wanted pairs vanish to rounding or the
basis spans the whole space. The trace for the explained shares is the sum of the
rows' exact deviations.

Edge cases: rows with a null vector or a null or non-finite entry are dropped;
shorter vectors count as padded with entries of 0; a null id passes; repeated rows
count each time; with fewer than ``k`` dimensions there are as many components;
where the eigenvalue is 0 (to rounding: fewer different rows than components) the
direction is any orthogonal one, and whitened is null; an empty table gives no
rows; entries beyond 2**51 count as that, and a deviation beyond a long is null; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.cluster import checkpoint, ship

COMPONENTS = 8
SCALE = 1024
OFFSET = 100_000
#: Whole numbers farther from 0 (entries above 2e15) count as this.
FARTHEST = 1 << 61
#: Residual, as a share of the largest eigenvalue, below which a Ritz pair is settled.
TOLERANCE = 1e-14
#: Rows that a task multiplies at once.
_ROWS = 4096


def integers(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, x: the whole numbers of the rows that take part."""
    c = F.transform(vec_col, lambda v: v.cast("double"))
    fine = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    bound = lambda x: F.greatest(F.lit(-FARTHEST), F.least(F.lit(FARTHEST), x))
    return vectors.where(F.col(vec_col).isNotNull() & fine).select(F.col(id_col).alias("vec_id"), F.transform(c, lambda v: bound(F.floor(v * SCALE).cast("long")) + OFFSET).alias("x"))


class Fit:
    """Number of rows, dimensions and exact sums of the fit list; deviations of a batch from its mean."""

    def __init__(self, rows: DataFrame) -> None:
        r = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d"), F.max(F.array_max(F.transform("x", F.abs))).alias("top")).first()
        self.n, self.d, top = r["n"], r["d"] or 0, r["top"] or OFFSET
        sums = {}
        if self.n:
            # d rows; a missing entry counts as 0, whose whole number is the offset
            each = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(28,0)")).alias("s"), F.count("*").alias("m"))
            sums = {s["i"]: int(s["s"]) + OFFSET * (self.n - s["m"]) for s in each.collect()}
        self.sums = [sums.get(i, 0) for i in range(self.d)]
        self.whole = 2 * self.n * max(top, OFFSET) < 2**62  # n x - S fits a long

    def deviations(self, col: pa.Array) -> np.ndarray:
        """n x - S of each row: exact whole numbers."""
        size = np.asarray(col.value_lengths(), np.int64)
        x = np.full((len(col), self.d), OFFSET, np.int64)
        x[np.repeat(np.arange(len(col)), size), np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)] = np.asarray(col.flatten(), np.int64)
        if self.whole:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def blocks(self, batches: Iterator[pa.RecordBatch], place: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        for whole in batches:
            for lo in range(0, len(whole), _ROWS):
                b = whole.slice(lo, _ROWS)
                yield b, self.deviations(b.column(place))

    def times(self, rows: DataFrame, block: np.ndarray) -> np.ndarray:
        """The covariance times a block of columns: one pass over the rows."""
        n, p = self.n, block.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(block.shape)
            for _, d in self.blocks(batches, 0):
                c = d.astype(np.float64) / n
                total += c.T @ (c @ block)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), *[pa.array(total[:, j]) for j in range(p)]], names=["i", *[f"s{j}" for j in range(p)]])

        sums = rows.select("x").mapInArrow(run, "i long, " + ", ".join(f"s{j} double" for j in range(p))).groupBy("i").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(p)])
        out = np.zeros(block.shape)
        for r in sums.collect():
            out[r["i"]] = [r[f"s{j}"] for j in range(p)]
        return out / n


def _orthonormal(block: np.ndarray, basis: np.ndarray, rnd: np.random.Generator, scale: float) -> np.ndarray:
    """Unit columns, orthogonal to the basis and each other; a column that vanishes is drawn anew, while the space has room."""
    out = basis
    for v in block.T:
        floor = 1e-12 * scale
        for _ in range(6):
            for _ in range(2):
                v = v - out @ (out.T @ v)
            size = np.linalg.norm(v)
            if size > floor:
                v = v / size
                for _ in range(2):
                    v = v - out @ (out.T @ v)
                out = np.column_stack([out, v / np.linalg.norm(v)])
                break
            if out.shape[1] >= len(v):
                break
            v, floor = rnd.standard_normal(len(v)), 1e-6
    return out[:, basis.shape[1] :]


def components(rows: DataFrame, fit: Fit, k: int = COMPONENTS, seed: int = 11) -> tuple[np.ndarray, np.ndarray, int]:
    """Eigenvalues (falling), unit eigenvectors as columns, and the number of passes."""
    k, rnd = min(k, fit.d), np.random.default_rng(seed)
    basis, image = np.zeros((fit.d, 0)), np.zeros((fit.d, 0))
    block = rnd.standard_normal((fit.d, k))
    passes, scale = 0, 1.0
    while True:
        new = _orthonormal(block, basis, rnd, scale)
        got = fit.times(rows, new)
        passes += 1
        basis, image = np.column_stack([basis, new]), np.column_stack([image, got])
        t = basis.T @ image
        e, y = np.linalg.eigh((t + t.T) / 2)
        e, y = e[::-1][:k], y[:, ::-1][:, :k]
        vectors = basis @ y
        scale = max(float(e[0]), 0.0)
        gap = np.linalg.norm(image @ y - vectors * e, axis=0)
        if basis.shape[1] >= fit.d or scale == 0 or gap.max() <= TOLERANCE * scale:
            break
        block = got  # made orthogonal to all that came before
    vectors /= np.linalg.norm(vectors, axis=0)
    vectors *= np.sign(vectors[np.abs(vectors).argmax(0), np.arange(k)])  # one sign for all rows and runs
    return np.maximum(e, 0), vectors, passes


def projected(rows: DataFrame, fit: Fit, e: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """vec_id, deviation and w: the whitened coordinates of each row, for the eigenvalues above 0."""
    kind, n, over = rows.schema["vec_id"].dataType.simpleString(), fit.n, vectors / np.sqrt(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, d in fit.blocks(batches, 1):
            if len(b):
                big = float(np.abs(d).max(initial=0)) ** 2 * max(1, d.shape[1]) >= 2**62
                dev = [x if x < 2**63 else None for x in (d.astype(object) ** 2).sum(1)] if big else (d.astype(np.int64) ** 2).sum(1)
                w = d.astype(np.float64) / n @ over
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dev, pa.int64()), pa.array(list(w), pa.list_(pa.float64()))], names=["vec_id", "deviation", "w"])

    return rows.select("vec_id", "x").mapInArrow(run, f"vec_id {kind}, deviation long, w array<double>")


def _total_deviation(rows: DataFrame, fit: Fit) -> float:
    """Sum over the rows of the squared deviations, exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for _, d in fit.blocks(batches, 0):
            big = float(np.abs(d).max(initial=0)) ** 2 * max(1, d.size) >= 2**62
            total += int((d.astype(object) ** 2).sum()) if big else int((d.astype(np.int64) ** 2).sum())
        yield pa.RecordBatch.from_arrays([pa.array([str(total)])], names=["total"])

    # a task's sum as text: whole numbers of any length
    sums = rows.select("x").mapInArrow(run, "total string")
    exact = sums.agg(F.sum(F.try_to_number("total", F.lit("9" * 38))).alias("exact"), F.sum(F.col("total").cast("double")).alias("near")).first()
    return float(exact["exact"] if exact["exact"] is not None and exact["exact"] > 0 else exact["near"] or 0.0)


def identity_error(white: DataFrame, n: int, k: int) -> float:
    """The largest entry of the whitened rows' covariance less the identity; centred before multiplying."""
    if not k:
        return 0.0
    mean = white.agg(*[F.avg(F.col("w")[i]).alias(f"m{i}") for i in range(k)]).first()
    c = [F.col("w")[i] - F.lit(mean[i]) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    cov = white.agg(*[(F.sum(c[i] * c[j]) / n).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(cov[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(vectors: DataFrame, k: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error: a row for each remaining vector and component."""
    ship(vectors.sparkSession)
    rows = checkpoint(integers(vectors, id_col, vec_col))
    fit = Fit(rows)
    kind = "vec_id " + rows.schema["vec_id"].dataType.simpleString()
    if not fit.n or not fit.d:
        return rows.sparkSession.createDataFrame([], f"{kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    e, v, _ = components(rows, fit, k)
    good = int((e > 1e-13 * e[0]).sum()) if e[0] > 0 else 0
    white = checkpoint(projected(rows, fit, e[:good], v[:, :good]))
    error = identity_error(white, fit.n, good)
    trace = _total_deviation(rows, fit) / float(fit.n) ** 3
    share = F.array(*[F.lit(float(x / trace) if trace else 0.0) for x in e])
    each = white.select("vec_id", "deviation", F.posexplode(share).alias("i", "explained"), "w")
    return each.select(
        "vec_id",
        (F.col("i") + 1).alias("component"),
        F.lit(fit.n).cast("long").alias("n"),
        "deviation",
        F.get("w", F.col("i")).alias("whitened"),
        "explained",
        F.lit(float(error)).alias("identity_error"),
    )
