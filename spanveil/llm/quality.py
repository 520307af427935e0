"""Quality rules: hashed word and character n-gram logistic regression.

Features are the shares of hashed words, word pairs and 4-byte character
n-grams of a whole text; the weights are fitted on a bounded, documented sample
of labelled rows (``max_rows`` of each class, taken by a hash of the id) and the
logits are calibrated to probabilities on a held-out fifth of it (Platt scaling,
weighted to the class shares of *all* labels). Texts are scored in Arrow batches
against a fixed threshold, beside the fixed base rules.

Edge cases: a null text has no words and fails the base rules; an empty or
one-class label table gives a model that rejects nothing; rows with a null or
other label than 0 or 1 are not used; repeated rows get equal results; a probability
equal to the threshold keeps; rows of the sample whose hashes tie go by id; further
columns of the input are not read by ``score`` and pass through ``keep`` as
they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.llm import vec

#: Rows of each class that the classifier is fitted on, at most.
MAX_ROWS = 1500
BITS = 12
THRESHOLD = 0.5
MIN_WORDS = 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_START = np.ones(256, bool)
_START[0x80:0xC0] = False

_FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


@dataclass(frozen=True)
class Model:
    """Weights of the three hashed feature spaces, and the calibration."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    @classmethod
    def neutral(cls) -> Model:
        return cls(np.zeros(3 << BITS, np.float32), 20.0, 1.0, 0.0)


def _features(data: np.ndarray, offs: np.ndarray, words: tuple) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket, row) of every feature occurrence in the three spaces."""
    _, _, row, h = words
    shift = np.uint64(64 - BITS)
    out = [((h >> shift).astype(np.int64), row)]
    g, at = vec.grams(h, row, 2)
    out.append(((g >> shift).astype(np.int64) + (1 << BITS), row[at]))
    n = len(data) - 3
    if n > 0:
        d = data.astype(np.uint32)
        c = d[:n] | (d[1 : n + 1] << np.uint32(8)) | (d[2 : n + 2] << np.uint32(16)) | (d[3:] << np.uint32(24))
        c = (c * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        r = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
        ok = np.flatnonzero(r[:n] == r[3:])
        out.append((c[ok].astype(np.int64) + (2 << BITS), r[ok]))
    return out


def _words(data: np.ndarray, offs: np.ndarray) -> tuple:
    s, e, row = vec.runs(~vec.SPACE[data], offs)
    return s, e, row, vec.hash_runs(data, s, e)


def _dup_lines(data: np.ndarray, offs: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The lines with a word of each text that equal an earlier one; word: starts of all words. Lines count as equal by two 64-bit hashes."""
    s, e, row = vec.runs(data != 10, offs)
    real = np.searchsorted(word, e) > np.searchsorted(word, s)
    s, e, row = s[real], e[real], row[real]
    n = len(offs) - 1
    if not len(s):
        return np.zeros(n, np.int64)
    a, b = vec.hash_runs(data, s, e), vec.hash_runs2(data, s, e)
    order = np.lexsort((b, a, row))
    a, b, r = a[order], b[order], row[order]
    again = np.flatnonzero((a[1:] == a[:-1]) & (b[1:] == b[:-1]) & (r[1:] == r[:-1])) + 1
    return np.bincount(r[again], minlength=n)


def base(col: pa.Array) -> Iterator[tuple[dict[str, np.ndarray], tuple]]:
    """The base figures of each chunk of texts, and what they were made from."""
    for i, j, data, offs in vec.chunks(col):
        n = j - i
        words = _words(data, offs)
        s, e, row, h = words
        g, at = vec.grams(h, row, 3)
        rep = vec.first_of(g ^ vec.mix(row[at].astype(np.uint64) + np.uint64(1)))
        hit = np.zeros(len(h) + 3, bool)
        for k in range(3):
            hit[at[rep] + k] = True
        c = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_START[data], out=c[1:])
        m = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_SYMBOL[data], out=m[1:])
        out = {
            "n_words": vec.per_row(np.ones(len(row)), row, n).astype(np.int64),
            "word_chars": vec.per_row(c[e] - c[s], row, n).astype(np.int64),
            "n_symbols": m[offs[1:]] - m[offs[:-1]],
            "n_dup_lines": _dup_lines(data, offs, s),
            "n_repeat_words": vec.per_row(hit[: len(h)], row, n).astype(np.int64),
        }
        out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
        yield out, (data, offs, words)


def probability(model: Model, data: np.ndarray, offs: np.ndarray, words: tuple) -> np.ndarray:
    """The calibrated probability that each text is good."""
    n = len(offs) - 1
    z = np.full(n, model.bias)
    for bucket, row in _features(data, offs, words):
        count = np.bincount(row, minlength=n)
        z += vec.per_row(model.weights[bucket], row, n) / np.maximum(count, 1)
    return 1 / (1 + np.exp(-np.clip(model.slope * z + model.offset, -500, 500)))


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, data, offs in vec.chunks(b.column(0)):
            n = j - i
            keys, vals = [], []
            for bucket, row in _features(data, offs, _words(data, offs)):
                k, c = np.unique(row * (3 << BITS) + bucket, return_counts=True)
                total = np.bincount(row, minlength=n)
                keys.append(k)
                vals.append((c / total[k // (3 << BITS)]).astype(np.float32))
            k = np.concatenate(keys)
            v = np.concatenate(vals)
            order = np.argsort(k, kind="stable")
            k, v = k[order], v[order]
            cut = np.searchsorted(k, np.arange(n + 1) * (3 << BITS)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(1).slice(i, n),
                    pa.ListArray.from_arrays(cut, pa.array((k % (3 << BITS)).astype(np.int32))),
                    pa.ListArray.from_arrays(cut, pa.array(v)),
                ],
                names=["y", "idx", "val"],
            )


def _platt(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    a, b = 1.0, 0.0
    t = np.where(y > 0, 1 - 1 / (w * y).sum().clip(2), 1 / (w * (1 - y)).sum().clip(2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = w * (p - t)
        s = w * p * (1 - p) + 1e-9
        h = np.array([[(s * z * z).sum() + 1e-6, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, [(g * z).sum(), g.sum()])
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return (float(a), float(b)) if np.isfinite([a, b]).all() and a > 0 else (1.0, 0.0)


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], share: float, steps: int = 120) -> Model:
    """Fits weights on four fifths of the rows, and the calibration on the rest. share: of good labels among all."""
    y = np.array([r[0] for r in rows], np.float64)
    if len(set(y.tolist())) < 2 or min((y == 0).sum(), (y == 1).sum()) < 5:
        return Model.neutral()
    lens = np.array([len(r[1]) for r in rows])
    idx = np.concatenate([r[1] for r in rows]).astype(np.int64)
    val = np.concatenate([r[2] for r in rows]).astype(np.float64)
    row = np.repeat(np.arange(len(y)), lens)
    train = np.arange(len(y)) % 5 != 4
    w, bias = np.zeros(3 << BITS), 0.0
    cw = np.where(y > 0, 0.5 / (y[train] > 0).mean(), 0.5 / (y[train] == 0).mean()) * train / train.sum()
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        z = np.bincount(row, weights=val * w[idx], minlength=len(y)) + bias
        r = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * cw
        g = np.append(np.bincount(idx, weights=val * r[row], minlength=len(w)) + 1e-6 * w, r.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
        w -= step[:-1]
        bias -= step[-1]
    z = np.bincount(row, weights=val * w[idx], minlength=len(y)) + bias
    held = ~train
    cal = np.where(y > 0, share / max(1, (y[held] > 0).sum()), (1 - share) / max(1, (y[held] == 0).sum())) * held.sum()
    slope, offset = _platt(z[held], y[held], cal[held])
    return Model(w.astype(np.float32), float(bias), slope, offset)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fits a model on at most ``max_rows`` labelled rows of each class; the class shares come from all labels."""
    y = F.col("quality").cast("int").alias("y")
    known = labels.select(F.col("doc_id").alias("id"), y).where(F.col("id").isNotNull() & F.col("y").isin(0, 1))
    count = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(count) < 2:
        return Model.neutral()
    sample = None
    for k in (0, 1):
        part = known.where(F.col("y") == k).orderBy(F.xxhash64("id"), "id").limit(max_rows)
        sample = part if sample is None else sample.unionByName(part)
    rows = (
        docs.select(F.col("doc_id").alias("id"), F.col("text").alias("t"))
        .join(F.broadcast(sample), "id")  # 2 * max_rows rows at most
        .select("t", "y")
        .mapInArrow(_sparse, "y int, idx array<int>, val array<float>")
        .toArrow()
    )
    got = [
        (int(a), np.asarray(b.values), np.asarray(c.values))
        for a, b, c in zip(rows["y"].to_pylist(), rows["idx"], rows["val"], strict=True)
    ]
    got.sort(key=lambda r: (float(r[2].sum()), len(r[1]), float((r[1] * 1.0 @ r[2])) if len(r[1]) else 0.0))
    return fit(got, count[1] / (count[0] + count[1]))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the base figures, the probability of being good, and whether the document is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for fig, made in base(b.column(1)):
                p = probability(model, *made)
                n = len(p)
                cols = {"doc_id": b.column(0).slice(at, n)} | {k: pa.array(x) for k, x in fig.items()}
                cols["kept"] = pa.array(~fig["base_failed"] & (p >= threshold))
                cols["p_good"] = pa.array(p)
                yield vec.columns(b, cols)
                at += n

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {_FIELDS}, kept boolean, p_good double")


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that the rules keep, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [~fig["base_failed"] & (probability(model, *made) >= threshold) for fig, made in base(b.column(at))]
            if ok:
                yield b.filter(pa.array(np.concatenate(ok)))

    # by place: the mapping resolves names, which fails for those with dots
    placed = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return placed.mapInArrow(run, placed.schema).toDF(*docs.columns)
