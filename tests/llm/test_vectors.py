"""Whitening and importance resampling against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from spanveil.llm import resample, whiten
from tests.llm import data


def plain(rows, k):
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in rows])
    n, s = len(x), x.sum(0)
    d = (n * x - s).astype(float) / n
    e, v = np.linalg.eigh(d.T @ d / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return x, n, s, d, e, v, np.linalg.eigvalsh(d.T @ d / n).sum()


@pytest.mark.parametrize("dims", [3, 40])
def test_whitening(spark, dims):
    rnd = np.random.default_rng(dims)
    shape = rnd.standard_normal((dims, dims)) * np.linspace(1, 4, dims)
    rows = [(i, [float(c) for c in rnd.standard_normal(dims) @ shape]) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 420)]  # a hot vector
    odd = [(500, None), (501, [None] * dims), (502, [float("nan")] * dims), (503, [float("inf")] * dims)]
    df = spark.createDataFrame([(*r, "z") for r in rows + odd], "vec_id long, embedding array<float>, w string").repartition(3)
    out = whiten.whiten(df).collect()
    k = min(8, dims)
    x, n, s, d, e, v, trace = plain(rows, k)
    assert len(out) == n * k and {r["vec_id"] for r in out} == {r[0] for r in rows}
    white = np.zeros((n, k))
    for r in out:
        assert r["n"] == n and r["deviation"] == sum(int(a) ** 2 for a in n * x[r["vec_id"]] - s)
        assert r["explained"] == pytest.approx(e[r["component"] - 1] / trace, rel=1e-9)
        white[r["vec_id"], r["component"] - 1] = r["whitened"]
    want = d @ v / np.sqrt(e)
    sign = np.sign((white * want).sum(0))
    assert np.abs(white - want * sign).max() < 1e-8
    assert out[0]["identity_error"] < 1e-9 and len({r["identity_error"] for r in out}) == 1


def test_lanczos_converges_before_the_space_is_full(spark):
    rnd = np.random.default_rng(4)
    rows = [(i, [float(c) for c in rnd.standard_normal(60) * np.array([2.0**-j for j in range(60)])]) for i in range(200)]
    ints = whiten.integers(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).cache()
    fit = whiten.Fit(ints)
    e, v, passes = whiten.components(ints, fit, 2)
    *_, want, _, _ = plain(rows, 2)
    assert passes < 30 and np.allclose(e, want, rtol=1e-12)
    assert np.abs(v.T @ v - np.eye(2)).max() < 1e-14


def test_whitening_of_few_vectors(spark):
    kind = "vec_id long, embedding array<float>"
    assert whiten.whiten(spark.createDataFrame([], kind)).count() == 0
    same = whiten.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0, 2.0])], kind)).collect()
    assert len(same) == 4 and all(r["whitened"] is None and r["explained"] == 0 and r["deviation"] == 0 for r in same)
    line = whiten.whiten(spark.createDataFrame([(1, [1.0, 2.0, 0.5]), (2, [2.0, 4.0, 0.5]), (3, [2.0, 4.0])], kind)).collect()
    assert sum(r["whitened"] is not None for r in line) == 6  # two directions
    big = whiten.whiten(spark.createDataFrame([(1, [3e38, 1.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0])], kind)).collect()
    assert len(big) == 6 and big[0]["deviation"] is None


def want_sample(docs, target, percent, least, max_n):
    def feats(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", data.lower(t))
        return w, [" ".join(w[i : i + n]) for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s = Counter(bucket(f) for _, t in docs for f in feats(t)[1])
    t_ = Counter(bucket(f) for t in target for f in feats(t)[1])
    S, T = sum(s.values()), sum(t_.values())
    gain = lambda b: math.floor(1000 * math.log((t_[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000))))
    rows = []
    for i, t in docs:
        w, f = feats(t)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(x)) for x in f)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    ready = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for n, r in enumerate(ready[: percent * len(ready) // 100]):
        r[4] = n + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


@pytest.mark.parametrize("max_n", [1, 3])
def test_resampling(spark, max_n):
    rnd = random.Random(3)
    vocab = [rnd.choice(["Alpha", "bêta", "x" * 150, "d3", "naïve"]) + str(i % 40) for i in range(200)]
    docs = [(i, ", ".join(rnd.choice(vocab) for _ in range(rnd.randrange(60)))) for i in range(150)]
    docs += [(200 + i, docs[5][1]) for i in range(70)] + [(r[0], r[1]) for r in data.odd_rows()]
    target = [" ".join(rnd.choice(vocab[:20]) for _ in range(30)) for _ in range(8)] + [None, ""]
    df = spark.createDataFrame([(*r, 1, "k") for r in docs], "doc_id long, text string, weight int, key string").repartition(3)
    tf = spark.createDataFrame([(t,) for t in target], "text string")
    got = sorted((tuple(r) for r in resample.sample(df, tf, 10, 20, max_n).collect()), key=repr)
    assert got == want_sample(docs, target, 10, 20, max_n)
    assert resample.sample(data.empty(spark), tf).count() == 0
    assert resample.sample(df, tf.limit(0)).count() == len(docs)


def test_crc():
    words = [bytes(random.Random(i).randrange(256) for _ in range(i)) for i in range(1, 140)]
    cut = np.append(0, np.cumsum([len(w) for w in words])).astype(np.int64)
    got = resample.crc32(np.frombuffer(b"".join(words), np.uint8), cut[:-1], cut[1:])
    assert got.tolist() == [zlib.crc32(w) for w in words]
    assert len(resample.crc32(np.zeros(0, np.uint8), cut[:0], cut[:0])) == 0
