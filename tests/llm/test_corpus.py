"""Operators that look at all rows together: search, language model, near copies, mixing, line dedup, and the pipeline."""

import math
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanveil.llm import linedup, maxent, mixing, nearcopy, topk
from tests.llm import data


def test_topk_is_exact(spark):
    rnd = random.Random(6)
    common = [rnd.uniform(-1, 1) for _ in range(6)]
    rows = [(i, common if i % 3 == 0 else [rnd.uniform(-1, 1) for _ in range(6)]) for i in range(400)]
    rows += [(400, None), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (None, common)]
    v = topk.integers(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    import numpy as np

    whole = {i: [math.floor(1024 * float(np.float32(c))) for c in x] for i, x in rows[:400]}
    want = set()
    for q in range(0, 400, 100):
        order = sorted(((-sum(a * b for a, b in zip(whole[q], x)), i) for i, x in whole.items() if i != q))[:10]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(order)}
    for block in (10_000, 90):
        assert {tuple(r) for r in topk.search(v, v.where("id % 100 = 0"), 10, block).collect()} == want
    assert topk.search(v.limit(0), v.limit(0)).count() == 0
    assert topk.search(v.where("id in (1, 100)"), v.where("id = 100")).count() == 1


def test_topk_stops_early():
    import numpy as np

    x = np.zeros((2000, 3), np.int64)
    x[:, 0] = np.arange(2000)
    lists = topk.Lists(np.arange(2000), x, 3)
    met = []
    score = lists.scores
    lists.scores = lambda rows, q: met.append(len(rows)) or score(rows, q)
    ids, s = lists.top(np.array([5, 0, 0]), -1)
    assert ids.tolist() == [1999, 1998, 1997] and sum(met) < 200


def test_maxent_base_and_sum(spark):
    docs = data.odd(spark)
    toks = [([*map(data.lower, data.words(r[1])), "\0"], zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 10 == 0) for r in data.odd_rows()]
    count = Counter(w for t, held in toks if not held for w in t)
    n, v = sum(count.values()), len(count)
    want = sorted((held, len(t), sum(count[w] > 0 for w in t), round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 4)) for t, held in toks)
    for hot in (maxent.HOT, 0.05):  # counts found in the batch, or by the join
        got = maxent.score(docs, hot).collect()
        assert sorted((r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in got) == want
        assert {r["train_tokens"] for r in got} == {n} and all(math.isfinite(r["score"]) for r in got)
    assert maxent.score(data.empty(spark)).count() == 0


def test_maxent_learns_order(spark):
    rows = [(i, " ".join(["alpha beta gamma delta"] * 30)) for i in range(60)]
    got = maxent.score(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    assert got and all(r["score"] > r["base_score"] + 5 for r in got)


def _pairs_of_words(n):
    rnd = random.Random(3)
    return [(i, " ".join(f"left{k} right{k}" for k in (rnd.randrange(200) for _ in range(40)))) for i in range(n)]


def test_maxent_scores_do_not_depend_on_partitions(spark):
    docs = spark.createDataFrame(_pairs_of_words(200), "doc_id long, text string")
    some, other = ({r["doc_id"]: r["score"] for r in maxent.score(docs.repartition(n)).collect()} for n in (3, 7))
    assert some.keys() == other.keys() and all(math.isclose(some[i], other[i], abs_tol=1e-2) for i in some)


def test_maxent_learns_words_within_classes(spark):
    # a right word follows its left word alone: to know it takes the branches, as classes hold many words
    got = maxent.score(spark.createDataFrame(_pairs_of_words(600), "doc_id long, text string")).where("held_out").collect()
    gain = sum(r["score"] - r["base_score"] for r in got) / sum(r["n_tokens"] for r in got)
    assert gain > 0.5


def test_maxent_gradients_are_summed_by_row_at_the_cost_of_the_weights():
    rng = np.random.default_rng(3)
    spent = []
    for n, rows, choices in ((16_384, 4_096, maxent.CLASSES), (500, 4_096, maxent.BRANCHES), (0, 4_096, maxent.BRANCHES)):
        f = rng.integers(rows, size=(3, n)).astype(np.uint16)
        f[0, ::2] = 7  # a frequent word
        w, start = rng.normal(0, 0.3, (3, rows, choices)).astype(np.float32), np.zeros((1, choices), np.float32)
        g = rng.normal(0, 1, (n, choices)).astype(np.float32)
        total, seen = np.zeros((3, choices, rows)), np.zeros((3, rows))
        maxent._gather(total, seen, f, g)
        for k in range(3):
            want = np.zeros((rows, choices))
            np.add.at(want, f[k], g)
            assert np.allclose(total[k].T, want, atol=1e-9)
            assert (seen[k] == np.bincount(f[k], minlength=rows)).all()
        if not spent:  # the best of some, so that a busy machine does not matter
            for work in (lambda: maxent._weights(w, f, start), lambda: maxent._gather(total, seen, f, g)):
                times = []
                for _ in range(15):
                    since = time.process_time()
                    work()
                    times.append(time.process_time() - since)
                spent.append(min(times))
    assert spent[1] < 3 * spent[0]


def test_maxent_batches_cost_little_more_than_their_looking_up_and_counting():
    rng = np.random.default_rng(4)
    n, rows, choices = 16_384, 4_096, maxent.CLASSES
    f = rng.integers(rows, size=(3, n)).astype(np.uint16)
    at = f.astype(np.intp)
    w, start = rng.normal(0, 0.3, (3, rows, choices)).astype(np.float32), np.zeros((1, choices), np.float32)
    g = rng.normal(0, 1, (n, choices)).astype(np.float32)
    total, seen, columns = np.zeros((3, choices, rows)), np.zeros((3, rows)), g.T.astype(np.float64, order="C")

    def looked_up():
        z = w[0].take(at[0], axis=0)
        z += w[1].take(at[1], axis=0)
        z += w[2].take(at[2], axis=0)
        return np.exp(z, out=z)

    def counted():
        for r in at:
            for column in columns:
                np.bincount(r, column, rows)

    best = [math.inf] * 4
    for _ in range(15):  # by turns, and the best of some, so that a busy machine does not matter
        for k, work in enumerate((lambda: maxent._weights(w, f, start), looked_up, lambda: maxent._gather(total, seen, f, g), counted)):
            since = time.process_time()
            work()
            best[k] = min(best[k], time.process_time() - since)
    assert best[0] + best[2] < 1.9 * (best[1] + best[3])


def test_maxent_weights_of_any_size():
    rng = np.random.default_rng(5)
    rows, choices = 50, maxent.BRANCHES
    for spread in (0.5, 30, 300):  # the last two beyond what powers in single precision hold
        w = rng.normal(0, spread, (3, rows, choices)).astype(np.float32)
        for n in (0, 1, 9_000):
            f, start = rng.integers(rows, size=(3, n)).astype(np.uint16), rng.normal(0, 1, (n, choices)).astype(np.float32)
            z = start + w[0][f[0]] + w[1][f[1]] + w[2][f[2]].astype(np.float64)
            want = np.exp(z - z.max(1, keepdims=True, initial=-np.inf))
            got, sums = maxent._weights(w, f, start)
            assert got.shape == (n, choices) and np.isfinite(got).all() and np.isfinite(sums).all()
            assert np.allclose(got / sums, want / want.sum(1, keepdims=True), rtol=1e-4 * max(1, spread), atol=1e-6)


def test_maxent_score_is_the_plain_sum(spark):
    import numpy as np
    from spanveil.llm import vec

    docs = spark.createDataFrame(_pairs_of_words(60), "doc_id long, text string")
    table = maxent.counts(docs).cache()
    count = {r["word"]: r["c"] for r in table.collect()}
    voc = maxent.vocabulary(table)
    w = maxent.train(docs, voc)
    singles = set(voc.word[voc.single >= 0].view(np.int64).tolist())

    def softmax(z):
        top = max(z)
        z = [math.exp(x - top) for x in z]
        return [x / sum(z) for x in z]

    for r in maxent.score(docs).where("doc_id < 6").collect():
        data_, offs = vec.utf8(maxent.pa.array([dict(_pairs_of_words(60))[r["doc_id"]]]))
        tok, row = maxent._tokens(data_, offs)
        h, y = maxent._context(tok, row), voc.classes(tok, *voc.find(tok))
        want = 0.0
        for j, t in enumerate(tok.view(np.int64).tolist()):
            at = [int(x) >> (64 - maxent.BITS) for x in h[:, j]]
            want += math.log10(softmax([math.log(voc.share[c]) + sum(float(w[0][k][at[k]][c]) for k in range(3)) for c in range(maxent.CLASSES)])[y[j]])
            c = count.get(t, 0) + 0.1
            if t in singles:
                want += math.log10(c / voc.below[y[j]])
                continue
            for level, shares in enumerate(voc.branch):
                node = int(maxent._node(tok[j : j + 1], level)[0])
                own = vec.mix(np.array([node], np.uint64) + np.uint64((level + 1) << 56))
                at = [int(vec.mix(h[k, j : j + 1] + own)[0]) >> (64 - voc.bits) for k in range(3)]
                z = [float(shares[node][b]) + sum(float(w[1][k][at[k]][b]) for k in range(3)) for b in range(maxent.BRANCHES)]
                want += math.log10(softmax(z)[int(maxent._node(tok[j : j + 1], level + 1)[0]) % maxent.BRANCHES])
            want += math.log10(c / voc.below[maxent.SINGLE + int(maxent._node(tok[j : j + 1], len(voc.branch))[0])])
        assert math.isclose(r["score"], want, rel_tol=1e-3)


def test_near_copies(spark):
    rnd = random.Random(8)
    docs, n = [], 0
    for f in range(12):
        base = [f"w{rnd.randint(0, 5000)}" for _ in range(150)]
        for _ in range(4):
            t = list(base)
            t[rnd.randrange(150)] = "edit"
            docs.append((n, " ".join(t)))
            n += 1
    shared = " ".join(f"s{i}" for i in range(40))
    docs += [(n + i, shared + " " + " ".join(f"u{rnd.randint(0, 9000)}" for _ in range(120))) for i in range(40)]
    got = {r["doc_id"]: r["class_id"] for r in nearcopy.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(got[i] == 4 * (i // 4) for i in range(48)) and all(got[i] == i for i in range(48, 88))


def test_near_copies_of_one_large_family(spark):
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    docs = []
    for i in range(150):
        t = list(base)
        t[rnd.randrange(200)] = f"e{i}"
        docs.append((i, " ".join(t)))
    got = nearcopy.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r["class_id"], r["class_size"]) for r in got} == {(0, 150)}


def _classes_by_all_pairs(docs):
    import pyarrow as pa

    from spanveil.llm import vec

    labelled = [(i, nearcopy._labelled(*vec.utf8(pa.array([t])), nearcopy.WORDS)[0]) for i, t in docs]
    root = {i: i for i, _ in docs}
    for k, (i, a) in enumerate(labelled):
        for j, b in labelled[:k]:
            if root[i] != root[j] and nearcopy.similarity(a, b) >= nearcopy.SIMILARITY:
                lo, hi = sorted((root[i], root[j]))
                root = {x: lo if r == hi else r for x, r in root.items()}
    return root


def test_near_copies_of_large_families_below_the_leader(spark):
    rnd = random.Random(1)
    docs, t = [], [f"w{i}" for i in range(240)]
    for i in range(40):  # each near the one before, the ends far apart
        docs.append((i, " ".join(t)))
        for q in rnd.sample(range(240), 2):
            t[q] = f"c{i}x{q}"
    for i in range(100):  # variants of an absent text, many pairs about as similar as the threshold
        t = [f"v{q}" for q in range(200)]
        for q in rnd.sample(range(200), 3 + i % 2):
            t[q] = f"d{i}x{q}"
        docs.append((1000 + i, " ".join(t)))
    rnd.shuffle(docs)
    want = _classes_by_all_pairs(docs)
    assert all(want[i] == 0 for i in range(40))
    got = {r["doc_id"]: r["class_id"] for r in nearcopy.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want


def test_near_copies_odd_rows(spark):
    df = data.odd(spark)
    got = defaultdict(set)
    for r in nearcopy.report(df).collect():
        got[r["class_id"]].add(r["doc_id"])
    assert {1, 2, 3} in got.values() and {4, 5} in got.values() and {12} in got.values()
    kept = nearcopy.keep_one(df)
    assert kept.columns == df.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(min(c)) if None not in c else "None" for c in got.values())
    assert nearcopy.report(data.empty(spark)).count() == 0


def test_similarity_is_aligned():
    import numpy as np

    a = np.arange(100, dtype=np.uint64)
    assert nearcopy.similarity(a, a) == 1.0
    assert nearcopy.similarity(a, np.concatenate([a[50:], a[:50]])) < 0.5
    assert nearcopy.similarity(a, np.concatenate([a[:95], a[95:] + 1000])) == 95 / 105


def test_line_dedup_matches_a_scan(spark):
    rnd = random.Random(3)
    rows = [(i, "\n".join(rnd.choice(["a b c", "d", "e f", "", "x y z q"]) for _ in range(rnd.randint(0, 12)))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["removed"] for r in linedup.report(docs, 9).collect()}
    assert [got[i] for i in range(40)] == data.runs_to_delete([t for _, t in rows], 9)


def test_line_dedup_odd_rows(spark):
    df = data.odd(spark)
    got = {r["doc_id"]: r["removed"] for r in linedup.report(df).collect()}
    assert got[9] == [] and got[10] == [2, 3, 4, 5] and got[1] == [] and got[2] == [0] and got[4] == [] and got[12] == []
    kept = linedup.clean(df)
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert kept.columns == df.columns and 2 not in texts and texts[10] == "other head\n\nmore" and texts[4] is None and texts[5] == ""
    assert linedup.report(data.empty(spark)).count() == 0


def _targets(size):
    """Water filling by repeated sharing."""
    names = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in size else [])
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    got, free, left = {}, set(names), float(sum(size.values()))
    while free:
        share = left / sum(w[s] for s in free)
        over = {s for s in free if w[s] * share > 3 * size[s]}
        if not over:
            got |= {s: w[s] * share for s in free}
            break
        got |= {s: 3.0 * size[s] for s in over}
        left -= sum(3 * size[s] for s in over)
        free -= over
    return got


@pytest.mark.parametrize("n", [30, 3000])
def test_mixing_meets_targets(spark, n):
    rnd = random.Random(n)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 200)), "hot" if rnd.random() < 0.4 else rnd.choice(["a", "b", "é", None])) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.assign(docs).select("doc_id", "source", F.col("_mix_size").alias("size"), F.col("_mix_target").alias("target"), F.col("_mix_takes").alias("takes")).collect()
    size, taken = Counter(), Counter()
    for r in got:
        assert r["size"] == len(r and rows[r["doc_id"]][1].split()) and len(r["takes"]) <= 3
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * len(r["takes"])
    want = _targets(size)
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
    assert all(abs(taken[s] - want[s]) <= (0.02 * want[s] if n > 1000 else 101) for s in want)
    again = mixing.assign(docs.repartition(7)).select("doc_id", "_mix_takes").collect()
    assert {r["doc_id"]: r["takes"] for r in got} == {r["doc_id"]: r["_mix_takes"] for r in again}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(len(r["takes"]) for r in got)


def test_mixing_splits_quotas_exactly(spark):
    b = spark.createDataFrame([(k, i, k % 3, True, False) for k in range(1, 4) for i in range(40 * k)], "rank int, block int, passes int, whole boolean, cut boolean")
    runs = mixing.tree(b, 8).collect()
    quota = {k: 40 * k * (k % 3 + 1) for k in range(1, 4)}
    by_shard = Counter()
    for k, q in quota.items():
        own = sorted((r["first"], r["last"]) for r in runs if r["rank"] == k)
        assert [x for a, z in own for x in range(a, z + 1)] == list(range(1, q + 1))
    for r in runs:
        by_shard[r["shard"]] += r["last"] - r["first"] + 1
    assert max(by_shard.values()) - min(by_shard.values()) <= 3 and len(by_shard) == 8


def test_mixing_draw_is_hypergeometric(spark):
    col = mixing._draw(F.lit(50).cast("long"), F.lit(20).cast("long"), F.lit(15).cast("long"), F.rand(3))
    got = Counter(r[0] for r in spark.range(4000).select(col.alias("x")).collect())
    for x in range(2, 11):
        p = math.comb(15, x) * math.comb(35, 20 - x) / math.comb(50, 20)
        assert abs(got[x] / 4000 - p) < 0.03


def test_mixing_odd_rows(spark):
    df = data.odd(spark)
    assert mixing.mix(df).columns == df.columns
    got = mixing.assign(df).collect()
    assert len(got) == df.count() and all(len(r["_mix_takes"]) == 0 for r in got if r["_mix_size"] == 0)
    assert mixing.mix(data.empty(spark)).count() == 0


def test_pipeline_runs_its_stages(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(5)
    good = lambda: " ".join(f"t{rnd.randint(0, 4000)}" for _ in range(90))
    rows = [(i, good(), "en", f"s{i % 4}", 1) for i in range(80)]
    rows += [(100 + i, " ".join(f"junk{rnd.randint(0, 900)}###" for _ in range(90)), "en", "s0", 1) for i in range(40)]
    rows += [(200, rows[0][1], "en", "s1", 1), (201, "too short", "en", "s1", 1), (202, None, None, None, None)]
    d = str(tmp_path)
    spark.createDataFrame(rows, data.KIND).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] < 100), 0) for r in rows if r[0] < 140], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = set()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{d}/{k}")
        docs = spark.read.parquet(f"{d}/{k}")
        names.add(name)
        if name == "near_dedup":
            assert {r["doc_id"] for r in docs.collect()} == set(range(80))
    assert len(names) == 5 and docs.where("NOT lossless").count() == 0 and docs.count() > 40
    assert corpus_pipeline.run(spark, d).count() == docs.count()


def test_mixing_of_many_small_sources(spark):
    # with so many sources, some are cut before the first key of their block
    docs = spark.range(1800).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.floor(F.col("id") / 3).cast("string")).alias("source"), F.repeat(F.lit("w "), (F.pmod("id", F.lit(3)) * 40 + 5).cast("int")).alias("text"))
    got = mixing.assign(docs).select(F.col("_mix_size").alias("size"), F.col("_mix_target").alias("target"), F.size("_mix_takes").alias("n")).collect()
    assert len(got) == 1800 and all(0 <= r["n"] <= 3 for r in got)
    assert abs(sum(r["size"] * r["n"] for r in got) / sum(r["target"] / 3 for r in got) - 1) < 0.1
