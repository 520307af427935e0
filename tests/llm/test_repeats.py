"""Suffix-array dedup against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from spanveil.llm import suffix
from tests.llm import data


def removed(texts, span):
    """Which bytes lie in a string of span bytes that starts twice or more."""
    raw = [(t or "").encode() for t in texts]
    count = Counter(t[i : i + span] for t in raw for i in range(len(t) - span + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - span + 1):
            if count[t[i : i + span]] > 1:
                gone[i : i + span] = True
        out.append(gone)
    return raw, out


def expected(rows, span):
    raw, gone = removed([r[1] for r in rows], span)
    out = []
    for r, t, g in zip(rows, raw, gone, strict=True):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], g.astype(int), [0]])))
        out.append((r[0], len(t), tuple(map(tuple, edge.reshape(-1, 2).tolist())), bytes(b for b, x in zip(t, g, strict=True) if not x)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["doc_id"], r["n_bytes"], tuple((x["start"], x["end"]) for x in r["removed"]), bytes(r["kept"])) for r in df.collect()), key=repr)


def made(seed, letters, n=60):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(10, 120))) for _ in range(6)]
    rows = []
    for i in range(n):
        t = list("".join(rnd.choice(base)[rnd.randrange(6) :] for _ in range(rnd.randrange(0, 5))))
        for _ in range(rnd.randrange(3)):
            if t:
                t[rnd.randrange(len(t))] = rnd.choice(letters)
        rows.append((i, "".join(t)))
    # one passage in a third of all rows, with other text around it; near copies; rows repeated with their id; nulls
    rows += [(100 + i, "".join(rnd.choice(letters) for _ in range(20)) + base[0] + "".join(rnd.choice(letters) for _ in range(20))) for i in range(n // 2)]
    rows += [(7, base[1])] * 3 + [(None, base[2])] * 2 + [(None, None), (8, ""), (9, "é" * 30), (9, "x" * 50)]
    return rows


@pytest.mark.parametrize(("seed", "letters", "span", "limit"), [(1, "ab", 24, 1000), (2, "abcdé", 12, 3), (3, "abcdefgh", 16, 1)])
def test_all_repeats_go(spark, seed, letters, span, limit):
    rows = made(seed, letters)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(suffix.dedup(docs, span, limit)) == expected(rows, span)


def test_odd_rows(spark):
    rows = [(r[0], r[1]) for r in data.odd_rows()]
    assert got(suffix.dedup(data.odd(spark))) == expected(rows, 200)
    assert suffix.dedup(data.empty(spark)).count() == 0
    assert suffix.groups(data.empty(spark)).count() == 0


def test_groups_name_equal_texts(spark):
    rows = made(5, "abcdefgh")
    raw = {r[0]: (r[1] or "").encode() for r in rows}
    found = suffix.groups(spark.createDataFrame(rows, "doc_id long, text string").where("doc_id is not null and doc_id not in (7, 8, 9)"), 16).collect()
    by = {}
    for r in found:
        by.setdefault(r["repeat"], set()).add(raw[r["doc_id"]][r["start"] : r["end"]])
    assert by and all(len(x) == 1 and len(next(iter(x))) >= 16 for x in by.values())


def test_intervals():
    # suffixes of banana by first letters: a, ana, anana, banana, na, nana
    common, before = [0, 1, 3, 0, 0, 2], [ord("n"), ord("n"), ord("b"), -1, ord("a"), ord("a")]
    assert sorted(suffix.intervals(common, before, 1)) == [(1, 0, 2), (3, 1, 2)]  # na always follows a


def test_pieces_do_not_matter(spark, monkeypatch):
    rows = made(9, "abcdefgh")
    data_ = np.frombuffer("".join(r[1] or "" for r in rows).encode(), np.uint8)
    offs = np.append(0, np.cumsum([len((r[1] or "").encode()) for r in rows])).astype(np.int64)

    def strings(piece):
        monkeypatch.setattr(suffix, "_PIECE", piece)
        return {(r, s + j, h) for rs, hs, _, ss, ns in suffix.contexts(data_, offs, 16) for r, h, s, n in zip(rs.tolist(), hs.tolist(), ss.tolist(), ns.tolist(), strict=True) for j in range(n)}

    assert strings(1 << 18) == strings(100)


def hot(seed, n, size):
    """One passage in every row, among text of its own, of one of few edges, or of another's."""
    rnd = random.Random(seed)
    some = lambda k, letters="abcdefgh ": "".join(rnd.choice(letters) for _ in range(k))
    passage, edges = some(2 * size), [some(size // 6) for _ in range(5)]
    rows = []
    for i in range(n):
        cut = rnd.choice([0, 0, rnd.randrange(size // 4)])
        rows.append((i, some(size // 2) + rnd.choice([*edges, "", some(3)]) + passage[cut : 2 * size - rnd.choice([0, cut])] + rnd.choice([*edges, "", some(2)]) + some(size // 2)))
    return rows + [(n + i, some(size) + "é" * rnd.randrange(size, 2 * size)) for i in range(9)] + [(n + 20, rows[0][1])]


def most_rows(spark, since):
    """Rows of the largest join, generator or Arrow function of the executions after ``since``."""
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    runs, most = store.executionsList(), 0
    for i in range(runs.size()):
        if (run := runs.apply(i)).executionId() > since:
            values, nodes = store.executionMetrics(run.executionId()), store.planGraph(run.executionId()).allNodes()
            for k in range(nodes.size()):
                node = nodes.apply(k)
                for m in range(node.metrics().size()) if any(x in node.name() for x in ("Join", "Generate", "Arrow")) else ():
                    metric = node.metrics().apply(m)
                    if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                        most = max(most, int(values.apply(metric.accumulatorId()).replace(",", "")))
    return most


@pytest.mark.parametrize(("seed", "span"), [(1, 200), (2, 40), (3, 13)])
def test_large_buckets(spark, seed, span):
    rows = hot(seed, 150, span)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = expected(rows, span)
    for limit in (1, 20):
        assert got(suffix.dedup(docs, span, limit)) == want


def test_a_large_bucket_is_no_row_for_each_string(spark):
    rows = hot(4, 600, 200)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    since = max([runs.apply(i).executionId() for i in range(runs.size())], default=-1)
    assert suffix.dedup(docs, 200, 32).count() == len(rows)
    strings = sum(len(r[1].encode()) - 199 for r in rows)
    assert most_rows(spark, since) < strings / 4


def arrow_rows(spark, since, name):
    """Rows of all Arrow functions with a column of that name in the executions after ``since``."""
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    runs, rows = store.executionsList(), 0
    for i in range(runs.size()):
        if (run := runs.apply(i)).executionId() > since:
            values, nodes = store.executionMetrics(run.executionId()), store.planGraph(run.executionId()).allNodes()
            for k in range(nodes.size()):
                node = nodes.apply(k)
                for m in range(node.metrics().size()) if node.name() == "MapInArrow" and name in node.desc() else ():
                    metric = node.metrics().apply(m)
                    if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                        rows += int(values.apply(metric.accumulatorId()).replace(",", ""))
    return rows


def test_blocks_of_a_large_bucket_grow_with_its_contexts(spark):
    def made(n):
        docs = spark.createDataFrame(hot(4, n, 200), "doc_id long, text string").repartition(3)
        runs = spark._jsparkSession.sharedState().statusStore().executionsList()
        since = max([runs.apply(i).executionId() for i in range(runs.size())], default=-1)
        assert suffix.dedup(docs, 200, 32).count() == n + 10
        return arrow_rows(spark, since, "own#")

    few, many = made(300), made(600)
    assert 0 < many < min(2.5 * few, 40_000)  # of 266,945 strings; blocks of all widths together


def test_groups_of_large_buckets_name_equal_texts(spark):
    span = 40
    rows = hot(5, 60, span)
    texts = {k: t.encode() for k, t in rows}
    found = suffix.groups(spark.createDataFrame(rows, "doc_id long, text string"), span, 20).collect()
    names, gone = {}, {k: bytearray(len(t)) for k, t in texts.items()}
    for r in found:
        part = texts[r["doc_id"]][r["start"] : r["end"]]
        assert len(part) >= span and names.setdefault(r["repeat"], part) == part
        gone[r["doc_id"]][r["start"] : r["end"]] = b"\1" * len(part)
    assert len(set(names.values())) == len(names)
    assert [sum(v) for v in gone.values()] == [sum(g) for g in removed([t for _, t in rows], span)[1]]
