"""Near copies by order MinHash, verified by banded alignment.

A text's 5-word k-mers are labelled with their occurrence number. Each of
``SKETCHES`` hash orders picks the ``ELL`` smallest labelled k-mers of a text and
keeps them in text order: two texts agree in a sketch with a chance that falls
with edits and with reordering. Equal texts are one node, so copies cost no
pairs. Texts that share a sketch are candidates: all pairs of a bucket of up to
``ALL_PAIRS`` texts; in a larger bucket each text with the text that shares most
sketches of all. Texts of a larger bucket that these links leave in several
classes are then all compared across classes, in blocks: common k-mers are
counted by matrix products, and only links that join two classes come out.
Candidates are verified on whole texts: common labelled k-mers within a band around the diagonal are
aligned (longest common subsequence), and aligned / (all - aligned) must reach
``SIMILARITY``. Linked texts form classes (connected components by large-star and
small-star rounds over the links).

Edge cases: a null text counts as empty; all empty texts are copies of each
other; texts of fewer than five words are one k-mer; rows of equal text are one
class; ties go to the smaller doc_id; a null id is last; an empty table gives an
empty result; further columns pass through ``keep_one`` as they are.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.cluster import checkpoint
from spanveil.llm import vec

WORDS = 5
SIMILARITY = 0.8
SKETCHES = 12
ELL = 3
ALL_PAIRS = 12
#: Candidate texts up to which their ids are broadcast to fetch the texts; beyond, they are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Texts, and bytes of them, in a block of a large bucket, about; and k-mers that are counted at once.
BLOCK = 512
BLOCK_BYTES = 8_000_000
COLUMNS = 2048
#: Width of the band, as a share of the longer text's k-mers, on either side.
BAND = 0.25

_U = np.uint64
_MAX = _U(0xFFFFFFFFFFFFFFFF)


def text_id(text):
    """A node for each distinct text."""
    return F.xxhash64(F.coalesce(text, F.lit("")), F.lit(11))


def _labelled(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the occurrence-labelled k-mers, and their texts, in text order."""
    s, e, row = vec.runs(~vec.SPACE[data], offs)
    h = vec.hash_runs(data, s, e)
    n = len(offs) - 1
    count = np.bincount(row, minlength=n)
    short = np.flatnonzero((count > 0) & (count < k))
    g, at = vec.grams(h, row, k)
    r = row[at]
    if len(short):
        first = np.cumsum(count) - count
        g2 = np.array([int(vec.mix(np.array([(h[first[i] : first[i] + count[i]] * _U(0x9E3779B97F4A7C15) ** np.arange(1, count[i] + 1, dtype=_U)).sum() + _U(count[i])], _U))[0]) for i in short], _U)
        g, r = np.concatenate([g, g2]), np.concatenate([r, short])
        order = np.argsort(r, kind="stable")
        g, r = g[order], r[order]
    key = g ^ vec.mix(r.astype(_U) + _U(1))
    order = np.argsort(key, kind="stable")
    ks = key[order]
    new = np.flatnonzero(np.concatenate([[True], ks[1:] != ks[:-1]])) if len(ks) else np.zeros(0, np.int64)
    nth = np.zeros(len(ks), np.int64)
    nth[order] = np.arange(len(ks)) - np.repeat(new, np.diff(np.append(new, len(ks))))
    again = nth > 0
    g[again] = vec.mix(g[again] + nth[again].astype(_U))
    return g, r


def _sketch(lab: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have k-mers, and their sketches (rows x SKETCHES)."""
    count = np.bincount(row, minlength=n)
    have = np.flatnonzero(count)
    count = count[have]
    start = np.cumsum(count) - count
    out = np.zeros((len(have), SKETCHES), _U)
    if not len(have):
        return have, out
    for k in range(SKETCHES):
        v = lab * (vec.seed(77, k) | _U(1))
        v ^= v >> _U(29)
        v *= vec.seed(78, k) | _U(1)
        places = np.full((ELL, len(have)), np.iinfo(np.int64).max)
        for t in range(ELL):
            low = np.minimum.reduceat(v, start)
            at = np.flatnonzero(v == np.repeat(low, count))
            which = np.searchsorted(start, at, "right") - 1
            first = np.flatnonzero(np.diff(which, prepend=-1))
            at, which = at[first], which[first]
            ok = low[which] != _MAX
            places[t, which[ok]] = at[ok]
            v[at] = _MAX
        places.sort(axis=0)
        acc = np.full(len(have), vec.seed(79, k), _U)
        for t in range(ELL):
            ok = places[t] < len(lab)
            acc[ok] = acc[ok] * _U(0x9E3779B97F4A7C15) + lab[places[t][ok]]
        out[:, k] = vec.mix(acc)
    return have, out


def sketches(docs: DataFrame) -> DataFrame:
    """tid, doc_id and the sketches of each row (none for texts without words)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in vec.chunks(b.column(2)):
                n = j - i
                have, sk = _sketch(*_labelled(data, offs, WORDS), n)
                count = np.zeros(n, np.int64)
                count[have] = SKETCHES
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, n), b.column(1).slice(i, n), vec.lists(sk.reshape(-1).view(np.int64), count)],
                    names=["tid", "doc_id", "sk"],
                )

    return docs.select(text_id(F.col("text")).alias("tid"), "doc_id", "text").mapInArrow(run, f"tid long, doc_id {kind}, sk array<long>")


def _bucket_pairs(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Pairs of texts that share a bucket: all pairs of small buckets, and the pairs of large ones with their leader; and the rows in large buckets."""
    # kept apart from the rows, so that Spark may split a large bucket's part of the join
    size = checkpoint(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max_by("tid", F.struct("support", "tid")).alias("leader")).where(F.col("n") > 1))
    placed = checkpoint(rows.join(size, keys))  # what follows needs small buckets together only
    few = placed.where(F.col("n") <= ALL_PAIRS).groupBy(*keys).agg(F.sort_array(F.collect_list("tid")).alias("t"))
    few = few.select(F.explode(F.flatten(F.transform("t", lambda x, i: F.transform(F.slice("t", F.lit(1), i), lambda y: F.struct(y.alias("a"), x.alias("b")))))).alias("p")).select("p.*")
    many = placed.where(F.col("n") > ALL_PAIRS)
    star = many.where(F.col("tid") != F.col("leader")).select(F.least("tid", "leader").alias("a"), F.greatest("tid", "leader").alias("b"))
    return few.unionByName(star), many.drop("n", "leader")


def candidates(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """a, b: distinct candidate pairs of the texts (tid, sk); and the rows (s, key, tid) in large buckets."""
    rows = texts.select("tid", F.posexplode("sk").alias("s", "key")).select("tid", F.col("s").cast("byte").alias("s"), "key")
    n = checkpoint(rows.groupBy("s", "key").agg(F.count("*").alias("n")).where(F.col("n") > 1))
    shared = checkpoint(rows.join(n, ["s", "key"]))
    support = shared.groupBy("tid").agg(F.sum("n").alias("support"))
    pairs, large = _bucket_pairs(checkpoint(shared.drop("n").join(support, "tid")), ["s", "key"])
    return pairs.distinct(), large.select("s", "key", "tid")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Aligned k-mers within the band, over all: of two texts' labelled k-mers (each distinct in its text)."""
    n, m = len(a), len(b)
    if not n or not m:
        return float(n == m)
    if min(n, m) < SIMILARITY * max(n, m):
        return 0.0
    oa, ob = np.argsort(a), np.argsort(b)
    at = np.searchsorted(b[ob], a[oa])
    at[at == m] = m - 1
    hit = b[ob][at] == a[oa]
    pa_, pb = oa[hit], ob[at[hit]]
    inside = np.abs(pa_ - pb) <= max(8, int(BAND * max(n, m)))
    pa_, pb = pa_[inside], pb[inside]
    if len(pa_) < SIMILARITY * (n + m - len(pa_)):
        return len(pa_) / (n + m - len(pa_))
    line = pb[np.argsort(pa_)]
    if len(line) > 1 and (np.diff(line) <= 0).any():
        tails: list[int] = []
        for x in line.tolist():
            k = bisect_left(tails, x)
            if k == len(tails):
                tails.append(x)
            else:
                tails[k] = x
        c = len(tails)
    else:
        c = len(line)
    return c / (n + m - c)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for lo in range(0, len(whole), 200):
            b = whole.slice(lo, 200)
            sides = []
            for c in (2, 3):
                data, offs = vec.utf8(b.column(c))
                lab, row = _labelled(data, offs, WORDS)
                sides.append((lab, np.searchsorted(row, np.arange(len(b) + 1))))
            (la, ca), (lb, cb) = sides
            ok = [similarity(la[ca[i] : ca[i + 1]], lb[cb[i] : cb[i + 1]]) >= SIMILARITY for i in range(len(b))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok))


def fetch(docs: DataFrame, texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """tid and text of the candidate texts. texts: tid and least, the id of one row of each text.

    Only that row's text is fetched: copies of one text, however many, never meet.
    """
    used = checkpoint(pairs.select(F.explode(F.array("a", "b")).alias("tid")).distinct().join(texts.select("tid", "least"), "tid"))
    used = used.select(F.col("tid").alias("_tid"), F.col("least").alias("_id"))
    rows = docs.select(text_id(F.col("text")).alias("tid"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    few = used.count() <= BROADCAST_ROWS
    own = rows.join(F.broadcast(used) if few else used, (F.col("tid") == F.col("_tid")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    return checkpoint(own.groupBy("tid").agg(F.first("text").alias("text")))


def links(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The candidate pairs whose whole texts (tid, text) are similar."""
    return (
        pairs.join(texts.select(F.col("tid").alias("a"), F.col("text").alias("ta")), "a")
        .join(texts.select(F.col("tid").alias("b"), F.col("text").alias("tb")), "b")
        .select("a", "b", "ta", "tb")
        .mapInArrow(_verify, "a long, b long")
    )


def _across(t: pa.Table) -> pa.Table:
    """Links between the classes of two blocks of a bucket: enough of them to join all classes that similar texts join.

    Common k-mers of all pairs are counted by products of incidence matrices, some columns at a time; a pair of
    different classes that has enough of them is verified unless earlier links have joined its classes.
    """
    t = t.sort_by("tid")
    tid, root = np.asarray(t["tid"]), np.asarray(t["root"])
    labels, n = [], []
    for i, j, data, offs in vec.chunks(t["text"].combine_chunks()):
        g, row = _labelled(data, offs, WORDS)
        n.append(np.bincount(row, minlength=j - i))
        labels += np.split(g, np.cumsum(n[-1])[:-1])
    n = np.concatenate(n)
    word, which, freq = np.unique(np.concatenate(labels), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(n)), n)
    column = np.where(freq > 1, np.cumsum(freq > 1) - 1, -1)[which]
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    own, lo, hi = np.asarray(t["own"]), t["lo"][0].as_py(), t["hi"][0].as_py()
    one, two = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
    common = np.zeros((len(one), len(two)), np.float32)
    for at in range(0, int((freq > 1).sum()), COLUMNS):
        x, y = np.searchsorted(column, [at, at + COLUMNS])
        m = np.zeros((len(n), COLUMNS), np.float32)
        m[row[x:y], column[x:y] - at] = 1
        common += m[one] @ m[two].T
    enough = common >= SIMILARITY / (1 + SIMILARITY) * (n[one][:, None] + n[two][None]) - 1e-4
    enough &= root[one][:, None] != root[two][None]
    if lo == hi:
        enough = np.triu(enough)
    up = {int(x): int(x) for x in set(root.tolist())}

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    links = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(enough)), strict=True):
        i, j = one[i], two[j]
        x, y = top(int(root[i])), top(int(root[j]))
        if x != y and similarity(labels[i], labels[j]) >= SIMILARITY:
            up[x] = y
            links.append((int(tid[i]), int(tid[j])))
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def joined(large: DataFrame, texts: DataFrame, roots: DataFrame) -> DataFrame:
    """roots (tid, root), after all similar pairs of large buckets (s, key, tid) whose texts lie in several classes.

    The texts of such a bucket are dealt by a hash into blocks of bounded rows and bytes, and each pair of blocks is
    one group: no pair of texts is a row, and what is emitted is at most one link for each text of a group.
    """
    rows = large.join(roots, "tid", "left").withColumn("root", F.coalesce("root", "tid"))
    mixed = rows.groupBy("s", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where(F.col("lo") != F.col("hi"))
    rows = checkpoint(rows.join(mixed.select("s", "key"), ["s", "key"]))
    if rows.isEmpty():
        return roots
    texts = texts.select("tid", "text", F.octet_length("text").alias("bytes"))
    size = rows.join(texts.select("tid", "bytes"), "tid").groupBy("s", "key").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    dealt = rows.join(checkpoint(size), ["s", "key"]).withColumn("own", F.pmod(F.xxhash64("tid", F.lit(17)), F.col("blocks")).cast("int"))
    dealt = dealt.join(texts.select("tid", "text"), "tid").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("s", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "tid", "root", "text")
    new = checkpoint(dealt.groupBy("s", "key", "lo", "hi").applyInArrow(_across, "a long, b long").distinct())
    if new.isEmpty():
        return roots
    return checkpoint(components(roots.select(F.col("tid").alias("a"), F.col("root").alias("b")).unionByName(new)))


def components(edges: DataFrame) -> DataFrame:
    """tid, root: of the nodes of edges (a, b), with the smallest node of each connected component as its root."""
    e = checkpoint(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("u") != F.col("v")).distinct())
    mark = None
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = checkpoint(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        # large star: larger neighbours go to the least of the neighbourhood
        large = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        # small star: a node and its smaller neighbours go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        e = checkpoint(small)
        now = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == mark:
            return e.select(F.col("u").alias("tid"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("tid"), F.col("v").alias("root")).distinct())
        mark = now


def classes(docs: DataFrame) -> DataFrame:
    """tid, doc_id, class_id and class_size of each row of docs; class_id is the smallest doc_id of the class."""
    rows = checkpoint(sketches(docs))
    texts = rows.groupBy("tid").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), F.first("sk").alias("sk"))
    texts = checkpoint(texts)
    pairs, large = candidates(texts.where(F.size("sk") > 0).select("tid", "sk"))
    pairs = checkpoint(pairs)
    held = fetch(docs, texts, pairs)
    roots = checkpoint(components(links(held, pairs)))
    if not large.isEmpty():
        roots = joined(large, held, roots)
    grouped = texts.select("tid", "least", "n").join(roots, "tid", "left").withColumn("root", F.coalesce("root", "tid"))
    size = grouped.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"), F.min_by("tid", F.struct(F.col("least").isNull(), "least", "tid")).alias("head"))
    named = checkpoint(grouped.join(size, "root").select("tid", "class_id", "class_size", "head"))
    return rows.select("tid", "doc_id").join(named, "tid")


def report(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, class_id, class_size."""
    return classes(docs).select("doc_id", "class_id", "class_size")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each class: that of the smallest doc_id."""
    c = checkpoint(classes(docs))
    # the class's head text, and of the rows with that text the one of the smallest id
    own, tid, least = vec.free(docs, "copy_text", "copy_tid", "copy_least")
    head = c.where(F.col("tid") == F.col("head")).groupBy("tid").agg(F.min("doc_id").alias(least)).withColumnRenamed("tid", tid)
    rows = docs.withColumn(own, text_id(F.col("text"))).join(head, (F.col(own) == F.col(tid)) & F.col("doc_id").eqNullSafe(F.col(least)), "left_semi")
    if not c.groupBy("tid", "doc_id").count().where("count > 1").isEmpty():
        rows = rows.dropDuplicates([own, "doc_id"])  # rows repeated with their id
    return rows.select(*[F.col(vec.quoted(x)) for x in docs.columns])
