"""Language-model scores of a hashed maximum-entropy model with class-factored softmax.

A word is reached by a path of choices: P(word | context) = P(class | context) *
P(branch | class, context) * ... * P(word | leaf). The most frequent words are
classes of their own, all others fall into hashed classes, each the root of a
tree of 16 branches a node, by further bits of the word's hash; a leaf's words
share it by their smoothed counts. Every choice is a softmax over hashed n-gram
and skip features of the context (the word before, the pair before, and the word
before that alone), in the tree together with the node. Depth and feature rows
follow the number of distinct words (``LEAF``, ``PER_ROW``), so what is gathered
about contexts grows with the corpus.

Weights are offsets to the log shares of the counts, and trained by distributed
gradient updates: in each round all tasks sum the gradients of a fixed share of
the training documents at the common weights, the sums meet by blocks of rows,
and each weight takes one step, scaled by the occurrences of its feature. So
weights and scores do not depend on how the rows are partitioned, but for the
rounding of floating-point sums. Texts are scored in numpy batches that touch
only the weight rows of their features.

Word counts cover all training documents. Words above a share ``HOT`` of all
tokens (at most 1 / HOT of them, so the table is bounded) are looked up in the
batch; all others meet their counts in a join.

Edge cases: a null text counts as empty and has the end token alone; a null id
counts as an empty id text; without training tokens all counts are 0 and all
classes equally likely; equal rows get equal scores; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.cluster import checkpoint
from spanveil.llm import vec

#: Share of all tokens from which a word's count is sent to all tasks; so at most 1 / HOT words are.
HOT = 2e-6
SINGLE = 32
HASHED = 32
CLASSES = SINGLE + HASHED
#: Distinct words a leaf holds on average, at most.
LEAF = 1024
BRANCHES = 16
#: Rows of each kind of feature: 2 ** BITS for classes; for branches at least so many, and one for each PER_ROW distinct words.
BITS = 12
PER_ROW = 512
ROUNDS = 3
#: Probabilities computed at once.
BATCH = 1 << 20
#: Of these, so many are worked on at a time, and so many turned to columns.
NEAR = 1 << 16
TURN = 1 << 13
#: Sums of weights within which no power overflows or vanishes in single precision.
FAR = 80
RATE = 0.5
#: Occurrences that a feature must outweigh.
PRIOR = 1.0
BLOCK = 256
#: Training tokens of a round for which a task of its own is worth its sums.
TASK_TOKENS = 8_000_000

_U = np.uint64
END = int(vec.seed(5, 1).view(np.int64))
_BEGIN = vec.seed(5, 2)


_memory: dict[str, np.ndarray] = {}


def _held(name: str, shape: tuple[int, int], dtype: type) -> np.ndarray:
    """An array in the memory that the last call of this name got, as new pages for each batch cost more than some of the work on them."""
    n = shape[0] * shape[1]
    if len(_memory.get(name, ())) < n:
        _memory[name] = np.empty(n, dtype)
    return _memory[name][:n].reshape(shape)


def in_training(doc_id: Column) -> Column:
    """Whether a document is learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 != 0


def _tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's end among them, and their texts."""
    low = vec.LOWER[data]
    s, e, row = vec.runs(~vec.SPACE[low], offs)
    n = len(offs) - 1
    tok = np.full(len(row) + n, END, np.int64).view(_U)
    tok[np.arange(len(row)) + row] = vec.hash_runs(low, s, e)
    return tok, np.repeat(np.arange(n), np.bincount(row, minlength=n) + 1)


def _context(tok: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Hashes of the three features of each token's context."""
    one = np.full(len(tok), _BEGIN)
    two = one.copy()
    same = row[1:] == row[:-1]
    one[1:][same] = tok[:-1][same]
    same = row[2:] == row[:-2]
    two[2:][same] = tok[:-2][same]
    return np.stack([vec.mix(one), vec.mix(one * _U(0x9E3779B97F4A7C15) + two), vec.mix(two + _U(77))])


def _rows(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Feature rows of hashes; small integers are sorted by radix."""
    return (hashes >> _U(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)


@dataclass
class Vocabulary:
    """The frequent words with their counts, and the shares of classes, branches and leaves in the counts."""

    word: np.ndarray  # sorted hashes
    count: np.ndarray
    single: np.ndarray  # class of each of these words, or -1
    below: np.ndarray  # what counts are divided by, of each single word, then of each leaf
    share: np.ndarray  # of each class, smoothed
    branch: list[np.ndarray]  # for each level: log shares of the branches (nodes x branches)
    bits: int  # of the branches' feature rows
    tokens: int
    distinct: int

    def find(self, tok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of tokens among the frequent words, and whether they are there."""
        if not len(self.word):
            return np.zeros(len(tok), np.int64), np.zeros(len(tok), bool)
        at = np.minimum(np.searchsorted(self.word, tok), len(self.word) - 1)
        return at, self.word[at] == tok

    def classes(self, tok: np.ndarray, at: np.ndarray, hot: np.ndarray) -> np.ndarray:
        c = SINGLE + _node(tok, 0)
        if len(self.word):
            own = np.where(hot, self.single[at], -1)
            c = np.where(own >= 0, own, c)
        return c


def _node(tok: np.ndarray, level: int) -> np.ndarray:
    """The node of a level on each word's path; level 0 are the hashed classes."""
    return ((tok >> _U(40 - 4 * level)) & _U(HASHED * BRANCHES**level - 1)).astype(np.int64)


def _choices(voc: Vocabulary, tok: np.ndarray, row: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """In batches, all choices on the paths of tokens of classes y: which weights (0: classes, 1: branches), tokens, feature rows, log shares, and what is chosen."""
    h = _context(tok, row)
    f, start = _rows(h, BITS), np.log(np.maximum(voc.share, 1e-12)).astype(np.float32)[None]
    size = BATCH // CLASSES
    for i in range(0, len(tok), size):
        yield 0, np.arange(i, min(i + size, len(tok))), f[:, i : i + size], start, y[i : i + size]
    deep = np.flatnonzero(y >= SINGLE)
    size = BATCH // BRANCHES
    for level, shares in enumerate(voc.branch):
        for i in range(0, len(deep), size):
            at = deep[i : i + size]
            node = _node(tok[at], level)
            own = vec.mix(node.astype(_U) + _U((level + 1) << 56))
            start = shares.take(node, axis=0, out=_held("start", (len(node), BRANCHES), np.float32), mode="clip")
            yield 1, at, _rows(vec.mix(h[:, at] + own), voc.bits), start, _node(tok[at], level + 1) % BRANCHES


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, counts, held = [], [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        w, inv = np.unique(np.concatenate(words), return_inverse=True)
        return w, np.bincount(inv, weights=np.concatenate(counts), minlength=len(w)).astype(np.int64)

    def out() -> Iterator[pa.RecordBatch]:
        w, c = merged()
        for i in range(0, len(w), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(w[i : i + 100_000].view(np.int64)), pa.array(c[i : i + 100_000])], names=["word", "c"])

    for b in batches:
        for _, _, data, offs in vec.chunks(b.column(0)):
            w, c = np.unique(_tokens(data, offs)[0], return_counts=True)
            words.append(w)
            counts.append(c)
            held += len(w)
            if held > 2_000_000:
                w, c = merged()
                words, counts, held = [w], [c], len(w)
                if held > 1_000_000:
                    yield from out()
                    words, counts, held = [], [], 0
    if words:
        yield from out()


def counts(docs: DataFrame) -> DataFrame:
    """word (hash), c: how often each token occurs in the training documents."""
    rows = docs.where(in_training(F.col("doc_id"))).select("text").mapInArrow(_counted, "word long, c long")
    return rows.groupBy("word").agg(F.sum("c").alias("c"))


def vocabulary(table: DataFrame, hot: float = HOT) -> Vocabulary:
    total = table.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = int(total["n"] or 0), int(total["v"])
    rows = table.where(F.col("c") >= max(1.0, hot * n)).toArrow() if n else pa.table({"word": pa.array([], pa.int64()), "c": pa.array([], pa.int64())})  # 1 / hot rows at most
    word = rows["word"].to_numpy().view(_U)
    order = np.argsort(word)
    word, count = word[order], rows["c"].to_numpy()[order]
    top = np.lexsort((word, -count))[:SINGLE]
    single = np.full(len(word), -1, np.int64)
    single[top] = np.arange(len(top))
    depth = 1
    while HASHED * BRANCHES**depth * LEAF < v and depth < 10:
        depth += 1
    leaves = np.full(HASHED * BRANCHES**depth, 0.1)  # a leaf that no token has met keeps the share of unknown words
    rest = table.where(~F.col("word").isin(word[top].view(np.int64).tolist())) if len(top) else table
    leaf = F.shiftrightunsigned("word", 40 - 4 * depth).bitwiseAND(F.lit(len(leaves) - 1))
    got = rest.groupBy(leaf.alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).toArrow()  # a row for each leaf
    leaves[got["k"].to_numpy()] = got["n"].to_numpy() + 0.1 * (got["v"].to_numpy() + 1)
    below = np.full(SINGLE, 0.1)
    below[: len(top)] = count[top] + 0.1
    mass, branch = leaves, []
    for _ in range(depth):
        under = mass.reshape(-1, BRANCHES)
        mass = under.sum(1)
        branch.insert(0, np.log(under / mass[:, None]).astype(np.float32))
    share = np.concatenate([np.where(np.arange(SINGLE) < len(top), below, 0.1 / HASHED), mass if n else np.full(HASHED, 0.1 / HASHED)])
    bits = max(BITS, int(np.ceil(np.log2(max(v, 1) / PER_ROW))))
    return Vocabulary(word, count, single, np.concatenate([below, leaves]), share / share.sum(), branch, bits, n, v)


def _weights(w: np.ndarray, f: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each choice weighs in its features (held until the next call), and all choices together."""
    n, choices = f.shape[1], w.shape[2]
    f, z, total = f.astype(np.intp), _held("z", (n, choices), np.float32), np.empty((n, 1), np.float32)
    size = NEAR // choices
    more = _held("more", (min(n, size), choices), np.float32)
    for i in range(0, n, size):  # what is worked on stays in the processor's cache
        at = slice(i, i + size)
        own = z[at]
        w[0].take(f[0, at], axis=0, out=own, mode="clip")
        own += start if len(start) == 1 else start[at]
        for k in (1, 2):
            own += w[k].take(f[k, at], axis=0, out=more[: len(own)], mode="clip")
        if own.max() > FAR or own.min() < -FAR:  # else no power is too large or small
            own -= own.max(1, keepdims=True)
        np.exp(own, out=own)
        own.sum(1, keepdims=True, out=total[at])
    return z, total


def _gather(total: np.ndarray, seen: np.ndarray, f: np.ndarray, g: np.ndarray) -> None:
    """Adds a batch's gradients and occurrences to those of its features: total is features x choices x rows, so that each choice is one count."""
    columns, size = _held("columns", g.shape[::-1], np.float64), TURN // g.shape[1]
    for i in range(0, len(g), size):  # few rows at a time, as each is a stride away from the next
        columns[:, i : i + size] = g[i : i + size].T
    for k, rows in enumerate(f):
        at, r, n = slice(None), rows.astype(np.intp), seen.shape[1]
        if len(r) < n:  # a large table is touched only in the batch's rows
            at, r = np.unique(r, return_inverse=True)
            n = len(at)
        seen[k, at] += np.bincount(r, minlength=n)
        for own, column in zip(total[k], columns, strict=True):
            own[at] += np.bincount(r, column, n)


def train(docs: DataFrame, voc: Vocabulary, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The weights of classes and branches (features x rows x choices), from one pass over all training documents in ``rounds`` shares."""
    shape = [(3, 1 << BITS, CLASSES), (3, 1 << voc.bits, BRANCHES)]
    w = [np.zeros(s, np.float32) for s in shape]
    # a choice's gradient is held against how often its feature would meet it by shares alone
    usual = [voc.share, np.full(BRANCHES, 1 / BRANCHES)]
    rows = docs.where(in_training(F.col("doc_id"))).select("text", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(3)), F.lit(rounds)).alias("share"))
    tasks = max(2 * docs.sparkSession.sparkContext.defaultParallelism, voc.tokens // rounds // TASK_TOKENS)
    kind = "part int, block int, task long, g binary, n binary"

    def total(t: pa.Table) -> pa.Table:
        t = t.sort_by("task")
        g, n = (np.sum([np.frombuffer(x.as_py(), np.float32) for x in t[c]], axis=0, dtype=np.float64).astype(np.float32) for c in "gn")
        return pa.table({"part": t["part"][:1], "block": t["block"][:1], "task": t["task"][:1], "g": pa.array([g.tobytes()]), "n": pa.array([n.tobytes()])})

    for share in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], w: list[np.ndarray] = w) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            sums = [np.zeros((s[0], s[2], s[1])) for s in shape]
            seen = [np.zeros(s[:2]) for s in shape]
            for b in batches:
                for _, _, data, offs in vec.chunks(b.column(0)):
                    tok, row = _tokens(data, offs)
                    for part, _, f, start, y in _choices(voc, tok, row, voc.classes(tok, *voc.find(tok))):
                        g, z = _weights(w[part], f, start)
                        g /= z
                        g[np.arange(len(y)), y] -= 1
                        _gather(sums[part], seen[part], f, g)
            task = TaskContext.get().partitionId()
            for part in (0, 1):
                g, n = sums[part].swapaxes(1, 2).reshape(-1, BLOCK, shape[part][2]), seen[part].reshape(-1, BLOCK)
                for k in np.flatnonzero(n.any(1)):
                    yield pa.RecordBatch.from_pylist([{"part": part, "block": int(k), "task": task, "g": g[k].astype(np.float32).tobytes(), "n": n[k].astype(np.float32).tobytes()}], schema)

        schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("task", pa.int64()), ("g", pa.binary()), ("n", pa.binary())])
        parts = rows.where(F.col("share") == share).select("text").coalesce(tasks).mapInArrow(run, kind)
        some = parts.groupBy("part", "block", (F.col("task") % 64).alias("salt")).applyInArrow(total, kind)
        new = [x.copy() for x in w]
        for r in some.groupBy("part", "block").applyInArrow(total, kind).collect():  # one row for each block of the weights
            choices = shape[r["part"]][2]
            g = np.frombuffer(r["g"], np.float32).reshape(-1, choices)
            n = np.frombuffer(r["n"], np.float32)[:, None]
            step = -g / (n * usual[r["part"]] + PRIOR)
            new[r["part"]].reshape(-1, BLOCK, choices)[r["block"]] += RATE * np.sign(step) * np.log1p(np.abs(step))
        w = new
    return w


def score(docs: DataFrame, hot: float = HOT) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities)."""
    table = checkpoint(counts(docs))
    voc = vocabulary(table, hot)
    weights = train(docs, voc)
    kind = docs.schema["doc_id"].dataType.simpleString()
    log_below = np.log10(voc.below)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_count = np.log10(voc.count + 0.1)
        for b in batches:
            for i, j, data, offs in vec.chunks(b.column(0)):
                n = j - i
                tok, row = _tokens(data, offs)
                at, is_hot = voc.find(tok)
                y = voc.classes(tok, at, is_hot)
                lp = -log_below[np.where(y < SINGLE, y, SINGLE + _node(tok, len(voc.branch)))]
                for part, picked, f, start, c in _choices(voc, tok, row, y):
                    g, z = _weights(weights[part], f, start)
                    lp[picked] += np.log10(np.maximum(g[np.arange(len(g)), c] / z[:, 0], 1e-30))
                top = log_count[at[is_hot]] if len(log_count) else np.zeros(0)
                rare = np.flatnonzero(~is_hot)
                order = rare[np.lexsort((tok[rare], row[rare]))]
                new = np.ones(len(order), bool)
                new[1:] = (tok[order][1:] != tok[order][:-1]) | (row[order][1:] != row[order][:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(order)))
                per = np.bincount(row[order[first]], minlength=n)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(1).slice(i, n),
                        b.column(2).slice(i, n),
                        pa.array(np.bincount(row, minlength=n).astype(np.int64)),
                        pa.array(np.bincount(row[is_hot], minlength=n).astype(np.int64)),
                        pa.array(vec.per_row(top, row[is_hot], n)),
                        pa.array(vec.per_row(lp, row, n)),
                        vec.lists(tok[order[first]].view(np.int64), per),
                        vec.lists(times.astype(np.int32), per),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "hot_known", "hot_sum", "model", "words", "times"],
                )

    rows = docs.select("text", "doc_id", (~in_training(F.col("doc_id"))).alias("held_out")).mapInArrow(
        run, f"doc_id {kind}, held_out boolean, n_tokens long, hot_known long, hot_sum double, model double, words array<long>, times array<int>"
    )
    rows = checkpoint(rows.withColumn("rid", F.monotonically_increasing_id()))  # kept, so the ids hold
    rare = rows.select("rid", F.explode(F.arrays_zip("words", "times")).alias("z")).select("rid", F.col("z.words").alias("word"), F.col("z.times").alias("times"))
    c = F.coalesce("c", F.lit(0))
    sums = (
        rare.join(table, "word", "left")
        .groupBy("rid")
        .agg(F.sum(F.col("times") * F.log10(c + 0.1)).alias("rare_sum"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    )
    above = F.col("hot_sum") + F.coalesce("rare_sum", F.lit(0.0))
    return rows.drop("words", "times").join(sums, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("hot_known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(voc.tokens).cast("long").alias("train_tokens"),
        (above - F.col("n_tokens") * F.log10(F.lit(voc.tokens + 0.1 * (voc.distinct + 1)))).alias("base_score"),
        (above + F.col("model")).alias("score"),
    )
