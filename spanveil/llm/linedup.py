"""Line dedup over the suffix array of all line-ID sequences.

Every text is a sequence of lines; lines without a word are no part of it. Prefix
doubling ranks all suffixes of all texts by their first 1, 2, 4, ... lines: a
round pairs each suffix's rank with that of the suffix as many lines later, sorts
the distinct pairs over the cluster, and numbers them in order. A rank is an
interval of the suffix array whose common prefix is that long; suffixes alone in
their interval are settled and leave. A run of n lines is the same as another if
the ranks of its first and its last 2**k <= n lines are, so the ranks name every
longest-common-prefix interval of ``min_words`` words or more: of each line, the
shortest run of so many words that starts with it, and the one that ends with it.
Each line of a repeated run of at least ``min_words`` words lies in such a run,
and every copy of it but the first (by doc_id, then row key) is deleted.

As lines have a word at least, ``min_words`` bounds the rounds, not the data. A
line that a third of all texts share is one pair in a partial count, and its
joins are sort-merge joins whose large partitions Spark may split.

Edge cases: null and empty texts have no lines and nothing to delete; rows equal
in id and text count as one and share their fate; a null id comes last; a run
repeated within one text is deleted after its first place; short common lines
stay; empty tables give empty results; further columns pass through ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanveil.cluster import checkpoint
from spanveil.llm import vec

MIN_WORDS = 50


def row_key(doc_id: str = "doc_id", text: str = "text"):
    """What tells rows apart, in any partitioning."""
    return F.xxhash64(F.col(doc_id).cast("string"), F.lit(0), F.col(text))


def sequences(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """rid, doc_id, n_lines and, for each line with a word: its number, two hashes, and the lines of the shortest runs of min_words words from it and up to it (0: none)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in vec.chunks(b.column(2)):
                n = j - i
                ws, _, _ = vec.runs(~vec.SPACE[data], offs)
                s, e, row = vec.runs(data != 10, offs)
                cw = np.searchsorted(ws, np.append(s, len(data)))
                words = np.searchsorted(ws, e) - cw[:-1]
                real = words > 0
                # a line's number: newlines of its text before it
                nl = np.zeros(len(data) + 1, np.int64)
                np.cumsum(data == 10, out=nl[1:])
                number = nl[s] - nl[offs[row]]
                s, e, row, words, number = s[real], e[real], row[real], words[real], number[real]
                count = np.bincount(row, minlength=n)
                c = np.concatenate([[0], np.cumsum(words)])
                end = np.cumsum(count)[row]
                begin = end - count[row]
                at = np.arange(len(row))
                fwd = np.searchsorted(c, c[:-1] + min_words)  # the run ends before this line
                fwd = np.where(fwd <= end, fwd - at, 0)
                back = np.searchsorted(c, c[1:] - min_words, "right") - 1  # the run starts with this line
                back = np.where((c[1:] >= min_words) & (back >= begin), at + 1 - back, 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(i, n),
                        b.column(1).slice(i, n),
                        pa.array((nl[offs[1:]] - nl[offs[:-1]] + 1).astype(np.int32)),
                        vec.lists(number.astype(np.int32), count),
                        vec.lists(vec.hash_runs(data, s, e).view(np.int64), count),
                        vec.lists(vec.hash_runs2(data, s, e).view(np.int64), count),
                        vec.lists(fwd.astype(np.int32), count),
                        vec.lists(back.astype(np.int32), count),
                    ],
                    names=["rid", "doc_id", "n_lines", "line", "h1", "h2", "fwd", "back"],
                )

    return docs.select(row_key().alias("rid"), "doc_id", "text").mapInArrow(
        run, f"rid long, doc_id {kind}, n_lines int, line array<int>, h1 array<long>, h2 array<long>, fwd array<int>, back array<int>"
    )


def ranks(seqs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """rid, at and r0, r1, ...: the rank of each suffix by its first 2**k lines, in lexical order of the lines' hashes; null where no other suffix begins so."""

    def numbered(pairs: DataFrame, name: str) -> DataFrame:
        # Sorted over the cluster and numbered in order; kept, so that all readers see the same numbers.
        keys = [c for c in pairs.columns if c != "n"]
        return checkpoint(pairs.where(F.col("n") > 1).orderBy(*keys).withColumn(name, F.monotonically_increasing_id()).drop("n"))

    t = seqs.select("rid", F.posexplode(F.arrays_zip("h1", "h2")).alias("at", "h")).select("rid", "at", F.col("h.h1").alias("a"), F.col("h.h2").alias("b"))
    t = t.join(numbered(t.groupBy("a", "b").agg(F.count("*").alias("n")), "r0"), ["a", "b"]).drop("a", "b")
    k = 0
    while (2 << k) <= min_words:
        ahead = Window.partitionBy("rid").orderBy("at")
        step = 1 << k
        t = t.withColumn("a", F.when(F.lead("at", step).over(ahead) == F.col("at") + step, F.col(f"r{k}"))).withColumn("b", F.lead(f"r{k}", step).over(ahead))
        t = checkpoint(t)
        pair = numbered(t.where(F.col("a").isNotNull() & F.col("b").isNotNull()).groupBy("a", "b").agg(F.count("*").alias("n")), f"r{k + 1}")
        t = t.join(pair, ["a", "b"], "left").drop("a", "b")
        k += 1
    return t


def removals(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """rid, doc_id, n_lines and removed: the sorted numbers (from 0) of the lines to delete, of each distinct row."""
    seqs = checkpoint(sequences(docs, min_words).dropDuplicates(["rid"]))
    t = ranks(seqs, min_words)
    levels = [c for c in t.columns if c.startswith("r") and c[1:].isdigit()]
    per_doc = t.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("at", *levels))).alias("x"))
    rows = per_doc.join(seqs.select("rid", "doc_id", "line", "fwd", "back"), "rid").select(
        "rid", "doc_id", "line", "fwd", "back", F.col("x.at").alias("at"), *[F.col(f"x.{c}").alias(c) for c in levels]
    )
    kind = docs.schema["doc_id"].dataType.simpleString()

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), 2000):
                b = whole.slice(lo, 2000)
                line, fwd, back, at = (b.column(i) for i in (2, 3, 4, 5))
                size = np.asarray(line.value_lengths(), np.int64)
                base = np.cumsum(size) - size
                n = int(size.sum())
                have = np.asarray(at.value_lengths(), np.int64)
                place = np.asarray(at.flatten(), np.int64) + np.repeat(base, have)
                row = np.repeat(np.arange(len(b)), size)
                number = np.asarray(line.flatten(), np.int64)
                level = np.full((len(levels), n), -1, np.int64)
                for k in range(len(levels)):
                    level[k, place] = np.asarray(b.column(6 + k).flatten().fill_null(-1), np.int64)
                f, g = np.asarray(fwd.flatten(), np.int64), np.asarray(back.flatten(), np.int64)
                i = np.arange(n)
                start = np.concatenate([i[f > 0], (i - g + 1)[g > 0]])
                long = np.concatenate([f[f > 0], g[g > 0]])
                k = np.log2(np.maximum(long, 1)).astype(np.int64)
                x, y = level[k, start], level[k, start + long - (1 << k)]
                ok = (x >= 0) & (y >= 0)
                start, long, x, y = start[ok], long[ok], x[ok], y[ok]
                r = row[start]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(long.astype(np.int32)),
                        pa.array(x),
                        pa.array(y),
                        b.column(1).take(pa.array(r)),
                        b.column(0).take(pa.array(r)),
                        pa.array(number[start].astype(np.int32)),
                        pa.array(number[start + long - 1].astype(np.int32)),
                    ],
                    names=["n", "x", "y", "doc_id", "rid", "first", "last"],
                )

    runs = checkpoint(rows.mapInArrow(windows, f"n int, x long, y long, doc_id {kind}, rid long, first int, last int").distinct())
    place = F.struct(F.col("doc_id").isNull().alias("u"), F.col("doc_id").alias("v"), F.col("rid").alias("w"), F.col("first").alias("f"))
    # kept apart from the runs, so that Spark may split the part of a run with very many copies
    original = checkpoint(runs.groupBy("n", "x", "y").agg(F.count("*").alias("copies"), F.min(place).alias("origin")).where(F.col("copies") > 1))
    later = runs.join(original, ["n", "x", "y"]).where(place > F.col("origin"))
    gone = later.groupBy("rid").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence("first", "last"))))).alias("removed"))
    return seqs.select("rid", "doc_id", "n_lines").join(gone, "rid", "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))


def report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each row of docs: doc_id, n_lines, n_removed and the numbers of the removed lines."""
    rows = docs.select(row_key().alias("rid"), F.col("doc_id"))
    gone = removals(docs, min_words).drop("doc_id")
    return rows.join(gone, "rid").select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), "removed")


def clean(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs without the deleted lines; a document of which no line with a word is left goes, one that had none stays."""
    key, rid, removed, new = vec.free(docs, "line_key", "line_rid", "line_removed", "line_text")
    gone = removals(docs, min_words).where(F.size("removed") > 0).select(F.col("rid").alias(rid), F.col("removed").alias(removed))
    rows = docs.withColumn(key, row_key()).join(gone, F.col(key) == F.col(rid), "left")
    # a text's lines are numbered, and an outer difference of two sets of numbers takes time linear in them
    lines = F.split("text", "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), removed)
    kept = F.array_join(F.transform(left, lambda i: F.get(F.col(new), i)), "\n")
    rows = rows.withColumn(new, F.when(F.col(removed).isNotNull(), lines)).withColumn(new, F.when(F.col(removed).isNull(), F.col("text")).otherwise(kept))
    rows = rows.where(F.col(removed).isNull() | F.col(new).rlike(r"[^\x20\x09-\x0D]"))
    return rows.select(*[F.col(new).alias("text") if c == "text" else F.col(vec.quoted(c)) for c in docs.columns])
