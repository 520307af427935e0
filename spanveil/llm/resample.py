"""Importance resampling of documents towards a target distribution, by hashed word n-grams.

A document's features are its runs of 1 to ``max_n`` consecutive words; a
feature's bucket is the CRC-32 of its UTF-8 bytes modulo ``buckets``. A bucket's
gain is the logarithm of its smoothed share in the target texts over that in the
documents, in thousandths and floored. A document's weight is the sum of its
features' gains; Gumbel noise, seeded by its id, makes the documents of highest
score a sample drawn in proportion to exp(weight), without replacement.

Identical texts are collapsed first, by grouping the full text: features are
made and weighed once for each distinct text, the corpus counts are multiplied
by its multiplicity, and weights are joined back to the rows before each gets
its own noise. The join is on the SHA-256 of the text, one row a text on the
side of the weights, so Spark may split the rows of a text that very many share.
Only the ``buckets`` gains (a parameter, not the data's size) go to the driver
and into the tasks. The draw numbers rows sorted over the cluster.

Edge cases: a null or empty text has no features, weight 0 and is never drawn
where ``min_words`` is positive; a null id counts as empty in the noise and comes
last among equal scores; rows repeated with their id get equal scores and
neighbouring ranks; an empty table gives no rows, an empty target only smoothed
shares; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.cluster import checkpoint, numbered, ship
from spanveil.llm import vec

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
#: Longer runs are hashed one by one.
_LONG = 96


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_CRC = _crc_table()


def crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The CRC-32 of each byte run, all runs a byte further at each step."""
    size = end - start
    order = np.argsort(-np.minimum(size, _LONG + 1), kind="stable")
    s, left = start[order], size[order]
    crc = np.full(len(s), 0xFFFFFFFF, np.uint32)
    # how many runs, longest first, have a byte at each place
    alive = len(s) - np.cumsum(np.bincount(np.minimum(size, _LONG + 1), minlength=_LONG + 2))
    for j in range(_LONG + 1):
        n = int(alive[j])
        if not n:
            break
        c = crc[:n]
        crc[:n] = _CRC[(c ^ data[s[:n] + j]) & 0xFF] ^ (c >> np.uint32(8))
    out = np.empty(len(s), np.uint32)
    out[order] = ~crc
    for i in order[: int(np.searchsorted(-left, -_LONG, "left"))]:
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes())
    return out


def features(data: np.ndarray, offs: np.ndarray, max_n: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC-32 and text of every feature, text by text, and the number of words of each text."""
    data = vec.LOWER[data]
    s, e, row = vec.runs(vec.ALNUM[data], offs)
    words = np.bincount(row, minlength=len(offs) - 1)
    if max_n > 1 and len(s):  # words side by side, one space between them
        size = e - s
        begin = np.cumsum(size + 1) - size - 1
        joined = np.full(int(begin[-1] + size[-1]) + 1, 0x20, np.uint8)
        at = np.flatnonzero(vec.ALNUM[data])
        joined[np.repeat(begin - s, size) + at] = data[at]
        data, s, e = joined, begin, begin + size
    crcs, rows = [], []
    for n in range(1, max_n + 1):
        k = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :]) if len(row) >= n else np.zeros(0, np.int64)
        crcs.append(crc32(data, s[k], e[k + n - 1]))
        rows.append(row[k])
    crc, row = np.concatenate(crcs), np.concatenate(rows)
    if max_n > 1:
        order = np.argsort(row, kind="stable")
        crc, row = crc[order], row[order]
    return crc, row, words


def bucketed(texts: DataFrame, max_n: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """key, copies, n_words and the bucket of each feature, for texts (key, copies, text)."""
    kind = np.int16 if buckets <= 1 << 15 else np.int64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in vec.chunks(b.column(2)):
                crc, row, words = features(data, offs, max_n)
                count = np.bincount(row, minlength=j - i)
                ids = (crc.astype(np.int64) % buckets).astype(kind)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(words.astype(np.int64)), vec.lists(ids, count)], names=["key", "copies", "n_words", "buckets"])

    return texts.mapInArrow(run, f"key binary, copies long, n_words long, buckets array<{'smallint' if kind is np.int16 else 'bigint'}>")


def counted(rows: DataFrame) -> DataFrame:
    """bucket, n: features of all rows in each bucket, a text's times its copies; summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            got = b.column(1)
            times = np.repeat(np.asarray(b.column(0), np.int64), np.asarray(got.value_lengths(), np.int64))
            ids = np.asarray(got.flatten(), np.int64)
            if not len(ids):
                continue
            if ids.max() >= len(total):
                total = np.append(total, np.zeros(ids.max() + 1 - len(total), np.int64))
            # one sum for each number of copies keeps the sums whole numbers
            for c in np.unique(times):
                n = np.bincount(ids[times == c])
                total[: len(n)] += c * n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return rows.select("copies", "buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket, from the two tables of counts."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for counts, out in ((corpus, s), (target, t)):
        for r in counts.collect():  # at most ``buckets`` rows
            out[r["bucket"]] = r["n"]
    return np.floor(1000 * np.log((t + 1.0) * float(s.sum() + buckets) / ((s + 1.0) * float(t.sum() + buckets)))).astype(np.int64)


def weighed(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """key, n_words, n_features and weight of each distinct text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.asarray(b.column(2).value_lengths(), np.int64)
            each = gain[np.asarray(b.column(2).flatten(), np.int64)]
            c = np.concatenate([[0], np.cumsum(each)])
            end = np.cumsum(size)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size), pa.array(c[end] - c[end - size])], names=["key", "n_words", "n_features", "weight"])

    return rows.select("key", "n_words", "buckets").mapInArrow(run, "key binary, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, floored, of a document."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def _texts(docs: DataFrame) -> DataFrame:
    """key, copies, text: one row for each distinct text."""
    return docs.groupBy("text").agg(F.count("*").alias("copies")).select(_key().alias("key"), "copies", "text")


def _key() -> Column:
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))


def sample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, max_n: int = 1, buckets: int = BUCKETS, seed: int = SEED
) -> DataFrame:
    """doc_id, n_features, weight, score and rank (of the drawn, else null) of every row of docs; target: rows with a text."""
    ship(docs.sparkSession)
    # a null and an empty text have one key; their copies count no features
    rows = checkpoint(bucketed(_texts(docs), max_n, buckets))
    gain = gains(counted(rows), counted(bucketed(_texts(target), max_n, buckets)), buckets)
    weights = weighed(rows, gain).dropDuplicates(["key"])
    own = docs.select("doc_id", _key().alias("key"))
    scored = own.join(weights, "key").select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"))
    ready = F.col("n_words") >= min_words
    placed = numbered(scored, ready.desc(), F.desc("score"), F.asc_nulls_last("doc_id"), name="place")
    n = placed.where(ready).count()
    return placed.select("doc_id", "n_features", "weight", "score", F.when(ready & (F.col("place") <= percent * n // 100), F.col("place")).cast("long").alias("rank"))
