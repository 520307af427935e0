"""Suffix-array dedup: every byte that a string of ``span`` bytes covers goes, if that string also starts elsewhere.

The method is the interval tree of common prefixes: suffixes in order, the common
prefix of neighbours, and a scan with a stack that yields every interval; an
interval whose suffixes differ in the byte before them (or begin a context) is a
maximal repeat, and all its suffixes are its occurrences. Only suffixes that can
share ``span`` bytes are ordered, in buckets that no such common prefix leaves:

1. Each string of ``span`` bytes has an anchor, the byte run of smallest hash in
   it. Neighbouring strings of one anchor are a context: the text from the start of
   the first to the end of the last. Equal strings have equal anchors, so they meet
   in the bucket of the anchor's hash.
2. Anchors that occur once are dropped by a count; equal contexts become one row
   with the number of their copies. A bucket of one context repeats as a whole.
3. A bucket of several contexts is one enhanced suffix array inside a task. Its
   suffixes are those that occur twice and differ in the byte before, by the hashes
   of their first ``span`` bytes; they are then ordered, compared and scanned by
   their bytes. A repeat longer than its context comes out in overlapping pieces.
4. A bucket of more than ``LIMIT`` different contexts is no task of its own: it is dealt out, and its
   contexts are divided. Equal strings have their anchor at equal places, so strings whose anchors lie in
   one block of ``WIDTHS`` places share all bytes but those of the block: their core. A core that occurs
   once is dropped, and one in equal surroundings repeats whole. Any other (where a repeat ends) is a bucket again, of the
   different texts of its blocks, and goes through 3 or, above ``LIMIT``, is divided further, down to single strings (exact up to equal 64-bit hashes).
5. Repeats go back to the contexts' places and are united in each text.

A context holds less than 2 x ``span`` bytes, so tasks are bounded by ``LIMIT`` contexts
(about 0.4 MB at 200 bytes) and by the longest text. Hot anchors are partial counts and
sort-merge joins, whose large partitions Spark may split.

Edge cases: a null text counts as empty; texts shorter than ``span`` keep all bytes;
rows equal in id and text are different places, so both lose what they share (all of it); a
null id passes; a string may overlap its own copy (a run of one letter goes whole);
an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.cluster import ship, written
from spanveil.llm import vec

SPAN = 200
#: Different contexts of a bucket up to which one task orders its suffixes.
LIMIT = 1024
#: Places of the anchor in a block, as contexts of larger buckets are divided; each divides the one before.
WIDTHS = (16, 4, 1)
#: Bytes of text looked at together.
_PIECE = 1 << 18
_U = np.uint64


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p, q = vec._powers(len(data) + 1)
    c = np.zeros(len(data) + 1, _U)
    np.cumsum(vec._BYTE[data] * p[: len(data)], out=c[1:])
    return c, q


def contexts(data: np.ndarray, offs: np.ndarray, span: int = SPAN) -> Iterator[tuple[np.ndarray, ...]]:
    """row, anchor hash, context hash, start in its text and number of strings of every context; for pieces of the bytes of some texts."""
    k = max(2, span // 8)
    width = span - k + 1
    size = np.diff(offs)
    long = size >= span
    open_, close = offs[:-1][long], offs[1:][long] - span + 1  # where strings may start
    for lo in range(0, int(offs[-1]), _PIECE):
        hi = min(lo + _PIECE, int(offs[-1]))
        edge = np.zeros(hi - lo + 1, np.int64)
        np.add.at(edge, np.clip(open_, lo, hi) - lo, 1)
        np.add.at(edge, np.clip(close, lo, hi) - lo, -1)
        s = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        if not len(s):
            continue
        part = data[lo : min(hi + span - 1, len(data))]
        c, q = _sums(part)
        n = len(part) - k + 1
        h = vec.mix((c[k:] - c[:-k]) * q[:n])
        low = _U((1 << 20) - 1)  # more than a piece's places
        key = np.full(-(-n // width) * width, ~_U(0))
        key[:n] = (h & ~low) | np.arange(n, dtype=_U)  # the first of equal ones counts
        rows = key.reshape(-1, width)
        head = np.minimum.accumulate(rows, axis=1).reshape(-1)
        tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        at = (np.minimum(tail[s], head[s + width - 1]) & low).astype(np.int64)
        cut = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (s[1:] != s[:-1] + 1)))
        first, last, at = s[cut], s[np.append(cut[1:], len(s)) - 1], at[cut]
        number = last - first + 1
        context = vec.mix((c[last + span] - c[first]) * q[first] + (number + span - 1).astype(_U))
        row = np.searchsorted(offs, first + lo, "right") - 1
        yield row, h[at].view(np.int64), context.view(np.int64), first + lo - offs[row], number


def _scan(texts: DataFrame, span: int, whole: bool) -> DataFrame:
    """h of every context of texts (rid, text); with ``whole`` also c, rid and place: start x 65536 + number of strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, _, data, offs in vec.chunks(b.column(0)):
                for row, h, c, start, number in contexts(data, offs, span):
                    out = {"h": pa.array(h)}
                    if whole:
                        out |= {"c": pa.array(c), "rid": b.column(1).take(pa.array(row + i)), "place": pa.array(start << 16 | number)}
                    yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return texts.select("text", "rid").mapInArrow(run, "h long, c long, rid long, place long" if whole else "h long")


def _cut(rows: DataFrame, span: int) -> DataFrame:
    """h, c, copies, salt and the bytes of the contexts that ``wanted`` (h, c, copies, salt, place) of each text names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in vec.chunks(b.column(0)):
                want = b.column(1).slice(i, j - i)
                size = np.asarray(want.value_lengths(), np.int64)
                w = want.flatten()
                place = np.asarray(w.field("place"), np.int64)
                s = np.repeat(offs[:-1], size) + (place >> 16)
                n = (place & 0xFFFF) + span - 1
                raw = data[np.repeat(s - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
                cut = np.zeros(len(n) + 1, np.int32)
                np.cumsum(n, out=cut[1:])
                binary = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(cut), pa.py_buffer(np.ascontiguousarray(raw))])
                yield pa.RecordBatch.from_arrays([*[w.field(x) for x in ("h", "c", "copies", "salt")], binary], names=["h", "c", "copies", "salt", "context"])

    return rows.select("text", "wanted").mapInArrow(run, "h long, c long, copies long, salt long, context binary")


def intervals(common: list[int], before: list[int], least: int) -> list[tuple[int, int, int]]:
    """Maximal repeats (length, first, last suffix) of ordered suffixes: common[i] is the prefix that i shares with i - 1, before[i] the byte before i (-1: none)."""
    out: list[tuple[int, int, int]] = []
    stack: list[list[int]] = []  # open intervals: length, first suffix, byte before all of them or -1
    for i in range(1, len(common) + 1):
        now = common[i] if i < len(common) and common[i] >= least else 0
        first, byte = i - 1, before[i - 1]
        while stack and stack[-1][0] > now:
            length, first, other = stack.pop()
            byte = byte if byte == other else -1
            if byte < 0:
                out.append((length, first, i - 1))
        if now and stack and stack[-1][0] == now:
            stack[-1][2] = byte if byte == stack[-1][2] else -1
        elif now:
            stack.append([now, first, byte])
    return out


def repeats(bucket: np.ndarray, copies: np.ndarray, data: np.ndarray, offs: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, ...]:
    """context, start, end and repeat of the occurrences of all maximal repeats among contexts of some buckets."""
    number = np.diff(offs) - span + 1
    own = np.repeat(np.arange(len(number)), number)
    step = np.arange(len(own)) - np.repeat(np.cumsum(number) - number, number)
    at = offs[:-1][own] + step
    c, q = _sums(data)
    key = vec.mix(vec.mix((c[at + span] - c[at]) * q[at]) + bucket[own].astype(_U))
    # strings that occur twice and differ in the byte before
    order = np.argsort(key, kind="stable")
    group = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
    byte = np.where(step > 0, data[at - 1].astype(np.int64), -1)
    few, many = np.minimum.reduceat(byte[order], group), np.maximum.reduceat(byte[order], group)
    good = (np.add.reduceat(copies[own][order], group) > 1) & ((few < 0) | (few != many))
    pick = order[np.repeat(good, np.diff(np.append(group, len(order))))]
    own, at, byte, step = own[pick], at[pick], byte[pick], step[pick]
    size = offs[1:][own] - at
    by_size = np.argsort(size, kind="stable")  # a suffix comes before the longer ones that it begins
    own, at, byte, step, size = own[by_size], at[by_size], byte[by_size], step[by_size], size[by_size]
    width = int(size.max(initial=0))
    if not width:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    suffix = np.zeros((len(at), width + 4), np.uint8)
    suffix[:, :4] = bucket[own].astype(">u4").view(np.uint8).reshape(-1, 4)
    suffix[:, 4:] = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(width, np.uint8)), width)[at]
    suffix[:, 4:][np.arange(width) >= size[:, None]] = 0
    order = np.argsort(suffix.view(f"S{width + 4}").reshape(-1), kind="stable")
    own, at, byte, step, size, suffix = own[order], at[order], byte[order], step[order], size[order], suffix[order]
    other = suffix[1:] != suffix[:-1]
    common = np.where(other.any(1), other.argmax(1), width + 4) - 4
    common = np.append(0, np.minimum(common, np.minimum(size[1:], size[:-1])))
    # a context with copies is a repeat of its whole length
    best = np.where((copies[own] > 1) & (step == 0), size, 0)
    for length, first, last in intervals(common.tolist(), byte.tolist(), span):
        part = best[first : last + 1]  # inner intervals come first and are longer
        np.maximum(part, length, out=part)
    have = best > 0
    own, at, step, best = own[have], at[have], step[have], best[have]
    return own, step, step + best, vec.mix((c[at + best] - c[at]) * q[at] + best.astype(_U)).view(np.int64)


_FOUND = "h long, c long, copies long, a array<int>, b array<int>, repeat array<long>, context binary"


def _bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of byte strings."""
    raw = (col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col).cast(pa.large_binary())
    if not len(raw):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, buf = raw.buffers()
    offs = np.frombuffer(off, np.int64)[raw.offset : raw.offset + len(raw) + 1]
    return np.frombuffer(buf, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def _searched(rows: DataFrame, span: int) -> DataFrame:
    """h, c and the repeats of each context (h, c, copies, salt, context).

    Contexts of salt 0 are dealt and sorted by h, and whole buckets are worked on
    together. Others are of large buckets and pass with their bytes, not searched yet.
    """

    names = ["h", "c", "copies", "a", "b", "repeat", "context"]

    def arrays(t: pa.Table) -> Iterator[pa.RecordBatch]:
        h, cs = np.asarray(t.column("h"), np.int64), np.asarray(t.column("c"), np.int64)
        copies = np.asarray(t.column("copies"), np.int64)
        new = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        ends = np.append(new[1:], len(h))
        lo = 0
        while lo < len(new):  # about LIMIT contexts at a time
            hi = max(lo + 1, int(np.searchsorted(ends, new[lo] + LIMIT, "right")))
            i, j = int(new[lo]), int(ends[hi - 1])
            data, offs = _bytes(t.column("context").slice(i, j - i))
            own, a, b, name = repeats(np.searchsorted(new, np.arange(i, j), "right"), copies[i:j], data, offs, span)
            order = np.argsort(own, kind="stable")
            count = np.bincount(own, minlength=j - i)
            some = count > 0
            found = [vec.lists(x[order].astype(kind), count[some]) for x, kind in ((a, np.int32), (b, np.int32), (name, np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array(h[i:j][some]), pa.array(cs[i:j][some]), pa.array(copies[i:j][some]), *found, pa.nulls(int(some.sum()), pa.binary())], names=names)
            lo = hi

    def passed(t: pa.Table) -> pa.RecordBatch:
        none = [pa.nulls(len(t), pa.list_(x)) for x in (pa.int32(), pa.int32(), pa.int64())]
        return pa.RecordBatch.from_arrays([*[t.column(x).combine_chunks() for x in ("h", "c", "copies")], *none, t.column("context").combine_chunks()], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            salt = np.asarray(t.column("salt"), np.int64)
            n = int(np.searchsorted(salt, 1))  # sorted: those of salt 0 come first
            if n < len(t):
                yield passed(t.slice(n))
                t = t.slice(0, n)
            t = t if left is None else pa.concat_tables([left, t])
            left = None
            if len(t):
                h = np.asarray(t.column("h"), np.int64)
                whole = int(np.searchsorted(h, h[-1]))  # the last bucket may go on
                if whole:
                    yield from arrays(t.slice(0, whole))
                left = t.slice(whole)
        if left is not None:
            yield from arrays(left)

    return rows.repartition("h", "salt").sortWithinPartitions("salt", "h").mapInArrow(run, _FOUND)


def blocks(h: np.ndarray, data: np.ndarray, offs: np.ndarray, span: int, width: int) -> tuple[np.ndarray, ...]:
    """context, first string, number of strings, core hash and text hash of the blocks of contexts with anchors h."""
    k = max(2, span // 8)
    c, q = _sums(data)
    run = vec.mix((c[k:] - c[:-k]) * q[: len(data) - k + 1])
    row = np.repeat(np.arange(len(h)), np.diff(offs))[: len(run)]
    hit = np.flatnonzero((run == h.view(_U)[row]) & (np.arange(len(run)) + k <= offs[1:][row]))
    anchor = (hit - offs[row[hit]])[np.flatnonzero(np.diff(row[hit], prepend=-1))]  # the first run of that hash
    n = np.diff(offs) - span + 1
    high, low = anchor // width, (anchor - n + 1) // width
    count = high - low + 1
    of = np.repeat(np.arange(len(h)), count)
    last = anchor[of] - width * (high[of] - (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)))  # where the block's last string would start
    first = np.maximum(0, last - width + 1)
    number = np.minimum(n[of], last + 1) - first
    at = offs[:-1][of]
    s, e = at + last, at + last - width + 1 + span
    core = vec.mix(vec.mix((c[e] - c[s]) * q[s]) + h.view(_U)[of] + ((anchor[of] - last) * 2 + 1).astype(_U))
    s, size = at + first, number + span - 1
    return of, first, number, core.view(np.int64), vec.mix((c[s + size] - c[s]) * q[s] + size.astype(_U)).view(np.int64)


def _blocks(rows: DataFrame, span: int, width: int) -> DataFrame:
    """bucket, h, c, copies, first, n, core and own of the blocks of contexts (bucket, h, c, copies, context)."""
    names = ["bucket", "h", "c", "copies", "first", "n", "core", "own"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = _bytes(b.column(4))
            if not len(data):
                continue
            of, first, n, core, own = blocks(np.asarray(b.column(1), np.int64), data, offs, span, width)
            new = [pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(core), pa.array(own)]
            yield pa.RecordBatch.from_arrays([*[b.column(i).take(pa.array(of)) for i in range(4)], *new], names=names)

    return rows.select("bucket", "h", "c", "copies", "context").mapInArrow(run, "bucket long, h long, c long, copies long, first int, n int, core long, own long")


def _divided(rows: DataFrame, span: int, limit: int, widths: tuple[int, ...]) -> DataFrame:
    """bucket, c, a, b and repeat of the contexts (bucket, h, c, copies, context) of large buckets, h their anchor.

    Each core is a bucket of its own, and its contexts are the different texts of its blocks: up
    to ``limit`` of them are ordered in a task, more are divided again.
    """
    width, *rest = widths
    parts = written(_blocks(rows, span, width))
    one = F.min(F.struct("bucket", "c", "first", "n")).alias("one")
    each = written(parts.groupBy("core", "own").agg(F.first("h").alias("h"), F.sum("copies").alias("copies"), one))
    cores = written(each.groupBy("core").agg(F.sum("copies").alias("n"), F.count("*").alias("m")).where(F.col("n") > 1).select("core", "m"))
    met = written(parts.drop("h", "copies").join(cores, "core"))
    end = F.col("first") + F.col("n") + (span - 1)
    found = met.where("m = 1").select("bucket", "c", F.array(F.struct(F.col("first").alias("a"), end.alias("b"), F.col("own").alias("repeat"))).alias("x"))
    if rest:
        again = each.join(cores.where("m > 1"), "core").select("core", "own", "m", F.col("h").alias("anchor"), F.col("copies").alias("all"), "one.*")
        text = F.substring("context", F.col("first") + 1, F.col("n") + (span - 1))
        inner = again.join(rows.select("bucket", "c", "context"), ["bucket", "c"])
        inner = written(inner.select(F.col("core").alias("bucket"), F.col("anchor").alias("h"), F.col("own").alias("c"), F.col("all").alias("copies"), "m", text.alias("context")))
        small = inner.where(F.col("m") <= limit).select(F.col("bucket").alias("h"), "c", "copies", F.lit(0).cast("long").alias("salt"), "context")
        got = _searched(small, span).select(F.col("h").alias("bucket"), "c", "a", "b", "repeat")
        if inner.where(F.col("m") > limit).limit(1).count():
            got = got.unionByName(_divided(inner.where(F.col("m") > limit), span, limit, tuple(rest)))
        got = written(got.select(F.col("bucket").alias("core"), F.col("c").alias("own"), F.arrays_zip("a", "b", "repeat").alias("z")))
        moved = F.transform("z", lambda z: F.struct((z["a"] + F.col("first")).alias("a"), (z["b"] + F.col("first")).alias("b"), z["repeat"].alias("repeat")))
        found = found.unionByName(met.where("m > 1").join(got, ["core", "own"]).select("bucket", "c", moved.alias("x")))
    found = found.groupBy("bucket", "c").agg(F.array_sort(F.flatten(F.collect_list("x"))).alias("x"))
    return found.select("bucket", "c", *[F.col(f"x.{x}").alias(x) for x in ("a", "b", "repeat")])


def _places(docs: DataFrame, span: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """The distinct rows (rid, doc_id, text, copies), and for each rid that has any its repeats: found, an array of (place, a, b, repeat)."""
    ship(docs.sparkSession)
    rid = F.xxhash64(F.col("doc_id").cast("string"), F.lit(0), F.col("text"))
    docs = docs.select(rid.alias("rid"), "doc_id", "text")
    # written tables: a join of two exchanges of them is one that Spark may split
    again = written(_scan(docs, span, False).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("h"))
    places = written(_scan(docs, span, True).join(again, "h"))
    # one row for each different context, with one place of it
    single = written(places.groupBy("h", "c").agg(F.count("*").alias("copies"), F.min(F.struct("rid", "place")).alias("one")).select("h", "c", "copies", "one.rid", "one.place"))
    size = written(single.groupBy("h").agg(F.count("*").alias("m")))
    sized = single.join(size, "h")
    width = F.col("place").bitwiseAND(F.lit(0xFFFF)) + (span - 1)
    alone = sized.where(F.col("m") == 1).select("h", "c", F.array(F.lit(0)).alias("a"), F.array(width.cast("int")).alias("b"), F.array(F.col("c")).alias("repeat"))
    # rows equal in id and text are one
    texts = docs.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").alias("copies"))
    salt = F.when(F.col("m") > limit, F.pmod("c", F.lit(1 << 20)) + 1).otherwise(F.lit(0).cast("long"))
    wanted = sized.where(F.col("m") > 1).groupBy("rid").agg(F.collect_list(F.struct("h", "c", "copies", salt.alias("salt"), "place")).alias("wanted"))
    several = written(_searched(_cut(texts.select("rid", "text").join(wanted, "rid"), span), span))
    found = alone.unionByName(several.where(F.col("context").isNull()).drop("copies", "context"))
    if size.where(F.col("m") > limit).limit(1).count():
        large = several.where(F.col("context").isNotNull()).select(F.col("h").alias("bucket"), "h", "c", "copies", "context")
        widths = tuple(w for w in WIDTHS if 8 * w <= span or w == 1)
        found = found.unionByName(_divided(large, span, limit, widths).withColumnRenamed("bucket", "h"))
    met = places.join(found, ["h", "c"]).groupBy("rid").agg(F.collect_set(F.struct("place", "a", "b", "repeat")).alias("found"))
    return texts, met


def dedup(docs: DataFrame, span: int = SPAN, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, removed (start and end of the maximal runs of removed bytes) and kept (the bytes that stay) of each row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts, met = _places(docs, span, limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in vec.chunks(b.column(2)):
                part = b.column(3).slice(i, j - i)
                size = np.asarray(part.value_lengths().fill_null(0), np.int64)
                f = part.flatten()
                place = np.asarray(f.field("place"), np.int64) >> 16
                n = np.asarray(f.field("a").value_lengths(), np.int64)
                base = np.repeat(np.repeat(offs[:-1], size) + place, n)
                edge = np.zeros(len(data) + 1, np.int64)
                np.add.at(edge, base + np.asarray(f.field("a").flatten(), np.int64), 1)
                np.add.at(edge, base + np.asarray(f.field("b").flatten(), np.int64), -1)
                gone = np.cumsum(edge[:-1]) > 0
                s, e, row = vec.runs(gone, offs)
                count = np.bincount(row, minlength=j - i)
                left = np.concatenate([[0], np.cumsum(~gone)])[offs]
                kept = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(left), pa.py_buffer(np.ascontiguousarray(data[~gone]))])
                runs = pa.StructArray.from_arrays([pa.array(s - offs[row]), pa.array(e - offs[row])], names=["start", "end"])
                cut = np.zeros(len(count) + 1, np.int32)
                np.cumsum(count, out=cut[1:])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(np.diff(offs)), pa.ListArray.from_arrays(pa.array(cut), runs), kept.cast(pa.binary())],
                    names=["doc_id", "copies", "n_bytes", "removed", "kept"],
                )

    rows = texts.join(met, "rid", "left").select("doc_id", "copies", "text", "found")
    out = rows.mapInArrow(run, f"doc_id {kind}, copies long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")
    return out.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("again", "copies")


def groups(docs: DataFrame, span: int = SPAN, limit: int = LIMIT) -> DataFrame:
    """repeat, doc_id, start and end of all occurrences of the maximal repeats, as far as their contexts reach."""
    texts, met = _places(docs, span, limit)
    each = met.select("rid", F.explode("found").alias("f")).select("rid", F.shiftright("f.place", 16).alias("p"), F.explode(F.arrays_zip("f.a", "f.b", "f.repeat")).alias("z"))
    each = each.select("rid", F.col("z.repeat").alias("repeat"), (F.col("p") + F.col("z.a")).alias("start"), (F.col("p") + F.col("z.b")).alias("end"))
    return each.join(texts.select("rid", "doc_id"), "rid").select("repeat", "doc_id", "start", "end")
