"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

A text becomes the piece lattice of a SentencePiece model file (spaces as ▁, one
▁ before the text). Forward filtering sums the probabilities of all
segmentations up to each character; backward sampling draws a segmentation from
their distribution, with random numbers that depend on the row key and the place
in the text only, so a row's sample is the same in any batch, partition or run.
No piece has a ▁ after another character, so the lattice falls apart at word
ends, and the lattices of equal words are filtered once for a batch.

The model file is a parameter and only read. Its scores are merge ranks, so
piece probabilities follow Zipf's law over the rank, raised to ``theta``.
Characters without a piece, and a ▁ of the text itself, are coded as bytes.

Edge cases: a null text gives null ids and no tokens; an empty text gives no
ids; every valid text decodes to itself, white space and control characters
included; a word of any length is one lattice, filtered in time linear in its
length; rows with equal keys and texts get equal samples; further columns are
not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.llm import vec

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
THETA = 1.0
#: Bytes of texts that are handled together, about.
CHARS = 1 << 18
#: Longest word that is filtered together with others, and the characters of words that are.
SHORT = 48
TOGETHER = 20_000
#: Lattice nodes that a worker keeps for later batches, at most (but for those of one batch).
KEEP = 600_000
_SLOTS = 19

_SPACE = "▁"
_OWN = "\ud800"  # stands for a ▁ of the text: no valid text has it
_UNIT = re.compile(f"{_SPACE}*[^{_SPACE}]+|{_SPACE}+")
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_BASE = _U(0xD1342543DE82EF95)
_ZIPF = 10.0
_UNKNOWN = -16.0


class Lattice:
    """The pieces of a model, and the filtered lattices of the words met so far."""

    def __init__(self, path: str, theta: float) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.size = n
        self.byte = np.full(256, -1, np.int32)
        pieces: list[bytes] = []
        self.known: dict[str, tuple[int, float]] = {}
        rank = 0
        for i in range(n):
            p = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
                pieces.append(bytes([int(p[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                pieces.append(b"")
            else:
                self.known[p] = (i, -theta * math.log(rank + _ZIPF))
                rank += 1
                pieces.append(p.replace(_SPACE, " ").encode())
        if (self.byte < 0).any():
            raise ValueError("the model has no byte pieces, so not every text can be coded")
        self.longest = max(map(len, self.known))
        self.theta = theta
        # All pieces and their ends in a hash table: slots of one entry, and a sorted rest for those that found theirs taken.
        chars = sorted(set("".join(self.known)))
        codes = dict(zip(chars, self._char(np.array(list(map(ord, chars)), np.uint32)).tolist(), strict=True))
        ends: dict[int, tuple[int, float]] = {}
        inner: set[int] = set()  # those that go on to the left
        for p, (i, lp) in self.known.items():
            h, w = 0, 1
            for c in reversed(p):
                if h:
                    inner.add(h)
                    ends.setdefault(h, (-1, -math.inf))
                h = (h + codes[c] * w) & 0xFFFFFFFFFFFFFFFF
                w = w * int(_BASE) & 0xFFFFFFFFFFFFFFFF
            ends[h] = (i, lp)
        rows = sorted(ends)
        self.hashes = np.array([*rows, 0], _U)
        self.ids = np.array([*(ends[h][0] for h in rows), -1], np.int32)
        self.scores = np.array([*(ends[h][1] for h in rows), -np.inf])
        self.inner = np.array([*(h in inner for h in rows), False])
        self.slot = np.full(1 << _SLOTS, len(rows), np.int32)
        at = (self.hashes[:-1] >> _U(64 - _SLOTS)).astype(np.int64)
        new = np.append(True, at[1:] != at[:-1])  # sorted, so those of one slot are neighbours
        self.slot[at[new]] = np.flatnonzero(new)
        self.taken = np.zeros(1 << _SLOTS, bool)
        self.taken[at[~new]] = True
        self.lens = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.wide: dict[int, int] = {}  # characters coded as several bytes, and their number
        # of edges, by node: summed probabilities, pieces and nodes before; the first edge of each node; all with room for more
        self.cum, self.piece, self.prev, self.first = np.zeros(0), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.clear()

    @staticmethod
    def _char(cp: np.ndarray) -> np.ndarray:
        return vec.mix(cp.astype(_U) * _STEP + _U(1))

    def clear(self) -> None:
        self.end: dict[str, int] = {}  # the last node of each word
        self.nodes = 0
        self.edges = 0

    def _fallback(self, cp: int) -> int:
        if cp < 128:
            return int(self.byte[cp])
        return self.size + self.wide.setdefault(cp, len(self.wide))

    def _find(self, x: np.ndarray) -> np.ndarray:
        """The entry of each hash; of unknown ones the last, which is no piece."""
        h = (x >> _U(64 - _SLOTS)).astype(np.int64)
        e = self.slot[h]
        miss = self.hashes[e] != x
        e[miss] = len(self.ids) - 1
        more = np.flatnonzero(miss & self.taken[h])
        if len(more):
            j = np.minimum(np.searchsorted(self.hashes[:-1], x[more]), len(self.ids) - 2)
            hit = self.hashes[j] == x[more]
            e[more[hit]] = j[hit]
        return e

    def _together(self, units: list[str], lens: np.ndarray) -> tuple[np.ndarray, ...]:
        """Words in order of falling length. Their first characters are the first nodes, then all second ones, and so on."""
        count = np.append(np.searchsorted(-lens, -np.arange(1, int(lens[0]) + 1), "right"), 0)
        base = np.append(0, np.cumsum(count))  # the first node of each place (from 0)
        n, most = int(lens.sum()), min(self.longest, int(lens[0]))
        place = np.repeat(np.arange(len(count)), count)
        word = np.arange(n) - base[place]
        cp = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)[(np.cumsum(lens) - lens)[word] + place]
        code = self._char(cp)
        before = np.arange(n) - count[place - 1]  # the node of the character before
        before[: base[1]] = -1
        w = 1
        lp = np.full((most, n), -np.inf)
        edges: list[tuple[np.ndarray, np.ndarray]] = []
        live = left = np.arange(n)  # the last and the first character of what is looked up
        h = code
        m = 1
        for k in range(1, most + 1):
            e = self._find(h)
            ids = self.ids[e]
            hit = ids >= 0
            at = live[hit]
            lp[k - 1, at] = self.scores[e[hit]]
            edges.append((at, ids[hit]))
            if len(at):
                m = k
            if k == 1 and len(at) < n:
                bare = live[~hit]
                chars, which = np.unique(cp[bare], return_inverse=True)
                edges[0] = np.append(at, bare), np.append(ids[hit], np.array([self._fallback(int(c)) for c in chars], np.int32)[which])
                lp[0, bare] = _UNKNOWN * self.theta
            more = np.flatnonzero(self.inner[e])
            left = before[left[more]]
            if len(more) and left.min() < 0:
                inside = left >= 0
                more, left = more[inside], left[inside]
            if not len(more):
                break
            w = w * int(_BASE) & 0xFFFFFFFFFFFFFFFF
            live, h = live[more], h[more] + code[left] * _U(w)
        p = lp[:m]
        alpha = np.zeros(n)
        for j in range(int(lens[0])):
            g = slice(base[j], base[j + 1])
            a = p[: j + 1, g]
            for k in range(1, min(j, m) + 1):
                a[k - 1] += alpha[base[j - k] : base[j - k] + count[j]]
            top = a.max(0)
            a -= top
            np.exp(a, out=a)
            s = a.sum(0)
            alpha[g] = top + np.log(s)
            a /= s
            p[j + 1 :, g] = 0
        np.cumsum(p, axis=0, out=p)
        p /= p[-1].copy()
        g = np.concatenate([x for x, _ in edges])
        order = np.argsort(g.astype(np.uint16) if n <= 1 << 16 else g, kind="stable")  # small integers are sorted by radix
        k = np.repeat(np.arange(len(edges)), [len(x) for x, _ in edges])[order]
        g, ids = g[order], np.concatenate([x for _, x in edges])[order]
        first_edge = np.flatnonzero(np.diff(g, prepend=-1))
        prev = np.where(place[g] == k, -1, self.nodes + base[place[g] - k - 1] + word[g])
        cum = p[k, g]
        cum[np.append(first_edge[1:], len(g)) - 1] = 1.0
        self.end.update(zip(units, (self.nodes + base[lens - 1] + np.arange(len(lens))).tolist(), strict=True))
        self.nodes += n
        return cum, ids, prev.astype(np.int32), first_edge

    def _alone(self, unit: str) -> tuple[np.ndarray, ...]:
        alpha = [0.0]
        cum: list[float] = []
        first: list[int] = []
        piece: list[int] = []
        prev: list[int] = []
        for j in range(1, len(unit) + 1):
            found = []
            for k in range(1, min(j, self.longest) + 1):
                hit = self.known.get(unit[j - k : j])
                if hit:
                    found.append((hit[0], alpha[j - k] + hit[1], k))
            if not found or found[0][2] != 1:
                found.insert(0, (self._fallback(ord(unit[j - 1])), alpha[j - 1] + _UNKNOWN * self.theta, 1))
            top = max(x[1] for x in found)
            e = [math.exp(x[1] - top) for x in found]
            s = sum(e)
            alpha.append(top + math.log(s))
            c, node = 0.0, self.nodes + j - 1
            first.append(len(cum))
            for (i, _, k), x in zip(found, e, strict=True):
                c += x
                cum.append(c / s)
                piece.append(i)
                prev.append(-1 if j == k else node - k)
            cum[-1] = 1.0
        self.end[unit] = self.nodes + len(unit) - 1
        self.nodes += len(unit)
        return np.array(cum), np.array(piece, np.int32), np.array(prev, np.int32), np.array(first, np.int64)

    def filter(self, units: set[str]) -> None:
        """Adds the words that are not yet there."""
        new = list(units.difference(self.end))
        if not new:
            return
        if self.nodes + sum(map(len, new)) > KEEP:
            self.clear()
            new = list(units)
        lens = np.array(list(map(len, new)), np.int64)
        order = np.argsort(-lens, kind="stable")
        order = order[lens[order] <= SHORT]
        part = np.cumsum(lens[order]) // TOGETHER
        for o in np.split(order, np.flatnonzero(np.diff(part)) + 1):
            if len(o):
                self._keep(*self._together([new[j] for j in o], lens[o]))
        for j in np.flatnonzero(lens > SHORT):
            self._keep(*self._alone(new[j]))

    def _keep(self, cum: np.ndarray, piece: np.ndarray, prev: np.ndarray, first: np.ndarray) -> None:
        """Adds the edges of the newest nodes."""
        for name, new, at in (("cum", cum, self.edges), ("piece", piece, self.edges), ("prev", prev, self.edges), ("first", first + self.edges, self.nodes - len(first))):
            have = getattr(self, name)
            if at + len(new) > len(have):
                have = np.resize(have, (at + len(new)) * 5 // 4) if len(have) else np.zeros((at + len(new)) * 5 // 4, have.dtype)
                setattr(self, name, have)
            have[at : at + len(new)] = new
        self.edges += len(cum)

    def sample(self, node: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For words by last node and random base: the number of pieces of each, and all pieces in text order."""
        n = np.zeros(len(node), np.int64)
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        live, node = np.arange(len(node)), node.astype(np.int64)
        k = 0
        while len(live):
            k += 1
            u = (vec.mix(base[live] + _U(k * int(_STEP) & 0xFFFFFFFFFFFFFFFF)) >> _U(11)).astype(np.float64) * 2.0**-53
            e = self.first[node].astype(np.int64)
            on = np.flatnonzero(self.cum[e] <= u)
            while len(on):
                e[on] += 1
                on = on[self.cum[e[on]] <= u[on]]
            steps.append((live, self.piece[e]))
            n[live] += 1
            node = self.prev[e].astype(np.int64)
            go = node >= 0
            live, node = live[go], node[go]
        last = np.cumsum(n) - 1
        out = np.zeros(int(n.sum()), np.int32)
        for back, (rows, ids) in enumerate(steps):
            out[last[rows] - back] = ids
        return n, out

    def expand(self, n: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters that take several bytes become their byte pieces."""
        wide = ids >= self.size
        if not wide.any():
            return n, ids
        chars = [(_SPACE if c == ord(_OWN) else chr(c)).encode() for c in self.wide]
        width = np.ones(len(ids), np.int64)
        width[wide] = np.array([len(c) for c in chars])[ids[wide] - self.size]
        out = np.repeat(ids, width)
        flat = np.array([self.byte[b] for c in chars for b in c], np.int32)
        first = np.cumsum([0, *(len(c) for c in chars)])
        place = np.arange(len(out)) - np.repeat(np.cumsum(width) - width, width)
        w = out >= self.size
        out[w] = flat[first[out[w] - self.size] + place[w]]
        end = np.concatenate([[0], np.cumsum(width)])[np.cumsum(n)] if len(n) else np.zeros(0, np.int64)
        return np.diff(end, prepend=0), out

    def encode(self, texts: list[str | None], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each text, and all ids in order."""
        units: list[str] = []
        count = np.zeros(len(texts), np.int64)
        for r, t in enumerate(texts):
            if t:
                if _SPACE in t:
                    t = t.replace(_SPACE, _OWN)
                found = _UNIT.findall(_SPACE + t.replace(" ", _SPACE))
                count[r] = len(found)
                units += found
        self.filter(set(units))
        end = self.end
        node = np.array(list(map(end.__getitem__, units)), np.int64)
        row = np.repeat(np.arange(len(texts)), count)
        place = np.arange(len(units)) - np.repeat(np.cumsum(count) - count, count)
        base = vec.mix(keys.astype(_U)[row] + (place.astype(_U) + _U(1)) * _BASE)
        n, ids = self.sample(node, base)
        n, ids = self.expand(n, ids)
        return vec.per_row(n, row, len(texts)).astype(np.int64), ids

    def decode(self, n: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and bytes of the texts of id lists of n ids each."""
        width = self.lens[ids]
        total = int(width.sum())
        at = np.arange(total) + np.repeat(self.starts[ids] - (np.cumsum(width) - width), width)
        data = self.bytes[at]
        cut = np.concatenate([[0], np.cumsum(width)])[np.concatenate([[0], np.cumsum(n)])]
        some = cut[:-1] < cut[1:]
        keep = np.ones(total, bool)
        keep[cut[:-1][some]] = False  # the ▁ before the text
        return cut - np.concatenate([[0], np.cumsum(some)]), data[keep]


@lru_cache(maxsize=2)
def lattice(path: str, theta: float) -> Lattice:
    """The worker's lattice of a model."""
    return Lattice(path, theta)


def _parts(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of whole texts, of about CHARS bytes each."""
    _, offs = vec.utf8(b.column(0))
    i = 0
    while i < len(b):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + CHARS, "right")) - 1)
        yield b.slice(i, j - i)
        i = j


def _by_place(df: DataFrame) -> DataFrame:
    """Columns named by their place: names with dots, or given twice, cannot be mapped."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def encode(docs: DataFrame, model: str = MODEL, theta: float = THETA, seed: int = 1, key: str | Column = "doc_id", out: str = "ids", proof: str | None = None) -> DataFrame:
    """docs with its ids as a further (or replaced) column; proof: name of a column that says whether the ids decode to the text."""
    keep = [c for c in docs.columns if c not in (out, proof)]
    more = [(out, "array<int>")] + ([(proof, "boolean")] if proof else [])
    names = [*keep, *[c for c, _ in more]]
    schema = ", ".join(f"c{i} {k}" for i, k in enumerate([docs.schema[c].dataType.simpleString() for c in keep] + [k for _, k in more]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(model, theta)
        for whole in batches:
            for b in _parts(whole):
                keys = np.asarray(b.column(1).fill_null(0), np.int64).view(_U)
                n, ids = lat.encode(b.column(0).to_pylist(), keys)
                cut = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                null = np.asarray(b.column(0).is_null())
                cols = [*b.columns[2:], pa.ListArray.from_arrays(pa.array(cut, mask=np.append(null, False)), pa.array(ids))]
                if proof:
                    offs, data = lat.decode(n, ids)
                    want, at = vec.utf8(b.column(0))
                    same = np.diff(offs) == np.diff(at)
                    if same.all():
                        bad = np.flatnonzero(data != want)
                        same[np.searchsorted(at, bad, "right") - 1] = False
                    else:
                        same &= np.array([bytes(data[offs[r] : offs[r + 1]]) == bytes(want[at[r] : at[r + 1]]) for r in range(len(same))], bool)
                    cols.append(pa.array(same))
                yield pa.RecordBatch.from_arrays(cols, names=[f"c{i}" for i in range(len(names))])

    key = F.col(key) if isinstance(key, str) else key
    rows = docs.select(F.col("text"), F.xxhash64(F.lit(seed), key), *[F.col(vec.quoted(c)) for c in keep])
    return _by_place(rows).mapInArrow(run, schema).toDF(*names)


def decode(rows: DataFrame, model: str = MODEL, ids: str = "ids", out: str = "text") -> DataFrame:
    """rows with the texts of their ids in column ``out``; null ids give a null text."""
    keep = [c for c in rows.columns if c not in (ids, out)]
    schema = ", ".join(f"c{i} {k}" for i, k in enumerate([rows.schema[c].dataType.simpleString() for c in keep] + ["string"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(model, THETA)
        for b in batches:
            col = b.column(0)
            n = np.asarray(col.value_lengths().fill_null(0), np.int64)
            offs, data = lat.decode(n, np.asarray(col.flatten(), np.int64))
            texts = pa.LargeStringArray.from_buffers(len(b), pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
            texts = pa.compute.if_else(col.is_null(), None, texts).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], texts], names=[f"c{i}" for i in range(len(keep) + 1)])

    return _by_place(rows.select(F.col(vec.quoted(ids)), *[F.col(vec.quoted(c)) for c in keep])).mapInArrow(run, schema).toDF(*keep, out)
