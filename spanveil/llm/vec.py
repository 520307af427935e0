"""Vectorised text kernels over the UTF-8 buffers of Arrow string columns.

Everything works on chunks of whole texts (never on parts of one), about
``CHUNK`` bytes each, so that memory stays bounded by the longest single text.
A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19

_U = np.uint64
_P = _U(0x9E3779B97F4A7C15 | 1)
_PI = _U(pow(int(_P), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def seed(*parts: int) -> np.uint64:
    """One 64-bit seed out of several integers."""
    x = np.zeros(1, _U)
    for p in parts:
        x = mix(x * _P + _U(p & 0xFFFFFFFFFFFFFFFF) + _U(0x632BE59BD9B4E019))
    return x[0]


_BYTE = mix(np.arange(256, dtype=_U) * _P + _U(0x51ED270B))
_POW: list[np.ndarray] = [np.ones(0, _U), np.ones(0, _U)]

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = True
ALNUM[128:] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        for k, p in enumerate((_P, _PI)):
            a = np.full(n, p, _U)
            a[0] = 1
            _POW[k] = np.multiply.accumulate(a)
    return _POW[0][:n], _POW[1][:n]


def strings(col: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A large_string array without nulls."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.type != pa.large_string():
        col = col.cast(pa.large_string())
    return col.fill_null("") if col.null_count else col


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows; the first is 0) of a column of texts."""
    col = strings(col)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offs = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(col: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of groups of whole texts of about ``limit`` bytes."""
    data, offs = utf8(col)
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of marked bytes, cut where a text ends."""
    n = len(inside)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    cut = offs[1:-1]
    cut = cut[cut < n]
    before[cut] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    back = cut[cut > 0] - 1
    after[back] = False
    s = np.flatnonzero(inside & ~before)
    e = np.flatnonzero(inside & ~after) + 1
    return s, e, np.searchsorted(offs, s, "right") - 1


def hash_runs(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte run."""
    p, q = _powers(len(data) + 1)
    c = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE[data] * p[: len(data)], out=c[1:])
    return mix((c[e] - c[s]) * q[s] + (e - s).astype(_U))


def grams(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of k runs within one text, and the index of their first run."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    g = h[:n].copy()
    for j in range(1, k):
        g *= _P
        g += h[j : j + n]
    at = np.flatnonzero(row[:n] == row[k - 1 : k - 1 + n])
    return mix(g[at]), at


def per_row(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Sums by row."""
    return np.bincount(row, weights=values, minlength=n) if len(row) else np.zeros(n)


def first_of(key: np.ndarray) -> np.ndarray:
    """Marks every place whose key occurs twice or more."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = np.zeros(len(k), bool)
    if len(k) > 1:
        eq = k[1:] == k[:-1]
        same[1:] |= eq
        same[:-1] |= eq
    out = np.zeros(len(k), bool)
    out[order] = same
    return out


def columns(batch: pa.RecordBatch, extra: dict[str, pa.Array]) -> pa.RecordBatch:
    """A batch of the given columns."""
    return pa.RecordBatch.from_arrays(list(extra.values()), names=list(extra))


_BYTE2 = mix(np.arange(256, dtype=_U) * _P + _U(0xA24BAED4963EE407))


def hash_runs2(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A second, independent hash of each byte run."""
    p, q = _powers(len(data) + 1)
    c = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE2[data] * p[: len(data)], out=c[1:])
    return mix((c[e] - c[s]) * q[s] - (e - s).astype(_U))


def lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A list column out of flat values and the number of each row."""
    cut = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=cut[1:])
    return pa.ListArray.from_arrays(pa.array(cut), pa.array(values))


def free(df, *wanted: str) -> list[str]:
    """Column names that no column of a data frame has, whatever the case of its letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    """A column's name as Spark SQL text, dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"
