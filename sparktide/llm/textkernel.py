"""Vectorised text primitives that run inside Arrow batches: words, n-gram hashes.

A batch is laid out as one array of code points; every step is a NumPy pass over it, so
the cost is a few nanoseconds a character and no Python object exists per word.
A word is a maximal run of letters, digits and combining marks, compared in lower case.
"""

from __future__ import annotations

import ctypes
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0xD6E8FEB86659FD93
_BASE_INV = pow(_BASE, -1, 1 << 64)
_TABLE_SIZE = 0x20000
CHUNK_CHARS = 1 << 19

_tables: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finalizer; returns a new array."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


def _fold_table() -> np.ndarray:
    if "fold" not in _tables:
        t = np.zeros(_TABLE_SIZE, dtype=np.uint32)
        for i in range(_TABLE_SIZE):
            ch = chr(i)
            if ch.isalnum() or unicodedata.category(ch)[0] == "M":
                low = ch.lower()
                t[i] = ord(low) if len(low) == 1 else i
        _tables["fold"] = t
    return _tables["fold"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "pow" not in _tables or len(_tables["pow"]) < n:
        size = max(n, 2 * CHUNK_CHARS)
        for name, base in (("pow", _BASE), ("inv", _BASE_INV)):
            a = np.full(size, base, dtype=U64)
            a[0] = 1
            _tables[name] = np.multiply.accumulate(a)
    return _tables["pow"], _tables["inv"]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each after a line feed, and where each text starts."""
    joined = "\n" + "\n".join(texts) + "\n"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lens = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    base = np.cumsum(lens + 1) - lens
    return cp, base


def fold(cp: np.ndarray) -> np.ndarray:
    """Lower case of word characters, 0 for all others."""
    t = _fold_table()
    if len(cp) and cp.max() >= _TABLE_SIZE:
        far = cp >= _TABLE_SIZE
        out = t[np.where(far, 0, cp)]
        out[far] = cp[far]
        return out
    return t[cp]


class Words:
    """Words of some texts: `off` delimits each text's words; start and end are offsets in the text."""

    __slots__ = ("base", "doc", "end", "folded", "hash", "off", "prefix", "start")

    def __init__(self, texts: list[str]):
        cp, self.base = code_points(texts)
        c = fold(cp)
        is_word = c != 0
        edges = np.flatnonzero(is_word[1:] != is_word[:-1]) + 1
        st, en = edges[0::2], edges[1::2]
        power, inverse = _powers(len(c) + 1)
        total = np.empty(len(c) + 1, dtype=U64)
        total[0] = 0
        np.cumsum(c * power[: len(c)], out=total[1:])
        self.folded, self.prefix = c, total
        self.hash = mix64((total[en] - total[st]) * inverse[st])
        self.off = np.append(np.searchsorted(st, self.base), len(st))
        counts = np.diff(self.off)
        self.doc = np.repeat(np.arange(len(texts)), counts)
        shift = np.repeat(self.base, counts)
        self.start, self.end = st - shift, en - shift

    def prefix_hash(self, n: int) -> np.ndarray:
        """Hash of each word's first n characters (all, if it has fewer)."""
        shift = self.base[self.doc]
        st = self.start + shift
        en = np.minimum(self.end + shift, st + n)
        return mix64((self.prefix[en] - self.prefix[st]) * _powers(len(self.folded) + 1)[1][st])

    def ngrams(self, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether the text has that many left."""
        n = len(self.hash)
        out = np.zeros(n, dtype=U64)
        for j, c in enumerate(constants(k, seed)[:n]):  # no gram reaches farther than the last word
            out[: n - j] += self.hash[j:] * c
        last = np.repeat(self.off[1:] - k, np.diff(self.off))
        return mix64(out), np.arange(n) <= last

    def text_hash(self, seed: int = 0) -> np.ndarray:
        """Hash of each text's whole word sequence."""
        n = len(self.hash)
        power, inverse = _powers(n + 1)
        total = np.empty(n + 1, dtype=U64)
        total[0] = 0
        np.cumsum(mix64(self.hash + U64(seed)) * power[:n], out=total[1:])
        return mix64((total[self.off[1:]] - total[self.off[:-1]]) * inverse[self.off[:-1]] + np.diff(self.off).astype(U64))


def chunks(texts: list[str | None], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about `limit` characters, with the first one's index; NULL becomes empty."""
    start, size, part = 0, 0, []
    for i, t in enumerate(texts):
        t = t or ""
        if part and size + len(t) > limit:
            yield start, part
            start, size, part = i, 0, []
        part.append(t)
        size += len(t) + 1
    if part:
        yield start, part


def text_chunks(column: pa.Array, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """chunks of a column of texts, of which one run at a time is turned into Python strings."""
    size = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64) + 1
    ends = np.cumsum(size)
    start = 0
    while start < len(column):
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield start, [t or "" for t in column.slice(start, stop - start).to_pylist()]
        start = stop


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True


def word_counts(column: pa.Array, limit: int = 1 << 19) -> np.ndarray:
    """Runs of bytes other than ASCII white space in each text, NULL as 0; reads the Arrow buffers in place, half a megabyte at a time."""
    n = len(column)
    out = np.zeros(n, dtype=np.int64)
    _, offsets, data = column.buffers()
    if not n or data is None:
        return out
    off = np.frombuffer(offsets, dtype=np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, int(off[i]) + limit, side="right")) - 1)
        part = off[i : j + 1] - off[i]
        space = _SPACE[raw[off[i] : off[j]]]
        start = ~space
        start[1:] &= space[:-1]
        first = part[:-1][part[:-1] < part[1:]]
        start[first] = ~space[first]
        # a text's count is the number of word starts before its end less those before its beginning
        at = np.flatnonzero(start)
        out[i:j] = np.diff(np.searchsorted(at, part))
        i = j
    if column.null_count:
        out[np.asarray(column.is_null())] = 0
    return out


def lean(run: Callable) -> Callable:
    """An Arrow batch function that gives unused memory back at its end: workers live on between tasks."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim:
                trim(0)

    return wrapped


def sliding_argmin(x: np.ndarray, w: int) -> np.ndarray:
    """Index of the leftmost minimum of each window of w values, by doubling."""
    n = len(x) - w + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    idx = np.arange(len(x))
    span = 1
    while span * 2 <= w:
        a, b = idx[: len(idx) - span], idx[span:]
        idx = np.where(x[b] < x[a], b, a)
        span *= 2
    a, b = idx[:n], idx[w - span : w - span + n]
    return np.where(x[b] < x[a], b, a)
