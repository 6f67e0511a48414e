"""Shared helpers of the llm operators: Arrow batches as byte arrays, words and
their 64-bit hashes in numpy, checked sizes and written intermediate tables.

Texts reach Python only inside Spark tasks, as Arrow batches; a batch is worked
on in slices of at most ``SLICE_BYTES`` (or one text, if that is longer) so
that a worker's memory does not depend on the number of rows in a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.session import cut_lineage

SLICE_BYTES = 1 << 19
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_SEED = 0x5EED_7E55


def _space_table() -> np.ndarray:
    t = np.zeros(256, bool)
    t[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
    return t


def _alnum_table() -> np.ndarray:
    """True for every ASCII byte that is neither a digit nor a lower-case letter."""
    t = np.zeros(256, bool)
    t[:0x80] = True
    t[0x30:0x3A] = False
    t[0x61:0x7B] = False
    return t


SPACE = _space_table()          # separators of words [^\x20\x09-\x0D]+
NOT_ALNUM = _alnum_table()      # separators of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20        # A-Z only
_BYTE = np.random.Generator(np.random.PCG64(_WORD_SEED)).integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_GRAM = np.random.Generator(np.random.PCG64(_WORD_SEED + 1)).integers(0, 1 << 63, 64, dtype=np.uint64) * U64(2) + U64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all output bits."""
    x = np.asarray(x, U64).copy()
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_powers: dict[str, np.ndarray] = {}


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, up to ``n``."""
    if not _powers or len(_powers["up"]) < n + 1:
        size = max(SLICE_BYTES + 1, n + 1)
        inv = pow(_BASE, -1, 1 << 64)
        for name, b in (("up", _BASE), ("down", inv)):
            a = np.full(size, b, U64)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["up"], _powers["down"]


def slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets)`` of consecutive row ranges; a
    null text counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type)
    offs = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + max_bytes, "right")) - 1)
        yield lo, hi, data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


class Words:
    """Words of consecutive texts: byte span, row and position of each."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, separators: np.ndarray, fold: np.ndarray | None = None):
        self.buf = buf if fold is None else fold[buf]
        self.offs = offs
        n = len(buf)
        inside = ~separators[self.buf]
        begins, ends = inside.copy(), inside.copy()
        if n:
            begins[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            edge = offs[offs < n]
            begins[edge] = inside[edge]
            edge = offs[offs > 0] - 1
            ends[edge] = inside[edge]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offs)       # row -> its first word
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(len(offs) - 1), self.count)
        self.inside = inside

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        return span_hash(self.buf, self.start, self.end)


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, from one prefix sum of a polynomial."""
    up, down = _pow(len(buf))
    acc = np.zeros(len(buf) + 1, U64)
    np.cumsum(_BYTE[buf] * up[:len(buf)], out=acc[1:])
    return mix64((acc[end] - acc[start]) * down[start] + (end - start).astype(U64) * _GRAM[63])


def gram_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all ``k`` consecutive word hashes (over row borders, too)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    g = np.full(n, (k * int(_GRAM[62])) & (2 ** 64 - 1), U64)
    for j in range(k):
        g += h[j:j + n] * _GRAM[j]
    return mix64(g)


def within_row(words: Words, k: int) -> np.ndarray:
    """For every k-gram start: do all its words belong to one row?"""
    n = len(words) - k + 1
    return words.row[:n] == words.row[k - 1:] if n > 0 else np.zeros(0, bool)


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over ``[offsets[i], offsets[i+1])``."""
    acc = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=acc[1:])
    return acc[offsets[1:]] - acc[offsets[:-1]]


def small(df, rows: int) -> bool:
    """Whether a (written) table has at most ``rows`` rows; reads no more than needed."""
    return df.limit(rows + 1).count() <= rows


_WRITE = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",      # the table replaces the shuffle files
          "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}                  # whole texts are long rows


def cut(df):
    """``df`` as a written table in the shared checkpoint folder.  The shuffle
    files of the write are dropped as soon as it has ended, and Arrow batches of
    texts are kept small; the session's settings are put back after it."""
    conf = df.sparkSession.conf
    before = {k: conf.get(k, None) for k in _WRITE}
    for k, v in _WRITE.items():
        conf.set(k, v)
    try:
        return cut_lineage(df)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
