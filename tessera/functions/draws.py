"""Seeded draws for whole arrays: X-03 (``shaping.hash_uniform``) for every place
of an array at once.

A column expression hashes one element at a time, which for tokens costs more than
all else an operator does.  Here the places of an Arrow batch are hashed together:
the messages ``seed:key:place`` are laid out as one-block MD5 inputs in numpy and the
64 steps are run on ``LANES`` of them at a time.  Messages of more than one block
(keys of some forty characters and more) go through hashlib.  Same bits as the column.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

LANES = 8192
BLOCK = 55            # bytes of a message that fit into one MD5 block
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2 ** 32)) for i in range(64)]
_SHIFTS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def _md5_head(blocks: np.ndarray) -> np.ndarray:
    """First 52 bits of the MD5 of padded one-block messages, one row of 64 bytes each."""
    m = np.ascontiguousarray(blocks.view("<u4").T)
    a, b, c, d = (np.full(m.shape[1], x, np.uint32) for x in _START)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            g = (7 * i) % 16
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        for x in (a, _SINES[i], m[g]):
            np.add(f, x, out=f)
        np.left_shift(f, np.uint32(_SHIFTS[i]), out=t)
        np.right_shift(f, np.uint32(32 - _SHIFTS[i]), out=f)
        np.bitwise_or(f, t, out=f)
        np.add(f, b, out=f)
        a, b, c, d, f = d, f, b, c, a
    first, second = (a + _START[0]).byteswap().astype(np.int64), (b + _START[1]).byteswap().astype(np.int64)
    return (first << 20) | (second >> 12)


def _text_rows(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte rows of equal width (zeros behind a text) and the lengths."""
    size = np.array([len(x) for x in texts], np.int64)
    width = int(size.max(initial=1)) or 1
    return np.frombuffer(b"".join(x.ljust(width, b"\0") for x in texts), np.uint8).reshape(len(texts), width), size


def _tails(upto: int, suffixes: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, lengths)`` of place + suffix + the first pad byte, places in order,
    the suffixes of a place one after the other."""
    ends = [x.encode() + b"\x80" for x in suffixes]
    return _text_rows([b"%d%s" % (i, e) for i in range(upto) for e in ends])


def _draw(heads: list[bytes], sizes: np.ndarray, suffixes: Sequence[str]) -> np.ndarray:
    """Draws of all places of rows with ``sizes`` places each, in order."""
    per = len(suffixes)
    head, head_len = _text_rows([h[:BLOCK] for h in heads])
    whole_len = np.array([len(h) for h in heads], np.int64)
    tail, tail_len = _tails(int(sizes.max(initial=0)), suffixes)
    ends = np.cumsum(sizes * per)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
    column = np.arange(tail.shape[1])
    for lo in range(0, len(out), LANES):
        at = np.arange(lo, min(lo + LANES, len(out)))
        row = np.searchsorted(ends, at, "right")
        which = at - (ends[row] - sizes[row] * per)
        begin, total = whole_len[row], whole_len[row] + tail_len[which] - 1
        fits = total <= BLOCK
        buf = np.zeros((len(at), 64 + tail.shape[1]), np.uint8)
        buf[:, :head.shape[1]] = head[row]
        short = np.flatnonzero(fits)
        buf[short[:, None], begin[short, None] + column] = tail[which[short]]
        blocks = np.ascontiguousarray(buf[:, :64])
        blocks[:, 56], blocks[:, 57] = (total * 8) & 255, (total * 8 >> 8) & 255
        out[at] = _md5_head(blocks)
        for i in np.flatnonzero(~fits).tolist():
            text = heads[row[i]] + tail[which[i]][:tail_len[which[i]] - 1].tobytes()
            out[lo + i] = int(hashlib.md5(text, usedforsecurity=False).hexdigest()[:13], 16)
    return out


def _batch(seed: str, key: pa.Array, like: pa.Array) -> tuple[list[bytes], np.ndarray]:
    heads = [(seed if k is None else f"{seed}:{k}").encode() + b":" for k in key.to_pylist()]
    return heads, pc.fill_null(pc.list_value_length(like), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _lists(values: pa.Array, sizes: np.ndarray, like: pa.Array) -> pa.Array:
    ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return pa.ListArray.from_arrays(ends, values, mask=like.is_null())


def uniforms(seed, key, like, suffixes: Sequence[str] = ("",)) -> Column:
    """The draws ``hash_uniform(seed, key, place)`` of all places (from 0) of the array
    ``like``, as an array; null for a null array.  With ``suffixes`` every place has
    one draw for each, next to each other, the suffix put behind the place's number."""
    name, tags = str(seed), list(suffixes)

    @F.arrow_udf("array<double>")
    def run(key: pa.Array, like: pa.Array) -> pa.Array:
        heads, sizes = _batch(name, key, like)
        return _lists(pa.array(_draw(heads, sizes, tags) / 4503599627370496.0), sizes * len(tags), like)

    return run((F.col(key) if isinstance(key, str) else key).cast("string"), F.col(like) if isinstance(like, str) else like)


def draw_ranks(seed, key, like) -> Column:
    """For every place of the array ``like``: how many places of it come before by
    (draw, place), the draws being those of :func:`uniforms`."""
    name = str(seed)

    @F.arrow_udf("array<int>")
    def run(key: pa.Array, like: pa.Array) -> pa.Array:
        heads, sizes = _batch(name, key, like)
        draws, row = _draw(heads, sizes, [""]), np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((draws, row))           # stable: equal draws stay in the order of places
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order)) - (np.cumsum(sizes) - sizes)[row]
        return _lists(pa.array(rank), sizes, like)

    return run((F.col(key) if isinstance(key, str) else key).cast("string"), F.col(like) if isinstance(like, str) else like)


class _Words:
    """Tokens of an Arrow batch of arrays, side by side, with the words they belong
    to: a token that ends in ``marker`` (or is null) goes on, a row's last one ends."""

    def __init__(self, seed: str, key: pa.Array, lists: pa.Array, marker: str, eos: str | None):
        self.lists, self.seed = lists, seed
        self.heads, self.size = _batch(seed, key, lists)
        self.tokens = lists.flatten()
        self.ends = np.cumsum(self.size)
        self.starts = self.ends - self.size
        self.row = np.repeat(np.arange(len(self.size)), self.size)
        self.place = np.arange(len(self.tokens)) - self.starts[self.row]
        final = self.ends[self.size > 0] - 1
        closes = ~pc.fill_null(pc.ends_with(self.tokens, marker), True).to_numpy(zero_copy_only=False)
        closes[final] = True
        before = np.cumsum(closes) - closes                                  # words closed before a token, in all rows
        words = np.zeros(len(self.size), np.int64)
        words[self.size > 0] = (np.cumsum(closes)[final])
        words = np.maximum.accumulate(words)
        self.words = np.diff(np.r_[0, words])
        self.word = before - (words - self.words)[self.row]
        self.fixed = np.zeros(len(self.size), bool)
        if eos is not None and len(final):
            self.fixed[self.size > 0] = pc.fill_null(pc.equal(self.tokens.take(pa.array(final)), eos), False).to_numpy(zero_copy_only=False)
        drawn = _draw(self.heads, self.words, [""]) / 4503599627370496.0
        self.u = drawn[(np.cumsum(self.words) - self.words)[self.row] + self.word] if len(self.tokens) else np.zeros(0)

    def taken(self, at: np.ndarray, size: np.ndarray, tokens: pa.Array | None = None) -> pa.Array:
        return _lists((self.tokens if tokens is None else tokens).take(pa.array(at, pa.int64())), size, self.lists)


def shuffled_words(seed, key, tokens, k: float, eos: str | None = None, marker: str = "@@") -> Column:
    """N-03 on the arrays ``tokens``: a word's draw of :func:`uniforms` (the places
    being word numbers) moves it by up to ``k``; the first word and a final ``eos`` stay."""
    name = str(seed)

    @F.arrow_udf("array<string>")
    def run(key: pa.Array, tokens: pa.Array) -> pa.Array:
        w = _Words(name, key, tokens, marker, eos)
        end = w.fixed[w.row] & (w.place == w.size[w.row] - 1)
        score = w.word + np.where(w.word == 0, -1.0, w.u * k) + 1e-6 * w.place
        order = np.lexsort((score, end, w.row))
        s, r, e = score[order], w.row[order], end[order]
        if ((s[1:] == s[:-1]) & (r[1:] == r[:-1]) & (e[1:] == e[:-1])).any():      # equal scores: by token, null first
            text = [(x is not None, (x or "").encode()) for x in w.tokens.to_pylist()]
            order = np.array(sorted(order.tolist(), key=lambda i: (w.row[i], end[i], score[i], text[i])), np.int64)
        return w.taken(order, w.size)

    return F.when(F.size(_col(tokens)) > 0, run(_text(key), _col(tokens)))       # a row without tokens gives null


def dropped_words(seed, key, tokens, p: float, blank: str | None = None, eos: str | None = None, marker: str = "@@") -> Column:
    """N-01 / N-02 on the arrays ``tokens``: words whose draw is below ``p`` go (or
    become ``blank``), a final ``eos`` stays; with one token or none left, a random
    token of the row comes in front."""
    name = str(seed)

    @F.arrow_udf("array<string>")
    def run(key: pa.Array, tokens: pa.Array) -> pa.Array:
        w = _Words(name, key, tokens, marker, eos)
        kept = (w.u >= p) | (w.fixed[w.row] & (w.word == w.words[w.row] - 1))
        values = w.tokens if blank is None else pc.if_else(pa.array(kept), w.tokens, pa.scalar(blank, w.tokens.type))
        at = np.flatnonzero(kept) if blank is None else np.arange(len(kept))
        left = np.bincount(w.row[at], minlength=len(w.size)).astype(np.int64)
        few = np.flatnonzero((left <= 1) & (w.size > 0))
        u = np.array([int(hashlib.md5(w.heads[i] + b"insert", usedforsecurity=False).hexdigest()[:13], 16) for i in few.tolist()], np.int64) / 4503599627370496.0
        extra = w.starts[few] + np.floor(u * w.size[few]).astype(np.int64)
        at = np.insert(at, (np.cumsum(left) - left)[few], extra + (0 if blank is None else len(values)))
        left[few] += 1
        both = values if blank is None else pa.concat_arrays([values, w.tokens])      # an extra token is no blank
        return w.taken(at, left, both)

    return run(_text(key), _col(tokens))


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _text(key) -> Column:
    return _col(key).cast("string")
