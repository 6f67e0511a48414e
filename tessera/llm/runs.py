"""Periodic runs of words by a dictionary of basic factors (operator 12).

A run is a stretch of words with smallest period ``q`` (words ``q`` apart are
identical) of at least ``max(min_length, 2 q)`` words that neither neighbouring
word extends.

For every power of two ``L`` the dictionary names the factors of ``L`` words:
equal names, equal words.  A run with ``L <= q < 2 L`` holds a place whose factor
comes again ``q`` words later, so periods are proposed by occurrences that follow
one another within ``2 L`` words; such occurrences form arithmetic progressions:

* if the next occurrence is over ``L / 2`` away, the next three are proposed (more
  do not fit);
* else the factor itself is periodic with that difference ``d``.  Inside the
  progression only ``d`` can be a smallest period (found at a lower level), so it
  is skipped, and the first occurrence behind its end is proposed.  If all factors
  of the run's first period are like that, they share ``d``, the second period
  starts a progression of its own, and no occurrence lies between: it is that one.

A proposal is extended to both sides by comparing names from long to short
factors.  Proposals of one period that touch belong to one run, and of runs with
equal borders the one with the smallest period is kept; multiples of a period
have the same borders.  Work is n log n for n words whatever the text is.

Words are named by Arrow's exact dictionary encoding together with their row, so
no factor spans two texts, and factors that occur once are not followed further.

Defined results: a null or empty text has no words and no runs; null ids are
ids like others (``planted`` leaves their texts alone); repeated rows are worked
on one by one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, Words, slices

MIN_LENGTH = 12


class Factors:
    """Names of the factors of 1, 2, 4, ... symbols; a factor that occurs once
    in all has a name of its own."""

    def __init__(self, symbols: np.ndarray, longest: int):
        self.n = n = len(symbols)
        self.names: list[np.ndarray] = []
        self.order: list[np.ndarray] = []       # places of repeated factors, by name and place
        self.last: list[np.ndarray] = []        # whether no equal factor follows in that order
        at, key = np.arange(n), np.asarray(symbols, np.int64)
        length = 1
        while length <= longest:
            by = np.argsort(key, kind="stable")
            at, key = at[by], key[by]
            new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
            name = np.cumsum(new) - 1
            many = np.bincount(name)[name] > 1 if len(name) else new
            names = n + np.arange(n)
            names[at[many]] = name[many]
            self.names.append(names)
            at, name = at[many], name[many]
            self.order.append(at)
            self.last.append(np.concatenate([name[1:] != name[:-1], [True]]) if len(name) else np.zeros(0, bool))
            if not len(at):
                break
            at = np.sort(at[at + 2 * length <= n])
            at = at[(names[at] < n) & (names[at + length] < n)]
            key = names[at] * n + names[at + length]
            length *= 2

    def same_right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal symbols from ``a`` and ``b > a`` on."""
        a, b = a.copy(), b.copy()
        begin = a.copy()
        for k in range(len(self.names) - 1, -1, -1):
            open_ = np.flatnonzero(b + (1 << k) <= self.n)
            while len(open_):
                open_ = open_[self.names[k][a[open_]] == self.names[k][b[open_]]]
                a[open_] += 1 << k
                b[open_] += 1 << k
                open_ = open_[b[open_] + (1 << k) <= self.n] if k == len(self.names) - 1 else open_[:0]
        return a - begin

    def same_left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal symbols before ``a`` and ``b > a``."""
        a, b = a.copy(), b.copy()
        begin = a.copy()
        for k in range(len(self.names) - 1, -1, -1):
            open_ = np.flatnonzero(a >= 1 << k)
            while len(open_):
                open_ = open_[self.names[k][a[open_] - (1 << k)] == self.names[k][b[open_] - (1 << k)]]
                a[open_] -= 1 << k
                b[open_] -= 1 << k
                open_ = open_[a[open_] >= 1 << k] if k == len(self.names) - 1 else open_[:0]
        return begin - a

    def proposals(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """``(place, period)``, periods from ``2**k`` to below ``2**(k + 1)``."""
        size, pos, last = 1 << k, self.order[k], self.last[k]
        m = len(pos)
        none = 4 * size                                     # farther than any period of this level
        gap = np.full(m, none)
        inner = np.flatnonzero(~last)
        gap[inner] = np.minimum(pos[inner + 1] - pos[inner], none)
        index = np.arange(m)
        # first index from which on the gap is another one: the end of the progression
        change = np.concatenate([np.flatnonzero(gap[1:] != gap[:-1]) + 1, [m]])
        end = change[np.searchsorted(change, index, "right")]
        close = gap <= size // 2
        near = np.flatnonzero(close & (end < m))
        behind = end[near]                                  # the progression's last place; what follows is proposed
        far = pos[np.minimum(behind + 1, m - 1)] - pos[near]
        found = [(near[gap[behind] < none], far[gap[behind] < none])]
        at, reach = np.flatnonzero(~close & (gap < none)), None
        to = at.copy()
        for _ in range(3):
            ok = gap[to] < none
            at, to = at[ok], to[ok] + 1
            reach = pos[to] - pos[at]
            found.append((at, reach))
            ok = reach < 2 * size
            at, to = at[ok], to[ok]
        where = np.concatenate([a for a, _ in found])
        period = np.concatenate([q for _, q in found])
        ok = (period >= size) & (period < 2 * size)
        return pos[where[ok]], period[ok]

    def runs(self, min_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(start, end, period)`` of all runs, by start and period."""
        found = []
        for k in range(len(self.names)):
            if not len(self.order[k]):
                break
            place, q = self.proposals(k)
            by = np.lexsort((place, q))
            place, q = place[by], q[by]
            if len(q):
                head = np.concatenate([[True], (q[1:] != q[:-1]) | (place[1:] - place[:-1] > 1 << k)])
                place, q = place[head], q[head]
            left = self.same_left(place, place + q)
            right = self.same_right(place, place + q)
            long = left + right >= np.maximum(q, min_length - q)
            found.append(np.stack([place - left, place + q + right, q])[:, long])
        if not found:
            return (np.zeros(0, np.int64),) * 3
        start, end, q = np.concatenate(found, axis=1)
        by = np.lexsort((q, end, start))
        start, end, q = start[by], end[by], q[by]
        head = np.ones(len(q), bool)
        head[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
        start, end, q = start[head], end[head], q[head]
        by = np.lexsort((q, start))
        return start[by], end[by], q[by]


def word_names(words: Words) -> np.ndarray:
    """Numbers of the words, equal for equal words of one row only."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    ends = np.cumsum(words.end - words.start)
    data = np.ascontiguousarray(words.buf[words.inside])
    coded = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
    return words.row.astype(np.int64) * len(coded.dictionary) + coded.indices.to_numpy()


def _ragged(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def find(docs: DataFrame, min_length: int = MIN_LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_words, runs, collapsed)`` of every row: its runs by start
    and period, and the words that are left, joined by spaces, when of each run
    only the first period stays."""
    d = docs.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in slices(batch.column(1)):
                w = Words(buf, offs, SPACE)
                n = len(w)
                longest = max(1, int(w.count.max(initial=0)) // 2)
                start, end, q = Factors(word_names(w), longest).runs(min_length)
                row = w.row[start]
                depth = np.zeros(n + 1, np.int64)
                np.add.at(depth, start + q, 1)
                np.add.at(depth, end, -1)
                stay = np.cumsum(depth[:n]) == 0
                # kept words and one space behind each but the last of a row
                kept = np.flatnonzero(stay)
                size = w.end[kept] - w.start[kept]
                more = np.concatenate([w.row[kept][1:] == w.row[kept][:-1], [False]]).astype(np.int64) if len(kept) else np.zeros(0, np.int64)
                ends = np.concatenate([[0], np.cumsum(size + more)])
                out = np.full(ends[-1], 0x20, np.uint8)
                at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                out[np.repeat(ends[:-1], size) + at] = buf[np.repeat(w.start[kept], size) + at]
                text = pa.Array.from_buffers(pa.large_string(), hi - lo, [None, pa.py_buffer(ends[np.searchsorted(kept, w.first)].astype(np.int64)), pa.py_buffer(out)])
                value = pa.StructArray.from_arrays([pa.array(start - w.first[row], pa.int64()), pa.array(end - start, pa.int64()), pa.array(q, pa.int64())],
                                                   names=["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(w.count.astype(np.int64)), _ragged(value, np.searchsorted(row, np.arange(hi - lo + 1))), text.cast(pa.string())],
                    names=[id_col, "n_words", "runs", "collapsed"])

    return d.mapInArrow(run, f"`{id_col}` {d.schema[id_col].dataType.simpleString()}, n_words bigint, runs {RUN}, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` with periods planted in every tenth document by
    ``h = crc32(doc_id)``: from word ``a`` on, the ``p`` words from there repeat."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    d = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("w"), F.floor(h / 10).alias("g"))
    d = d.withColumn("n", F.coalesce(F.size("w"), F.lit(0)))
    d = d.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    d = d.withColumn("p", F.expr("cast(1 + floor((n - a) / (3 + g % 8)) as int)"))
    again = F.expr("concat(slice(w, 1, a), slice(flatten(array_repeat(slice(w, a + 1, p), cast(ceil((n - a) / p) as int))), 1, n - a))")
    return d.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def report(docs: DataFrame) -> DataFrame:
    """Runs of every document with planted periods; digests of all runs and of
    the collapsed text, and the longest run (ties: smallest start, then period)."""
    r = find(planted(docs))
    lines = F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n")))
    best = F.array_max(F.transform("runs", lambda x: F.struct(x["length"].alias("length"), (-x["start"]).alias("start"), (-x["period"]).alias("period"))))
    r = r.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
                 F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return r.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
                    F.expr("1000 * best.length div -best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
