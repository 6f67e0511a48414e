"""Corpus BLEU (G-19 single reference on id arrays, G-20 multiple references
on token arrays).

N-grams never leave their row: an Arrow batch of (hypothesis, references) rows is
counted as a whole.  Tokens are numbered by exact dictionary encoding, an n-gram is
numbered from the number of its first n - 1 tokens and its last token, and
clipped matches come from sorted (row, n-gram) keys, all in numpy.  A task returns
four rows a batch, one per order, and only those are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDERS = 4


def bleu_trim(col, pad: int, eos: int) -> Column:
    """Drop leading pads, then trailing end/pad ids (at least one id stays)."""
    a = F.col(col) if isinstance(col, str) else col
    lead = F.array_position(F.transform(a, lambda x: x != pad), F.lit(True))
    a1 = F.when(lead == 0, F.slice(a, 1, 0)).otherwise(F.slice(a, F.greatest(lead, F.lit(1)), F.size(a)))
    rev = F.reverse(a1)
    tail = F.array_position(F.transform(rev, lambda x: (x != pad) & (x != eos)), F.lit(True))
    keep = F.when(tail == 0, F.lit(1)).otherwise(F.size(a1) - tail + 1)
    return F.slice(a1, 1, keep)


def _score(stats: DataFrame, smooth: bool) -> DataFrame:
    """stats rows: (n, match, total, predlen, reflen) -> one BLEU row."""
    agg = stats.agg(
        F.sum("predlen").alias("predlen"), F.sum("reflen").alias("reflen"),
        *[F.sum(F.when(F.col("n") == k, F.col("match")).otherwise(0)).alias(f"m{k}") for k in range(1, ORDERS + 1)],
        *[F.sum(F.when(F.col("n") == k, F.col("total")).otherwise(0)).alias(f"c{k}") for k in range(1, ORDERS + 1)])
    add = [0] + [1 if smooth else 0] * (ORDERS - 1)
    p = [F.coalesce(F.try_divide((F.col(f"m{k}") + add[k - 1]).cast("double"), F.col(f"c{k}") + add[k - 1]),
                    F.lit(0.0)) for k in range(1, ORDERS + 1)]
    any_zero = p[0] == 0
    for x in p[1:]:
        any_zero = any_zero | (x == 0)
    logmean = sum((F.log(x) for x in p[1:]), F.log(p[0])) / ORDERS
    bp = F.least(F.lit(1.0), F.exp(1.0 - F.try_divide(F.col("reflen").cast("double"), F.col("predlen"))))
    out = agg.select(*[F.col(c).cast("long").alias(c) for c in agg.columns],
                     bp.alias("bp"), F.when(any_zero, F.lit(0.0)).otherwise(bp * F.exp(logmean) * 100.0).alias("bleu"))
    return out


STATS = "n int, match bigint, total bigint, predlen bigint, reflen bigint"


ROWS = 2000            # rows that are counted at a time


class Sides:
    """Token sequences of one side: numbers of their tokens, one sequence behind
    another, the row of each sequence, and where each begins and ends."""

    def __init__(self, ids: np.ndarray, size: np.ndarray, row: np.ndarray):
        self.ids, self.size, self.row = ids, size, row
        self.ends = np.cumsum(size)
        self.seq = np.repeat(np.arange(len(size)), size)

    def trimmed(self, pads: np.ndarray, ends: np.ndarray) -> Sides:
        """Without leading pads, and trailing pads and ends (one token stays)."""
        pos, n = np.arange(len(self.ids)), len(self.size)
        some = np.flatnonzero(self.size > 0)
        begin, stop = np.full(n, len(pos)), np.full(n, 0)
        if len(some):
            at = (self.ends - self.size)[some]
            begin[some] = np.minimum.reduceat(np.where(pads, len(pos), pos), at)
            stop[some] = np.maximum.reduceat(np.where(pads | ends, -1, pos), at) + 1
        stop = np.maximum(stop, begin + 1)
        keep = (pos >= begin[self.seq]) & (pos < stop[self.seq])
        return Sides(self.ids[keep], np.bincount(self.seq[keep], minlength=n), self.row)

    def grams(self, order: int) -> np.ndarray:
        """Places at which an n-gram of that order starts."""
        pos = np.arange(len(self.ids))
        return pos[pos + order <= self.ends[self.seq]]


def _counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(key, return_counts=True)


def clipped(hyp: Sides, refs: Sides, rows: int, max_order: int) -> list[tuple[int, int]]:
    """``(matches, n-grams of the hypotheses)`` of each order: a row's n-gram
    matches as often as in the reference that has most of it."""
    out = []
    h, r = hyp.ids, refs.ids                   # numbers of the n-grams that start at each place
    for order in range(1, max_order + 1):
        ha, ra = hyp.grams(order), refs.grams(order)
        if order > 1:
            width = max(hyp.ids.max(initial=0), refs.ids.max(initial=0)) + 1
            key = np.concatenate([h[ha] * width + hyp.ids[ha + order - 1], r[ra] * width + refs.ids[ra + order - 1]])
            number = np.unique(key, return_inverse=True)[1].reshape(-1)
            h, r = h.copy(), r.copy()
            h[ha], r[ra] = number[:len(ha)], number[len(ha):]
        many = max(h[ha].max(initial=0), r[ra].max(initial=0)) + 1
        mine, have = _counted(hyp.row[hyp.seq[ha]] * many + h[ha])
        each, count = _counted(refs.seq[ra] * many + r[ra])
        per_row = refs.row[each // many] * many + each % many
        order_ = np.argsort(per_row, kind="stable")
        per_row, count = per_row[order_], count[order_]
        head = np.flatnonzero(np.concatenate([[True], per_row[1:] != per_row[:-1]])) if len(per_row) else np.zeros(0, np.int64)
        keys, most = per_row[head], np.maximum.reduceat(count, head) if len(head) else count
        at = np.minimum(np.searchsorted(keys, mine), max(0, len(keys) - 1))
        hit = keys[at] == mine if len(keys) else np.zeros(len(mine), bool)
        out.append((int(np.minimum(have[hit], most[at[hit]]).sum()), len(ha)))
    return out


def _numbers(values: list[pa.Array]) -> list[np.ndarray]:
    """Equal numbers for equal values over some columns (nulls are equal)."""
    coded = pa.concat_arrays([v.cast(values[0].type) for v in values]).dictionary_encode()
    ids = coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(ids, np.cumsum([len(v) for v in values])[:-1])


def _sizes(column: pa.Array) -> np.ndarray:
    return column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _row_stats(max_order: int, pad: int | None, eos: int | None, unk: int | None):
    """Clipped n-gram matches of (hypothesis, references) rows; ids are trimmed
    first if a pad is given, and an unknown id of a reference never matches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), ROWS):
                batch = whole.slice(lo, ROWS)
                rows = np.arange(len(batch))
                h, lists = batch.column(0), batch.column(1)
                refs = lists.flatten()
                ht, rt = h.flatten(), refs.flatten()
                hi, ri = _numbers([ht, rt])
                hyp, ref = Sides(hi, _sizes(h), rows), Sides(ri, _sizes(refs), np.repeat(rows, _sizes(lists)))
                if pad is not None:
                    ids = [x.fill_null(pad).to_numpy(zero_copy_only=False) for x in (ht, rt)]
                    ref.ids = np.where(ids[1] == unk, ref.ids + hyp.ids.max(initial=0) + ref.ids.max(initial=0) + 1, ref.ids)
                    hyp, ref = (s.trimmed(i == pad, i == eos) for s, i in zip((hyp, ref), ids))
                got = clipped(hyp, ref, len(batch), max_order)
                near = 0
                if len(ref.size):
                    far = (np.abs(ref.size - hyp.size[ref.row]) << 32) + ref.size         # closest, then shortest
                    head = np.flatnonzero(np.concatenate([[True], ref.row[1:] != ref.row[:-1]]))
                    near = int((np.minimum.reduceat(far, head) & ((1 << 32) - 1)).sum())
                first = [1] + [0] * (max_order - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(1, max_order + 1), pa.int32()), pa.array([m for m, _ in got], pa.int64()), pa.array([t for _, t in got], pa.int64()),
                     pa.array([int(hyp.size.sum()) * f for f in first], pa.int64()), pa.array([near * f for f in first], pa.int64())],
                    names=["n", "match", "total", "predlen", "reflen"])
    return run


def ngram_stats(rows: DataFrame, max_order: int = ORDERS, pad: int | None = None, eos: int | None = None, unk: int | None = None) -> DataFrame:
    """``(n, match, total, predlen, reflen)`` of ``(hyp, refs)`` rows: no n-gram
    leaves its row, only partial sums are shuffled."""
    part = rows.select("hyp", "refs").mapInArrow(_row_stats(max_order, pad, eos, unk), STATS)
    return part.groupBy("n").agg(*[F.sum(c).cast("long").alias(c) for c in ("match", "total", "predlen", "reflen")])


def bleu(df: DataFrame, key: str, hyp: str, ref: str, pad: int = 1, eos: int = 2, unk: int = 3,
         smooth: bool = False) -> DataFrame:
    """G-19: corpus BLEU over id arrays; reference unk ids never match."""
    rows = df.select(F.col(hyp).alias("hyp"), F.array(F.col(ref)).alias("refs"))
    return _score(ngram_stats(rows, pad=pad, eos=eos, unk=unk), smooth)


def bleu_multi(hyp: DataFrame, refs: DataFrame, key: str, tokens: str = "tokens", ref_idx: str = "ref",
               lowercase: bool = False) -> DataFrame:
    """G-20: multiple references: clip by the per-gram maximum over the
    references; reference length = closest to the hypothesis (ties: the
    shorter); a zero reference length gives 0.  A key's references are gathered
    once (their number is small by nature) and joined to its hypothesis."""
    low = (lambda c: F.transform(F.col(c), lambda x: F.lower(x))) if lowercase else F.col
    r = refs.groupBy(key).agg(F.collect_list(low(tokens)).alias("refs"))
    rows = hyp.select(key, low(tokens).alias("hyp")).join(r, key, "left")
    out = _score(ngram_stats(rows), smooth=False)
    # min(1, e^(1 - r/h)) equals the 'shorter than reference' rule
    return out.withColumn("bleu", F.when(F.col("reflen") == 0, F.lit(0.0)).otherwise(F.col("bleu")))
