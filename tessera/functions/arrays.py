"""Column-level id-array transforms (B-08..B-30, B-34, B-38, B-39).

Every function maps Columns to a Column built from Spark SQL higher-order
functions, so it runs inside generated code on the executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _nonneg(x: Column) -> Column:
    return F.greatest(x, F.lit(0))


def append_eos(col, eos: int) -> Column:
    """B-08: append ``eos`` unless the array already ends with it."""
    a = _c(col)
    return F.when((F.size(a) > 0) & (F.element_at(a, -1) == eos), a).otherwise(F.concat(a, F.array(F.lit(eos))))


def remove_eos(col, eos: int) -> Column:
    """B-08: drop a trailing ``eos``."""
    a = _c(col)
    return F.when((F.size(a) > 0) & (F.element_at(a, -1) == eos), F.slice(a, 1, _nonneg(F.size(a) - 1))).otherwise(a)


def prepend_bos(col, bos: int) -> Column:
    """B-08: put ``bos`` in front unless already there (B-23 is :func:`prepend`)."""
    a = _c(col)
    return F.when((F.size(a) > 0) & (F.element_at(a, 1) == bos), a).otherwise(F.concat(F.array(F.lit(bos)), a))


def replace_last(col, token: int, expect: int | None = None) -> Column:
    """B-09: replace the final id (source end symbol) by a language id."""
    a = _c(col)
    body = F.concat(F.slice(a, 1, _nonneg(F.size(a) - 1)), F.array(F.lit(token)))
    if expect is None:
        return F.when(F.size(a) > 0, body).otherwise(a)
    return F.when((F.size(a) > 0) & (F.element_at(a, -1) == expect), body).otherwise(a)


def replace_first(col, token: int) -> Column:
    """B-09: replace the first id (target start symbol) by a language id."""
    a = _c(col)
    return F.when(F.size(a) > 0, F.concat(F.array(F.lit(token)), F.slice(a, 2, F.size(a)))).otherwise(a)


def prepend(col, token: int | None) -> Column:
    """B-10: size + 1; no-op for a null token."""
    a = _c(col)
    return a if token is None else F.concat(F.array(F.lit(token)), a)


def strip_token(col, token: int) -> Column:
    """B-11: remove every occurrence."""
    return F.array_remove(_c(col), token)


def truncate(col, n: int) -> Column:
    """B-12: keep the first ``n``."""
    return F.slice(_c(col), 1, n)


def truncate_keep_eos(col, n: int, eos: int) -> Column:
    """B-13: longer than ``n`` -> first n with the last one set to ``eos``."""
    a = _c(col)
    return F.when(F.size(a) > n, F.concat(F.slice(a, 1, max(n - 1, 0)), F.array(F.lit(eos)))).otherwise(a)


def offset(col, k: int) -> Column:
    """B-14: add ``k`` to every id."""
    return F.transform(_c(col), lambda x: x + k)


def pair_sequence(src_len, tgt_len, src, tgt, eos: int):
    """B-18: ``eos S eos eos T eos`` with mask 0 x (S+2), 1 x (T+2)."""
    s, t = _c(src), _c(tgt)
    e = F.array(F.lit(eos))
    seq = F.concat(e, s, e, e, t, e)
    mask = F.concat(F.array_repeat(F.lit(0), F.size(s) + 2), F.array_repeat(F.lit(1), F.size(t) + 2))
    return seq, mask


def language_ids(src, tgt, src_lang: int = 14, tgt_lang: int = 4) -> Column:
    """B-18: first S+2 positions carry the source language id, the rest the target's."""
    s, t = _c(src), _c(tgt)
    return F.concat(F.array_repeat(F.lit(src_lang), F.size(s) + 2), F.array_repeat(F.lit(tgt_lang), F.size(t) + 2))


def concat_pair(a, b, lang_a: int, lang_b: int, reset: bool):
    """B-19: join two end-wrapped sequences.  Without reset the shared end
    symbol overlaps (length - 1) and positions continue; with reset the
    positions restart at the second sequence."""
    x, y = _c(a), _c(b)
    if reset:
        seq = F.concat(x, y)
        pos = F.concat(F.sequence(F.lit(0), F.size(x) - 1), F.sequence(F.lit(0), F.size(y) - 1))
        langs = F.concat(F.array_repeat(F.lit(lang_a), F.size(x)), F.array_repeat(F.lit(lang_b), F.size(y)))
    else:
        seq = F.concat(F.slice(x, 1, _nonneg(F.size(x) - 1)), y)
        pos = F.sequence(F.lit(0), F.size(x) + F.size(y) - 2)
        langs = F.concat(F.array_repeat(F.lit(lang_a), F.size(x) - 1), F.array_repeat(F.lit(lang_b), F.size(y)))
    return seq, pos, langs


def target_slice(seq, src_len, tgt_len) -> Column:
    """B-20: the target part of a pair sequence (0-based start S+3, length T)."""
    return F.slice(_c(seq), _c(src_len) + 4, _c(tgt_len))


def shift_right(col, eos: int) -> Column:
    """B-21: teacher-forcing input: the final end id moves to the front."""
    a = _c(col)
    return F.concat(F.array(F.lit(eos)), F.slice(a, 1, _nonneg(F.size(a) - 1)))


def lm_source(col, eos: int) -> Column:
    """B-22: model input for a one-sentence block: shifted right by one,
    led by the end symbol (the block itself is the 'future' target)."""
    a = _c(col)
    return F.concat(F.array(F.lit(eos)), F.slice(a, 1, _nonneg(F.size(a) - 1)))


def lm_past(col, pad: int, eos: int) -> Column:
    """B-22 'past' target: shifted right by two, led by pad then end symbol."""
    a = _c(col)
    return F.concat(F.array(F.lit(pad), F.lit(eos)), F.slice(a, 1, _nonneg(F.size(a) - 2)))


def clip_vocab(col, n: int, unk: int) -> Column:
    """B-23: ids >= ``n`` become ``unk``."""
    return F.transform(_c(col), lambda x: F.when(x >= n, F.lit(unk)).otherwise(x))


def make_positions(col, pad: int) -> Column:
    """B-24: non-pad ids numbered pad+1, pad+2, ... in order; pads stay pad.
    Pass a column reference: the array is scanned once per element."""
    a = _c(col)
    return F.transform(a, lambda x, i: F.when(x == pad, F.lit(pad)).otherwise(
        (F.size(F.filter(F.slice(a, 1, i + 1), lambda y: y != pad)) + pad).cast("int")))


def flip_padding(col, pad: int, to_left: bool) -> Column:
    """B-25: move padding to the other end: rotate the row by its number of
    pads (interior pads keep their place in the rotated order).  Row form of a
    batch rule: a row that does not end (``to_left``) or begin in a pad has its
    padding on the wanted side, or none, and stays as it is."""
    a = _c(col)
    n, npad = F.size(a), F.size(F.filter(a, lambda x: x == pad))
    head = npad if not to_left else n - npad          # what the rotation moves to the back
    turned = F.concat(F.slice(a, head + 1, F.greatest(n - head, F.lit(0))), F.slice(a, 1, head))
    return F.when((n > 0) & (F.get(a, n - 1 if to_left else F.lit(0)) == pad), turned).otherwise(a)


def flip_keep_first(col, length) -> Column:
    """B-26: reverse positions 1..len-1, keep position 0 and anything after len."""
    a, n = _c(col), _c(length)
    return F.concat(F.slice(a, 1, 1), F.reverse(F.slice(a, 2, _nonneg(n - 1))), F.slice(a, n + 1, F.size(a)))


def word_bytes(word, max_len: int, special=None) -> Column:
    """B-27: UTF-8 byte values + 1, zero padded / truncated to ``max_len``;
    specials are all zeros."""
    w = _c(word)
    hexed = F.regexp_extract_all(F.hex(F.encode(w, "UTF-8")), F.lit("(..)"), 1)
    codes = F.transform(hexed, lambda h: F.conv(h, 16, 10).cast("int") + 1)
    padded = F.slice(F.concat(codes, F.array_repeat(F.lit(0), F.lit(max_len))), 1, max_len)
    zeros = F.array_repeat(F.lit(0), max_len)
    return padded if special is None else F.when(_c(special), zeros).otherwise(padded)


def band(id_col, cutoffs: Sequence[int]):
    """B-28: adaptive-softmax bands: id in [c_i, c_{i+1}) -> head id c_0 + i - 1
    and tail id id - c_i (head ids below c_0 pass through)."""
    x = _c(id_col)
    head = x
    tail = F.lit(None).cast("int")
    for i in range(len(cutoffs) - 1, 0, -1):
        inside = (x >= cutoffs[i - 1]) & (x < cutoffs[i])
        head = F.when(inside, F.lit(cutoffs[0] + i - 1)).otherwise(head)
        tail = F.when(inside, x - cutoffs[i - 1]).otherwise(tail)
    return head, tail


def wrap_pair(a, b, cls: int, sep: int):
    """B-29: ``cls a sep b sep`` with segment 0 for ``cls a sep`` and 1 after."""
    x, y = _c(a), _c(b)
    seq = F.concat(F.array(F.lit(cls)), x, F.array(F.lit(sep)), y, F.array(F.lit(sep)))
    seg = F.concat(F.array_repeat(F.lit(0), F.size(x) + 2), F.array_repeat(F.lit(1), F.size(y) + 1))
    return seq, seg


def schedule_value(step, knots: Sequence[tuple[int, float]]) -> Column:
    """B-34 / J-05: piecewise-linear value over a knot list; constant after the
    last knot, an error before the first."""
    s = _c(step)
    out = F.lit(float(knots[-1][1]))
    for (xa, ya), (xb, yb) in reversed(list(zip(knots[:-1], knots[1:]))):
        out = F.when((s >= xa) & (s < xb), F.lit(ya) + (s - xa) * F.lit((yb - ya) / (xb - xa))).otherwise(out)
    return F.when(s < knots[0][0], F.raise_error(F.lit("step before the first knot")).cast("double")).otherwise(out)


def knots_of(table, knot: str = "step", value: str = "value", at_most: int = 1000) -> list[tuple[int, float]]:
    """J-05: the knot list of a (small, checked) knot table, in order."""
    rows = table.select(knot, value).orderBy(knot).limit(at_most + 1).collect()
    if not 0 < len(rows) <= at_most:
        raise ValueError(f"a schedule has 1 to {at_most} knots")
    return [(r[0], float(r[1])) for r in rows]


def vec_mul(a, b) -> Column:
    """B-39: element-wise product."""
    return F.zip_with(_c(a), _c(b), lambda x, y: x * y)


def vec_mask(vec, mask) -> Column:
    """B-39: zero the values where mask is 0 (padding)."""
    return F.zip_with(_c(vec), _c(mask), lambda x, m: F.when(m == 0, F.lit(0.0)).otherwise(x))


def repeats_ngram(col, n: int) -> Column:
    """C-11: true when some n-gram occurs twice."""
    a = _c(col)
    cnt = F.greatest(F.size(a) - n + 1, F.lit(0))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(cnt, F.lit(1))), lambda i: F.slice(a, i, n))
    grams = F.slice(grams, 1, cnt)  # drop the placeholder when too short
    return F.size(F.array_distinct(grams)) < F.size(grams)
