"""Column-level text and sub-word functions (B-01, B-05..B-07, B-31..B-37).

All of them are built from Spark SQL expressions so they stay inside
whole-stage code generation; none calls into Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's ``str.split()`` treats as white space
# (ASCII controls 09-0D, 1C-1F, 85, and every Unicode separator \p{Z}).
WHITESPACE_CLASS = r"[\t\n\x0B\f\r\x1C-\x1F\x85\p{Z}]+"
TOKEN_START = WHITESPACE_CLASS.replace("[", "[^", 1).rstrip("+")      # found where a text has a token
# Sub-word continuation marker and sentencepiece word marker.
BPE_CONT = "@@"
SPM_MARK = "▁"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def tokenize(col) -> Column:
    """B-01: split on Unicode white space, dropping empty pieces."""
    return F.filter(F.split(_c(col), WHITESPACE_CLASS), lambda x: x != "")


def remove_bpe(col, marker: str | None = "@@ ") -> Column:
    """B-05: undo sub-word segmentation of a detokenised string.

    ``marker='sentencepiece'`` drops spaces and turns the word marker into a
    space; any other marker is removed from ``text + ' '`` and the result is
    right-trimmed.
    """
    c = _c(col)
    if marker is None:
        return c
    if marker == "sentencepiece":
        return F.trim(F.replace(F.replace(c, F.lit(" "), F.lit("")), F.lit(SPM_MARK), F.lit(" ")))
    return F.rtrim(F.replace(F.concat(c, F.lit(" ")), F.lit(marker), F.lit("")))


def remove_bpe_regex(col) -> Column:
    """B-05 regex form: drop '@@ ' and a trailing '@@'."""
    return F.regexp_replace(_c(col), r"(@@ )|(@@ ?$)", "")


def word_end_positions(tokens, marker: str = BPE_CONT, end_marker: bool = False) -> Column:
    """0-based positions that close a word; the last position always closes."""
    t = _c(tokens)
    n = F.size(t)
    if end_marker:
        closes = lambda i: F.endswith(F.element_at(t, i + 1), F.lit(marker))
    else:
        closes = lambda i: ~F.endswith(F.element_at(t, i + 1), F.lit(marker))
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(
        F.filter(F.sequence(F.lit(0), n - 1), lambda i: closes(i) | (i == n - 1)))


def word_spans(tokens, marker: str = BPE_CONT, end_marker: bool = False) -> Column:
    """B-07: inclusive (start, end) token span of every word, in order.

    Built without referring to an outer array inside a lambda, so the cost
    stays linear in the sentence length."""
    ends = word_end_positions(tokens, marker, end_marker)
    starts = F.concat(F.array(F.lit(0)),
                      F.transform(F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0))), lambda e: e + 1))
    return F.arrays_zip(starts.alias("start"), ends.alias("end"))


def word_index(tokens, marker: str = BPE_CONT, end_marker: bool = False) -> Column:
    """B-06: word number of every token (continued tokens share the number).

    Linear in sentence length: one ``array_repeat`` per word, flattened.
    """
    spans = word_spans(tokens, marker, end_marker)
    return F.flatten(F.transform(spans, lambda s, k: F.array_repeat(k, s["end"] - s["start"] + 1)))


def render_tags(col) -> Column:
    """B-31: 1 -> 'OK', anything else -> 'BAD'."""
    return F.transform(_c(col), lambda x: F.when(x == 1, F.lit("OK")).otherwise(F.lit("BAD")))


def interleave(gap, word) -> Column:
    """B-32: g0 w0 g1 w1 ... g(n-1) w(n-1) gn."""
    g, w = _c(gap), _c(word)
    pairs = F.transform(w, lambda x, i: F.array(F.element_at(g, i + 1), x))
    return F.concat(F.flatten(pairs), F.array(F.element_at(g, -1)))


def binarize(col, threshold: float = 0.5) -> Column:
    """B-33: strictly greater than ``threshold`` -> 1 else 0."""
    return F.transform(_c(col), lambda x: F.when(x > threshold, F.lit(1)).otherwise(F.lit(0)))


def argmax(col) -> Column:
    """B-36: 0-based position of the first maximum."""
    c = _c(col)
    return (F.array_position(c, F.array_max(c)) - 1).cast("int")


def tag_lines(text, row_id) -> Column:
    """B-35: append two spaces and the 1-based line number in brackets."""
    return F.concat(_c(text), F.lit("  ("), (_c(row_id) + 1).cast("string"), F.lit(")"))


def parse_int_list(col) -> Column:
    """A-07: whitespace separated integers."""
    return F.transform(tokenize(col), lambda x: x.cast("int"))


def parse_spans(col) -> Column:
    """A-08: '[(0, 0), (1, 2)]' -> array<struct<start,end>> without eval."""
    c = _c(col)
    starts = F.regexp_extract_all(c, F.lit(r"\(\s*(-?\d+)\s*,"), 1)
    ends = F.regexp_extract_all(c, F.lit(r",\s*(-?\d+)\s*\)"), 1)
    return F.transform(F.arrays_zip(starts, ends), lambda z: F.struct(
        z["0"].cast("int").alias("start"), z["1"].cast("int").alias("end")))
