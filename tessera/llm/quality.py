"""Quality rules with a perplexity band per language (operator 5).

The language model is a byte 5-gram model of words (``charlm``), counted by
Spark over all documents, language by language, smoothed by modified Kneser-Ney
and looked up in sorted hash arrays, or, beyond ``charlm.MODEL_ROWS`` n-grams of
the highest order over all languages, joined with the distinct words; either way
every language keeps all its n-grams.  A document's score is its mean log
probability per byte.  Documents whose score lies outside their language's band
are rejected.  Where ``labels`` name at least ``MIN_GOOD`` good documents of a
language that pass the plain rules, the band is fitted on them, on all of them: its
borders leave ``LOST`` of them out on each side, by their deviation from the
language's median score, weighted with ``sqrt(bytes / (bytes + LENGTH))`` because
short texts scatter.  Other languages, and all without labels, have a wide band: the
middle half of the language's scores widened by
``REACH`` times its own width to either side, plus ``SHORT / sqrt(bytes)``, the
chance variation of a short text.  Scores below the band are text of another
kind or language than it says, scores above it are monotonous.

Plain rules come first: fewer than ``MIN_WORDS`` words, or more than half of the
words inside 3-word windows that occur twice or more in the text, fail.

Defined results: a null or empty text has no words and fails; a null language is
a language of its own; the bands of a language come from its documents that pass
the plain rules, a language with none has no band; repeated rows are judged one
by one; an empty table gives an empty result; other columns are not read.  A label
counts for all rows of its ``doc_id``; labels that are null or contradict each other,
or are of unknown or null ids, count for none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import charlm
from tessera.llm.common import LOWER, SPACE, U64, Words, cut, gram_hash, mix64, per_row, slices, small, span_hash, within_row

MIN_WORDS = 50
REPEAT_PERCENT = 50
REACH = 10.0
SHORT = 6.0
MIN_GOOD = 200
LOST = 0.0025
LENGTH = 3000
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def twice(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each (row, hash): how often it occurs."""
    _, inverse, count = np.unique(h + mix64(row.astype(U64)), return_inverse=True, return_counts=True)
    return count[inverse]


def features(w: Words, h: np.ndarray) -> dict[str, np.ndarray]:
    buf, offs = w.buf, w.offs
    rows = len(offs) - 1
    chars = w.inside & ((buf & 0xC0) != 0x80)
    # lines: spans between line feeds and text borders, that hold a word
    n = len(buf)
    feeds = np.flatnonzero(buf == 0x0A)
    start = np.unique(np.concatenate([offs[:-1], feeds + 1]))
    start = start[start < n]
    stop = np.append(start[1:], n)
    ends_in_feed = buf[stop - 1] == 0x0A if n else np.zeros(0, bool)
    stop = stop - ends_in_feed
    inside = np.concatenate([[0], np.cumsum(w.inside)])
    worded = inside[stop] > inside[start]
    start, stop = start[worded], stop[worded]
    line_row = np.searchsorted(offs, start, "right") - 1
    key = span_hash(buf, start, stop) + mix64(line_row.astype(U64))
    _, first = np.unique(key, return_index=True)
    dup = np.ones(len(key), np.int64)
    dup[first] = 0
    # words in repeated 3-word windows
    covered = np.zeros(len(w), bool)
    whole = np.flatnonzero(within_row(w, 3))
    if len(whole):
        again = whole[twice(w.row[whole], gram_hash(h, 3)[whole]) > 1]
        for j in range(3):
            covered[again + j] = True
    return {"n_words": w.count.astype(np.int64), "word_chars": per_row(chars, offs), "n_symbols": per_row(_SYMBOL[buf], offs),
            "n_dup_lines": np.bincount(line_row, dup, rows).astype(np.int64), "n_repeat_words": per_row(covered, w.first)}


def _measure(models):
    """``models``: broadcast arrays by language, or None if the words are to be
    joined later (they are returned then, and the score is 0)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell = {k: charlm.Speller(charlm.HashArrays(v)) for k, v in models.value.items()} if models else {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=str)
            for lo, hi, buf, offs in slices(batch.column(2)):
                rows = hi - lo
                f = features(w := Words(buf, offs, SPACE), Words(buf, offs, SPACE).hashes())
                low = LOWER[buf]
                h = span_hash(low, w.start, w.end)
                total = np.zeros(rows)
                if models:
                    for lang, mine, one, inverse in charlm.lang_words(langs[lo:hi], w, h):
                        score = spell[lang].score(low, w.start[one], w.end[one], h[one])
                        total += np.bincount(w.row[mine], score[inverse], rows)
                units = per_row(w.inside, offs) + w.count
                columns = [batch.column(0).slice(lo, rows), batch.column(1).slice(lo, rows), *(pa.array(f[n]) for n in FEATURES),
                           pa.array(units), pa.array(total / np.maximum(units, 1))]
                names = ["doc_id", "lang", *FEATURES, "units", "score"]
                if not models:
                    word, inverse = np.unique(h, return_inverse=True)
                    pair, n = np.unique(w.row * max(1, len(word)) + inverse.reshape(-1), return_counts=True)
                    row, at = np.divmod(pair, max(1, len(word)))
                    columns, names = columns + [charlm.word_lists(rows, row, word[at], n)], names + ["words"]
                yield pa.RecordBatch.from_arrays(columns, names=names)
    return run


def _deviation() -> Column:
    return (F.col("score") - F.col("middle")) * F.sqrt(F.col("units") / (F.col("units") + F.lit(LENGTH)))


def _by_language(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows with their language's row of a written table: broadcast while there are
    few languages, or a language would be one task."""
    return rows.join(F.broadcast(table) if small(table, charlm.LANGUAGES) else table, "lang", "left")


def bands(passed: DataFrame, labels: DataFrame | None, label_key: Column) -> DataFrame:
    """``(lang, low, middle, high, low_cut, high_cut)``: quartiles of the scores of the
    documents that pass the plain rules, and borders of the deviation, null where not fitted."""
    q = F.percentile_approx("score", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(10000))
    band = cut(passed.groupBy("lang").agg(q.alias("q")).select("lang", *[F.col("q")[i].alias(n) for i, n in enumerate(("low", "middle", "high"))]))
    none = F.lit(None).cast("double")
    if labels is None:
        return band.withColumns({"low_cut": none, "high_cut": none})
    good = labels.groupBy(F.col("doc_id").alias("_label")).agg(F.min("quality").alias("a"), F.max("quality").alias("b")).filter("a = 1 and b = 1").select("_label")
    rows = passed.select("lang", "score", "units", label_key.alias("_label")).join(good, "_label")
    borders = F.percentile_approx(_deviation(), F.array(F.lit(LOST), F.lit(1 - LOST)), F.lit(100000))
    fitted = _by_language(rows, band).groupBy("lang").agg(borders.alias("q"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_GOOD)
    fitted = cut(fitted.select("lang", F.col("q")[0].alias("low_cut"), F.col("q")[1].alias("high_cut")))
    return cut(_by_language(band, fitted))


def judged(docs: DataFrame, labels: DataFrame | None = None, label_key: Column | None = None) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, perplexity, kept)`` of every row; ``label_key`` finds the ``doc_id``
    of ``labels`` in that of ``docs``."""
    d = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), "text")
    grams = charlm.count_grams(d)
    model = charlm.smoothed(grams)
    kind = d.schema["doc_id"].dataType.simpleString()
    head = f"doc_id {kind}, lang string, {', '.join(f'{n} bigint' for n in FEATURES)}, units bigint, score double"
    if charlm.few(grams):
        scored = cut(d.mapInArrow(_measure(d.sparkSession.sparkContext.broadcast(charlm.arrays(model))), head))
    else:
        rows = cut(d.mapInArrow(_measure(None), f"{head}, words array<struct<word:bigint,n:bigint>>").withColumn("_row", F.monotonically_increasing_id()))
        each = rows.select("_row", "lang", F.explode("words").alias("w")).select("_row", "lang", "w.word", "w.n")
        sums = (each.join(charlm.word_scores(charlm.spellings(d), model), ["lang", "word"])
                .groupBy("_row").agg(F.sum(F.col("n") * F.col("spelled")).alias("total")))
        mean = F.coalesce("total", F.lit(0.0)) / F.greatest("units", F.lit(1))
        scored = cut(rows.drop("words", "score").join(sums, "_row", "left").withColumn("score", mean).drop("_row", "total"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed)
    band = bands(scored.filter(~failed), labels, F.col("doc_id") if label_key is None else label_key)
    slack = REACH * (F.col("high") - F.col("low")) + SHORT / F.sqrt(F.greatest("units", F.lit(1)))
    wide = F.coalesce(F.col("score").between(F.col("low") - slack, F.col("high") + slack), F.lit(True))
    within = F.when(F.col("low_cut").isNull(), wide).otherwise(_deviation().between(F.col("low_cut"), F.col("high_cut")))
    return (_by_language(scored, band).select("doc_id", *FEATURES, "base_failed", F.exp(-F.col("score")).alias("perplexity"),
                                              (~F.col("base_failed") & within).alias("kept"), "lang", "score", "units", "low", "high"))


def report(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    return judged(docs, labels).drop("lang", "score", "units", "low", "high")
