"""Byte n-gram models of words, counted and smoothed by Spark.

A word is the byte string ``^^^^ w1 .. wm $`` (both marks are a space, which no
word holds); its probability is the product over w1 .. wm, $ of the byte's
probability after the ``ORDER - 1`` bytes before.  An n-gram is the integer of
its bytes, oldest first, so dropping the oldest byte is a mask and dropping the
newest a shift.  Smoothing is interpolated modified Kneser-Ney: lower orders
count distinct left neighbours (n-grams that begin with the word's start keep
their counts), three discounts per order come from the counts of counts.

Counts cover all given texts, and a model holds every n-gram.  Up to
``MODEL_ROWS`` n-grams of the highest order it is sent to the tasks whole;
beyond that it stays a table, with which the n-grams of the texts' distinct
words are joined (``word_scores``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, SPACE, U64, Words, cut, mix64, slices, small

ORDER = 5
MARK = 0x20
EMPTY_WORD = int.from_bytes(bytes([MARK]) * ORDER, "big")
MODEL_ROWS = 4_000_000
LANGUAGES = 100_000     # rows of three numbers that are broadcast
HELD = 1 << 21          # n-grams a counting task holds before it merges them
NEVER = -99.0


def mask(k: int) -> int:
    return (1 << 8 * k) - 1


def word_grams(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(word index, n-gram)`` for each byte of each word and its end mark."""
    size = end - start + 1
    word = np.repeat(np.arange(len(start)), size)
    t = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
    gram = np.zeros(len(word), U64)
    for back in range(ORDER - 1, -1, -1):
        at = t - back
        inside = (at >= 0) & (at < (end - start)[word])
        byte = np.where(inside, buf[np.clip(start[word] + at, 0, max(0, len(buf) - 1))], MARK) if len(buf) else np.full(len(word), MARK)
        gram = gram << U64(8) | byte.astype(U64)
    return word, gram


def merged(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and their summed weights."""
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(weights, first) if len(first) else weights


class Tally:
    """Counts of integer keys by group, merged whenever they have become many."""

    def __init__(self):
        self.parts: dict = {}

    def add(self, group, keys: np.ndarray, weights: np.ndarray) -> None:
        held = self.parts.setdefault(group, [])
        held.append(merged(keys, weights))
        if sum(len(k) for k, _ in held) > HELD:
            self.parts[group] = [self._merge(held)]

    @staticmethod
    def _merge(held: list) -> tuple[np.ndarray, np.ndarray]:
        return merged(np.concatenate([k for k, _ in held]), np.concatenate([w for _, w in held]))

    def batches(self, names: list[str], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
        for group, held in self.parts.items():
            keys, weights = self._merge(held)
            for a in range(0, len(keys), rows):
                k = keys[a:a + rows]
                yield pa.RecordBatch.from_arrays([pa.array([group] * len(k), pa.string()), pa.array(k.view(np.int64)), pa.array(weights[a:a + rows])], names=names)


def lang_words(langs: np.ndarray, words: Words, h: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """By language: indexes of its words, of one word of each spelling among
    them, and the spelling of each."""
    for lang in np.unique(langs).tolist():
        mine = np.flatnonzero((langs == lang)[words.row])
        if len(mine):
            _, first, inverse = np.unique(h[mine], return_index=True, return_inverse=True)
            yield lang, mine, mine[first], inverse


def _count(ends: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=str)
            for lo, hi, buf, offs in slices(batch.column(1)):
                w = Words(buf, offs, SPACE, LOWER)
                for lang, _, one, inverse in lang_words(langs[lo:hi], w, w.hashes()):
                    word, gram = word_grams(w.buf, w.start[one], w.end[one])
                    tally.add(lang, gram, np.bincount(inverse, minlength=len(one)).astype(np.int64)[word])
                if ends:
                    for lang, n in zip(*np.unique(langs[lo:hi], return_counts=True)):
                        tally.add(str(lang), np.array([EMPTY_WORD], U64), np.array([n], np.int64))
        yield from tally.batches(["lang", "gram", "n"])
    return run


def count_grams(texts: DataFrame, ends: bool = False) -> DataFrame:
    """``(lang, gram, n)`` over all words of ``(lang, text)`` and, with ``ends``,
    over an empty word at the end of each text."""
    partial = texts.select("lang", "text").mapInArrow(_count(ends), "lang string, gram bigint, n bigint")
    return cut(partial.groupBy("lang", "gram").agg(F.sum("n").alias("n")))


def _discounts(level: DataFrame) -> DataFrame:
    """Per language: what is taken off counts of 1, 2, and 3 or more."""
    n = [F.sum((F.col("c") == i).cast("double")) for i in (1, 2, 3, 4)]
    d = level.groupBy("lang").agg(*[x.alias(f"n{i + 1}") for i, x in enumerate(n)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

    def cutoff(i: int):
        raw = i - (i + 1) * y * F.col(f"n{i + 1}") / F.nullif(F.col(f"n{i}"), F.lit(0.0))
        return F.least(F.lit(i - 0.05), F.greatest(F.lit(0.05), F.coalesce(F.nanvl(raw, F.lit(0.5)), F.lit(0.5))))

    d = d.withColumn("n1", F.greatest("n1", F.lit(1e-9)))
    return d.select("lang", *[cutoff(i).alias(f"d{i}") for i in (1, 2, 3)])


def smoothed(counts: DataFrame) -> DataFrame:
    """``(lang, k, gram, logp, logb)`` of all orders k: natural logarithms of the
    probability of the newest byte and of the weight the n-gram gives, as a
    context, to the order below.  ``k = 0`` is the uniform byte."""
    levels = {ORDER: cut(counts.select("lang", "gram", F.col("n").alias("raw"), F.col("n").alias("c")))}
    for k in range(ORDER - 1, 0, -1):
        low = levels[k + 1].groupBy("lang", F.col("gram").bitwiseAND(F.lit(mask(k))).alias("gram")).agg(
            F.sum("raw").alias("raw"), F.count(F.lit(1)).alias("types"))
        starts = (F.shiftright("gram", 8 * (k - 1)) == MARK) & F.lit(k > 1)
        levels[k] = cut(low.select("lang", "gram", "raw", F.when(starts, F.col("raw")).otherwise(F.col("types")).alias("c")))
    out, lower = [], None
    for k in range(1, ORDER + 1):
        off_by = cut(_discounts(levels[k]))              # a row per language: broadcast, or a language would be one task
        off_by = F.broadcast(off_by) if small(off_by, LANGUAGES) else off_by
        lv = levels[k].withColumn("ctx", F.shiftright("gram", 8)).join(off_by, "lang")
        off = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        lv = lv.withColumn("off", F.least(off, F.col("c").cast("double")))
        ctx = cut(lv.groupBy("lang", "ctx").agg(F.sum("c").alias("total"), F.sum("off").alias("freed"))
                  .select("lang", "ctx", "total", (F.col("freed") / F.col("total")).alias("gamma")))
        lv = lv.join(ctx, ["lang", "ctx"])
        if lower is None:
            p = lv.withColumn("below", F.lit(1 / 256))
        else:
            low = lower.select("lang", F.col("gram").alias("sfx"), F.col("p").alias("below"))
            p = lv.withColumn("sfx", F.col("gram").bitwiseAND(F.lit(mask(k - 1)))).join(low, ["lang", "sfx"])
        lower = cut(p.select("lang", "gram", ((F.col("c") - F.col("off")) / F.col("total") + F.col("gamma") * F.col("below")).alias("p")))
        out.append((lower, ctx))
    rows = None
    for k in range(0, ORDER + 1):
        here = out[k - 1][0].select("lang", "gram", F.log("p").alias("logp")) if k else out[0][1].select(
            "lang", F.lit(0).cast("long").alias("gram"), F.lit(float(np.log(1 / 256))).alias("logp"))
        if k < ORDER:
            back = out[k][1].select("lang", F.col("ctx").alias("gram"), F.log("gamma").alias("logb"))
            here = here.join(back, ["lang", "gram"], "full")
        else:
            here = here.withColumn("logb", F.lit(0.0))
        here = here.select("lang", F.lit(k).alias("k"), "gram", F.coalesce("logp", F.lit(NEVER)).alias("logp"), F.coalesce("logb", F.lit(0.0)).alias("logb"))
        rows = here if rows is None else rows.union(here)
    return cut(rows)


def few(counts: DataFrame) -> bool:
    """Whether the model of these counts is sent to the tasks whole."""
    return counts.count() <= MODEL_ROWS


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    met = Memo()
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), dtype=str)
        for lo, hi, buf, offs in slices(batch.column(1)):
            w = Words(buf, offs, SPACE, LOWER)
            h = w.hashes()
            for lang, _, one, _ in lang_words(langs[lo:hi], w, h):
                salt = U64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "big"))
                key = mix64(h[one] + salt)
                new = ~met.get(key)[1]
                met.put(key[new], np.zeros(int(new.sum())))
                one = one[new]
                size = w.end[one] - w.start[one]
                ends = np.concatenate([[0], np.cumsum(size)])
                data = w.buf[np.arange(ends[-1]) + np.repeat(w.start[one] - ends[:-1], size)]
                spelling = pa.Array.from_buffers(pa.string(), len(one), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(one), pa.string()), pa.array(h[one].view(np.int64)), spelling], names=["lang", "word", "spelling"])


def spellings(texts: DataFrame) -> DataFrame:
    """``(lang, word, spelling)``: the distinct words of ``(lang, text)``, by hash;
    a task returns a word once, as long as it remembers it."""
    return texts.select("lang", "text").mapInArrow(_spell, "lang string, word bigint, spelling string").dropDuplicates(["lang", "word"])


def _spelled_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, offs in slices(batch.column(2)):
            word, gram = word_grams(buf, offs[:-1], offs[1:])
            at = pa.array(word + lo)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(gram.view(np.int64))], names=["lang", "word", "gram"])


def gram_scores(grams: DataFrame, model: DataFrame) -> DataFrame:
    """``(lang, gram, value)`` of distinct n-grams of the highest order: what
    ``HashArrays.score`` gives, by joins with the model's table."""
    rows = grams.select("lang", "gram", F.lit(0.0).alias("back"), F.lit(None).cast("double").alias("value"))
    done = None
    for k in range(ORDER, -1, -1):
        known = model.filter((F.col("k") == k) & (F.col("logp") > NEVER + 1)).select("lang", F.col("gram").alias("_key"), F.col("logp").alias("_p"))
        rows = rows.withColumn("_key", F.col("gram").bitwiseAND(F.lit(mask(k)))).join(known, ["lang", "_key"], "left")
        rows = rows.select("lang", "gram", "back", F.coalesce("value", F.col("back") + F.col("_p")).alias("value"))
        if k == ORDER:                                   # few are left for the lower orders
            rows = cut(rows)
            done, rows = rows.filter(F.col("value").isNotNull()), rows.filter(F.col("value").isNull())
        if k:
            weight = model.filter(F.col("k") == k - 1).select("lang", F.col("gram").alias("_key"), F.col("logb").alias("_b"))
            rows = rows.withColumn("_key", F.shiftright("gram", 8).bitwiseAND(F.lit(mask(k - 1)))).join(weight, ["lang", "_key"], "left")
            rows = rows.select("lang", "gram", (F.col("back") + F.coalesce("_b", F.lit(0.0))).alias("back"), "value")
    floor = F.col("back") + F.lit(float(np.log(1 / 256)))
    return done.select("lang", "gram", "value").union(rows.select("lang", "gram", F.coalesce("value", floor).alias("value")))


def word_scores(words: DataFrame, model: DataFrame) -> DataFrame:
    """``(lang, word, spelled)``: log probabilities of the words of ``spellings``."""
    grams = cut(words.select("lang", "word", "spelling").mapInArrow(_spelled_grams, "lang string, word bigint, gram bigint"))
    value = gram_scores(grams.select("lang", "gram").distinct(), model)
    return cut(grams.join(value, ["lang", "gram"]).groupBy("lang", "word").agg(F.sum("value").alias("spelled")))


def word_lists(rows: int, row: np.ndarray, word: np.ndarray, n: np.ndarray) -> pa.Array:
    """``array<struct<word, n>>`` of each row, from a list of (row, word, n)."""
    order = np.argsort(row, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(word[order].view(np.int64)), pa.array(n[order])], names=["word", "n"])
    return pa.ListArray.from_arrays(pa.array(ends), pairs)


def arrays(model: DataFrame) -> dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """A (``few``) model by language: for each order, sorted n-grams, logp, logb."""
    table = model.toArrow()
    lang = np.array(table["lang"].to_pylist(), dtype=str)
    k, gram = table["k"].to_numpy(), table["gram"].to_numpy().view(U64)
    logp, logb = table["logp"].to_numpy(), table["logb"].to_numpy()
    out = {}
    for name in np.unique(lang).tolist():
        levels = []
        for order in range(ORDER + 1):
            at = np.flatnonzero((lang == name) & (k == order))
            at = at[np.argsort(gram[at])]
            levels.append((gram[at], logp[at], logb[at]))
        out[name] = levels
    return out


class HashArrays:
    """One language's model in sorted hash arrays, searched by bisection."""

    def __init__(self, levels: list):
        key = np.concatenate([self._key(k, g) for k, (g, _, _) in enumerate(levels)])
        order = np.argsort(key)
        self.key = key[order]
        self.logp = np.concatenate([p for _, p, _ in levels])[order].astype(np.float32)
        self.logb = np.concatenate([b for _, _, b in levels])[order].astype(np.float32)

    @staticmethod
    def _key(k: int, gram: np.ndarray) -> np.ndarray:
        return mix64(gram + (U64(k) << U64(56)))

    def _find(self, k: int, gram: np.ndarray) -> np.ndarray:
        key = self._key(k, gram)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, at, -1)

    def score(self, gram: np.ndarray) -> np.ndarray:
        """Log probability of each n-gram's newest byte: the longest known
        n-gram's, plus the weights of the longer known contexts."""
        out, todo = np.zeros(len(gram)), np.arange(len(gram))
        for k in range(ORDER, -1, -1):
            g = gram[todo] & U64(mask(k))
            at = self._find(k, g)
            hit = at >= 0
            if k:
                hit &= self.logp[at] > NEVER + 1
            out[todo[hit]] += self.logp[at[hit]]
            todo = todo[~hit]
            if k and len(todo):
                ctx = self._find(k - 1, gram[todo] >> U64(8) & U64(mask(k - 1)))
                out[todo] += np.where(ctx >= 0, self.logb[ctx], 0.0)
        return out


class Memo:
    """Values by key, in a large sorted part and a small one that is merged into
    it now and then; emptied when it holds ``LIMIT`` keys."""

    LIMIT, SMALL = 1 << 21, 1 << 15

    def __init__(self):
        self.parts = [(np.zeros(0, U64), np.zeros(0)) for _ in range(2)]

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of (distinct) keys, and which of them are known."""
        out, seen = np.zeros(len(keys)), np.zeros(len(keys), bool)
        for known, value in self.parts:
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[at] == keys
                out[hit] = value[at[hit]]
                seen |= hit
        return out, seen

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        (k, v), (ks, vs) = self.parts
        if len(k) + len(ks) + len(keys) > self.LIMIT:
            self.__init__()
            (k, v), (ks, vs) = self.parts
        ks, vs = self._sorted(np.concatenate([ks, keys]), np.concatenate([vs, values]))
        if len(ks) > max(self.SMALL, len(k) // 4):
            k, v = self._sorted(np.concatenate([k, ks]), np.concatenate([v, vs]))
            ks, vs = ks[:0], vs[:0]
        self.parts = [(k, v), (ks, vs)]

    @staticmethod
    def _sorted(k: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(k, kind="stable")
        return k[order], v[order]


class Speller:
    """Log probabilities of words, by hash; a word is spelled out and an n-gram
    is looked up once a task."""

    def __init__(self, model):
        self.model, self.words, self.grams = model, Memo(), Memo()

    def score(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> np.ndarray:
        """For words of distinct, ascending hashes ``h``."""
        out, seen = self.words.get(h)
        new = np.flatnonzero(~seen)
        if len(new):
            word, gram = word_grams(buf, start[new], end[new])
            distinct, inverse = np.unique(gram, return_inverse=True)
            value, known = self.grams.get(distinct)
            ask = distinct[~known]
            if len(ask):
                value[~known] = self.model.score(ask)
                self.grams.put(ask, value[~known])
            out[new] = np.bincount(word, value[inverse], len(new))
            self.words.put(h[new], out[new])
        return out
