"""Byte-pair merges (H-02): learn from a word-frequency table, apply to words.

Learning works on the *distinct-word* table.  Its state is that table and one of pair
counts, each written once a round; the former ones are deleted, and no word is shuffled:

1. the best ``width`` pairs (count descending, then pair ascending) are candidates;
2. a scan of the words finds those that hold one;
3. a prefix of the candidates is accepted whose pairs are, one after the other,
   what the one-by-one learner would take (see ``_accepted``);
4. the words that hold an accepted pair are rewritten, and the difference of their
   old and new pairs is added to the counts; the other words are copied.

The driver sees ``width`` candidates a round and the merges, never words.

Applying follows the rank rule (repeatedly merge the lowest-ranked adjacent
pair present in the word) per distinct word, as a small helper inside an
Arrow UDF; words are joined back by the H-01 path.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import cut_lineage, discard

WIDTH = 256          # candidates a round


def merge_all(symbols: list[str], merges: set[tuple[str, str]]) -> list[str]:
    """Merge every adjacent pair of ``merges``, left to right, without overlaps."""
    out: list[str] = []
    fresh = False                      # the last of ``out`` was just merged
    for x in symbols:
        if out and not fresh and (out[-1], x) in merges:
            out[-1] += x
            fresh = True
        else:
            out.append(x)
            fresh = False
    return out


def _pairs(words: DataFrame) -> DataFrame:
    """``(a, b, word, c)`` of all adjacent symbols of ``(word, syms, c)``."""
    n = F.greatest(F.size("syms") - 1, F.lit(0))
    zipped = F.arrays_zip(F.slice("syms", 1, n).alias("a"), F.slice("syms", 2, n).alias("b"))
    return words.select(F.explode(zipped).alias("p"), "word", "c").select("p.a", "p.b", "word", "c")


def _holds(pairs: list[tuple[str, str]]) -> Column:
    """Whether ``syms`` has one of ``pairs`` side by side."""
    n = F.greatest(F.size("syms") - 1, F.lit(0))
    name = lambda a, b: F.concat(F.length(a).cast("string"), F.lit(":"), a, b)
    held = F.transform(F.arrays_zip(F.slice("syms", 1, n).alias("a"), F.slice("syms", 2, n).alias("b")), lambda p: name(p["a"], p["b"]))
    return F.arrays_overlap(held, F.array(*[name(F.lit(a), F.lit(b)) for a, b in pairs]))


def _accepted(top: list, best_new: dict, known: set[str]) -> list[tuple[str, str]]:
    """The longest prefix of the candidates ``top`` (a, b, n) that the one-by-one
    learner takes in this order.  Merging (a, b) lowers only counts of pairs that
    end in a or begin with b, so a candidate keeps its count unless it is one of
    those (or a pair of equal symbols shares one).  A new pair holds the merged
    symbol and counts at most as often as the three symbols it comes from; the best
    such bound of every accepted pair, ``best_new`` (-n, pair), has to rank behind
    the candidate.  A merge whose symbol an earlier round made (``known``) adds
    to old pairs and so ends the prefix."""
    taken: list[tuple[str, str]] = []
    made: set[str] = set()
    limit = None
    for a, b, n in top:
        clash = any(b == x or a == y or ((a == b or x == y) and {a, b} & {x, y}) for x, y in taken)
        if taken and (clash or a + b in made or {a, b} & made or limit <= (-n, (a, b))):
            break
        taken.append((a, b))
        made.add(a + b)
        new = best_new.get((a, b))
        if new is not None:
            limit = new if limit is None else min(limit, new)
        else:
            limit = limit if limit is not None else (1, ("", ""))
        if a + b in known:
            break
    return taken


def _best_new(touched: DataFrame, top: DataFrame) -> dict:
    """For each candidate the best rank, (-n, pair), that a pair made by its
    merge can have: counts of three adjacent symbols, and for equal counts the
    smallest pair, the outer symbol being itself or any candidate's merged symbol."""
    n = F.greatest(F.size("syms") - 2, F.lit(0))
    triples = touched.select(F.explode(F.arrays_zip(F.slice("syms", 1, n).alias("x"), F.slice("syms", 2, n).alias("y"), F.slice("syms", 3, n).alias("z"))).alias("t"), "c")
    triples = triples.groupBy("t.x", "t.y", "t.z").agg(F.sum("c").alias("n"))
    left = triples.join(F.broadcast(top.select(F.col("a").alias("y"), F.col("b").alias("z"))), ["y", "z"])
    left = left.join(F.broadcast(top.select(F.col("b").alias("x"), F.concat("a", "b").alias("m"))), "x", "left")
    left = left.select(F.col("y").alias("a"), F.col("z").alias("b"), "n", F.struct(F.least("x", F.coalesce("m", "x")).alias("p"), F.concat("y", "z").alias("q")).alias("pair"))
    right = triples.join(F.broadcast(top.select(F.col("a").alias("x"), F.col("b").alias("y"))), ["x", "y"])
    right = right.join(F.broadcast(top.select(F.col("a").alias("z"), F.concat("a", "b").alias("m"))), "z", "left")
    right = right.select(F.col("x").alias("a"), F.col("y").alias("b"), "n", F.struct(F.concat("x", "y").alias("p"), F.least("z", F.coalesce("m", "z")).alias("q")).alias("pair"))
    best = left.unionByName(right).groupBy("a", "b").agg(F.min(F.struct((-F.col("n")).alias("n"), "pair")).alias("r"))
    return {(r.a, r.b): (r.r.n, (r.r.pair.p, r.r.pair.q)) for r in best.collect()}


def learn_rounds(words: DataFrame, word: str, count: str, n_merges: int, min_count: int = 2, width: int = WIDTH) -> list[list[tuple[str, str]]]:
    """Merges by round; ``words`` holds one row per distinct word with its
    frequency.  Learning stops before ``n_merges`` when no pair occurs ``min_count``
    times.  An empty or null word has no pairs."""
    spark = words.sparkSession
    first = words.select(F.col(word).alias("word"), F.filter(F.split(word, ""), lambda x: x != "").alias("syms"), F.col(count).cast("long").alias("c"))
    state = cut_lineage(first.filter(F.size("syms") > 1))
    counts = cut_lineage(_pairs(state).groupBy("a", "b").agg(F.sum("c").alias("n")))
    rounds: list[list[tuple[str, str]]] = []
    left = n_merges
    while left > 0:
        top = counts.filter(F.col("n") >= min_count).orderBy(F.col("n").desc(), "a", "b").limit(min(width, left)).collect()
        if not top:
            break
        pairs = spark.createDataFrame([(r.a, r.b) for r in top], "a string, b string")
        holds = _holds([(r.a, r.b) for r in top])
        touched = cut_lineage(state.filter(holds))
        taken = _accepted([(r.a, r.b, r.n) for r in top], _best_new(touched, pairs), {a + b for r in rounds for a, b in r})
        merges = set(taken)

        def rewrite(batches: Iterator[pd.DataFrame], merges=merges) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b.assign(new=[merge_all(list(s), merges) for s in b["syms"]])

        # a word that the accepted pairs leave as it was is copied with the rest
        done = cut_lineage(touched.mapInPandas(rewrite, "word string, syms array<string>, c bigint, new array<string>"))
        rounds.append(taken)
        left -= len(taken)
        changed = done.filter(F.size("new") != F.size("syms"))
        after = done.select("word", F.col("new").alias("syms"), "c")
        delta = _pairs(changed.select("word", F.col("new").alias("syms"), "c")).select("a", "b", F.col("c").alias("n")).unionByName(
            _pairs(changed).select("a", "b", (-F.col("c")).alias("n")))
        total = counts.unionByName(delta).groupBy("a", "b").agg(F.sum("n").alias("n")).filter(F.col("n") > 0)
        total = cut_lineage(total)
        rest = cut_lineage(state.filter(~holds).unionByName(after).filter(F.size("syms") > 1)) if left > 0 else None
        for t in [counts, touched, done, state]:
            discard(t)
        counts, state = total, rest
    return rounds


def learn_merges(words: DataFrame, word: str, count: str, n_merges: int, min_count: int = 2) -> list[tuple[int, str, str]]:
    """The learned merges as a list of (rank, a, b)."""
    flat = [p for r in learn_rounds(words, word, count, n_merges, min_count) for p in r]
    return [(i, a, b) for i, (a, b) in enumerate(flat)]


def bpe_word(word: str, ranks: dict) -> list[str]:
    """Rank rule on one word: merge the lowest-ranked adjacent pair until
    none of the pairs is a known merge."""
    parts = list(word)
    while len(parts) > 1:
        cands = [(ranks.get((parts[i], parts[i + 1]), None), i) for i in range(len(parts) - 1)]
        cands = [c for c in cands if c[0] is not None]
        if not cands:
            break
        rank = min(c[0] for c in cands)
        a, b = next((parts[i], parts[i + 1]) for r, i in cands if r == rank)
        out, i = [], 0
        while i < len(parts):
            if i < len(parts) - 1 and parts[i] == a and parts[i + 1] == b:
                out.append(a + b)
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return parts


def merges_applier(merges):
    """pandas function for :func:`tessera.operators.extras.apply_word_tokenizer`
    (the merge list is bounded by the number of learned merges)."""
    ranks = {(a, b): r for r, a, b in merges}

    def fn(words: pd.Series) -> pd.Series:
        return words.map(lambda w: bpe_word(w, ranks))
    return fn


