"""Vocabulary building, encoding and decoding (G-01..G-07, B-02..B-04, J-02, J-17).

Vocabulary table: ``(id INT, symbol STRING, count BIGINT, is_special BOOLEAN)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ids import with_row_id

# Special symbols and their ids, first vocabulary layout.
SPECIALS = ["<s>", "<pad>", "</s>", "<unk>"]
BOS, PAD, EOS, UNK = 0, 1, 2, 3
# Second layout (<s> </s> <pad> <unk> then ten <special%i>).
SPECIALS_ALT = ["<s>", "</s>", "<pad>", "<unk>"] + [f"<special{i}>" for i in range(10)]
BOS_ALT, EOS_ALT, PAD_ALT, UNK_ALT = 0, 1, 2, 3
# Filler symbol pattern used to pad the vocabulary size.
FILLER_FMT = "madeupword%04d"

# Row bound under which a vocabulary is broadcast to every task.
MAX_BROADCAST_VOCAB = 2_000_000


def sized_broadcast(small: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast ``small`` only when it provably has at most ``max_rows`` rows;
    otherwise return it unchanged so the join shuffles (AQE splits skew)."""
    n = small.limit(max_rows + 1).count()
    return F.broadcast(small) if n <= max_rows else small


def count_vocab(df: DataFrame, tokens: str = "tokens", eos: str = "</s>") -> DataFrame:
    """G-01: symbol counts over all sentences plus one end symbol per line.

    Map-side partial counts (HashAggregate partial/final) make a hot token
    cost one row per task before the shuffle.
    """
    # explode_outer avoids an inferred size() > 0 filter that would tokenize twice
    return (df.select(F.explode_outer(F.concat(F.col(tokens), F.array(F.lit(eos)))).alias("symbol"))
            .groupBy("symbol").agg(F.count(F.lit(1)).alias("count")))


def finalize_vocab(counts: DataFrame, threshold: int = -1, nwords: int = -1,
                   padding_factor: int = 8, specials: Sequence[str] = SPECIALS) -> DataFrame:
    """G-04: specials first (their counts kept), then symbols by count desc,
    symbol asc; at most ``nwords`` ids in total; counts below ``threshold``
    dropped; filler symbols with count 0 pad the size to a multiple of
    ``padding_factor``."""
    spark = counts.sparkSession
    nspecial = len(specials)
    spec_tab = spark.createDataFrame([(i, s) for i, s in enumerate(specials)], "id int, symbol string")
    spec_counts = counts.filter(F.col("symbol").isin(list(specials)))  # at most nspecial rows
    spec_rows = (spec_tab.join(spec_counts, "symbol", "left")
                 .select("id", "symbol", F.coalesce("count", F.lit(0)).cast("long").alias("count"),
                         F.lit(True).alias("is_special")))
    rest = counts.join(F.broadcast(spec_tab.select("symbol")), "symbol", "left_anti")
    if threshold > 0:
        rest = rest.filter(F.col("count") >= threshold)
    neg = (-F.col("count"))
    # coarse buckets on a log scale of the count (a few hundred rows whatever
    # the corpus size), fine buckets split equal counts by symbol prefix
    coarse = -F.floor(F.log2(F.greatest(F.col("count"), F.lit(1))) * 8)
    ranked = with_row_id(rest, [neg, F.col("symbol")],
                         fine=[neg, F.substring("symbol", 1, 3)], coarse=[coarse], out="rank")
    if nwords > 0:
        ranked = ranked.filter(F.col("rank") < nwords - nspecial)
    words = ranked.select((F.col("rank") + nspecial).cast("int").alias("id"), "symbol",
                          F.col("count").cast("long").alias("count"), F.lit(False).alias("is_special"))
    vocab = spec_rows.unionByName(words)
    if padding_factor > 1:
        total = words.agg(F.count(F.lit(1)).alias("n")).select((F.col("n") + nspecial).alias("n"))
        npad = F.pmod(-F.col("n"), F.lit(padding_factor))
        fill = (total.select("n", F.explode(F.slice(F.sequence(F.lit(0), F.lit(padding_factor - 1)),
                                                    1, npad.cast("int"))).alias("i"))
                .select((F.col("n") + F.col("i")).cast("int").alias("id"),
                        F.format_string(FILLER_FMT, F.col("i")).alias("symbol"),
                        F.lit(0).cast("long").alias("count"), F.lit(False).alias("is_special")))
        vocab = vocab.unionByName(fill)
    return vocab


def build_vocab(df: DataFrame, tokens: str = "tokens", threshold: int = -1, nwords: int = -1,
                padding_factor: int = 8) -> DataFrame:
    return finalize_vocab(count_vocab(df, tokens), threshold, nwords, padding_factor)


def merge_vocab(a: DataFrame, b: DataFrame) -> DataFrame:
    """G-03: counts add; symbols new to ``a`` follow in ``b``'s id order."""
    both = (a.select("symbol", "count", F.lit(0).alias("src"), "id")
            .unionByName(b.select("symbol", "count", F.lit(1).alias("src"), "id")))
    merged = both.groupBy("symbol").agg(F.sum("count").alias("count"),
                                        F.min(F.struct("src", "id")).alias("first"))
    na = a.agg(F.max("id")).first()[0] + 1  # scalar: size of ``a``
    from_b = merged.filter(F.col("first.src") == 1)
    b_ranked = with_row_id(from_b, [F.col("first.id")], fine=[F.floor(F.col("first.id") / 65536)],
                           coarse=[F.floor(F.col("first.id") / (1 << 26))], out="r")
    return (merged.filter(F.col("first.src") == 0)
            .select(F.col("first.id").cast("int").alias("id"), "symbol", "count")
            .unionByName(b_ranked.select((F.lit(na) + F.col("r")).cast("int").alias("id"),
                                         "symbol", "count")))


def lookup_tokens(df: DataFrame, keys: Sequence[str], vocab: DataFrame, tokens: str = "tokens",
                  unk: int = UNK, max_broadcast: int = MAX_BROADCAST_VOCAB) -> DataFrame:
    """J-02 on exploded tokens: ``(keys..., pos, symbol, tid)``; unknown -> ``unk``.

    Sentences without tokens keep one row with ``pos`` NULL so they survive
    the regrouping.
    """
    ex = df.select(*keys, F.posexplode_outer(tokens).alias("pos", "symbol"))
    v = sized_broadcast(vocab.select("symbol", F.col("id").alias("_vid")), max_broadcast)
    return (ex.join(v, "symbol", "left")
            .select(*keys, "pos", "symbol",
                    F.when(F.col("pos").isNull(), F.lit(None))
                    .otherwise(F.coalesce("_vid", F.lit(unk))).cast("int").alias("tid")))


def lookup_strict(df: DataFrame, keys: Sequence[str], vocab: DataFrame, tokens: str = "tokens",
                  max_broadcast: int = MAX_BROADCAST_VOCAB) -> DataFrame:
    """J-02, strict: as :func:`lookup_tokens`, but a symbol that the vocabulary
    lacks fails the job where it is met."""
    ex = df.select(*keys, F.posexplode_outer(tokens).alias("pos", "symbol"))
    v = sized_broadcast(vocab.select("symbol", F.col("id").alias("_vid")), max_broadcast)
    missing = F.raise_error(F.concat(F.lit("not in the vocabulary: "), F.col("symbol"))).cast("int")
    return (ex.join(v, "symbol", "left")
            .select(*keys, "pos", "symbol", F.when(F.col("pos").isNull(), F.lit(None))
                    .when(F.col("_vid").isNull(), missing).otherwise(F.col("_vid")).cast("int").alias("tid")))


def assemble(ex: DataFrame, keys: Sequence[str], col: str = "tid", out: str = "ids") -> DataFrame:
    """Regroup exploded ``(keys, pos, col)`` rows into an ordered array."""
    return (ex.groupBy(*keys)
            .agg(F.array_sort(F.filter(F.collect_list(F.struct("pos", col)),
                                       lambda s: s["pos"].isNotNull())).alias("_s"))
            .select(*keys, F.transform("_s", lambda s: s[col]).alias(out)))


def encode(df: DataFrame, keys: Sequence[str], vocab: DataFrame, tokens: str = "tokens",
           append_eos: bool = True, reverse: bool = False, eos: int = EOS, unk: int = UNK,
           max_broadcast: int = MAX_BROADCAST_VOCAB) -> DataFrame:
    """B-02: token array -> id array (unknown -> unk, optional reverse, end id).

    The compact sentence rows are hash-partitioned by key *before* the
    explode, so the regrouping after the (broadcast) lookup needs no second
    exchange of the much more numerous token rows (measured ~40% faster)."""
    ex = lookup_tokens(df.repartition(*keys), keys, vocab, tokens, unk, max_broadcast)
    out = assemble(ex, keys)
    ids = F.col("ids")
    if reverse:
        ids = F.reverse(ids)
    if append_eos:
        ids = F.concat(ids, F.array(F.lit(eos)))
    return out.select(*keys, ids.alias("ids"))


def encode_special(df: DataFrame, keys: Sequence[str], vocab: DataFrame, tokens: str = "tokens",
                   nspecial: int = len(SPECIALS_ALT), unk: int = UNK_ALT, eos: int = EOS_ALT,
                   max_broadcast: int = MAX_BROADCAST_VOCAB) -> DataFrame:
    """B-03: second layout; special symbols written in the text (other than
    unk) are dropped; end id appended."""
    ex = lookup_tokens(df, keys, vocab, tokens, unk, max_broadcast)
    ex = ex.filter(F.col("pos").isNull() | (F.col("tid") >= nspecial) | (F.col("tid") == unk))
    out = assemble(ex, keys)
    return out.select(*keys, F.concat("ids", F.array(F.lit(eos))).alias("ids"))


def encode_stats(ex: DataFrame, keys: Sequence[str], unk: int = UNK, unk_word: str = "<unk>") -> DataFrame:
    """G-06 from :func:`lookup_tokens` output: sentences, tokens (with one
    end symbol each), replaced unknown tokens and distinct replaced words.
    Every sentence has exactly one row with position 0 or NULL (empty), so
    the sentence count needs no distinct aggregate."""
    replaced = (F.col("tid") == unk) & (F.col("symbol") != unk_word)
    first = F.col("pos").isNull() | (F.col("pos") == 0)
    nseq = F.sum(F.when(first, 1).otherwise(0)).cast("long")
    return ex.agg(
        nseq.alias("nseq"),
        (F.count("pos") + nseq).alias("ntok"),
        F.sum(F.when(replaced, 1).otherwise(0)).cast("long").alias("nunk"),
        F.countDistinct(F.when(replaced, F.col("symbol"))).alias("n_replaced_words"))


def replaced_words(ex: DataFrame, unk: int = UNK, unk_word: str = "<unk>") -> DataFrame:
    """G-06 companion: count per replaced word."""
    return (ex.filter((F.col("tid") == unk) & (F.col("symbol") != unk_word))
            .groupBy("symbol").agg(F.count(F.lit(1)).alias("count")))


def decode(df: DataFrame, keys: Sequence[str], vocab: DataFrame, ids: str = "ids",
           bpe: str | None = None, escape_unk: bool = False, eos: int = EOS, unk: int = UNK,
           unk_word: str = "<unk>", stop_at_eos: bool = False,
           max_broadcast: int = MAX_BROADCAST_VOCAB) -> DataFrame:
    """B-04: ids -> text.  End ids are removed (``stop_at_eos``: cut at the
    first end id after position 0); out-of-range ids read as unk; unk may be
    escaped as ``<<unk>>``; sub-word markers optionally removed."""
    from tessera.functions.text import remove_bpe
    a = F.col(ids)
    if stop_at_eos:
        first = F.array_position(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), F.lit(eos))
        a = F.when(first > 0, F.slice(a, 1, first)).otherwise(a)
    a = F.filter(a, lambda x: x != eos)
    ex = df.repartition(*keys).select(*keys, F.posexplode_outer(a).alias("pos", "tid"))
    v = sized_broadcast(vocab.select(F.col("id").alias("tid"), F.col("symbol").alias("_sym")), max_broadcast)
    unk_str = f"<{unk_word}>" if escape_unk else unk_word
    ex = ex.join(v, "tid", "left").select(
        *keys, "pos", F.when(F.col("tid") == unk, F.lit(unk_str))
        .otherwise(F.coalesce("_sym", F.lit(unk_str if escape_unk else unk_word))).alias("tok"))
    out = assemble(ex, keys, "tok", "toks")
    text = F.array_join("toks", " ")
    if bpe is not None:
        text = remove_bpe(text, bpe)
    return out.select(*keys, text.alias("text"))


def vocab_overlap(vocab: DataFrame, other: DataFrame, how: str = "left_semi") -> DataFrame:
    """J-17: symbols of ``vocab`` present (``left_semi``) or missing
    (``left_anti``) in ``other``'s ``symbol`` column."""
    return vocab.join(other.select("symbol").distinct(), "symbol", how)


def cap_vocab(df: DataFrame, ids: str = "ids", max_vocab: int = 0, min_count: int = 0,
              vocab: DataFrame | None = None, unk: int = UNK_ALT) -> DataFrame:
    """G-05: ids at or above the cap become unk.  A minimum count turns into
    an id cap because vocabularies are count-ordered (one scalar aggregate)."""
    cap = max_vocab if max_vocab > 0 else None
    if min_count > 0 and vocab is not None:
        by_count = vocab.filter((F.col("count") >= min_count) | F.col("is_special")).agg(
            (F.max("id") + 1).alias("cap")).first()["cap"]
        cap = by_count if cap is None else min(cap, by_count)
    a = F.col(ids)
    if cap is not None:
        a = F.transform(a, lambda x: F.when(x >= cap, F.lit(unk)).otherwise(x))
    return df.withColumn(ids, a)
