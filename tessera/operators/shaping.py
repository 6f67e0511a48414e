"""Corpus shaping: filters (C-*), ordering (L-*), sets/shards (U-*),
batching windows (W-01, W-02, W-04, W-06..W-13), seeded randomness (X-03).

Global orders never use an unpartitioned window: dense positions come from
the two-phase method in :mod:`tessera.operators.ids`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ids import running_total


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --------------------------------------------------------------- X-03
def hash_uniform(seed, *keys) -> Column:
    """Reproducible U[0,1) from (seed, keys...): first 52 bits of an MD5 of
    the ':'-joined values (all a double can tell apart below 1, so draws reach
    every row of a corpus of any size).  Same bits in any engine with md5;
    never rand()."""
    parts = [F.lit(str(seed))] + [_c(k).cast("string") for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / 4503599627370496.0


def hash_bucket(u: Column, n: int = 4096) -> Column:
    return F.floor(u * n)


# --------------------------------------------------------------- C-*
def filter_by_size(df: DataFrame, sizes: dict[str, int | None], raise_on_drop: bool = False):
    """C-01: keep rows whose every size column is within its limit (None =
    unlimited); returns (kept, dropped).  ``raise_on_drop`` fails the job when
    anything would be dropped (checked with a bounded ``limit(1)``)."""
    cond = F.lit(True)
    for col, lim in sizes.items():
        if lim is not None:
            cond = cond & (F.col(col) <= lim)
    kept, dropped = df.filter(cond), df.filter(~cond)
    if raise_on_drop and dropped.limit(1).count() > 0:
        raise ValueError("rows exceed the size limits")
    return kept, dropped


def resolve_limits(*limits: Column) -> Column:
    """C-02: null-safe component-wise minimum (``least`` skips NULL)."""
    return F.least(*limits)


def check_vocab(vocab: DataFrame, specials: Sequence[str]) -> DataFrame:
    """C-03: violation counts: specials in place, ids a bijection 0..n-1,
    counts non-increasing after the specials.  The predecessor is found by an
    equi-join on id - 1 (distributed), not by a global ``lag``."""
    spec = vocab.sparkSession.createDataFrame([(i, s) for i, s in enumerate(specials)], "id int, symbol string")
    bad_spec = spec.join(vocab.select("id", F.col("symbol").alias("v")), "id", "left").filter(
        F.col("v").isNull() | (F.col("v") != F.col("symbol"))).agg(F.count(F.lit(1)).alias("n"))
    ids = vocab.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("nd"),
                    F.countDistinct("symbol").alias("ns"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    prev = vocab.select((F.col("id") + 1).alias("id"), F.col("count").alias("prev"))
    order = (vocab.filter(F.col("id") > len(specials)).join(prev, "id")
             .filter(F.col("count") > F.col("prev")).agg(F.count(F.lit(1)).alias("n")))
    return (bad_spec.select(F.lit("specials").alias("check"), F.col("n").alias("violations"))
            .unionByName(ids.select(F.lit("bijection").alias("check"),
                                    ((F.col("n") - F.col("nd")) + (F.col("n") - F.col("ns"))
                                     + F.when((F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1), 1).otherwise(0))
                                    .alias("violations")))
            .unionByName(order.select(F.lit("count_order").alias("check"), F.col("n").alias("violations"))))


def drop_empty(df: DataFrame, *arrays: str) -> DataFrame:
    """C-04: every side non-empty."""
    cond = F.lit(True)
    for a in arrays:
        cond = cond & (F.size(a) > 0)
    return df.filter(cond)


def drop_long(df: DataFrame, n: int, *arrays: str) -> DataFrame:
    """C-05: every side at most ``n`` long (0 disables)."""
    if n == 0:
        return df
    cond = F.lit(True)
    for a in arrays:
        cond = cond & (F.size(a) <= n)
    return df.filter(cond)


def select_rows(df: DataFrame, row_id: str, a: int, b: int) -> DataFrame:
    """C-07: half-open row range, ids re-based to 0."""
    return df.filter((F.col(row_id) >= a) & (F.col(row_id) < b)).withColumn(row_id, F.col(row_id) - a)


def select_blocks(df: DataFrame, block: str, a: int, b: int, n_blocks: int) -> DataFrame:
    """C-08: keep blocks [a, b); an invalid range leaves the data unchanged."""
    if not (0 <= a < b <= n_blocks):
        return df
    return df.filter((F.col(block) >= a) & (F.col(block) < b))


def check_tags(df: DataFrame, ntok: str, word_tags: str, gap_tags: str, tags: str, spans: str) -> DataFrame:
    """C-09: per-row violations of gaps = words + 1, tags = 2 words + 1,
    spans = words and spans covering the tokens contiguously (one pass over
    the span array carrying the next expected start)."""
    w = F.size(word_tags)
    walk = F.aggregate(spans, F.struct(F.lit(0).alias("next"), F.lit(True).alias("ok")),
                       lambda acc, sp: F.struct((sp["end"] + 1).alias("next"),
                                                (acc["ok"] & (sp["start"] == acc["next"])).alias("ok")))
    return (df.withColumn("_walk", walk)
            .select("*", (F.size(gap_tags) != w + 1).alias("bad_gaps"), (F.size(tags) != 2 * w + 1).alias("bad_tags"),
                    (F.size(spans) != w).alias("bad_spans"),
                    (~(F.col("_walk.ok") & (F.col("_walk.next") == F.col(ntok)))).alias("bad_cover"))
            .drop("_walk"))


def check_corpus(df: DataFrame, ids: str, vocab_size: int) -> DataFrame:
    """C-10: rows, empty rows and out-of-range ids (one aggregate)."""
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.sum(F.when(F.size(ids) == 0, 1).otherwise(0)).cast("long").alias("empty"),
                  F.sum(F.size(F.filter(ids, lambda x: (x < 0) | (x >= vocab_size)))).cast("long").alias("out_of_range"))


# --------------------------------------------------------------- L-*
def top_k(df: DataFrame, by: Sequence[str], score: str, k: int, tie: str, ascending: bool = False) -> DataFrame:
    """L-02 / L-09: best ``k`` per group, equal scores in the order of the unique
    key ``tie`` (Spark plans a group-limit before the shuffle for
    ``row_number() <= k``)."""
    o = F.col(score).asc() if ascending else F.col(score).desc()
    w = Window.partitionBy(*by).orderBy(o, F.col(tie))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def norm_score(score, length, penalty: float, max_len: int | None = None) -> Column:
    """L-03: score / len**penalty; over-long hypotheses get -inf."""
    s = _c(score) / F.pow(_c(length).cast("double"), F.lit(penalty))
    if max_len is None:
        return s
    return F.when(_c(length) > max_len, F.lit(float("-inf"))).otherwise(s)


# --------------------------------------------------------------- U-*
def shard_contiguous(df: DataFrame, row_id: str, n_rows: int, n_shards: int, shard: int) -> DataFrame:
    """U-05: shard k of g takes rows [k*(n//g), (k+1)*(n//g)); the remainder is dropped."""
    per = n_rows // n_shards
    return df.filter((F.col(row_id) >= shard * per) & (F.col(row_id) < (shard + 1) * per))


def shard_round_robin(df: DataFrame, row_id: str, n_shards: int) -> DataFrame:
    """U-04: row i -> shard i mod n, slot i div n."""
    return df.withColumn("shard", F.pmod(F.col(row_id), F.lit(n_shards))).withColumn(
        "slot", F.floor(F.col(row_id) / n_shards))


# --------------------------------------------------------------- W-*
def token_batches(df: DataFrame, length: str, budget: int, order: Sequence, fine, coarse) -> DataFrame:
    """W-01: batch key = inclusive running length // budget (X-02)."""
    r = running_total(df, order, fine, coarse, value=length, out="_cum")
    return r.withColumn("batch_key", F.floor(F.col("_cum") / budget)).drop("_cum")


def equal_batches(row_id: Column, n_rows: int, batch_size: int) -> Column:
    """W-02: ceil(n / bs) batches, the first n mod k one row larger (same
    split as numpy ``array_split``), closed form on a dense row id."""
    k = -(-n_rows // batch_size)
    q, rem = divmod(n_rows, k)
    big = rem * (q + 1)
    return F.when(row_id < big, F.floor(row_id / (q + 1))).otherwise(
        F.lit(rem) + F.floor((row_id - big) / max(q, 1))).cast("long")


def posterior(df: DataFrame, by: Sequence[str], expert: str, lprob: str, prior: str | None = None) -> DataFrame:
    """W-04: softmax of (lprob + prior) over the experts of each group and the
    hard winner (first maximum)."""
    x = _c(lprob) + (_c(prior) if prior else F.lit(0.0))
    w = Window.partitionBy(*by)
    d = df.withColumn("_x", x).withColumn("_m", F.max("_x").over(w))
    d = d.withColumn("_e", F.exp(F.col("_x") - F.col("_m")))
    d = d.withColumn("posterior", F.col("_e") / F.sum("_e").over(w))
    win = F.min(F.struct((-F.col("_x")).alias("nx"), F.col(expert).alias("e"))).over(w)["e"]
    return d.withColumn("winner", win).drop("_x", "_m", "_e")


def mismatch(cands: DataFrame, given: DataFrame, keys: Sequence[str], tok: str, score: str) -> DataFrame:
    """W-06: per position: score of the given token, best score, best token,
    whether they agree and the gap best - given."""
    best = cands.groupBy(*keys).agg(F.max(score).alias("best"),
                                    F.max_by(tok, F.struct(F.col(score), -F.col(tok))).alias("best_tok"))
    gs = (given.join(cands.withColumnRenamed(score, "given_score"), list(keys) + [tok], "left"))
    return (gs.join(best, list(keys))
            .select(*keys, tok, "given_score", "best", "best_tok",
                    (F.col("best_tok") == F.col(tok)).alias("equal"),
                    (F.col("best") - F.col("given_score")).alias("gap")))


def gap_features(words: DataFrame, key: str, word: str, value: str, n_words: DataFrame) -> DataFrame:
    """W-07: n words -> n+1 gaps; gap i has (word i-1, word i) features, 0 at
    the edges.  Built by two shifted equi-joins, no window."""
    gaps = n_words.select(key, F.explode(F.sequence(F.lit(0), F.col("n"))).alias("gap"))
    left = words.select(key, (F.col(word) + 1).alias("gap"), F.col(value).alias("left"))
    right = words.select(key, F.col(word).alias("gap"), F.col(value).alias("right"))
    return (gaps.join(left, [key, "gap"], "left").join(right, [key, "gap"], "left")
            .select(key, "gap", F.coalesce("left", F.lit(0.0)).alias("left"),
                    F.coalesce("right", F.lit(0.0)).alias("right")))


def blend(a, b, alpha: float) -> Column:
    """W-08: alpha * a + (1 - alpha) * b."""
    return alpha * _c(a) + (1.0 - alpha) * _c(b)


def decumulate(df: DataFrame, by: Sequence[str], pos: str, cum: str, out: str = "step_score") -> DataFrame:
    """W-09: per-position score from a cumulative one (difference with the
    previous position, first keeps its value) via a shifted equi-join."""
    prev = df.select(*by, (F.col(pos) + 1).alias(pos), F.col(cum).alias("_prev"))
    return (df.join(prev, list(by) + [pos], "left")
            .withColumn(out, F.col(cum) - F.coalesce("_prev", F.lit(0.0))).drop("_prev"))


def rescore(df: DataFrame, by: Sequence[str], score: str, temperature: float = 1.0, softmax: bool = False,
            subtract: str | None = None, l1: bool = False) -> DataFrame:
    """W-10: temperature, softmax, subtract min/mean/median (lower median),
    L1 normalisation, in that order, per query group."""
    w = Window.partitionBy(*by)
    d = df.withColumn("_s", F.col(score) / temperature)
    if softmax:
        d = d.withColumn("_s", F.exp(F.col("_s") - F.max("_s").over(w)))
        d = d.withColumn("_s", F.col("_s") / F.sum("_s").over(w))
    if subtract == "min":
        d = d.withColumn("_s", F.col("_s") - F.min("_s").over(w))
    elif subtract == "mean":
        d = d.withColumn("_s", F.col("_s") - F.avg("_s").over(w))
    elif subtract == "median":
        ow = Window.partitionBy(*by).orderBy("_s")
        d = d.withColumn("_r", F.row_number().over(ow)).withColumn("_n", F.count(F.lit(1)).over(w))
        m = F.max(F.when(F.col("_r") == F.floor((F.col("_n") + 1) / 2), F.col("_s"))).over(w)
        d = d.withColumn("_s", F.col("_s") - m).drop("_r", "_n")
    if l1:
        d = d.withColumn("_s", F.try_divide(F.col("_s"), F.sum(F.abs("_s")).over(w)))
    return d.withColumn("rescored", F.col("_s")).drop("_s")


def best_and_patience(df: DataFrame, run: str, step: str, metric: str, maximize: bool = True,
                      strict: bool = True, patience: int = 3, step_width: int = 1 << 16) -> DataFrame:
    """W-11: running best per run, steps since the last improvement
    (``counter``) and the stop flag (counter > patience).  A strict
    improvement needs ``>``; the other form accepts ties (``>=``).

    No per-run window: step numbers, the previous best and the last
    improvement come from two-phase running counts/maxima over
    (run, step div step_width) buckets, so one very long run spreads over
    many tasks.  ``step`` must be an integer order key."""
    from tessera.operators.ids import running_in_group, running_max
    v = F.col(metric) if maximize else -F.col(metric)
    fine = [F.floor(F.col(step) / step_width)]
    d = df.withColumn("_val", v)
    d = running_in_group(d, [run], [F.col(step)], fine, F.lit(1).cast("long"), "_idx", how="sum")
    d = running_max(d, [run], [F.col(step)], fine, "_val", "_prev", inclusive=False)
    imp = F.col("_prev").isNull() | ((F.col("_val") > F.col("_prev")) if strict else (F.col("_val") >= F.col("_prev")))
    d = d.withColumn("_impidx", F.when(imp, F.col("_idx")))
    d = running_max(d, [run], [F.col(step)], fine, "_impidx", "_last", inclusive=True)
    best = F.greatest(F.coalesce(F.col("_prev"), F.col("_val")), F.col("_val"))
    d = d.withColumn("best", best * (1 if maximize else -1))
    d = d.withColumn("counter", (F.col("_idx") - F.col("_last")).cast("int"))
    return d.withColumn("stop", F.col("counter") > patience).drop("_val", "_idx", "_prev", "_impidx", "_last")


def nucleus(df: DataFrame, by: Sequence[str], prob: str, p: float, tie: str) -> DataFrame:
    """W-12: smallest prefix (by prob desc) with mass >= p; at least one row."""
    w = Window.partitionBy(*by).orderBy(F.col(prob).desc(), F.col(tie)).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(prob).over(w), F.lit(0.0))
    return df.withColumn("_before", before).filter(F.col("_before") < p).drop("_before")
