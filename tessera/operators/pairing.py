"""Pairing joins (J-01, J-04, J-06, J-09..J-11, J-13, J-17) and hash-seeded
noise (N-01..N-09).

Randomness is always X-03 (md5 of seed and row keys), so any task retry,
engine or partition count draws the same values.  Partner lookups are
equi-joins on (group, index) pairs, never theta or cross joins; noise on a
sentence is computed inside its row (no shuffle).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType

from tessera.functions.draws import _draw, draw_ranks, dropped_words, shuffled_words, uniforms
from tessera.operators.ids import prefix_sum, running_total, with_row_id
from tessera.operators.shaping import hash_uniform
from tessera.operators.vocab import sized_broadcast
from tessera.session import cut_lineage


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ------------------------------------------------------------------ joins
def zip_by_id(dfs: Sequence[DataFrame], key: str = "id") -> DataFrame:
    """J-01: positional zip of aligned tables = chained inner equi-joins on
    the id.  Use :func:`zip_mismatch` to assert the lengths agree."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.join(d, key)
    return out


def zip_mismatch(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Ids present on one side only (a full outer join with null sides)."""
    return (a.select(key, F.lit(1).alias("_a")).join(b.select(key, F.lit(1).alias("_b")), key, "full")
            .filter(F.col("_a").isNull() | F.col("_b").isNull()).select(key))


def pool_spans(feats: DataFrame, spans: DataFrame, key: str, offset: int = 0) -> DataFrame:
    """J-04: mean of per-position features over each word's inclusive span
    (positions shifted by ``offset``).  ``feats`` has rows (key, pos, value), or
    (key, values) with the features of positions 0, 1, ... side by side.  Arrays meet
    the spans of their key, and a span is summed where it lies; rows are
    equi-joined on (key, pos) with the exploded spans: no range join."""
    if "values" in feats.columns:
        both = spans.select(key, "spans").join(feats.select(key, "values"), key)
        inside = lambda s: F.filter(F.slice("values", F.greatest(s["start"] + offset, F.lit(0)) + 1,      # noqa: E731
                                            F.greatest(s["end"] + offset - F.greatest(s["start"] + offset, F.lit(0)) + 1, F.lit(0))), lambda v: v.isNotNull())
        words = both.select(key, F.posexplode(F.transform("spans", inside)).alias("word", "_v")).filter(F.size("_v") > 0)
        words = words.select(key, "word", F.aggregate("_v", F.lit(0.0), lambda a, v: a + v).alias("_sum"), F.size("_v").alias("_n"))
        return words.groupBy(key, "word").agg((F.sum("_sum") / F.sum("_n")).alias("mean"))
    # the outer form keeps Spark from inferring a size(spans) > 0 filter that
    # would be pushed below the projection and re-evaluate the span builder
    sp = spans.select(key, F.posexplode_outer("spans").alias("word", "s")).filter(F.col("word").isNotNull())
    pos = sp.select(key, "word", F.explode(F.sequence(F.col("s.start"), F.col("s.end"))).alias("pos"))
    pos = pos.withColumn("pos", F.col("pos") + offset)
    return pos.join(feats, [key, "pos"]).groupBy(key, "word").agg(F.avg("value").alias("mean"))


def dense_rank_in_group(df: DataFrame, group: str, order: str, width: int = 1 << 16) -> DataFrame:
    """0-based position inside ``group`` by ``order`` plus the group size, via
    the two-phase method (a hot group is split into many fine buckets)."""
    r = running_total(df, [F.col(group), F.col(order)], fine=[F.col(group), F.floor(F.col(order) / width)],
                      coarse=[F.col(group)], value=None, out="_g", inclusive=False)
    starts = r.groupBy(group).agg(F.min("_g").alias("_s"), F.count(F.lit(1)).alias("n"))
    return r.join(starts, group).withColumn("rank", F.col("_g") - F.col("_s")).drop("_g", "_s")


def round_robin_zip(big: DataFrame, small: DataFrame, big_row: str, small_row: str, n_small: int) -> DataFrame:
    """J-06: row i of the longer table with row i mod n of the shorter one."""
    return big.withColumn("_k", F.pmod(F.col(big_row), F.lit(n_small))).join(
        small.withColumnRenamed(small_row, "_k"), "_k").drop("_k")


def negatives(df: DataFrame, group: str, key: str, seed: int) -> DataFrame:
    """J-10: each row keeps its own partner with probability 1/2 (label 1),
    otherwise it is matched to a different row of its group at shift
    1..n-1 mod n (label 0); groups of one row are skipped."""
    r = dense_rank_in_group(df, group, key).filter(F.col("n") > 1)
    keep = hash_uniform(seed, key, F.lit("keep")) < 0.5
    shift = 1 + F.floor(hash_uniform(seed, key, F.lit("shift")) * (F.col("n") - 1))
    r = r.withColumn("label", F.when(keep, 1).otherwise(0)).withColumn(
        "prank", F.when(keep, F.col("rank")).otherwise(F.pmod(F.col("rank") + shift, F.col("n"))))
    partners = r.select(group, F.col("rank").alias("prank"), F.col(key).alias("partner"))
    return r.join(partners, [group, "prank"]).select(key, group, "partner", "label")


def next_sentence(df: DataFrame, row: str, n: int, seed: int) -> DataFrame:
    """J-11: with p = 1/2 the next row, else a uniform row outside {i, i+1};
    the last row always gets a random one."""
    u = hash_uniform(seed, row, F.lit("next"))
    r2 = F.floor(hash_uniform(seed, row, F.lit("rand")) * (n - 2))
    rnd = F.when(r2 >= F.col(row), r2 + 2).otherwise(r2)
    is_next = (u < 0.5) & (F.col(row) < n - 1)
    d = df.withColumn("is_next", is_next).withColumn("prow", F.when(is_next, F.col(row) + 1).otherwise(rnd))
    partners = df.select(F.col(row).alias("prow"), *[F.col(c).alias("p_" + c) for c in df.columns if c != row])
    return d.join(partners, "prow")


def contrastive_negatives(df: DataFrame, key: str, length: str, n_neg: int, seed: int) -> DataFrame:
    """J-13: ``n_neg`` negatives per position, drawn uniformly from all
    positions of the same sequence, the own one included (a sequence of one
    position draws itself)."""
    draws = uniforms(seed, key, F.sequence(F.lit(0), F.col(length) - 1), [f":{j}" for j in range(1, n_neg + 1)])
    each = df.filter(F.col(length) > 0).select(key, length, F.posexplode(draws).alias("_i", "_u"))
    return each.select(key, F.floor(F.col("_i") / n_neg).cast("int").alias("pos"), (F.col("_i") % n_neg + 1).alias("j"),
                       F.floor(F.col("_u") * F.col(length)).alias("neg"))


ROWS_OUT = 1 << 16      # negatives in an Arrow batch


def _whole_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by their first column, some batches of it at a time, none of them cut."""
    held: list[pa.RecordBatch] = []
    for rb in batches:
        if not rb.num_rows:
            continue
        b = rb.column(0)
        cut = int(np.searchsorted(pc.fill_null(pc.equal(b, b[-1]), True).to_numpy(zero_copy_only=False), True))
        if cut or (held and held[-1].column(0)[-1] != b[0]):
            held += [rb.slice(0, cut)] if cut else []
            yield pa.Table.from_batches(held)
            held = []
        held.append(rb.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _across(seed: str, n_neg: int, schema: StructType):
    """Rows ``(batch, key, its text, length)``, sorted, to their negatives."""
    tags = [f":{j}" for j in range(1, n_neg + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(schema)
        for t in _whole_batches(batches):
            t = t.combine_chunks()
            b, k, name = (t.column(i).combine_chunks() for i in range(3))
            n = t.column(3).to_numpy().astype(np.int64)
            new_batch = np.r_[True, _differs(b)]
            new_key = new_batch | np.r_[True, _differs(k)]
            first = np.flatnonzero(new_batch)
            group = np.cumsum(new_batch) - 1
            begin, upto = (np.cumsum(n) - n)[first], np.cumsum(n)              # of a batch; with the row
            total = np.add.reduceat(n, first)
            last = np.r_[np.flatnonzero(new_key)[1:] - 1, len(n) - 1]          # row of each key
            at = upto[last[np.cumsum(new_key) - 1]] - n                        # number of a row's first position, batches side by side
            heads = [(seed if x is None else f"{seed}:{x}").encode() + b":" for x in name.to_pylist()]
            alone = bool(new_key.all())
            if not alone:                       # positions of rows of one key lie over each other
                where = np.repeat(at - (upto - n), n) + np.arange(upto[-1])
                order = np.argsort(where, kind="stable")
                where, holder = where[order], np.repeat(np.arange(len(n)), n)[order]
            step = max(1, ROWS_OUT // n_neg)
            for lo, hi in _slices(n, step):
                size = n[lo:hi]
                u = _draw(heads[lo:hi], size, tags) / 4503599627370496.0
                row = np.repeat(np.arange(lo, hi), size * n_neg)
                d = np.arange(len(row)) - np.repeat((np.cumsum(size) - size) * n_neg, size * n_neg)
                i = begin[group[row]] + np.floor(u * total[group[row]]).astype(np.int64)
                if alone:
                    hit = np.searchsorted(at, i, "right") - 1
                else:
                    left, right = np.searchsorted(where, i, "left"), np.searchsorted(where, i, "right")
                    many = right - left
                    found = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(left, many)
                    row, d, i, hit = np.repeat(row, many), np.repeat(d, many), np.repeat(i, many), holder[found]
                columns = [k.take(pa.array(row)), pa.array(d // n_neg), pa.array(d % n_neg + 1), k.take(pa.array(hit)), pa.array(i - at[hit])]
                for x in range(0, len(row), ROWS_OUT):
                    part = [c.slice(x, ROWS_OUT).cast(f.type) for c, f in zip(columns, kinds)]
                    yield pa.RecordBatch.from_arrays(part, schema=kinds)
    return run


def _differs(x: pa.Array) -> np.ndarray:
    """For each element but the first whether it differs from the one before; nulls are alike."""
    code = x.dictionary_encode().indices
    code = pc.fill_null(code, -1).to_numpy(zero_copy_only=False)
    return code[1:] != code[:-1]


def _slices(n: np.ndarray, step: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with ``step`` positions or so in all."""
    upto, lo = np.cumsum(n), 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + step, "right")))
        yield lo, hi
        lo = hi


def contrastive_negatives_across(df: DataFrame, batch: str, key: str, length: str, n_neg: int, seed: int) -> DataFrame:
    """J-13, across rows: ``n_neg`` negatives ``(neg_key, neg_pos)`` per position,
    drawn uniformly from all positions of all rows of the batch, the own one
    included.  Only the rows' lengths are shuffled: a task has the rows of a batch
    together, in order, and finds a drawn number among their running lengths.  Rows
    of one key share the running length behind them all (a range frame)."""
    kind = df.schema[key].dataType
    schema = StructType([StructField(key, kind), StructField("pos", IntegerType()), StructField("j", IntegerType()),
                         StructField("neg_key", kind), StructField("neg_pos", df.schema[length].dataType)])
    d = df.filter((F.col(length) > 0) & F.col(batch).isNotNull())
    d = d.select(F.col(batch).alias("_b"), F.col(key).alias("_k"), F.col(key).cast("string").alias("_name"), F.col(length).alias("_n"))
    return d.repartition("_b").sortWithinPartitions("_b", "_k").mapInArrow(_across(str(seed), n_neg, schema), schema)


def attach_vectors(vocab: DataFrame, vectors: DataFrame, symbol: str = "symbol", word: str = "word") -> DataFrame:
    """J-03: the vocabulary with the vector of each symbol that the word-vector
    table holds (null elsewhere); ``vectors`` has one row per word (A-11)."""
    return vocab.join(vectors.withColumnRenamed(word, symbol), symbol, "left")


def vector_overlap(vocab: DataFrame, vectors: DataFrame, symbol: str = "symbol", word: str = "word") -> DataFrame:
    """J-03: one row ``(found, types)``: how many vocabulary types have a vector."""
    has = vectors.select(F.col(word).alias(symbol), F.lit(1).alias("_has")).distinct()
    return vocab.select(symbol).join(has, symbol, "left").agg(F.count("_has").alias("found"), F.count(F.lit(1)).alias("types"))


# ------------------------------------------------------------------ noise
def _pinned(expr: Column, arrays=(), scalars=()) -> Column:
    """Guard ``expr`` with a second reference to the staged columns it reads
    inside lambdas.  The optimiser inlines a column referenced only once,
    which inside a lambda would recompute the whole array per element; with
    two references it keeps the column computed once per row."""
    cond = None
    for a in arrays:
        c = F.size(a) >= -1
        cond = c if cond is None else cond & c
    for x in scalars:
        c = F.col(x) > F.lit(-1e308)
        cond = c if cond is None else cond & c
    return F.when(cond, expr)


def word_dropout(df: DataFrame, key: str, tokens: str, p: float, seed, blank: str | None = None,
                 eos: str | None = None) -> DataFrame:
    """N-01 / N-02: drop (or blank) whole words with probability ``p``; a
    final ``eos`` always stays.  If one token or none is left, a random token of
    the sentence is put in front."""
    return df.withColumn("noised", dropped_words(seed, key, tokens, p, blank, eos))


def word_shuffle(df: DataFrame, key: str, tokens: str, k: float, seed, eos: str | None = None) -> DataFrame:
    """N-03: local shuffle: word w gets score w + U(0, k) (first word -1),
    tokens sorted by score (+1e-6 * position keeps sub-words in order); a
    final ``eos`` keeps its place."""
    if k == 0:
        return df.withColumn("noised", F.col(tokens))
    if k <= 1:
        raise ValueError("shuffle distance must be > 1")
    return df.withColumn("noised", shuffled_words(seed, key, tokens, k, eos))


def add_noise(df: DataFrame, key: str, tokens: str, k: float, p_drop: float, p_blank: float, seeds: Sequence,
              blank: str = "<unk>", eos: str | None = "</s>") -> DataFrame:
    """N-04: shuffle, then drop, then blank, each on the words of what the step
    before left; ``seeds`` are the three steps' seeds."""
    d = word_shuffle(df, key, tokens, k, seeds[0], eos).withColumnRenamed("noised", "_n1")
    d = (word_dropout(d, key, "_n1", p_drop, seeds[1], None, eos) if p_drop else d.withColumn("noised", F.col("_n1")))
    d = d.withColumnRenamed("noised", "_n2")
    d = (word_dropout(d, key, "_n2", p_blank, seeds[2], blank, eos) if p_blank else d.withColumn("noised", F.col("_n2")))
    return d.drop("_n1", "_n2")


def mask_tokens(df: DataFrame, key: str, ids: str, p: float, seed, mask_id: int, pad: int,
                p_keep: float = 0.1, p_rand: float = 0.1, vocab_lo: int = 4, vocab_hi: int = 12,
                ceil_count: bool = False, begins=None, replace=None) -> DataFrame:
    """N-05 / N-06: choose int(p*n + u) (or ceil(p*n)) units without
    replacement by their draw order; of those keep the tokens (p_keep), use
    random vocabulary ids (p_rand) or the mask id.  A unit is a token or, with
    ``begins(id)`` (a Column function), a whole word: a token where it holds, or
    the first one, and what follows; one decision then holds for all its
    tokens.  ``replace(u)`` maps a uniform draw to a random id (for replacement by
    frequency); the default is uniform over ``[vocab_lo, vocab_hi)``.  Returns the
    masked input and the target (original id at chosen places, pad elsewhere)."""
    random_id = replace or (lambda u: (vocab_lo + F.floor(u * (vocab_hi - vocab_lo))).cast("int"))
    first = F.transform(F.col(ids), lambda x, i: F.when((i == 0) | (F.lit(True) if begins is None else begins(x)), i))
    d = df.withColumn("_at", F.filter(first, lambda i: i.isNotNull()))
    n = F.size("_at")
    cnt = F.ceil(n * p) if ceil_count else F.floor(n * p + hash_uniform(seed, key, F.lit("n")))
    d = d.withColumn("_cnt", cnt).withColumn("_rank", draw_ranks(seed, key, "_at"))
    # the second draw of a chosen unit, null for the others
    d = d.withColumn("_how", _pinned(F.transform("_rank", lambda r, w: F.when(
        r < F.col("_cnt"), hash_uniform(seed, key, w, F.lit("how")))), scalars=["_cnt"]))
    if begins is None:
        each = F.arrays_zip(F.col(ids).alias("t"), F.col("_how").alias("how"))
    else:
        end = F.slice(F.concat(F.slice("_at", 2, n), F.array(F.size(ids))), 1, n)
        each = F.flatten(F.transform(F.arrays_zip(F.col("_at").alias("a"), end.alias("b"), F.col("_how").alias("how")), lambda x: F.transform(
            F.slice(ids, x["a"] + 1, x["b"] - x["a"]), lambda t: F.struct(t.alias("t"), x["how"].alias("how")))))
    d = d.withColumn("_each", each)

    def masked(x, i):
        return F.when(x["how"].isNull() | (x["how"] < p_keep), x["t"]).when(
            x["how"] < p_keep + p_rand, random_id(hash_uniform(seed, key, i, F.lit("rand")))).otherwise(F.lit(mask_id))

    return (d.withColumn("masked", _pinned(F.transform("_each", masked), arrays=["_each"]))
            .withColumn("target", _pinned(F.transform("_each", lambda x: F.when(x["how"].isNotNull(), x["t"]).otherwise(F.lit(pad))), arrays=["_each"]))
            .drop("_at", "_cnt", "_rank", "_how", "_each"))


def mask_weighted(df: DataFrame, key: str, ids: str, weight_of, p: float, seed, mask_id: int,
                  never: Sequence[int] = ()) -> DataFrame:
    """N-07: weighted sampling without replacement of max(1, round(p*n))
    positions (never the first or last, an id in ``never`` such as end and pad,
    or one of weight 0): the positions with the largest u**(1/w), compared as
    ln(u)/w (Efraimidis-Spirakis), ``weight_of(id)`` a Column function."""
    n = F.size(ids)
    cnt = F.greatest(F.lit(1), F.round(n * p)).cast("int")
    d = df.withColumn("_u", uniforms(seed, key, ids))
    keyed = F.transform(F.arrays_zip(F.col(ids).alias("t"), F.col("_u").alias("u")), lambda x, i: F.struct(
        (-F.log(F.greatest(x["u"], F.lit(1e-300))) / F.nullif(weight_of(x["t"]), F.lit(0.0))).alias("k"), i.alias("i"),
        ((i == 0) | (i == n - 1) | (x["t"].isin(*never) if never else F.lit(False))).alias("edge")))
    d = d.withColumn("_cand", F.filter(F.sort_array(keyed), lambda s: ~s["edge"] & s["k"].isNotNull()))
    d = d.withColumn("_take", F.array_sort(F.transform(F.slice("_cand", 1, cnt), lambda s: s["i"])))
    # the chosen places in order cut the row into what lies between them
    start = F.concat(F.array(F.lit(0)), F.transform("_take", lambda i: i + 1))
    stop = F.concat("_take", F.array(n))
    d = d.withColumn("_gaps", F.transform(F.arrays_zip(start.alias("a"), stop.alias("b")), lambda x, j: F.concat(
        F.when(j > 0, F.array(F.lit(mask_id))).otherwise(F.slice(ids, 1, 0)), F.slice(ids, x["a"] + 1, x["b"] - x["a"]))))
    return d.withColumn("masked", F.flatten("_gaps")).drop("_u", "_take", "_cand", "_gaps")


CELLS = 1_000_000      # of an alias table (four short columns) that are broadcast


def alias_table(table: DataFrame, item: str, weight: str) -> tuple[DataFrame, int, float]:
    """N-08 / N-09: Walker's alias table of positive weights, as ``(cells, number of
    cells, capacity)``; a cell ``(cell, item, own, alias)`` belongs to one item, the
    part ``own`` of its capacity stands for it, the rest for ``alias``.

    Weights are multiplied by their number, so that the capacity is their sum.
    Light items (below it) lack something, the others have an excess; both are laid
    out by item as intervals on one line.  A light item is filled up by the heavy
    one in whose interval its own begins.  A heavy item that so gives more than it
    has is filled up by the next heavy one, in turn.  Both neighbours are found by
    counting along the merged order of the interval borders (X-02), so the match
    is two prefix sums and two equi-joins on ranks, with no scan by one task.
    Integer weights are matched in exact arithmetic.  Null and non-positive
    weights have no cell."""
    exact = table.schema[weight].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    kind = "decimal(38,0)" if exact else "double"
    t = table.select(F.col(item).alias("item"), F.col(weight).cast(kind).alias("w")).filter(F.col("w") > 0)
    t = cut_lineage(with_row_id(t, ["item"], out="cell"))
    got = t.agg(F.count(F.lit(1)).alias("m"), F.sum("w").alias("total")).first()
    m, total = got.m, got.total
    if not m:
        return t.select("cell", "item", F.lit(0.0).alias("own"), F.col("item").alias("alias")), 0, 0.0
    part = (F.col("w") * F.lit(m)).cast(kind)
    sides = []
    for light in (True, False):
        gap = (F.lit(total).cast(kind) - part if light else part - F.lit(total).cast(kind)).cast(kind)
        d = t.filter(part < F.lit(total).cast(kind) if light else part >= F.lit(total).cast(kind)).withColumn("gap", gap)
        d = with_row_id(prefix_sum(d, "gap", ["item"], out="hi"), ["item"], out="rank")
        sides.append(cut_lineage(d.withColumn("hi", F.col("hi").cast(kind)).withColumn("lo", (F.col("hi") - F.col("gap")).cast(kind))))
    light, heavy = sides

    def counted(asked: DataFrame, at: str, other: DataFrame, first: bool) -> DataFrame:
        """``(item, n)``: how many ``lo`` borders of ``other`` lie before ``at``, those
        at the same place too if ``first``."""
        a = asked.select("item", F.col(at).alias("at"), F.lit(0).alias("one"), F.lit(1 if first else 0).alias("turn"))
        b = other.select("item", F.col("lo").alias("at"), F.lit(1).alias("one"), F.lit(0 if first else 1).alias("turn"))
        return prefix_sum(a.unionByName(b), F.col("one").cast("long"), ["at", "turn", "item"], out="n").filter(F.col("one") == 0).select("item", "n")

    giver = heavy.select((F.col("rank") + 1).alias("n"), F.col("item").alias("alias"))
    light = light.join(counted(light, "lo", heavy, True), "item").join(giver, "n", "left")
    light = light.select("cell", "item", part.cast("double").alias("own"), F.coalesce("alias", "item").alias("alias"))
    reach = sides[0].select((F.col("rank") + 1).alias("n"), F.col("hi").alias("reach"))
    after = heavy.select((F.col("rank") - 1).alias("rank"), F.col("item").alias("alias"))
    over = F.greatest(F.coalesce(F.col("reach") - F.col("hi"), F.lit(0).cast(kind)), F.lit(0).cast(kind))
    heavy = heavy.join(counted(heavy, "hi", sides[0], False), "item").join(reach, "n", "left").join(after, "rank", "left")
    heavy = heavy.select("cell", "item", (F.lit(total).cast(kind) - over).cast("double").alias("own"), F.coalesce("alias", "item").alias("alias"))
    return cut_lineage(light.unionByName(heavy)), m, float(total)


def draw_by_weight(draws: DataFrame, u: str, table: DataFrame, item: str, weight: str) -> DataFrame:
    """N-08 / N-09: a draw of ``item`` with probability proportional to
    ``weight`` for each ``u`` in [0, 1): the cell ``floor(u * m)`` by an equi-join,
    and one comparison with what is left.  Cells are hit alike whatever the
    weights, so no key is hot.  Without positive weights nothing is drawn."""
    cells, m, total = alias_table(table, item, weight)
    x = F.col(u) * F.lit(float(m))
    d = draws.withColumn("_cell", F.floor(x).cast("long")).withColumn("_rest", (x - F.floor(x)) * F.lit(total))
    c = sized_broadcast(cells.select(F.col("cell").alias("_cell"), F.col("item").alias("_item"), "own", "alias"), CELLS)
    return d.join(c, "_cell").withColumn(item, F.when(F.col("_rest") < F.col("own"), F.col("_item")).otherwise(F.col("alias"))).drop("_cell", "_rest", "_item", "own", "alias")
