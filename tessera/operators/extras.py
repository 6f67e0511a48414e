"""Remaining inventory operators: expert fan-out (B-38), label index (G-29),
batch statistics (G-34), weighted objectives (G-36), corpus-sampled zip
(J-07), context windows (W-13), QE/mono collation (E-03, E-05), span
cropping (E-07) and the extension hooks (H-01, H-03..H-05)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.operators.ids import LOCAL_BITS, with_row_id
from tessera.operators.shaping import hash_uniform
from tessera.operators.vocab import sized_broadcast
from tessera.session import cut_lineage


def fan_out(df: DataFrame, ids: str, k: int, first_id: int) -> DataFrame:
    """B-38: k copies of every request; copy i starts with id first_id + i
    in place of its first id."""
    d = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("expert"))
    return d.withColumn(ids, F.concat(F.array((F.lit(first_id) + F.col("expert")).cast("int")),
                                      F.slice(ids, 2, F.greatest(F.size(ids) - 1, F.lit(0)))))


def label_index(df: DataFrame, label: str, skip_empty: bool = False) -> DataFrame:
    """G-29: ids of the distinct labels in sorted order; ``skip_empty`` gives
    the empty label none."""
    distinct = df.select(label).distinct()
    if skip_empty:
        distinct = distinct.filter(F.col(label) != "")
    return with_row_id(distinct, [F.col(label)], out="label_id")


def label_ids(df: DataFrame, index: DataFrame, label: str, unknown: int = 0, max_rows: int = 1_000_000) -> DataFrame:
    """G-29: ``df`` with ``label_id``; a label without one (empty, null or not in
    the index) is ``unknown``."""
    i = sized_broadcast(index.select(F.col(label).alias("_l"), F.col("label_id").cast("long").alias("label_id")), max_rows)
    return df.join(i, F.col(label) == F.col("_l"), "left").drop("_l").withColumn("label_id", F.coalesce("label_id", F.lit(unknown).cast("long")))


def batch_stats(df: DataFrame, batch: str, src_len: str, tgt_len: str | None) -> DataFrame:
    """G-34: sentences, tokens (target tokens, else source) per batch."""
    ntok = F.col(tgt_len) if tgt_len else F.col(src_len)
    return df.groupBy(batch).agg(F.count(F.lit(1)).alias("nsentences"), F.sum(ntok).cast("long").alias("ntokens"),
                                 F.sum(ntok).cast("long").alias("sample_size"))


def combine_losses(df: DataFrame, by: Sequence[str], objective: str, loss: str, size: str,
                   weights: dict[str, float]) -> DataFrame:
    """G-36: sum over objectives of weight * loss; zero-weight objectives are
    skipped; sample sizes add up."""
    live = {k: v for k, v in weights.items() if v != 0}
    w = F.create_map(*[x for k, v in live.items() for x in (F.lit(k), F.lit(float(v)))])
    d = df.filter(F.col(objective).isin(list(live))).withColumn("_w", w[F.col(objective)])
    return d.groupBy(*by).agg(F.sum(F.col("_w") * F.col(loss)).alias("loss"), F.sum(size).alias("sample_size"))


def sampled_zip(corpora: Sequence[DataFrame], ns: Sequence[int], batch_size: int, seed) -> DataFrame:
    """J-07: a virtual dataset of sum(n) rows cut into batches; each batch
    takes all its rows from one corpus chosen uniformly by the batch's draw;
    position j reads row j mod n of that corpus (equi-join on (corpus, row))."""
    spark = corpora[0].sparkSession
    total = sum(ns)
    pos = spark.range(total).select(F.col("id").alias("j"))  # the virtual index space
    pos = pos.withColumn("batch", F.floor(F.col("j") / batch_size))
    pos = pos.withColumn("corpus", F.floor(hash_uniform(seed, "batch") * len(corpora)).cast("int"))
    nmap = F.create_map(*[x for i, n in enumerate(ns) for x in (F.lit(i), F.lit(n))])
    pos = pos.withColumn("row", F.pmod(F.col("j"), nmap[F.col("corpus")]))
    parts = None
    for i, c in enumerate(corpora):
        t = c.select(F.lit(i).alias("corpus"), F.col("row"), F.col("id"))
        parts = t if parts is None else parts.unionByName(t)
    return pos.join(parts, ["corpus", "row"])


def _contexts(context: int):
    """Append ``_loc``, the tokens in the partition before each row, ``_ctx``, the
    last ``context`` of them, and on the last row of a batch ``_n``, the tokens of the
    batch, and ``_tail``, the last ``context`` tokens of the partition so far."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, carry = 0, None
        for batch in batches:
            rows, lists = batch.num_rows, batch.column(1)
            if not rows:
                continue
            size = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            flat = flat if carry is None else pa.concat_arrays([carry, flat])
            held = 0 if carry is None else len(carry)
            start = held + np.cumsum(size) - size
            n = np.minimum(start, context)
            ends = np.cumsum(n)
            at = np.arange(ends[-1]) + np.repeat(start - ends, n)
            ctx = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), flat.take(pa.array(at)))
            carry = flat.slice(max(0, len(flat) - context))
            carry = carry.take(pa.array(np.arange(len(carry))))              # not a view of the batch
            tail = pa.concat_arrays([pa.nulls(rows - 1, ctx.type), pa.ListArray.from_arrays(pa.array([0, len(carry)], pa.int32()), carry)])
            loc = total + start - held
            total += int(size.sum())
            n = pa.array([None] * (rows - 1) + [int(size.sum())], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(loc), ctx, n, tail], names=[*batch.schema.names, "_loc", "_ctx", "_n", "_tail"])
    return run


def with_context(df: DataFrame, key: str, tokens: str, context: int, order, fine, coarse) -> DataFrame:
    """W-13: prepend the ``context`` tokens that precede each sentence in
    corpus order.  Rows are range-partitioned and sorted once; each takes what
    precedes it in its partition, and the first ones of a partition what the
    partitions before it end with (``context`` tokens each, broadcast).  Rows of a
    repeated key share their contexts, in the order of the stream; a null key has none."""
    names = [f"_o{i}" for i in range(len(order))]
    d = df.select(F.col(key).alias("_k"), F.col(tokens).alias("_t"), *[(F.col(c) if isinstance(c, str) else c).alias(n) for c, n in zip(order, names)])
    d = d.repartitionByRange(*names).sortWithinPartitions(*names).select("_k", "_t", F.monotonically_increasing_id().alias("_mid"))
    kind = d.schema["_t"].dataType
    schema = StructType([*d.schema.fields]).add("_loc", "long").add("_ctx", kind).add("_n", "long").add("_tail", kind)
    rows = cut_lineage(d.mapInArrow(_contexts(context), schema))
    rows = rows.withColumn("_part", F.shiftright("_mid", LOCAL_BITS))
    parts = rows.filter(F.col("_tail").isNotNull()).groupBy("_part").agg(F.sum("_n").alias("_n"), F.max_by("_tail", "_mid").alias("_tail"))
    last = Window.orderBy("_part").rowsBetween(1 - context, 0)                    # one row per partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    full = parts.filter("_n > 0").withColumn("_after", F.flatten(F.collect_list("_tail").over(last))).select("_part", "_after")
    parts = parts.join(full, "_part", "left").select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
                                                     F.last("_after", ignorenulls=True).over(before).alias("_before"))
    got = F.concat(F.coalesce("_before", F.array().cast(kind)), "_ctx")
    got = F.when(F.size("_ctx") < context, F.slice(got, F.greatest(F.lit(1), F.size(got) - context + 1), F.lit(context))).otherwise(F.col("_ctx"))
    out = rows.join(F.broadcast(parts), "_part").select("_k", (F.col("_off") + F.col("_loc")).alias("start"), got.alias("context"), "_t")
    out = out.withColumn("context", F.when(F.col("_k").isNull(), F.array().cast(kind)).otherwise(F.col("context")))
    twice = cut_lineage(rows.groupBy("_k").agg(F.count(F.lit(1)).alias("_m")).filter("_m > 1 and _k is not null").select("_k"))
    if not twice.isEmpty():
        each = out.join(twice, "_k").select("_k", (F.col("start") - F.size("context")).alias("_s"), F.posexplode("context").alias("pos", "tok"))
        shared = each.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct((F.col("_s") + F.col("pos")).alias("off"), "tok"))).alias("_c"))
        out = out.join(shared, "_k", "left").withColumn("context", F.coalesce(F.transform("_c", lambda x: x["tok"]), "context"))
    return out.select(F.col("_k").alias(key), "start", "context", F.col("_t").alias(tokens))


def with_kept_context(df: DataFrame, key: str, tokens: str, context: int, tokens_per_sample: int, order, pad: str = "<pad>") -> DataFrame:
    """W-13, as model input: ``(key, source, start_index, length)``.  A row keeps as many
    of the ``context`` tokens before it as fit beside its own into
    ``tokens_per_sample + context``; ``start_index`` is their number, ``length`` what
    is scored with them, and pads fill the places of context that is not there.
    What a trimmed row keeps does not shorten the context of the next one, as its
    own tokens and the kept ones together are ``context`` or more."""
    d = with_context(df, key, tokens, context, order, (), ())
    room = F.greatest(F.lit(0), tokens_per_sample + context - F.size(tokens))
    d = d.withColumn("start_index", F.least(F.size("context"), room))
    kept = F.slice("context", F.size("context") - F.col("start_index") + 1, F.col("start_index"))
    source = F.concat(kept, F.col(tokens), F.array_repeat(F.lit(pad), F.lit(context) - F.col("start_index")))
    return d.select(key, source.alias("source"), "start_index", (F.col("start_index") + F.size(tokens)).alias("length"))


def pad_tags(df: DataFrame, batch: str, tags: str, fill: int = -1) -> DataFrame:
    """E-03: tag arrays padded with -1 to the longest in the batch."""
    w = Window.partitionBy(batch)
    d = df.withColumn("_m", F.max(F.size(tags)).over(w))
    return d.withColumn("tags_padded", F.concat(tags, F.array_repeat(F.lit(fill), F.col("_m") - F.size(tags)))).drop("_m")


def collate_word_qe(df: DataFrame, batch: str, key: str, src: str, tgt: str, word_tags: str, gap_tags: str, src_tags: str,
                    spans: str, src_spans: str, eos: int, pad: int, tag_pad: int = -1,
                    src_lang: int = 14, tgt_lang: int = 4) -> DataFrame:
    """E-03: word-level QE batches.  Per row, in the batch's order of descending
    source length (ties by key): the pair sequence (B-18) padded with ``pad``;
    the target mask (zeros for source length + 3 places, ones for the longest
    target of the batch, cut to the padded length); language ids (source id on
    the first source length + 2 places, target id after); word, gap and source
    tags padded with ``tag_pad`` to the longest span list of the batch (plus one
    for gaps); the span lists as they are; the target padded and, shifted by its
    end symbol moved to the front, as decoder input; and the lengths."""
    from tessera.functions.arrays import pair_sequence
    seq, _ = pair_sequence(None, None, src, tgt, eos)
    w = Window.partitionBy(batch)
    n, m = F.size(src), F.size(tgt)
    d = df.withColumn("_seq", seq)
    most = F.max(m).over(w)
    width = F.greatest(F.max(F.size("_seq")).over(w), F.max(n).over(w) + 3 + most)
    d = (d.withColumn("_w", width).withColumn("_tm", most)
         .withColumn("_b", F.max(F.size(spans)).over(w)).withColumn("_sb", F.max(F.size(src_spans)).over(w)))

    def to(c, value: int, size) -> Column:
        return F.concat(c, F.array_repeat(F.lit(value), F.greatest(size - F.size(c), F.lit(0))))

    order = F.row_number().over(w.orderBy(n.desc(), F.col(key))) - 1
    mask = F.concat(F.array_repeat(F.lit(0), n + 3), F.array_repeat(F.lit(1), F.col("_tm")))
    return d.select(
        batch, key, order.alias("place"), to(F.col("_seq"), pad, F.col("_w")).alias("net_input"),
        to(F.slice(mask, 1, F.col("_w")), 0, F.col("_w")).alias("xml_mask"),
        to(F.array_repeat(F.lit(src_lang), n + 2), tgt_lang, F.col("_w")).alias("langs"),
        to(F.col(tgt), pad, F.col("_tm")).alias("target"),
        to(F.concat(F.slice(tgt, -1, 1), F.slice(tgt, 1, F.greatest(m - 1, F.lit(0)))), pad, F.col("_tm")).alias("prev_output"),
        to(F.col(word_tags), tag_pad, F.col("_b")).alias("word_tags"), to(F.col(gap_tags), tag_pad, F.col("_b") + 1).alias("gap_tags"),
        to(F.col(src_tags), tag_pad, F.col("_sb")).alias("src_tags"), F.col(spans).alias("spans"), F.col(src_spans).alias("src_spans"),
        n.alias("src_length"), m.alias("tgt_length"))


def crop_to_batch(df: DataFrame, batch: str, key: str, vals: str, seed) -> DataFrame:
    """E-07: crop every row of a batch to the batch's shortest length at a
    reproducible random start."""
    w = Window.partitionBy(batch)
    d = df.withColumn("_t", F.min(F.size(vals)).over(w))
    start = F.floor(hash_uniform(seed, key) * (F.size(vals) - F.col("_t") + 1)) + 1
    return d.withColumn("cropped", F.slice(vals, start.cast("int"), F.col("_t"))).drop("_t")


# ------------------------------------------------------------------ hooks
def apply_word_tokenizer(df: DataFrame, tokens: str, fn: Callable[[pd.Series], pd.Series],
                         out: str = "pieces") -> DataFrame:
    """H-01: a per-word tokenizer / sub-word encoder runs once per *distinct*
    word of an Arrow batch, where its pieces are put in order.  No word leaves its
    row; rows alike in all other columns become one, as their pieces by position.
    Rows meet before their words become pieces, which are not shuffled."""
    keys = [c for c in df.columns if c != tokens]
    schema = StructType([df.schema[c] for c in keys]).add("_l", StructType.fromDDL("l array<array<struct<_pos:int,p:array<string>>>>")["l"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(len(keys))
            lists = rows.flatten()
            words = lists.flatten().dictionary_encode()
            pieces = pa.array(fn(pd.Series(words.dictionary.to_pylist(), dtype=object)).tolist(), pa.list_(pa.string()))
            n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(n)
            pos = pa.array((np.arange(len(words)) - np.repeat(ends - n, n)).astype(np.int32))
            placed = pa.StructArray.from_arrays([pos, pieces.take(words.indices)], ["_pos", "p"])
            each = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), placed)
            of = np.r_[0, np.cumsum(rows.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keys)], pa.ListArray.from_arrays(pa.array(of), each)], names=[*keys, "_l"])

    # a null array counts as an empty one
    g = df.groupBy(*keys).agg(F.collect_list(F.coalesce(tokens, F.array().cast("array<string>"))).alias("_t"))
    done = g.mapInArrow(run, schema)
    one = F.when(F.size("_l") == 1, F.get("_l", F.lit(0))).otherwise(F.array_sort(F.flatten("_l")))
    return done.select(*keys, F.flatten(F.transform(one, lambda x: x["p"])).alias(out))


def score_with(df: DataFrame, provider: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """H-03: plug a model-score provider: pandas batches in, the score table
    of the declared schema out (Arrow batched, partition-parallel)."""
    def run(batches):
        for pdf in batches:
            yield provider(pdf)
    return df.mapInPandas(run, schema)


def apply_grouped(df: DataFrame, key: Sequence[str], fn: Callable[[pd.DataFrame], pd.DataFrame],
                  schema: str) -> DataFrame:
    """H-04: custom per-group operator (only for groups of bounded size)."""
    return df.groupBy(*key).applyInPandas(fn, schema)


def sample_by(df: DataFrame, expr) -> DataFrame:
    """H-05: custom sampler as a column predicate (e.g. on the batch id)."""
    return df.filter(expr)


def collate_qe(df: DataFrame, batch: str, src: str, tgt: str, score: str, eos: int, pad: int,
               src_lang: int = 14, tgt_lang: int = 4) -> DataFrame:
    """E-02: sentence-level QE batch rows: the pair sequence (B-18), its
    target mask and language ids, all right-padded to the batch's longest
    sequence; the score travels with the row."""
    from tessera.functions.arrays import language_ids, pair_sequence
    seq, mask = pair_sequence(None, None, src, tgt, eos)
    d = df.withColumn("_seq", seq).withColumn("_mask", mask).withColumn("_lang", language_ids(src, tgt, src_lang, tgt_lang))
    w = Window.partitionBy(batch)
    d = d.withColumn("_m", F.max(F.size("_seq")).over(w))
    fill = lambda c, v: F.concat(F.col(c), F.array_repeat(F.lit(v), F.col("_m") - F.size(c)))
    return (d.withColumn("net_input", fill("_seq", pad)).withColumn("xml_mask", fill("_mask", 0))
            .withColumn("langs", fill("_lang", tgt_lang)).withColumn("ter", F.col(score))
            .drop("_seq", "_mask", "_lang", "_m"))
