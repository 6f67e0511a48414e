"""Document chunk pairs (J-12, 'doc' mode).

A document is a run of sentences between separators.  From a start sentence a
chunk takes sentences until the document's target length is reached; it is cut
at a random place into a first part and a second one.  With probability 1/2 the
second part follows (label 1) and the next chunk starts behind it; otherwise a
stretch of another, random document does (label 0), and the next chunk starts
with the unused second part.  The longer side is then shortened, token by token
at a random end, until both fit.

All draws are hashes of (seed, document, start), so the start of the next chunk is
a function of the present start alone.  That function is tabulated for *every*
sentence, and the starts a document really uses are found by pointer doubling:
``reached`` gains its image under the 2**k-th successor, and the successor table
is joined with itself, until no chain is that long.  Every step is an equi-join on
(document, sentence), so one huge document is spread over all tasks and the number
of rounds is the logarithm of its chunks.  Chunk ends and cut places are searched
as running minima over the merged order of prefix sums and wanted sums, in buckets.

Defined results: a line of ``break_size`` tokens separates and belongs to no
document; with one document in all, label 0 pairs have no second side (nulls,
length 0); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.draws import uniforms
from tessera.operators.ids import prefix_sum, running_in_group
from tessera.operators.shaping import hash_uniform
from tessera.session import cut_lineage

SPAN = 1 << 12       # sentences of one bucket of a running sum
WIDTH = 1 << 16      # tokens of one bucket of a search


def documents_of_lines(lines: DataFrame, group: str, pos: str, size: str, break_size: int = 1) -> DataFrame:
    """``(doc, idx, group, pos, size, cum)`` of the sentences: documents are
    numbered in the order of (group, pos), ``cum`` is the sum of sizes up to and
    with the sentence.  Separators, and the borders of groups, end a document."""
    d = lines.select(F.col(group).alias("group"), F.col(pos).alias("pos"), F.col(size).cast("long").alias("size"))
    bucket = [F.floor(F.col("pos") / SPAN)]
    d = running_in_group(d, ["group"], ["pos"], bucket, (F.col("size") == break_size).cast("long"), "seg", how="sum")
    d = d.filter(F.col("size") != break_size)
    d = running_in_group(d, ["group", "seg"], ["pos"], bucket, F.lit(1).cast("long"), "idx", how="sum")
    d = prefix_sum(d.withColumn("idx", F.col("idx") - 1), (F.col("idx") == 0).cast("long"), ["group", "pos"], out="doc")
    d = d.withColumn("doc", F.col("doc") - 1)
    d = running_in_group(d, ["doc"], ["idx"], [F.floor(F.col("idx") / SPAN)], F.col("size"), "cum", how="sum")
    return cut_lineage(d.select("doc", "idx", "group", "pos", "size", "cum"))


def first_at_least(sents: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (doc, value, ...) with ``found`` = (idx, before) of the document's
    first sentence whose ``cum`` is at least ``value``; null if there is none."""
    carry = [c for c in asked.columns if c != "doc"]
    points = sents.select("doc", F.col("cum").alias("_v"), F.lit(1).alias("_t"),
                          F.struct((-F.col("idx")).alias("i"), (F.col("size") - F.col("cum")).alias("b")).alias("_point"))
    wanted = asked.select("doc", F.col("value").cast("long").alias("_v"), F.lit(0).alias("_t"), F.struct(*carry).alias("_q"))
    both = points.unionByName(wanted, allowMissingColumns=True)
    down = [-F.col("_v"), -F.col("_t")]                # a sentence that just reaches the value counts
    both = running_in_group(both, ["doc"], down, [F.floor(-F.col("_v") / WIDTH)], F.col("_point"), "_best", how="max")
    best = F.when(F.col("_best").isNotNull(), F.struct((-F.col("_best.i")).alias("idx"), (-F.col("_best.b")).alias("before")))
    return both.filter(F.col("_t") == 0).select("doc", *[F.col(f"_q.{c}").alias(c) for c in carry], best.alias("found"))


def chunks(sents: DataFrame, docs: DataFrame, seed: int) -> DataFrame:
    """The chunk that would start at each sentence: ``(doc, s, before, target, e, k, a, label, nxt, len)``."""
    d = sents.join(docs, "doc").select("doc", F.col("idx").alias("s"), (F.col("cum") - F.col("size")).alias("before"), "target", "len")
    d = first_at_least(sents, d.withColumn("value", F.col("before") + F.col("target")))
    d = d.withColumn("e", F.coalesce(F.col("found.idx"), F.col("len") - 1)).withColumn("k", F.col("e") - F.col("s") + 1)
    inner = 1 + F.floor(hash_uniform(seed, F.lit("split"), "doc", "s") * (F.col("k") - 2))
    d = d.withColumn("a", F.when(F.col("k") > 2, inner).otherwise(1).cast("long"))
    d = d.withColumn("label", (hash_uniform(seed, F.lit("label"), "doc", "s") > 0.5) & (F.col("k") > 1))
    d = d.withColumn("nxt", F.when(F.col("label"), F.col("e") + 1).otherwise(F.col("s") + F.col("a")))
    return cut_lineage(d.select("doc", "s", "before", "target", "len", "e", "a", "label", "nxt"))


def reached_starts(table: DataFrame) -> DataFrame:
    """The starts of ``chunks`` that are used: those reached from sentence 0."""
    reached = cut_lineage(table.filter(F.col("s") == 0).select("doc", "s"))
    jump = cut_lineage(table.filter(F.col("nxt") < F.col("len")).select("doc", "s", F.col("nxt").alias("t")))
    while not jump.isEmpty():
        new = reached.join(jump, ["doc", "s"]).select("doc", F.col("t").alias("s"))
        reached = cut_lineage(reached.unionByName(new))
        far = jump.select("doc", F.col("s").alias("t"), F.col("t").alias("u"))
        jump = cut_lineage(jump.join(far, ["doc", "t"]).select("doc", "s", F.col("u").alias("t")))
    return reached


def _sums_at(d: DataFrame, sents: DataFrame, doc: str, idx: str, **names: str) -> DataFrame:
    """``d`` with columns of the sentence (doc, idx), by an equi-join."""
    s = sents.select(F.col("doc").alias("_d"), F.col("idx").alias("_i"), *[F.expr(v).alias(k) for k, v in names.items()])
    return d.join(s, (F.col(doc) == F.col("_d")) & (F.col(idx) == F.col("_i")), "left").drop("_d", "_i")


def _front(seed: int, side: str, cuts: Column) -> Column:
    """How many of ``cuts`` tokens go from the front."""
    places = F.sequence(F.lit(0).cast("long"), cuts)          # a cut's draw has its number from 1 on
    draws = uniforms(seed, F.concat_ws(":", F.lit(side), F.col("doc").cast("string"), F.col("s").cast("string")), places)
    return F.size(F.filter(F.slice(draws, 2, cuts.cast("int")), lambda u: u < 0.5)).cast("long")


def doc_pairs(sents: DataFrame, block: int, seed: int, short_prob: float = 0.1) -> DataFrame:
    """``(doc, s, label, a_start, a_offset, a_end, a_len, b_doc, b_start, b_offset,
    b_end, b_len, size)``: the pairs of all documents of ``documents_of_lines``.
    A side is ``len`` tokens from ``offset`` on in the sentences start..end."""
    most = block - 3
    short = hash_uniform(seed, F.lit("short"), "doc") < short_prob
    target = F.when(short, 2 + F.floor(hash_uniform(seed, F.lit("target"), "doc") * (most - 2))).otherwise(most).cast("long")
    docs = cut_lineage(sents.groupBy("doc").agg(F.count(F.lit(1)).alias("len")).withColumn("target", target))
    n = docs.count()
    table = chunks(sents, docs, seed)
    d = table.join(reached_starts(table), ["doc", "s"]).withColumn("a_last", F.col("s") + F.col("a") - 1)
    d = _sums_at(d, sents, "doc", "a_last", a_cum="cum")
    other = F.floor(hash_uniform(seed, F.lit("doc"), "doc", "s") * (n - 1))
    other = F.when(other >= F.col("doc"), other + 1).otherwise(other)
    d = cut_lineage(d.withColumn("b_doc", F.when(F.col("label"), F.col("doc")).otherwise(other)))
    # second sides: the rest of the chunk, or a stretch of another document
    own = _sums_at(d.filter("label"), sents, "doc", "e", b_cum="cum").withColumn("b_before", F.col("a_cum"))
    size_of = docs.select(F.col("doc").alias("b_doc"), F.col("len").alias("b_docs"))
    far = d.filter(~F.col("label")).join(size_of, "b_doc", "left")
    far = far.withColumn("b0", F.floor(hash_uniform(seed, F.lit("start"), "doc", "s") * F.col("b_docs")))
    far = _sums_at(far, sents, "b_doc", "b0", b_before="cum - size")
    want = F.greatest(F.col("target") - (F.col("a_cum") - F.col("before")), F.lit(1))
    lone = far.filter(F.col("b_before").isNull()).withColumn("b_cum", F.lit(None).cast("long"))
    far = far.filter(F.col("b_before").isNotNull()).withColumnRenamed("doc", "_doc").withColumnRenamed("b_doc", "doc")
    far = first_at_least(sents, far.withColumn("value", F.col("b_before") + want))
    far = far.withColumn("b1", F.coalesce(F.col("found.idx"), F.col("b_docs") - 1)).withColumnRenamed("doc", "b_doc").withColumnRenamed("_doc", "doc")
    far = _sums_at(far, sents, "b_doc", "b1", b_cum="cum")
    names = ["doc", "s", "label", "before", "a_cum", "b_doc", "b_before", "b_cum"]
    d = own.select(*names).unionByName(far.select(*names)).unionByName(lone.withColumn("b_doc", F.lit(None).cast("long")).select(*names))
    # shorten the longer side, then both in turns, the second first
    la, lb = F.col("a_cum") - F.col("before"), F.coalesce(F.col("b_cum") - F.col("b_before"), F.lit(0))
    over = F.greatest(la + lb - most, F.lit(0))
    first = F.least(over, F.abs(la - lb))
    rest = over - first
    d = d.withColumn("a_cut", F.when(la > lb, first).otherwise(0) + F.floor(rest / 2))
    d = d.withColumn("b_cut", F.when(la > lb, 0).otherwise(first) + F.ceil(rest / 2))
    d = cut_lineage(d.withColumn("a_len", la - F.col("a_cut")).withColumn("b_len", lb - F.col("b_cut"))
                    .withColumn("a_front", _front(seed, "a", F.col("a_cut"))).withColumn("b_front", _front(seed, "b", F.col("b_cut"))))

    def ask(tag: str, doc: str, value: str) -> DataFrame:
        return d.filter(F.col(doc).isNotNull()).select(F.col(doc).alias("doc"), F.col("doc").alias("own"), "s", F.lit(tag).alias("tag"), F.expr(value).alias("value"))

    asked = (ask("a0", "doc", "before + a_front + 1").unionByName(ask("a1", "doc", "a_cum - (a_cut - a_front)"))
             .unionByName(ask("b0", "b_doc", "b_before + b_front + 1")).unionByName(ask("b1", "b_doc", "b_cum - (b_cut - b_front)")))
    ends = (first_at_least(sents, asked).groupBy(F.col("own").alias("doc"), "s")
            .agg(*[F.max(F.when(F.col("tag") == t, F.col("found"))).alias(t) for t in ("a0", "a1", "b0", "b1")]))
    r = d.join(ends, ["doc", "s"])
    return r.select("doc", "s", "label", F.col("a0.idx").alias("a_start"), (F.col("before") + F.col("a_front") - F.col("a0.before")).alias("a_offset"),
                    F.col("a1.idx").alias("a_end"), "a_len", "b_doc", F.col("b0.idx").alias("b_start"),
                    (F.col("b_before") + F.col("b_front") - F.col("b0.before")).alias("b_offset"), F.col("b1.idx").alias("b_end"), "b_len",
                    (3 + F.col("a_len") + F.col("b_len")).alias("size"))
