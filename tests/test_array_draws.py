"""Draws of whole arrays: the bits of the column form, and no hash per element in plans."""

import contextlib
import io

from pyspark.sql import functions as F

from tessera.functions.draws import draw_ranks, uniforms
from tessera.operators import pairing as P
from tessera.operators.shaping import hash_uniform


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(True)
    return out.getvalue().split("== Optimized Logical Plan ==")[1]


def test_draws_are_those_of_the_column(spark):
    keys = ["1", "-7", None, "", "ä", "x" * 44, "y" * 52, "z" * 300]
    rows = [(k, list(range(n))) for k in keys for n in (0, 1, 12, 130)] + [("n", None)]
    d = spark.createDataFrame(rows, "k string, a array<int>").repartition(3)
    for tags in (["", ":how"], [":1"]):
        one = F.flatten(F.transform("a", lambda x, i: F.array(*[hash_uniform(23, "k", F.concat(i.cast("string"), F.lit(t))) for t in tags])))
        both = d.select(one.alias("old"), uniforms(23, "k", "a", tags).alias("new"))
        assert both.filter(~F.col("old").eqNullSafe(F.col("new"))).count() == 0 and both.count() == len(rows)
    pairs = F.array_sort(F.transform("a", lambda x, i: F.struct(hash_uniform(5, "k", i).alias("u"), i.alias("i"))))
    for r in d.select(pairs.alias("p"), draw_ranks(5, "k", "a").alias("r")).collect():
        assert (r.p is None and r.r is None) or [r.r[x.i] for x in r.p] == list(range(len(r.p)))


def test_masks_and_negatives_hash_arrays_at_once(spark):
    d = spark.createDataFrame([(1, [5, 6, 2], 3)], "k long, ids array<int>, n int")
    negatives = plan(P.contrastive_negatives(d, "k", "n", 3, 19))
    assert "ArrowEvalPython" in negatives and "md5" not in negatives
    masked = plan(P.mask_tokens(d.select("k", "ids"), "k", "ids", 0.15, 23, 0, 1))
    assert "ArrowEvalPython" in masked and "array_sort" not in masked
