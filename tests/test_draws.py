"""Alias tables (N-08, N-09): cells hold exactly the weights, draws follow them."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tessera.operators.pairing import alias_table, draw_by_weight


def held(spark, weights, kind):
    df = spark.createDataFrame(list(enumerate(weights)), f"i int, w {kind}").repartition(3)
    cells, m, total = alias_table(df, "i", "w")
    share = {}
    rows = cells.collect()
    assert sorted(r.cell for r in rows) == list(range(m))
    for r in rows:
        assert 0 <= r.own <= total * (1 + 1e-12)
        share[r["item"]] = share.get(r["item"], 0) + Fraction(r.own)
        share[r.alias] = share.get(r.alias, 0) + Fraction(total) - Fraction(r.own)
    return share, m


@pytest.mark.parametrize("weights", [[1], [5, 5, 5], [1, 1, 1, 97], [97, 1, 1, 1], [40, 1, 40, 1, 1, 40, 2], [1, 2, 3, 4, 5, 6, 7, 8],
                                     [random.Random(1).choice([1, 1, 2, 3, 50, 400]) for _ in range(120)]])
def test_cells_hold_the_weights(spark, weights):
    share, m = held(spark, weights, "bigint")
    assert {i: share[i] for i in range(len(weights))} == {i: w * m for i, w in enumerate(weights)}


def test_real_weights_nulls_and_zeros(spark):
    weights = [0.1, None, 0.0, 0.7, -1.0, 1e-9, 0.2]
    share, m = held(spark, weights, "double")
    assert m == 4 and all(abs(float(share[i]) - weights[i] * m) < 1e-12 for i in (0, 3, 5, 6))
    none = spark.createDataFrame([(1, 0)], "i int, w int")
    assert draw_by_weight(spark.range(3).select(F.lit(0.5).alias("u")), "u", none, "i", "w").count() == 0


def test_draws_pass_a_chi_square_test(spark):
    weights = [1, 500, 20, 20, 3000, 7, 452]
    table = spark.createDataFrame(list(enumerate(weights)), "i int, w int")
    n = 200_000
    draws = spark.range(n).select(((F.pmod(F.xxhash64("id"), F.lit(1 << 40))) / float(1 << 40)).alias("u"))
    got = {r.i: r["count"] for r in draw_by_weight(draws, "u", table, "i", "w").groupBy("i").count().collect()}
    want = [n * w / sum(weights) for w in weights]
    assert sum((got.get(i, 0) - e) ** 2 / e for i, e in enumerate(want)) < 24      # 6 degrees of freedom, p < 0.001
