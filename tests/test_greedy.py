"""Greedy size batches (W-03): chunk functions compose to the sequential rule."""

import random

import numpy as np
import pytest

from tessera.operators import batching as BT
from test_goldens import brute_greedy


def in_chunks(sizes, rule, most, size):
    """The rows' batches, chunk by chunk, each entered through the tables alone."""
    state = closed = 0
    out = []
    for first in range(0, len(sizes), size):
        lo, end = max(0, first - most), min(first + size, len(sizes))
        g = BT.Greedy(np.array(sizes[lo:min(len(sizes), end + most + 1)]), *rule, most)
        out += (g.batches(first - lo, end - lo, state) + closed).tolist()
        exits, count = g.table(first - lo, end - lo, most)
        state, closed = int(exits[state]), closed + int(count[state])
    return out


@pytest.mark.parametrize("seed", range(6))
def test_chunks_equal_the_sequential_rule(seed):
    rnd = random.Random(seed)
    for max_tok, max_sent, mult in [(64, 7, 1), (100, 16, 8), (40, 5, 3), (60, 10 ** 9, 4), (10 ** 9, 9, 8), (64, 3, 8)]:
        sizes = [rnd.choice([1, 2, 3, 5, 8, 13, 40]) for _ in range(rnd.randint(1, 300))]
        sizes = sizes if seed % 2 else sorted(sizes)                   # several size columns: not monotone
        most = min(len(sizes), max_sent, max_tok) + mult
        want = [b for b, rows in enumerate(brute_greedy(sizes, max_tok, max_sent, mult)) for _ in rows]
        assert in_chunks(sizes, (max_tok, max_sent, mult), most, most + 2 + rnd.randrange(20)) == want


@pytest.mark.parametrize("chunk", [24, 8192])
def test_two_size_columns_over_many_chunks(spark, chunk):
    rnd = random.Random(chunk)
    rows = [(i, rnd.randint(1, 12), rnd.randint(1, 20)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, s int, t int").repartition(3)
    got = sorted((r["rank"], r["id"], r["batch"]) for r in BT.greedy_batches(df, "id", ["s", "t"], 90, 12, 4, chunk_rows=chunk).collect())
    order = sorted(rows, key=lambda r: (r[1], r[2], r[0]))
    want = [b for b, g in enumerate(brute_greedy([max(r[1:]) for r in order], 90, 12, 4)) for _ in g]
    assert got == [(i, r[0], b) for i, (r, b) in enumerate(zip(order, want))]


def test_edges(spark):
    none = spark.createDataFrame([], "id long, s int")
    assert BT.greedy_batches(none, "id", ["s"], 10, 5).collect() == []
    some = spark.createDataFrame([(1, 0), (2, 0), (3, 11)], "id long, s int")
    with pytest.raises(ValueError):
        BT.greedy_batches(some, "id", ["s"], 10, 5)
    assert {r.batch for r in BT.greedy_batches(some, "id", ["s"]).collect()} == {0}
