"""Operators on the token stream of a corpus: odd rows against plain loops, and plans."""

import random

from pyspark.sql import functions as F

from tessera.operators import batching as BT
from tessera.operators import extras as X
from tessera.operators import ids as I
from tessera.operators import pairing as P
from tests.test_rows_stay import plan


def corpus(seed=5, n=300):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 0, 1, 2, 3, 20]) for _ in range(n)]
    rows, at = [], 0
    for i, k in enumerate(sizes):
        tokens = [None if t % 17 == 5 else f"t{t}" for t in range(at, at + k)]
        rows.append((i, i, None if k == 0 and i % 2 else tokens))
        at += k
    return rows


def with_parts(spark, parts, run):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        return run()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_context_over_empty_rows_and_partitions(spark):
    rows = corpus()
    d = spark.createDataFrame(rows, "o int, k long, t array<string>").repartition(3)
    stream, want = [], []
    for o, k, t in rows:
        want.append((k, len(stream), stream[-8:], t))
        stream += t or []
    for parts in (1, 60):
        got = with_parts(spark, parts, lambda: X.with_context(d, "k", "t", 8, ["o"], (), ()).collect())
        assert sorted((r.k, r.start, r.context, r.t) for r in got) == want


def test_context_of_repeated_and_null_keys(spark):
    rows = [(0, 1, ["a"]), (1, 2, ["b", "c"]), (2, 2, ["d"]), (3, None, ["e"]), (4, 3, [])]
    d = spark.createDataFrame(rows, "o int, k long, t array<string>")
    got = {(r.k, r.start): r.context for r in X.with_context(d, "k", "t", 2, ["o"], (), ()).collect()}
    assert got == {(1, 0): [], (2, 1): ["a", "b", "c"], (2, 3): ["a", "b", "c"], (None, 4): [], (3, 5): ["d", "e"]}


def test_context_leaves_tokens_in_their_rows(spark):
    d = spark.createDataFrame(corpus(), "o int, k long, t array<string>")
    text = plan(X.with_context(d, "k", "t", 8, ["o"], (), ()))
    assert "Generate" not in text and "SortMergeJoin" not in text


def test_blocks_are_cut_where_the_stream_lies(spark):
    rows = corpus(7)
    stream = [x for _, _, t in rows for x in t or []]
    d = spark.createDataFrame(rows, "o int, k long, t array<string>").repartition(3)
    for size, parts in ((1, 5), (4, 1), (7, 60), (5000, 9)):
        b = with_parts(spark, parts, lambda: BT.token_blocks(d, "t", size, [F.col("o")]))
        got = sorted((r.block, r.tokens) for r in b.collect())
        assert got == [(i, stream[i * size:(i + 1) * size]) for i in range(-(-len(stream) // size))]
    assert "Generate" not in plan(b)


def test_running_sum_of_longs_needs_no_window_over_rows(spark):
    d = spark.createDataFrame([(i, None if i % 5 == 0 else i, 0.5 * i) for i in range(200)], "i int, v long, x double").repartition(7)
    for name, of in (("v", lambda i: 0 if i % 5 == 0 else i), ("x", lambda i: 0.5 * i)):
        for inclusive in (True, False):
            s = I.prefix_sum(d, name, [F.col("i")], inclusive=inclusive)
            assert {r.i: r.cum for r in s.collect()} == {i: sum(of(j) for j in range(i + inclusive)) for i in range(200)}
    assert plan(I.prefix_sum(d, "v", [F.col("i")])).count("Window") == 1          # of the partitions


def test_pooled_arrays_equal_pooled_rows(spark):
    d = spark.createDataFrame([(1, [1.0, 2.0, None, 4.0], [(0, 1), (2, 2), (2, 3), (3, 9)]), (1, [8.0], [(0, 0)]),
                               (2, [], [(0, 0)]), (None, [1.0], [(0, 0)]), (3, [1.0, 2.0, 3.0], None)],
                              "k long, values array<double>, spans array<struct<start:int,end:int>>")
    feats = d.select("k", F.posexplode("values").alias("pos", "value")).filter("value is not null")
    for offset in (0, 1, -1):
        arrays = P.pool_spans(d.select("k", "values"), d.select("k", "spans"), "k", offset)
        rows = P.pool_spans(feats, d.select("k", "spans"), "k", offset)
        assert sorted(map(tuple, arrays.collect())) == sorted(map(tuple, rows.collect()))
