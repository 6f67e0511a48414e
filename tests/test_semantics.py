"""Hand-computed cases of rules that a shared reading of Spark code and SQL
twin could both get wrong."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.operators import batching as BT
from tessera.operators import bleu as B
from tessera.operators import ids as I
from tessera.operators import pairing as P
from tessera.sources import text as TX


def arr(spark, values, expr):
    df = spark.createDataFrame([(values,)], "a array<int>")
    return df.select(expr(F.col("a")).alias("x")).first()["x"]


@pytest.mark.parametrize("row,left,want", [
    ([5, 1, 7, 2], True, [5, 1, 7, 2]),            # does not end in a pad: stays, interior pad and all
    ([5, 7, 1, 1], True, [1, 1, 5, 7]),
    ([5, 1, 7, 1], True, [7, 1, 5, 1]),            # rotation by two pads keeps the interior order
    ([1, 1, 5, 7], True, [1, 1, 5, 7]),
    ([1, 1, 5, 7], False, [5, 7, 1, 1]),
    ([1, 5, 1, 7], False, [1, 7, 1, 5]),
    ([5, 7], True, [5, 7]), ([], True, []), ([1, 1], True, [1, 1]),
])
def test_flip_padding(spark, row, left, want):
    assert arr(spark, row, lambda a: A.flip_padding(a, 1, left)) == want


def test_bos_is_always_prepended_and_conditional_form_is_apart(spark):
    assert arr(spark, [0, 5], lambda a: A.prepend(a, 0)) == [0, 0, 5]
    assert arr(spark, [0, 5], lambda a: A.prepend_bos(a, 0)) == [0, 5]


def test_part_files_are_read_in_numeric_order(spark, tmp_path):
    for n in (99_998, 99_999, 100_000, 100_001, 2):
        (tmp_path / f"part-{n:05d}-abc.txt").write_text(f"line of {n}\n")
    got = [r.line for r in TX.read_lines(spark, str(tmp_path)).orderBy("id").collect()]
    assert got == [f"line of {n}" for n in (2, 99_998, 99_999, 100_000, 100_001)]


def test_malformed_rows_fail_the_read(spark, tmp_path):
    align, manifest = tmp_path / "align.txt", tmp_path / "manifest.tsv"
    align.write_text("a b\nlonely\n")
    manifest.write_text("/root/of/it\nx.wav\t12\nbad line\n")
    with pytest.raises(ValueError, match="alignment line 1"):
        TX.read_align(spark, str(align))
    with pytest.raises(ValueError, match="manifest line 2"):
        TX.read_manifest(spark, str(manifest))
    manifest.write_text("/root/of/it\nx.wav\t12\ny.wav\t7\n")
    assert sorted((r.fname, r["size"]) for r in TX.read_manifest(spark, str(manifest)).collect()) == [("x.wav", 12), ("y.wav", 7)]


def test_negatives_come_from_all_positions(spark):
    df = spark.createDataFrame([("a", 1), ("b", 3), ("c", 0)], "k string, n int")
    got = P.contrastive_negatives(df, "k", "n", 200, 7).collect()
    assert {r.neg for r in got if r.k == "a"} == {0} and sum(r.k == "a" for r in got) == 200
    assert {(r.pos, r.neg) for r in got if r.k == "b"} == {(p, q) for p in range(3) for q in range(3)}
    assert not [r for r in got if r.k == "c"]


def test_zero_weights_and_special_ids_are_never_masked(spark):
    df = spark.createDataFrame([(i, [9, 4, 1, 2, 5, 6, 2]) for i in range(50)], "k int, ids array<int>")
    w = lambda x: F.when(x == 4, 0.0).otherwise(1.0)
    got = P.mask_weighted(df, "k", "ids", w, 0.9, 3, mask_id=0, never=(1, 2)).collect()
    assert {tuple(r.masked) for r in got} == {(9, 4, 1, 2, 0, 0, 2)}


def test_noise_keeps_the_end_and_is_never_empty(spark):
    rnd = random.Random(1)
    rows = [(i, [f"w{rnd.randrange(9)}" + ("@@" if rnd.random() < 0.3 else "") for _ in range(rnd.randrange(0, 7))] + ["</s>"]) for i in range(80)]
    df = spark.createDataFrame(rows, "k int, t array<string>")
    for r in P.word_dropout(df, "k", "t", 0.97, 5, eos="</s>").collect():
        assert r.noised[-1] == "</s>" and len(r.noised) >= 2 and set(r.noised) <= set(r.t)
    for r in P.word_shuffle(df, "k", "t", 3.0, 5, eos="</s>").collect():
        assert r.noised[-1] == "</s>" and sorted(r.noised) == sorted(r.t)
    for r in P.add_noise(df, "k", "t", 3.0, 0.5, 0.5, (1, 2, 3)).collect():
        assert r.noised[-1] == "</s>" and len(r.noised) >= 2


def test_draws_have_52_bits(spark):
    u = [r.u for r in spark.range(2000).select(P.hash_uniform(1, "id").alias("u")).collect()]
    assert len(set(u)) == 2000 and any((x * 2 ** 32) % 1 for x in u) and all(0 <= x < 1 for x in u)


@pytest.mark.parametrize("parts", [1, 5, 16])
def test_row_numbers_with_one_hot_value_and_hashed_keys(spark, parts):
    rnd = random.Random(2)
    rows = [(7 if i % 3 == 0 else rnd.getrandbits(62), rnd.getrandbits(62), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "major long, minor long, v long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = I.running_total(I.with_row_id(df, ["major", "minor"]), ["major", "minor"], value="v", out="cum").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    total, want = 0, {}
    for n, (a, b, v) in enumerate(sorted(rows)):
        total += v
        want[a, b] = (n, total)
    assert {(r.major, r.minor): (r.row_id, r.cum) for r in got} == want


def test_token_blocks_over_long_and_empty_rows(spark):
    rows = [(0, ["a"] * 5), (1, []), (2, [f"t{i}" for i in range(23)]), (3, ["z"])]
    got = BT.token_blocks(spark.createDataFrame(rows, "i int, t array<string>"), "t", 4, [F.col("i")]).orderBy("block").collect()
    flat = [t for _, ts in rows for t in ts]
    assert [(r.block, r.tokens) for r in got] == [(b, flat[4 * b:4 * b + 4]) for b in range(8)]


def test_bleu_with_several_references(spark):
    hyp = spark.createDataFrame([(0, "a b c d e f".split())], "k int, tokens array<string>")
    refs = spark.createDataFrame([(0, 0, "a b c d x".split()), (0, 1, "c d e f g h i".split())], "k int, ref int, tokens array<string>")
    r = B.bleu_multi(hyp, refs, "k").first()
    assert (r.m1, r.m2, r.m3, r.m4) == (6, 5, 4, 2) and (r.c1, r.c4) == (6, 3) and (r.predlen, r.reflen) == (6, 5)


def test_every_row_a_size_of_its_own(spark):
    """W-03 has no bound on the number of distinct sizes (there was one, which refused)."""
    got = BT.greedy_batches(spark.range(50).select("id", (F.col("id") + 1).alias("n")), "id", ["n"], max_tokens=64, chunk_rows=10)
    rows = sorted((r["rank"], r["batch"]) for r in got.collect())
    want, open_, k = [], [], 0
    for i in range(50):
        if open_ and (len(open_) + 1) * (i + 1) > 64:
            open_, k = [], k + 1
        open_.append(i)
        want.append((i, k))
    assert rows == want
