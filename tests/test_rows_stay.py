"""Operators on tokens that leave a row's tokens together: results on odd rows, and plans."""

import contextlib
import hashlib
import io

from pyspark.sql import functions as F

from tessera.operators import extras as X
from tessera.operators import features as FE
from tessera.operators import pairing as P
from tessera.sources import text as S


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_negatives_across_do_not_broadcast_positions(spark):
    d = spark.createDataFrame([(0, 1, 3), (0, 2, 2), (1, 3, 1)], "batch long, k long, n int")
    c = P.contrastive_negatives_across(d, "batch", "k", "n", 2, 67)
    assert "Broadcast" not in plan(c) and c.count() == 12


def test_word_tokenizer_without_explode_or_broadcast(spark):
    rows = [(1, ["ab", "c", "ab"]), (2, []), (3, None), (1, ["d"]), (None, ["ab"]), (None, ["x"])]
    d = spark.createDataFrame(rows, "id long, t array<string>").repartition(2)
    got = X.apply_word_tokenizer(d, "t", lambda w: w.map(list))
    assert "Generate" not in plan(got) and "Broadcast" not in plan(got)
    assert sorted(map(tuple, got.collect()), key=str) == [
        (1, ["a", "b", "d", "c", "a", "b"]), (2, []), (3, []), (None, ["a", "b", "x"])]


def test_replace_unk_explodes_unknown_tokens_only(spark):
    h = spark.createDataFrame([(1, ["a", "<unk>", "<unk>", "<unk>"], [0, 1, 0, 9]), (2, [], []), (3, None, None),
                               (4, ["<unk>", "b"], [0, None]), (None, ["<unk>"], [0])], "k long, hyp array<string>, al array<int>")
    s = spark.createDataFrame([(1, ["x", "y"]), (4, ["z"]), (4, ["x", "q"]), (None, ["x"])], "k long, src array<string>")
    d = spark.createDataFrame([("x", "X"), ("<eos>", "E")], "src string, tgt string")
    got = {r.k: r.replaced for r in FE.replace_unk(h, s, d, "k", alignment="al").collect()}
    assert got == {1: ["a", "y", "X", "<unk>"], 2: [], 3: [], 4: ["X", "z", "b"], None: ["<unk>"]}
    plain = {r.k: r.replaced for r in FE.replace_unk(h, s, d, "k", max_broadcast=0).collect()}
    assert plain == {1: ["a", "y", "E", "<unk>"], 2: [], 3: [], 4: ["X", "z", "b", "b"], None: ["<unk>"]}
    assert plan(FE.replace_unk(h, s, d, "k")).count("Generate") == 1


def test_lines_are_numbered_where_they_are_read(spark, tmp_path):
    d = spark.range(1000).select("id", F.concat(F.lit("line "), F.col("id").cast("string")).alias("l"))
    S.write_lines(d.repartition(7), "id", "l", f"{tmp_path}/lines")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")          # several splits a file
        got = S.read_lines(spark, f"{tmp_path}/lines")
        assert "rangepartitioning" not in plan(got)
        assert sorted(map(tuple, got.collect())) == [(i, f"line {i}") for i in range(1000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_negatives_across_shuffle_lengths_only(spark):
    rows = [(0, 1, 3), (0, 2, 2), (1, 3, 1), (1, 3, 1), (None, 4, 2), (2, None, 2), (2, 5, 0), (2, 6, None)]
    d = spark.createDataFrame(rows, "batch long, k long, n int").repartition(3)
    c = P.contrastive_negatives_across(d, "batch", "k", "n", 4, 67)
    assert "Join" not in plan(c) and "Generate" not in plan(c) and plan(c).count("Exchange") == 2
    got, at = {}, {(0, 1): (0, 3, 0, 5), (0, 2): (3, 2, 0, 5), (1, 3): (1, 1, 1, 2), (2, None): (0, 2, 2, 2)}
    for r in c.collect():
        got.setdefault((r.k, r.pos, r.j), []).append((r.neg_key, r.neg_pos))
    for (batch, k), (_, n, _, total) in at.items():
        for pos in range(n):
            for j in range(1, 5):
                name = f"67:{pos}:{j}" if k is None else f"67:{k}:{pos}:{j}"
                i = int(int(hashlib.md5(name.encode()).hexdigest()[:13], 16) / 2 ** 52 * total)
                want = [(x, i - s) for (b, x), (s, m, _, _) in at.items() if b == batch and s <= i < s + m]
                copies = 4 if k == 3 else 1           # rows of one key lie over each other: each draws, and is met, twice
                assert got.pop((k, pos, j), []) == want * copies
    assert not got


def test_word_tokenizer_does_not_shuffle_pieces(spark):
    d = spark.createDataFrame([(1, ["ab", "c"]), (2, None)], "id long, t array<string>")
    text = plan(X.apply_word_tokenizer(d.repartition("id"), "t", lambda w: w.map(list)))
    assert text.count("Exchange") == 1 and text.index("MapInArrow") < text.index("Exchange")
