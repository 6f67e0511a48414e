"""Hand goldens (FIXTURES.md section 3) and brute-force checks of operators
without an SQL oracle."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions import text as T
from tessera.operators import batching as BT
from tessera.operators import bleu as B
from tessera.operators import metrics as M
from tessera.operators import shaping as S
from tessera.operators import vocab as V


def one(spark, expr, schema="x string", value=None):
    df = spark.createDataFrame([(value,)], schema)
    return df.select(expr.alias("r")).first()["r"]


def test_remove_bpe(spark):
    assert one(spark, T.remove_bpe("x"), value="选@@ 任 统治") == "选任 统治"


def test_word_index_and_spans(spark):
    df = spark.createDataFrame([(["how", "are", "y@@", "ou"],)], "t array<string>")
    r = df.select(T.word_index("t").alias("w"), T.word_spans("t").alias("s")).first()
    assert r["w"] == [0, 1, 2, 2]
    assert [(x["start"], x["end"]) for x in r["s"]] == [(0, 0), (1, 1), (2, 3)]


def test_interleave(spark):
    df = spark.createDataFrame([([1, 0, 1], [1, 0])], "g array<int>, w array<int>")
    assert df.select(T.interleave("g", "w").alias("r")).first()["r"] == [1, 1, 0, 0, 1]


def test_finalize_vocab(spark):
    counts = spark.createDataFrame([("b", 2), ("a", 2), ("c", 1)], "symbol string, count long")
    v = V.finalize_vocab(counts, threshold=2, padding_factor=8).orderBy("id").collect()
    assert [r["symbol"] for r in v] == ["<s>", "<pad>", "</s>", "<unk>", "a", "b", "madeupword0000", "madeupword0001"]


def test_equal_batches(spark):
    df = spark.range(10).select(S.equal_batches(F.col("id"), 10, 3).alias("b"))
    sizes = sorted([r["count"] for r in df.groupBy("b").count().orderBy("b").collect()], reverse=True)
    assert sizes == [3, 3, 2, 2]


def brute_greedy(sizes, max_tokens, max_sentences, mult):
    """Plain greedy packing written from the rule: a batch closes before a
    row that would make (rows + 1) * longest exceed max_tokens or when it
    already holds max_sentences rows; only a multiple of ``mult`` rows leaves,
    the rest carries over."""
    out, cur = [], []
    for i, n in enumerate(sizes):
        longest = max([sizes[j] for j in cur] + [n])
        if cur and (len(cur) == max_sentences or (len(cur) + 1) * longest > max_tokens):
            take = max(mult * (len(cur) // mult), len(cur) % mult)
            out.append(cur[:take])
            cur = cur[take:]
        cur.append(i)
    if cur:
        out.append(cur)
    return out


@pytest.mark.parametrize("seed", [0, 1, 2, 3])
def test_greedy_segments_match_brute_force(seed):
    rnd = random.Random(seed)
    all_sizes = sorted(rnd.choice([1, 2, 3, 5, 8, 13, 40]) for _ in range(rnd.randint(1, 400)))
    for max_tok, max_sent, mult in [(6, None, 1), (64, 7, 1), (100, 16, 8), (40, 5, 3)]:
        sizes = [x for x in all_sizes if x <= max_tok]
        runs = [((n,), n, sizes.count(n)) for n in sorted(set(sizes))]
        segs, nb = BT.greedy_segments(runs, max_tok, max_sent, mult)
        got = {}
        for s0, s1, b0, st in segs:
            for r in range(s0, s1):
                got.setdefault(b0 + (r - s0) // st, []).append(r)
        want = brute_greedy(sizes, max_tok, max_sent if max_sent else 10 ** 9, mult)
        assert [got[k] for k in sorted(got)] == want


def test_greedy_golden():
    runs = [((1,), 1, 1), ((2,), 2, 1), ((3,), 3, 2)]
    segs, nb = BT.greedy_segments(runs, 6, None, 1)
    assert nb == 2


def test_greedy_batches_spark(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice([3, 4, 9, 20])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, len long")
    got = BT.greedy_batches(df, "id", ["len"], max_tokens=64, max_sentences=10, multiple=4)
    got = sorted((r["rank"], r["batch"]) for r in got.collect())
    sizes = [n for _, n in sorted(rows, key=lambda r: (r[1], r[0]))]
    want = brute_greedy(sizes, 64, 10, 4)
    flat = [(r, b) for b, rs in enumerate(want) for r in rs]
    assert got == flat


def test_tag_scores(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 0.0), (0, 0.0), (0, 0.0)], "gold int, pred double")
    r = M.tag_scores(df, "pred", "gold").first()
    assert (r["tp"], r["tn"], r["fp"], r["fn"]) == (1, 2, 0, 1)
    assert abs(r["mcc"] - 2 / math.sqrt(12)) < 1e-9
    assert abs(r["f1_bad"] - 0.8) < 1e-9 and abs(r["f1_ok"] - 2 / 3) < 1e-9
    df2 = spark.createDataFrame([(1, 1.0), (0, 1.0)], "gold int, pred double")
    assert M.tag_scores(df2, "pred", "gold").first()["mcc"] == 0.0


def test_bleu_identity_and_zero(spark):
    df = spark.createDataFrame([(0, [5, 6, 7, 8, 9], [5, 6, 7, 8, 9])], "id long, h array<int>, r array<int>")
    assert abs(B.bleu(df, "id", "h", "r").first()["bleu"] - 100.0) < 1e-9
    df = spark.createDataFrame([(0, [5, 6, 7, 8, 9], [5, 6, 7, 9, 8])], "id long, h array<int>, r array<int>")
    assert B.bleu(df, "id", "h", "r").first()["bleu"] == 0.0


def test_quantile_loss(spark):
    assert abs(one(spark, M.quantile_loss(F.lit(0.5), F.lit(0.8), 0.6)) - 0.12) < 1e-12


def test_schedule(spark):
    v = one(spark, A.schedule_value(F.lit(1500), [(0, 0.0), (1000, 0.0), (2000, 1.0)]))
    assert abs(v - 0.5) < 1e-12


def test_decumulate(spark):
    df = spark.createDataFrame([(0, 0, -1.0), (0, 1, -3.0), (0, 2, -4.0)], "h long, pos long, cum double")
    r = S.decumulate(df, ["h"], "pos", "cum").orderBy("pos").collect()
    assert [x["step_score"] for x in r] == [-1.0, -2.0, -1.0]


def test_nucleus(spark):
    df = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.3), (0, 2, 0.2)], "g long, k long, p double")
    assert sorted(r["k"] for r in S.nucleus(df, ["g"], "p", 0.6, "k").collect()) == [0, 1]


def test_pair_sequence(spark):
    df = spark.createDataFrame([([10, 11], [12])], "s array<int>, t array<int>")
    seq, mask = A.pair_sequence(None, None, "s", "t", eos=2)
    r = df.select(seq.alias("q"), mask.alias("m"), A.language_ids("s", "t").alias("l")).first()
    assert r["q"] == [2, 10, 11, 2, 2, 12, 2]
    assert r["m"] == [0, 0, 0, 0, 1, 1, 1]
    assert r["l"] == [14] * 4 + [4] * 3


def test_partition_independence(spark):
    """Two-phase row ids do not depend on the shuffle partition count."""
    from tessera.operators.ids import with_row_id
    rows = [(i % 7, i) for i in range(500)]
    res = []
    for n in (1, 3, 16):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        df = spark.createDataFrame(rows, "a long, b long").repartition(n)
        r = with_row_id(df, [F.col("a"), F.col("b")], [F.col("a"), F.floor(F.col("b") / 50)], [F.col("a")])
        res.append(sorted((x["a"], x["b"], x["row_id"]) for x in r.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert res[0] == res[1] == res[2]
    assert [x[2] for x in sorted(res[0])] == list(range(500))


def brute_blocks(sizes, block, sep):
    """Sentence blocks written from the rule: fill while the block stays
    within ``block`` tokens (an empty block takes any sentence); a separator
    row closes the current block and belongs to none."""
    out, cur, blk = [], 0, 0
    for s in sizes:
        if sep is not None and s == sep:
            out.append(None)
            blk, cur = blk + 1, 0
            continue
        if cur != 0 and cur + s > block:
            blk, cur = blk + 1, 0
        cur += s
        out.append(blk)
    return out


@pytest.mark.parametrize("sep", [None, 1])
def test_sentence_blocks_match_brute_force(spark, sep):
    from tessera.operators.sentence_blocks import sentence_blocks
    rnd = random.Random(7)
    sizes = [rnd.choice([1, 2, 3, 5, 9, 17, 30]) for _ in range(700)]
    df = spark.createDataFrame(list(enumerate(sizes)), "k long, n long")
    got = sentence_blocks(df, "n", [F.col("k")], [F.floor(F.col("k") / 64)], [F.lit(0)], block=20, sep=sep,
                          chunk_rows=37, group_chunks=3)
    got = [r["block"] for r in got.orderBy("k").collect()]
    assert got == brute_blocks(sizes, 20, sep)


def test_learn_merges_brute_force(spark):
    from collections import Counter

    from tessera.operators.bpe import bpe_word, learn_merges
    words = {"lower": 5, "lowest": 3, "newer": 6, "wider": 2, "new": 4}
    df = spark.createDataFrame(list(words.items()), "w string, c long")
    got = learn_merges(df, "w", "c", 6)
    # plain learner: most frequent adjacent pair (ties: smallest pair), merged everywhere
    segs = {w: list(w) for w in words}
    want = []
    for r in range(6):
        cnt = Counter()
        for w, parts in segs.items():
            for a, b in zip(parts, parts[1:]):
                cnt[(a, b)] += words[w]
        (a, b), n = sorted(cnt.items(), key=lambda kv: (-kv[1], kv[0]))[0]
        if n < 2:
            break
        want.append((r, a, b))
        for w, parts in segs.items():
            out, i = [], 0
            while i < len(parts):
                if i < len(parts) - 1 and parts[i] == a and parts[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            segs[w] = out
    assert got == want
    ranks = {(a, b): r for r, a, b in got}
    assert "".join(bpe_word("lowest", ranks)) == "lowest"


@pytest.mark.parametrize("parts", [1, 5, 16])
def test_results_independent_of_partitioning(spark, parts):
    """BLEU, greedy batches and sentence blocks give the same answer for any
    shuffle partition count and input partitioning."""
    from tessera.operators.sentence_blocks import sentence_blocks
    rnd = random.Random(11)
    rows = [(i, [rnd.randint(4, 9) for _ in range(rnd.randint(1, 12))]) for i in range(120)]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.createDataFrame(rows, "id long, h array<int>").repartition(parts)
        df = df.withColumn("r", F.reverse("h"))
        b = B.bleu(df, "id", "h", "r").first()
        sizes = spark.createDataFrame([(i, len(h)) for i, h in rows], "id long, len long").repartition(parts)
        g = BT.greedy_batches(sizes, "id", ["len"], max_tokens=24, max_sentences=5, multiple=2)
        gb = sorted((r["id"], r["batch"]) for r in g.collect())
        sb = sentence_blocks(sizes, "len", [F.col("id")], [F.floor(F.col("id") / 16)], [F.lit(0)], block=20,
                             chunk_rows=13, group_chunks=2)
        sbb = sorted((r["id"], r["block"]) for r in sb.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    key = (round(b["bleu"], 9), b["m1"], b["m4"], tuple(gb), tuple(sbb))
    cache = test_results_independent_of_partitioning.__dict__.setdefault("seen", [])
    cache.append(key)
    assert all(k == cache[0] for k in cache)
    assert sbb and [x[1] for x in sorted(sbb)] == brute_blocks([len(h) for _, h in rows], 20, None)
