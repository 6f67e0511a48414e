"""Document chunk pairs (J-12) and batched byte-pair learning (H-02) against plain loops."""

import hashlib
import random
from collections import Counter

import pytest

from tessera.operators import bpe
from tessera.operators.doc_pairs import doc_pairs, documents_of_lines


def draw(seed, *keys):
    return int(hashlib.md5(":".join(map(str, (seed, *keys))).encode()).hexdigest()[:13], 16) / 2 ** 52


def plain_pairs(docs, block, seed):
    """The sequential rule: walk each document, chunk by chunk."""
    most, out = block - 3, []
    for doc, sizes in enumerate(docs):
        target = 2 + int(draw(seed, "target", doc) * (most - 2)) if draw(seed, "short", doc) < 0.1 else most
        s = 0
        while s < len(sizes):
            e = s
            while e < len(sizes) - 1 and sum(sizes[s:e + 1]) < target:
                e += 1
            k = e - s + 1
            a = 1 + int(draw(seed, "split", doc, s) * (k - 2)) if k > 2 else 1
            label = draw(seed, "label", doc, s) > 0.5 and k > 1
            left, right, other = [(doc, i) for i in range(s, s + a)], [(doc, i) for i in range(s + a, e + 1)], doc
            if not label:
                other = int(draw(seed, "doc", doc, s) * (len(docs) - 1))
                other += other >= doc
                right = []
                if len(docs) > 1:
                    want = target - sum(sizes[s:s + a])
                    for j in range(int(draw(seed, "start", doc, s) * len(docs[other])), len(docs[other])):
                        right.append((other, j))
                        if sum(docs[d][i] for d, i in right) >= want:
                            break
            la, lb = (sum(docs[d][i] for d, i in side) for side in (left, right))
            cut = {"a": 0, "b": 0}
            while la - cut["a"] + lb - cut["b"] > most:
                cut["a" if la - cut["a"] > lb - cut["b"] else "b"] += 1
            ends = []
            for name, side, total in (("a", left, la), ("b", right, lb)):
                front = sum(draw(seed, name, doc, s, j) < 0.5 for j in range(1, cut[name] + 1))
                tokens = [(i, t) for d, i in side for t in range(docs[d][i])][front:total - (cut[name] - front)]
                ends.append((tokens[0][0], tokens[0][1], tokens[-1][0], len(tokens)) if tokens else (None, None, None, 0))
            out.append((doc, s, label, *ends[0], other if right else None, *ends[1], 3 + ends[0][3] + ends[1][3]))
            s = e + 1 if label else s + a
    return out


def got_pairs(spark, docs, block, seed, parts=4):
    rows = []
    for g, sizes in enumerate(docs):
        rows += [(g, 2 * i, n) for i, n in enumerate(sizes)] + [(g, 2 * len(sizes), 1)]
    lines = spark.createDataFrame(rows or [(0, 0, 1)], "g int, p int, n int").repartition(parts)
    return sorted(map(tuple, doc_pairs(documents_of_lines(lines, "g", "p", "n"), block, seed).collect()))


def test_doc_pairs_equal_the_walk(spark):
    rng = random.Random(2)
    docs = [[rng.randrange(2, 12) for _ in range(rng.choice([1, 2, 3, 8, 40]))] for _ in range(12)] + [[50, 2, 90, 3], [200], [2] * 150]
    assert got_pairs(spark, docs, 32, 7) == plain_pairs(docs, 32, 7)


def test_doc_pairs_alone_and_empty(spark):
    assert got_pairs(spark, [[5, 6, 7, 8, 9]], 16, 3) == plain_pairs([[5, 6, 7, 8, 9]], 16, 3)
    assert got_pairs(spark, [], 16, 3) == []


def test_blank_lines_separate(spark):
    lines = spark.createDataFrame([(1, 0, 3), (1, 1, 1), (1, 2, 1), (1, 3, 4), (2, 0, 1), (2, 1, 5), (2, 2, 2)], "g int, p int, n int")
    got = documents_of_lines(lines, "g", "p", "n").orderBy("doc", "idx").collect()
    assert [tuple(r) for r in got] == [(0, 0, 1, 0, 3, 3), (1, 0, 1, 3, 4, 4), (2, 0, 2, 1, 5, 5), (2, 1, 2, 2, 2, 7)]


def plain_merges(words, n_merges, least=2):
    segs, out = {w: list(w) for w in words if w}, []
    while len(out) < n_merges:
        count = Counter()
        for w, s in segs.items():
            for p in zip(s, s[1:]):
                count[p] += words[w]
        best = min(((-n, p) for p, n in count.items() if n >= least), default=None)
        if best is None:
            break
        out.append(best[1])
        segs = {w: bpe.merge_all(s, {best[1]}) for w, s in segs.items()}
    return out


@pytest.mark.parametrize("alphabet,n", [("ab", 7), ("abcdefgh", 16)])
def test_batched_merges_equal_one_by_one(spark, alphabet, n):
    rng = random.Random(n)
    words = {"".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 9))): rng.choice([1, 1, 2, 2, 3, 5, 8]) for _ in range(120)} | {"": 4, "aaaaaaa": 3}
    df = spark.createDataFrame(list(words.items()) + [(None, 9)], "w string, c int")
    rounds = bpe.learn_rounds(df, "w", "c", n)
    assert [p for r in rounds for p in r] == plain_merges(words, n)
    assert len(alphabet) < 8 or len(rounds) < n


def test_many_merges_a_round(spark):
    """Words over letters of their own: their merges do not touch each other."""
    words = {chr(0x4E00 + 2 * i) + chr(0x4E01 + 2 * i): 1000 - i for i in range(120)}
    rounds = bpe.learn_rounds(spark.createDataFrame(list(words.items()), "w string, c int"), "w", "c", 120)
    assert len(rounds) == 1 and rounds[0] == plain_merges(words, 120)


def test_merges_that_end_a_batch():
    taken = bpe._accepted
    far = {p: (-1, ("z", "z")) for p in [("a", "b"), ("c", "d"), ("b", "c"), ("a", "d")]}
    assert taken([("a", "b", 9), ("c", "d", 8)], far, set()) == [("a", "b"), ("c", "d")]
    assert taken([("a", "b", 9), ("b", "c", 8)], far, set()) == [("a", "b")]                  # its count may fall
    assert taken([("a", "b", 9), ("a", "d", 8)], far, set()) == [("a", "b"), ("a", "d")]
    assert taken([("a", "b", 9), ("c", "d", 8)], far | {("a", "b"): (-8, ("ab", "x"))}, set()) == [("a", "b")]     # a new pair comes first
    assert taken([("a", "b", 9), ("c", "d", 8)], far | {("a", "b"): (-8, ("x", "ab"))}, set()) == [("a", "b"), ("c", "d")]
    assert taken([("a", "b", 9), ("c", "d", 8)], far, {"ab"}) == [("a", "b")]                 # its symbol exists already
    assert taken([("a", "b", 9), ("ab", "c", 8)], far, set()) == [("a", "b")]
    assert taken([("a", "a", 9), ("a", "b", 8)], far, set()) == [("a", "a")]


def test_empty_words(spark):
    assert bpe.learn_merges(spark.createDataFrame([], "w string, c int"), "w", "c", 5) == []


def test_learning_leaves_counts_only(spark):
    import os

    from tessera.session import ensure_checkpoint_dir
    home = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(home))
    d = spark.createDataFrame([("abab", 3), ("ababc", 2), ("cc", 2), ("x", 9), ("", 1), (None, 4)], "w string, c int")
    assert [p for r in bpe.learn_rounds(d, "w", "c", 3) for p in r] == [("a", "b"), ("ab", "ab"), ("abab", "c")]
    assert len(set(os.listdir(home)) - before) == 1          # no index of words, no words of former rounds
