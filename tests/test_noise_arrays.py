"""N-01 to N-04 on odd rows against plain loops, and plans without a hash per word."""

import hashlib
import random

from tessera.operators import pairing as P
from tests.test_array_draws import plan


def u(*parts):
    text = ":".join(str(p) for p in parts if p is not None)
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 4503599627370496.0


def words_of(tokens):
    out, w = [], 0
    for t in tokens:
        out.append(w)
        w += t is not None and not t.endswith("@@")
    return out


def shuffled(key, tokens, k, seed, eos):
    w, n = words_of(tokens), len(tokens) - (tokens[-1] == eos)
    at = sorted(range(len(tokens)), key=lambda i: (i >= n, w[i] + (u(seed, key, w[i]) * k if w[i] else -1.0) + 1e-6 * i))
    return [tokens[i] for i in at]


def dropped(key, tokens, p, seed, blank, eos):
    w = words_of(tokens)
    kept = [u(seed, key, x) >= p or (tokens[-1] == eos and x == w[-1]) for x in w]
    out = [t if k else blank for t, k in zip(tokens, kept) if k or blank]
    return out if len(out) > 1 else [tokens[int(u(seed, key, "insert") * len(tokens))]] + out


def rows(seed=4):
    rng = random.Random(seed)
    some = ["a", "b@@", "dé@@", "</s>", None, "@@", "<unk>", ""]
    out = [(rng.choice([None, i, i, 7]), [rng.choice(some) for _ in range(rng.choice([1, 1, 2, 5, 40]))]) for i in range(300)]
    return [(k, t + ["</s>"] if i % 2 else t) for i, (k, t) in enumerate(out)]


def test_noise_equals_plain_loops(spark):
    data = rows()
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "i int, k long, t array<string>").repartition(3)

    def got(c):
        return [r.noised for r in sorted(c.collect(), key=lambda r: r.i)]

    assert got(P.word_shuffle(d, "k", "t", 3.0, 11, eos="</s>")) == [shuffled(k, t, 3.0, 11, "</s>") for k, t in data]
    for blank in (None, "<unk>"):
        assert got(P.word_dropout(d, "k", "t", 0.6, 5, blank, "</s>")) == [dropped(k, t, 0.6, 5, blank, "</s>") for k, t in data]
    want = []
    for k, t in data:
        t = dropped(k, shuffled(k, t, 3.0, 1, "</s>"), 0.2, 2, None, "</s>")
        want.append(dropped(k, t, 0.2, 3, "<unk>", "</s>"))
    assert got(P.add_noise(d, "k", "t", 3.0, 0.2, 0.2, (1, 2, 3))) == want


def test_noise_of_null_and_empty_rows(spark):
    d = spark.createDataFrame([(1, None), (2, [])], "k long, t array<string>")
    assert {r.k: r.noised for r in P.word_dropout(d, "k", "t", 0.5, 5).collect()} == {1: None, 2: []}
    assert {r.k: r.noised for r in P.word_shuffle(d, "k", "t", 3.0, 5).collect()} == {1: None, 2: None}


def test_noise_hashes_words_at_once(spark):
    text = plan(P.add_noise(spark.createDataFrame([(1, ["a", "</s>"])], "k long, t array<string>"), "k", "t", 3.0, 0.2, 0.2, (1, 2, 3)))
    assert text.split("== Physical Plan ==")[1].count("ArrowEvalPython") == 3 and "md5" not in text
