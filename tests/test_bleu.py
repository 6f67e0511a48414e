"""Corpus BLEU counts (G-19, G-20) against plain counting."""

import random
from collections import Counter

from tessera.operators import bleu as B


def grams(x, n):
    return Counter(zip(*(x[i:] for i in range(n))))


def plain(rows):
    out = []
    for n in range(1, 5):
        match = total = 0
        for h, refs in rows:
            most = Counter()
            for r in refs or []:
                most |= grams(r or [], n)
            match += sum((grams(h or [], n) & most).values())
            total += max(0, len(h or []) - n + 1)
        out.append((n, match, total))
    pred = sum(len(h or []) for h, _ in rows)
    near = sum(min((abs(len(r or []) - len(h or [])), len(r or [])) for r in refs)[1] for h, refs in rows if refs)
    return out, pred, near


def test_counts_of_token_rows(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(300):
        refs = [[rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(rng.randrange(4))]
        rows.append(([rng.choice("abcde") for _ in range(rng.randrange(9))], refs))
    rows += [(None, [["a"]]), (["a"], None), (["a", None, "a"], [["a", None, "a"], None]), ([], [])]
    df = spark.createDataFrame(rows, "hyp array<string>, refs array<array<string>>").repartition(3)
    got = sorted(map(tuple, B.ngram_stats(df).collect()))
    want, pred, near = plain(rows)
    assert [r[:3] for r in got] == want and got[0][3:] == (pred, near) and all(r[3:] == (0, 0) for r in got[1:])


def trim(x, pad=1, eos=2):
    x = list(x)
    while x and x[0] == pad:
        x.pop(0)
    while len(x) > 1 and x[-1] in (pad, eos):
        x.pop()
    return x


def test_counts_of_id_rows(spark):
    rng = random.Random(4)
    side = lambda: [1] * rng.randrange(3) + [rng.choice([2, 3, 4, 5, 6]) for _ in range(rng.randrange(8))] + [2] * rng.randrange(2) + [1] * rng.randrange(3)
    rows = [(i, side(), side()) for i in range(300)] + [(400, [], [1, 1]), (401, [2], [2]), (402, [2, 2], [3]), (403, None, [4])]
    df = spark.createDataFrame(rows, "id int, h array<int>, r array<int>").repartition(3)
    want, pred, near = plain([(trim(h or []), [[x if x != 3 else -9 for x in trim(r)]]) for _, h, r in rows])
    row = B.bleu(df, "id", "h", "r").first()
    assert [(n, row[f"m{n}"], row[f"c{n}"]) for n in range(1, 5)] == want and (row.predlen, row.reflen) == (pred, near)
    assert B.bleu(df.filter("false"), "id", "h", "r").count() == 1
