"""Quality rules and language-model scores against plain Python."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import charlm, lm_score, quality
from tessera.llm.common import SPACE, U64, Words, slices

SPACES = r"[^\x20\x09-\x0D]+"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(SPACES, t or "")


def base_features(t):
    w = words(t)
    n = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    rep = {i + j for i in range(len(w) - 2) if n[tuple(w[i:i + 3])] > 1 for j in range(3)}
    lines = Counter(x for x in (t or "").split("\n") if words(x))
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), sum(c - 1 for c in lines.values()), len(rep))


def brute_model(texts, ends=False):
    """Interpolated modified Kneser-Ney over byte tuples, as in charlm."""
    K, counts = charlm.ORDER, Counter()
    for t in texts:
        for w in [x.translate(FOLD).encode() for x in words(t)] + ([b""] if ends else []):
            s = b" " * (K - 1) + w + b" "
            counts.update(s[i:i + K] for i in range(len(s) - K + 1))
    level = {K: {g: (n, n) for g, n in counts.items()}}
    for k in range(K - 1, 0, -1):
        raw, types = Counter(), Counter()
        for g, (r, _) in level[k + 1].items():
            raw[g[1:]] += r
            types[g[1:]] += 1
        level[k] = {g: (raw[g], raw[g] if k > 1 and g[:1] == b" " else types[g]) for g in raw}
    p, gamma = {0: {b"": 1 / 256}}, {}
    for k in range(1, K + 1):
        c = {g: x for g, (_, x) in level[k].items()}
        n = [sum(x == i for x in c.values()) for i in (1, 2, 3, 4)]
        y = max(n[0], 1e-9) / (max(n[0], 1e-9) + 2 * n[1])
        m = [max(n[0], 1e-9), *n[1:]]
        cutoff = [min(i - 0.05, max(0.05, i - (i + 1) * y * m[i] / m[i - 1] if m[i - 1] else 0.5)) for i in (1, 2, 3)]
        off = {g: min(x, cutoff[min(x, 3) - 1]) for g, x in c.items()}
        total, freed = Counter(), defaultdict(float)
        for g, x in c.items():
            total[g[:-1]] += x
            freed[g[:-1]] += off[g]
        gamma[k] = {ctx: freed[ctx] / total[ctx] for ctx in total}
        p[k] = {g: (x - off[g]) / total[g[:-1]] + gamma[k][g[:-1]] * p[k - 1][g[1:]] for g, x in c.items()}

    def log_prob(g):
        out = 0.0
        for k in range(K, -1, -1):
            s = g[len(g) - k:]
            if s in p[k]:
                return out + math.log(p[k][s])
            if k:
                out += math.log(gamma[k].get(s[:-1], 1.0))
        return out + math.log(1 / 256)

    def word(w):
        s = b" " * (K - 1) + w + b" "
        return sum(log_prob(s[i:i + K]) for i in range(len(s) - K + 1))
    return word, p


TEXTS = ["the cat sat on the mat", "the dog sat on the log and the cat", "a cat and a dog", "été naïve the", "x" * 40]


@pytest.fixture(scope="module")
def levels(spark):
    t = spark.createDataFrame([("en", x) for x in TEXTS], "lang string, text string")
    return charlm.arrays(charlm.smoothed(charlm.count_grams(t, ends=True)))["en"]


def test_kneser_ney_is_that_of_plain_python_and_sums_to_one(levels):
    word, p = brute_model(TEXTS, ends=True)
    for k in range(1, charlm.ORDER + 1):
        gram, logp, _ = levels[k]
        real = {int.from_bytes(g, "big"): x for g, x in p[k].items()}
        got = {int(g): math.exp(v) for g, v in zip(gram, logp) if v > charlm.NEVER + 1}
        assert got.keys() == real.keys()
        assert all(abs(got[g] - real[g]) < 1e-9 for g in got)
    model = charlm.HashArrays(levels)
    for ctx in (b"    ", b"  th", b"qqqq", b" cat"):
        at = np.array([int.from_bytes(ctx + bytes([b]), "big") for b in range(256)], U64)
        assert abs(np.exp(model.score(at)).sum() - 1) < 1e-4


def test_word_scores_of_both_stores(levels):
    word, _ = brute_model(TEXTS, ends=True)
    known = ["the", "cat", "mat", "dog", "unseen", "thezzz", "été", "x" * 40, "q"]
    buf = np.frombuffer(" ".join(known).encode(), np.uint8)
    w = Words(buf, np.array([0, len(buf)]), SPACE)
    h, one = np.unique(w.hashes(), return_index=True)
    want = [word(known[i].encode()) for i in one]
    exact = charlm.Speller(charlm.HashArrays(levels))
    for _ in range(2):                                   # spelled out, then remembered
        assert np.allclose(exact.score(buf, w.start[one], w.end[one], h), want, atol=1e-4)
    trie = lm_score.Trie(levels)
    got = charlm.Speller(trie).score(buf, w.start[one], w.end[one], h)
    size = np.array([len(known[i].encode()) + 1 for i in one])
    assert (np.abs(got - want) <= 0.1 * size).all()      # what is lost to 256 levels
    gram = np.sort(levels[5][0])
    exact_p = charlm.HashArrays(levels).score(gram)
    assert np.abs(trie.score(gram) - exact_p).max() < 0.2


@pytest.mark.parametrize("values", [[0], [0, 0, 0], [3], [0, 1, 1, 5, 900, 900, 10 ** 9], list(range(2000)), [7] * 700 + [10 ** 7]])
def test_elias_fano(values):
    s = lm_score.EliasFano(np.array(values))
    assert s[np.arange(len(values))].tolist() == values


def test_quality(spark, odd, odd_rows, nothing):
    r = np.random.default_rng(4)
    syll = ["ta", "lo", "mi", "ren", "so", "ka"]

    def text(n, alphabet=None):
        return " ".join("".join(r.choice(syll, r.integers(1, 4))) if alphabet is None else "".join(r.choice(list(alphabet), 7)) for _ in range(n))
    rows = [(3000 + i, text(150), "xx") for i in range(120)] + [(4000, text(300, "qzwvjkxQZ#*"), "xx"), (4001, "tatata " * 200, "xx"),
                                                               (4002, "a line of it\n\n a line of it\na line of it\r\n|x|\n|x|", "xx"), (4003, text(40), "xx")]
    docs = odd.select("doc_id", "text", "lang").union(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    got = quality.judged(docs).collect()
    alls = [(x[0], x[1]) for x in odd_rows] + [(x[0], x[1]) for x in rows]
    want = Counter((d, *base_features(t)) for d, t in alls)
    assert Counter((x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) for x in got) == want
    for x in got:
        assert x.base_failed == (x.n_words < 50 or 100 * x.n_repeat_words > 50 * x.n_words)
        assert not (x.kept and x.base_failed)
    kept = {x.doc_id: x.kept for x in got}
    assert all(kept[3000 + i] for i in range(120)) and not kept[4000] and not kept[4001] and not kept[4003]
    assert kept[1] and kept[4]
    # perplexity and bands, from a model written in plain Python
    by = defaultdict(list)
    for d, t, *rest in [(x[0], x[1], x[2]) for x in odd_rows] + rows:
        by[rest[0] or ""].append((d, t))
    word, _ = brute_model([t for _, t in by["xx"]])
    for x in got:
        if x.lang == "xx" and x.n_words:
            t = dict(by["xx"])[x.doc_id].translate(FOLD)
            mean = sum(word(w.encode()) for w in words(t)) / sum(len(w.encode()) + 1 for w in words(t))
            assert abs(math.log(x.perplexity) + mean) < 1e-3
            if not x.base_failed:
                slack = quality.REACH * (x.high - x.low) + quality.SHORT / math.sqrt(x.units)
                assert x.kept == (x.low - slack <= x.score <= x.high + slack)
    assert quality.report(nothing).count() == 0


def test_bands_fitted_on_labels(spark, monkeypatch):
    """Both borders reject, a hot source of another kind does not widen them, and
    languages with few good labels keep the wide band."""
    monkeypatch.setattr(quality, "MIN_GOOD", 50)
    r = np.random.default_rng(6)
    syll = ["ta", "lo", "mi", "ren", "so", "ka", "bri", "un"]

    def text(n, draw):
        return " ".join("".join(draw()) for _ in range(n))
    plain = lambda: r.choice(syll, r.integers(1, 4))                     # noqa: E731
    rows = [(i, text(int(r.integers(60, 200)), plain), "xx") for i in range(300)]
    rows += [(1000 + i, text(120, lambda: r.choice(list("taiouzqvwx"), 7)), "xx") for i in range(130)]      # a third, apart
    rows += [(2000, text(150, lambda: r.choice(list("qzwvjkx#"), 7)), "xx"), (2001, text(150, lambda: r.choice(["ta", "lo"], 2)), "xx"),
             (None, text(80, plain), "xx")] + [(3000 + i, text(90, plain), "yy") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = [(i, 1) for i in range(300)] + [(0, 1), (5, 0), (6, None), (None, 1), (99999, 1)] + [(3000 + i, 1) for i in range(20)]
    labels = spark.createDataFrame(labels, "doc_id bigint, quality int")
    got = quality.judged(docs, labels).collect()
    kept = {x.doc_id: x.kept for x in got}
    assert len(got) == len(rows) and not any(x.base_failed for x in got if x.doc_id != 2001)
    assert sum(kept[i] for i in range(300)) >= 296 and all(kept[3000 + i] for i in range(20))
    assert not any(kept[1000 + i] for i in range(130)) and not kept[2000] and not kept[2001]
    # the borders, from all good labels in plain Python
    mine = {x.doc_id: x for x in got if x.lang == "xx" and not x.base_failed}
    middle = sorted(x.score for x in got if x.lang == "xx" and not x.base_failed)
    middle = middle[math.ceil(len(middle) / 2) - 1]
    dev = {d: (x.score - middle) * math.sqrt(x.units / (x.units + quality.LENGTH)) for d, x in mine.items()}
    good = sorted(dev[i] for i in range(300) if i != 5)
    low, high = (good[math.ceil(q * len(good)) - 1] for q in (quality.LOST, 1 - quality.LOST))
    assert all(x.kept == (low <= dev[d] <= high) for d, x in mine.items())
    few = spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")
    wide = {x.doc_id: x.kept for x in quality.judged(docs, few).collect()}
    assert wide == {x.doc_id: x.kept for x in quality.judged(docs).collect()}
    assert quality.report(docs.limit(0), labels).count() == 0 and quality.report(docs.limit(3), labels.limit(0)).count() == 3


def brute_scores(rows):
    train = [(d, t) for d, t in rows if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2]
    c = Counter(w for _, t in train for w in words((t or "").translate(FOLD)))
    c["<end> "] = len(train)
    c = +c
    total, distinct = sum(c.values()), len(c)
    out = []
    for d, t in rows:
        tokens = words((t or "").translate(FOLD)) + ["<end> "]
        held = zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
        out.append((d, held, len(tokens), sum(c[w] > 0 for w in tokens), total, sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in tokens)))
    return sorted(out, key=lambda r: tuple((x is not None, x) for x in r)), train


def brute_events(train, spell):
    """Probabilities of training tokens (the end is "") and of any other token."""
    c = Counter(w for _, t in train for w in words((t or "").translate(FOLD)) + [""])
    total, n = sum(c.values()), [sum(x == i for x in c.values()) for i in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1])
    cutoff = [min(i - 0.05, max(0.05, i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else 0.5)) for i in (1, 2, 3)]
    off = {w: cutoff[min(x, 3) - 1] for w, x in c.items()}
    mass, other = sum(math.exp(spell[w]) for w in c), (n[0] + 1) / (total + 2)
    p = {w: (1 - other) * (x - off[w] + sum(off.values()) * math.exp(spell[w]) / mass) / total for w, x in c.items()}
    assert abs(sum(p.values()) + other - 1) < 1e-9
    return lambda w: p.get(w, other)


@pytest.mark.parametrize("limit", [lm_score.VOCABULARY, 0])
def test_scores(spark, odd, odd_rows, nothing, limit):
    rows = [(x[0], x[1]) for x in odd_rows]
    want, train = brute_scores(rows)
    got = sorted((tuple(r) for r in lm_score.scored(odd, limit).collect()), key=lambda r: tuple((x is not None, x) for x in r))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert all(abs(a[5] - b[5]) < 1e-6 * max(1, abs(b[5])) for a, b in zip(got, want))
    word, _ = brute_model([t for _, t in train], ends=True)
    spell = {w: word(w.encode()) for w in {w for _, t in rows for w in words((t or "").translate(FOLD))} | {""}}
    opened = {d: sum(spell[w] for w in words((t or "").translate(FOLD)) + [""]) / math.log(10) for d, t in rows if d not in (None, 13)}
    event = brute_events(train, spell)
    true = {d: sum(math.log10(event(w)) for w in words((t or "").translate(FOLD)) + [""]) for d, t in rows if d not in (None, 13)}
    for r in got:
        if r[0] in true:
            assert abs(r[6] - true[r[0]]) <= 0.02 * abs(true[r[0]]) + 0.2
            assert abs(r[7] - opened[r[0]]) <= 0.02 * abs(opened[r[0]]) + 0.2
    assert lm_score.scored(nothing, limit).count() == 0


def test_held_out_texts_are_better_than_their_base(spark):
    """On text of the same kind, the model beats add-one unigrams."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    r = lm_score.scored(d).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def test_scores_do_not_depend_on_the_size_of_the_model(spark, odd, monkeypatch):
    """Beyond the bound of what is broadcast, every n-gram still counts."""
    def run():
        return sorted((tuple(r) for r in lm_score.scored(odd).collect()), key=lambda r: tuple((x is not None, x) for x in r))
    whole = run()
    monkeypatch.setattr(charlm, "MODEL_ROWS", 20)
    joined = run()
    assert [r[:5] for r in joined] == [r[:5] for r in whole]
    for a, b in zip(joined, whole):
        assert abs(a[5] - b[5]) < 1e-6 * max(1, abs(b[5])) and abs(a[6] - b[6]) < 1e-4 * max(1, abs(b[6]))


def test_joined_grams_score_as_looked_up_ones(spark, levels):
    """Known and unknown n-grams, and a language that the model does not have."""
    t = spark.createDataFrame([("en", x) for x in TEXTS], "lang string, text string")
    model = charlm.smoothed(charlm.count_grams(t, ends=True))
    grams = np.unique(np.concatenate([levels[5][0], np.array([int.from_bytes(x, "big") for x in (b"  the", b"zzzzz", b" catz", b"qthe ", b"    q")], U64)]))
    asked = spark.createDataFrame([(lang, int(g)) for g in grams for lang in ("en", "xx")], "lang string, gram bigint")
    got = {(r.lang, r.gram): r.value for r in charlm.gram_scores(asked, model).collect()}
    want = charlm.HashArrays(levels).score(grams)
    assert len(got) == 2 * len(grams)
    assert all(abs(got["en", int(g)] - v) < 1e-4 for g, v in zip(grams, want))
    assert all(abs(got["xx", int(g)] - math.log(1 / 256)) < 1e-9 for g in grams)


def test_a_rare_language_keeps_its_model(spark, monkeypatch):
    """Two languages of very unequal size, and more n-grams than are broadcast."""
    r = np.random.default_rng(5)

    def text(syll, n):
        return " ".join("".join(r.choice(syll, r.integers(1, 4))) for _ in range(n))
    rows = [(i, text(["ta", "lo", "mi"], 100), "big") for i in range(60)] + [(100 + i, text(["é", "gu", "pa"], 60), None) for i in range(3)] + [(200, "", "rare")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")

    def run():
        return sorted((tuple(x) for x in quality.judged(docs).drop("low", "high").collect()))
    whole = run()
    monkeypatch.setattr(charlm, "MODEL_ROWS", 50)
    joined = run()
    assert len(joined) == len(rows)
    for a, b in zip(joined, whole):
        assert all(abs(x - y) < 1e-4 if isinstance(x, float) else x == y for x, y in zip(a, b))
    assert all(x[7] > 1.1 for x in joined if 100 <= x[0] < 103)
