"""Near-duplicates, packing, sharding, archives against brute force and round trips."""

import base64
import gzip
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyarrow import fs

from tessera.llm import near_dedup, packing, sharding, warc

SPACES = r"[^\x20\x09-\x0D]+"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = re.findall(SPACES, (text or "").translate(FOLD))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, percent, k):
    """Per row: shingles, smallest id reachable, in the order of rows."""
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[root(i)] = min(low.get(root(i), doc), doc)
    return sorted(((doc, len(sets[i]), low.get(root(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)),
                  key=lambda r: tuple((x is not None, x) for x in r))


def got_components(df):
    rows = df.collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=lambda r: tuple((x is not None, x) for x in r))


def edited(words, n, rng, tag):
    w = list(words)
    for p in rng.sample(range(len(w)), n):
        w[p] = f"{tag}{rng.randrange(10 ** 9)}"
    return " ".join(w)


@pytest.mark.parametrize("percent,k", [(85, 3), (80, 5)])
def test_near_duplicates(spark, odd, odd_rows, nothing, percent, k):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(150)]
    more = [(2000 + i, edited(base, rng.randrange(12), rng, "e")) for i in range(60)]
    # copies of copies: linked with each other, not with the original
    second = edited(base, 9, rng, "f").split()
    more += [(2100 + i, edited(second, rng.randrange(4), rng, "g")) for i in range(25)]
    more += [(2200 + i, " ".join(base[:110 + i]) + "".join(f" t{j}" for j in range(i))) for i in range(40)]      # other lengths
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id bigint, text string"))
    want = brute_components([(r[0], r[1]) for r in odd_rows] + more, percent, k)
    assert got_components(near_dedup.near_duplicates(docs, percent, k)) == want
    assert near_dedup.near_duplicates(nothing).count() == 0


def test_near_duplicates_hot_group(spark):
    """Copies of one text at all distances, with a line that half of them share."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(140)]
    rows = []
    for i in range(220):
        t = edited(base, rng.randrange(1, 16), rng, "e")
        rows.append((i, t + (" the very same added closing line of words" if i % 2 else "")))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert got_components(near_dedup.near_duplicates(docs, 85, 3)) == brute_components(rows, 85, 3)


def test_near_duplicates_compares_few_pairs_of_a_hot_group(spark, monkeypatch):
    """Compared pairs follow the members and links that no centre has, not the square of a group."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(140)]
    rows = [(i, edited(base, rng.randrange(1, 16), rng, "e")) for i in range(500)]
    tables = []
    shares = near_dedup.shares

    def counted(pairs, sets):
        tables.append(shares(pairs, sets))
        return tables[-1]

    monkeypatch.setattr(near_dedup, "shares", counted)
    got = got_components(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), 80, 5))
    assert got == brute_components(rows, 80, 5)
    assert sum(t.count() for t in tables) < 10 * len(rows)


def test_densified_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    for size in (3, 20, 2000):
        a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        b = np.unique(np.concatenate([a[: int(size * 0.9)], rng.integers(0, 1 << 63, size - int(size * 0.9)).astype(np.uint64)]))
        s = near_dedup.signatures([a, b, a])
        assert (s[0] == s[2]).all() and s.all()
        want = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((s[0] == s[1]).mean() - want) < 0.25


@pytest.mark.parametrize("sources", [1, 5, 300])
def test_best_fit_takes_the_tightest_compatible_bin(sources):
    rng = random.Random(sources)
    items = sorted(((rng.randrange(1, 101), rng.randrange(sources) if rng.random() < 0.6 else 0, rng.randrange(150)) for _ in range(700)), reverse=True)
    place = packing.pack_group(*(np.array(c) for c in zip(*items)), 100)
    filled, src, clu = Counter(), {}, {}
    for (length, s, c), (b, slot, offset) in zip(items, place.tolist()):
        open_ = [100 - filled[x] for x in filled if filled[x] + length <= 100 and s not in src[x] and c not in clu[x]] if length < 100 else []
        new = b not in filled
        assert new == (not open_)
        if open_:
            assert 100 - filled[b] == min(open_) and s not in src[b] and c not in clu[b]
        assert offset == filled[b] and slot == len(src.get(b, ()))
        filled[b] += length
        src.setdefault(b, set()).add(s)
        clu.setdefault(b, set()).add(c)


def test_packing(spark, odd, odd_rows, nothing):
    got = packing.pack(odd, capacity=500, group_pieces=10).collect()
    want = Counter()
    for r in odd_rows:
        n = len(re.findall(SPACES, r[1] or "")) + 1
        want.update((r[0], p, p * 500, min(500, n - p * 500)) for p in range(-(-n // 500)))
    assert Counter((r.doc_id, r.piece, r.start, r.length) for r in got) == want
    by = {}
    for r in got:
        by.setdefault((r.pack, r.bin), []).append((r.slot, r.offset, r.length))
    for rows in by.values():
        rows.sort()
        at = 0
        for i, (slot, offset, length) in enumerate(rows):
            assert (slot, offset) == (i, at)
            at += length
        assert at <= 500
    assert packing.pack(nothing).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 40, 41, 1000, 4097])
def test_feistel_is_a_permutation(n):
    f = sharding.Feistel(n, 11)
    p = f.forward(np.arange(n))
    assert sorted(p.tolist()) == list(range(n)) and (f.inverse(p) == np.arange(n)).all()
    if n > 100:
        assert (p != np.arange(n)).mean() > 0.9 and (sharding.Feistel(n, 12).forward(np.arange(n)) != p).any()


def test_sharding(spark, odd, odd_rows, nothing):
    def run(df):
        return sorted(((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.slot, r.grown_shard) for r in sharding.assign(df, 5).collect()),
                      key=lambda r: (r[4], r[5]))
    got = run(odd)
    assert got == run(odd.repartition(7, "text"))
    text = [(r[0], (r[1] or "").encode()) for r in odd_rows]
    assert Counter(r[:3] for r in got) == Counter((d, len(t) + 16, zlib.crc32(t)) for d, t in text)
    size = Counter(r[4] for r in got)
    assert set(size) == set(range(5)) and max(size.values()) - min(size.values()) <= 1
    assert all(sorted(r[5] for r in got if r[4] == s) == list(range(size[s])) for s in size)
    assert sharding.assign(nothing).count() == 0


def test_written_shards(spark, odd, tmp_path):
    sharding.write_shards(odd, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == odd.count() and set(odd.columns) <= set(back.columns)
    got = Counter((r.doc_id, r.text) for r in back.collect())
    assert got == Counter((r.doc_id, r.text) for r in odd.collect())


def pages(spark, extra=""):
    rows = [(i, f"http://h{i % 3}.Example.com:80/p/{i}?q=é {i}#f", f"<p>page {i % 7} é</p>", "x", 1) for i in range(40)]
    rows += [(50, None, "<p>x</p>", "x", 1), (51, "not a url", None, "x", 1), (52, "http://[bad", "", "x", 1), (None, "http://a.b/", "<p>page 3 é</p>", "x", 1),
             (53, "http://a.b/\r\nX: y", "long " * 50_000, "x", 1), (54, "http://a.b/d", "same", "x", 1), (54, "http://a.b/d", "same", "x", 1), (-5, "https://z.z", "same", "x", 1)]
    return rows, spark.createDataFrame(rows, "page_id bigint, url string, html string, key string, offset int").repartition(3)


def test_archives(spark):
    rows, df = pages(spark)
    last = {}
    for p, _, h, *_ in rows:
        if p is not None:
            last[h or ""] = max(last.get(h or "", p), p)
    want = Counter()
    for p, _, h, *_ in rows:
        b = (h or "").encode()
        ref = last.get(h or "")
        ref = None if ref == p else ref
        want[(p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if ref is None else "revisit", ref)] += 1
    assert Counter(tuple(r) for r in warc.round_trip(df).collect()) == want
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.round_trip(none).count() == 0


def test_archive_index_finds_only_what_is_there(spark, monkeypatch):
    monkeypatch.setattr(warc, "LINES", 4)
    rows, df = pages(spark)
    folder = warc.archive_folder(spark)
    captures = warc.write_archives(df, folder)
    directory = warc.build_index(captures, folder)
    assert directory.count() >= 48 // 4
    where, path = fs.FileSystem.from_uri(folder)
    for f in {r.file for r in captures.collect()}:          # every file is a plain sequence of gzip members
        with where.open_input_file(f"{path}/{f}") as s:
            text = gzip.decompress(s.read())
        assert text.count(b"WARC/1.1\r\n") == sum(r.file == f for r in captures.collect())
    ask = spark.createDataFrame([(r[0], r[1]) for r in rows[:5]] + [(999, "http://h0.example.com/none"), (3, "http://elsewhere/")], "page_id bigint, url string")
    found = warc.lookup(warc.page_keys(ask), directory, folder).collect()
    assert sorted(r.page_id for r in found) == [0, 1, 2, 3, 4]


def test_url_keys():
    assert warc.reversed_host_key("HTTPS://www.Example.com:443/A?b=1#c") == "com,example,www)/A?b=1"
    assert warc.reversed_host_key("http://x.org:8080") == "org,x:8080)/"
    assert warc.reversed_host_key(None) == "-"
