"""Near-duplicate classes by MinHash with star-shaped candidates (operator 1).

One-permutation hashing: a document's distinct word shingles are hashed once,
the 64-bit range is cut into ``BANDS * ROWS`` bins, and a bin keeps its smallest
hash.  Empty bins are filled by optimal densification (each draws bins from a
hash of its own number until it meets a filled one).  ``ROWS`` bins make a band,
equal bands put two texts in a bucket.

Texts with equal shingle sets are one node from the start.  Buckets of at most
``FEW`` members are compared in full.  A larger bucket does not emit its pairs:
it elects a centre, the member that meets most others over all its buckets
(copies resemble their original more than each other), or rather takes the one
that its members share with most other texts (``_common``), and only
(centre, member) edges are checked, on full sets.

A star loses links between members that are not both linked to its centre.  Such
members must differ from the centre in the same shingles, so they are joined on
these differences (``_bridges``), rarest first and only as far as a link is
possible; the pairs left are checked on full sets, too.  So every link of two
texts that share a bucket is found.

Defined results: a null or empty text has no shingles, is linked with nothing
and is its own component; a text of fewer words than a shingle has one shingle,
its whole word sequence; repeated rows and ties give one class with the smallest
``doc_id``; rows with a null ``doc_id`` take part, their class takes the
smallest id that is not null; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, SPACE, U64, Words, cut, gram_hash, mix64, slices, small, within_row

BANDS, ROWS = 40, 5       # misses a link at 0.85 with chance 1e-10, at 0.8 with 1e-7
BINS = BANDS * ROWS
ROWS_AT_ONCE = 2048
BROADCAST_ROWS = 100_000     # of narrow rows (a key and a few numbers)
FEW = 8                      # members of a bucket that are compared with each other
STARS = 2                    # centres of a bucket; all but the first only join members under one label
_EDGES = np.array([(j << 64) // BINS for j in range(1, BINS)], dtype=U64)
_BAND = mix64(np.arange(1, BINS + 1, dtype=U64)) | U64(1)


def shingle_sets(buf: np.ndarray, offs: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (A-Z lower-cased)."""
    w = Words(buf, offs, SPACE, LOWER)
    h = w.hashes()
    keep = within_row(w, words)
    grams, at = gram_hash(h, words), np.concatenate([[0], np.cumsum(keep)])
    whole = grams[keep]
    out = []
    for r, n in enumerate(w.count.tolist()):
        a = w.first[r]
        if n >= words:
            out.append(np.unique(whole[at[a]:at[a + n - words + 1]]))
        elif n:
            out.append(gram_hash(h[a:a + n], n))
        else:
            out.append(np.zeros(0, U64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Densified one-permutation MinHash of non-empty sets, one row each."""
    sig = np.zeros((len(sets), BINS), U64)
    filled = np.zeros((len(sets), BINS), bool)
    for i, s in enumerate(sets):
        at = np.concatenate([[0], np.searchsorted(s, _EDGES), [len(s)]])
        has = at[:-1] < at[1:]
        filled[i] = has
        sig[i, has] = s[at[:-1][has]]
    row, col = np.nonzero(~filled)
    attempt = 0
    while len(row):
        attempt += 1
        draw = (mix64(col.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(attempt)) % U64(BINS)).astype(np.int64)
        got = filled[row, draw]
        sig[row[got], col[got]] = sig[row[got], draw[got]]
        row, col = row[~got], col[~got]
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    parts = (sig * _BAND).reshape(len(sig), BANDS, ROWS)
    return mix64(mix64(parts).sum(axis=2, dtype=U64) + _BAND[:BANDS])


def _sketch(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in slices(batch.column(1)):
                sets = shingle_sets(buf, offs, words)
                for a in range(0, len(sets), ROWS_AT_ONCE):
                    part = sets[a:a + ROWS_AT_ONCE]
                    some = [i for i, s in enumerate(part) if len(s)]
                    keys = band_keys(signatures([part[i] for i in some])).view(np.int64)
                    ends = np.zeros(len(part) + 1, np.int32)
                    ends[np.array(some, np.int64) + 1] = BANDS
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).slice(lo + a, len(part)),
                        pa.array([len(s) for s in part], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in part], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), pa.array(keys.reshape(-1))),
                    ], names=["doc_id", "n_shingles", "node", "bands"])
    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, offs in slices(batch.column(0)):
                sets = shingle_sets(buf, offs, words)
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                ], names=["node", "shingles"])
    return run


def sketch(docs: DataFrame, words: int) -> DataFrame:
    """``(doc_id, n_shingles, node, bands)``; ``node`` digests the shingle set."""
    d = docs.select("doc_id", "text")
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(_sketch(words), f"doc_id {kind}, n_shingles bigint, node binary, bands array<bigint>")


def _light(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a written table if its rows are few; else leave the join to Spark."""
    return F.broadcast(df) if small(df, rows) else df


def full_sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """``(node, shingles)`` of the given ``(node, doc_id)``, from whole texts."""
    want = _light(cut(nodes.select(F.col("doc_id").alias("_id")).distinct()))
    d = docs.select("doc_id", "text")
    texts = d.join(want, d["doc_id"].eqNullSafe(want["_id"]), "left_semi")
    sets = texts.select("text").mapInArrow(_sets(words), "node binary, shingles array<bigint>")
    return cut(sets.join(_light(cut(nodes.select("node"))), "node", "left_semi").dropDuplicates(["node"]))


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)``: smallest node reachable, by alternating hooking on the
    smallest neighbour and pointer jumping; each round is a written table."""
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = label.join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        jump = hooked.select(F.col("node").alias("new"), F.col("new").alias("far"))
        step = cut(hooked.join(jump, "new", "left").select("node", "label", F.least("new", F.coalesce("far", "new")).alias("new")))
        moved = step.filter(~F.col("label").eqNullSafe(F.col("new"))).limit(1).count()
        label = step.select("node", F.col("new").alias("label"))
        if not moved:
            return label


def shares(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``(a, b, na, nb, share)``: set sizes and size of the intersection."""
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("_sa"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("_sb"))
    return (pairs.join(a, "a").join(b, "b")
            .select("a", "b", F.size("_sa").alias("na"), F.size("_sb").alias("nb"), F.size(F.array_intersect("_sa", "_sb")).alias("share")))


def linked(percent: int):
    return 100 * F.col("share") >= percent * (F.col("na") + F.col("nb") - F.col("share"))


def quick_labels(edges: DataFrame) -> DataFrame:
    """``(node, label)``: two rounds of hooking; equal labels are one component,
    one component may still have several."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    one = (both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    far = one.select(F.col("node").alias("label"), F.col("label").alias("far"))
    return cut(one.join(far, "label", "left").select("node", F.coalesce("far", "label").alias("label")))


def _common(large: DataFrame, top: DataFrame) -> DataFrame:
    """``(bucket, c)``: of the centres in ``top``, each bucket takes the one that most
    of its members have as theirs with the largest group, so that the buckets of a
    group of copies share a centre; it need not be a member itself."""
    mine = large.join(top, "bucket").select("c", "node").distinct()
    group = mine.groupBy("c").agg(F.count(F.lit(1)).alias("m"))
    home = mine.join(group, "c").groupBy("node").agg(F.max(F.struct("m", "c")).alias("h"))
    votes = large.select("bucket", "node").join(home, "node").groupBy("bucket", "h").agg(F.count(F.lit(1)).alias("k"))
    return votes.groupBy("bucket").agg(F.max(F.struct("k", "h")).alias("t")).select("bucket", F.col("t.h.c").alias("c"))


def _ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _fits(x: str, y: str, percent: int):
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _within(few: DataFrame, percent: int) -> DataFrame:
    """All pairs of a small bucket's members whose sizes fit."""
    other = few.select("bucket", F.col("node").alias("_c"), F.col("n").alias("_n"))
    return few.join(other, "bucket").filter((F.col("node") < F.col("_c")) & _fits("n", "_n", percent)).select(*_ordered("node", "_c"))


def _labelled(df: DataFrame, label: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` with the label of ``key``, which is its own where it has no link."""
    mark = label.select(F.col("node").alias(key), F.col("label").alias(name))
    return df.join(mark, key, "left").withColumn(name, F.coalesce(name, key))


def _bridges(star: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(a, b)``: pairs of members of one centre that may be linked, have
    different labels and are not both linked to the centre, from ``star``:
    ``(c, node, n, nc, share, is_link, label)``.

    A member differs from c in the shingles of c that it lacks (nc - share) and in
    those that it has besides.  Two members x and y with ``o`` differences in
    common share share_x + share_y - nc + o shingles, so they are linked exactly if

        (100 + percent) * o >= z_x + z_y + (100 + percent) * nc,
        z = percent * n - (100 + percent) * share.

    As z >= -100 * nc, and z > -percent * nc for a member that is not linked to c,
    such a pair has o > 0: it meets in a difference.  Differences are taken in
    one order for all members of c, the rarest first; at the first one that x and y
    have in common, o is at most what both have left of either kind.  Where that
    falls short the pair is no link; a member's own rows end where no partner
    could make up for it.  Differences that no two members of different labels
    share, one of them not linked to c, count for no pair and are left out."""
    whole = 100 + percent
    star = star.withColumn("z", percent * F.col("n") - whole * F.col("share"))
    loose = ~F.col("is_link")
    groups = (star.groupBy("c").agg(F.min("z").alias("z_any"), F.min(F.when(loose, F.col("z"))).alias("z_loose"), F.min("label").alias("_low"), F.max("label").alias("_high"))
              .filter(F.col("z_loose").isNotNull() & (F.col("_low") != F.col("_high"))).drop("_low", "_high"))
    star = star.join(groups, "c").withColumn("base", whole * F.col("nc"))
    star = star.withColumn("least", F.col("base") + F.col("z") + F.when(loose, F.col("z_any")).otherwise(F.col("z_loose")))
    mine = sets.select("node", F.col("shingles").alias("_s"))
    centre = sets.select(F.col("node").alias("c"), F.col("shingles").alias("_c"))
    kind = lambda x, extra: F.transform(x, lambda s: F.struct(s.alias("s"), F.lit(extra).alias("extra")))
    lines = cut(star.join(mine, "node").join(centre, "c")
                .select("c", "node", "n", "label", "is_link", "z", "base", "least",
                        F.explode(F.concat(kind(F.array_except("_c", "_s"), 0), kind(F.array_except("_s", "_c"), 1))).alias("d"))
                .select("*", "d.s", "d.extra").drop("d"))
    met = (lines.groupBy("c", "s").agg(F.count(F.lit(1)).alias("held"), F.max(loose).alias("_loose"), F.min("label").alias("_low"), F.max("label").alias("_high"))
           .filter(F.col("_loose") & (F.col("_low") != F.col("_high"))).select("c", "s", "held"))
    rest = Window.partitionBy("c", "node").orderBy(F.col("held").desc(), F.col("s").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = (lines.join(met, ["c", "s"])
             .withColumn("has", F.sum("extra").over(rest)).withColumn("lacks", F.sum(1 - F.col("extra")).over(rest))
             .filter(whole * (F.col("has") + F.col("lacks")) >= F.col("least")))
    lines = cut(lines.select("c", "s", "node", "n", "label", "is_link", "z", "base", "has", "lacks"))
    other = lines.select("c", "s", *[F.col(k).alias(f"_{k}") for k in ("node", "n", "label", "is_link", "z", "has", "lacks")])
    left = F.least("has", "_has") + F.least("lacks", "_lacks")
    may = (F.col("label") != F.col("_label")) & (F.col("_is_link") | (F.col("node") < F.col("_node")))
    may = may & (whole * left >= F.col("z") + F.col("_z") + F.col("base")) & _fits("n", "_n", percent)
    return lines.filter(loose).join(other, ["c", "s"]).filter(may).select(*_ordered("node", "_node")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = 5) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept, node)`` of every row of
    ``docs``: texts whose word shingle sets share ``percent`` of their union are
    linked, ``component_id`` is the smallest ``doc_id`` reachable."""
    seen = cut(sketch(docs, words))
    nodes = (seen.filter("n_shingles > 0").groupBy("node")
             .agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"), F.first("bands").alias("bands")))
    spread = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    live = cut(spread.join(shared, "bucket"))
    links = live.groupBy("node").agg(F.sum("size").alias("links"))
    sizes = cut(nodes.select("node", "doc_id", "n").join(links, "node"))
    sets = full_sets(docs, sizes, words)
    sizes = sizes.select("node", "n", "links")

    few = live.filter(F.col("size") <= FEW).select("bucket", "node").join(sizes.drop("links"), "node")
    large = cut(live.filter(F.col("size") > FEW).select("bucket", "node").join(sizes.drop("n"), "node"))
    pairs, tested, label, star = _within(few, percent), None, None, None
    for turn in range(STARS):
        top = large.groupBy("bucket").agg(F.max(F.struct("links", "node")).alias("t")).select("bucket", F.col("t.node").alias("c"))
        top = top if turn else _common(large, top)
        large = cut(large.join(top, "bucket").filter("node != c"))
        if turn and not large.limit(1).count():
            break
        spokes = cut(large.select("c", "node").distinct())
        pairs = spokes.select(*_ordered("c", "node")) if turn else pairs.union(spokes.select(*_ordered("c", "node")))
        pairs = pairs.distinct() if tested is None else pairs.distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti")
        found = cut(shares(pairs, sets))
        tested = found if tested is None else tested.union(found)
        label = quick_labels(tested.filter(linked(percent)).select("a", "b"))
        star = spokes if star is None else star
        large = _labelled(_labelled(large, label, "node", "_l"), label, "c", "_k").filter("_l != _k").select("bucket", "node", "links")
    known = tested.select("a", "b", "share", "na", "nb", linked(percent).alias("is_link"))
    star = star.select("c", "node", *_ordered("c", "node")).join(known, ["a", "b"])
    star = star.select("c", "node", F.when(F.col("a") == F.col("node"), F.col("na")).otherwise(F.col("nb")).alias("n"),
                       F.when(F.col("a") == F.col("c"), F.col("na")).otherwise(F.col("nb")).alias("nc"), "share", "is_link")
    star = cut(_labelled(star, label, "node", "label"))
    if star.filter(~F.col("is_link")).limit(1).count():
        pairs = _bridges(star, sets, percent).join(tested.select("a", "b"), ["a", "b"], "left_anti")
        tested = tested.union(cut(shares(pairs, sets)))
    edges = cut(tested.filter(linked(percent)).select("a", "b"))
    label = components(edges) if edges.limit(1).count() else None

    first = seen.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("_first"))
    if label is not None:
        least = label.join(first, "node").groupBy("label").agg(F.min("_first").alias("_least"))
        first = first.join(label.join(least, "label").select("node", "_least"), "node", "left").select("node", F.coalesce("_least", "_first").alias("_first"))
    out = seen.select("doc_id", "n_shingles", "node").join(first, "node", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("_first")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "node")
