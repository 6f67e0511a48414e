"""Substring deduplication over prefix-partitioned suffix trees (operator 6).

A window is ``WINDOW`` consecutive words; it is removed where the same words
start earlier.  The tree is a suffix tree over word sequences, cut at depth
``WINDOW``: a suffix is the path (8, 12, 16, 20 words), each level a hash of the
words so far, packed into two longs that sort in tree order.

1. Identical texts are one leaf: all but the first hold nothing new.
2. Only suffixes that can be in a deep node are built.  Every window has an
   anchor, its smallest 8-gram; a window can repeat only if its anchor does.
3. Suffixes are split by range of (path, document, position).  Range borders are
   prefixes of whatever length makes the groups equally large: a short one where
   suffixes are few, a full path plus a place in the corpus inside a hot node.
   Spark's sort spills, so a group need not fit in memory.
4. One walk over a sorted group is the subtree's traversal: neighbours that agree
   down to depth ``WINDOW`` are in one deep internal node, whose first suffix
   stays.  A node cut by a range border is joined by its border rows.

Defined results: a null or empty text has no words; a text shorter than a window
keeps all; a null ``doc_id`` counts as smaller than all others; repeated rows
(same id, same words) do not remove each other, and rows that share an id but
differ in text share the positions removed; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, U64, Words, cut, gram_hash, slices, within_row

WINDOW, ANCHOR = 20, 8
LEAST_ID = -(1 << 63)


def window_anchors(h: np.ndarray) -> np.ndarray:
    """Position of each window's anchor (the last of equal ones)."""
    n = len(h) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    g = gram_hash(h, ANCHOR)
    best, at = g[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, WINDOW - ANCHOR + 1):
        better = g[j:j + n] <= best
        best[better] = g[j:j + n][better]
        at[better] = j
    return np.arange(n) + at


def paths(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Path of each window: 8, 12 and 16 words in one long, 20 in another."""
    n = len(h) - WINDOW + 1
    hi = gram_hash(h, 8)[:n] & U64(0xFFFFFFFF00000000)
    hi |= gram_hash(h, 12)[:n] >> U64(48) << U64(16)
    hi |= gram_hash(h, 16)[:n] >> U64(48)
    return hi.view(np.int64), gram_hash(h, WINDOW).view(np.int64)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, offs in slices(batch.column(1)):
            w = Words(buf, offs, SPACE)
            h = w.hashes()
            marks = [hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest() for a, b in zip(w.first[:-1], w.first[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(w.count.astype(np.int64)), pa.array(marks, pa.binary())],
                                             names=["_id", "n_words", "mark"])


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, offs in slices(batch.column(1)):
            w = Words(buf, offs, SPACE)
            h = w.hashes()
            pos = np.unique(window_anchors(h)[within_row(w, WINDOW)])
            row = w.row[pos]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo).take(pa.array(row)), pa.array((pos - w.first[row]).astype(np.int32)),
                 pa.array(gram_hash(h, ANCHOR)[pos].view(np.int64) if len(pos) else np.zeros(0, np.int64))],
                names=["_id", "pos", "gram"])


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes whose window's anchor is one of the document's repeated ones."""
    for batch in batches:
        repeated = batch.column(2)
        for lo, hi, buf, offs in slices(batch.column(1)):
            w = Words(buf, offs, SPACE)
            h = w.hashes()
            if len(h) < WINDOW:
                continue
            mine = repeated.slice(lo, hi - lo)
            at = mine.flatten().to_numpy() + np.repeat(w.first[:-1], np.diff(mine.offsets.to_numpy()))
            marked = np.zeros(len(h), bool)
            marked[at[at < len(h)]] = True
            pos = np.flatnonzero(marked[window_anchors(h)] & within_row(w, WINDOW))
            top, deep = paths(h)
            row = w.row[pos]
            yield pa.RecordBatch.from_arrays(
                [pa.array(top[pos]), pa.array(deep[pos]), batch.column(0).slice(lo, hi - lo).take(pa.array(row)),
                 pa.array((pos - w.first[row]).astype(np.int32))], names=["top", "deep", "_id", "pos"])


INSIDE, HEAD, TAIL = 0, 1, 2


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Traverse one sorted group: every suffix of a deep node after the node's
    first; besides, the group's first suffix and its last path."""
    part = TaskContext.get().partitionId()
    names = ["kind", "_id", "pos", "top", "deep", "part"]

    def border(kind: int, row: tuple) -> pa.RecordBatch:
        top, deep, doc, pos = row
        return pa.RecordBatch.from_arrays([pa.array([kind], pa.int8()), pa.array([doc], pa.int64()), pa.array([pos], pa.int32()),
                                           pa.array([top], pa.int64()), pa.array([deep], pa.int64()), pa.array([part], pa.int32())], names=names)

    first = None                       # of the node that the last batch ended in
    for batch in batches:
        top, deep, doc, pos = (batch.column(i).to_numpy() for i in range(4))
        if not len(top):
            continue
        if first is None:
            first = (top[0], deep[0], doc[0], pos[0])
            yield border(HEAD, first)
        opens = np.concatenate([[(top[0], deep[0]) != first[:2]], (top[1:] != top[:-1]) | (deep[1:] != deep[:-1])])
        own = np.maximum.accumulate(np.where(opens, np.arange(len(top)), -1))
        lead_doc = np.where(own >= 0, doc[own], first[2])
        lead_pos = np.where(own >= 0, pos[own], first[3])
        if own[-1] >= 0:
            i = own[-1]
            first = (top[i], deep[i], doc[i], pos[i])
        out = np.flatnonzero((doc != lead_doc) | (pos != lead_pos))
        n = len(out)
        nothing = pa.nulls(n, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, INSIDE, np.int8)), pa.array(doc[out]), pa.array(pos[out]), nothing, nothing,
                                          pa.array(np.full(n, part, np.int32))], names=names)
    if first is not None:
        yield border(TAIL, first)


def repeated_windows(docs: DataFrame) -> DataFrame:
    """``(_id, pos)`` of windows whose words start earlier; ``docs``: ``(_id, text, repeated)``,
    ``repeated`` the positions of the document's anchors that occur elsewhere, too."""
    suffixes = cut(docs.select("_id", "text", "repeated").mapInArrow(_suffixes, "top bigint, deep bigint, _id bigint, pos int"))
    order = ["top", "deep", "_id", "pos"]
    groups = suffixes.repartitionByRange(*order).sortWithinPartitions(*order).select(*order)
    nodes = cut(groups.mapInArrow(_walk, "kind tinyint, _id bigint, pos int, top bigint, deep bigint, part int"))
    tails = nodes.filter(F.col("kind") == TAIL).select("top", "deep", F.col("part").alias("_before"))
    heads = nodes.filter(F.col("kind") == HEAD)
    cut_nodes = heads.join(tails, (heads["top"] == tails["top"]) & (heads["deep"] == tails["deep"]) & (F.col("_before") < F.col("part")), "left_semi")
    return nodes.filter(F.col("kind") == INSIDE).select("_id", "pos").union(cut_nodes.select("_id", "pos"))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, len(batch), 256):
            doc, text, starts, marks = (c.slice(lo, 256) for c in batch.columns)
            n_words, n_removed, kept = [], [], []
            for t, s, m in zip(text, starts, marks):
                words = t.as_buffer().to_pybytes().split() if t.is_valid else []
                n, gone = len(words), 0
                if n >= WINDOW and m.is_valid and _mark(words) in m.as_py():
                    words, gone = [], n
                elif s.is_valid and len(s.values):
                    step = np.zeros(n + WINDOW + 1, np.int32)
                    p = s.values.to_numpy()
                    p = p[p + WINDOW <= n]
                    np.add.at(step, p, 1)
                    np.add.at(step, p + WINDOW, -1)
                    covered = np.cumsum(step)[:n] > 0
                    gone = int(covered.sum())
                    words = [words[i] for i in np.flatnonzero(~covered).tolist()]
                n_words.append(n), n_removed.append(gone), kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([doc, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                                              pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])


def _mark(words: list[bytes]) -> bytes:
    buf = np.frombuffer(b" ".join(words), np.uint8)
    h = Words(buf, np.array([0, len(buf)]), SPACE).hashes()
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_text)`` of every row: each word in a
    window that starts earlier in the corpus is removed."""
    d = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("_id"))
    marks = cut(d.select("_id", "text").mapInArrow(_digests, "_id bigint, n_words bigint, mark binary"))
    first = marks.filter(F.col("n_words") >= WINDOW).groupBy("mark").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    copies = cut(marks.join(first.drop("_n"), "mark").filter("_id > _first").select("_id", "mark"))
    anchors = d.select("_id", "text").mapInArrow(_anchors, "_id bigint, pos int, gram bigint").join(copies.select("_id").distinct(), "_id", "left_anti")
    common = anchors.groupBy("gram").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("gram")
    repeated = cut(anchors.join(common, "gram").groupBy("_id").agg(F.collect_list("pos").alias("repeated")))
    windows = repeated_windows(d.select("_id", "text").join(repeated, "_id"))
    gone = windows.groupBy("_id").agg(F.collect_list("pos").alias("starts"))
    whole = copies.groupBy("_id").agg(F.collect_set("mark").alias("marks"))
    gone = cut(gone.join(whole, "_id", "full"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return cut(d.join(gone, "_id", "left").select("doc_id", "text", "starts", "marks")
               .mapInArrow(_remove, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_text string"))


def report(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
