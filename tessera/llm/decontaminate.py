"""Benchmark decontamination by winnowing (operator 3).

A text's fingerprints are the smallest k-gram hash of every ``window - k + 1``
consecutive k-grams (the rightmost of equal ones), so two texts that share
``window`` words share a fingerprint at the same place of the shared span.
Fingerprints of documents are joined with the distinct ones of benchmark items;
each hit is extended to both sides to all windows of the document's own words
that hold it, and those that are windows of an item are occurrences.  Equal
windows of several items are one row, which carries their ids.

An item shorter than a window is one window of its own length; for each such
length that occurs, documents are winnowed for that length, too.

Defined results: a null or empty text has no words; a null ``item_id`` counts
as the empty string; repeated rows of either side are judged one by one, an
item id that occurs twice is one item; empty tables give no hits; other columns
are not read.  A document row meets the hits of all rows with its ``doc_id``
(null matches null), extension on its own words rejects those of other texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, NOT_ALNUM, U64, Words, gram_hash, mix64, slices, small
from tessera.session import cut_lineage

WINDOW = 10
GRAM = 5
BROADCAST_ROWS = 200_000     # fingerprints of items or hit documents


def shape(window: int) -> tuple[int, int]:
    """Gram size and number of grams to a fingerprint for windows of a length."""
    k = min(GRAM, window)
    return k, window - k + 1


def winnow(h: np.ndarray, row: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """``(position, fingerprint)`` of word hashes ``h`` that belong to rows ``row``."""
    k, span = shape(window)
    g = gram_hash(h, k) + mix64(np.array([window], U64))
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    best, at = g[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, span):
        better = g[j:j + n] <= best
        best[better] = g[j:j + n][better]
        at[better] = j
    whole = row[:n] == row[window - 1:]
    pos = np.unique((np.arange(n) + at)[whole])
    return pos, g[pos]


def _documents(windows: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in slices(batch.column(1)):
                w = Words(buf, offs, NOT_ALNUM, LOWER)
                h = w.hashes()
                ids = batch.column(0).slice(lo, hi - lo)
                for t in windows:
                    pos, fp = winnow(h, w.row, t)
                    row = w.row[pos]
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(row)), pa.array((pos - w.first[row]).astype(np.int32)), pa.array(fp.view(np.int64)), pa.array(np.full(len(pos), t, np.int32))],
                        names=["doc_id", "pos", "fp", "window"])
    return run


def covering(pos: np.ndarray, window: int, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(index of pos, start)`` of all windows within ``[first, last)`` that hold
    the gram at ``pos``: a hit extended to either side."""
    _, span = shape(window)
    start = pos[:, None] - np.arange(span)
    ok = (start >= first[:, None]) & (start + window <= last[:, None])
    which, _ = np.nonzero(ok)
    return which, start[ok]


def _windows(h: np.ndarray, window: int) -> np.ndarray:
    """Hashes of all windows of words, apart from those of other lengths."""
    return gram_hash(h, window) + mix64(np.array([window], U64))


def _items(window: int):
    """Windows of benchmark items, each with its fingerprints."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in slices(batch.column(1)):
                w = Words(buf, offs, NOT_ALNUM, LOWER)
                h = w.hashes()
                ids = batch.column(0).slice(lo, hi - lo)
                lengths = np.minimum(w.count, window)
                for t in np.unique(lengths[lengths > 0]).tolist():
                    pos, fp = winnow(h, w.row, t)
                    mine = lengths[w.row[pos]] == t
                    pos, fp = pos[mine], fp[mine]
                    row = w.row[pos]
                    which, start = covering(pos, t, w.first[row], w.first[row + 1])
                    win = _windows(h, t)[start]
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(row[which])), pa.array(np.full(len(win), t, np.int32)), pa.array(fp[which].view(np.int64)), pa.array(win.view(np.int64))],
                        names=["item", "window", "fp", "win"])
    return run


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of every document, and the windows around its hits."""
    for batch in batches:
        hits = batch.column(2)
        for lo, hi, buf, offs in slices(batch.column(1)):
            w = Words(buf, offs, NOT_ALNUM, LOWER)
            h = w.hashes()
            mine = hits.slice(lo, hi - lo)
            n = mine.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            row, flat = np.repeat(np.arange(hi - lo), n), mine.flatten()
            pos, kind = flat.field("pos").to_numpy().astype(np.int64) + w.first[row], flat.field("window").to_numpy()
            found = [np.zeros((4, 0), np.int64)]
            for t in np.unique(kind).tolist():
                here = kind == t
                which, start = covering(pos[here], t, w.first[row[here]], w.first[row[here] + 1])
                if len(which):
                    r = row[here][which]
                    found.append(np.unique(np.stack([r, start - w.first[r], np.full(len(r), t), _windows(h, t)[start].view(np.int64)]), axis=1))
            r, start, t, win = np.concatenate(found, axis=1)
            order = np.argsort(r, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(r, minlength=hi - lo))])
            value = pa.StructArray.from_arrays([pa.array(start[order]), pa.array(t[order].astype(np.int32)), pa.array(win[order])], names=["start", "window", "win"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array(w.count.astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), value)],
                names=["doc_id", "n_words", "wins"])


def spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of ranges, as ranges."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]]) if len(start) else np.zeros(0, bool)
    return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)] if len(start) else end


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, n_hit = [], []
        for got in batch.column(1):
            s = got.values.field("start").to_numpy()
            a, b = spans(s, s + got.values.field("window").to_numpy())
            n_hit.append(int((b - a).sum()))
            out.append([{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist())])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_hit, pa.int64()), batch.column(2), pa.array(out, kind)], names=["_row", "n_hit", "items", "spans"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, n_words, n_hit, items, spans)`` of every row of ``docs``:
    words inside an occurrence of an item window, the ids of the items that
    occur (as sorted strings), and the word ranges that are hit."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").mapInArrow(
        _items(window), "item string, window int, fp bigint, win bigint")
    # A window or a fingerprint that n items and n documents share is one row of the item side: n hits, not n * n.
    items = cut_lineage(items.groupBy("window", "fp", "win").agg(F.collect_set("item").alias("names")))
    prints = items.select("fp", "window").distinct()
    known = items.groupBy("window", "win").agg(F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"))
    windows = sorted(r[0] for r in items.select("window").distinct().collect())     # at most ``window`` of them
    few = small(items, BROADCAST_ROWS)
    d = docs.select("doc_id", "text")
    kind = d.schema["doc_id"].dataType.simpleString()
    mine = d.mapInArrow(_documents(windows), f"doc_id {kind}, pos int, fp bigint, window int")
    hits = cut_lineage(mine.join(F.broadcast(prints) if few else prints, ["fp", "window"]).groupBy(F.col("doc_id").alias("_id"))
                       .agg(F.collect_set(F.struct("pos", "window")).alias("hits")))
    hits = F.broadcast(hits) if small(hits, BROADCAST_ROWS // 10) else hits
    rows = cut_lineage(d.join(hits, d["doc_id"].eqNullSafe(hits["_id"]), "left").select("doc_id", "text", "hits")
                       .mapInArrow(_extend, f"doc_id {kind}, n_words bigint, wins array<struct<start:bigint,window:int,win:bigint>>")
                       .withColumn("_row", F.monotonically_increasing_id()))
    wins = rows.select("_row", F.explode("wins").alias("w")).select("_row", "w.start", "w.window", "w.win")
    found = (wins.join(F.broadcast(known) if few else known, ["window", "win"]).groupBy("_row")
             .agg(F.collect_list(F.struct("start", "window")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("items")))
    found = cut_lineage(found.mapInArrow(_covered, "_row bigint, n_hit bigint, items array<string>, spans array<struct<start:bigint,end:bigint>>"))
    found = F.broadcast(found) if small(found, BROADCAST_ROWS // 10) else found
    none = F.array()
    return rows.drop("wins").join(found, "_row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none.cast("array<string>")).alias("items"),
        F.coalesce("spans", none.cast("array<struct<start:bigint,end:bigint>>")).alias("spans"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    c = contamination(docs, benchmark)
    return c.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
