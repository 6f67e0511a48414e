"""Greedy size batches (W-03), fixed token blocks (D-01, D-04), stream
reshape (D-03) and batch collation (E-01, E-04..E-06).

W-03 plan (exact): rows are numbered in size order and cut into chunks of
consecutive numbers.  What a chunk needs to know of the rows before it is how many
of them are in the open batch (their sizes are the last rows before the chunk, which
it is given), so a chunk is a function of that count: count at its end and batches
closed.  All entry counts are followed together: after a batch is closed, only the
closing row and the number of rows left over matter, so paths that meet are
followed once.  Chunk functions compose in a tree (as for D-02), and each chunk then
numbers its rows' batches from its true entry; one batch of rows behind the chunk
tells where its last batch ends.  Only (number, size) rows are grouped, nothing is
collected.  ``greedy_segments`` is the same rule over runs of equal sizes, for
summaries that fit one machine.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ids import running_total, with_row_id
from tessera.operators.sentence_blocks import chunk_entries
from tessera.operators.shaping import hash_uniform
from tessera.session import cut_lineage

INF = 1 << 62


def greedy_segments(runs, max_tokens=None, max_sentences=None, multiple=1):
    """Greedy batch boundaries over ``runs`` = [(key, n_tokens, count)] in
    order.  Returns (segments, n_batches); a segment is
    (key, start_rank, end_rank, first_batch, step): rows with rank r in
    [start, end) belong to batch first_batch + (r - start) // step."""
    max_tok = INF if max_tokens is None else max_tokens
    max_sent = INF if max_sentences is None else max_sentences
    lens: deque = deque()          # [n_tokens, count] of rows in the open batch
    b = 0                          # rows in the open batch
    s_len = 0                      # running max length of the open batch (+ current row)
    batch_start = 0                # rank of the first row of the open batch
    rank = 0                       # rank of the next row
    boundaries: list[tuple] = []   # (key, first_start, step, count): batch starts

    def pop_front(k):
        while k > 0:
            if lens[0][1] <= k:
                k -= lens[0][1]
                lens.popleft()
            else:
                lens[0][1] -= k
                k = 0

    for key, n, c in runs:
        if n > max_tok:
            raise ValueError(f"a row of size {n} exceeds max_tokens {max_tok}")
        i = 0
        while i < c:
            s_new = max(s_len, n)
            lim = min(max_sent, max_tok // s_new)
            if b == 0 or b < lim:
                k = min(c - i, max(lim - b, 1))
                b += k
                if lens and lens[-1][0] == n:
                    lens[-1][1] += k
                else:
                    lens.append([n, k])
                s_len, i, rank = s_new, i + k, rank + k
                continue
            # the next row closes the batch: flush a multiple of ``multiple``
            mod = max(multiple * (b // multiple), b % multiple)
            boundaries.append((key, batch_start, mod, 1))
            batch_start += mod
            pop_front(mod)
            b -= mod
            s_len = max([x[0] for x in lens] + [n])
            b += 1
            if lens and lens[-1][0] == n:
                lens[-1][1] += 1
            else:
                lens.append([n, 1])
            i, rank = i + 1, rank + 1
            # periodic part: every row of the open batch is from this run
            steady_lim = min(max_sent, max_tok // n)
            steady_mod = max(multiple * (steady_lim // multiple), steady_lim % multiple)
            if (len(lens) == 1 and lens[0][0] == n and s_len == n
                    and b == steady_lim - steady_mod + 1 and c - i >= steady_mod):
                cycles = (c - i) // steady_mod
                boundaries.append((key, batch_start, steady_mod, cycles))
                batch_start += cycles * steady_mod
                i += cycles * steady_mod
                rank += cycles * steady_mod
    # segments: a boundary entry (first_start, step, count) covers ranks
    # [first_start, first_start + step * count); the open batch is the tail.
    segs = []
    batch_id = 0
    for key, start, step, count in boundaries:
        segs.append((start, start + step * count, batch_id, step))
        batch_id += count
    if b > 0:
        segs.append((batch_start, rank, batch_id, max(rank - batch_start, 1)))
        batch_id += 1
    return segs, batch_id


class Greedy:
    """The greedy rule over ``sizes`` of consecutive rows (tokens a row costs)."""

    def __init__(self, sizes: np.ndarray, max_tokens: int, max_sentences: int, multiple: int, most: int):
        self.sizes, self.max_tokens, self.max_sentences, self.multiple = sizes, max_tokens, max_sentences, multiple
        self.step = most + 2            # no open batch grows beyond ``most`` rows

    def closer(self, start: int, row: int) -> int:
        """The first row from ``row`` on that does not fit a batch open since
        ``start``; the number of rows if there is none."""
        lo = row
        top = int(self.sizes[start:row].max(initial=0))
        while lo < len(self.sizes):
            part = np.maximum(np.maximum.accumulate(self.sizes[lo:lo + self.step]), top)
            n = np.arange(lo - start + 1, lo - start + 1 + len(part))
            over = (n > self.max_sentences) | (part * n > self.max_tokens)
            if start == row:
                over[0] &= lo > row                    # an empty batch takes any row
            if over.any():
                return lo + int(over.argmax())
            lo, top = lo + len(part), int(part[-1])
        return len(self.sizes)

    def cut(self, rows: int) -> int:
        """How many of an open batch's rows a closed batch takes."""
        return max(self.multiple * (rows // self.multiple), rows % self.multiple)

    def table(self, first: int, end: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """For each number of open rows before row ``first``: open rows before
        ``end``, and batches closed by rows in between."""
        known: dict[tuple[int, int], tuple[int, int]] = {}
        out, closed = np.zeros(most + 1, np.int64), np.zeros(most + 1, np.int64)
        for b in range(most + 1):
            start, row, way = max(0, first - b), first, []
            while True:
                j = self.closer(start, row)
                if j >= end:
                    got = (end - start, 0)
                    break
                start += self.cut(j - start)
                row = j + 1
                if (j, start) in known:
                    got = known[j, start]
                    way.append((j, start))
                    break
                way.append((j, start))
            open_, later = got
            for i, at in enumerate(reversed(way)):
                if at in known:
                    later = known[at][1]
                else:
                    known[at] = (open_, later)
                later += 1
            out[b], closed[b] = min(open_, most), later
        return out, closed

    def batches(self, first: int, end: int, open_rows: int) -> np.ndarray:
        """Batches closed before each row of ``[first, end)``, counted from the
        batch that is open at ``first``.  A batch that is open at the end of all rows is whole."""
        start, row, k = first - open_rows, first, 0
        out = np.zeros(end - first, np.int64)
        while start < end:
            j = self.closer(start, row)
            stop = len(self.sizes) if j >= len(self.sizes) else start + self.cut(j - start)
            out[max(0, start - first):max(0, stop - first)] = k
            start, row, k = stop, j + 1, k + 1
        return out


def greedy_batches(df: DataFrame, key: str, sizes: list[str], max_tokens=None, max_sentences=None,
                   multiple: int = 1, chunk_rows: int = 8192) -> DataFrame:
    """W-03: rows ordered by ``sizes`` then ``key``; a row costs
    max(sizes) tokens; returns df + ``rank`` + ``batch``.  A row of more than
    ``max_tokens`` fails; an empty table gives an empty result."""
    ntok = F.greatest(*[F.col(s) for s in sizes]) if len(sizes) > 1 else F.col(sizes[0])
    order = [F.col(c) for c in sizes] + [F.col(key)]
    ranked = with_row_id(df.withColumn("_n", ntok.cast("long")), order, out="rank")
    seen = ranked.agg(F.count(F.lit(1)).alias("rows"), F.min(F.when(F.col("_n") > 0, F.col("_n"))).alias("low"), F.max("_n").alias("high"),
                      F.count(F.when(F.col("_n") <= 0, 1)).alias("zeros")).first()
    if max_tokens is not None and seen.rows and seen.high > max_tokens:
        raise ValueError(f"a row of size {seen.high} exceeds max_tokens {max_tokens}")
    by_tokens = seen.rows if max_tokens is None else max_tokens // max(1, seen.low or 1) + seen.zeros
    most = max(1, min(seen.rows, by_tokens, seen.rows if max_sentences is None else max_sentences, seen.rows) + multiple)
    rule = (max_tokens or INF, max_sentences or INF, multiple, most)
    size = max(chunk_rows, most + 2)
    chunks = -(-seen.rows // size)
    # a chunk with the rows before it that can be in the open batch, and those behind it that can end its last one
    r, c = F.col("rank") % size, F.floor(F.col("rank") / size)
    mine = F.array_compact(F.array(c, F.when((r >= size - most) & (c + 1 < chunks), c + 1), F.when((r <= most) & (c > 0), c - 1)))
    rows = cut_lineage(ranked.select("rank", F.col("_n").alias("n"), F.explode(mine).alias("_i")))

    def split(pdf: pd.DataFrame) -> tuple[int, int, int, Greedy]:
        pdf = pdf.sort_values("rank")
        i, at = int(pdf["_i"].iloc[0]), pdf["rank"].to_numpy()
        first, end = np.searchsorted(at, [i * size, (i + 1) * size]).tolist()
        return i, first, end, Greedy(pdf["n"].to_numpy(), *rule)

    def tables(pdf: pd.DataFrame) -> pd.DataFrame:
        i, first, end, g = split(pdf)
        out, cnt = g.table(first, end, most)
        return pd.DataFrame({"_i": [i], "out": [out.tolist()], "cnt": [cnt.tolist()]})

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        i, first, end, g = split(pdf)
        batch = g.batches(first, end, int(pdf["state"].iloc[0])) + int(pdf["closed"].iloc[0])
        return pd.DataFrame({"rank": np.arange(i * size, i * size + end - first), "batch": batch})

    if chunks:
        if chunks > 1:
            tab = rows.groupBy("_i").applyInPandas(tables, "_i long, out array<long>, cnt array<long>")
            entry = chunk_entries(tab, chunks, most + 1, 1024)
        else:
            entry = df.sparkSession.range(1).select(F.col("id").alias("_i"), F.lit(0).alias("state"), F.lit(0).alias("closed"))
        got = rows.join(entry, "_i").groupBy("_i").applyInPandas(number, "rank long, batch long")
    else:
        got = ranked.select("rank", F.lit(0).cast("long").alias("batch"))
    return ranked.join(got, "rank").select(*df.columns, "rank", "batch")


# ------------------------------------------------------------------ D-01
def _stream_parts(block_size: int):
    """``(block, _start, _p)`` of rows ``(_start, tokens)``: the tokens of rows that
    continue each other, cut at the borders of blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, lists = batch.column(0).to_numpy(), batch.column(1)
            size = lists.value_lengths().to_numpy()
            flat = lists.flatten()
            at = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
            new = np.flatnonzero(np.concatenate([[True], start[1:] != start[:-1] + size[:-1]])) if len(start) else []
            for a, b in zip(new, [*new[1:], len(start)]):
                first, n = int(start[a]), int(at[b] - at[a])
                cuts = np.arange(first // block_size * block_size, first + n + block_size, block_size).clip(first, first + n)
                cuts = np.unique(cuts)
                part = pa.ListArray.from_arrays(pa.array((cuts - first).astype(np.int32)), flat.slice(int(at[a]), n))
                yield pa.RecordBatch.from_arrays([pa.array(cuts[:-1] // block_size), pa.array(cuts[:-1]), part], names=["block", "_start", "_p"])
    return run


def token_blocks(df: DataFrame, tokens: str, block_size: int, order, fine=(), coarse=()) -> DataFrame:
    """D-01 ('none' mode): the corpus as one token stream cut every
    ``block_size`` tokens (last block short).  Sentence start offsets come
    from the two-phase prefix sum; rows that follow each other in a sorted partition
    are one stretch of the stream, which is cut where it lies.  Only the slices of
    blocks that span two stretches are shuffled and joined in order."""
    d = df.withColumn("_n", F.size(tokens).cast("long"))
    d = running_total(d.select(F.col(tokens).alias("_t"), "_n", *[(F.col(c) if isinstance(c, str) else c).alias(f"_k{i}") for i, c in enumerate(order)]),
                      [f"_k{i}" for i in range(len(order))], value="_n", out="_start", inclusive=False)
    d = d.filter(F.col("_n") > 0).select("_start", "_t")
    kind = d.schema["_t"].dataType.simpleString()
    parts = d.mapInArrow(_stream_parts(block_size), f"block bigint, _start bigint, _p {kind}")
    whole = F.size("_p") == block_size
    rest = (parts.filter(~whole).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("_start", "_p"))).alias("_s"))
            .select("block", F.flatten(F.transform("_s", lambda s: s["_p"])).alias("tokens")))
    return parts.filter(whole).select("block", F.col("_p").alias("tokens")).union(rest)


# ------------------------------------------------------------------ E-*
def pad_to_batch(df: DataFrame, batch: str, ids: str, pad: int, left: bool = False,
                 cap: int | None = None) -> DataFrame:
    """E-04: pad every row of a batch to the batch's longest row; rows are cut
    to ``cap`` ids only where the caller asks for it."""
    w = Window.partitionBy(batch)
    d = df.withColumn("_a", F.col(ids) if cap is None else F.slice(ids, 1, cap))
    d = d.withColumn("_m", F.max(F.size("_a")).over(w))
    fill = F.array_repeat(F.lit(pad), F.col("_m") - F.size("_a"))
    return d.withColumn("padded", F.concat(fill, "_a") if left else F.concat("_a", fill)).drop("_a", "_m")


def collate_pairs(df: DataFrame, batch: str, key: str, src: str, tgt: str) -> DataFrame:
    """E-01: one row per batch: ids in descending source length (ties by
    id), source lengths, target token count, sentence count."""
    return (df.groupBy(batch)
            .agg(F.sort_array(F.collect_list(F.struct((-F.size(src)).alias("neg"), F.col(key).alias("id"),
                                                      F.size(src).alias("sl"))), True).alias("_s"),
                 F.sum(F.size(tgt)).alias("ntokens"), F.count(F.lit(1)).alias("nsentences"))
            .select(batch, F.transform("_s", lambda s: s["id"]).alias("ids"),
                    F.transform("_s", lambda s: s["sl"]).alias("src_lengths"), "ntokens", "nsentences"))


def collate_arrays(df: DataFrame, batch: str, key: str, src: str, tgt: str, pad: int, eos: int,
                   left_pad_source: bool = True, left_pad_target: bool = False) -> DataFrame:
    """E-01, arrays: one row per sentence, ``(batch, row, key, src_len, source,
    tgt_len, target, previous)``: sides padded to the batch's longest, the
    shifted target (its end symbol moved to the front), and the row's place in
    descending source length (ties by id).  A null target has null arrays."""
    w = Window.partitionBy(batch)

    def padded(ids, most: str, left: bool):
        fill = F.array_repeat(F.lit(pad), F.col(most) - F.size(ids))
        return F.concat(fill, ids) if left else F.concat(ids, fill)

    d = df.select(batch, key, F.col(src).alias("_s"), F.col(tgt).alias("_t"))
    d = d.withColumn("_ms", F.max(F.size("_s")).over(w)).withColumn("_mt", F.max(F.size("_t")).over(w))
    shifted = F.when(F.size("_t") > 0, F.concat(F.array(F.lit(eos)), F.slice("_t", 1, F.size("_t") - 1))).otherwise(F.col("_t"))
    d = d.withColumn("_p", shifted).withColumn("row", F.row_number().over(w.orderBy(F.size("_s").desc(), key)) - 1)
    return d.select(batch, "row", key, F.size("_s").alias("src_len"), padded(F.col("_s"), "_ms", left_pad_source).alias("source"),
                    F.size("_t").alias("tgt_len"), padded(F.col("_t"), "_mt", left_pad_target).alias("target"),
                    padded(F.col("_p"), "_mt", left_pad_target).alias("previous"))


def round_batches(df: DataFrame, batch: str, key: str, multiple: int = 8, seed: int | None = None) -> DataFrame:
    """E-06: drop the surplus rows of each batch beyond a multiple of 8 (keeps
    batches smaller than the multiple whole): the highest ids, or with a ``seed``
    rows chosen by hash."""
    w = Window.partitionBy(batch)
    order = [key] if seed is None else [hash_uniform(seed, key), key]
    d = df.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn(
        "_r", F.row_number().over(Window.partitionBy(batch).orderBy(*order)))
    keep = F.when(F.col("_n") < multiple, F.col("_n")).otherwise(F.floor(F.col("_n") / multiple) * multiple)
    return d.filter(F.col("_r") <= keep).drop("_n", "_r")


def pad_lengths(df: DataFrame, batch: str, ids: str, pad: int, multiple: int = 8) -> DataFrame:
    """E-06, second half: ``padded`` ids of every row up to the batch's longest,
    rounded up to a multiple; batches of fewer rows than that are only padded to
    their longest."""
    w = Window.partitionBy(batch)
    d = df.withColumn("_m", F.max(F.size(ids)).over(w)).withColumn("_n", F.count(F.lit(1)).over(w))
    most = F.when(F.col("_n") < multiple, F.col("_m")).otherwise(F.ceil(F.col("_m") / multiple) * multiple).cast("int")
    return d.withColumn("padded", F.concat(F.col(ids), F.array_repeat(F.lit(pad), most - F.size(ids)))).drop("_m", "_n")


# ------------------------------------------------------------------ D-03
def stream_columns(df: DataFrame, tokens: str, bs: int, bptt: int, eos: str, order, fine, coarse) -> DataFrame:
    """D-03: the corpus token stream as a (n_batches * bptt + 1) x bs grid:
    left-padded with the end symbol to n_batches * bptt * bs cells, filled
    column by column, with a leading row of end symbols.  Every token's cell
    is arithmetic on its global offset (two-phase prefix sum); the padding
    cells are generated from the (scalar) token count.  Returns (row, col, tok)."""
    spark = df.sparkSession
    n = F.size(tokens).cast("long")
    d = running_total(df.withColumn("_n", n), order, fine, coarse, value="_n", out="_start", inclusive=False)
    ex = d.select(F.posexplode_outer(tokens).alias("pos", "tok"), "_start").filter(F.col("pos").isNotNull())
    total = df.agg(F.sum(n)).first()[0] or 0  # scalar
    n_batches = -(-total // (bs * bptt))
    length = n_batches * bptt
    pad = n_batches * bptt * bs - total
    p = F.col("_start") + F.col("pos") + pad
    cells = ex.select((F.floor(p % length) + 1).cast("long").alias("row"), F.floor(p / length).cast("long").alias("col"), "tok")
    fill = spark.range(pad).select((F.col("id") % length + 1).alias("row"), F.floor(F.col("id") / length).alias("col"),
                                   F.lit(eos).alias("tok"))
    head = spark.range(bs).select(F.lit(0).cast("long").alias("row"), F.col("id").alias("col"), F.lit(eos).alias("tok"))
    return cells.unionByName(fill).unionByName(head)
