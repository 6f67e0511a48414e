"""Whole-sentence blocks (D-02, modes 'complete' and 'complete_doc') as an
exact parallel scan.

The greedy fill is a finite-state machine: its state is the current block
fill, 0..block_size, plus one 'over-full' state (a single sentence longer
than the block), so there are block_size + 2 states.  Rows are cut into
chunks of consecutive row ids (two-phase X-01); each chunk computes, in one
vectorised numpy pass, its transition table for *every* entry state: exit
state and number of closed blocks.  Tables compose associatively, so chunk
entry states are found by a tree of prefixes: ``fan`` chunk functions compose
to one function, ``fan`` of those to one of the next level and so on up; entry
states then go down the same levels, and each chunk replays its rows from its
exact entry state.  No group grows with the corpus, at any level.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ids import with_row_id
from tessera.session import cut_lineage


def _step(state: np.ndarray, flushes: np.ndarray, s: int, block: int, sep: int | None):
    """Advance every state of ``state`` by one sentence of size ``s``."""
    over = block + 1
    if sep is not None and s == sep:          # document end: close the block, skip the separator
        return np.zeros_like(state), flushes + 1
    add = (state == 0) | ((state != over) & (state + s <= block))
    new = np.where(add, state + s, s)
    new = np.where(new > block, over, new)
    return new, flushes + (~add)


def chunk_table(sizes: np.ndarray, block: int, sep: int | None):
    """Exit state and closed-block count for each of the block + 2 entry states."""
    state = np.arange(block + 2)
    flushes = np.zeros(block + 2, dtype=np.int64)
    for s in sizes:
        state, flushes = _step(state, flushes, int(s), block, sep)
    return state, flushes


def replay(sizes: np.ndarray, start: int, block: int, sep: int | None):
    """Blocks closed before each row, for one entry state."""
    state = np.array([start])
    flushes = np.zeros(1, dtype=np.int64)
    before = np.empty(len(sizes), dtype=np.int64)
    for i, s in enumerate(sizes):
        state, f2 = _step(state, flushes, int(s), block, sep)
        # a row that closes the previous block belongs to the next one
        before[i] = f2[0] if not (sep is not None and s == sep) else flushes[0]
        flushes = f2
    return before, int(state[0]), int(flushes[0])


CHILD = "_i long, _p long, total boolean, out array<long>, cnt array<long>"


def _compose(states: int, fan: int):
    """Of ``fan`` consecutive functions: for each the function from the group's
    start to its own, and one row with the whole group's."""
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        parent = int(pdf["_i"].iloc[0]) // fan
        out, cnt, rows = np.arange(states), np.zeros(states, dtype=np.int64), []
        for i, o, c in zip(pdf["_i"], pdf["out"], pdf["cnt"]):
            rows.append((int(i), parent, False, out, cnt))
            cnt = cnt + np.asarray(c)[out]
            out = np.asarray(o)[out]
        rows.append((parent, parent, True, out, cnt))
        return pd.DataFrame(rows, columns=["_i", "_p", "total", "out", "cnt"])
    return fn


def chunk_entries(tab: DataFrame, n: int, states: int, fan: int) -> DataFrame:
    """``(_i, state, closed)``: entry state and blocks closed before each of
    ``n`` functions ``(_i, out, cnt)`` of ``states`` states, numbered 0 .. n - 1;
    the first is entered in state 0."""
    levels = []
    while True:
        level = cut_lineage(tab.groupBy(F.floor(F.col("_i") / fan)).applyInPandas(_compose(states, fan), CHILD))
        levels.append(level.filter(~F.col("total")))
        tab, n = level.filter("total").select("_i", "out", "cnt"), -(-n // fan)
        if n <= 1:
            break
    zero = F.lit(0).cast("long")
    entry = tab.select("_i", zero.alias("state"), zero.alias("closed"))
    for level in reversed(levels):
        at = (F.col("state") + 1).cast("int")
        entry = (level.join(entry.withColumnRenamed("_i", "_p"), "_p")
                 .select("_i", F.element_at("out", at).alias("state"), (F.col("closed") + F.element_at("cnt", at)).alias("closed")))
    return entry


def sentence_blocks(df: DataFrame, size: str, order, fine, coarse, block: int, sep: int | None = None,
                    chunk_rows: int = 4096, group_chunks: int = 1024) -> DataFrame:
    """D-02: ``block`` id per row (rows in ``order``); ``sep`` marks document
    separator rows ('complete_doc'), which close a block and get NULL."""
    d = cut_lineage(with_row_id(df, order, fine, coarse, out="_rid").withColumn("_i", F.floor(F.col("_rid") / chunk_rows)))
    chunks = -(-d.count() // chunk_rows)

    def tables(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rid")
        out, cnt = chunk_table(pdf[size].to_numpy(), block, sep)
        return pd.DataFrame({"_i": [int(pdf["_i"].iloc[0])], "out": [out.tolist()], "cnt": [cnt.tolist()]})

    tab = d.select("_i", "_rid", size).groupBy("_i").applyInPandas(tables, "_i long, out array<long>, cnt array<long>")
    entry = chunk_entries(tab, chunks, block + 2, group_chunks)
    names = df.columns
    back = d.schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rid")
        before, _, _ = replay(pdf[size].to_numpy(), int(pdf["state"].iloc[0]), block, sep)
        blk = pd.Series(before + int(pdf["closed"].iloc[0]), index=pdf.index, dtype="Int64")
        if sep is not None:
            blk[pdf[size] == sep] = pd.NA
        return pdf[names].assign(block=blk)

    out = ", ".join(f"`{c}` {back[c].dataType.simpleString()}" for c in names) + ", block bigint"
    return d.join(entry, "_i").groupBy("_i").applyInPandas(run, out)
