"""Exact nearest neighbours (J-14) and multi-head lookup (J-16).

Keys are partitioned by pivots: a bounded sample of keys (``PIVOTS`` at most, by
hash of the id), and every key belongs to the cell of its nearest pivot.  Keys are
not copied.  A query is first solved against its nearest cells that hold ``k`` keys
together; its k-th score there bounds its k-th distance, and only cells that the
triangle inequality leaves within that bound get a copy of the query:

    max(d(q, p) - largest, smallest - d(q, p)) <= bound

with the smallest and largest distance of the cell's keys to its pivot p.  All
three scores are distances in a suitable space: l2 as it is; dot products after
Shrivastava's lift, which gives a key the coordinate sqrt(M^2 - |k|^2) (M: the
largest key norm) and a query 0; cosine likewise after scaling.  Bounds carry a
slack for rounding, and scores themselves are computed in the given space, so the
rows are those of a full comparison.

Cells are many and small, so that the bounds are close; what is compared are slabs:
neighbouring cells with up to ``SLAB`` keys together.  A query is copied once for a
slab, however many of its cells it has to visit, and then meets all keys of the slab.
A slab is solved as cogroups of numpy matrix products over slices (at most ``SLICE``
scores at a time), of which only scores that reach the query's k-th best so far are
kept.  Slabs of more keys (many equal vectors) are cut by hash, and those that more
than ``QUERIES`` queries visit are solved in blocks of queries, for which alone their
keys are copied.  Where vectors are so spread that nothing can be excluded, that is
the full comparison in blocks: n / ``SLAB`` copies of a query, n / ``QUERIES`` of a key.
What reaches the driver are pivots and one row of figures per cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut_lineage

PIVOTS = 4096          # in all; with more heads than that a head is one cell
PER_BLOCK = 4          # pivots for ``cell_rows`` keys
SLACK = 1e-9           # of a bound, relative and absolute
SLAB = 16_384          # keys that are compared together
QUERIES = 8_192        # queries that meet them in one call
ROUTE = 512            # vectors whose distances to all pivots are held at a time
OUT_SCHEMA = "head int, qid long, kid long, score double"


def _scores(q: np.ndarray, k: np.ndarray, metric: str) -> np.ndarray:
    if metric == "dot":
        return q @ k.T
    if metric == "cosine":
        qn = q / (np.linalg.norm(q, axis=1, keepdims=True) + 1e-9)
        kn = k / (np.linalg.norm(k, axis=1, keepdims=True) + 1e-9)
        return qn @ kn.T
    if metric == "l2":  # larger is nearer: 2ab - a^2 - b^2
        return 2 * (q @ k.T) - (q * q).sum(1, keepdims=True) - (k * k).sum(1)[None, :]
    raise ValueError(metric)


SLICE = 4_000_000      # scores held at a time (32 MB)
PAIRS = 100_000        # pairs of vectors held at a time


def _pair_scores(q: np.ndarray, k: np.ndarray, metric: str) -> np.ndarray:
    """Scores of row by row pairs, by sums that do not depend on the place of a
    row (a matrix product's last bits do), so that equal vectors tie."""
    if metric == "cosine":
        q = q / (np.linalg.norm(q, axis=1, keepdims=True) + 1e-9)
        k = k / (np.linalg.norm(k, axis=1, keepdims=True) + 1e-9)
    s = (q * k).sum(axis=1)
    return 2 * s - (q * q).sum(axis=1) - (k * k).sum(axis=1) if metric == "l2" else s


def _enough(kv: np.ndarray, kid: np.ndarray, k: int) -> np.ndarray:
    """Places of the keys that can be in a top ``k``: of equal vectors the ``k`` with
    the smallest ids."""
    order = np.argsort(kid, kind="stable")
    rows = np.ascontiguousarray(kv[order]).view(np.dtype((np.void, kv.shape[1] * 8))).ravel()
    _, group = np.unique(rows, return_inverse=True)
    by = np.argsort(group, kind="stable")
    start = np.searchsorted(group[by], group[by])
    return np.sort(order[by[np.arange(len(by)) - start < k]])


def _merged(rows: np.ndarray, s: np.ndarray, kid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of candidates ``(row, score, key id)`` the top ``k`` of each row, by row."""
    order = np.lexsort((kid, -s, rows))
    rows, s, kid = rows[order], s[order], kid[order]
    start = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]][:len(rows)])
    place = np.arange(len(rows)) - np.repeat(start, np.diff(np.r_[start, len(rows)]))
    return rows[place < k], s[place < k], kid[place < k]


def _cell_topk(k: int, metric: str):
    """Top ``k`` of each query among the keys of a block; of those below its ``kth``
    score (from keys elsewhere, null: none) nothing is returned."""
    def fn(qpdf: pd.DataFrame, kpdf: pd.DataFrame) -> pd.DataFrame:
        if qpdf.empty or kpdf.empty:
            return pd.DataFrame({"head": [], "qid": [], "kid": [], "score": []})
        q = np.stack(qpdf["vec"].to_numpy()).astype(np.float64)
        kv = np.stack(kpdf["vec"].to_numpy()).astype(np.float64)
        ids, kid = qpdf["id"].to_numpy(), kpdf["id"].to_numpy()
        some = _enough(kv, kid, k)
        kv, kid = kv[some], kid[some]
        known = qpdf["kth"].astype("float64").to_numpy()
        known = np.where(np.isnan(known), -np.inf, known)
        kstep = min(len(kv), max(k, 2048))
        qstep = max(1, SLICE // kstep)
        out = []
        for a in range(0, len(q), qstep):
            qa, floor = q[a:a + qstep], known[a:a + qstep].copy()
            row, s, i = np.zeros(0, np.int64), np.zeros(0), kid[:0]
            for b in range(0, len(kv), kstep):
                ns = _scores(qa, kv[b:b + kstep], metric)
                least = floor
                if ns.shape[1] >= k and np.isneginf(floor).all():
                    least = np.partition(ns, ns.shape[1] - k, axis=1)[:, ns.shape[1] - k]
                at, c = np.nonzero(~(ns < (least - SLACK * (1 + np.abs(least)))[:, None]))
                for e in range(0, len(at), PAIRS):
                    x, y = at[e:e + PAIRS], c[e:e + PAIRS] + b
                    row, s, i = _merged(np.r_[row, x], np.r_[s, _pair_scores(qa[x], kv[y], metric)], np.r_[i, kid[y]], k)
                if len(at):
                    held = np.bincount(row, minlength=len(qa)) == k
                    last = np.flatnonzero(np.r_[row[1:] != row[:-1], True])
                    last = last[held[row[last]]]
                    floor[row[last]] = np.maximum(floor[row[last]], s[last])
            out.append(pd.DataFrame({"qid": ids[a:a + qstep][row], "kid": i, "score": s}))
        res = pd.concat(out, ignore_index=True)
        res.insert(0, "head", qpdf["head"].iloc[0])
        return res
    return fn


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _scaled(x: np.ndarray, metric: str) -> np.ndarray:
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9) if metric == "cosine" else x


def _lifted(x: np.ndarray, metric: str, top: float, key: bool) -> np.ndarray:
    """Vectors in the space in which a better score is a smaller distance."""
    if metric == "l2":
        return x
    x = _scaled(x, metric)
    last = np.sqrt(np.maximum(top * top - (x * x).sum(axis=1), 0)) if key else np.zeros(len(x))
    return np.hstack([x, last[:, None]])


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * x @ pivots.T, 0))


class Cells:
    """Pivots by head, and of each cell the number of keys and their smallest and
    largest distance to the pivot.  A cell has a number; a head without pivots is
    one cell without bounds.  ``slab`` has the number of each cell's slab."""

    def __init__(self, metric: str, top: float, pivots: dict[int, np.ndarray]):
        self.metric, self.top, self.pivots = metric, top, pivots
        self.base, at = {}, 0
        for head in sorted(pivots):
            self.base[head] = at
            at += len(pivots[head])
        self.figures: dict[tuple[int, int], tuple[int, float, float]] = {}
        self.slab: dict[tuple[int, int], int] = {}

    def lay_slabs(self, rows: int) -> None:
        """Put cells together to slabs of about ``rows`` keys: those nearest to the
        same of a few pivots (as many as slabs), by distance to it."""
        for (head, cell) in self.figures:
            if cell < 0:
                self.slab[head, cell] = -1
        for head, p in self.pivots.items():
            count = np.array([self.figures.get((head, self.base[head] + c), (0,))[0] for c in range(len(p))])
            seeds = p[:max(1, -(-int(count.sum()) // rows))]
            d = _distances(p, seeds)
            near = d.argmin(axis=1)
            number, held = self.base[head], 0
            for c in np.lexsort((d[np.arange(len(p)), near], near)).tolist():
                if held and held + count[c] > rows:
                    number, held = number + 1, 0
                held += int(count[c])
                self.slab[head, self.base[head] + c] = number

    def assign(self, head: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell, dist = np.full(len(x), -1, np.int64), np.zeros(len(x))
        for lo in range(0, len(x) if head in self.pivots else 0, ROUTE):
            d = _distances(_lifted(x[lo:lo + ROUTE], self.metric, self.top, True), self.pivots[head])
            near = d.argmin(axis=1)
            cell[lo:lo + ROUTE], dist[lo:lo + ROUTE] = near + self.base[head], d[np.arange(len(d)), near]
        return cell, dist

    def visits(self, head: int, x: np.ndarray, k: int, bound: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """``(query, slab)``: the slabs of the nearest cells that hold ``k`` keys
        together, or, with bounds of the k-th distance, all others with a cell that
        may hold a better key."""
        if head not in self.pivots:
            n = len(x) if bound is None and (head, -1) in self.figures else 0
            return np.arange(n), np.full(n, -1)
        base, many = self.base[head], len(self.pivots[head])
        got = [self.figures.get((head, base + c), (0, 0.0, 0.0)) for c in range(many)]
        count, low, high = (np.array(v, np.float64) for v in zip(*got))
        slab = np.array([self.slab[head, base + c] for c in range(many)]) - base
        d = _distances(_lifted(x, self.metric, self.top, False), self.pivots[head])
        order = np.argsort(d, axis=1, kind="stable")
        held = np.cumsum(count[order], axis=1)
        first = np.zeros(d.shape, bool)
        np.put_along_axis(first, order, held - count[order] < k, axis=1)

        def slabs(take: np.ndarray) -> np.ndarray:
            hit = np.zeros((len(d), int(slab.max()) + 1), bool)
            q, c = np.nonzero(take & (count > 0))
            hit[q, slab[c]] = True
            return hit

        hit = slabs(first)
        if bound is not None:
            hit = slabs(np.maximum(d - high, low - d) <= bound[:, None] * (1 + SLACK) + SLACK) & ~hit
        q, c = np.nonzero(hit)
        return q, c + base

    def reach(self, x: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance of a score."""
        if self.metric == "l2":
            return np.sqrt(np.maximum(-score, 0))
        x = _scaled(x, self.metric)
        return np.sqrt(np.maximum((x * x).sum(axis=1) + self.top ** 2 - 2 * score, 0))


def cells_of(keys: DataFrame, metric: str, cell_rows: int) -> tuple[DataFrame, Cells]:
    """Keys ``(head, id, vec)`` with their ``cell`` (written), and its figures."""
    heads = keys.groupBy("head").agg(F.count(F.lit(1)).alias("n"))
    seen = heads.agg(F.count(F.lit(1)).alias("heads"), F.sum("n").alias("n")).first()
    wanted = min(PIVOTS, -(-PER_BLOCK * (seen.n or 0) // cell_rows))
    top, pivots = 0.0, {}
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    if seen.heads <= PIVOTS // 2 and wanted > seen.heads:
        if metric != "l2":
            top = (keys.agg(F.max(norm / (norm + 1e-9) if metric == "cosine" else norm)).first()[0] or 0.0) * (1 + SLACK)
        share = min(1.0, 2.0 * wanted / seen.n)
        draw = F.pmod(F.xxhash64(F.lit(17), "head", "id"), F.lit(1 << 30)) < int(share * (1 << 30))
        by: dict[int, list] = {}
        for r in keys.filter(draw).orderBy(F.xxhash64("head", "id")).limit(wanted).collect():
            by.setdefault(r.head, []).append(r.vec)
        pivots = {h: _lifted(np.array(v, np.float64), metric, top, True) for h, v in by.items()}
    cells = Cells(metric, top, pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            head = batch.column(0).to_numpy()
            cell, dist = np.full(len(batch), -1, np.int64), np.zeros(len(batch))
            for h in np.unique(head).tolist():
                at = np.flatnonzero(head == h)
                cell[at], dist[at] = cells.assign(h, _matrix(batch.column(2).take(pa.array(at))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(dist)], names=["head", "id", "vec", "cell", "dist"])

    kind = keys.schema["vec"].dataType.simpleString()
    placed = cut_lineage(keys.select("head", F.col("id").cast("long"), "vec").mapInArrow(assign, f"head int, id bigint, vec {kind}, cell bigint, dist double"))
    figures = placed.groupBy("head", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("low"), F.max("dist").alias("high"))
    if seen.heads <= PIVOTS:
        cells.figures = {(r.head, r.cell): (r.n, r.low, r.high) for r in figures.collect()}
        cells.lay_slabs(max(cell_rows, SLAB))
    return placed, cells


def routed(queries: DataFrame, cells: Cells, k: int) -> DataFrame:
    """``(head, id, vec, kth, slab)``: a copy of each query ``(head, id, vec[, kth])`` for
    every slab it has to visit; without ``kth`` (then null) the first ones."""
    bounded = "kth" in queries.columns
    kind = queries.schema["vec"].dataType.simpleString()
    d = queries.select("head", F.col("id").cast("long"), "vec", F.col("kth") if bounded else F.lit(None).cast("double").alias("kth"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), ROUTE):
                part = batch.slice(lo, ROUTE)
                head = part.column(0).to_numpy()
                for h in np.unique(head).tolist():
                    at = np.flatnonzero(head == h)
                    x = _matrix(part.column(2).take(pa.array(at)))
                    bound = cells.reach(x, part.column(3).to_numpy(zero_copy_only=False)[at]) if bounded else None
                    q, c = cells.visits(h, x, k, bound)
                    for a in range(0, len(q), 10_000):       # a query may visit many slabs
                        rows = part.take(pa.array(at[q[a:a + 10_000]]))
                        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(c[a:a + 10_000].astype(np.int64))], names=["head", "id", "vec", "kth", "slab"])

    return d.mapInArrow(run, f"head int, id bigint, vec {kind}, kth double, slab bigint")


def _solve(placed: DataFrame, visits: DataFrame, k: int, metric: str, cell_rows: int) -> DataFrame:
    """Top ``k`` of each (slab, visiting query)."""
    kept = ["head", "slab"]
    blocks = (placed.groupBy(*kept).agg(F.count(F.lit(1)).alias("n")).join(visits.groupBy(*kept).agg(F.count(F.lit(1)).alias("m")), kept)
              .select(*kept, F.ceil(F.col("n") / max(2 * cell_rows, 2 * SLAB)).cast("int").alias("kbs"), F.ceil(F.col("m") / QUERIES).cast("int").alias("qbs")))
    blocks = cut_lineage(blocks)
    kk = placed.select("head", "id", "vec", "slab").join(blocks, kept)
    kk = kk.withColumn("kb", F.pmod(F.xxhash64("id"), F.col("kbs")).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("qbs") - 1)))
    qq = visits.join(blocks, kept)
    qq = qq.withColumn("qb", F.pmod(F.xxhash64("id"), F.col("qbs")).cast("int")).withColumn("kb", F.explode(F.sequence(F.lit(0), F.col("kbs") - 1)))
    block = ["head", "slab", "kb", "qb"]
    cols = [*block, "id", "vec"]
    return qq.select(*cols, "kth").groupBy(*block).cogroup(kk.select(*cols).groupBy(*block)).applyInPandas(_cell_topk(k, metric), OUT_SCHEMA)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("head", "qid").orderBy(F.col("score").desc(), F.col("kid"))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _knn(keys: DataFrame, queries: DataFrame, k: int, metric: str, cell_rows: int) -> DataFrame:
    """``(head, qid, kid, score, rank)`` of keys and queries ``(head, id, vec)``."""
    if k < 1 or metric not in ("dot", "cosine", "l2"):
        raise ValueError("k is at least 1, the metric dot, cosine or l2")
    placed, cells = cells_of(keys, metric, cell_rows)
    if not cells.figures:                       # a slab is a head
        visits = queries.select("head", F.col("id").cast("long"), "vec", F.lit(None).cast("double").alias("kth"), F.lit(-1).cast("long").alias("slab"))
        return _ranked(_solve(placed.withColumnRenamed("cell", "slab"), visits, k, metric, cell_rows), k)
    laid = keys.sparkSession.createDataFrame([(*c, s) for c, s in cells.slab.items()], "head int, cell long, slab long")
    placed = placed.join(F.broadcast(laid), ["head", "cell"])
    visits = routed(queries, cells, k)
    visits = cut_lineage(visits) if cells.pivots else visits
    first = _ranked(_solve(placed, visits, k, metric, cell_rows), k)
    if len(set(cells.slab.values())) == len({h for h, _ in cells.slab}):      # the first slab was the only one
        return first
    first = cut_lineage(first)
    kth = first.groupBy("head", "qid").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k)
    more = queries.select("head", "id", "vec").join(kth.select("head", F.col("qid").alias("id"), "kth"), ["head", "id"])
    more = cut_lineage(routed(more, cells, k))
    return _ranked(first.drop("rank").unionByName(_solve(placed, more, k, metric, cell_rows)), k)


def knn(keys: DataFrame, queries: DataFrame, k: int = 5, metric: str = "dot", cell_rows: int = 20000) -> DataFrame:
    """J-14: top-``k`` keys per query.  ``keys``/``queries``: (id, vec), ids unique."""
    one = F.lit(0).alias("head")
    return _knn(keys.select(one, "id", "vec"), queries.select(one, "id", "vec"), k, metric, cell_rows).drop("head")


def knn_heads(keys: DataFrame, queries: DataFrame, heads: int, k: int = 5, metric: str = "dot",
              cell_rows: int = 20000) -> DataFrame:
    """J-16: independent keys per head (integer ``head`` column in both inputs);
    results per (query, head).  Each head has pivots of its own; one plan,
    whatever the number of heads."""
    of_int = F.col("head").cast("int").alias("head")
    return _knn(keys.select(of_int, "id", "vec"), queries.select(of_int, "id", "vec"), k, metric, cell_rows)


def knn_product(keys1: DataFrame, keys2: DataFrame, q1: DataFrame, q2: DataFrame, k: int, n2: int | None = None,
                metric: str = "dot") -> DataFrame:
    """J-15: product keys.  The score of key (i1, i2) is s1(i1) + s2(i2); the
    best k per half are found with :func:`knn`.  A pair whose half ranks are
    (a, b) (1-based) is dominated by at least a*b pairs, so only pairs with
    a*b <= k can reach the top k: each first-half candidate is exploded to
    its allowed second-half ranks and equi-joined on (query, rank).  Exact,
    and no query ever forms k x k pairs.  Key id = i1 * n2 + i2, where ``n2``
    (by default the largest second id plus one) is larger than every second id."""
    n2 = n2 or keys2.agg(F.max("id")).first()[0] + 1
    h1 = knn(keys1, q1, k, metric).select("qid", F.col("kid").alias("k1"), F.col("score").alias("s1"),
                                           F.col("rank").alias("r1"))
    h2 = knn(keys2, q2, k, metric).select("qid", F.col("kid").alias("k2"), F.col("score").alias("s2"),
                                           F.col("rank").alias("r2"))
    allowed = h1.select("*", F.explode(F.sequence(F.lit(1), F.floor(F.lit(k) / F.col("r1")).cast("int"))).alias("r2"))
    cand = allowed.join(h2, ["qid", "r2"]).select(
        "qid", (F.col("k1") * n2 + F.col("k2")).alias("kid"), (F.col("s1") + F.col("s2")).alias("score"))
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("kid"))
    return cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
