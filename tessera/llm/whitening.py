"""Embedding whitening by mixed-precision eigenvectors (operator 13).

Entries become integers on a grid (``floor(64 c) + 1 000 000``), and the fit uses
each distinct grid vector once.  Grid vectors travel as small binary keys, so a
vector that a third of all rows share is combined before the shuffle.  Sums and
the matrix of products are integer arithmetic: rows are shifted by the rounded
mean before they are multiplied, blocks are multiplied as doubles as long as that
is exact, and blocks and partitions are added as integers.  What reaches the
driver is the covariance, ``d (d + 1) / 2`` numbers (``MAX_DIM`` bounds d).

The driver takes float32 eigenvectors of the covariance and corrects them by
Ogita-Aishima iterations in extended precision: each multiplies matrices only
and doubles the number of right digits.  Eigenvalues closer than the present
error bound are a cluster; their vectors are first turned by the eigenvectors
of the cluster's own small matrix, with the common eigenvalue taken out.

Defined results: rows whose vector is null, empty, or holds null or non-finite
entries are dropped, and so are those of another length than the most frequent
one among distinct vectors (ties: the shorter).  Grid values are clipped at
``2**45``.  ``deviation`` is null where the exact value fits no long.  A component
without variance (at most 1e-14 of the trace) has ``whitened`` null and does not
enter ``identity_error``; with no variance at all ``explained`` is null.  Null and
repeated ids are rows like others; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut

SCALE, ORIGIN = 64.0, 1_000_000
LIMIT = float(1 << 45)
MAX_DIM = 2048
COMPONENTS = 16
FLAT = 1e-14          # share of the trace up to which a component has no variance
WIDE = np.longdouble
ROWS = 2048           # rows of one matrix product


def grid(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(rows, sizes, values)``: which rows of a list column have a full finite
    vector, its length, and all their values ``floor(64 c)``, one row behind another."""
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64())
    c = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(c))])
    ends = np.concatenate([[0], np.cumsum(size)])
    good = (size > 0) & (bad[ends[1:]] == bad[ends[:-1]])
    with np.errstate(invalid="ignore", over="ignore"):
        v = np.clip(np.floor(SCALE * c[np.repeat(good, size)]), -LIMIT, LIMIT).astype(np.int64)
    return np.flatnonzero(good), size[good], v


def pack(sizes: np.ndarray, values: np.ndarray) -> list[bytes]:
    """One key per vector: the entries in the fewest of 2, 4 or 8 bytes each,
    and that width in front."""
    ends = np.cumsum(sizes)
    big = np.maximum.reduceat(np.where(values < 0, ~values, values), ends - sizes) if len(sizes) else values
    out: list[bytes] = [b""] * len(sizes)
    for width, kind, low, high in ((2, "<i2", 0, 1 << 15), (4, "<i4", 1 << 15, 1 << 31), (8, "<i8", 1 << 31, 1 << 62)):
        mine = np.flatnonzero((big >= low) & (big < high))
        if len(mine):
            data, tag = values.astype(kind), bytes([width])
            for r in mine.tolist():
                out[r] = tag + data[ends[r] - sizes[r]:ends[r]].tobytes()
    return out


def unpack(keys: list[bytes], dim: int) -> np.ndarray:
    """The vectors of keys that all have ``dim`` entries."""
    x = np.empty((len(keys), dim), np.int64)
    width = np.array([k[0] for k in keys], np.int64)
    for w in np.unique(width).tolist():
        mine = np.flatnonzero(width == w)
        x[mine] = np.frombuffer(b"".join(keys[r][1:] for r in mine.tolist()), f"<i{w}").reshape(-1, dim)
    return x


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, sizes, values = grid(batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(pack(sizes, values), pa.binary()), pa.array(sizes.astype(np.int32))], names=["x", "dim"])


def products(y: np.ndarray) -> np.ndarray:
    """Exact ``y^T y`` as Python integers."""
    top = max(1, int(np.abs(y).max(initial=0))) ** 2
    if top >= 1 << 52:
        return y.astype(object).T @ y.astype(object)
    total = np.zeros((y.shape[1],) * 2, object)
    step = max(1, min(ROWS, (1 << 53) // top))
    for lo in range(0, len(y), step):
        f = y[lo:lo + step].astype(np.float64)
        total = total + (f.T @ f).astype(np.int64)
    return total


@dataclass
class Fit:
    """What whitening needs: rows of the fit list, shift and remaining sums per
    dimension (of the values without ``ORIGIN``), directions and eigenvalues."""
    n: int
    shift: np.ndarray
    rest: np.ndarray          # sums of value - shift
    vectors: np.ndarray       # dim x components
    values: np.ndarray
    trace: float

    @property
    def scaled(self) -> np.ndarray:
        live = self.live
        return np.where(live, self.vectors / np.sqrt(np.where(live, self.values, 1)), 0.0)

    @property
    def live(self) -> np.ndarray:
        return self.values > FLAT * self.trace

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.shift) - self.rest.astype(np.float64) / self.n) @ self.scaled

    def deviation(self, x: np.ndarray) -> list[int | None]:
        y = x - self.shift
        size = max(1.0, float(np.abs(y).max(initial=0)) * self.n + float(np.abs(self.rest).max(initial=0)))
        if size * size * max(1, x.shape[1]) < 2.0 ** 62:
            return ((self.n * y - self.rest) ** 2).sum(axis=1).tolist()
        exact = ((self.n * y.astype(object) - self.rest.astype(object)) ** 2).sum(axis=1).tolist()
        return [v if v < 1 << 63 else None for v in exact]


def _decimals(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def _sums(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dim, object)
        for batch in batches:
            for lo in range(0, len(batch), ROWS):
                x = unpack(batch.column(0).slice(lo, ROWS).to_pylist(), dim)
                n, total = n + len(x), total + x.sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(np.full(dim, n)), _decimals(total)], names=["i", "n", "s"])
    return run


def _products(dim: int, shift: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for lo in range(0, len(batch), ROWS):
                p = products(unpack(batch.column(0).slice(lo, ROWS).to_pylist(), dim) - shift)
                total = p if total is None else total + p
        if total is not None:
            i, j = np.triu_indices(dim)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), _decimals(total[i, j])], names=["i", "j", "s"])
    return run


def _error_sums(fit: Fit, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(fit.values)
        total, mean = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            for lo in range(0, len(batch), ROWS):
                w = fit.whiten(unpack(batch.column(0).slice(lo, ROWS).to_pylist(), dim))
                total, mean = total + w.T @ w, mean + w.sum(axis=0)
        i, j = (a.ravel() for a in np.indices((k, k + 1)))
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(np.hstack([total, mean[:, None]]).ravel())],
                                         names=["i", "j", "s"])
    return run


def clusters(values: np.ndarray, bound) -> list[np.ndarray]:
    """Groups of two or more ascending ``values`` whose neighbours are within ``bound``."""
    parts = np.split(np.arange(len(values)), np.flatnonzero(np.diff(values) > bound) + 1)
    return [p for p in parts if len(p) > 1]


def eigen(a: np.ndarray, most: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, ascending, and eigenvectors of a symmetric extended-precision
    matrix: float32 vectors, corrected by Ogita-Aishima iterations."""
    d = len(a)
    unit = np.abs(a).max(initial=0)
    if not unit:
        return np.zeros(d, WIDE), np.eye(d, dtype=WIDE)
    a = a / unit
    one = np.eye(d, dtype=WIDE)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(WIDE)
    norm = np.sqrt((a * a).sum())
    # A turn by rounding / gap costs its square in orthogonality: closer values are left to sub-solves.
    fine = 4 * np.sqrt(np.finfo(WIDE).eps)
    calm = 0
    for _ in range(most):
        r = one - x.T @ x
        s = x.T @ (a @ x)
        r, s = (r + r.T) / 2, (s + s.T) / 2                     # else small gaps blow their rounding up
        values = np.diag(s) / (1 - np.diag(r))
        by = np.argsort(values, kind="stable")
        x, values, r, s = x[:, by], values[by], r[np.ix_(by, by)], s[np.ix_(by, by)]
        off = s - np.diag(np.diag(s))
        bound = max(fine, 2 * (np.sqrt((off * off).sum()) + norm * np.sqrt((r * r).sum())))
        gap = values[None, :] - values[:, None]
        near = np.abs(gap) <= bound
        e = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, gap))
        x = x + x @ e
        for group in clusters(values, bound):                   # sub-solves, with the common eigenvalue taken out
            part = x[:, group]
            small = part.T @ (a @ part) - values[group].mean() * (part.T @ part)
            size = np.abs(small).max()
            if size > 8 * np.finfo(WIDE).eps:
                turn = np.linalg.eigh(((small + small.T) / (2 * size)).astype(np.float64))[1].astype(WIDE)
                turn = turn @ (3 * np.eye(len(group), dtype=WIDE) - turn.T @ turn) / 2      # orthonormal to extended precision
                x[:, group] = part @ turn
        calm = calm + 1 if np.abs(e).max() <= fine and bound == fine else 0
        if calm == 2:                                           # the last one squared an error that was small already
            break
    s = x.T @ (a @ x)
    values = np.diag(s) / np.diag(x.T @ x)
    by = np.argsort(values, kind="stable")
    return values[by] * unit, x[:, by]


def _wide(v: int) -> np.longdouble:
    high = float(v)
    return WIDE(high) + WIDE(float(v - int(high)))


def fit(keys: DataFrame, dim: int, components: int = COMPONENTS) -> Fit:
    """Fit on distinct vectors of ``dim`` entries (column ``x``)."""
    got = keys.mapInArrow(_sums(dim), "i int, n bigint, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    n = got[0].n
    total = [int(r.s) for r in sorted(got, key=lambda r: r.i)]
    shift = np.array([(2 * t + n) // (2 * n) for t in total], np.int64)
    rest = [t - n * int(c) for t, c in zip(total, shift)]
    got = keys.mapInArrow(_products(dim, shift), "i int, j int, s decimal(38,0)").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    v = np.zeros((dim, dim), WIDE)
    square = WIDE(n) * WIDE(n)
    for r in got:
        v[r.i, r.j] = v[r.j, r.i] = _wide(n * int(r.s) - rest[r.i] * rest[r.j]) / square
    values, vectors = eigen(v)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return Fit(n, shift, np.array(rest, np.int64), (vectors * sign).astype(np.float64), np.maximum(values, 0).astype(np.float64), float(np.trace(v)))


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``(id_col, component, n, deviation, whitened, explained, identity_error)``
    of every row with a usable vector and each of the first components."""
    vectors = embeddings.select(F.col(vector_col).cast("array<double>").alias("v"))
    keys = cut(vectors.mapInArrow(_keys, "x binary, dim int").groupBy("x", "dim").agg(F.lit(1).alias("one")).drop("one"))
    lengths = keys.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    d = embeddings.select(id_col, F.col(vector_col).cast("array<double>").alias("v"))
    schema = f"`{id_col}` {d.schema[id_col].dataType.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if not lengths:
        return d.filter("false").mapInArrow(lambda batches: iter(()), schema)
    dim = lengths[0].dim
    if dim > MAX_DIM:
        raise ValueError(f"vectors of {dim} entries; the covariance is solved for at most {MAX_DIM}")
    keys = keys.filter(F.col("dim") == dim).select("x")
    model = fit(keys, dim, components)
    k = len(model.values)
    error = 0.0
    if model.live.any():
        got = keys.mapInArrow(_error_sums(model, dim), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
        sums = np.zeros((k, k + 1))
        for r in got:
            sums[r.i, r.j] = r.s / model.n
        cov = sums[:, :k] - np.outer(sums[:, k], sums[:, k])
        error = float(np.abs(cov - np.eye(k))[np.ix_(model.live, model.live)].max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        explained = pa.array(model.values / model.trace if model.trace > 0 else [None] * k, pa.float64())
        for batch in batches:
            for lo in range(0, len(batch), ROWS):
                part = batch.slice(lo, ROWS)
                rows, sizes, values = grid(part.column(1))
                mine = sizes == dim
                x = values[np.repeat(mine, sizes)].reshape(-1, dim)
                rows, m = rows[mine], int(mine.sum())
                each, comp = np.repeat(np.arange(m), k), np.tile(np.arange(k), m)
                w = pa.array(model.whiten(x).ravel(), mask=~np.tile(model.live, m))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows[each])), pa.array((comp + 1).astype(np.int32)), pa.array(np.full(m * k, model.n)),
                     pa.array(model.deviation(x), pa.int64()).take(pa.array(each)), w, explained.take(pa.array(comp)), pa.array(np.full(m * k, error))],
                    names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return d.mapInArrow(run, schema)
