"""Sharding by a Feistel permutation of global row numbers (operator 8).

Rows are numbered 0..N-1 in the order of (id, text digest); a balanced Feistel
network over the smallest even number of bits that holds N, walked along its
cycle until it lands below N, permutes the numbers.  Permuted number ``p`` is
slot ``p div shards`` of shard ``p mod shards``: shard sizes differ by at most
one, slots are gapless, and both follow from (row number, N, seed) alone; the
inverse network gives the row of a slot.

Numbering is two-phase: a range partitioning and a sort inside each part give
local numbers, and one row per part carries the counts.

Defined results: a null text has no bytes and digest 0; null ids come first;
fully repeated rows are numbered in any order among themselves (they are
equal); an empty table gives an empty result; clashing extra columns are kept
out (``assign``) or kept as they are (``write_shards``, but for its own two).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import U64, cut, mix64

ROUNDS = 8
LOCAL_BITS = 33      # of Spark's monotonically increasing ids


class Feistel:
    """A permutation of range(n); vectorised, invertible, no tables."""

    def __init__(self, n: int, seed: int):
        self.n = n
        self.half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
        self.mask = U64((1 << self.half) - 1)
        self.keys = mix64(np.arange(1, ROUNDS + 1, dtype=U64) + mix64(np.array([seed & (2 ** 64 - 1)], U64)))

    def _once(self, x: np.ndarray, keys) -> np.ndarray:
        left, right = x >> U64(self.half), x & self.mask
        for k in keys:
            left, right = right, left ^ (mix64(right + k) & self.mask)
        return left << U64(self.half) | right

    def _back(self, x: np.ndarray, keys) -> np.ndarray:
        left, right = x >> U64(self.half), x & self.mask
        for k in keys[::-1]:
            left, right = right ^ (mix64(left + k) & self.mask), left
        return left << U64(self.half) | right

    def _walk(self, x: np.ndarray, step) -> np.ndarray:
        x = step(np.asarray(x).astype(U64), self.keys)
        out = np.flatnonzero(x >= U64(self.n))
        while len(out):
            x[out] = step(x[out], self.keys)
            out = out[x[out] >= U64(self.n)]
        return x.astype(np.int64)

    def forward(self, row) -> np.ndarray:
        return self._walk(row, self._once)

    def inverse(self, place) -> np.ndarray:
        return self._walk(place, self._back)


def numbered(df: DataFrame, order: list[str], out: str = "_row") -> tuple[DataFrame, int]:
    """``df`` with dense row numbers in ``order``, and the number of rows.  The
    sorted rows are written once; only one count per partition is summed up."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = cut(ranged.withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright("_mid", LOCAL_BITS)
    parts = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)      # one row per partition
    offset = cut(parts.select("_part", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")))
    total = offset.agg(F.sum("_n")).first()[0] or 0
    local = F.col("_mid").bitwiseAND(F.lit((1 << LOCAL_BITS) - 1))
    res = rows.withColumn("_part", part).join(F.broadcast(offset.drop("_n")), "_part").withColumn(out, F.col("_offset") + local)
    return res.drop("_mid", "_part", "_offset"), total


def placed(df: DataFrame, total: int, shards: int, seed: int, row: str = "_row") -> DataFrame:
    """Append ``shard`` and ``slot`` of each row number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Feistel(total, seed)
        for batch in batches:
            p = network.forward(batch.column(row).to_numpy()) if len(batch) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((p % shards).astype(np.int32)), pa.array(p // shards)],
                                             names=[*batch.schema.names, "shard", "slot"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, shard int, slot bigint")


def assign(docs: DataFrame, shards: int = 40, seed: int = 7) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` of every row."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                    F.xxhash64(text).alias("_digest"))
    rows, total = numbered(d, ["doc_id", "_digest", "text_crc32", "size"])
    out = placed(rows.drop("_digest"), total, shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 40, seed: int = 7) -> None:
    """Write all columns of ``docs`` and ``_slot`` as Parquet under
    ``path/_shard=<n>/``, in slot order; columns of these two names are replaced."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")
    rows, total = numbered(docs.select(own, F.xxhash64("text").alias("digest"), F.col("doc_id").alias("id")), ["id", "digest"])
    keys = placed(rows.select("_row"), total, shards, seed).withColumnsRenamed({"shard": "_shard", "slot": "_slot"})
    out = rows.join(keys, "_row").repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot")
    names = [c for c in docs.columns if c not in ("_shard", "_slot")]
    out.select(*[F.col(f"own.`{c}`").alias(c) for c in names], "_slot", "_shard").write.partitionBy("_shard").parquet(path)
