"""Conflict-constrained best-fit packing (operator 2).

A document is cut into pieces of at most ``capacity`` tokens (words, plus one
separator at its end).  Pieces go, largest first, into the open bin with the
smallest residual that holds them and has neither their source nor their
duplicate cluster: bins are kept ordered by residual and carry a bitmap of
sources and one of clusters, and the search runs from the successor of the
piece's length upwards until a compatible bin is met; if none is, a bin opens.
Bitmaps are exact integers; a 64-bit fold of each is compared for a whole run of
bins at once, and the exact one decides where a folded bit may be another's.

Packing is sequential, so pieces are dealt to groups by a hash of their
identity, with as many groups as keep one at about ``GROUP_PIECES`` pieces: hot
sources and clusters spread over all groups, no group grows with the corpus.

Defined results: a null or empty text is one piece of length 1 (its separator);
null sources are one source, null ids come first in ties, equal texts are a
cluster unless ``cluster_col`` is given (then null clusters are one cluster);
repeated rows are packed one by one; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut

CAPACITY = 2048
GROUP_PIECES = 8192


class Bins:
    """Open bins in order of residual."""

    def __init__(self, capacity: int, room: int):
        self.capacity, self.n = capacity, 0
        self.residual = np.zeros(room, np.int64)
        self.name = np.zeros(room, np.int64)
        self.source_fold = np.zeros(room, np.uint64)
        self.cluster_fold = np.zeros(room, np.uint64)
        self.sources: list[int] = []          # exact bitmaps, by bin name
        self.clusters: list[int] = []
        self.used: list[int] = []             # pieces and tokens so far
        self.filled: list[int] = []

    def find(self, length: int, source: int, cluster: int) -> int:
        """Index of the tightest compatible bin, -1 if there is none."""
        s, c = np.uint64(1 << (source & 63)), np.uint64(1 << (cluster & 63))
        at, step = int(np.searchsorted(self.residual[:self.n], length)), 64
        while at < self.n:
            end = min(self.n, at + step)
            clash = ((self.source_fold[at:end] & s) | (self.cluster_fold[at:end] & c)) != 0
            free = int(np.argmin(clash))
            stop = free if not clash[free] else end - at
            certain = (self.source_fold[at:at + stop] & s) != 0 if source < 64 and self.narrow else np.zeros(stop, bool)
            for i in np.flatnonzero(~certain).tolist():
                b = int(self.name[at + i])
                if not (self.sources[b] >> source & 1 or self.clusters[b] >> cluster & 1):
                    return at + i
            if at + stop < end:
                return at + stop
            at, step = end, step * 4
        return -1

    narrow = True      # at most 64 sources: a folded source bit is exact

    def put(self, length: int, source: int, cluster: int) -> tuple[int, int, int]:
        """Place a piece; returns its bin, its number in the bin and its offset."""
        i = self.find(length, source, cluster) if length < self.capacity else -1
        if i < 0:
            i, b, left = self.n, len(self.used), self.capacity
            self.n += 1
            self.sources.append(0), self.clusters.append(0), self.used.append(0), self.filled.append(0)
            fold = (np.uint64(0), np.uint64(0))
        else:
            b, left = int(self.name[i]), int(self.residual[i])
            fold = (self.source_fold[i], self.cluster_fold[i])
        left -= length
        to = int(np.searchsorted(self.residual[:i], left))
        for a in (self.residual, self.name, self.source_fold, self.cluster_fold):
            a[to + 1:i + 1] = a[to:i]
        self.residual[to], self.name[to] = left, b
        self.source_fold[to] = fold[0] | np.uint64(1 << (source & 63))
        self.cluster_fold[to] = fold[1] | np.uint64(1 << (cluster & 63))
        self.sources[b] |= 1 << source
        self.clusters[b] |= 1 << cluster
        place = (b, self.used[b], self.filled[b])
        self.used[b] += 1
        self.filled[b] += length
        return place


def pack_group(length: np.ndarray, source: np.ndarray, cluster: np.ndarray, capacity: int) -> np.ndarray:
    """``(bin, number in bin, offset)`` of pieces in the given order; sources
    and clusters are small integers."""
    bins = Bins(capacity, len(length) + 1)
    bins.narrow = not len(source) or int(source.max()) < 64
    out = [bins.put(*p) for p in zip(length.tolist(), source.tolist(), cluster.tolist())]
    return np.array(out, np.int64).reshape(-1, 3)


def pieces(docs: DataFrame, capacity: int, cluster_col: str | None) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    words = F.size(F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != ""))
    cluster = F.xxhash64(F.md5(text)) if cluster_col is None else F.xxhash64(F.col(cluster_col))
    d = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), cluster.alias("cluster"),
                    F.crc32(text.cast("binary")).alias("_crc"), (words + 1).cast("long").alias("_n"))
    d = d.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / capacity))).alias("piece"))
    return d.select("doc_id", "source", "cluster", "_crc", "piece", (F.col("piece") * capacity).alias("start"),
                    F.least(F.lit(capacity).cast("long"), F.col("_n") - F.col("piece") * capacity).alias("length"))


def pack(docs: DataFrame, capacity: int = CAPACITY, cluster_col: str | None = None, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``(doc_id, piece, start, length, pack, bin, slot, offset)``: piece
    ``piece`` of a document is words ``[start, start + length)`` and lies at
    ``offset`` of sequence ``(pack, bin)`` as its ``slot``-th piece."""
    cut_up = cut(pieces(docs, capacity, cluster_col))
    groups = max(1, -(-cut_up.count() // group_pieces))
    dealt = cut_up.withColumn("pack", F.pmod(F.xxhash64("doc_id", "piece", "_crc"), F.lit(groups)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(group: pa.Table) -> pa.Table:
        order = [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("_crc", "ascending")]
        group = group.take(pa.compute.sort_indices(group, sort_keys=order, null_placement="at_start"))
        source = np.unique(group["source"].to_numpy(zero_copy_only=False).astype(str), return_inverse=True)[1]
        cluster = np.unique(group["cluster"].to_numpy(), return_inverse=True)[1]
        place = pack_group(group["length"].to_numpy(), source, cluster, capacity)
        names = ["doc_id", "piece", "start", "length", "pack"]
        return pa.table([*(group[n] for n in names), *(pa.array(place[:, i]) for i in range(3))], names=[*names, "bin", "slot", "offset"])

    return dealt.groupBy("pack").applyInArrow(run, f"doc_id {kind}, piece bigint, start bigint, length bigint, pack bigint, bin bigint, slot bigint, offset bigint")
