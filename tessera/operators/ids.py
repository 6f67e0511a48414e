"""Exact global row numbers and running totals (X-01, X-02).

A window without ``partitionBy`` funnels every row through one task.  The
two-phase method used here never does that:

1. rows are range-partitioned and sorted by the order key and written once;
   Spark samples the borders from the data, so a frequent value, a huge document
   or hashed keys make no larger partition than others (ties are cut wherever the
   full order key allows);
2. one total per partition (as many rows as partitions) is prefixed and
   broadcast;
3. a row's number is its partition's offset plus its place in the partition; a
   running total of longs is summed in the sorted partition before it is written,
   one of other types adds a window over the partition's rows.

The order is total, so neither retries nor the number of partitions can change
the answer.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.session import cut_lineage


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


LOCAL_BITS = 33      # of Spark's monotonically increasing ids


def _local_sums():
    """Append ``_loc``, the sum of ``_v`` in the rows of the partition before each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            v = pc.fill_null(batch.column(batch.schema.get_field_index("_v")), 0).to_numpy(zero_copy_only=False)
            upto = total + np.cumsum(v, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(upto - v, pa.int64())], names=[*batch.schema.names, "_loc"])
            total = int(upto[-1]) if len(upto) else total
    return run


def running_total(df: DataFrame, order: Sequence, fine: Sequence = (), coarse: Sequence = (),
                  value=None, out: str = "running", inclusive: bool = True) -> DataFrame:
    """Append ``out`` = running sum of ``value`` (1 when None) in ``order``.

    ``order`` must be a total order (append a unique key to break ties).
    ``fine`` and ``coarse`` (bucket columns) are accepted and not needed.
    """
    names = [f"_o{i}" for i in range(len(order))]
    val = F.lit(1).cast("long") if value is None else (F.col(value) if isinstance(value, str) else value)
    d = df.select("*", *[c.alias(n) for c, n in zip(_cols(order), names)], val.alias("_v"))
    rows = (d.repartitionByRange(*names).sortWithinPartitions(*names)
            .drop(*names).withColumn("_mid", F.monotonically_increasing_id()))
    summed = value is not None and isinstance(d.schema["_v"].dataType, LongType)
    if summed:
        rows = rows.mapInArrow(_local_sums(), StructType([*rows.schema.fields, StructField("_loc", LongType())]))
    rows = cut_lineage(rows)
    rows = rows.withColumn("_part", F.shiftright("_mid", LOCAL_BITS))
    parts = rows.groupBy("_part").agg(F.sum("_v").alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)     # one row per partition
    offsets = parts.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_off"))
    res = rows.join(F.broadcast(offsets), "_part")
    if value is None:
        local = F.col("_mid").bitwiseAND(F.lit((1 << LOCAL_BITS) - 1)) + int(inclusive)
    elif summed:
        local = F.col("_loc") + (F.coalesce("_v", F.lit(0)) if inclusive else F.lit(0))
    else:
        frame = Window.partitionBy("_part").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        local = F.coalesce(F.sum("_v").over(frame), F.lit(0))
    return res.withColumn(out, F.col("_off") + local).drop("_mid", "_part", "_off", "_v", "_loc")


def with_row_id(df: DataFrame, order: Sequence, fine: Sequence = (), coarse: Sequence = (),
                out: str = "row_id") -> DataFrame:
    """X-01: dense 0-based row number in ``order``."""
    return running_total(df, order, fine, coarse, None, out, inclusive=False)


def int_key_buckets(key, fine_width: int = 1 << 16, coarse_width: int = 1 << 26):
    """Fine/coarse buckets for a single integer order key."""
    k = F.col(key) if isinstance(key, str) else key
    return [F.floor(k / fine_width)], [F.floor(k / coarse_width)]


def pair_key_buckets(major, minor, minor_width: int = 1 << 12, coarse_width: int = 1 << 14):
    """Buckets for a lexicographic (major, minor) integer key, e.g. (doc_id,
    line_no): a document with very many lines is split into several fine
    buckets."""
    a = F.col(major) if isinstance(major, str) else major
    b = F.col(minor) if isinstance(minor, str) else minor
    return [a, F.floor(b / minor_width)], [F.floor(a / coarse_width)]


def prefix_sum(df: DataFrame, value, order: Sequence, fine: Sequence = (), coarse: Sequence = (),
               out: str = "cum", inclusive: bool = True) -> DataFrame:
    """X-02: exact running total of ``value``."""
    return running_total(df, order, fine, coarse, value, out, inclusive)


def running_in_group(df: DataFrame, group: Sequence, order: Sequence, fine: Sequence, value, out: str,
                     how: str = "max", inclusive: bool = True) -> DataFrame:
    """Running maximum or sum of ``value`` per ``group`` in ``order`` without
    a per-group window over rows: every fine bucket (data columns, monotone in
    the order inside a group) is aggregated map-side, the bucket table (small)
    is prefixed per group, and the result is combined with the running value
    inside the bucket.  A group holding a third of all rows is split over
    many fine buckets, hence many tasks."""
    agg = F.max if how == "max" else F.sum
    group_c, order_c = _cols(group), _cols(order)
    gnames = [f"_g{i}" for i in range(len(group))]
    fnames = [f"_f{i}" for i in range(len(fine))]
    v = F.col(value) if isinstance(value, str) else value
    d = df.select("*", *[c.alias(n) for c, n in zip(group_c, gnames)],
                  *[c.alias(n) for c, n in zip(_cols(fine), fnames)], v.alias("_rv"))
    buckets = d.groupBy(*gnames, *fnames).agg(agg("_rv").alias("_b"))
    w_b = Window.partitionBy(*gnames).orderBy(*fnames).rowsBetween(Window.unboundedPreceding, -1)
    before = buckets.select(*gnames, *fnames, agg("_b").over(w_b).alias("_p"))
    w_r = Window.partitionBy(*gnames, *fnames).orderBy(*order_c).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    inside = agg("_rv").over(w_r)
    if how == "max":
        comb = F.greatest(F.col("_p"), inside)      # greatest skips NULL
    else:
        comb = F.coalesce(F.col("_p"), F.lit(0)) + F.coalesce(inside, F.lit(0))
    res = d.join(before, gnames + fnames).withColumn(out, comb)
    return res.drop(*gnames, *fnames, "_rv", "_p")


def running_max(df: DataFrame, group: Sequence, order: Sequence, fine: Sequence, value, out: str,
                inclusive: bool = True) -> DataFrame:
    return running_in_group(df, group, order, fine, value, out, "max", inclusive)
