"""A training corpus from raw documents: five stages over the ``documents`` table.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written
as Parquet and read again before the next one, which deletes the scratch tables of
the stage before it.  All but the last return the
columns of ``docs``; the last returns one row per packed piece.

Rows are told apart by ``doc_id`` and text, so null and repeated ids are safe:
a decision is joined back to exactly the rows it was made for.
"""

from __future__ import annotations

import functools
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, line_dedup, near_dedup, packing, quality
from tessera.llm.common import cut, small
from tessera.session import discard_folders, recording, table_names

BROADCAST_ROWS = 500_000
ORACLE_SQL = None      # perplexity bands and best-fit packing are beyond SQL; see tests/llm


def _keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """``docs`` for an operator, with (id, text digest) as the row's id."""
    return docs.select(F.struct("doc_id", F.md5("text").alias("digest")).alias("doc_id"), *columns)


def _without(docs: DataFrame, out: DataFrame) -> DataFrame:
    """``docs`` without the rows whose id is in ``out``."""
    gone = cut(out.select(F.col("doc_id.doc_id").alias("_id"), F.col("doc_id.digest").alias("_digest")).distinct())
    if small(gone, BROADCAST_ROWS):      # ids and digests only; beyond the bound the join shuffles
        gone = F.broadcast(gone)
    same = docs["doc_id"].eqNullSafe(gone["_id"]) & F.md5(docs["text"]).eqNullSafe(gone["_digest"])
    return docs.join(gone, same, "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; the bands are fitted on ``labels``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _without(docs, quality.judged(_keyed(docs, "lang", "text"), labels, F.col("doc_id.doc_id")).filter(~F.col("kept")))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site lines go, except where they come first; a document that had
    words and is left with none goes, too.  ``n_chars`` follows the text."""
    d = line_dedup.removed(docs).filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    length = F.when(F.col("n_removed") == 0, F.col("row.n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    new = {"text": F.col("text"), "n_chars": length}
    return d.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (five-word shingles, 0.8)."""
    groups = near_dedup.near_duplicates(_keyed(docs, "text"))
    rest = _without(docs, groups.filter(~F.col("kept")))
    worded = F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    copies = rest.groupBy("doc_id", F.md5("text").alias("_digest")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").limit(1)
    if not copies.count():
        return rest
    return rest.filter(~worded).unionByName(rest.filter(worded).dropDuplicates(["doc_id", "text"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, decontaminate.contamination(_keyed(docs, "text"), benchmark).filter("n_hit > 0"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, packed into sequences."""
    return packing.pack(docs)


_spent = threading.local()      # scratch tables of this thread's stage before


def _tidy(stage):
    """The stage, which first deletes the scratch tables of the one before it but
    for those that ``docs`` still reads: when the next stage begins, the result of
    the last one has been written."""
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        old, used = getattr(_spent, "paths", []), table_names(docs)
        kept = [p for p in old if p.rsplit("/", 1)[-1] in used]
        discard_folders(spark, [p for p in old if p not in kept])
        with recording() as new:
            out = stage(spark, docs, sf_dir)
        _spent.paths = kept + new
        return out
    return run_stage


STAGES = [
    ("quality rules", _tidy(quality_rules)),
    ("line dedup", _tidy(drop_common_lines)),
    ("near-duplicates", _tidy(drop_near_duplicates)),
    ("decontamination", _tidy(drop_contaminated)),
    ("packing", _tidy(pack)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
