"""Cross-site line deduplication (operator 7), DataFrame functions only.

A line (its text without outer white space) that occurs on ``min_sites`` or more
distinct sites is boilerplate: its first occurrence, by document and line
number, stays, all others are removed.  Spread is measured by one HyperLogLog
sketch per line hash, merged by the aggregation; where the estimate is within
``MARGIN`` of the threshold, exact distinct counts decide.  With 2**LG_K
registers the standard error is 1.6 %, so an estimate outside the margin is off
the threshold by over fifteen standard errors.

Defined results: lines without a word always stay and are no boilerplate; a
null text has no lines and stays null; a null site is a site of its own; null
ids come first; repeated rows (same id and text) are treated alike; an empty
table gives an empty result.  Rows are matched by id and text digest, so rows
that share an id keep their own lines; extra columns are carried through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut

MIN_SITES = 10
LG_K = 12
MARGIN = 0.25
BLANKS = " \t\r\x0b\x0c"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_table(docs: DataFrame, id_col: str, site_col: str) -> DataFrame:
    """``(key, doc, digest, line_no, site)`` of each line with a word."""
    text = F.col("text")
    d = docs.select(F.col(id_col).alias("doc"), F.unhex(F.md5(text)).alias("digest"), F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"),
                    F.posexplode(_lines(text)).alias("line_no", "line"))
    bare = F.btrim("line", F.lit(BLANKS))
    return d.filter(bare != "").select(F.unhex(F.md5(bare)).alias("key"), "doc", "digest", "line_no", "site")


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """``(key, first)`` of lines on at least ``min_sites`` sites."""
    spread = cut(lines.groupBy("key").agg(
        F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.min(F.struct("doc", "line_no")).alias("first"))
        .select("key", "first", F.hll_sketch_estimate("sketch").alias("sites"))
        .filter(F.col("sites") >= min_sites * (1 - MARGIN)))
    sure = spread.filter(F.col("sites") >= min_sites * (1 + MARGIN)).select("key", "first")
    near = spread.filter(F.col("sites") < min_sites * (1 + MARGIN)).select("key", "first")
    exact = (lines.select("key", "site").join(near.select("key"), "key", "left_semi").distinct()
             .groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_sites))
    return cut(sure.union(near.join(exact.select("key"), "key")))


def removed(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", site_col: str = "source") -> DataFrame:
    """``(row, text, n_lines, n_removed)``: every row of ``docs`` as it is (one
    struct), its text without removed lines, its lines with a word, and how many
    of them went."""
    lines = cut(line_table(docs, id_col, site_col))
    common = boilerplate(lines, min_sites)
    first = (F.col("doc").eqNullSafe(F.col("first.doc"))) & (F.col("line_no") == F.col("first.line_no"))
    gone = lines.join(common, "key").filter(~first).groupBy("doc", "digest").agg(F.collect_set("line_no").alias("gone"))
    gone = cut(gone)
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.unhex(F.md5("text")).alias("mark"))
    d = d.join(gone, d["id"].eqNullSafe(gone["doc"]) & (d["mark"] == gone["digest"]), "left").select("row", "gone", _lines(F.col("row.text")).alias("lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n")
    counted = F.size(F.filter("lines", lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    return d.select("row", F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(kept).alias("text"),
                    F.when(F.col("row.text").isNull(), 0).otherwise(counted).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", site_col: str = "source") -> DataFrame:
    """``docs`` with ``text`` without removed lines, plus ``_n_lines`` (lines with
    a word) and ``_n_removed``; where ``docs`` has such a column, its own stays
    and the new one gets one more underscore."""
    names = []
    for name in ("_n_lines", "_n_removed"):
        while name in docs.columns:
            name = "_" + name
        names.append(name)
    own = [F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return removed(docs, min_sites, id_col, site_col).select(*own, F.col("n_lines").alias(names[0]), F.col("n_removed").alias(names[1]))


def report(docs: DataFrame) -> DataFrame:
    r = removed(docs.select("doc_id", "source", "text"))
    return r.select("row.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
