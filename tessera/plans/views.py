"""Test views derived from the driver tables, in Spark.

Every view is a plain projection/explode/join over the given tables, so
its work grows with them.  ``oracle.py`` defines the same views in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import tokenize
from tessera.session import read_table

# A sentence id packs (doc_id, line_no), a pair id (conv_id, turn).  A text and an
# array hold fewer than 2**31 lines, so ids of different rows differ; a major id of
# 2**32 or more overflows and fails the job rather than collide.
LINE_SPAN = 1 << 31


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents")


def sent(spark: SparkSession, sf: str) -> DataFrame:
    """``(doc_id, line_no, sid, lang, text)``: documents split on newline."""
    d = documents(spark, sf).select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return d.select("doc_id", "line_no", (F.col("doc_id") * LINE_SPAN + F.col("line_no")).alias("sid"),
                    "lang", "text")


def sent_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """``sent`` plus ``tokens`` (B-01)."""
    return sent(spark, sf).withColumn("tokens", tokenize("text"))


def tok(spark: SparkSession, sf: str) -> DataFrame:
    """``(doc_id, line_no, sid, pos, tok)``."""
    s = sent_tokens(spark, sf)
    return s.select("doc_id", "line_no", "sid", F.posexplode("tokens").alias("pos", "tok"))


def pair(spark: SparkSession, sf: str) -> DataFrame:
    """``(id, conv_id, turn, src, tgt)``: each user turn with the next
    assistant turn of the same conversation (pairs by role, not parity)."""
    c = read_table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    w = Window.partitionBy("conv_id").orderBy("turn")
    nxt = c.select("conv_id", "turn", "role", "text",
                   F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("next_text"))
    p = nxt.filter((F.col("role") == "user") & (F.col("next_role") == "assistant"))
    return p.select((F.col("conv_id") * LINE_SPAN + F.col("turn")).alias("id"), "conv_id", "turn",
                    F.col("text").alias("src"), F.col("next_text").alias("tgt"))


def gold(spark: SparkSession, sf: str) -> DataFrame:
    """``(id, gold, score, toxic)``: labels with a score derived from the
    document length."""
    lab = read_table(spark, sf, "labels")
    doc = documents(spark, sf).select("doc_id", "n_chars")
    return (lab.join(doc, "doc_id")
            .select(F.col("doc_id").alias("id"), F.col("quality").alias("gold"),
                    (F.pmod(F.col("n_chars"), F.lit(100)) / 100.0).alias("score"),
                    F.col("toxic")))


def hyp(spark: SparkSession, sf: str) -> DataFrame:
    """``(id, rank, score, len)``: one hypothesis list per order, scores
    from the line's price (log-prob-like, negative)."""
    li = read_table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("rank"),
                     (-F.col("l_extendedprice") / 10000.0).alias("score"),
                     F.col("l_quantity").cast("int").alias("len"))


def emb(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


def metric(spark: SparkSession, sf: str) -> DataFrame:
    """``(run, step, ts, value, n)``: per user, events in time order."""
    from tessera.operators.ids import running_in_group
    ev = read_table(spark, sf, "events")
    # step = position of the event in its user's time order, counted with
    # hour buckets (two-phase), so one very active user is not one task
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    d = ev.withColumn("_t", t)
    d = running_in_group(d, ["user_id"], [F.col("_t"), F.col("event_id")], [F.floor(F.col("_t") / 3_600_000_000)],
                         F.lit(1).cast("long"), "step", how="sum")
    return d.select(F.col("user_id").alias("run"), F.col("step").cast("int").alias("step"), "ts",
                    "value", (F.col("event_id") % 7 + 1).alias("n"), "event_type")


def ids(spark: SparkSession, sf: str) -> DataFrame:
    """``(sid, ids)``: a vocabulary-free id array per line (token length mod
    12, then the end id 2) so that specials occur and every array op bites."""
    s = sent_tokens(spark, sf)
    return s.select("sid", F.concat(F.transform("tokens", lambda t: F.length(t) % 12),
                                    F.array(F.lit(2))).alias("ids"))


def bpe(spark: SparkSession, sf: str) -> DataFrame:
    """``(sid, seg)``: lines with sub-word splits ``abcd@@ efgh``."""
    s = sent(spark, sf)
    return s.select("sid", F.regexp_replace("text", "([A-Za-z]{4})([A-Za-z])", "$1@@ $2").alias("seg"))
