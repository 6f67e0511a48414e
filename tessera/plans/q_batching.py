"""Queries: greedy batches, token blocks and collation (W-03, D-01, D-04, E-01, E-04, E-06)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import batching as BT
from tessera.operators import ids as I
from tessera.operators import shaping as S
from tessera.plans import views
from tessera.plans.oracle import with_views
from tessera.plans.q_shaping import HU_SQL
from tessera.plans.registry import register


def J(c):
    c = F.col(c) if isinstance(c, str) else c
    return F.array_join(c.cast("array<string>"), " ")


# In size-ascending order the longest row of an open batch is always the
# current row, so the greedy state is (batch start, rows in batch): a
# recursive CTE walks the rows and records where each flushed batch ends.
W03_SQL = with_views("""
    WITH RECURSIVE s AS (
      SELECT sid, len, row_number() OVER (ORDER BY len, sid) - 1 AS rk
      FROM (SELECT sid, len(tokens) + 1 AS len FROM sent_tok) WHERE len <= 1024),
    st(rk, bstart, b, flush) AS (
      SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(1 AS BIGINT), CAST(NULL AS BIGINT)
      UNION ALL
      SELECT s.rk,
             CASE WHEN st.b = 64 OR (st.b + 1) * s.len > 1024 THEN st.bstart + greatest(8 * (st.b // 8), st.b % 8) ELSE st.bstart END,
             CASE WHEN st.b = 64 OR (st.b + 1) * s.len > 1024 THEN st.b - greatest(8 * (st.b // 8), st.b % 8) + 1 ELSE st.b + 1 END,
             CASE WHEN st.b = 64 OR (st.b + 1) * s.len > 1024 THEN st.bstart + greatest(8 * (st.b // 8), st.b % 8) END
      FROM st JOIN s ON s.rk = st.rk + 1),
    bounds AS (SELECT flush AS f FROM st WHERE flush IS NOT NULL)
    SELECT s.sid, s.len, s.rk AS rank, (SELECT count(*) FROM bounds WHERE f <= s.rk) AS batch FROM s
    UNION ALL SELECT sid, len(tokens) + 1, NULL, NULL FROM sent_tok WHERE len(tokens) + 1 > 1024""", "sent_tok")


@register("w03_greedy_batches", W03_SQL)  # also checked against brute force in tests/
def q_w03(spark, sf):
    s = views.sent_tokens(spark, sf).select("sid", (F.size("tokens") + 1).cast("long").alias("len"))
    kept, over = S.filter_by_size(s, {"len": 1024})  # C-01 first, as in the training input path
    b = BT.greedy_batches(kept, "sid", ["len"], max_tokens=1024, max_sentences=64, multiple=8)
    none = F.lit(None).cast("long")                  # lines that fit no batch are returned without one
    return b.select("sid", "len", "rank", "batch").union(over.select("sid", "len", none, none))


def _blocks_sql(size: int) -> str:
    return f"""
    WITH t AS (SELECT doc_id, line_no, list_append(tokens, '</s>') AS t FROM sent_tok),
    o AS (SELECT *, coalesce(sum(len(t)) OVER (ORDER BY doc_id, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM t),
    e AS (SELECT st + unnest(range(len(t))) AS off, unnest(t) AS tok FROM o)
    SELECT off // {size} AS block, string_agg(tok, ' ' ORDER BY off) AS tokens FROM e GROUP BY off // {size}"""


@register("d01_token_blocks", with_views(_blocks_sql(64), "sent_tok"))
def q_d01(spark, sf):
    s = views.sent_tokens(spark, sf).select("doc_id", "line_no", F.concat("tokens", F.array(F.lit("</s>"))).alias("t"))
    fine, coarse = I.pair_key_buckets("doc_id", "line_no")
    b = BT.token_blocks(s, "t", 64, [F.col("doc_id"), F.col("line_no")], fine, coarse)
    return b.select(F.col("block").cast("long").alias("block"), F.array_join("tokens", " ").alias("tokens"))


@register("d04_half_blocks", with_views(_blocks_sql((128 - 3) // 2), "sent_tok"))
def q_d04(spark, sf):
    """D-04: blocks of (block - 3) // 2 tokens so two halves plus specials fit."""
    s = views.sent_tokens(spark, sf).select("doc_id", "line_no", F.concat("tokens", F.array(F.lit("</s>"))).alias("t"))
    fine, coarse = I.pair_key_buckets("doc_id", "line_no")
    b = BT.token_blocks(s, "t", (128 - 3) // 2, [F.col("doc_id"), F.col("line_no")], fine, coarse)
    return b.select(F.col("block").cast("long").alias("block"), F.array_join("tokens", " ").alias("tokens"))


ROWS_IDS = {"r": """
    SELECT i.sid, i.ids, (row_number() OVER (ORDER BY s.doc_id, s.line_no) - 1) AS row_id
    FROM ids i JOIN sent s USING (sid)"""}


def ids_rows(spark, sf):
    d = views.ids(spark, sf).join(views.sent(spark, sf).select("sid", "doc_id", "line_no"), "sid")
    fine, coarse = I.pair_key_buckets("doc_id", "line_no")
    return I.with_row_id(d, [F.col("doc_id"), F.col("line_no")], fine, coarse)


@register("e04_pad_to_batch", with_views("""
    SELECT sid, array_to_string(list_concat(ids, list_transform(range(m - len(ids)), lambda i: 1)), ' ') AS padded
    FROM (SELECT sid, ids, max(len(ids)) OVER (PARTITION BY row_id // 16) AS m FROM r)""", "sent", "ids",
    extra=ROWS_IDS))
def q_e04(spark, sf):
    d = ids_rows(spark, sf).withColumn("batch", F.floor(F.col("row_id") / 16))
    return BT.pad_to_batch(d, "batch", "ids", pad=1).select("sid", J("padded").alias("padded"))


@register("e01_collate_pairs", with_views("""
    SELECT row_id // 16 AS batch, string_agg(CAST(sid AS VARCHAR), ' ' ORDER BY len(ids) DESC, sid) AS ids,
           string_agg(CAST(len(ids) AS VARCHAR), ' ' ORDER BY len(ids) DESC, sid) AS src_lengths,
           sum(len(list_filter(ids, lambda x: x <> 1))) AS ntokens, count(*) AS nsentences
    FROM r GROUP BY row_id // 16""", "sent", "ids", extra=ROWS_IDS))
def q_e01(spark, sf):
    d = ids_rows(spark, sf).withColumn("batch", F.floor(F.col("row_id") / 16)).withColumn(
        "tgt", F.filter("ids", lambda x: x != 1))
    c = BT.collate_pairs(d, "batch", "sid", "ids", "tgt")
    return c.select("batch", J("ids").alias("ids"), J("src_lengths").alias("src_lengths"),
                    F.col("ntokens").cast("long").alias("ntokens"), "nsentences")


@register("e06_round_batches", with_views("""
    SELECT sid FROM (SELECT sid, row_number() OVER (PARTITION BY row_id // 20 ORDER BY sid) AS rn,
                            count(*) OVER (PARTITION BY row_id // 20) AS n FROM r)
    WHERE rn <= CASE WHEN n < 8 THEN n ELSE (n // 8) * 8 END""", "sent", "ids", extra=ROWS_IDS))
def q_e06(spark, sf):
    d = ids_rows(spark, sf).withColumn("batch", F.floor(F.col("row_id") / 20))
    return BT.round_batches(d, "batch", "sid").select("sid")


@register("e01_collate_arrays", with_views("""
    WITH b AS (SELECT row_id // 16 AS batch, sid, ids, list_filter(ids, lambda x: x <> 1) AS tgt FROM r),
    m AS (SELECT *, max(len(ids)) OVER w AS ms, max(len(tgt)) OVER w AS mt, row_number() OVER (PARTITION BY batch ORDER BY len(ids) DESC, sid) - 1 AS row FROM b WINDOW w AS (PARTITION BY batch))
    SELECT batch, row, sid, array_to_string(list_concat(list_transform(range(ms - len(ids)), lambda i: 1), ids), ' ') AS source,
           array_to_string(list_concat(tgt, list_transform(range(mt - len(tgt)), lambda i: 1)), ' ') AS target,
           array_to_string(list_concat(list_concat([2], tgt[:-2]), list_transform(range(mt - len(tgt)), lambda i: 1)), ' ') AS previous FROM m""", "sent", "ids", extra=ROWS_IDS))
def q_e01_arrays(spark, sf):
    d = ids_rows(spark, sf).withColumn("batch", F.floor(F.col("row_id") / 16)).withColumn("tgt", F.filter("ids", lambda x: x != 1))
    c = BT.collate_arrays(d, "batch", "sid", "ids", "tgt", pad=1, eos=2)
    return c.select("batch", F.col("row").cast("long").alias("row"), "sid", J("source").alias("source"), J("target").alias("target"), J("previous").alias("previous"))


@register("e06_round_and_pad", with_views(f"""
    WITH c AS (SELECT sid, ids, row_id // 20 AS batch, row_number() OVER (PARTITION BY row_id // 20 ORDER BY {HU_SQL(61, 'sid')}, sid) AS rn,
                      count(*) OVER (PARTITION BY row_id // 20) AS n FROM r),
    k AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS m FROM c WHERE rn <= CASE WHEN n < 8 THEN n ELSE (n // 8) * 8 END)
    SELECT batch, sid, array_to_string(list_concat(ids, list_transform(range(CASE WHEN n < 8 THEN m ELSE ((m + 7) // 8) * 8 END - len(ids)), lambda i: 1)), ' ') AS padded
    FROM k""", "sent", "ids", extra=ROWS_IDS))
def q_e06_pad(spark, sf):
    d = ids_rows(spark, sf).withColumn("batch", F.floor(F.col("row_id") / 20))
    r = BT.pad_lengths(BT.round_batches(d, "batch", "sid", seed=61), "batch", "ids", pad=1)
    return r.select("batch", "sid", J("padded").alias("padded"))


D02_SQL = with_views("""
    WITH RECURSIVE s AS (
      SELECT sid, len(tokens) + 1 AS n, row_number() OVER (ORDER BY doc_id, line_no) - 1 AS rk FROM sent_tok),
    st(rk, cur, blk, out) AS (
      SELECT rk, CASE WHEN n = 1 THEN 0 ELSE n END, CASE WHEN n = 1 THEN 1 ELSE 0 END,
             CASE WHEN n = 1 THEN NULL ELSE 0 END FROM s WHERE rk = 0
      UNION ALL
      SELECT s.rk,
             CASE WHEN s.n = 1 THEN 0 WHEN st.cur <> 0 AND st.cur + s.n > 256 THEN s.n ELSE st.cur + s.n END,
             CASE WHEN s.n = 1 OR (st.cur <> 0 AND st.cur + s.n > 256) THEN st.blk + 1 ELSE st.blk END,
             CASE WHEN s.n = 1 THEN NULL WHEN st.cur <> 0 AND st.cur + s.n > 256 THEN st.blk + 1 ELSE st.blk END
      FROM st JOIN s ON s.rk = st.rk + 1)
    SELECT s.sid, CAST(s.n AS INTEGER) AS n, CAST(st.out AS BIGINT) AS block FROM s JOIN st USING (rk)""", "sent_tok")


@register("d02_sentence_blocks", D02_SQL)  # also checked against brute force in tests/
def q_d02(spark, sf):
    """'complete_doc' blocks of at most 256 tokens; an empty line (size 1:
    only its end symbol) ends a document."""
    from tessera.operators.sentence_blocks import sentence_blocks
    s = views.sent_tokens(spark, sf).select("sid", "doc_id", "line_no", (F.size("tokens") + 1).alias("n"))
    fine, coarse = I.pair_key_buckets("doc_id", "line_no")
    b = sentence_blocks(s, "n", [F.col("doc_id"), F.col("line_no")], fine, coarse, block=256, sep=1,
                        chunk_rows=512, group_chunks=4)
    return b.select("sid", "n", "block")


@register("d03_stream_columns", with_views("""
    WITH t AS (SELECT doc_id, line_no, list_append(tokens, '</s>') AS t FROM sent_tok),
    o AS (SELECT *, coalesce(sum(len(t)) OVER (ORDER BY doc_id, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM t),
    e AS (SELECT st + unnest(range(len(t))) AS off, unnest(t) AS tok FROM o),
    n AS (SELECT count(*) AS n, CAST(ceil(count(*) / 128.0) AS BIGINT) AS nb FROM e),
    g AS (SELECT n, nb, nb * 16 AS len, nb * 16 * 8 - n AS pad FROM n)
    SELECT CAST((off + pad) % len + 1 AS BIGINT) AS row, CAST((off + pad) // len AS BIGINT) AS col, tok FROM e, g
    UNION ALL SELECT CAST(i % len + 1 AS BIGINT), CAST(i // len AS BIGINT), '</s>' FROM g, range(pad) r(i)
    UNION ALL SELECT CAST(0 AS BIGINT), CAST(c AS BIGINT), '</s>' FROM range(8) r(c)""", "sent_tok"))
def q_d03(spark, sf):
    s = views.sent_tokens(spark, sf).select("doc_id", "line_no", F.concat("tokens", F.array(F.lit("</s>"))).alias("t"))
    fine, coarse = I.pair_key_buckets("doc_id", "line_no")
    return BT.stream_columns(s, "t", 8, 16, "</s>", [F.col("doc_id"), F.col("line_no")], fine, coarse)
