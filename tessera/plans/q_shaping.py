"""Queries: ids, filters, ordering, shards and batching (X-*, C-*, L-*, U-*, W-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import ids as I
from tessera.operators import shaping as S
from tessera.operators import vocab as V
from tessera.plans import views
from tessera.plans.oracle import tokens_sql, with_views
from tessera.plans.q_vocab import _vocab, vocab_sql
from tessera.plans.registry import register
from tessera.session import read_table


def R(c, k=6):
    return F.round(F.col(c) if isinstance(c, str) else c, k)


def HU_SQL(seed, key):
    """X-03 in DuckDB: first 32 bits of md5('seed:key') / 2^32."""
    return f"(CAST(('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 13)) AS BIGINT) / 4503599627370496.0)"


def sent_rows(spark, sf):
    """``sent`` with ntok and a dense row id in (doc_id, line_no) order."""
    s = views.sent_tokens(spark, sf).select("doc_id", "line_no", "sid", F.size("tokens").alias("ntok"))
    fine, coarse = I.pair_key_buckets("doc_id", "line_no")
    return I.with_row_id(s, [F.col("doc_id"), F.col("line_no")], fine, coarse)


ROWS_SQL = {"rows": """
    SELECT doc_id, line_no, sid, len(tokens) AS ntok, row_number() OVER (ORDER BY doc_id, line_no) - 1 AS row_id
    FROM sent_tok"""}


@register("x01_row_ids", with_views("SELECT sid, row_id FROM rows", "sent_tok", extra=ROWS_SQL))
def q_x01(spark, sf):
    keys = views.sent(spark, sf).select("doc_id", "line_no", "sid")      # only keys are numbered, no text is shuffled
    return I.with_row_id(keys, ["doc_id", "line_no"]).select("sid", "row_id")


@register("x02_prefix_sum", with_views("""
    SELECT sid, sum(len(tokens)) OVER (ORDER BY doc_id, line_no ROWS UNBOUNDED PRECEDING) AS cum FROM sent_tok""",
    "sent_tok"))
def q_x02(spark, sf):
    s = views.sent_tokens(spark, sf).select("doc_id", "line_no", "sid", F.size("tokens").cast("long").alias("ntok"))
    fine, coarse = I.pair_key_buckets("doc_id", "line_no")
    return I.prefix_sum(s, "ntok", [F.col("doc_id"), F.col("line_no")], fine, coarse).select("sid", "cum")


@register("x03_hash_uniform", with_views(f"SELECT sid, round({HU_SQL(7, 'sid')}, 9) AS u FROM sent", "sent"))
def q_x03(spark, sf):
    return views.sent(spark, sf).select("sid", R(S.hash_uniform(7, "sid"), 9).alias("u"))


@register("c01_filter_by_size_dropped", with_views("SELECT sid, len(tokens) AS ntok FROM sent_tok WHERE len(tokens) > 60",
                                                   "sent_tok"))
def q_c01(spark, sf):
    s = views.sent_tokens(spark, sf).select("sid", F.size("tokens").alias("ntok"))
    _, dropped = S.filter_by_size(s, {"ntok": 60})
    return dropped.select("sid", F.col("ntok").cast("long").alias("ntok"))


@register("c01_filter_by_size_kept", with_views("""
    SELECT count(*) AS kept FROM (SELECT id, len(s) AS sl, len(t) AS tl FROM (
      SELECT id, {src} AS s, {tgt} AS t FROM pair)) WHERE sl <= 200 AND tl <= 400""".format(
    src=tokens_sql("src"), tgt=tokens_sql("tgt")), "pair"))
def q_c01k(spark, sf):
    p = views.pair(spark, sf).select("id", F.size(T.tokenize("src")).alias("sl"), F.size(T.tokenize("tgt")).alias("tl"))
    kept, _ = S.filter_by_size(p, {"sl": 200, "tl": 400})
    return kept.agg(F.count(F.lit(1)).alias("kept"))


@register("c02_resolve_limits", with_views("""
    SELECT id, least(CASE WHEN id % 3 = 0 THEN NULL ELSE 100 + id % 50 END,
                     CASE WHEN id % 5 = 0 THEN NULL ELSE 120 - id % 40 END) AS lim FROM pair""", "pair"))
def q_c02(spark, sf):
    p = views.pair(spark, sf)
    a = F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(100 + F.col("id") % 50)
    b = F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise(120 - F.col("id") % 40)
    return p.select("id", S.resolve_limits(a, b).alias("lim"))


# a vocabulary with faults of each kind: a renamed special, two rows with one id, counts out of order
ODD_VOCAB = {"odd": """SELECT CASE WHEN id = 20 THEN 21 ELSE id END AS id, CASE WHEN id = 3 THEN '<odd>' ELSE symbol END AS symbol,
    CASE WHEN id % 50 = 7 THEN count * 1000 ELSE count END AS count FROM vocab"""}


@register("c03_check_vocab", with_views("""
    SELECT 'specials' AS "check", (SELECT count(*) FROM vocab v LEFT JOIN odd USING (id) WHERE v.id < 4 AND odd.symbol IS DISTINCT FROM v.symbol) AS violations
    UNION ALL SELECT 'bijection', (SELECT 2 * count(*) - count(DISTINCT id) - count(DISTINCT symbol)
        + CASE WHEN min(id) <> 0 OR max(id) <> count(*) - 1 THEN 1 ELSE 0 END FROM odd)
    UNION ALL SELECT 'count_order', (SELECT count(*) FROM odd a JOIN odd b ON a.id = b.id + 1 WHERE a.id > 4 AND a.count > b.count)""",
    "sent_tok", extra={**vocab_sql(threshold=2), **ODD_VOCAB}))
def q_c03(spark, sf):
    v = _vocab(spark, sf, threshold=2).select(
        F.when(F.col("id") == 20, 21).otherwise(F.col("id")).alias("id"), F.when(F.col("id") == 3, "<odd>").otherwise(F.col("symbol")).alias("symbol"),
        F.when(F.col("id") % 50 == 7, F.col("count") * 1000).otherwise(F.col("count")).alias("count"))
    return S.check_vocab(v, V.SPECIALS).select("check", F.col("violations").cast("long").alias("violations"))


PIDS = {"ptok": f"SELECT id, {tokens_sql('src')} AS s, {tokens_sql('tgt')} AS t FROM pair"}


def ptok(spark, sf):
    return views.pair(spark, sf).select("id", T.tokenize("src").alias("s"), T.tokenize("tgt").alias("t"))


@register("c04_drop_empty", with_views("SELECT id FROM ptok WHERE len(s) > 0 AND len(t) > 0", "pair", extra=PIDS))
def q_c04(spark, sf):
    return S.drop_empty(ptok(spark, sf), "s", "t").select("id")


@register("c05_drop_long", with_views("SELECT id FROM ptok WHERE len(s) <= 50 AND len(t) <= 50", "pair", extra=PIDS))
def q_c05(spark, sf):
    return S.drop_long(ptok(spark, sf), 50, "s", "t").select("id")


@register("c06_filter_quality", with_views("SELECT id, score FROM gold WHERE score <= 0.2", "gold"))
def q_c06(spark, sf):
    return views.gold(spark, sf).filter(F.col("score") <= 0.2).select("id", R("score").alias("score"))


@register("c07_select_rows", with_views("SELECT sid, row_id - 100 AS row_id FROM rows WHERE row_id >= 100 AND row_id < 300",
                                        "sent_tok", extra=ROWS_SQL))
def q_c07(spark, sf):
    return S.select_rows(sent_rows(spark, sf), "row_id", 100, 300).select("sid", "row_id")


@register("c08_select_blocks", with_views("""
    SELECT sid, row_id // 100 AS block FROM rows WHERE row_id // 100 >= 2 AND row_id // 100 < 5""",
    "sent_tok", extra=ROWS_SQL))
def q_c08(spark, sf):
    r = sent_rows(spark, sf).withColumn("block", F.floor(F.col("row_id") / 100))
    return S.select_blocks(r, "block", 2, 5, 10 ** 9).select("sid", "block")


@register("c09_check_tags", with_views(f"""
    SELECT count(*) FILTER (WHERE sid % 10 = 3) AS bad_gaps, count(*) FILTER (WHERE sid % 10 = 4) AS bad_tags,
           count(*) FILTER (WHERE sid % 10 = 5) AS bad_spans, count(*) FILTER (WHERE sid % 10 IN (5, 6)) AS bad_cover, count(*) AS rows
    FROM (SELECT sid, {tokens_sql('seg')} AS t FROM bpe) WHERE len(t) > 0""", "bpe"))
def q_c09(spark, sf):
    d = views.bpe(spark, sf).select("sid", T.tokenize("seg").alias("t")).filter(F.size("t") > 0)
    d = d.select("sid", F.size("t").alias("ntok"), T.word_spans("t").alias("spans"))
    d = d.select("sid", "ntok", "spans",
                 F.transform("spans", lambda s: F.when((s["end"] - s["start"]) % 2 == 0, 1).otherwise(0)).alias("word_tags"),
                 F.transform(F.sequence(F.lit(0), F.size("spans")), lambda i: i % 2).alias("gap_tags"))
    d = d.withColumn("tags", T.interleave("gap_tags", "word_tags"))
    # faults of each kind: a gap tag, a tag or a span too few, a token that no span covers
    short = lambda c, k: F.when(F.col("sid") % 10 == k, F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0)))).otherwise(F.col(c))
    d = d.withColumn("gap_tags", short("gap_tags", 3)).withColumn("tags", short("tags", 4)).withColumn("spans", short("spans", 5))
    d = d.withColumn("ntok", F.col("ntok") + (F.col("sid") % 10 == 6).cast("int"))
    c = S.check_tags(d, "ntok", "word_tags", "gap_tags", "tags", "spans")
    n = lambda c: F.sum(F.col(c).cast("int")).cast("long").alias(c)
    return c.agg(n("bad_gaps"), n("bad_tags"), n("bad_spans"), n("bad_cover"), F.count(F.lit(1)).alias("rows"))


@register("c10_check_corpus", with_views("""
    SELECT count(*) AS rows, sum(CASE WHEN len(ids) = 0 THEN 1 ELSE 0 END) AS empty,
           sum(len(list_filter(ids, lambda x: x < 0 OR x >= 10))) AS out_of_range
    FROM (SELECT CASE WHEN sid % 7 = 0 THEN [] ELSE ids END AS ids FROM ids)""", "ids"))
def q_c10(spark, sf):
    d = views.ids(spark, sf)      # every seventh line is emptied
    return S.check_corpus(d.withColumn("ids", F.when(F.col("sid") % 7 == 0, F.slice("ids", 1, 0)).otherwise(F.col("ids"))), "ids", 10)


@register("c12_manifest_size", """
    SELECT doc_id, least(n_chars, 5000) AS size FROM documents WHERE n_chars >= 200""")
def q_c12(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.filter(F.col("n_chars") >= 200).select("doc_id", F.least("n_chars", F.lit(5000)).alias("size"))


@register("c13_eval_subset", with_views("""
    WITH nl AS (SELECT count(DISTINCT lang) AS n FROM sent),
    pol AS (SELECT CASE WHEN n > 30 THEN 10 WHEN n > 5 THEN 10 ELSE 1 END AS subsample,
                   CASE WHEN n > 30 THEN 600 WHEN n > 5 THEN 300 ELSE -1 END AS n_sentences FROM nl)
    SELECT lang, subsample, n_sentences, count(*) AS rows FROM (
      SELECT s.lang, s.sid, p.subsample, p.n_sentences,
             row_number() OVER (PARTITION BY s.lang ORDER BY s.sid) AS rn FROM sent s, pol p)
    WHERE n_sentences < 0 OR rn <= n_sentences GROUP BY ALL""", "sent"))
def q_c13(spark, sf):
    s = views.sent(spark, sf)
    n_langs = s.select("lang").distinct().count()  # one scalar decides the policy
    subsample, n_sent = (10, 600) if n_langs > 30 else ((10, 300) if n_langs > 5 else (1, -1))
    if n_sent > 0:
        s = S.top_k(s.select("lang", "sid", (-F.col("sid")).alias("neg")), ["lang"], "neg", n_sent, tie="sid")
    return s.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).select(
        "lang", F.lit(subsample).alias("subsample"), F.lit(n_sent).alias("n_sentences"), "rows")


@register("l01_order_by_size", with_views(f"""
    SELECT id, row_number() OVER (ORDER BY len(s), len(t), {HU_SQL(1, 'id')}, id) - 1 AS rank FROM ptok""",
    "pair", extra=PIDS))
def q_l01(spark, sf):
    p = ptok(spark, sf).select("id", F.size("s").alias("sl"), F.size("t").alias("tl"), S.hash_uniform(1, "id").alias("h"))
    order = [F.col("sl"), F.col("tl"), F.col("h"), F.col("id")]
    r = I.with_row_id(p, order, fine=[F.col("sl"), F.col("tl"), S.hash_bucket(F.col("h"))], coarse=[F.col("sl")], out="rank")
    return r.select("id", "rank")


@register("l02_top_k", with_views("""
    SELECT id, rank, round(score, 6) AS score FROM (
      SELECT id, rank, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, rank) AS rn FROM hyp)
    WHERE rn <= 2""", "hyp"))
def q_l02(spark, sf):
    h = views.hyp(spark, sf).select("id", "score", "rank")
    return S.top_k(h, ["id"], "score", 2, tie="rank").select("id", "rank", R("score").alias("score"))


@register("l03_norm_score", with_views("""
    SELECT id, rank, floor(CASE WHEN len > 40 THEN '-inf'::DOUBLE ELSE score / pow(len, 1.5) END * 1e6) / 1e6 AS norm
    FROM hyp WHERE len <= 40
    UNION ALL SELECT id, rank, '-inf'::DOUBLE FROM hyp WHERE len > 40""",
    "hyp"))
def q_l03(spark, sf):
    h = views.hyp(spark, sf)
    n = S.norm_score("score", "len", 1.5, 40)
    # quantised with floor (identical in both engines), -inf passes through
    return h.select("id", "rank", F.when(F.col("len") > 40, n).otherwise(F.floor(n * 1e6) / 1e6).alias("norm"))


@register("l04_lexsort", with_views("""
    SELECT id, row_number() OVER (ORDER BY len(t), len(s), id) - 1 AS rank FROM ptok""", "pair", extra=PIDS))
def q_l04(spark, sf):
    p = ptok(spark, sf).select("id", F.size("s").alias("sl"), F.size("t").alias("tl"))
    keys = ["id", "sl", "tl"]  # last key is the primary one
    order = [F.col(k) for k in reversed(keys)]
    r = I.with_row_id(p, order, fine=[F.col("tl"), F.col("sl")], coarse=[F.col("tl")], out="rank")
    return r.select("id", "rank")


@register("l06_head_shuffled", with_views(f"SELECT sid FROM sent ORDER BY {HU_SQL(5, 'sid')}, sid LIMIT 100", "sent"))
def q_l06(spark, sf):
    s = views.sent(spark, sf).select("sid", S.hash_uniform(5, "sid").alias("h"))
    return s.orderBy("h", "sid").limit(100).select("sid")


@register("l08_shuffle_epoch", with_views(f"""
    SELECT b AS batch_id, row_number() OVER (ORDER BY {HU_SQL('3:2', 'b')}, b) - 1 AS position FROM (
      SELECT DISTINCT row_id // 64 AS b FROM rows)""", "sent_tok", extra=ROWS_SQL))
def q_l08(spark, sf):
    b = sent_rows(spark, sf).select(F.floor(F.col("row_id") / 64).alias("batch_id")).distinct()
    b = b.withColumn("h", S.hash_uniform("3:2", "batch_id"))
    r = I.with_row_id(b, [F.col("h"), F.col("batch_id")], fine=[S.hash_bucket(F.col("h"), 65536)],
                      coarse=[S.hash_bucket(F.col("h"), 64)], out="position")
    return r.select("batch_id", "position")


@register("u01_union_all", with_views("""
    SELECT src, count(*) AS n FROM (SELECT 'docs' AS src, sid FROM sent UNION ALL SELECT 'pairs', id FROM pair)
    GROUP BY src""", "sent", "pair"))
def q_u01(spark, sf):
    a = views.sent(spark, sf).select(F.lit("docs").alias("src"), F.col("sid").alias("id"))
    b = views.pair(spark, sf).select(F.lit("pairs").alias("src"), "id")
    return a.unionByName(b).groupBy("src").agg(F.count(F.lit(1)).alias("n"))


@register("u02_common_words", with_views("""
    SELECT tok FROM (SELECT unnest(tokens) AS tok FROM sent_tok WHERE lang = 'en')
    INTERSECT SELECT tok FROM (SELECT unnest(tokens) AS tok FROM sent_tok WHERE lang = 'fr')""", "sent_tok"))
def q_u02(spark, sf):
    s = views.sent_tokens(spark, sf).filter(F.col("lang").isin("en", "fr")).select("lang", F.explode("tokens").alias("tok"))
    # one aggregate, merged per task before the shuffle: no join of the two languages' words
    langs = s.groupBy("tok").agg(F.max(F.col("lang") == "en").alias("en"), F.max(F.col("lang") == "fr").alias("fr"))
    return langs.filter(F.col("en") & F.col("fr")).select("tok")


@register("u03_shared_limits", with_views("""
    SELECT a.lang, least(a.lim, b.lim) AS lim FROM
      (SELECT lang, max(len(tokens)) AS lim FROM sent_tok GROUP BY lang) a
      JOIN (SELECT lang, CAST(avg(n_chars) AS BIGINT) AS lim FROM documents WHERE lang <> 'de' GROUP BY lang) b
      USING (lang)""", "sent_tok"))
def q_u03(spark, sf):
    a = views.sent_tokens(spark, sf).groupBy("lang").agg(F.max(F.size("tokens")).cast("long").alias("la"))
    b = (read_table(spark, sf, "documents").filter(F.col("lang") != "de").groupBy("lang")
         .agg(F.avg("n_chars").cast("long").alias("lb")))
    return a.join(b, "lang").select("lang", F.least("la", "lb").alias("lim"))


@register("u04_shard_round_robin", with_views("""
    WITH r AS (SELECT sid, row_id % 7 AS shard, row_id // 7 AS slot FROM rows),
    n AS (SELECT count(*) AS n FROM rows),
    fill AS (SELECT s.shard, (SELECT max(slot) FROM r) AS slot FROM (SELECT DISTINCT shard FROM r) s
             WHERE (SELECT count(*) FROM r x WHERE x.shard = s.shard) < (SELECT (n + 6) // 7 FROM n))
    SELECT shard, slot, sid FROM r UNION ALL SELECT shard, slot, NULL FROM fill""", "sent_tok", extra=ROWS_SQL))
def q_u04(spark, sf):
    r = S.shard_round_robin(sent_rows(spark, sf), "row_id", 7).select("sid", "shard", "slot")
    from pyspark.sql import Window
    per = r.groupBy("shard").agg(F.count(F.lit(1)).alias("c"), F.max("slot").alias("last"))
    every = Window.partitionBy(F.lit(0))  # one row per shard: a tiny table
    per = per.withColumn("m", F.max("c").over(every)).withColumn("last_slot", F.max("last").over(every))
    # shards short of the longest one get one filler row in the last slot
    fill = (per.filter(F.col("c") < F.col("m"))
            .select("shard", F.col("last_slot").alias("slot"), F.lit(None).cast("long").alias("sid")))
    return r.select("shard", "slot", "sid").unionByName(fill)


@register("u05_shard_contiguous", with_views("""
    SELECT sid, row_id FROM rows WHERE row_id >= 2 * ((SELECT count(*) FROM rows) // 3)
                                   AND row_id < 3 * ((SELECT count(*) FROM rows) // 3)""", "sent_tok", extra=ROWS_SQL))
def q_u05(spark, sf):
    r = sent_rows(spark, sf)
    n = r.count()  # shard bounds need the row count (one scalar)
    return S.shard_contiguous(r, "row_id", n, 3, 2).select("sid", "row_id")


@register("u06_group_batches", with_views("""
    SELECT row_id // 64 AS batch_id, (row_id // 64) // 4 AS update_group FROM rows GROUP BY ALL""",
    "sent_tok", extra=ROWS_SQL))
def q_u06(spark, sf):
    r = sent_rows(spark, sf).select(F.floor(F.col("row_id") / 64).alias("batch_id")).distinct()
    return r.select("batch_id", F.floor(F.col("batch_id") / 4).alias("update_group"))


@register("u07_dropped_ids", with_views("""
    SELECT sid FROM sent_tok ANTI JOIN (SELECT sid FROM sent_tok WHERE len(tokens) BETWEEN 1 AND 60) k USING (sid)""",
    "sent_tok"))
def q_u07(spark, sf):
    before = views.sent_tokens(spark, sf).select("sid", F.size("tokens").alias("n"))
    after = before.filter((F.col("n") >= 1) & (F.col("n") <= 60))
    return before.join(after, "sid", "left_anti").select("sid")


BATCH_SQL = {"bl": "SELECT sid, len(tokens) + 2 AS len FROM sent_tok"}


@register("w01_token_batches", with_views("""
    SELECT sid, sum(len) OVER (ORDER BY len, sid ROWS UNBOUNDED PRECEDING) // 1024 AS batch_key FROM bl""",
    "sent_tok", extra=BATCH_SQL))
def q_w01(spark, sf):
    s = views.sent_tokens(spark, sf).select("sid", (F.size("tokens") + 2).cast("long").alias("len"))
    b = S.token_batches(s, "len", 1024, [F.col("len"), F.col("sid")],
                        fine=[F.col("len"), F.floor(F.col("sid") / 1e9)], coarse=[F.col("len")])
    return b.select("sid", F.col("batch_key").cast("long").alias("batch_key"))


@register("w02_equal_batches", with_views("""
    WITH r AS (SELECT sid, row_number() OVER (ORDER BY len, sid) - 1 AS rid FROM bl),
    k AS (SELECT count(*) AS n, CAST(ceil(count(*) / 64.0) AS BIGINT) AS k FROM r),
    q AS (SELECT n, k, n // k AS q, n % k AS rem FROM k)
    SELECT sid, CASE WHEN rid < rem * (q + 1) THEN rid // (q + 1) ELSE rem + (rid - rem * (q + 1)) // q END AS batch
    FROM r, q""", "sent_tok", extra=BATCH_SQL))
def q_w02(spark, sf):
    s = views.sent_tokens(spark, sf).select("sid", (F.size("tokens") + 2).cast("long").alias("len"))
    r = I.with_row_id(s, [F.col("len"), F.col("sid")], fine=[F.col("len"), F.floor(F.col("sid") / 1e9)],
                      coarse=[F.col("len")], out="rid")
    n = s.count()  # the split sizes depend on the row count (one scalar)
    return r.select("sid", S.equal_batches(F.col("rid"), n, 64).alias("batch"))


@register("w04_posterior", with_views("""
    SELECT id, rank, round(exp(score - m) / sum(exp(score - m)) OVER (PARTITION BY id), 6) AS posterior,
           first(rank ORDER BY score DESC, rank) OVER (PARTITION BY id) AS winner
    FROM (SELECT id, rank, score, max(score) OVER (PARTITION BY id) AS m FROM hyp)""", "hyp"))
def q_w04(spark, sf):
    p = S.posterior(views.hyp(spark, sf), ["id"], "rank", "score")
    return p.select("id", "rank", R("posterior").alias("posterior"), "winner")


@register("w06_mismatch", """
    WITH c AS (SELECT l_orderkey AS id, l_partkey % 97 AS tok, -l_extendedprice / 10000.0 AS score FROM lineitem),
    g AS (SELECT l_orderkey AS id, l_partkey % 97 AS tok FROM lineitem),
    cm AS (SELECT id, tok, max(score) AS score FROM c GROUP BY id, tok),
    b AS (SELECT id, max(score) AS best, arg_max(tok, score * 1e9 - tok) AS best_tok FROM cm GROUP BY id)
    SELECT g.id, g.tok, round(cm.score, 6) AS given_score, round(b.best, 6) AS best, b.best_tok,
           b.best_tok = g.tok AS equal, round(b.best - cm.score, 6) AS gap
    FROM g LEFT JOIN cm USING (id, tok) JOIN b USING (id)""")
def q_w06(spark, sf):
    li = read_table(spark, sf, "lineitem")
    cands = (li.select(F.col("l_orderkey").alias("id"), (F.col("l_partkey") % 97).alias("tok"),
                       (-F.col("l_extendedprice") / 10000.0).alias("score"))
             .groupBy("id", "tok").agg(F.max("score").alias("score")))
    given = li.select(F.col("l_orderkey").alias("id"), (F.col("l_partkey") % 97).alias("tok"))
    m = S.mismatch(cands, given, ["id"], "tok", "score")
    return m.select("id", "tok", R("given_score").alias("given_score"), R("best").alias("best"), "best_tok", "equal",
                    R("gap").alias("gap"))


@register("w07_gap_features", with_views("""
    WITH w AS (SELECT sid, pos AS word, CAST(length(tok) AS DOUBLE) AS v FROM tok),
    g AS (SELECT sid, unnest(range(len(tokens) + 1)) AS gap FROM sent_tok)
    SELECT g.sid, g.gap, coalesce(l.v, 0.0) AS "left", coalesce(r.v, 0.0) AS "right"
    FROM g LEFT JOIN w l ON l.sid = g.sid AND l.word + 1 = g.gap LEFT JOIN w r ON r.sid = g.sid AND r.word = g.gap""",
    "tok"))
def q_w07(spark, sf):
    t = views.tok(spark, sf).select("sid", F.col("pos").alias("word"), F.length("tok").cast("double").alias("v"))
    n = views.sent_tokens(spark, sf).select("sid", F.size("tokens").alias("n"))
    return S.gap_features(t, "sid", "word", "v", n)


@register("w08_blend", with_views("SELECT id, round(0.8 * score + 0.2 * toxic, 6) AS blended FROM gold", "gold"))
def q_w08(spark, sf):
    return views.gold(spark, sf).select("id", R(S.blend("score", "toxic", 0.8)).alias("blended"))


@register("w09_decumulate", with_views("""
    SELECT run, step, round(cum - coalesce(lag(cum) OVER (PARTITION BY run ORDER BY step), 0), 6) AS step_score FROM (
      SELECT run, step, sum(value) OVER (PARTITION BY run ORDER BY step) AS cum FROM metric)""", "metric"))
def q_w09(spark, sf):
    from pyspark.sql import Window
    m = views.metric(spark, sf)
    m = m.withColumn("cum", F.sum("value").over(Window.partitionBy("run").orderBy("step")))
    return S.decumulate(m, ["run"], "step", "cum").select("run", "step", R("step_score").alias("step_score"))


@register("w10_rescore", with_views("""
    WITH a AS (SELECT id, rank, score / 2.0 AS s FROM hyp),
    b AS (SELECT id, rank, exp(s - max(s) OVER (PARTITION BY id)) AS e FROM a),
    c AS (SELECT id, rank, e / sum(e) OVER (PARTITION BY id) AS s FROM b),
    d AS (SELECT id, rank, s, row_number() OVER (PARTITION BY id ORDER BY s) AS r, count(*) OVER (PARTITION BY id) AS n FROM c),
    e AS (SELECT id, rank, s - max(CASE WHEN r = (n + 1) // 2 THEN s END) OVER (PARTITION BY id) AS s FROM d)
    SELECT id, rank, round(s / nullif(sum(abs(s)) OVER (PARTITION BY id), 0), 6) AS rescored FROM e""", "hyp"))
def q_w10(spark, sf):
    r = S.rescore(views.hyp(spark, sf), ["id"], "score", temperature=2.0, softmax=True, subtract="median", l1=True)
    return r.select("id", "rank", R("rescored").alias("rescored"))


@register("w11_best_patience", with_views("""
    WITH a AS (SELECT run, step, value, max(value) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb,
                      row_number() OVER (PARTITION BY run ORDER BY step) AS idx FROM metric),
    b AS (SELECT *, (pb IS NULL OR value > pb) AS imp FROM a),
    c AS (SELECT run, step, max(value) OVER (PARTITION BY run ORDER BY step ROWS UNBOUNDED PRECEDING) AS best,
                 idx - max(CASE WHEN imp THEN idx END) OVER (PARTITION BY run ORDER BY step ROWS UNBOUNDED PRECEDING) AS counter
          FROM b)
    SELECT run, step, round(best, 6) AS best, CAST(counter AS INTEGER) AS counter, counter > 20 AS stop FROM c""", "metric"))
def q_w11(spark, sf):
    b = S.best_and_patience(views.metric(spark, sf), "run", "step", "value", patience=20)
    return b.select("run", "step", R("best").alias("best"), "counter", "stop")


@register("w12_nucleus", with_views("""
    WITH p AS (SELECT id, rank, exp(score) / sum(exp(score)) OVER (PARTITION BY id) AS prob FROM hyp)
    SELECT id, rank FROM (SELECT id, rank, coalesce(sum(prob) OVER (PARTITION BY id ORDER BY prob DESC, rank
                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
    WHERE before < 0.6""", "hyp"))
def q_w12(spark, sf):
    from pyspark.sql import Window
    h = views.hyp(spark, sf)
    h = h.withColumn("prob", F.exp("score") / F.sum(F.exp("score")).over(Window.partitionBy("id")))
    return S.nucleus(h, ["id"], "prob", 0.6, "rank").select("id", "rank")
