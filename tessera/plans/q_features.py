"""Queries: vocabulary extras and feature assembly (B-03, B-04, B-30, B-37, G-02, G-03,
G-05, G-07, G-23..G-25, G-31..G-33, G-37, J-03, J-09, L-07)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import features as FE
from tessera.operators import ids as I
from tessera.operators import pairing as P
from tessera.operators import vocab as V
from tessera.plans import views
from tessera.plans.oracle import with_views
from tessera.plans.q_shaping import ROWS_SQL, sent_rows
from tessera.plans.q_vocab import ENC_EXTRA, _vocab, vocab_sql
from tessera.plans.registry import register
from tessera.session import cut_lineage, read_table


def R(c, k=6):
    return F.round(F.col(c) if isinstance(c, str) else c, k)


def J(c):
    c = F.col(c) if isinstance(c, str) else c
    return F.array_join(c.cast("array<string>"), " ")


@register("b03_encode_special", with_views("""
    WITH e AS (SELECT t.sid, t.pos, coalesce(v.id, 3) AS tid FROM tok t LEFT JOIN vocab v ON t.tok = v.symbol)
    SELECT s.sid, trim(coalesce(x.ids || ' ', '') || '1') AS ids FROM sent s LEFT JOIN (
      SELECT sid, string_agg(CAST(tid AS VARCHAR), ' ' ORDER BY pos) AS ids FROM e WHERE tid >= 14 OR tid = 3 GROUP BY sid) x
    USING (sid)""", "tok", extra=vocab_sql(threshold=3, specials=V.SPECIALS_ALT)))
def q_b03(spark, sf):
    s = views.sent_tokens(spark, sf)
    v = cut_lineage(V.finalize_vocab(V.count_vocab(s), threshold=3, specials=V.SPECIALS_ALT))
    e = V.encode_special(s, ["sid"], v)
    return e.select("sid", J("ids").alias("ids"))


@register("b04_decode", with_views("""
    SELECT s.sid, coalesce(x.text, '') AS text FROM sent s LEFT JOIN (
      SELECT sid, string_agg(CASE WHEN tid = 3 THEN '<<unk>>' ELSE tok END, ' ' ORDER BY pos) AS text FROM enc GROUP BY sid) x
    USING (sid)""", "tok", extra={**vocab_sql(threshold=3), **ENC_EXTRA}))
def q_b04(spark, sf):
    s = views.sent_tokens(spark, sf)
    v = _vocab(spark, sf, threshold=3, materialize=True)
    e = V.encode(s, ["sid"], v)
    return V.decode(e, ["sid"], v, escape_unk=True)


@register("g02_upsample_concat", with_views("""
    WITH a AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS r FROM pair),
    n AS (SELECT count(*) AS n FROM a),
    c AS (SELECT a.id, a.r + k.c * n.n AS j FROM a, n, (SELECT unnest(range(3)) AS c) k)
    SELECT 0 AS part, j, id FROM c, n WHERE j < floor(2.5 * n.n)
    UNION ALL SELECT 1, row_id, sid FROM rows""", "pair", "sent_tok", extra=ROWS_SQL))
def q_g02(spark, sf):
    a = views.pair(spark, sf).select("id")
    a = I.with_row_id(a, [F.col("id")], *I.int_key_buckets("id"), out="r")
    na = a.count()  # the upsampled length int(ratio * n) needs n (one scalar)
    b = sent_rows(spark, sf).select(F.col("sid").alias("id"), F.col("row_id").alias("r"))
    nb = b.count()
    out = FE.upsample_concat([(a, 2.5, "r", na), (b, 1.0, "r", nb)])
    return out.select(F.col("part").cast("int").alias("part"), F.col("j").cast("long").alias("j"), "id")


def _lang_vocab_sql(lang: str, name: str) -> str:
    return f"""
    SELECT s.id, s.symbol, CAST(coalesce(c.count, 0) AS BIGINT) AS count FROM spec s LEFT JOIN (
      SELECT symbol, count(*) AS count FROM (SELECT unnest(list_append(tokens, '</s>')) AS symbol FROM sent_tok WHERE lang = '{lang}')
      GROUP BY symbol) c USING (symbol)
    UNION ALL SELECT CAST(3 + row_number() OVER (ORDER BY count DESC, symbol) AS INTEGER), symbol, count FROM (
      SELECT symbol, count(*) AS count FROM (SELECT unnest(list_append(tokens, '</s>')) AS symbol FROM sent_tok WHERE lang = '{lang}')
      GROUP BY symbol) WHERE symbol NOT IN (SELECT symbol FROM spec) AND count >= 2"""


@register("g03_merge_vocab", with_views("""
    WITH m AS (SELECT symbol, sum(count) AS count FROM (SELECT symbol, count FROM va UNION ALL SELECT symbol, count FROM vb)
               GROUP BY symbol),
    newb AS (SELECT symbol, (SELECT max(id) + 1 FROM va) + row_number() OVER (ORDER BY id) - 1 AS id FROM vb ANTI JOIN va USING (symbol))
    SELECT CAST(coalesce(a.id, newb.id) AS INTEGER) AS id, m.symbol, m.count FROM m
    LEFT JOIN va a USING (symbol) LEFT JOIN newb USING (symbol)""", "sent_tok", extra={
    "spec": "SELECT * FROM (VALUES (0, '<s>'), (1, '<pad>'), (2, '</s>'), (3, '<unk>')) t(id, symbol)",
    "va": _lang_vocab_sql("en", "a"), "vb": _lang_vocab_sql("fr", "b")}))
def q_g03(spark, sf):
    s = views.sent_tokens(spark, sf)
    va = V.finalize_vocab(V.count_vocab(s.filter(F.col("lang") == "en")), threshold=2, padding_factor=1)
    vb = V.finalize_vocab(V.count_vocab(s.filter(F.col("lang") == "fr")), threshold=2, padding_factor=1)
    return V.merge_vocab(va, vb).select("id", "symbol", F.col("count").cast("long").alias("count"))


@register("g05_cap_vocab", with_views("""
    SELECT s.sid, trim(coalesce(e.ids || ' ', '') || '2') AS ids
    FROM sent s LEFT JOIN (SELECT sid, string_agg(CAST(CASE WHEN tid >= 1000 THEN 3 ELSE tid END AS VARCHAR), ' ' ORDER BY pos) AS ids
                           FROM enc GROUP BY sid) e USING (sid)""",
    "tok", extra={**vocab_sql(threshold=3), **ENC_EXTRA}))
def q_g05(spark, sf):
    s = views.sent_tokens(spark, sf)
    v = _vocab(spark, sf, threshold=3, materialize=True)
    e = V.cap_vocab(V.encode(s, ["sid"], v), max_vocab=1000, unk=V.UNK)
    return e.select("sid", J("ids").alias("ids"))


@register("g07_corpus_summary", with_views("""
    WITH e AS (SELECT s.lang, enc.tid FROM enc JOIN sent s USING (sid))
    SELECT s.lang, coalesce(w.words, 0) AS words, coalesce(w.uniq, 0) AS "unique", s.sentences,
           round(100.0 * w.unk / nullif(w.words, 0), 6) AS unk_pct
    FROM (SELECT lang, count(*) AS sentences FROM sent GROUP BY lang) s
    LEFT JOIN (SELECT lang, count(*) AS words, count(DISTINCT tid) AS uniq, sum(CASE WHEN tid = 3 THEN 1 ELSE 0 END) AS unk
               FROM e GROUP BY lang) w USING (lang)""", "tok", extra={**vocab_sql(threshold=3), **ENC_EXTRA}))
def q_g07(spark, sf):
    s = views.sent_tokens(spark, sf)
    v = _vocab(spark, sf, threshold=3, materialize=True)
    e = V.encode(s, ["sid"], v, append_eos=False).join(s.select("sid", "lang"), "sid")
    c = FE.corpus_summary(e, ["lang"], "ids", V.UNK)
    return c.select("lang", "words", "unique", "sentences", R("unk_pct").alias("unk_pct"))


@register("g23_mean_pool", with_views("""
    SELECT label, d AS dim, round(avg(v), 6) AS mean FROM (
      SELECT label, unnest(range(len(vec))) AS d, unnest(vec) AS v FROM emb) GROUP BY label, d""", "emb"))
def q_g23(spark, sf):
    m = FE.mean_pool(views.emb(spark, sf), ["label"], "vec")
    return m.select("label", "dim", R("mean").alias("mean"))


@register("g24_topk_pool", with_views("""
    SELECT label, dim, round(sum(v) / 3, 6) AS topk_mean FROM (
      SELECT label, dim, v, row_number() OVER (PARTITION BY label, dim ORDER BY v DESC) AS r FROM (
        SELECT label, unnest(range(len(vec))) AS dim, unnest(vec) AS v FROM emb)) WHERE r <= 3 GROUP BY label, dim""",
    "emb"))
def q_g24(spark, sf):
    e = views.emb(spark, sf).select("id", "label", F.posexplode("vec").alias("dim", "v"))
    t = FE.topk_mean(e, ["label", "dim"], "v", 3, "id")
    return t.select("label", "dim", R("topk_mean").alias("topk_mean"))


@register("g25_weighted_bag", with_views("""
    WITH nn AS (SELECT qid, kid, score FROM (
        SELECT q.id AS qid, k.id AS kid, list_dot_product(q.vec, k.vec) AS score,
               row_number() OVER (PARTITION BY q.id ORDER BY list_dot_product(q.vec, k.vec) DESC, k.id) AS rank
        FROM emb q, emb k) WHERE rank <= 3),
    e1 AS (SELECT qid, kid, exp(score - max(score) OVER (PARTITION BY qid)) AS e FROM nn),
    w AS (SELECT qid, kid, e / sum(e) OVER (PARTITION BY qid) AS w FROM e1)
    SELECT qid, dim, round(sum(w * v), 6) AS value FROM w JOIN (
      SELECT id, unnest(range(len(vec))) AS dim, unnest(vec) AS v FROM emb) e ON e.id = w.kid GROUP BY qid, dim""", "emb"))
def q_g25(spark, sf):
    from pyspark.sql import Window
    from tessera.operators.knn import knn
    e = views.emb(spark, sf).select("id", "vec")
    nn = knn(e, e, k=3, cell_rows=200)
    w = Window.partitionBy("qid")
    nn = nn.withColumn("m", F.max("score").over(w)).withColumn("e", F.exp(F.col("score") - F.col("m")))
    nn = nn.withColumn("w", F.col("e") / F.sum("e").over(w))
    b = FE.weighted_bag(nn, e, "qid", "kid", "w", "vec")
    return b.select("qid", "dim", R("value").alias("value"))


@register("g31_mask_weights", with_views("""
    SELECT id, symbol, round(CASE WHEN id = 1 OR count = 0 THEN 0.0 ELSE pow(greatest(count, 1), -0.5) END, 6) AS weight
    FROM vocab""", "sent_tok", extra=vocab_sql(threshold=3)))
def q_g31(spark, sf):
    w = FE.mask_weights(_vocab(spark, sf, threshold=3), 0.5, V.PAD)
    return w.select("id", "symbol", R("weight").alias("weight"))


@register("g32_masked_score", with_views("""
    SELECT sid, round(sum(CASE WHEN m = 1 THEN -ln(x + 2.0) ELSE 0 END) / nullif(sum(m), 0), 6) AS masked_score FROM (
      SELECT sid, unnest(ids) AS x, unnest(list_transform(ids, lambda y: CASE WHEN y % 3 = 0 THEN 1 ELSE 0 END)) AS m FROM ids)
    GROUP BY sid""", "ids"))
def q_g32(spark, sf):
    d = views.ids(spark, sf).select("sid", F.explode("ids").alias("x"))
    d = d.select("sid", (-F.log(F.col("x") + 2.0)).alias("lp"), F.when(F.col("x") % 3 == 0, 1).otherwise(0).alias("m"))
    return FE.masked_score(d, "sid", "lp", "m").select("sid", R("masked_score").alias("masked_score"))


@register("g33_score_reference", """
    SELECT id, round(avg(lp), 6) AS score FROM (
      SELECT l_orderkey AS id, l_linenumber AS pos, ln(avg(l_discount + 0.01)) AS lp FROM lineitem GROUP BY l_orderkey, l_linenumber)
    GROUP BY id""")
def q_g33(spark, sf):
    li = read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("pos"),
                                                  (F.col("l_discount") + 0.01).alias("p"))
    return FE.score_reference(li, "id", "pos", "p").select("id", R("score").alias("score"))


@register("g37_word_stats", with_views("""
    SELECT tok AS word, count(*) AS count, round(avg(-ln(length(tok) + 1.0)), 6) AS mean_lprob FROM tok GROUP BY tok""", "tok"))
def q_g37(spark, sf):
    t = views.tok(spark, sf).select(F.col("tok").alias("word"), (-F.log(F.length("tok") + 1.0)).alias("lp"))
    return FE.word_stats(t, "word", "lp").select("word", "count", R("mean_lprob").alias("mean_lprob"))


# a word-vector table: every token's hash names one of the vectors, or none
WORD_VEC_SQL = """SELECT t.tok AS word, e.vec FROM (SELECT DISTINCT tok FROM tok) t
    JOIN emb e ON e.id = CAST('0x' || substr(md5(t.tok), 1, 6) AS BIGINT) % 5000"""


def _word_vectors(spark, sf):
    t = views.tok(spark, sf).select(F.col("tok").alias("word")).distinct()
    t = t.withColumn("id", F.conv(F.substring(F.md5("word"), 1, 6), 16, 10).cast("long") % 5000)
    return t.join(views.emb(spark, sf).select("id", "vec"), "id").select("word", "vec")


@register("j03_attach_vectors", with_views("""
    SELECT v.id, v.symbol, list_transform(e.vec, lambda x: round(x, 6)) AS vec FROM vocab v LEFT JOIN wv e ON e.word = v.symbol""",
    "tok", "emb", extra={**vocab_sql(threshold=3), "wv": WORD_VEC_SQL}))
def q_j03(spark, sf):
    j = P.attach_vectors(_vocab(spark, sf, threshold=3), _word_vectors(spark, sf))
    return j.select("id", "symbol", F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))


@register("j03_vector_overlap", with_views("""
    SELECT count(e.word) AS found, count(*) AS types FROM vocab v LEFT JOIN wv e ON e.word = v.symbol""",
    "tok", "emb", extra={**vocab_sql(threshold=3), "wv": WORD_VEC_SQL}))
def q_j03o(spark, sf):
    return P.vector_overlap(_vocab(spark, sf, threshold=3), _word_vectors(spark, sf))


@register("j09_back_translation", """
    SELECT h.id, h.source, o.o_totalprice AS target FROM (
      SELECT l_orderkey AS id, arg_max(l_linenumber, -l_extendedprice * 1e6 - l_linenumber) AS source
      FROM lineitem GROUP BY l_orderkey) h JOIN orders o ON o.o_orderkey = h.id""")
def q_j09(spark, sf):
    h = views.hyp(spark, sf)
    o = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("target"))
    return FE.back_translation_pairs(h, o, "id", "score", "rank").select("id", "source", "target")


@register("l07_sort_in_batch", with_views("""
    SELECT row_id // 16 AS batch, string_agg(CAST(sid AS VARCHAR), ' ' ORDER BY ntok DESC, sid) AS "order"
    FROM rows GROUP BY row_id // 16""", "sent_tok", extra=ROWS_SQL))
def q_l07(spark, sf):
    r = sent_rows(spark, sf).withColumn("batch", F.floor(F.col("row_id") / 16))
    return FE.sort_in_batch(r, "batch", "sid", "ntok").select("batch", J("order").alias("order"))


@register("b30_replace_unk", with_views("""
    WITH h AS (SELECT t.sid, t.pos, t.tok AS src_tok, CASE WHEN v.id IS NULL THEN '<unk>' ELSE t.tok END AS tok
               FROM tok t LEFT JOIN vocab v ON t.tok = v.symbol),
    d AS (SELECT DISTINCT tok AS src, '[' || tok || ']' AS tgt FROM tok)
    SELECT sid, string_agg(CASE WHEN h.tok = '<unk>' THEN coalesce(d.tgt, h.src_tok) ELSE h.tok END, ' ' ORDER BY pos) AS replaced
    FROM h LEFT JOIN d ON d.src = h.src_tok GROUP BY sid""", "tok", extra=vocab_sql(threshold=3)))
def q_b30(spark, sf):
    s = views.sent_tokens(spark, sf).filter(F.size("tokens") > 0)
    v = _vocab(spark, sf, threshold=3, materialize=True)
    ex = V.lookup_tokens(s.repartition("sid"), ["sid"], v)      # as in V.encode: rows are regrouped where they are
    hyp = V.assemble(ex.withColumn("tok", F.when(F.col("tid") == V.UNK, F.lit("<unk>")).otherwise(F.col("symbol"))),
                     ["sid"], "tok", "hyp")
    align = views.tok(spark, sf).select(F.col("tok").alias("src"), F.concat(F.lit("["), "tok", F.lit("]")).alias("tgt")).distinct()
    r = FE.replace_unk(hyp, s.select("sid", F.col("tokens").alias("src")), align, "sid")
    return r.select("sid", F.array_join("replaced", " ").alias("replaced"))


@register("b30_replace_unk_aligned", with_views("""
    WITH n AS (SELECT sid, len(tokens) AS n FROM sent_tok),
    h AS (SELECT t.sid, t.pos, n - 1 - t.pos AS at, CASE WHEN v.id IS NULL THEN '<unk>' ELSE t.tok END AS tok
          FROM tok t JOIN n USING (sid) LEFT JOIN vocab v ON t.tok = v.symbol)
    SELECT h.sid, string_agg(CASE WHEN h.tok = '<unk>' THEN CASE WHEN length(s.tok) >= 6 THEN '[' || s.tok || ']' ELSE s.tok END ELSE h.tok END, ' ' ORDER BY h.pos) AS replaced
    FROM h JOIN tok s ON s.sid = h.sid AND s.pos = h.at GROUP BY h.sid""", "tok", extra=vocab_sql(threshold=3)))
def q_b30_aligned(spark, sf):
    """Source positions come from an alignment (here: back to front); the
    dictionary has the longer words only, so that both outcomes occur."""
    s = views.sent_tokens(spark, sf).filter(F.size("tokens") > 0)
    v = _vocab(spark, sf, threshold=3, materialize=True)
    ex = V.lookup_tokens(s.repartition("sid"), ["sid"], v)      # as in V.encode: rows are regrouped where they are
    hyp = V.assemble(ex.withColumn("tok", F.when(F.col("tid") == V.UNK, F.lit("<unk>")).otherwise(F.col("symbol"))), ["sid"], "tok", "hyp")
    hyp = hyp.withColumn("alignment", F.sequence(F.size("hyp") - 1, F.lit(0), F.lit(-1)))
    align = (views.tok(spark, sf).filter(F.length("tok") >= 6)
             .select(F.col("tok").alias("src"), F.concat(F.lit("["), "tok", F.lit("]")).alias("tgt")).distinct())
    r = FE.replace_unk(hyp, s.select("sid", F.col("tokens").alias("src")), align, "sid", alignment="alignment")
    return r.select("sid", F.array_join("replaced", " ").alias("replaced"))


@register("b37_word_begin", with_views("""
    SELECT id, symbol, (id < 4 OR starts_with(symbol, 'madeupword') OR starts_with(symbol, '▁')) AS "begin" FROM vocab""",
    "sent_tok", extra=vocab_sql(threshold=3)))
def q_b37(spark, sf):
    return FE.word_begin(_vocab(spark, sf, threshold=3), 4)
