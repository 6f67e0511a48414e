"""Queries: evaluation and meters (G-08..G-22, G-26..G-28, G-30, W-05, J-08)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import bleu as B
from tessera.operators import metrics as M
from tessera.plans import views
from tessera.plans.oracle import with_views
from tessera.plans.registry import register
from tessera.session import read_table


def R(c, k=6):
    return F.round(F.col(c) if isinstance(c, str) else c, k)


@register("g08_avg_meter", with_views("""
    SELECT run, sum(value * n) AS sum, sum(n) AS count, round(sum(value * n) / sum(n), 6) AS avg
    FROM metric GROUP BY run""", "metric"))
def q_g08(spark, sf):
    d = M.avg_meter(views.metric(spark, sf), ["run"], "value", "n")
    return d.select("run", R("sum").alias("sum"), "count", R("avg").alias("avg"))


@register("g09_rate_meter", with_views("""
    SELECT run, sum(n) AS n, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS elapsed,
           round(sum(n) / nullif((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 0), 6) AS rate,
           round(((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) / nullif(count(*) - 1, 0), 6) AS avg_interval
    FROM metric GROUP BY run""", "metric"))
def q_g09(spark, sf):
    d = M.rate_meter(views.metric(spark, sf), ["run"], "n", "ts")
    return d.select("run", "n", R("elapsed").alias("elapsed"), R("rate").alias("rate"), R("avg_interval").alias("avg_interval"))


@register("g10_loss_summary", with_views("""
    SELECT id % 3 AS lang_pair, round(sum(-score), 6) AS loss_sum, sum(len) AS sample_size, sum(len) AS ntokens,
           count(*) AS nsentences, round(sum(-score) / sum(len) / ln(2), 6) AS loss,
           round(sum(-score * 0.5) / sum(len) / ln(2), 6) AS nll_loss,
           round(sum(CASE WHEN rank = 1 THEN 1 ELSE 0 END) / count(*), 6) AS accuracy
    FROM hyp GROUP BY id % 3""", "hyp"))
def q_g10(spark, sf):
    h = views.hyp(spark, sf).select((F.col("id") % 3).alias("lang_pair"), (-F.col("score")).alias("loss"),
                                     (-F.col("score") * 0.5).alias("nll"), F.col("len").cast("long").alias("len"),
                                     F.lit(1).cast("long").alias("one"),
                                     F.when(F.col("rank") == 1, 1).otherwise(0).alias("ok"))
    d = M.loss_summary(h, ["lang_pair"], "loss", "nll", "len", "len", "one", "ok")
    return d.select("lang_pair", R("loss_sum").alias("loss_sum"), "sample_size", "ntokens", "nsentences",
                    R("loss").alias("loss"), R("nll_loss").alias("nll_loss"), R("accuracy").alias("accuracy"))


@register("g11_rollup_by_lang", with_views("""
    SELECT coalesce(lang, 'all') AS lang_pair, sum(len(tokens)) AS ntok, count(*) AS nsent
    FROM sent_tok GROUP BY ROLLUP (lang)""", "sent_tok"))
def q_g11(spark, sf):
    s = views.sent_tokens(spark, sf)
    r = s.rollup("lang").agg(F.sum(F.size("tokens")).cast("long").alias("ntok"), F.count(F.lit(1)).alias("nsent"))
    return r.select(F.coalesce("lang", F.lit("all")).alias("lang_pair"), "ntok", "nsent")


@register("g12_perplexity", with_views("""
    SELECT id % 4 AS grp, round(CASE WHEN sum(len) = 0 THEN 1e9 ELSE exp(sum(-score) / sum(len)) END, 6) AS ppl,
           round(pow(2, sum(-score) / sum(len)), 6) AS ppl2,
           round(100.0 * sum(CASE WHEN rank = 1 THEN 1 ELSE 0 END) / count(*), 6) AS acc
    FROM hyp GROUP BY id % 4""", "hyp"))
def q_g12(spark, sf):
    h = views.hyp(spark, sf)
    g = h.groupBy((F.col("id") % 4).alias("grp")).agg(
        F.sum(-F.col("score")).alias("ls"), F.sum("len").alias("n"),
        (100.0 * F.sum(F.when(F.col("rank") == 1, 1).otherwise(0)) / F.count(F.lit(1))).alias("acc"))
    return g.select("grp", R(M.perplexity(F.col("ls"), F.col("n"))).alias("ppl"),
                    R(M.perplexity(F.col("ls"), F.col("n"), base2=True)).alias("ppl2"), R("acc").alias("acc"))


@register("g13_macro_mean", with_views("""
    SELECT round(avg(acc), 6) AS macro_acc FROM (
      SELECT d.lang, avg(CASE WHEN (g.score > 0.5) = (g.gold = 1) THEN 1.0 ELSE 0.0 END) AS acc
      FROM gold g JOIN documents d ON g.id = d.doc_id GROUP BY d.lang)""", "gold"))
def q_g13(spark, sf):
    g = views.gold(spark, sf).join(read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang"), "id")
    per = g.groupBy("lang").agg(F.avg(F.when((F.col("score") > 0.5) == (F.col("gold") == 1), 1.0).otherwise(0.0)).alias("acc"))
    return per.agg(R(F.avg("acc")).alias("macro_acc"))


@register("g14_pearson", with_views("""
    SELECT round(covar_pop(score, gold) / nullif(stddev_pop(score) * stddev_pop(gold), 0), 6) AS pearson,
           round(covar_pop(score, toxic) / nullif(stddev_pop(score) * stddev_pop(toxic), 0), 6) AS pearson_toxic
    FROM gold""", "gold"))
def q_g14(spark, sf):
    g = views.gold(spark, sf)
    return g.agg(R(M.pearson("score", "gold")).alias("pearson"), R(M.pearson("score", "toxic")).alias("pearson_toxic"))


@register("g15_spearman", with_views("""
    SELECT round(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0), 6) AS spearman FROM (
      SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rx,
             rank() OVER (ORDER BY gold) + (count(*) OVER (PARTITION BY gold) - 1) / 2.0 AS ry
      FROM gold)""", "gold"))
def q_g15(spark, sf):
    return M.spearman(views.gold(spark, sf), "score", "gold").select(R("spearman").alias("spearman"))


TAG_SQL = """
    SELECT tp, tn, fp, fn,
           round(coalesce(2.0 * tn / nullif(2 * tn + fp + fn, 0), 0), 6) AS f1_bad,
           round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1_ok,
           round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0.0
                 ELSE (1.0 * tp * tn - 1.0 * fp * fn) / sqrt(1.0 * (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) END, 6) AS mcc
    FROM (SELECT sum(CASE WHEN p = 1 AND g = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN p <> 1 AND g <> 1 THEN 1 ELSE 0 END) AS tn,
                 sum(CASE WHEN p = 1 AND g <> 1 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN p <> 1 AND g = 1 THEN 1 ELSE 0 END) AS fn
          FROM (SELECT CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS p, gold AS g FROM gold))"""


@register("g16_tag_scores", with_views(TAG_SQL, "gold"))
def q_g16(spark, sf):
    t = M.tag_scores(views.gold(spark, sf), "score", "gold")
    return t.select("tp", "tn", "fp", "fn", R("f1_bad").alias("f1_bad"), R("f1_ok").alias("f1_ok"), R("mcc").alias("mcc"))


CLF_SQL = """
    WITH cm AS (SELECT g, p, count(*) * 1.0 AS c FROM base GROUP BY g, p),
    k AS (SELECT k, sum(t) AS t, sum(pp) AS pp, sum(d) AS d FROM (
            SELECT g AS k, c AS t, 0.0 AS pp, CASE WHEN g = p THEN c ELSE 0.0 END AS d FROM cm
            UNION ALL SELECT p, 0.0, c, 0.0 FROM cm) GROUP BY k),
    s AS (SELECT sum(t) AS s, sum(d) AS cor, sum(t * pp) AS tp_sum, sum(t * t) AS t2, sum(pp * pp) AS p2,
                 sum(CASE WHEN k = 1 THEN d ELSE 0 END) AS tp1, sum(CASE WHEN k = 1 THEN pp - d ELSE 0 END) AS fp1,
                 sum(CASE WHEN k = 1 THEN t - d ELSE 0 END) AS fn1 FROM k)
    SELECT round(100.0 * cor / s, 6) AS acc, round(100.0 * {f1}, 6) AS f1,
           round(100.0 * CASE WHEN (s * s - p2) * (s * s - t2) = 0 THEN 0.0
                 ELSE (cor * s - tp_sum) / sqrt((s * s - p2) * (s * s - t2)) END, 6) AS mcc FROM s"""


@register("g17_clf_scores_multiclass", with_views(CLF_SQL.format(f1="cor / s"), "emb", extra={
    "base": "SELECT label AS g, (list_position(vec, list_max(vec)) - 1) % 4 AS p FROM emb"}))
def q_g17(spark, sf):
    from tessera.functions.text import argmax
    e = views.emb(spark, sf).select(F.col("label").alias("g"), (argmax("vec") % 4).alias("p"))
    c = M.clf_scores(e, "p", "g", binary=False)
    return c.select(R("acc").alias("acc"), R("f1").alias("f1"), R("mcc").alias("mcc"))


@register("g17_clf_scores_binary", with_views(
    CLF_SQL.format(f1="coalesce(2 * tp1 / nullif(2 * tp1 + fp1 + fn1, 0), 0)"), "gold", extra={
        "base": "SELECT gold AS g, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS p FROM gold"}))
def q_g17b(spark, sf):
    g = views.gold(spark, sf).select(F.col("gold").alias("g"), F.when(F.col("score") > 0.5, 1).otherwise(0).alias("p"))
    c = M.clf_scores(g, "p", "g", binary=True)
    return c.select(R("acc").alias("acc"), R("f1").alias("f1"), R("mcc").alias("mcc"))


@register("g18_accuracy_by_lang_split", with_views("""
    SELECT CASE g.id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'dev' ELSE 'test' END AS split, d.lang,
           count(*) AS total, sum(CASE WHEN g.gold = g.toxic THEN 1 ELSE 0 END) AS valid,
           round(100.0 * sum(CASE WHEN g.gold = g.toxic THEN 1 ELSE 0 END) / count(*), 6) AS acc
    FROM gold g JOIN documents d ON g.id = d.doc_id GROUP BY ALL""", "gold"))
def q_g18(spark, sf):
    g = views.gold(spark, sf).join(read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang"), "id")
    g = g.withColumn("split", F.when(F.col("id") % 3 == 0, "train").when(F.col("id") % 3 == 1, "dev").otherwise("test"))
    a = M.accuracy_by(g, ["split", "lang"], "gold", "toxic")
    return a.select("split", "lang", "total", "valid", R("acc").alias("acc"))


@register("g21_row_losses", with_views("""
    SELECT round(sum((score - gold) * (score - gold)), 6) AS mse,
           round(sum(greatest(score * 4 - 2, 0) - (score * 4 - 2) * gold + ln(1 + exp(-abs(score * 4 - 2)))), 6) AS bce,
           round(sum((1 - 0.1) * (-ln(score + 0.01)) + (0.1 / 100) * (-ln(score + 0.01) * 3)), 6) AS smoothed
    FROM gold""", "gold"))
def q_g21(spark, sf):
    g = views.gold(spark, sf)
    lp = F.log(F.col("score") + 0.01)
    sm, _ = M.smoothed_nll(lp, lp * 3, 0.1, 100)
    return g.agg(R(F.sum(M.mse("score", "gold"))).alias("mse"),
                 R(F.sum(M.bce(F.col("score") * 4 - 2, F.col("gold")))).alias("bce"),
                 R(F.sum(sm)).alias("smoothed"))


@register("g22_quantile_loss", with_views("""
    SELECT round(sum(CASE WHEN gold - score > 0 THEN 0.4 * (gold - score) ELSE -0.6 * (gold - score) END), 6) AS qloss
    FROM gold""", "gold"))
def q_g22(spark, sf):
    g = views.gold(spark, sf)
    return g.agg(R(F.sum(M.quantile_loss("score", "gold", 0.6))).alias("qloss"))


@register("j08_score_join", """
    SELECT count(l.doc_id) AS matched, sum(CASE WHEN l.doc_id IS NULL THEN 1 ELSE 0 END) AS missing_gold,
           round(covar_pop((d.n_chars % 100) / 100.0, l.quality)
                 / nullif(stddev_pop(CASE WHEN l.doc_id IS NOT NULL THEN (d.n_chars % 100) / 100.0 END)
                          * stddev_pop(l.quality), 0), 6) AS pearson
    FROM documents d LEFT JOIN labels l USING (doc_id)""")
def q_j08(spark, sf):
    pred = read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"),
                                                    (F.pmod("n_chars", F.lit(100)) / 100.0).alias("pred"))
    gold = read_table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("gold"))
    j = M.score_join_left(pred, gold)
    return j.agg(F.count("gold").alias("matched"),
                 F.sum(F.when(F.col("gold").isNull(), 1).otherwise(0)).cast("long").alias("missing_gold"),
                 R(M.pearson("pred", "gold")).alias("pearson"))


@register("g19_bleu", with_views("""
    WITH d0 AS (SELECT sid AS id, list_filter(ids, lambda x, i: (i - 1) % 5 <> 2) AS h, ids AS r FROM ids),
    lt AS (SELECT id, h[coalesce(list_position(list_transform(h, lambda x: x <> 1), true), len(h) + 1):] AS h,
                      r[coalesce(list_position(list_transform(r, lambda x: x <> 1), true), len(r) + 1):] AS r FROM d0),
    rt AS (SELECT id,
             (CASE WHEN len(h) > 1 THEN h[1:greatest(1, len(h) - coalesce(list_position(list_transform(list_reverse(h), lambda x: x <> 1 AND x <> 2), true), len(h)) + 1)] ELSE h END) AS h,
             (CASE WHEN len(r) > 1 THEN r[1:greatest(1, len(r) - coalesce(list_position(list_transform(list_reverse(r), lambda x: x <> 1 AND x <> 2), true), len(r)) + 1)] ELSE r END) AS r
           FROM lt),
    tr AS (SELECT id, h, list_transform(r, lambda x: CASE WHEN x = 3 THEN -999 ELSE x END) AS r FROM rt),
    ng AS (SELECT 1 AS n UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4),
    g AS (SELECT id, n, unnest(list_transform(range(1, len(h) - n + 2), lambda i: array_to_string(h[i:i + n - 1], ' '))) AS gram, 1 AS ch, 0 AS cr FROM tr, ng
          UNION ALL
          SELECT id, n, unnest(list_transform(range(1, len(r) - n + 2), lambda i: array_to_string(r[i:i + n - 1], ' '))), 0, 1 FROM tr, ng),
    c AS (SELECT n, sum(least(ch, cr)) AS m, sum(ch) AS t FROM (SELECT id, n, gram, sum(ch) AS ch, sum(cr) AS cr FROM g GROUP BY ALL) GROUP BY n),
    s AS (SELECT (SELECT sum(len(h)) FROM tr) AS predlen, (SELECT sum(len(r)) FROM tr) AS reflen,
                 (SELECT m FROM c WHERE n = 1) AS m1, (SELECT m FROM c WHERE n = 2) AS m2,
                 (SELECT m FROM c WHERE n = 3) AS m3, (SELECT m FROM c WHERE n = 4) AS m4,
                 (SELECT t FROM c WHERE n = 1) AS c1, (SELECT t FROM c WHERE n = 2) AS c2,
                 (SELECT t FROM c WHERE n = 3) AS c3, (SELECT t FROM c WHERE n = 4) AS c4)
    SELECT predlen, reflen, m1, m2, m3, m4, c1, c2, c3, c4,
           round(least(1.0, exp(1 - reflen / predlen)), 6) AS bp,
           round(CASE WHEN m1 = 0 OR m2 = 0 OR m3 = 0 OR m4 = 0 THEN 0.0
                 ELSE least(1.0, exp(1 - reflen / predlen)) * exp((ln(m1 / c1) + ln(m2 / c2) + ln(m3 / c3) + ln(m4 / c4)) / 4) * 100 END, 6) AS bleu
    FROM s""", "ids"))
def q_g19(spark, sf):
    d = views.ids(spark, sf).select(F.col("sid").alias("id"), F.filter("ids", lambda x, i: i % 5 != 2).alias("h"),
                                    F.col("ids").alias("r"))
    b = B.bleu(d, "id", "h", "r")
    return b.select(*[c for c in b.columns if c not in ("bp", "bleu")], R("bp").alias("bp"), R("bleu").alias("bleu"))


@register("g20_bleu_multi_ref", with_views("""
    WITH h AS (SELECT sid AS id, list_transform(list_filter(tokens, lambda x, i: (i - 1) % 7 <> 3), lambda x: lower(x)) AS t FROM sent_tok),
    r AS (SELECT sid AS id, 0 AS ref, list_transform(tokens, lambda x: lower(x)) AS t FROM sent_tok
          UNION ALL SELECT sid, 1, list_transform(list_filter(tokens, lambda x, i: (i - 1) % 5 <> 1), lambda x: lower(x)) FROM sent_tok),
    ng AS (SELECT 1 AS n UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4),
    hc AS (SELECT id, n, gram, count(*) AS ch FROM (
             SELECT id, n, unnest(list_transform(range(1, len(t) - n + 2), lambda i: array_to_string(t[i:i + n - 1], chr(1)))) AS gram FROM h, ng)
           GROUP BY ALL),
    rc AS (SELECT id, n, gram, max(c) AS cr FROM (SELECT id, ref, n, gram, count(*) AS c FROM (
             SELECT id, ref, n, unnest(list_transform(range(1, len(t) - n + 2), lambda i: array_to_string(t[i:i + n - 1], chr(1)))) AS gram FROM r, ng)
           GROUP BY ALL) GROUP BY ALL),
    c AS (SELECT n, sum(least(ch, coalesce(cr, 0))) AS m, sum(ch) AS t FROM hc LEFT JOIN rc USING (id, n, gram) GROUP BY n),
    cl AS (SELECT sum(hl) AS predlen, sum(rl) AS reflen FROM (
             SELECT h.id, len(h.t) AS hl, arg_min(len(r.t), abs(len(r.t) - len(h.t)) * 100000 + len(r.t)) AS rl
             FROM h JOIN r USING (id) GROUP BY h.id, len(h.t))),
    s AS (SELECT predlen, reflen, (SELECT m FROM c WHERE n = 1) AS m1, (SELECT m FROM c WHERE n = 2) AS m2,
                 (SELECT m FROM c WHERE n = 3) AS m3, (SELECT m FROM c WHERE n = 4) AS m4,
                 (SELECT t FROM c WHERE n = 1) AS c1, (SELECT t FROM c WHERE n = 2) AS c2,
                 (SELECT t FROM c WHERE n = 3) AS c3, (SELECT t FROM c WHERE n = 4) AS c4 FROM cl)
    SELECT predlen, reflen, m1, m2, m3, m4, c1, c2, c3, c4,
           round(least(1.0, exp(1 - reflen / predlen)), 6) AS bp,
           round(CASE WHEN reflen = 0 OR m1 = 0 OR m2 = 0 OR m3 = 0 OR m4 = 0 THEN 0.0
                 ELSE least(1.0, exp(1 - reflen / predlen)) * exp((ln(m1 / c1) + ln(m2 / c2) + ln(m3 / c3) + ln(m4 / c4)) / 4) * 100 END, 6) AS bleu
    FROM s""", "sent_tok"))
def q_g20(spark, sf):
    s = views.sent_tokens(spark, sf)
    hyp = s.select(F.col("sid").alias("id"), F.filter("tokens", lambda x, i: i % 7 != 3).alias("tokens"))
    refs = (s.select(F.col("sid").alias("id"), F.lit(0).alias("ref"), "tokens")
            .unionByName(s.select(F.col("sid").alias("id"), F.lit(1).alias("ref"),
                                  F.filter("tokens", lambda x, i: i % 5 != 1).alias("tokens"))))
    b = B.bleu_multi(hyp, refs, "id", lowercase=True)
    return b.select(*[c for c in b.columns if c not in ("bp", "bleu")], R("bp").alias("bp"), R("bleu").alias("bleu"))


@register("g26_usage_histogram", with_views("""
    SELECT c.c_custkey AS slot, round(coalesce(u.u, 0.0), 6) AS u, round(coalesce(u.u, 0.0) / (SELECT sum(o_totalprice) FROM orders), 6) AS p
    FROM customer c LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS u FROM orders GROUP BY o_custkey) u
    ON c.c_custkey = u.o_custkey"""))
def q_g26(spark, sf):
    slots = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("slot"))
    use = read_table(spark, sf, "orders").select(F.col("o_custkey").alias("slot"), F.col("o_totalprice").alias("w"))
    h = M.usage_histogram(use, "slot", "w", slots)
    return h.select("slot", R("u").alias("u"), R("p").alias("p"))


@register("g27_usage_stats", with_views("""
    WITH h AS (SELECT c.c_custkey AS slot, coalesce(u.u, 0.0) / (SELECT sum(o_totalprice) FROM orders) AS x
               FROM customer c LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS u FROM orders GROUP BY o_custkey) u
               ON c.c_custkey = u.o_custkey),
    a AS (SELECT slot, x, sum(x) OVER (ORDER BY x, slot ROWS UNBOUNDED PRECEDING) AS y FROM h)
    SELECT round(100.0 * sum(CASE WHEN x <> 0 THEN 1 ELSE 0 END) / count(*), 6) AS used_pct,
           round(ln(count(*)) + sum(CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END), 6) AS kl_uniform,
           round(1 - 2 * avg(y), 6) AS gini,
           sum(CASE WHEN y >= 0.5 THEN 1 ELSE 0 END) AS top50, sum(CASE WHEN y >= 0.1 THEN 1 ELSE 0 END) AS top90,
           sum(CASE WHEN y >= 0.01 THEN 1 ELSE 0 END) AS top99
    FROM a"""))
def q_g27(spark, sf):
    slots = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("slot"))
    use = read_table(spark, sf, "orders").select(F.col("o_custkey").alias("slot"), F.col("o_totalprice").alias("w"))
    st = M.usage_stats(M.usage_histogram(use, "slot", "w", slots), "slot")
    return st.select(R("used_pct").alias("used_pct"), R("kl_uniform").alias("kl_uniform"), R("gini").alias("gini"),
                     "top50", "top90", "top99")


@register("g28_class_weights", """
    SELECT quality, round((1.0 / count(*)) / sum(1.0 / count(*)) OVER (), 6) AS weight FROM labels GROUP BY quality""")
def q_g28(spark, sf):
    w = M.class_weights(read_table(spark, sf, "labels"), "quality")
    return w.select("quality", R("weight").alias("weight"))


@register("g30_sampling_probs", with_views("""
    SELECT lang, n, round(q / sum(q) OVER (), 6) AS prob FROM (
      SELECT lang, n, pow(n * 1.0 / sum(n) OVER (), 0.5) AS q FROM (SELECT lang, count(*) AS n FROM sent GROUP BY lang))""", "sent"))
def q_g30(spark, sf):
    p = M.sampling_probs(views.sent(spark, sf), "lang", 0.5)
    return p.select("lang", "n", R("prob").alias("prob"))


@register("w05_logsumexp", with_views("""
    SELECT id, round(max(score) + ln(sum(exp(score - m))), 6) AS lse FROM (
      SELECT id, score, max(score) OVER (PARTITION BY id) AS m FROM hyp) GROUP BY id""", "hyp"))
def q_w05(spark, sf):
    return M.logsumexp(views.hyp(spark, sf), ["id"], "score").select("id", R("lse").alias("lse"))
