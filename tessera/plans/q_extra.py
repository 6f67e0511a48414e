"""Queries: B-38, G-29, G-34, G-36, J-07, J-16, L-05, W-13, E-03, E-05, E-07, H-01, H-03..H-05, A-06, A-13, A-14."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import extras as X
from tessera.operators import ids as I
from tessera.operators import knn as K
from tessera.operators.batching import pad_to_batch
from tessera.plans import views
from tessera.plans.oracle import with_views
from tessera.plans.q_pairing import HU
from tessera.plans.q_shaping import ROWS_SQL, sent_rows
from tessera.plans.registry import register
from tessera.session import read_table
from tessera.sources import text as S


def R(c, k=6):
    return F.round(F.col(c) if isinstance(c, str) else c, k)


def J(c):
    c = F.col(c) if isinstance(c, str) else c
    return F.array_join(c.cast("array<string>"), " ")


@register("b38_fan_out", with_views("""
    SELECT sid, e AS expert, array_to_string(list_concat([100 + e], ids[2:]), ' ') AS ids
    FROM ids, (SELECT unnest(range(3)) AS e)""", "ids"))
def q_b38(spark, sf):
    d = X.fan_out(views.ids(spark, sf), "ids", 3, 100)
    return d.select("sid", F.col("expert").cast("bigint").alias("expert"), J("ids").alias("ids"))


@register("g29_label_index", """
    SELECT d.doc_id, CAST(dense_rank() OVER (ORDER BY d.source) - 1 AS BIGINT) AS label_id FROM documents d""")
def q_g29(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "source")
    idx = X.label_index(d, "source")
    return d.join(idx, "source").select("doc_id", F.col("label_id").cast("bigint").alias("label_id"))


@register("g29_label_ids", """
    WITH d AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE source END AS label FROM documents),
    i AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS label_id FROM (SELECT DISTINCT label FROM d WHERE label <> '' AND doc_id % 3 > 0))
    SELECT d.doc_id, coalesce(i.label_id, 0) AS label_id FROM d LEFT JOIN i USING (label)""")
def q_g29_ids(spark, sf):
    """Labels of two thirds of the documents make the index; empty and unseen ones are 0."""
    label = F.when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise(F.col("source"))
    d = read_table(spark, sf, "documents").select("doc_id", label.alias("label"))
    return X.label_ids(d, X.label_index(d.filter(F.col("doc_id") % 3 > 0), "label", skip_empty=True), "label").select("doc_id", "label_id")


@register("g34_batch_stats", with_views("""
    SELECT row_id // 16 AS batch, count(*) AS nsentences, sum(ntok) AS ntokens, sum(ntok) AS sample_size
    FROM rows GROUP BY row_id // 16""", "sent_tok", extra=ROWS_SQL))
def q_g34(spark, sf):
    r = sent_rows(spark, sf).withColumn("batch", F.floor(F.col("row_id") / 16))
    return X.batch_stats(r, "batch", "ntok", None)


@register("g36_combine_losses", """
    SELECT user_id AS run, round(sum(CASE event_type WHEN 'click' THEN 0.5 WHEN 'view' THEN 1.0 ELSE 2.0 END * value), 6) AS loss,
           count(*) AS sample_size
    FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY user_id""")
def q_g36(spark, sf):
    ev = read_table(spark, sf, "events").select(F.col("user_id").alias("run"), "event_type", "value",
                                                F.lit(1).alias("one"))
    c = X.combine_losses(ev, ["run"], "event_type", "value", "one",
                         {"click": 0.5, "view": 1.0, "purchase": 2.0, "error": 0.0})
    return c.select("run", R("loss").alias("loss"), F.col("sample_size").cast("long").alias("sample_size"))


@register("j07_sampled_zip", with_views(f"""
    WITH a AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS row FROM pair),
    b AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS row FROM (SELECT doc_id AS id FROM labels)),
    n AS (SELECT (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb),
    p AS (SELECT j, j // 32 AS batch, CAST(floor({HU(41, 'j // 32')} * 2) AS INTEGER) AS corpus FROM n, range(na + nb) t(j))
    SELECT p.j, p.batch, p.corpus, coalesce(a.id, b.id) AS id FROM p, n
    LEFT JOIN a ON p.corpus = 0 AND a.row = p.j % n.na
    LEFT JOIN b ON p.corpus = 1 AND b.row = p.j % n.nb""", "pair"))
def q_j07(spark, sf):
    a = views.pair(spark, sf).select("id")
    a = I.with_row_id(a, [F.col("id")], *I.int_key_buckets("id"), out="row")
    b = read_table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    b = I.with_row_id(b, [F.col("id")], *I.int_key_buckets("id"), out="row")
    na, nb = a.count(), b.count()  # corpus lengths (scalars)
    z = X.sampled_zip([a, b], [na, nb], 32, 41)
    return z.select("j", F.col("batch").cast("long").alias("batch"), "corpus", "id")


@register("j16_knn_heads", with_views("""
    SELECT head, qid, kid, rank, round(score, 6) AS score FROM (
      SELECT q.label % 2 AS head, q.id AS qid, k.id AS kid, list_dot_product(q.vec, k.vec) AS score,
             row_number() OVER (PARTITION BY q.id ORDER BY list_dot_product(q.vec, k.vec) DESC, k.id) AS rank
      FROM emb q JOIN emb k ON q.label % 2 = k.label % 2) WHERE rank <= 3""", "emb"))
def q_j16(spark, sf):
    e = views.emb(spark, sf).select("id", "vec", (F.col("label") % 2).alias("head"))
    r = K.knn_heads(e, e, heads=2, k=3)
    return r.select("head", "qid", "kid", F.col("rank").cast("long").alias("rank"), R("score").alias("score"))


@register("l05_restore_order", "SELECT doc_id AS id, quality FROM labels ORDER BY doc_id")
def q_l05(spark, sf):
    return read_table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality").orderBy("id")


@register("w13_with_context", with_views("""
    WITH o AS (SELECT sid, doc_id, line_no, tokens, coalesce(sum(len(tokens)) OVER (ORDER BY doc_id, line_no
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM sent_tok),
    t AS (SELECT start + unnest(range(len(tokens))) AS off, unnest(tokens) AS tok FROM o),
    c AS (SELECT o.sid, string_agg(t.tok, ' ' ORDER BY t.off) AS ctx FROM o JOIN t ON t.off >= o.start - 8 AND t.off < o.start
          GROUP BY o.sid)
    SELECT o.sid, o.start, coalesce(c.ctx, '') AS context FROM o LEFT JOIN c USING (sid)""", "sent_tok"))
def q_w13(spark, sf):
    s = views.sent_tokens(spark, sf).select("sid", "doc_id", "line_no", "tokens")
    fine, coarse = I.pair_key_buckets("doc_id", "line_no")
    c = X.with_context(s, "sid", "tokens", 8, [F.col("doc_id"), F.col("line_no")], fine, coarse)
    return c.select("sid", "start", F.array_join("context", " ").alias("context"))


@register("w13_kept_context", with_views("""
    WITH o AS (SELECT sid, doc_id, line_no, tokens, len(tokens) AS n, CAST(coalesce(sum(len(tokens)) OVER (ORDER BY doc_id, line_no
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM sent_tok),
    k AS (SELECT *, CAST(least(8, start, greatest(0, 20 - n)) AS BIGINT) AS kept FROM o),
    t AS (SELECT start + unnest(range(len(tokens))) AS off, unnest(tokens) AS tok FROM o),
    need AS (SELECT sid, start - 1 - unnest(range(kept)) AS off FROM k),
    c AS (SELECT need.sid, list(t.tok ORDER BY t.off) AS ctx FROM need JOIN t USING (off) GROUP BY need.sid)
    SELECT k.sid, array_to_string(list_concat(list_concat(coalesce(c.ctx, []), k.tokens), list_transform(range(8 - kept), lambda i: '<pad>')), ' ') AS source,
           CAST(kept AS BIGINT) AS start_index, CAST(kept + n AS BIGINT) AS length FROM k LEFT JOIN c USING (sid)""", "sent_tok"))
def q_w13_kept(spark, sf):
    s = views.sent_tokens(spark, sf).select("sid", "doc_id", "line_no", "tokens")
    c = X.with_kept_context(s, "sid", "tokens", 8, 12, ["doc_id", "line_no"])
    return c.select("sid", F.array_join("source", " ").alias("source"), F.col("start_index").cast("long").alias("start_index"), F.col("length").cast("long").alias("length"))


ROWS_IDS = {"r": """
    SELECT i.sid, i.ids, (row_number() OVER (ORDER BY s.doc_id, s.line_no) - 1) AS row_id
    FROM ids i JOIN sent s USING (sid)"""}


def ids_rows(spark, sf):
    d = views.ids(spark, sf).join(views.sent(spark, sf).select("sid", "doc_id", "line_no"), "sid")
    fine, coarse = I.pair_key_buckets("doc_id", "line_no")
    return I.with_row_id(d, [F.col("doc_id"), F.col("line_no")], fine, coarse)


@register("e03_pad_tags", with_views("""
    SELECT sid, array_to_string(list_concat(t, list_transform(range(m - len(t)), lambda i: -1)), ' ') AS tags_padded FROM (
      SELECT sid, t, max(len(t)) OVER (PARTITION BY row_id // 16) AS m FROM (
        SELECT sid, row_id, list_transform(ids, lambda x: x % 2) AS t FROM r))""", "sent", "ids", extra=ROWS_IDS))
def q_e03(spark, sf):
    d = ids_rows(spark, sf).withColumn("batch", F.floor(F.col("row_id") / 16)).withColumn(
        "t", F.transform("ids", lambda x: x % 2))
    return X.pad_tags(d, "batch", "t").select("sid", J("tags_padded").alias("tags_padded"))


@register("e05_collate_mono", with_views("""
    SELECT sid, array_to_string(list_concat(src, list_transform(range(m - len(src)), lambda i: 1)), ' ') AS source,
           array_to_string(list_concat(ids, list_transform(range(m - len(ids)), lambda i: 1)), ' ') AS target FROM (
      SELECT sid, ids, src, max(len(ids)) OVER (PARTITION BY row_id // 16) AS m FROM (
        SELECT sid, row_id, ids, list_prepend(2, ids[1:len(ids) - 1]) AS src FROM r))""",
    "sent", "ids", extra=ROWS_IDS))
def q_e05(spark, sf):
    from tessera.functions.arrays import lm_source
    d = ids_rows(spark, sf).withColumn("batch", F.floor(F.col("row_id") / 16)).withColumn("src", lm_source("ids", 2))
    d = pad_to_batch(d, "batch", "src", pad=1).withColumnRenamed("padded", "source")
    d = pad_to_batch(d, "batch", "ids", pad=1).withColumnRenamed("padded", "target")
    return d.select("sid", J("source").alias("source"), J("target").alias("target"))


@register("e07_crop_to_batch", with_views(f"""
    SELECT sid, array_to_string(ids[st:st + t - 1], ' ') AS cropped FROM (
      SELECT sid, ids, t, CAST(floor({HU(43, 'sid')} * (len(ids) - t + 1)) AS BIGINT) + 1 AS st FROM (
        SELECT sid, ids, min(len(ids)) OVER (PARTITION BY row_id // 16) AS t FROM r))""", "sent", "ids", extra=ROWS_IDS))
def q_e07(spark, sf):
    d = ids_rows(spark, sf).withColumn("batch", F.floor(F.col("row_id") / 16))
    return X.crop_to_batch(d, "batch", "sid", "ids", 43).select("sid", J("cropped").alias("cropped"))


def _split_suffix(words: pd.Series) -> pd.Series:
    """Example sub-word encoder: lower-case, then 4-character pieces."""
    return words.str.lower().map(lambda w: [w[i:i + 4] for i in range(0, len(w), 4)])


@register("h01_word_tokenizer", with_views("""
    SELECT sid, coalesce(string_agg(p, ' ' ORDER BY pos, k), '') AS pieces FROM (
      SELECT t.sid, t.pos, u.k, substr(lower(t.tok), u.k * 4 + 1, 4) AS p FROM tok t,
             LATERAL (SELECT unnest(range(CAST(ceil(length(t.tok) / 4.0) AS BIGINT))) AS k) u)
    GROUP BY sid""", "tok"))
def q_h01(spark, sf):
    s = views.sent_tokens(spark, sf).select("sid", "tokens").filter(F.size("tokens") > 0)
    return X.apply_word_tokenizer(s, "tokens", _split_suffix).select("sid", F.array_join("pieces", " ").alias("pieces"))


def _provider(pdf: pd.DataFrame) -> pd.DataFrame:
    """Example score provider: one log-prob per token position."""
    rows = [(sid, i, float(-np.log(x + 2.0))) for sid, ids in zip(pdf["sid"], pdf["ids"]) for i, x in enumerate(ids)]
    return pd.DataFrame(rows, columns=["sid", "pos", "lprob"])


@register("h03_score_provider", with_views("""
    SELECT sid, unnest(range(len(ids))) AS pos, round(-ln(unnest(ids) + 2.0), 6) AS lprob FROM ids""", "ids"))
def q_h03(spark, sf):
    s = X.score_with(views.ids(spark, sf), _provider, "sid long, pos long, lprob double")
    return s.select("sid", "pos", R("lprob").alias("lprob"))


def _turn_stats(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"conv_id": [int(pdf["conv_id"].iloc[0])], "turns": [len(pdf)],
                         "chars": [int(pdf["text"].str.len().sum())]})


@register("h04_apply_grouped", """
    SELECT conv_id, count(*) AS turns, sum(length(text)) AS chars FROM conversations GROUP BY conv_id""")
def q_h04(spark, sf):
    c = read_table(spark, sf, "conversations").select("conv_id", "text")
    return X.apply_grouped(c, ["conv_id"], _turn_stats, "conv_id long, turns long, chars long")


@register("h05_sample_by", with_views(f"""
    SELECT sid, row_id // 16 AS batch FROM rows WHERE {HU(47, 'row_id // 16')} < 0.25""", "sent_tok", extra=ROWS_SQL))
def q_h05(spark, sf):
    from tessera.operators.shaping import hash_uniform
    r = sent_rows(spark, sf).withColumn("batch", F.floor(F.col("row_id") / 16))
    keep = hash_uniform(47, "batch") < 0.25  # a sampler is a predicate on the batch id
    return X.sample_by(r, keep).select("sid", F.col("batch").cast("long").alias("batch"))


@register("a06_a14_read_scores_labels", with_views("""
    SELECT r.row_id AS id, round(g.score, 6) AS score, CAST(g.gold AS VARCHAR) AS label
    FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS row_id FROM gold) r JOIN gold g USING (id)""", "gold"))
def q_a06(spark, sf):
    g = views.gold(spark, sf)
    p1, p2 = S.scratch_path(spark, "scores"), S.scratch_path(spark, "labels")
    S.write_lines(g.select("id", F.format_string("%.6f", "score").alias("l")), "id", "l", p1)
    S.write_lines(g.select("id", F.concat(F.col("gold").cast("string"), F.lit(" ")).alias("l")), "id", "l", p2)
    sc = S.read_scores(spark, p1)
    lab = S.read_labels(spark, p2)
    return sc.join(lab, "id").select("id", R("score").alias("score"), "label")


@register("a13_read_manifest", """
    SELECT '/corpus/audio' AS root, 'utt' || CAST(doc_id AS VARCHAR) || '.wav' AS fname, n_chars AS size FROM documents""")
def q_a13(spark, sf):
    d = read_table(spark, sf, "documents")
    lines = d.select(F.col("doc_id").alias("k"), F.concat_ws("\t", F.concat(F.lit("utt"), F.col("doc_id").cast("string"),
                                                                          F.lit(".wav")), F.col("n_chars").cast("string")).alias("l"))
    header = d.agg(F.min("doc_id").alias("m")).select((F.col("m") - 1).alias("k"), F.lit("/corpus/audio").alias("l"))
    path = S.scratch_path(spark, "manifest")
    S.write_lines(header.unionByName(lines), "k", "l", path)
    return S.read_manifest(spark, path)


@register("e02_collate_qe", with_views("""
    WITH p AS (SELECT id, list_transform(s, lambda x: x) AS s, t, (len(t) % 10) / 10.0 AS ter,
                      row_number() OVER (ORDER BY id) - 1 AS rn FROM pids),
    q AS (SELECT id, ter, rn // 8 AS batch, list_concat([1], s, [1, 1], t, [1]) AS seq,
                 list_concat(list_transform(range(len(s) + 2), lambda i: 0), list_transform(range(len(t) + 2), lambda i: 1)) AS mask,
                 list_concat(list_transform(range(len(s) + 2), lambda i: 14), list_transform(range(len(t) + 2), lambda i: 4)) AS lg
          FROM p),
    m AS (SELECT *, max(len(seq)) OVER (PARTITION BY batch) AS mx FROM q)
    SELECT id, round(ter, 6) AS ter,
           array_to_string(list_concat(seq, list_transform(range(mx - len(seq)), lambda i: 2)), ' ') AS net_input,
           array_to_string(list_concat(mask, list_transform(range(mx - len(seq)), lambda i: 0)), ' ') AS xml_mask,
           array_to_string(list_concat(lg, list_transform(range(mx - len(seq)), lambda i: 4)), ' ') AS langs
    FROM m""", "pair", extra=__import__("tessera.plans.q_text", fromlist=["PAIR_IDS_SQL"]).PAIR_IDS_SQL))
def q_e02(spark, sf):
    from tessera.plans.q_text import pair_ids
    p = pair_ids(spark, sf).withColumn("ter", (F.size("t") % 10) / 10.0)
    p = I.with_row_id(p, [F.col("id")], *I.int_key_buckets("id"), out="rn").withColumn("batch", F.floor(F.col("rn") / 8))
    c = X.collate_qe(p, "batch", "s", "t", "ter", eos=1, pad=2)
    return c.select("id", R("ter").alias("ter"), J("net_input").alias("net_input"), J("xml_mask").alias("xml_mask"),
                    J("langs").alias("langs"))


@register("h02_learn_apply_bpe", with_views("""
    WITH RECURSIVE t AS (SELECT sid, unnest(list_transform(tokens, lambda t: lower(t))) AS w, unnest(range(len(tokens))) AS pos FROM sent_tok),
    -- a symbol is written between chr(1) and chr(2), so that merging a pair is a plain replacement
    learn AS (
        SELECT 0 AS step, w, chr(1) || array_to_string(string_split(w, ''), chr(2) || chr(1)) || chr(2) AS s, count(*) AS c FROM t GROUP BY w
        UNION ALL
        SELECT step + 1, w, coalesce(replace(s, chr(1) || best.a || chr(2) || chr(1) || best.b || chr(2), chr(1) || best.a || best.b || chr(2)), s), c
        FROM learn LEFT JOIN (
            SELECT a, b FROM (
                SELECT unnest(l[:-2]) AS a, unnest(l[2:]) AS b, c FROM (SELECT string_split(s[2:-2], chr(2) || chr(1)) AS l, c FROM learn) WHERE len(l) > 1)
            GROUP BY a, b HAVING sum(c) >= 2 ORDER BY sum(c) DESC, a, b LIMIT 1) best ON true
        WHERE step < 20),
    done AS (SELECT w, replace(s[2:-2], chr(2) || chr(1), ' ') AS pieces FROM learn WHERE step = 20)
    SELECT sid, string_agg(pieces, ' ' ORDER BY pos) AS pieces FROM t JOIN done USING (w) GROUP BY sid""", "sent_tok"))
def q_h02(spark, sf):
    """Learn 20 merges from the corpus word counts (lower-cased tokens) and
    segment every line with them."""
    from tessera.operators.bpe import learn_merges, merges_applier
    s = views.sent_tokens(spark, sf).select("sid", F.transform("tokens", lambda t: F.lower(t)).alias("tokens"))
    counts = s.select(F.explode_outer("tokens").alias("w")).filter(F.col("w").isNotNull()).groupBy("w").agg(
        F.count(F.lit(1)).alias("c"))
    merges = learn_merges(counts, "w", "c", 20)
    # lines are dealt by id as they are; the operator groups their words where they then lie
    lines = views.sent(spark, sf).filter(F.col("text").rlike(T.TOKEN_START)).select("sid", "text").repartition("sid")
    words = lines.select("sid", F.transform(T.tokenize("text"), lambda t: F.lower(t)).alias("tokens"))
    seg = X.apply_word_tokenizer(words, "tokens", merges_applier(merges))
    return seg.select("sid", F.array_join("pieces", " ").alias("pieces"))


@register("j15_knn_product_keys", with_views("""
    WITH h1 AS (SELECT qid, kid, score FROM (
        SELECT q.id AS qid, k.id AS kid, list_dot_product(q.vec[1:32], k.vec[1:32]) AS score,
               row_number() OVER (PARTITION BY q.id ORDER BY list_dot_product(q.vec[1:32], k.vec[1:32]) DESC, k.id) AS r
        FROM emb q, emb k) WHERE r <= 6),
    h2 AS (SELECT qid, kid, score FROM (
        SELECT q.id AS qid, k.id AS kid, list_dot_product(q.vec[33:64], k.vec[33:64]) AS score,
               row_number() OVER (PARTITION BY q.id ORDER BY list_dot_product(q.vec[33:64], k.vec[33:64]) DESC, k.id) AS r
        FROM emb q, emb k) WHERE r <= 6),
    c AS (SELECT h1.qid, h1.kid * (SELECT max(id) + 1 FROM emb) + h2.kid AS kid, h1.score + h2.score AS score FROM h1 JOIN h2 USING (qid))
    SELECT qid, kid, rank, round(score, 6) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, kid) AS rank FROM c) WHERE rank <= 6""", "emb"))
def q_j15(spark, sf):
    e = views.emb(spark, sf)
    a = e.select("id", F.slice("vec", 1, 32).alias("vec"))
    b = e.select("id", F.slice("vec", 33, 32).alias("vec"))
    r = K.knn_product(a, b, a, b, k=6)
    return r.select("qid", "kid", F.col("rank").cast("long").alias("rank"), R("score").alias("score"))


# words of two ids each (the last one alone): spans and tags of a pair
WORD_QE_SQL = {
    "wq": """SELECT id, s, t, (row_number() OVER (ORDER BY id) - 1) // 8 AS batch,
        list_transform(range((len(t) + 1) // 2), lambda w: {'start': 2 * w, 'end': least(2 * w + 1, len(t) - 1)}) AS spans,
        list_transform(range((len(s) + 1) // 2), lambda w: {'start': 2 * w, 'end': least(2 * w + 1, len(s) - 1)}) AS src_spans,
        list_transform(range((len(t) + 1) // 2), lambda w: t[2 * w + 1] % 2) AS wt,
        list_transform(range((len(t) + 1) // 2 + 1), lambda w: w % 2) AS gt,
        list_transform(range((len(s) + 1) // 2), lambda w: s[2 * w + 1] % 2) AS st FROM pids""",
    "wm": """SELECT *, max(len(t)) OVER b AS tm, greatest(max(len(s) + len(t) + 4) OVER b, max(len(s)) OVER b + 3 + max(len(t)) OVER b) AS w,
        max(len(spans)) OVER b AS mb, max(len(src_spans)) OVER b AS ms,
        row_number() OVER (PARTITION BY batch ORDER BY len(s) DESC, id) - 1 AS place FROM wq WINDOW b AS (PARTITION BY batch)""",
}


def _padded(expr: str, value: int, size: str) -> str:
    return f"array_to_string(list_concat({expr}, list_transform(range({size} - len({expr})), lambda i: {value})), ' ')"


@register("e03_collate_word_qe", with_views(f"""
    SELECT batch, id, place, {_padded("list_concat([1], s, [1, 1], t, [1])", 2, "w")} AS net_input,
           {_padded("list_concat(list_transform(range(len(s) + 3), lambda i: 0), list_transform(range(tm), lambda i: 1))[1:w]", 0, "w")} AS xml_mask,
           {_padded("list_transform(range(len(s) + 2), lambda i: 14)", 4, "w")} AS langs,
           {_padded("t", 2, "tm")} AS target, {_padded("list_concat(t[len(t):], t[1:len(t) - 1])", 2, "tm")} AS prev_output,
           {_padded("wt", -1, "mb")} AS word_tags, {_padded("gt", -1, "(mb + 1)")} AS gap_tags, {_padded("st", -1, "ms")} AS src_tags,
           array_to_string(list_transform(spans, lambda x: x.start || '-' || x."end"), ' ') AS spans,
           array_to_string(list_transform(src_spans, lambda x: x.start || '-' || x."end"), ' ') AS src_spans,
           len(s) AS src_length, len(t) AS tgt_length
    FROM wm""", "pair", extra={**__import__("tessera.plans.q_text", fromlist=["PAIR_IDS_SQL"]).PAIR_IDS_SQL, **WORD_QE_SQL}))
def q_e03w(spark, sf):
    from tessera.plans.q_text import pair_ids
    p = I.with_row_id(pair_ids(spark, sf), [F.col("id")], out="rn").withColumn("batch", F.floor(F.col("rn") / 8))

    def words(c):
        return F.transform(F.slice(F.sequence(F.lit(0), F.size(c)), 1, F.floor((F.size(c) + 1) / 2).cast("int")), lambda w: F.struct(
            (2 * w).alias("start"), F.least(2 * w + 1, F.size(c) - 1).alias("end")))

    def tags(c, spans):
        return F.transform(spans, lambda x: F.get(F.col(c), x["start"]) % 2)

    d = p.select("id", "batch", "s", "t", words("t").alias("spans"), words("s").alias("src_spans"))
    d = d.withColumn("wt", tags("t", F.col("spans"))).withColumn("st", tags("s", F.col("src_spans")))
    d = d.withColumn("gt", F.transform(F.sequence(F.lit(0), F.size("spans")), lambda w: w % 2))
    c = X.collate_word_qe(d, "batch", "id", "s", "t", "wt", "gt", "st", "spans", "src_spans", eos=1, pad=2)
    ids = ["net_input", "xml_mask", "langs", "target", "prev_output", "word_tags", "gap_tags", "src_tags"]

    def text(c):
        return F.array_join(F.transform(c, lambda x: F.concat_ws("-", x["start"], x["end"])), " ").alias(c)

    return c.select("batch", "id", "place", *[J(x).alias(x) for x in ids], text("spans"), text("src_spans"), "src_length", "tgt_length")
