"""Queries: string, token and array projections (B-*, C-11).

Array results are rendered as space-joined strings in both engines so the
oracle compares values, not driver-specific array objects.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions import text as T
from tessera.plans import views
from tessera.plans.oracle import tokens_sql, with_views
from tessera.plans.q_vocab import _vocab, vocab_sql
from tessera.plans.registry import register


def J(c):
    c = F.col(c) if isinstance(c, str) else c
    return F.array_join(c.cast("array<string>"), " ")


def ids_q(name: str, spark_expr, sql_expr: str):
    """Register a per-line projection over the ``ids`` view."""
    @register(name, with_views(f"SELECT sid, array_to_string({sql_expr}, ' ') AS out FROM ids", "ids"))
    def q(spark, sf):
        return views.ids(spark, sf).select("sid", J(spark_expr(F.col("ids"))).alias("out"))
    return q


ids_q("b08_append_eos", lambda a: A.append_eos(A.strip_token(a, 2), 2),
      "list_append(list_filter(ids, lambda x: x <> 2), 2)")
ids_q("b08_remove_eos", lambda a: A.remove_eos(a, 2),
      "CASE WHEN len(ids) > 0 AND ids[-1] = 2 THEN ids[1:len(ids) - 1] ELSE ids END")
ids_q("b09_lang_tokens", lambda a: A.replace_first(A.replace_last(a, 20, expect=2), 21),
      "list_prepend(21, (CASE WHEN ids[-1] = 2 THEN list_append(ids[1:len(ids) - 1], 20) ELSE ids END)[2:])")
ids_q("b10_prepend", lambda a: A.prepend(a, 0), "list_prepend(0, ids)")
ids_q("b11_strip_token", lambda a: A.strip_token(a, 1), "list_filter(ids, lambda x: x <> 1)")
ids_q("b12_truncate", lambda a: A.truncate(a, 5), "ids[1:5]")
ids_q("b13_truncate_keep_eos", lambda a: A.truncate_keep_eos(a, 5, 2),
      "CASE WHEN len(ids) > 5 THEN list_append(ids[1:4], 2) ELSE ids END")
ids_q("b14_offset", lambda a: A.offset(a, 10), "list_transform(ids, lambda x: x + 10)")
ids_q("b21_shift_right", lambda a: A.shift_right(a, 2), "list_prepend(2, ids[1:len(ids) - 1])")
ids_q("b22_lm_source", lambda a: A.lm_source(a, 2), "list_prepend(2, ids[1:len(ids) - 1])")
ids_q("b22_lm_past", lambda a: A.lm_past(a, 1, 2), "list_concat([1, 2], ids[1:len(ids) - 2])")
ids_q("b23_add_bos", lambda a: A.prepend(a, 0), "list_prepend(0, ids)")
ids_q("b08_prepend_bos", lambda a: A.prepend_bos(a, 5),
      "CASE WHEN ids[1] = 5 THEN ids ELSE list_prepend(5, ids) END")
ids_q("b23_clip_vocab", lambda a: A.clip_vocab(a, 8, 3),
      "list_transform(ids, lambda x: CASE WHEN x >= 8 THEN 3 ELSE x END)")
ids_q("b24_make_positions", lambda a: A.make_positions(a, 1),
      "list_transform(range(1, len(ids) + 1), lambda i: CASE WHEN ids[i] = 1 THEN 1 "
      "ELSE 1 + len(list_filter(ids[1:i], lambda x: x <> 1)) END)")
ids_q("b25_flip_padding", lambda a: A.flip_padding(a, 2, to_left=True),       # every row ends in 2
      "CASE WHEN ids[-1] <> 2 THEN ids ELSE list_concat(ids[len(ids) - len(list_filter(ids, lambda x: x = 2)) + 1:], "
      "ids[1:len(ids) - len(list_filter(ids, lambda x: x = 2))]) END")
ids_q("b25_flip_padding_right", lambda a: A.flip_padding(a, 3, to_left=False),
      "CASE WHEN ids[1] <> 3 THEN ids ELSE list_concat(ids[len(list_filter(ids, lambda x: x = 3)) + 1:], "
      "ids[1:len(list_filter(ids, lambda x: x = 3))]) END")
ids_q("b26_flip_keep_first", lambda a: A.flip_keep_first(a, F.size(a) - 1),
      "list_concat(ids[1:1], list_reverse(ids[2:len(ids) - 1]), ids[len(ids):])")


@register("b15_sizes", with_views("""
    SELECT sid, CAST(len(ids) AS INTEGER) AS size, CAST(len(list_filter(ids, lambda x: x <> 1)) AS INTEGER) AS numel
    FROM ids""", "ids"))
def q_b15(spark, sf):
    d = views.ids(spark, sf)
    return d.select("sid", F.size("ids").alias("size"), F.size(A.strip_token("ids", 1)).alias("numel"))


@register("b16_id_ones_label", with_views("""
    SELECT count(*) AS nsamples, sum(sid % 1000) AS id_sum, sum(len(ids) % 3) AS label_sum FROM ids""", "ids"))
def q_b16(spark, sf):
    d = views.ids(spark, sf)
    return d.agg(F.sum(F.lit(1)).cast("long").alias("nsamples"),
                 F.sum(F.col("sid") % 1000).alias("id_sum"),
                 F.sum(F.size("ids") % 3).cast("long").alias("label_sum"))


@register("b05_remove_bpe", with_views(r"""
    SELECT sid, seg, rtrim(replace(seg || ' ', '@@ ', '')) AS plain,
           regexp_replace(seg, '(@@ )|(@@ ?$)', '', 'g') AS plain_re
    FROM bpe""", "bpe"))
def q_b05(spark, sf):
    d = views.bpe(spark, sf)
    return d.select("sid", "seg", T.remove_bpe("seg").alias("plain"), T.remove_bpe_regex("seg").alias("plain_re"))


@register("b05_remove_spm", with_views("""
    SELECT sid, trim(replace(replace(spm, ' ', ''), '▁', ' ')) AS plain FROM (
      SELECT sid, '▁' || array_to_string(tokens, ' ▁') AS spm FROM sent_tok)""", "sent_tok"))
def q_b05s(spark, sf):
    s = views.sent_tokens(spark, sf)
    spm = F.concat(F.lit("▁"), F.array_join("tokens", " ▁"))
    return s.select("sid", T.remove_bpe(spm, "sentencepiece").alias("plain"))


BPE_TOK_SQL = {
    "btok": f"""
      SELECT sid, unnest(range(len(t))) AS pos, unnest(t) AS tok FROM (
        SELECT sid, {tokens_sql('seg')} AS t FROM bpe)""",
    "bword": """
      SELECT sid, pos, tok, coalesce(sum(CASE WHEN suffix(tok, '@@') THEN 0 ELSE 1 END) OVER (
               PARTITION BY sid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w
      FROM btok""",
}


@register("b06_word_index", with_views("""
    SELECT sid, string_agg(CAST(w AS VARCHAR), ' ' ORDER BY pos) AS widx FROM bword GROUP BY sid""",
    "bpe", extra=BPE_TOK_SQL))
def q_b06(spark, sf):
    d = views.bpe(spark, sf).select("sid", T.tokenize("seg").alias("t")).filter(F.size("t") > 0)
    return d.select("sid", J(T.word_index("t")).alias("widx"))


@register("b07_word_spans", with_views("""
    SELECT sid, string_agg(CAST(s AS VARCHAR) || '-' || CAST(e AS VARCHAR), ' ' ORDER BY w) AS spans FROM (
      SELECT sid, w, min(pos) AS s, max(pos) AS e FROM bword GROUP BY sid, w) GROUP BY sid""",
    "bpe", extra=BPE_TOK_SQL))
def q_b07(spark, sf):
    d = views.bpe(spark, sf).select("sid", T.tokenize("seg").alias("t")).filter(F.size("t") > 0)
    spans = F.transform(T.word_spans("t"), lambda s: F.concat_ws("-", s["start"].cast("string"),
                                                               s["end"].cast("string")))
    return d.select("sid", F.array_join(spans, " ").alias("spans"))


@register("b17_concat_sentences", with_views("""
    SELECT a.sid, array_to_string(list_concat(a.ids, b.ids), ' ') AS out,
           CAST(len(a.ids) + len(b.ids) AS INTEGER) AS size
    FROM ids a JOIN ids b ON b.sid = a.sid + 1""", "ids"))
def q_b17(spark, sf):
    a = views.ids(spark, sf)
    b = a.select((F.col("sid") - 1).alias("sid"), F.col("ids").alias("ids_b"))
    j = a.join(b, "sid")
    return j.select("sid", J(F.concat("ids", "ids_b")).alias("out"),
                    (F.size("ids") + F.size("ids_b")).alias("size"))


PAIR_IDS_SQL = {
    "pids": f"""
      SELECT id, list_transform({tokens_sql('src')}, lambda t: length(t) % 12 + 4) AS s,
                 list_transform({tokens_sql('tgt')}, lambda t: length(t) % 12 + 4) AS t
      FROM pair""",
}


def pair_ids(spark, sf):
    p = views.pair(spark, sf)
    f = lambda c: F.transform(T.tokenize(c), lambda t: F.length(t) % 12 + 4)
    return p.select("id", f("src").alias("s"), f("tgt").alias("t"))


@register("b18_pair_sequence", with_views("""
    SELECT id, array_to_string(list_concat([1], s, [1, 1], t, [1]), ' ') AS seq,
           array_to_string(list_concat(list_transform(range(len(s) + 2), lambda i: 0),
                                       list_transform(range(len(t) + 2), lambda i: 1)), ' ') AS mask,
           array_to_string(list_concat(list_transform(range(len(s) + 2), lambda i: 14),
                                       list_transform(range(len(t) + 2), lambda i: 4)), ' ') AS langs
    FROM pids""", "pair", extra=PAIR_IDS_SQL))
def q_b18(spark, sf):
    d = pair_ids(spark, sf)
    seq, mask = A.pair_sequence(None, None, "s", "t", eos=1)
    return d.select("id", J(seq).alias("seq"), J(mask).alias("mask"), J(A.language_ids("s", "t")).alias("langs"))


@register("b19_concat_pair", with_views("""
    SELECT id,
      array_to_string(list_concat(list_concat([1], s, [1])[1:len(s) + 1], list_concat([1], t, [1])), ' ') AS seq,
      array_to_string(range(len(s) + len(t) + 3), ' ') AS pos,
      array_to_string(list_concat(list_transform(range(len(s) + 1), lambda i: 5),
                                  list_transform(range(len(t) + 2), lambda i: 6)), ' ') AS langs,
      array_to_string(list_concat(list_concat([1], s, [1]), list_concat([1], t, [1])), ' ') AS seq_r,
      array_to_string(list_concat(range(len(s) + 2), range(len(t) + 2)), ' ') AS pos_r
    FROM pids""", "pair", extra=PAIR_IDS_SQL))
def q_b19(spark, sf):
    d = pair_ids(spark, sf)
    wrap = lambda c: F.concat(F.array(F.lit(1)), F.col(c), F.array(F.lit(1)))
    seq, pos, langs = A.concat_pair(wrap("s"), wrap("t"), 5, 6, reset=False)
    seq_r, pos_r, _ = A.concat_pair(wrap("s"), wrap("t"), 5, 6, reset=True)
    return d.select("id", J(seq).alias("seq"), J(pos).alias("pos"), J(langs).alias("langs"),
                    J(seq_r).alias("seq_r"), J(pos_r).alias("pos_r"))


@register("b20_target_slice", with_views("""
    SELECT id, array_to_string(list_concat([1], s, [1, 1], t, [1])[len(s) + 4:len(s) + 3 + len(t)], ' ') AS tgt
    FROM pids""", "pair", extra=PAIR_IDS_SQL))
def q_b20(spark, sf):
    d = pair_ids(spark, sf)
    seq, _ = A.pair_sequence(None, None, "s", "t", eos=1)
    return d.select("id", J(A.target_slice(seq, F.size("s"), F.size("t"))).alias("tgt"))


@register("b27_word_bytes", with_views("""
    SELECT id, symbol, array_to_string(CASE WHEN is_special THEN list_transform(range(12), lambda i: 0)
      ELSE list_concat(list_transform(regexp_extract_all(hex(encode(symbol)), '(..)', 1),
                                      lambda h: CAST(('0x' || h) AS INTEGER) + 1),
                       list_transform(range(12), lambda i: 0))[1:12] END, ' ') AS chars,
      CAST(strlen(symbol) > 12 AND NOT is_special AS BOOLEAN) AS truncated
    FROM vocab""", "sent_tok", extra=vocab_sql(threshold=5)))
def q_b27(spark, sf):
    v = _vocab(spark, sf, threshold=5)
    return v.select("id", "symbol", J(A.word_bytes("symbol", 12, F.col("is_special"))).alias("chars"),
                    ((F.octet_length("symbol") > 12) & ~F.col("is_special")).alias("truncated"))


@register("b28_band", with_views("""
    SELECT sid, pos,
      CASE WHEN x >= 4 AND x < 8 THEN 4 WHEN x >= 8 AND x < 12 THEN 5 ELSE x END AS head,
      CASE WHEN x >= 4 AND x < 8 THEN x - 4 WHEN x >= 8 AND x < 12 THEN x - 8 END AS tail
    FROM (SELECT sid, unnest(range(len(ids))) AS pos, unnest(ids) AS x FROM ids)""", "ids"))
def q_b28(spark, sf):
    d = views.ids(spark, sf).select("sid", F.posexplode("ids").alias("pos", "x"))
    head, tail = A.band("x", [4, 8, 12])
    return d.select("sid", "pos", head.alias("head"), tail.alias("tail"))


@register("b29_wrap_pair", with_views("""
    SELECT id, array_to_string(list_concat([0], s, [2], t, [2]), ' ') AS seq,
           array_to_string(list_concat(list_transform(range(len(s) + 2), lambda i: 0),
                                       list_transform(range(len(t) + 1), lambda i: 1)), ' ') AS seg
    FROM pids""", "pair", extra=PAIR_IDS_SQL))
def q_b29(spark, sf):
    d = pair_ids(spark, sf)
    seq, seg = A.wrap_pair("s", "t", cls=0, sep=2)
    return d.select("id", J(seq).alias("seq"), J(seg).alias("seg"))


@register("b31_b32_b33_tags", with_views("""
    SELECT sid, array_to_string(list_transform(w, lambda x: CASE WHEN x = 1 THEN 'OK' ELSE 'BAD' END), ' ') AS word_tags,
           array_to_string(list_concat(flatten(list_transform(range(1, len(w) + 1), lambda i: [g[i], w[i]])), [g[-1]]), ' ') AS tags
    FROM (SELECT sid,
            list_transform(ids, lambda x: CASE WHEN x / 12.0 > 0.5 THEN 1 ELSE 0 END) AS w,
            list_concat(list_transform(ids, lambda x: CASE WHEN x % 2 = 1 THEN 1 ELSE 0 END), [1]) AS g
          FROM ids)""", "ids"))
def q_b31(spark, sf):
    d = views.ids(spark, sf)
    w = T.binarize(F.transform("ids", lambda x: x / 12.0), 0.5)
    g = F.concat(F.transform("ids", lambda x: F.when(x % 2 == 1, 1).otherwise(0)), F.array(F.lit(1)))
    d = d.select("sid", w.alias("w"), g.alias("g"))
    return d.select("sid", F.array_join(T.render_tags("w"), " ").alias("word_tags"),
                    J(T.interleave("g", "w")).alias("tags"))


@register("b34_schedule", with_views("""
    SELECT run, step, round(CASE WHEN step >= 0 AND step < 40 THEN 0.0 + (step - 0) * (0.0 - 0.0) / 40
                                 WHEN step >= 40 AND step < 80 THEN 0.0 + (step - 40) * (1.0 - 0.0) / 40
                                 ELSE 1.0 END, 6) AS lam
    FROM metric""", "metric"))
def q_b34(spark, sf):
    m = views.metric(spark, sf)
    return m.select("run", "step", F.round(A.schedule_value("step", [(0, 0.0), (40, 0.0), (80, 1.0)]), 6).alias("lam"))


@register("b35_tag_lines", with_views("""
    SELECT sid, text || '  (' || CAST(line_no + 1 AS VARCHAR) || ')' AS tagged FROM sent""", "sent"))
def q_b35(spark, sf):
    s = views.sent(spark, sf)
    return s.select("sid", T.tag_lines("text", "line_no").alias("tagged"))


@register("b36_argmax", with_views("""
    SELECT id, CAST(list_position(vec, list_max(vec)) - 1 AS INTEGER) AS pred FROM emb""", "emb"))
def q_b36(spark, sf):
    return views.emb(spark, sf).select("id", T.argmax("vec").alias("pred"))


@register("b39_vec_ops", with_views("""
    SELECT id, round(list_sum(list_transform(range(1, 65), lambda i: vec[i] * vec[65 - i])), 6) AS dot_rev,
           round(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN i % 3 = 0 THEN 0.0 ELSE vec[i] END)), 6) AS masked_sum,
           CAST(len(list_concat(vec, vec)) AS INTEGER) AS concat_len
    FROM emb""", "emb"))
def q_b39(spark, sf):
    e = views.emb(spark, sf)
    mask = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.when(i % 3 == 0, 0).otherwise(1))
    prod = A.vec_mul("vec", F.reverse("vec"))
    return e.select("id", F.round(F.aggregate(prod, F.lit(0.0), lambda s, x: s + x), 6).alias("dot_rev"),
                    F.round(F.aggregate(A.vec_mask("vec", mask), F.lit(0.0), lambda s, x: s + x), 6).alias("masked_sum"),
                    F.size(F.concat("vec", "vec")).alias("concat_len"))


@register("c11_repeated_ngram", with_views("""
    SELECT sid, len(list_distinct(grams)) < len(grams) AS rep FROM (
      SELECT sid, list_transform(range(1, greatest(len(ids) - 2, 0) + 1), lambda i: ids[i:i + 2]) AS grams FROM ids)""",
    "ids"))
def q_c11(spark, sf):
    d = views.ids(spark, sf)
    return d.select("sid", A.repeats_ngram("ids", 3).alias("rep"))
