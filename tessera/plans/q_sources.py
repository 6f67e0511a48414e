"""Queries: text sources and sinks (A-*).  Each writes a table-derived file
to a fresh folder under the shared checkpoint folder and reads it back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import vocab as V
from tessera.plans import views
from tessera.plans.oracle import tokens_sql, with_views
from tessera.plans.q_shaping import ROWS_SQL
from tessera.plans.q_text import BPE_TOK_SQL
from tessera.plans.q_vocab import ENC_EXTRA, _vocab, vocab_sql
from tessera.plans.registry import register
from tessera.session import read_table
from tessera.sources import text as S


@register("a01_read_lines", with_views("""
    SELECT r.row_id AS id, s.text AS line FROM rows r JOIN sent s USING (sid)""", "sent_tok", extra=ROWS_SQL))
def q_a01(spark, sf):
    path = S.scratch_path(spark, "lines")
    S.write_lines(views.sent(spark, sf), "sid", "text", path)
    return S.read_lines(spark, path)


@register("a02_read_parallel", with_views("""
    SELECT r.row_id AS id, s.text, CAST(r.ntok AS VARCHAR) AS ntok FROM rows r JOIN sent s USING (sid)""",
    "sent_tok", extra=ROWS_SQL))
def q_a02(spark, sf):
    s = views.sent_tokens(spark, sf).select("sid", "text", F.size("tokens").cast("string").alias("ntok"))
    p1, p2 = S.scratch_path(spark, "text"), S.scratch_path(spark, "ntok")
    S.write_lines(s, "sid", "text", p1)
    S.write_lines(s, "sid", "ntok", p2)
    zipped, missing = S.read_parallel(spark, {"text": p1, "ntok": p2})
    if missing.limit(1).count() > 0:
        raise ValueError("aligned files differ in length")
    return zipped.select("id", "text", "ntok")


@register("a07_read_tags", with_views("""
    SELECT r.row_id AS id, array_to_string(i.ids, ' ') AS tags FROM rows r JOIN ids i USING (sid)""",
    "sent_tok", "ids", extra=ROWS_SQL))
def q_a07(spark, sf):
    d = views.ids(spark, sf).select("sid", F.array_join(F.col("ids").cast("array<string>"), " ").alias("l"))
    path = S.scratch_path(spark, "tags")
    S.write_lines(d, "sid", "l", path)
    t = S.read_tags(spark, path)
    return t.select("id", F.array_join(F.col("tags").cast("array<string>"), " ").alias("tags"))


@register("a08_read_spans", with_views("""
    SELECT id, string_agg(CAST(s AS VARCHAR) || '-' || CAST(e AS VARCHAR), ' ' ORDER BY w) AS spans FROM (
      SELECT sid, w, min(pos) AS s, max(pos) AS e FROM bword GROUP BY sid, w) x
    JOIN (SELECT sid, row_number() OVER (ORDER BY sid) - 1 AS id FROM (SELECT DISTINCT sid FROM bword)) USING (sid)
    GROUP BY id""", "bpe", extra=BPE_TOK_SQL))
def q_a08(spark, sf):
    d = views.bpe(spark, sf).select("sid", T.tokenize("seg").alias("t")).filter(F.size("t") > 0)
    d = d.select("sid", T.word_spans("t").alias("sp"))
    d = d.select("sid", F.concat(F.lit("["), F.array_join(F.transform("sp", lambda s: F.format_string(
        "(%d, %d)", s["start"], s["end"])), ", "), F.lit("]")).alias("l"))
    path = S.scratch_path(spark, "spans")
    S.write_lines(d, "sid", "l", path)
    sp = S.read_spans(spark, path)
    return sp.select("id", F.array_join(F.transform("spans", lambda s: F.concat_ws(
        "-", s["start"].cast("string"), s["end"].cast("string"))), " ").alias("spans"))


@register("a09_a16_vocab_roundtrip", with_views("SELECT id, symbol, count FROM vocab WHERE id >= 4", "sent_tok",
                                                extra=vocab_sql(threshold=3)))
def q_a09(spark, sf):
    v = _vocab(spark, sf, threshold=3)
    path = S.scratch_path(spark, "vocab")
    S.write_vocab(v, path)
    return S.read_vocab(spark, path)


@register("a10_read_vocab_clean", with_views("SELECT id + 10 AS id, symbol, count FROM vocab WHERE id >= 4", "sent_tok",
                                             extra=vocab_sql(threshold=3)))
def q_a10(spark, sf):
    v = _vocab(spark, sf, threshold=3)
    path = S.scratch_path(spark, "vocab")
    S.write_vocab(v, path)
    return S.read_vocab_clean(spark, path, nspecial=14)


@register("a11_read_vectors", """
    WITH ok AS (SELECT * FROM embeddings WHERE vec_id % 50 <> 7)
    SELECT 'w' || CAST(vec_id % 300 AS VARCHAR) AS word,
           array_to_string(list_transform(arg_max(embedding, vec_id), lambda x: printf('%.5f', CAST(x AS DOUBLE))), ' ') AS last_vec,
           array_to_string(list_transform(arg_min(embedding, vec_id), lambda x: printf('%.5f', CAST(x AS DOUBLE))), ' ') AS first_vec
    FROM ok GROUP BY vec_id % 300""")
def q_a11(spark, sf):
    """Every vector is written and read; those with ``vec_id % 50 = 7`` lack a number,
    so the reader drops them.  Both rules for repeated words."""
    e = read_table(spark, sf, "embeddings")
    numbers = F.when(F.col("vec_id") % 50 == 7, F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))
    lines = e.select(F.col("vec_id").alias("k"), F.concat_ws(
        " ", F.concat(F.lit("w"), (F.col("vec_id") % 300).cast("string")), F.array_join(numbers.cast("array<string>"), " ")).alias("l"))
    header = e.agg(F.count(F.lit(1)).alias("n")).select(F.lit(-1).cast("long").alias("k"),
                                                       F.concat_ws(" ", F.col("n").cast("string"), F.lit("64")).alias("l"))
    path = S.scratch_path(spark, "vectors")
    S.write_lines(header.unionByName(lines), "k", "l", path)
    text = F.array_join(F.transform("vec", lambda x: F.format_string("%.5f", x.cast("double"))), " ")
    last, first = (S.read_vectors(spark, path, 64, keep=k).select("word", text.alias(f"{k}_vec")) for k in ("last", "first"))
    return last.join(first, "word")


@register("a12_read_align", with_views("""
    SELECT tok AS src, CAST(sid AS VARCHAR) AS tgt FROM tok
    QUALIFY row_number() OVER (PARTITION BY tok ORDER BY doc_id DESC, line_no DESC, pos DESC) = 1""", "tok"))
def q_a12(spark, sf):
    # a sentence is sorted as one row, and becomes many lines behind the sort
    d = views.sent(spark, sf).filter(F.col("text").rlike(T.TOKEN_START)).select(F.struct("doc_id", "line_no").alias("k"), "sid", "text")
    l = F.array_join(F.transform(T.tokenize("text"), lambda t: F.concat_ws(" ", t, F.col("sid").cast("string"))), "\n")
    path = S.scratch_path(spark, "align")
    S.write_lines(d, "k", l.alias("l"), path)
    return S.read_align(spark, path)


@register("a15_corpus_roundtrip", with_views("""
    SELECT sid AS id, CAST(len(ids) AS INTEGER) AS size, array_to_string(ids, ' ') AS ids FROM ids""", "ids"))
def q_a15(spark, sf):
    path = S.scratch_path(spark, "corpus")
    d = views.ids(spark, sf).select(F.col("sid").alias("id"), "ids")
    S.write_corpus(d.filter(F.col("id") % 2 == 0), path, mode="overwrite")
    S.write_corpus(d.filter(F.col("id") % 2 == 1), path, mode="append")  # merging shards = append
    c = spark.read.parquet(path)
    return c.select("id", "size", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@register("a17_predictions", """
    SELECT doc_id AS id, printf('%.5f', (n_chars % 97) / 97.0) AS line FROM documents""")
def q_a17(spark, sf):
    d = read_table(spark, sf, "documents")
    preds = (d.select(F.col("doc_id").alias("id"), ((F.col("n_chars") % 89) / 89.0).alias("p"), F.lit(0).alias("seq"))
             .unionByName(d.select(F.col("doc_id").alias("id"), ((F.col("n_chars") % 97) / 97.0).alias("p"),
                                   F.lit(1).alias("seq"))))
    return S.predictions_lines(preds, "id", "p", "%.5f")


@register("a17_prediction_file", """
    SELECT row_number() OVER (ORDER BY doc_id) - 1 AS id, printf('%.5f', (n_chars % 97) / 97.0) AS line FROM documents""")
def q_a17_file(spark, sf):
    d = read_table(spark, sf, "documents")
    preds = (d.select("doc_id", ((F.col("n_chars") % 89) / 89.0).alias("p"), F.lit(0).alias("seq"))
             .unionByName(d.select("doc_id", ((F.col("n_chars") % 97) / 97.0).alias("p"), F.lit(1).alias("seq"))))
    path = S.scratch_path(spark, "prediction")
    S.write_predictions(preds, "doc_id", "p", path, "%.5f")
    return S.read_lines(spark, path)


@register("a17_word_predictions", with_views("""
    WITH t AS (SELECT sid, doc_id, line_no, list_transform(tokens, lambda x: (length(x) % 10) / 9.0) AS w,
                      list_transform(range(len(tokens) + 1), lambda i: (i % 7) / 6.0) AS g FROM sent_tok),
    p AS (SELECT sid, doc_id, line_no, list_transform(range(2 * len(w) + 1), lambda i: CASE WHEN i % 2 = 0 THEN g[CAST(i // 2 + 1 AS INTEGER)] ELSE w[CAST(i // 2 + 1 AS INTEGER)] END) AS p FROM t)
    SELECT row_number() OVER (ORDER BY doc_id, line_no) - 1 AS id, array_to_string(list_transform(p, lambda x: CASE WHEN x > 0.5 THEN 'OK' ELSE 'BAD' END), ' ') AS tags,
           array_to_string(list_transform(p, lambda x: printf('%.5f', x)), ' ') AS probs FROM p""", "sent_tok"))
def q_a17_words(spark, sf):
    s = views.sent(spark, sf).select("sid", "text", F.lit(0).alias("seq"))
    tokens = T.tokenize("text")
    gaps = F.transform(F.sequence(F.lit(0), F.size(tokens)), lambda i: (i % 7) / F.lit(6.0))
    path = S.scratch_path(spark, "words")
    S.write_word_predictions(s, "sid", F.transform(tokens, lambda x: (F.length(x) % 10) / F.lit(9.0)), gaps, path)
    tags, probs = (S.read_lines(spark, f"{path}/{n}").withColumnRenamed("line", n) for n in ("tags", "probs"))
    return tags.join(probs, "id")


@register("a18_report_file", """
    WITH h AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber) AS h, -l_extendedprice / 9973.0 AS score,
                      'p' || l_partkey || ' s' || l_suppkey AS hyp, [l_discount, l_tax] AS pos, l_linenumber % 3 || ' ' || l_linenumber % 2 AS al FROM lineitem),
    l AS (SELECT o_orderkey AS id, 0 AS h, 0 AS t, 'S-' || o_orderkey || chr(9) || o_orderpriority AS l FROM orders
          UNION ALL SELECT o_orderkey, 0, 1, 'T-' || o_orderkey || chr(9) || o_orderstatus FROM orders
          UNION ALL SELECT id, h, 0, 'H-' || id || chr(9) || printf('%.4f', score) || chr(9) || hyp FROM h WHERE h <= 2
          UNION ALL SELECT id, h, 1, 'P-' || id || chr(9) || printf('%.4f', pos[1]) || ' ' || printf('%.4f', pos[2]) FROM h WHERE h <= 2
          UNION ALL SELECT id, h, 2, 'A-' || id || chr(9) || al FROM h WHERE h <= 2)
    SELECT row_number() OVER (ORDER BY id, h, t) - 1 AS id, l AS line FROM l""")
def q_a18_file(spark, sf):
    """Two best of each list, with alignments, written in order and read back."""
    li = read_table(spark, sf, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_extendedprice", "l_linenumber")
    hyps = li.select(F.col("l_orderkey").alias("id"), F.row_number().over(w).alias("rank"), (-F.col("l_extendedprice") / 9973.0).alias("score"),
                     F.concat(F.lit("p"), F.col("l_partkey").cast("string"), F.lit(" s"), F.col("l_suppkey").cast("string")).alias("hyp"),
                     F.array("l_discount", "l_tax").alias("pos_scores"), F.array(F.col("l_linenumber") % 3, F.col("l_linenumber") % 2).alias("alignment"))
    src = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("src"), F.col("o_orderstatus").alias("tgt"))
    path = S.scratch_path(spark, "report")
    S.write_report(src, hyps, "id", path, nbest=2, alignment=True)
    return S.read_lines(spark, path)


@register("a21_export_file", with_views("""
    SELECT row_number() OVER (ORDER BY doc_id, line_no) - 1 AS id, rtrim(replace(replace(text, 'the', '<<unk>>') || ' ', '@@ ', '')) AS line FROM sent""", "sent"))
def q_a21_file(spark, sf):
    s = views.sent(spark, sf).select("sid", F.replace("text", F.lit("the"), F.lit("<unk>")).alias("text"))
    path = S.scratch_path(spark, "refs")
    S.write_refs(s, "sid", "text", path)
    return S.read_lines(spark, path)


@register("a18_report", with_views(f"""
    WITH p AS (SELECT id, src, tgt, {tokens_sql('tgt')} AS t FROM pair)
    SELECT id, 'S-' || id || chr(9) || src AS l FROM p
    UNION ALL SELECT id, 'T-' || id || chr(9) || tgt FROM p
    UNION ALL SELECT id, 'H-' || id || chr(9) || printf('%.4f', -len(t) / 10.0) || chr(9) || tgt FROM p
    UNION ALL SELECT id, 'P-' || id || chr(9) || array_to_string(list_transform(t, lambda x: printf('%.4f', -length(x) / 10.0)), ' ') FROM p""",
    "pair"))
def q_a18(spark, sf):
    p = views.pair(spark, sf).withColumn("t", T.tokenize("tgt"))
    p = p.select("id", "src", "tgt", F.col("tgt").alias("hyp"), (-F.size("t") / 10.0).alias("score"),
                 F.transform("t", lambda x: -F.length(x) / 10.0).alias("pos_scores"))
    return S.report_lines(p, "id").select("id", "l")


@register("a19_metrics_json", with_views("""
    SELECT to_json(struct_pack(valid_run := run, valid_n := sum(n), valid_count := count(*))) AS json
    FROM metric GROUP BY run""", "metric"))
def q_a19(spark, sf):
    m = views.metric(spark, sf).groupBy("run").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("count"))
    return S.metrics_json(m, "valid")


@register("a20_probs", with_views("""
    SELECT id, CAST(id AS VARCHAR) || chr(9) || array_to_string(list_transform(vec, lambda x: printf('%.4f', x)), ',') AS line
    FROM emb""", "emb"))
def q_a20(spark, sf):
    e = views.emb(spark, sf).select("id", F.transform("vec", lambda x: F.format_string("%.4f", x)).alias("p"))
    return S.probs_lines(e, "id", "p")


@register("a21_export_refs", with_views("""
    SELECT s.sid, rtrim(replace(coalesce(x.t, '') || ' ', '@@ ', '')) AS text FROM sent s LEFT JOIN (
      SELECT sid, string_agg(CASE WHEN tid = 3 THEN '<<unk>>' ELSE tok END, ' ' ORDER BY pos) AS t FROM enc GROUP BY sid) x
    USING (sid)""", "tok", extra={**vocab_sql(threshold=3), **ENC_EXTRA}))
def q_a21(spark, sf):
    s = views.sent_tokens(spark, sf)
    v = _vocab(spark, sf, threshold=3, materialize=True)
    d = V.decode(V.encode(s, ["sid"], v), ["sid"], v)
    return S.export_refs(d, "text").select("sid", "text")


@register("a03_a05_shards_and_pairs", """
    SELECT lang, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS shard, count(*) AS lines,
           'en' AS src, lang AS tgt
    FROM documents GROUP BY lang""")
def q_a03(spark, sf):
    """One shard per language written as '<split><k>.en-<lang>.txt' (A-03
    naming), probed in order; the language pair comes from the name (A-05)
    and the folder from the epoch rotation (A-04)."""
    d = read_table(spark, sf, "documents").select("doc_id", "lang")
    langs = [r["lang"] for r in d.select("lang").distinct().orderBy("lang").collect()]  # a few codes
    base = S.scratch_path(spark, "shards")
    for i, lg in enumerate(langs):
        name = "train" + ("" if i == 0 else str(i))
        S.write_lines(d.filter(F.col("lang") == lg).select("doc_id", F.col("doc_id").cast("string").alias("l")),
                      "doc_id", "l", f"{base}/{name}.en-{lg}.txt")
    folder = S.epoch_path(f"{base}-unused:{base}", 3)  # epoch 3 of two folders -> the second
    rows = S.read_shards(spark, folder, "train", r"en-[A-Za-z_]+\.txt")
    counts = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("lines"))
    pairs = S.infer_language_pair(spark, folder, r"train\d*")
    shard_lang = spark.createDataFrame([(i, lg) for i, lg in enumerate(langs)], "shard int, lang string")
    return (counts.join(shard_lang, "shard").join(pairs.withColumnRenamed("tgt", "lang"), "lang")
            .select("lang", "shard", "lines", "src", F.col("lang").alias("tgt")))
