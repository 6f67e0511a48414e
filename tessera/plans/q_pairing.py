"""Queries: pairing joins, nearest neighbours and seeded noise (J-*, N-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import ids as I
from tessera.operators import knn as K
from tessera.operators import metrics as M
from tessera.operators import pairing as P
from tessera.plans import views
from tessera.plans.oracle import with_views
from tessera.plans.q_shaping import ROWS_SQL, sent_rows
from tessera.plans.q_text import BPE_TOK_SQL
from tessera.plans.q_vocab import _vocab, vocab_sql
from tessera.plans.registry import register
from tessera.session import read_table


def R(c, k=6):
    return F.round(F.col(c) if isinstance(c, str) else c, k)


def HU(seed, *parts):
    """DuckDB form of shaping.hash_uniform(seed, parts...)."""
    key = " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(CAST(('0x' || substr(md5('{seed}:' || {key}), 1, 13)) AS BIGINT) / 4503599627370496.0)"


@register("j01_zip_by_id", """
    SELECT d.doc_id AS id, d.lang, d.n_chars, l.quality FROM documents d JOIN labels l USING (doc_id)""")
def q_j01(spark, sf):
    d = read_table(spark, sf, "documents")
    a = d.select(F.col("doc_id").alias("id"), "lang")
    b = d.select(F.col("doc_id").alias("id"), "n_chars")
    c = read_table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality")
    return P.zip_by_id([a, b, c])


@register("j01_zip_mismatch", "SELECT doc_id AS id FROM documents ANTI JOIN labels USING (doc_id)")
def q_j01m(spark, sf):
    d = read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    lab = read_table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return P.zip_mismatch(d, lab)


@register("j04_pool_spans", with_views("""
    SELECT sid, w AS word, round(avg(length(tok)), 6) AS mean FROM bword GROUP BY sid, w""", "bpe", extra=BPE_TOK_SQL))
def q_j04(spark, sf):
    d = views.bpe(spark, sf).select("sid", T.tokenize("seg").alias("t")).filter(F.size("t") > 0)
    spans = d.select("sid", T.word_spans("t").alias("spans"))
    feats = d.select("sid", F.transform("t", lambda w: F.length(w).cast("double")).alias("values"))
    return P.pool_spans(feats, spans, "sid").select("sid", "word", R("mean").alias("mean"))


@register("j06_round_robin_zip", with_views("""
    WITH p AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS prow FROM pair),
    n AS (SELECT count(*) AS n FROM pair)
    SELECT r.sid, p.id AS pair_id FROM rows r, n JOIN p ON p.prow = r.row_id % n.n""",
    "sent_tok", "pair", extra=ROWS_SQL))
def q_j06(spark, sf):
    big = sent_rows(spark, sf).select("sid", "row_id")
    pr = views.pair(spark, sf).select(F.col("id").alias("pair_id"))
    small = I.with_row_id(pr, [F.col("pair_id")], *I.int_key_buckets("pair_id"), out="prow")
    n = small.count()  # modulus of the zip (one scalar)
    return P.round_robin_zip(big, small, "row_id", "prow", n).select("sid", "pair_id")


@register("j10_negatives", with_views(f"""
    WITH r AS (SELECT sid, lang, row_number() OVER (PARTITION BY lang ORDER BY sid) - 1 AS rank,
                      count(*) OVER (PARTITION BY lang) AS n FROM sent),
    k AS (SELECT *, {HU(13, 'sid', "'keep'")} < 0.5 AS keep,
                 1 + floor({HU(13, 'sid', "'shift'")} * (n - 1)) AS shift FROM r WHERE n > 1),
    q AS (SELECT sid, lang, CASE WHEN keep THEN 1 ELSE 0 END AS label,
                 CASE WHEN keep THEN rank ELSE (rank + shift) % n END AS prank FROM k)
    SELECT q.sid, q.lang, r.sid AS partner, q.label FROM q JOIN r ON r.lang = q.lang AND r.rank = q.prank""", "sent"))
def q_j10(spark, sf):
    s = views.sent(spark, sf).select("sid", "lang")
    return P.negatives(s, "lang", "sid", 13)


@register("j11_next_sentence", with_views(f"""
    WITH n AS (SELECT count(*) AS n FROM rows),
    d AS (SELECT r.row_id, ({HU(17, 'r.row_id', "'next'")} < 0.5 AND r.row_id < n.n - 1) AS is_next,
                 floor({HU(17, 'r.row_id', "'rand'")} * (n.n - 2)) AS r2 FROM rows r, n)
    SELECT d.row_id, d.is_next, CAST(CASE WHEN d.is_next THEN d.row_id + 1 WHEN r2 >= d.row_id THEN r2 + 2 ELSE r2 END AS BIGINT) AS prow
    FROM d""", "sent_tok", extra=ROWS_SQL))
def q_j11(spark, sf):
    r = sent_rows(spark, sf).select("row_id", "sid")
    n = r.count()  # needed for the 'not i, not i+1' draw (one scalar)
    return P.next_sentence(r, "row_id", n, 17).select("row_id", "is_next", F.col("prow").cast("long").alias("prow"))


@register("j13_contrastive_negatives", with_views(f"""
    WITH p AS (SELECT sid, unnest(range(len(ids))) AS pos, len(ids) AS n FROM ids),
    d AS (SELECT sid, pos, n, unnest(range(1, 4)) AS j FROM p)
    SELECT sid, pos, j, CAST(floor({HU(19, 'sid', 'pos', 'j')} * n) AS BIGINT) AS neg FROM d""", "ids"))
def q_j13(spark, sf):
    d = views.ids(spark, sf).select("sid", F.size("ids").alias("n"))
    c = P.contrastive_negatives(d, "sid", "n", 3, 19)
    return c.select("sid", "pos", F.col("j").cast("long").alias("j"), F.col("neg").cast("long").alias("neg"))


@register("j13_negatives_across", with_views(f"""
    WITH b AS (SELECT i.sid, len(i.ids) AS n, (row_number() OVER (ORDER BY s.doc_id, s.line_no) - 1) // 16 AS batch FROM ids i JOIN sent s USING (sid)),
    o AS (SELECT *, sum(n) OVER (PARTITION BY batch ORDER BY sid) - n AS beg, sum(n) OVER (PARTITION BY batch) AS total FROM b),
    p AS (SELECT sid, batch, beg, total, unnest(range(n)) AS pos FROM o),
    d AS (SELECT *, unnest(range(1, 3)) AS j FROM p),
    e AS (SELECT *, CAST(floor({HU(67, 'sid', 'pos', 'j')} * total) AS BIGINT) AS i FROM d)
    SELECT e.sid, e.pos, e.j, p.sid AS neg_sid, p.pos AS neg_pos FROM e JOIN p ON p.batch = e.batch AND p.beg + p.pos = e.i""", "ids", "sent"))
def q_j13_across(spark, sf):
    n = views.ids(spark, sf).select("sid", F.size("ids").alias("n"))          # ids themselves are not shuffled
    d = n.join(views.sent(spark, sf).select("sid", "doc_id", "line_no"), "sid").select("sid", "doc_id", "line_no", "n")
    d = I.with_row_id(d, ["doc_id", "line_no"]).withColumn("batch", F.floor(F.col("row_id") / 16))
    c = P.contrastive_negatives_across(d, "batch", "sid", "n", 2, 67)
    return c.select("sid", F.col("pos").cast("long").alias("pos"), F.col("j").cast("long").alias("j"), F.col("neg_key").alias("neg_sid"), F.col("neg_pos").cast("long").alias("neg_pos"))


def _knn_sql(fn: str) -> str:
    return with_views(f"""
    SELECT qid, kid, rank, round(score, 6) AS score FROM (
      SELECT q.id AS qid, k.id AS kid, {fn} AS score,
             row_number() OVER (PARTITION BY q.id ORDER BY {fn} DESC, k.id) AS rank
      FROM emb q, emb k) WHERE rank <= 5""", "emb")


COS = ("list_dot_product(q.vec, k.vec) / ((sqrt(list_dot_product(q.vec, q.vec)) + 1e-9)"
       " * (sqrt(list_dot_product(k.vec, k.vec)) + 1e-9))")
L2 = "2 * list_dot_product(q.vec, k.vec) - list_dot_product(q.vec, q.vec) - list_dot_product(k.vec, k.vec)"


def _knn_q(metric):
    def q(spark, sf):
        e = views.emb(spark, sf).select("id", "vec")
        r = K.knn(e, e, k=5, metric=metric, cell_rows=200)
        return r.select("qid", "kid", F.col("rank").cast("long").alias("rank"), R("score").alias("score"))
    return q


register("j14_knn", _knn_sql("list_dot_product(q.vec, k.vec)"))(_knn_q("dot"))
register("j14_knn_cosine", _knn_sql(COS))(_knn_q("cosine"))
register("j14_knn_l2", _knn_sql(L2))(_knn_q("l2"))


@register("j17_vocab_overlap", with_views("""
    SELECT symbol FROM vocab SEMI JOIN (SELECT DISTINCT unnest(tokens) AS symbol FROM sent_tok WHERE lang = 'fr') f
    USING (symbol) WHERE NOT is_special""", "sent_tok", extra=vocab_sql(threshold=3)))
def q_j17(spark, sf):
    from tessera.operators.vocab import vocab_overlap
    v = _vocab(spark, sf, threshold=3).filter(~F.col("is_special"))
    fr = views.sent_tokens(spark, sf).filter(F.col("lang") == "fr").select(F.explode("tokens").alias("symbol"))
    return vocab_overlap(v, fr, "left_semi").select("symbol")


# Sentences with a final end symbol, as tokens with their word index, and the
# three noise steps; every step is a chain of views with its own prefix.
EOS_SQL = {"ew": """SELECT sid, pos, tok, w, false AS fin FROM bword UNION ALL
    SELECT s.sid, coalesce(m.n, 0), '</s>', coalesce(m.w + 1, 0), true
    FROM bpe s LEFT JOIN (SELECT sid, count(*) AS n, max(w) AS w FROM bword GROUP BY sid) m USING (sid)"""}


def _words_again(name: str, src: str) -> dict:
    """Word indexes of the tokens of ``src`` (sid, pos, tok)."""
    return {name: f"""SELECT sid, pos, tok, coalesce(sum(CASE WHEN tok LIKE '%@@' THEN 0 ELSE 1 END) OVER (
        PARTITION BY sid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS w,
        pos = max(pos) OVER (PARTITION BY sid) AS fin FROM {src}"""}


def _shuffle_views(x: str, src: str, k: float, seed: int) -> dict:
    return {f"{x}_out": f"""SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY fin,
        w + CASE WHEN w = 0 THEN -1.0 ELSE {HU(seed, 'sid', 'w')} * {k} END + 1e-6 * pos) - 1 AS pos, tok FROM {src}"""}


def _drop_views(x: str, src: str, p: float, seed: int, blank: str | None = None) -> dict:
    kept = "kw" if blank is None else "true"
    tok = "tok" if blank is None else f"CASE WHEN kw THEN tok ELSE '{blank}' END"
    return {
        f"{x}_k": f"SELECT *, w = max(CASE WHEN fin THEN w END) OVER (PARTITION BY sid) OR {HU(seed, 'sid', 'w')} >= {p} AS kw FROM {src}",
        f"{x}_n": f"SELECT sid, count(*) AS n, count(*) FILTER (WHERE {kept}) AS kept FROM {x}_k GROUP BY sid",
        f"{x}_all": f"""SELECT sid, pos, {tok} AS tok FROM {x}_k WHERE {kept} UNION ALL
            SELECT t.sid, -1, t.tok FROM {x}_k t JOIN {x}_n c USING (sid)
            WHERE c.kept <= 1 AND t.pos = floor({HU(seed, 'sid', "'insert'")} * c.n)""",
        f"{x}_out": f"SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY pos) - 1 AS pos, tok FROM {x}_all",
    }


def _joined_sql(src: str) -> str:
    return f"SELECT sid, string_agg(tok, ' ' ORDER BY pos) AS noised FROM {src} GROUP BY sid"


def _eos_tokens(spark, sf):
    return views.bpe(spark, sf).select("sid", F.concat(T.tokenize("seg"), F.array(F.lit("</s>"))).alias("t"))


@register("n01_word_dropout", with_views(_joined_sql("d_out"), "bpe",
                                         extra={**BPE_TOK_SQL, **EOS_SQL, **_drop_views("d", "ew", 0.3, 11)}))
def q_n01(spark, sf):
    return P.word_dropout(_eos_tokens(spark, sf), "sid", "t", 0.3, 11, eos="</s>").select("sid", F.array_join("noised", " ").alias("noised"))


@register("n02_word_blank", with_views(_joined_sql("d_out"), "bpe",
                                       extra={**BPE_TOK_SQL, **EOS_SQL, **_drop_views("d", "ew", 0.3, 11, "<unk>")}))
def q_n02(spark, sf):
    d = P.word_dropout(_eos_tokens(spark, sf), "sid", "t", 0.3, 11, blank="<unk>", eos="</s>")
    return d.select("sid", F.array_join("noised", " ").alias("noised"))


@register("n03_word_shuffle", with_views(_joined_sql("s_out"), "bpe",
                                         extra={**BPE_TOK_SQL, **EOS_SQL, **_shuffle_views("s", "ew", 3.0, 11)}))
def q_n03(spark, sf):
    return P.word_shuffle(_eos_tokens(spark, sf), "sid", "t", 3.0, 11, eos="</s>").select("sid", F.array_join("noised", " ").alias("noised"))


@register("n04_add_noise", with_views(_joined_sql("b_out"), "bpe", extra={
    **BPE_TOK_SQL, **EOS_SQL, **_shuffle_views("s", "ew", 3.0, 41), **_words_again("sw", "s_out"),
    **_drop_views("d", "sw", 0.2, 42), **_words_again("dw", "d_out"), **_drop_views("b", "dw", 0.2, 43, "<unk>")}))
def q_n04(spark, sf):
    d = P.add_noise(_eos_tokens(spark, sf), "sid", "t", 3.0, 0.2, 0.2, (41, 42, 43))
    return d.select("sid", F.array_join("noised", " ").alias("noised"))


def _mask_sql(count_expr: str) -> str:
    return with_views(f"""
    WITH p AS (SELECT sid, len(ids) AS n, unnest(range(len(ids))) AS i, unnest(ids) AS x FROM ids),
    r AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY {HU(23, 'sid', 'i')}, i) AS rk,
                 {count_expr} AS cnt FROM p),
    m AS (SELECT sid, i, x, rk <= cnt AS chosen, {HU(23, 'sid', 'i', "'how'")} AS u2,
                 4 + floor({HU(23, 'sid', 'i', "'rand'")} * 8) AS rnd FROM r)
    SELECT sid, string_agg(CAST(CASE WHEN NOT chosen OR u2 < 0.1 THEN x WHEN u2 < 0.2 THEN rnd ELSE 0 END AS BIGINT)::VARCHAR, ' ' ORDER BY i) AS masked,
           string_agg(CAST(CASE WHEN chosen THEN x ELSE 1 END AS VARCHAR), ' ' ORDER BY i) AS target
    FROM m GROUP BY sid""", "ids")


@register("n05_mask_tokens", _mask_sql(f"floor(n * 0.15 + {HU(23, 'sid', chr(39) + 'n' + chr(39))})"))
def q_n05(spark, sf):
    d = P.mask_tokens(views.ids(spark, sf), "sid", "ids", 0.15, 23, mask_id=0, pad=1)
    return d.select("sid", F.array_join(F.col("masked").cast("array<string>"), " ").alias("masked"),
                    F.array_join(F.col("target").cast("array<string>"), " ").alias("target"))


@register("n05_mask_whole_words", with_views(f"""
    WITH p AS (SELECT sid, unnest(range(len(ids))) AS i, unnest(ids) AS x FROM ids),
    b AS (SELECT *, CAST(sum(CASE WHEN i = 0 OR x % 3 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY sid ORDER BY i) - 1 AS BIGINT) AS w FROM p),
    u AS (SELECT sid, w, row_number() OVER (PARTITION BY sid ORDER BY {HU(23, 'sid', 'w')}, w) AS rk, count(*) OVER (PARTITION BY sid) AS nw
          FROM (SELECT DISTINCT sid, w FROM b)),
    c AS (SELECT b.*, rk <= floor(nw * 0.15 + {HU(23, 'b.sid', "'n'")}) AS chosen, {HU(23, 'b.sid', 'b.w', "'how'")} AS u2,
                 {HU(23, 'b.sid', 'i', "'rand'")} AS u3 FROM b JOIN u ON b.sid = u.sid AND b.w = u.w)
    SELECT sid, string_agg(CAST(CASE WHEN NOT chosen OR u2 < 0.1 THEN x WHEN u2 < 0.2 THEN
             CASE WHEN u3 < 0.1 THEN 4 WHEN u3 < 0.3 THEN 5 WHEN u3 < 0.6 THEN 6 ELSE 7 END ELSE 0 END AS VARCHAR), ' ' ORDER BY i) AS masked,
           string_agg(CAST(CASE WHEN chosen THEN x ELSE 1 END AS VARCHAR), ' ' ORDER BY i) AS target
    FROM c GROUP BY sid""", "ids"))
def q_n05w(spark, sf):
    by_count = lambda u: F.when(u < 0.1, 4).when(u < 0.3, 5).when(u < 0.6, 6).otherwise(7)  # noqa: E731  weights 1, 2, 3, 4
    d = P.mask_tokens(views.ids(spark, sf), "sid", "ids", 0.15, 23, mask_id=0, pad=1, begins=lambda x: x % 3 != 0, replace=by_count)
    return d.select("sid", F.array_join(F.col("masked").cast("array<string>"), " ").alias("masked"),
                    F.array_join(F.col("target").cast("array<string>"), " ").alias("target"))


@register("n06_mask_blocks", _mask_sql("ceil(n * 0.15)"))
def q_n06(spark, sf):
    d = P.mask_tokens(views.ids(spark, sf), "sid", "ids", 0.15, 23, mask_id=0, pad=1, ceil_count=True)
    return d.select("sid", F.array_join(F.col("masked").cast("array<string>"), " ").alias("masked"),
                    F.array_join(F.col("target").cast("array<string>"), " ").alias("target"))


@register("n07_mask_weighted", with_views(f"""
    WITH p AS (SELECT sid, len(ids) AS n, unnest(range(len(ids))) AS i, unnest(ids) AS x FROM ids),
    r AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY
                 CASE WHEN i = 0 OR i = n - 1 OR x IN (1, 2, 3) THEN 1 ELSE 0 END, -ln({HU(29, 'sid', 'i')}) / (1.0 / (x + 1)), i) AS rk,
                 greatest(1, round(n * 0.2)) AS cnt FROM p)
    SELECT sid, string_agg(CAST(CASE WHEN rk <= cnt AND NOT (i = 0 OR i = n - 1 OR x IN (1, 2, 3)) THEN 0 ELSE x END AS VARCHAR), ' ' ORDER BY i) AS masked
    FROM r GROUP BY sid""", "ids"))
def q_n07(spark, sf):
    d = P.mask_weighted(views.ids(spark, sf), "sid", "ids", lambda x: F.when(x == 3, 0.0).otherwise(1.0 / (x + 1)), 0.2, 29, mask_id=0,
                        never=(1, 2))          # 3 has weight 0, as symbols without a count have (G-31)
    return d.select("sid", F.array_join(F.col("masked").cast("array<string>"), " ").alias("masked"))


def alias_sql(table, item, weight, big):
    """Walker's alias table in SQL, from (item, weight): light items take from the heavy
    item in whose interval of excess their own interval of lack begins."""
    return f"""
    v AS (SELECT {item} AS item, CAST({weight} AS {big}) AS w FROM {table} WHERE {weight} > 0),
    g AS (SELECT CAST(count(*) AS {big}) AS m, sum(w) AS total FROM v),
    cell AS (SELECT row_number() OVER (ORDER BY item) - 1 AS cell, item, w * m AS part, total FROM v, g),
    l AS (SELECT *, sum(total - part) OVER (ORDER BY item) AS hi, sum(total - part) OVER (ORDER BY item) - (total - part) AS lo FROM cell WHERE part < total),
    h AS (SELECT *, sum(part - total) OVER (ORDER BY item) AS hi, sum(part - total) OVER (ORDER BY item) - (part - total) AS lo, lead(item) OVER (ORDER BY item) AS nxt
          FROM cell WHERE part >= total),
    cells AS (
        SELECT l.cell, l.item, CAST(l.part AS DOUBLE) AS own, coalesce(h.item, l.item) AS alias FROM l LEFT JOIN h ON l.lo >= h.lo AND l.lo < h.hi
        UNION ALL
        SELECT cell, item, CAST(total - greatest(coalesce((SELECT max(l.hi) FROM l WHERE l.lo < h.hi), h.hi) - h.hi, 0) AS DOUBLE), coalesce(nxt, item) FROM h)"""


DRAW_SQL = """SELECT d.id, CASE WHEN (d.u * m - floor(d.u * m)) * CAST(total AS DOUBLE) < own THEN item ELSE alias END AS item
    FROM (SELECT *, CAST(floor(u * m) AS BIGINT) AS cell FROM d, g) d JOIN cells USING (cell)"""


@register("n08_draw_words", with_views(f"""
    WITH {alias_sql('(SELECT * FROM vocab WHERE NOT is_special)', 'id', 'count', 'HUGEINT')},
    d AS (SELECT sid AS id, {HU(31, 'sid')} AS u FROM sent)
    SELECT id AS sid, item AS id FROM ({DRAW_SQL})""", "sent_tok", extra=vocab_sql(threshold=3)))
def q_n08(spark, sf):
    v = _vocab(spark, sf, threshold=3).filter(~F.col("is_special"))
    draws = views.sent(spark, sf).select("sid", P.hash_uniform(31, "sid").alias("u"))
    return P.draw_by_weight(draws, "u", v, "id", "count").select("sid", "id")


@register("n09_draw_langs", with_views(f"""
    WITH c AS (SELECT lang, count(*) AS n FROM sent GROUP BY lang),
    p AS (SELECT lang, pow(n * 1.0 / sum(n) OVER (), 0.5) AS q FROM c),
    probs AS (SELECT lang, q / sum(q) OVER () AS prob FROM p),
    {alias_sql('probs', 'lang', 'prob', 'DOUBLE')},
    d AS (SELECT id, {HU(37, 'id')} AS u FROM pair)
    SELECT id, item AS lang FROM ({DRAW_SQL})""", "sent", "pair"))
def q_n09(spark, sf):
    probs = M.sampling_probs(views.sent(spark, sf), "lang", 0.5)
    draws = views.pair(spark, sf).select("id", P.hash_uniform(37, "id").alias("u"))
    return P.draw_by_weight(draws, "u", probs, "lang", "prob").select("id", "lang")


@register("j12_block_pairs_none", with_views(f"""
    WITH t AS (SELECT doc_id, line_no, list_append(tokens, '</s>') AS t FROM sent_tok),
    o AS (SELECT *, coalesce(sum(len(t)) OVER (ORDER BY doc_id, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM t),
    e AS (SELECT st + unnest(range(len(t))) AS off FROM o),
    b AS (SELECT off // 62 AS block, count(*) AS size FROM e GROUP BY off // 62),
    n AS (SELECT count(*) AS n FROM b),
    d AS (SELECT b.block, b.size, ({HU(53, 'b.block', "'next'")} < 0.5 AND b.block < n.n - 1) AS is_next,
                 floor({HU(53, 'b.block', "'rand'")} * (n.n - 2)) AS r2 FROM b, n),
    p AS (SELECT block, size, is_next,
                 CAST(CASE WHEN is_next THEN block + 1 WHEN r2 >= block THEN r2 + 2 ELSE r2 END AS BIGINT) AS pblock FROM d)
    SELECT p.block, p.is_next, p.pblock, 3 + p.size + q.size AS pair_size FROM p JOIN b q ON q.block = p.pblock""",
    "sent_tok"))
def q_j12(spark, sf):
    """J-12, 'none' mode: the stream cut into (block - 3) // 2 token halves
    (D-04, block 127), each paired with the next half (label 1, p = 1/2,
    never for the last) or a random half outside {i, i+1} (J-11 rule)."""
    from tessera.operators.batching import token_blocks
    s = views.sent_tokens(spark, sf).select("doc_id", "line_no", F.concat("tokens", F.array(F.lit("</s>"))).alias("t"))
    fine, coarse = I.pair_key_buckets("doc_id", "line_no")
    blocks = token_blocks(s, "t", (127 - 3) // 2, [F.col("doc_id"), F.col("line_no")], fine, coarse)
    blocks = blocks.select(F.col("block").cast("long").alias("block"), F.size("tokens").alias("size"))
    n = blocks.count()  # number of halves (one scalar)
    pairs = P.next_sentence(blocks, "block", n, 53)
    return pairs.select("block", "is_next", F.col("prow").cast("long").alias("pblock"),
                        (3 + F.col("size") + F.col("p_size")).alias("pair_size"))


def _cuts(side):
    """Tokens of a side that go from the front, counted one by one."""
    return f"(SELECT count(*) FROM range(1, {side}_cut + 1) r(j) WHERE {HU(59, f"'{side}'", 'doc', 's', 'j')} < 0.5)"


@register("j12_doc_pairs", with_views(f"""
    WITH RECURSIVE l AS (SELECT doc_id, line_no, len(tokens) + 1 AS size FROM sent_tok),
    g AS (SELECT *, sum(CASE WHEN size = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS seg FROM l),
    k AS (SELECT *, dense_rank() OVER (ORDER BY doc_id, seg) - 1 AS doc FROM g WHERE size <> 1),
    st AS MATERIALIZED (SELECT doc, row_number() OVER w - 1 AS idx, CAST(size AS BIGINT) AS size, CAST(sum(size) OVER w AS BIGINT) AS cum
           FROM k WINDOW w AS (PARTITION BY doc ORDER BY line_no)),
    dl AS MATERIALIZED (SELECT doc, count(*) AS len, CAST(CASE WHEN {HU(59, "'short'", 'doc')} < 0.1 THEN 2 + floor({HU(59, "'target'", 'doc')} * 59) ELSE 61 END AS BIGINT) AS target
           FROM st GROUP BY doc),
    nd AS (SELECT count(*) AS n FROM dl),
    q AS (SELECT st.doc, st.idx AS s, cum - size AS before, target, len, cum - size + target AS v FROM st JOIN dl USING (doc)),
    e AS (SELECT q.doc, q.s, q.before, q.target, q.len, coalesce(p.idx, q.len - 1) AS e FROM q ASOF LEFT JOIN st p ON q.doc = p.doc AND q.v <= p.cum),
    c AS MATERIALIZED (SELECT *, CASE WHEN e - s + 1 > 2 THEN 1 + CAST(floor({HU(59, "'split'", 'doc', 's')} * (e - s - 1)) AS BIGINT) ELSE 1 END AS a,
                 {HU(59, "'label'", 'doc', 's')} > 0.5 AND e > s AS label FROM e),
    reach AS (SELECT doc, CAST(0 AS BIGINT) AS s FROM dl
              UNION ALL SELECT c.doc, CASE WHEN c.label THEN c.e + 1 ELSE c.s + c.a END FROM reach r JOIN c ON c.doc = r.doc AND c.s = r.s
              WHERE CASE WHEN c.label THEN c.e + 1 ELSE c.s + c.a END < c.len),
    u AS (SELECT c.*, x.cum AS a_cum, floor({HU(59, "'doc'", 'c.doc', 'c.s')} * (n - 1)) AS o FROM reach JOIN c USING (doc, s) JOIN st x ON x.doc = c.doc AND x.idx = c.s + c.a - 1, nd),
    t AS (SELECT *, CASE WHEN label THEN doc WHEN o >= doc THEN CAST(o + 1 AS BIGINT) ELSE CAST(o AS BIGINT) END AS b_doc FROM u),
    own AS (SELECT t.doc, t.s, t.label, t.before, t.a_cum, t.b_doc, t.a_cum AS b_before, y.cum AS b_cum FROM t JOIN st y ON y.doc = t.doc AND y.idx = t.e WHERE t.label),
    f0 AS (SELECT t.*, dl.len AS b_docs, CAST(floor({HU(59, "'start'", 't.doc', 't.s')} * dl.len) AS BIGINT) AS b0 FROM t JOIN dl ON dl.doc = t.b_doc WHERE NOT t.label),
    f1 AS (SELECT f0.*, y.cum - y.size AS b_before, y.cum - y.size + greatest(f0.target - (f0.a_cum - f0.before), 1) AS v FROM f0 JOIN st y ON y.doc = f0.b_doc AND y.idx = f0.b0),
    f2 AS (SELECT f1.*, coalesce(p.idx, f1.b_docs - 1) AS b1 FROM f1 ASOF LEFT JOIN st p ON f1.b_doc = p.doc AND f1.v <= p.cum),
    far AS (SELECT f2.doc, f2.s, f2.label, f2.before, f2.a_cum, f2.b_doc, f2.b_before, y.cum AS b_cum FROM f2 JOIN st y ON y.doc = f2.b_doc AND y.idx = f2.b1),
    z AS (SELECT *, a_cum - before AS la, b_cum - b_before AS lb, greatest(a_cum - before + b_cum - b_before - 61, 0) AS over FROM (SELECT * FROM own UNION ALL SELECT * FROM far)),
    z1 AS (SELECT *, CASE WHEN la > lb THEN least(over, la - lb) ELSE 0 END + (over - least(over, abs(la - lb))) // 2 AS a_cut,
                  CASE WHEN la > lb THEN 0 ELSE least(over, lb - la) END + (over - least(over, abs(la - lb)) + 1) // 2 AS b_cut FROM z),
    z2 AS (SELECT *, {_cuts('a')} AS a_front, {_cuts('b')} AS b_front FROM z1),
    z3 AS (SELECT *, before + a_front + 1 AS v1, a_cum - (a_cut - a_front) AS v2, b_before + b_front + 1 AS v3, b_cum - (b_cut - b_front) AS v4 FROM z2),
    y1 AS (SELECT z3.*, p.idx AS a_start, p.cum - p.size AS p1 FROM z3 ASOF JOIN st p ON z3.doc = p.doc AND z3.v1 <= p.cum),
    y2 AS (SELECT y1.*, p.idx AS a_end FROM y1 ASOF JOIN st p ON y1.doc = p.doc AND y1.v2 <= p.cum),
    y3 AS (SELECT y2.*, p.idx AS b_start, p.cum - p.size AS p3 FROM y2 ASOF JOIN st p ON y2.b_doc = p.doc AND y2.v3 <= p.cum),
    y4 AS (SELECT y3.*, p.idx AS b_end FROM y3 ASOF JOIN st p ON y3.b_doc = p.doc AND y3.v4 <= p.cum)
    SELECT doc, s, label, a_start, v1 - 1 - p1 AS a_offset, a_end, la - a_cut AS a_len, b_doc, b_start, v3 - 1 - p3 AS b_offset, b_end, lb - b_cut AS b_len,
           3 + la - a_cut + lb - b_cut AS size FROM y4""", "sent_tok"))
def q_j12_doc(spark, sf):
    """J-12, 'doc' mode: block 64, lines as sentences (with an end symbol), empty
    lines separate documents."""
    from tessera.operators.doc_pairs import doc_pairs, documents_of_lines
    s = views.sent_tokens(spark, sf).select("doc_id", "line_no", (F.size("tokens") + 1).alias("size"))
    return doc_pairs(documents_of_lines(s, "doc_id", "line_no", "size"), 64, 59)
