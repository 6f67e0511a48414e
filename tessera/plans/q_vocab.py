"""Queries: vocabulary, encoding, decoding (G-01..G-07, B-02..B-04, J-02, J-03, J-17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import vocab as V
from tessera.plans import views
from tessera.plans.oracle import with_views
from tessera.plans.registry import register
from tessera.session import cut_lineage

COUNTS_SQL = """
  SELECT symbol, count(*) AS count
  FROM (SELECT unnest(list_append(tokens, '</s>')) AS symbol FROM sent_tok) GROUP BY symbol"""
SPEC_SQL = "SELECT * FROM (VALUES (0, '<s>'), (1, '<pad>'), (2, '</s>'), (3, '<unk>')) t(id, symbol)"


def vocab_sql(threshold: int = -1, nwords: int = -1, pad: int = 8, specials=None) -> dict:
    specials = specials or V.SPECIALS
    ns = len(specials)
    cond = f"count >= {threshold}" if threshold > 0 else "TRUE"
    lim = f"WHERE rk <= {nwords - ns}" if nwords > 0 else ""
    spec = "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(specials)) + ") t(id, symbol)"
    return {
        "counts": COUNTS_SQL,
        "spec": spec,
        "ranked": f"""
          SELECT row_number() OVER (ORDER BY count DESC, symbol) AS rk, symbol, count
          FROM counts WHERE symbol NOT IN (SELECT symbol FROM spec) AND {cond}""",
        "words": f"SELECT CAST({ns - 1} + rk AS INTEGER) AS id, symbol, count FROM ranked {lim}",
        "nw": f"SELECT count(*) + {ns} AS n FROM words",
        "fill": f"""
          SELECT CAST(n + i AS INTEGER) AS id, printf('madeupword%04d', i) AS symbol, CAST(0 AS BIGINT) AS count
          FROM nw, range({pad}) r(i) WHERE i < ({pad} - n % {pad}) % {pad}""",
        "vocab": """
          SELECT s.id, s.symbol, CAST(coalesce(c.count, 0) AS BIGINT) AS count, TRUE AS is_special
          FROM spec s LEFT JOIN counts c USING (symbol)
          UNION ALL SELECT id, symbol, count, FALSE FROM words
          UNION ALL SELECT id, symbol, count, FALSE FROM fill""",
    }


def _vocab(spark, sf, threshold=-1, nwords=-1, materialize=False):
    v = V.build_vocab(views.sent_tokens(spark, sf), threshold=threshold, nwords=nwords)
    # The vocabulary feeds a size check and a join: materialise it once in
    # the shared checkpoint folder instead of recomputing the corpus count.
    return cut_lineage(v) if materialize else v


@register("b01_tokenize", with_views(
    "SELECT sid, CAST(len(tokens) AS BIGINT) AS ntok, array_to_string(tokens, ' ') AS toks FROM sent_tok",
    "sent_tok"))
def q_b01(spark, sf):
    s = views.sent_tokens(spark, sf)
    return s.select("sid", F.size("tokens").cast("long").alias("ntok"), F.array_join("tokens", " ").alias("toks"))


@register("g01_count_vocab", with_views(COUNTS_SQL, "sent_tok"))
def q_g01(spark, sf):
    return V.count_vocab(views.sent_tokens(spark, sf))


@register("g04_finalize_vocab", with_views("SELECT * FROM vocab", "sent_tok", extra=vocab_sql(threshold=2)))
def q_g04(spark, sf):
    return _vocab(spark, sf, threshold=2)


@register("g04_finalize_vocab_nwords", with_views("SELECT * FROM vocab", "sent_tok",
                                                  extra=vocab_sql(nwords=1000)))
def q_g04n(spark, sf):
    return _vocab(spark, sf, nwords=1000)


ENC_EXTRA = {
    "enc": "SELECT t.sid, t.pos, t.tok, coalesce(v.id, 3) AS tid FROM tok t LEFT JOIN vocab v ON t.tok = v.symbol",
}


@register("b02_encode", with_views("""
    SELECT s.sid, trim(coalesce(e.ids || ' ', '') || '2') AS ids
    FROM sent s LEFT JOIN (SELECT sid, string_agg(CAST(tid AS VARCHAR), ' ' ORDER BY pos) AS ids
                           FROM enc GROUP BY sid) e USING (sid)""",
    "tok", extra={**vocab_sql(threshold=3), **ENC_EXTRA}))
def q_b02(spark, sf):
    s = views.sent_tokens(spark, sf)
    v = _vocab(spark, sf, threshold=3, materialize=True)
    e = V.encode(s, ["sid"], v)
    return e.select("sid", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@register("g06_encode_stats", with_views("""
    SELECT (SELECT count(*) FROM sent) AS nseq,
           (SELECT count(*) FROM sent) + (SELECT count(*) FROM enc) AS ntok,
           (SELECT count(*) FROM enc WHERE tid = 3 AND tok <> '<unk>') AS nunk,
           (SELECT count(DISTINCT tok) FROM enc WHERE tid = 3 AND tok <> '<unk>') AS n_replaced_words""",
    "tok", extra={**vocab_sql(threshold=3), **ENC_EXTRA}))
def q_g06(spark, sf):
    s = views.sent_tokens(spark, sf)
    v = _vocab(spark, sf, threshold=3, materialize=True)
    return V.encode_stats(V.lookup_tokens(s, ["sid"], v), ["sid"])
