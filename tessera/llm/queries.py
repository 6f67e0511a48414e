"""Registered queries of the llm operators, over whole given tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(sql: str | None = None):
    def deco(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register()
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import secrets
    return secrets.report(table(spark, sf_dir, "documents"))


NEAR_DEDUP_SQL = r"""
WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 2), ' ') AS s
       FROM dw, LATERAL (SELECT unnest(range(1, greatest(len(w) - 1, 2))) AS p) WHERE len(w) > 0),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
way AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, way.b FROM reach JOIN way ON reach.b = way.a)
SELECT d.doc_id, coalesce(size.n, 0) AS n_shingles, r.low AS component_id, d.doc_id = r.low AS kept
FROM documents d LEFT JOIN size USING (doc_id) JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) r ON r.a = d.doc_id
"""


@register(NEAR_DEDUP_SQL)
def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import near_dedup
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85, words=3).drop("node")


DECONTAMINATE_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(list_slice(w, p, p + least(len(w), 10) - 1), ' ') AS s
        FROM iw, LATERAL (SELECT unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT m FROM win),
dwin AS (SELECT doc_id, m, p, array_to_string(list_slice(w, p, p + m - 1), ' ') AS s
         FROM dw, sizes, LATERAL (SELECT unnest(range(1, len(w) - m + 2)) AS p) WHERE len(w) >= m),
hit AS (SELECT doc_id, dwin.m, p, item FROM dwin JOIN win ON dwin.m = win.m AND dwin.s = win.s),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@register(DECONTAMINATE_SQL)
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import decontaminate
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SUBSTRING_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(list_slice(w, p, p + 19), ' ') AS s FROM w, LATERAL (SELECT unnest(range(1, len(w) - 18)) AS p) WHERE len(w) >= 20),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS p FROM later),
word AS (SELECT doc_id, p, w[p] AS word FROM w, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS p)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM word WHERE (doc_id, p) NOT IN (SELECT doc_id, p FROM gone) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(lost.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
"""


@register(SUBSTRING_SQL)
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import substrings
    return substrings.report(table(spark, sf_dir, "documents"))


LINE_SQL = r"""
WITH line AS (SELECT doc_id, source, i, string_split(text, chr(10))[i] AS raw
              FROM (SELECT doc_id, coalesce(source, '') AS source, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
bare AS (SELECT *, trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS t FROM line),
spread AS (SELECT t, min((doc_id, i)) AS first FROM bare WHERE t <> '' GROUP BY t HAVING count(DISTINCT source) >= 10),
judged AS (SELECT bare.*, spread.t IS NOT NULL AND (doc_id, i) <> first AS gone FROM bare LEFT JOIN spread ON bare.t = spread.t),
doc AS (SELECT doc_id, count(*) FILTER (WHERE t <> '') AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
               string_agg(raw, chr(10) ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM judged GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN doc USING (doc_id)
"""


@register(LINE_SQL)
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import line_dedup
    return line_dedup.report(table(spark, sf_dir, "documents"))


@register()
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import sharding
    return sharding.assign(table(spark, sf_dir, "documents"))


@register()
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import packing
    return packing.pack(table(spark, sf_dir, "documents"))


WARC_SQL = r"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS last,
             array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform([15, 10, 5, 0],
               lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, g * 5 + 1, 5) AS BIGINT) >> s) & 31 AS BIGINT) + 1, 1)), '')), '') AS payload_digest FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to FROM q
"""


@register(WARC_SQL)
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import warc
    return warc.round_trip(table(spark, sf_dir, "pages"))


@register()
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import quality
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register()
def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import lm_score
    return lm_score.scored(table(spark, sf_dir, "documents"))


@register()
def op11_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm import bpe_codec
    return bpe_codec.report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@register()
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import runs
    return runs.report(table(spark, sf_dir, "documents"))


@register()
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import whitening
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
