"""Queries: streaming operators run to completion over the given tables and
compared with the equivalent batch SQL (T-01..T-07)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans import views
from tessera.plans.oracle import with_views
from tessera.plans.q_vocab import COUNTS_SQL, _vocab, vocab_sql
from tessera.plans.registry import register
from tessera.session import read_table
from tessera.streaming import meters as T


def R(c, k=6):
    return F.round(F.col(c) if isinstance(c, str) else c, k)


def _stream(spark, sf: str, name: str, schema):
    """A file stream over a table, which is one parquet file inside the data folder
    or a folder of part files."""
    table = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf}/{name}.parquet")
    if table.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(table).isDirectory():
        return T.read_stream(spark, f"{sf}/{name}.parquet", schema)
    return T.read_stream(spark, sf, schema, glob=f"{name}.parquet")


@register("t01_stream_meters", """
    SELECT user_id AS run, date_trunc('hour', ts) AS window_start, round(sum(value * (event_id % 7 + 1)), 6) AS sum,
           sum(event_id % 7 + 1) AS count, count(*) AS events
    FROM events GROUP BY user_id, date_trunc('hour', ts)""")
def q_t01(spark, sf):
    ev = read_table(spark, sf, "events")
    s = _stream(spark, sf, "events", ev.schema)
    out, ck = T.scratch_path(spark, "t01"), T.scratch_path(spark, "t01-ck")
    meters = T.stream_meters(s, "user_id", "ts", "value", F.col("event_id") % 7 + 1, watermark="3650 days")
    T.run_upserts(meters, ["run", "window_start"], out, ck)
    r = T.latest(spark, out, ["run", "window_start"], ["run", "window_start", "sum", "count", "events"])
    return r.select("run", F.col("window_start").cast("timestamp_ntz").alias("window_start"), R("sum").alias("sum"),
                    "count", "events")


@register("t02_stream_vocab", with_views(COUNTS_SQL, "sent_tok"))
def q_t02(spark, sf):
    d = read_table(spark, sf, "documents")
    s = _stream(spark, sf, "documents", d.schema)
    out, ck = T.scratch_path(spark, "t02"), T.scratch_path(spark, "t02-ck")
    T.run_upserts(T.stream_vocab(s), ["symbol"], out, ck)
    return T.latest(spark, out, ["symbol"], ["symbol", "count"])


@register("t03_stream_shards", "SELECT event_id, event_id % 4 AS shard FROM events")
def q_t03(spark, sf):
    ev = read_table(spark, sf, "events")
    s = _stream(spark, sf, "events", ev.schema)
    out, ck = T.scratch_path(spark, "t03"), T.scratch_path(spark, "t03-ck")
    T.run_append(T.stream_shards(s, "event_id", 4, by_hash=False).select("event_id", "shard"), out, ck)
    return spark.read.parquet(out)


@register("t04_resume", "SELECT doc_id, lang FROM documents")
def q_t04(spark, sf):
    """Half the files, stop, more files arrive, restart from the checkpoint:
    every row is delivered exactly once."""
    d = read_table(spark, sf, "documents").select("doc_id", "lang")
    inbox, out, ck = T.scratch_path(spark, "t04-in"), T.scratch_path(spark, "t04"), T.scratch_path(spark, "t04-ck")
    d.filter(F.col("doc_id") % 2 == 0).write.parquet(inbox)
    T.run_append(T.read_stream(spark, inbox, d.schema), out, ck)
    d.filter(F.col("doc_id") % 2 == 1).write.mode("append").parquet(inbox)  # new files arrive
    T.run_append(T.read_stream(spark, inbox, d.schema), out, ck)              # resumes after the first files
    return spark.read.parquet(out)


@register("t05_stream_encode", with_views("""
    SELECT s.sid, CASE WHEN len(s.tokens) <= 60 THEN trim(coalesce(e.ids || ' ', '') || '2') END AS ids
    FROM sent_tok s LEFT JOIN (SELECT sid, string_agg(CAST(tid AS VARCHAR), ' ' ORDER BY pos) AS ids FROM enc GROUP BY sid) e
    USING (sid)""", "tok", extra={**vocab_sql(threshold=3), "enc": """
    SELECT t.sid, t.pos, t.tok, coalesce(v.id, 3) AS tid FROM tok t LEFT JOIN vocab v ON t.tok = v.symbol"""}))
def q_t05(spark, sf):
    d = read_table(spark, sf, "documents")
    v = _vocab(spark, sf, threshold=3, materialize=True)
    out, ck, over = T.scratch_path(spark, "t05"), T.scratch_path(spark, "t05-ck"), T.scratch_path(spark, "t05-over")
    T.encode_batches(_stream(spark, sf, "documents", d.schema), v, out, ck, 60, over)
    e = spark.read.parquet(out).select("sid", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))
    return e.union(spark.read.parquet(over).select("sid", F.lit(None).cast("string").alias("ids")))


@register("t06_stream_best", with_views("""
    WITH a AS (SELECT run, step, value, max(value) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb,
                      row_number() OVER (PARTITION BY run ORDER BY step) AS idx FROM metric),
    b AS (SELECT *, (pb IS NULL OR value > pb) AS imp FROM a),
    c AS (SELECT run, step, max(value) OVER (PARTITION BY run ORDER BY step ROWS UNBOUNDED PRECEDING) AS best,
                 idx - max(CASE WHEN imp THEN idx END) OVER (PARTITION BY run ORDER BY step ROWS UNBOUNDED PRECEDING) AS counter
          FROM b)
    SELECT run, step, round(best, 6) AS best, CAST(counter AS INTEGER) AS counter, counter > 20 AS stop FROM c""", "metric"))
def q_t06(spark, sf):
    m = views.metric(spark, sf).select("run", F.col("step").cast("long").alias("step"), "value")
    inbox, out, ck = T.scratch_path(spark, "t06-in"), T.scratch_path(spark, "t06"), T.scratch_path(spark, "t06-ck")
    m.repartition(6, F.xxhash64("run", "step")).write.parquet(inbox)         # steps of a run in all files
    s = T.read_stream(spark, inbox, m.schema, max_files=2)                   # and in all micro-batches
    T.run_ordered(T.stream_best(s, patience=20), out, ck)
    r = spark.read.parquet(out)
    return r.select("run", "step", R("best").alias("best"), "counter", "stop")


@register("t07_micro_batches", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def q_t07(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "lang")
    inbox, out, ck = T.scratch_path(spark, "t07-in"), T.scratch_path(spark, "t07"), T.scratch_path(spark, "t07-ck")
    d.repartition(6, "doc_id").write.parquet(inbox)
    s = T.read_stream(spark, inbox, d.schema, max_files=2)  # read N files, then process
    T.run_upserts(s.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), ["lang"], out, ck)
    return T.latest(spark, out, ["lang"], ["lang", "n"])
