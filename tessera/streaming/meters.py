"""Structured Streaming operators (T-01..T-07).

Every stream runs with a checkpoint folder under the shared
``spark.checkpoint.dir`` (restart = resume, T-04).  Aggregations use update
mode and ``foreachBatch`` writes each micro-batch's changed rows with its
batch id; the materialised view is the latest row per key, so no window is
lost at the end of input (append mode would hold back open windows).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.sources.text import scratch_path


def read_stream(spark: SparkSession, path: str, schema, max_files: int | None = None,
                glob: str | None = None) -> DataFrame:
    """Parquet file stream over a folder (T-07: ``max_files`` files per
    micro-batch; ``glob`` picks files inside the folder)."""
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.parquet(path)


def run_upserts(stream: DataFrame, keys: Sequence[str], out: str, checkpoint: str) -> None:
    """Run an update-mode aggregate to completion (available data), writing
    every micro-batch's changed rows with the batch id."""
    def sink(batch: DataFrame, batch_id: int) -> None:      # a replayed batch overwrites its own folder
        batch.write.mode("overwrite").parquet(f"{out}/_batch={batch_id}")
    q = (stream.writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def latest(spark: SparkSession, out: str, keys: Sequence[str], schema_cols: Sequence[str]) -> DataFrame:
    """The materialised view: the last written row of every key."""
    d = spark.read.parquet(out)
    vals = [c for c in schema_cols if c not in keys]
    agg = d.groupBy(*keys).agg(F.max_by(F.struct(*vals), "_batch").alias("_v"))
    return agg.select(*keys, *[F.col("_v")[c].alias(c) for c in vals])


def run_append(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    q = (stream.writeStream.outputMode(mode).format("parquet").option("path", out)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def stream_meters(events: DataFrame, run, ts: str, value, n, watermark: str, window: str = "1 hour") -> DataFrame:
    """T-01: per run and event-time window: sum(value*n), sum(n), weighted
    mean and count (G-08 over a stream).  Events later than ``watermark`` behind
    the newest event are dropped by the engine: choose it from how late files
    may arrive."""
    e = events.select(F.col(run).alias("run") if isinstance(run, str) else run.alias("run"), F.col(ts).cast("timestamp").alias("ts"),
                      (F.col(value) if isinstance(value, str) else value).alias("value"), (F.col(n) if isinstance(n, str) else n).alias("n"))
    e = e.withWatermark("ts", watermark)
    return (e.groupBy("run", F.window("ts", window).alias("w"))
            .agg(F.sum(F.col("value") * F.col("n")).alias("sum"), F.sum("n").alias("count"), F.count(F.lit(1)).alias("events"))
            .select("run", F.col("w.start").alias("window_start"), "sum", "count", "events"))


def stream_vocab(docs: DataFrame) -> DataFrame:
    """T-02: additive symbol counters (one end symbol per line)."""
    from tessera.functions.text import tokenize
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line"))
    toks = lines.select(F.explode(F.concat(tokenize("line"), F.array(F.lit("</s>")))).alias("symbol"))
    return toks.groupBy("symbol").agg(F.count(F.lit(1)).alias("count"))


def stream_shards(stream: DataFrame, key: str, n: int, by_hash: bool = True) -> DataFrame:
    """T-03: stateless shard assignment (hash of the key, or key mod n)."""
    k = F.xxhash64(key) if by_hash else F.col(key)
    return stream.withColumn("shard", F.pmod(k, F.lit(n)))


# ------------------------------------------------------------------ T-06
BEST_STATE = "best double, last_imp long, idx long, next long, held long"
BEST_OUT = "run long, step long, best double, counter int, stop boolean"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OrderedBest(StatefulProcessor):
    """Best-so-far and patience of one run, step by step in order.  A step that
    arrives before its predecessor is held as map state until that comes; a step
    that comes again is ignored.  With event times, a timer gives a missing
    step up: when the watermark has passed a held step by ``wait_ms``, the run goes on
    from the lowest held one, and what is missing before it counts as ignored."""

    def __init__(self, patience: int, strict: bool, first: int, wait_ms: int | None):
        self.patience, self.strict, self.first, self.wait_ms = patience, strict, first, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", BEST_STATE)
        self.held = handle.getMapState("held", "step long", "value double, ts long")

    def _load(self) -> tuple[list, dict]:
        if not self.state.exists():
            return [None, 0, 0, self.first], {}
        best, last, idx, following, held = self.state.get()
        return [best, last, idx, following], {k[0]: (v[0], v[1]) for k, v in self.held.iterator()} if held else {}

    def _save(self, now: list, before: dict, held: dict) -> None:
        for step in before.keys() - held.keys():
            self.held.removeKey((step,))
        for step in held.keys() - before.keys():
            self.held.updateValue((step,), held[step])
            if self.wait_ms is not None:
                self.handle.registerTimer(held[step][1] + self.wait_ms)
        self.state.update((*now, len(held)))

    def _take(self, now: list, step: int, value: float) -> tuple:
        best, last, idx, _ = now
        idx += 1
        if best is None or (value > best if self.strict else value >= best):
            last = idx
        best = value if best is None else max(best, value)
        now[:] = [best, last, idx, step + 1]
        return step, best, idx - last, idx - last > self.patience

    def _drain(self, now: list, held: dict, rows: list) -> None:
        while now[3] in held:
            rows.append(self._take(now, now[3], held.pop(now[3])[0]))

    def _frame(self, key, rows: list) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["step", "best", "counter", "stop"])
        out.insert(0, "run", int(key[0]))
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, held = self._load()
        before = dict(held)
        for pdf in rows:
            out: list = []
            pdf = pdf.sort_values("step")
            times = pdf["ts"].astype("int64") // 1_000_000 if self.wait_ms is not None else pdf["step"]
            for step, value, ts in zip(pdf["step"].tolist(), pdf["value"].tolist(), times.tolist()):
                if step == now[3]:
                    out.append(self._take(now, step, value))
                    self._drain(now, held, out)
                elif step > now[3]:
                    held[step] = (value, ts)
            if out:
                yield self._frame(key, out)
        self._save(now, before, held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, held = self._load()
        before, out = dict(held), []
        at = expiredTimerInfo.getExpiryTimeInMs()
        while held and held[min(held)][1] + self.wait_ms <= at:
            now[3] = min(held)
            self._drain(now, held, out)
        self._save(now, before, held)
        if out:
            yield self._frame(key, out)

    def close(self) -> None:
        pass


def stream_best(metrics: DataFrame, patience: int, strict: bool = True, first: int = 1, wait_ms: int | None = None) -> DataFrame:
    """T-06: best-so-far and patience per run as keyed state (W-11 online), in
    the order of ``step`` from ``first`` on, however files and micro-batches are cut.
    ``metrics``: (run, step, value); with ``wait_ms`` also ``ts`` under a watermark."""
    processor = OrderedBest(patience, strict, first, wait_ms)
    return metrics.groupBy("run").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=BEST_OUT, outputMode="append", timeMode="None" if wait_ms is None else "EventTime")


def run_ordered(stream: DataFrame, out: str, checkpoint: str) -> None:
    """``run_append`` of a stream with map state and timers, which RocksDB holds."""
    conf = stream.sparkSession.conf
    before = conf.get("spark.sql.streaming.stateStore.providerClass", None)
    conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        run_append(stream, out, checkpoint)
    finally:
        conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else conf.set("spark.sql.streaming.stateStore.providerClass", before)


def encode_batches(stream: DataFrame, vocab: DataFrame, out: str, checkpoint: str, max_len: int, refused: str) -> None:
    """T-05: per micro-batch, split lines, set over-long ones aside (C-01) and
    encode the others with the static vocabulary (B-02).  Results go to ``out``,
    the ids of over-long lines to ``refused``; a batch owns a folder in each, so a
    replayed batch replaces what it wrote."""
    from tessera.functions.text import tokenize
    from tessera.operators.shaping import filter_by_size
    from tessera.operators.vocab import encode

    def sink(batch: DataFrame, batch_id: int) -> None:
        s = batch.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
        s = s.select((F.col("doc_id") * (1 << 31) + F.col("line_no")).alias("sid"), tokenize("text").alias("tokens"))
        s = s.withColumn("n", F.size("tokens"))
        kept, over = filter_by_size(s, {"n": max_len})
        encode(kept, ["sid"], vocab).write.mode("overwrite").parquet(f"{out}/_batch={batch_id}")
        over.write.mode("overwrite").parquet(f"{refused}/_batch={batch_id}")
    q = (stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


__all__ = ["read_stream", "run_upserts", "latest", "run_append", "stream_meters", "stream_vocab",
           "stream_shards", "stream_best", "run_ordered", "OrderedBest", "encode_batches", "scratch_path"]
