"""Ordered keyed state (T-06): steps in any order, missing steps, repeated steps."""

import random
from datetime import datetime, timedelta

from tessera.streaming import meters as T


def want(values, patience):
    best, last, out = None, 0, []
    for i, (step, v) in enumerate(sorted(values.items()), 1):
        last = i if best is None or v > best else last
        best = v if best is None else max(best, v)
        out.append((step, best, i - last, i - last > patience))
    return out


def run(spark, tmp_path, batches, schema, **options):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = T.read_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, max_files=1)
    if options:
        s = s.withWatermark("ts", "0 seconds")
    T.run_ordered(T.stream_best(s, 3, **options), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).orderBy("run", "step").collect():
        got.setdefault(r.run, []).append((r.step, r.best, r.counter, r.stop))
    return got


def test_shuffled_steps_over_micro_batches(spark, tmp_path):
    rng = random.Random(2)
    runs = {r: {s: float(rng.randrange(30)) for s in range(1, 40)} for r in (1, 2, 3)}
    rows = [(r, s, v) for r, vs in runs.items() for s, v in vs.items()]
    rng.shuffle(rows)
    rows += rows[:5]                                                   # repeated steps change nothing
    got = run(spark, tmp_path, [rows[i::3] for i in range(3)], "run long, step long, value double")
    assert got == {r: want(v, 3) for r, v in runs.items()}


def test_a_missing_step_is_given_up(spark, tmp_path):
    t = datetime(2024, 1, 1)
    row = lambda s, minute, run=1: (run, s, float(s % 4), t + timedelta(minutes=minute))
    batches = [[row(1, 0), row(3, 1), row(4, 2)], [row(1, 60, run=2)], [row(2, 120, run=2)], [row(5, 130)]]      # step 2 of run 1 never comes
    got = run(spark, tmp_path, batches, "run long, step long, value double, ts timestamp", wait_ms=600_000)
    assert got[1] == want({s: float(s % 4) for s in (1, 3, 4, 5)}, 3) and got[2] == want({1: 1.0, 2: 2.0}, 3)
