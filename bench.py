"""Headline-query benchmark.

Runs the headline operators at ``$BENCH_SF_DIR`` (default sf0.1) on
``local[$BENCH_CPUS]`` and prints one JSON line.  Every query is forced in
full with the ``noop`` sink (no driver collect); one warm-up run, then the
best of ``$BENCH_REPEAT`` timed runs.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "g01_count_vocab",        # vocabulary counts
    "g04_finalize_vocab",     # ranked vocabulary (two-phase ids)
    "b02_encode",             # encode the corpus with a built vocabulary
    "g06_encode_stats",       # encoding report
    "x01_row_ids",            # dense global row ids
    "w01_token_batches",      # prefix-sum batching
    "w03_greedy_batches",     # greedy size batches
    "g19_bleu",               # corpus BLEU
    "j14_knn",                # nearest neighbours
    "d01_token_blocks",       # fixed token blocks
    "d02_sentence_blocks",    # whole-sentence blocks (parallel scan)
    "g15_spearman",           # rank correlation
    "g20_bleu_multi_ref",     # BLEU with several references
    "j10_negatives",          # partners by rank in a group
    "n08_draw_words",         # weighted draws
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    os.environ["TESSERA_MASTER"] = f"local[{cpus}]"
    from tessera.plans.registry import QUERIES, load_all
    from tessera.session import get_session
    load_all()
    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    times: dict[str, float] = {}
    for name in HEADLINE:
        if name not in QUERIES:
            continue
        fn = QUERIES[name]
        try:
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
            best = None
            for _ in range(repeat):
                t0 = time.perf_counter()
                fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
                dt = time.perf_counter() - t0
                best = dt if best is None else min(best, dt)
            times[name] = round(best, 3)
        except Exception as e:  # noqa: BLE001 - report and continue
            print(f"bench: {name} failed: {type(e).__name__}: {str(e)[:200]}", file=sys.stderr)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
