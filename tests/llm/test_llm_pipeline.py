"""Registered queries and the pipeline."""

import re
from collections import Counter

import pytest

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"
NAMES = ["op1_near_dedup", "op3_decontaminate", "op6_substring_dedup", "op7_line_dedup", "op10_warc"]


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_sql(spark, name):
    import __spark_entry__ as E
    from oracle_check import digest, duck
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = duck(SF).execute(E.oracle_sql()[name])
    cols, other = [d[0] for d in cur.description], cur.fetchall()
    assert sorted(cols) == sorted(df.columns) and digest(df.columns, rows)[0] == digest(cols, other)[0]


def test_every_number_is_registered():
    import __spark_entry__ as E
    q = E.queries()
    assert all(any(re.match(rf"op{n}_", k) for k in q) for n in range(1, 11)) and "pipeline" in q


def test_stages_keep_columns_and_rows(spark, odd, odd_rows, nothing, tmp_path):
    bench = spark.createDataFrame([(1, " ".join(odd_rows[3][1].split()[5:25]))], "item_id bigint, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 1), (None, 0)], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = odd
    for name, stage in P.STAGES[:-1]:
        before = Counter((r.doc_id, r.source) for r in docs.collect())
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == odd.columns, name
        after = Counter((r.doc_id, r.source) for r in docs.collect())
        assert not after - before, name
        gone = before - after
        if name == "quality rules":
            assert (5, "s0") in gone and (6, "s0") in gone and (1, "s0") not in gone
        if name == "near-duplicates":
            assert gone and (1, "s0") not in gone or (None, "s0") in before
        if name == "decontamination":
            assert set(gone) == {(4, "s0")}
    packed = P.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    empty = nothing
    for _, stage in P.STAGES:
        empty = stage(spark, empty, str(tmp_path))
        assert empty.count() == 0


def test_run_over_the_whole_table(spark):
    out = P.run(spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert out and {r.doc_id for r in out} <= docs.keys()
    assert all(r.length <= 2048 for r in out)
    texts = Counter(docs[i] for i in {r.doc_id for r in out})
    assert max(texts.values()) == 1                       # no exact copy stays
