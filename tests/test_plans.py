"""Physical-plan properties of representative queries: column pruning and
filter pushdown reach the parquet scan, the vocabulary join is a broadcast
behind its size check, and the two-phase row ids never sort corpus rows in
a single partition."""

import re

import pytest

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def queries():
    import __spark_entry__ as E
    return E.queries()


def test_scan_reads_only_needed_columns(spark, queries):
    p = plan(queries["b01_tokenize"](spark, SF))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", p)
    assert schemas and all("n_chars" not in s and "source" not in s for s in schemas)


def test_filter_pushed_to_scan(spark, queries):
    p = plan(queries["c12_manifest_size"](spark, SF))
    assert "PushedFilters: [IsNotNull(n_chars), GreaterThanOrEqual(n_chars,200)]" in p


def test_vocabulary_join_is_broadcast(spark, queries):
    p = plan(queries["b02_encode"](spark, SF))
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p


def test_row_ids_do_not_sort_rows_in_one_partition(spark, queries):
    df = queries["x01_row_ids"](spark, SF)
    p = df._jdf.queryExecution().executedPlan().toString()
    # the only single-partition exchange feeds the per-coarse-bucket table,
    # which is an aggregate (one row per coarse bucket), never raw rows
    for m in re.finditer(r"Exchange SinglePartition", p):
        below = p[m.end():m.end() + 600]
        assert "HashAggregate" in below or "Exchange hashpartitioning(_cb" in below
