"""A cross-section of registered queries compared with their DuckDB oracle
on the smallest data set (the full comparison is tests/oracle_check.py)."""

import pytest

from oracle_check import digest, duck

SF = "/root/testdata/sf0.001"
SAMPLE = ["b02_encode", "g04_finalize_vocab", "x01_row_ids", "x02_prefix_sum", "g19_bleu", "g15_spearman",
          "g16_tag_scores", "w01_token_batches", "d01_token_blocks", "j14_knn", "n05_mask_tokens",
          "a01_read_lines", "t02_stream_vocab", "w11_best_patience", "j15_knn_product_keys"]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_oracle(spark, con, name):
    import __spark_entry__ as E
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(rows) == len(drows)
    assert digest(df.columns, rows)[0] == digest(dcols, drows)[0]
