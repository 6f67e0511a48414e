"""U-02 as one aggregate: nulls, other languages, no join in the plan."""

import contextlib
import io

from tessera.plans.registry import QUERIES, load_all


def test_common_words_without_a_join(spark, tmp_path):
    load_all()
    rows = [(1, "a b a\nc", "en"), (2, "b c\nb d", "fr"), (3, "a d", "de"), (4, None, "fr"), (None, "c", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["u02_common_words"](spark, str(tmp_path))
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        got.explain()
    assert sorted(r.tok for r in got.collect()) == ["b", "c"] and "Join" not in out.getvalue()
