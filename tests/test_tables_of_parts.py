"""Tables that are folders of part files give the rows of single files."""

import __spark_entry__ as E
import pytest

DOCS = [(1, "en", "a b a\n\nc"), (2, "fr", "b " * 70), (3, "en", None), (4, "de", "")]


@pytest.mark.parametrize("name", ["t02_stream_vocab", "t05_stream_encode"])
def test_streams_read_folders_and_files(spark, tmp_path, name):
    d = spark.createDataFrame(DOCS, "doc_id long, lang string, text string")
    d.repartition(3, "doc_id").write.parquet(f"{tmp_path}/parts/documents.parquet")
    d.toPandas().to_parquet(tmp_path / "documents.parquet", index=False)
    parts, file = (sorted(map(tuple, E.queries()[name](spark, str(p)).collect()), key=str) for p in (tmp_path / "parts", tmp_path))
    assert parts and parts == file
