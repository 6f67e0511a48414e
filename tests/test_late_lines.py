"""Lines that are rendered behind the sort, and pairs of which the last counts."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.sources import text as S


def test_lines_are_rendered_behind_the_sort(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def shown(k):
        seen.add(1)
        return f"line {k}"

    d = spark.range(500).select((F.lit(499) - F.col("id")).alias("k")).repartition(7)
    S.write_lines(d, "k", shown("k").alias("l"), f"{tmp_path}/l")
    assert seen.value == 500          # once a line: borders are sampled without it
    assert sorted(map(tuple, S.read_lines(spark, f"{tmp_path}/l").collect())) == [(i, f"line {i}") for i in range(500)]


def test_token_start_is_found_where_a_text_has_tokens(spark):
    texts = ["", " ", "a", "\t\n", " ", " x", None, "\x1c\x85 \x0b", " b "]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [(r.a, r.b) for r in d.select(F.col("t").rlike(T.TOKEN_START).alias("a"), (F.size(T.tokenize("t")) > 0).alias("b")).collect()]
    assert all(bool(a) == bool(b) for a, b in got) and sum(bool(a) for a, _ in got) == 3


def test_last_pair_of_a_word_wins_within_and_across_batches(spark, tmp_path, monkeypatch):
    lines = ["a 1", "b\t2 x", "  a  3", "c  ", "\td", "a\x0b4 ", "e f g", "b 5", "a", "  6"]
    pad = [f"w{i % 700} {i}" for i in range(25_000)]
    rows = list(enumerate(lines[:8] + pad + lines[9:]))
    S.write_lines(spark.createDataFrame(rows, "k int, l string"), "k", "l", f"{tmp_path}/p")
    got = {r.src: r.tgt for r in S.read_align(spark, f"{tmp_path}/p").collect()}
    want = {f"w{i % 700}": str(i) for i in range(25_000)}
    assert got == {**want, "a": "4", "b": "5", "c": " ", "": "d", "e": "f", " ": "6"}
    S.write_lines(spark.createDataFrame([(0, "a 1"), (1, "  a  ")], "k int, l string"), "k", "l", f"{tmp_path}/bad")
    with pytest.raises(ValueError, match="malformed alignment line 1"):
        S.read_align(spark, f"{tmp_path}/bad")


def test_word_predictions_from_columns(spark, tmp_path):
    rows = [(2, "ab c", 0), (1, "", 0), (3, "x", 0), (2, "abc", 1)]
    d = spark.createDataFrame(rows, "k long, text string, seq int").repartition(3)
    tokens = T.tokenize("text")
    gaps = F.transform(F.sequence(F.lit(0), F.size(tokens)), lambda i: i * 0.25)
    words = F.transform(tokens, lambda t: F.length(t) / 4.0)
    S.write_word_predictions(d, "k", words, gaps, f"{tmp_path}/c")
    S.write_word_predictions(d.select("k", words.alias("w"), gaps.alias("g"), "seq"), "k", "w", "g", f"{tmp_path}/n")
    for f in ("c", "n"):
        assert [r.line for r in S.read_lines(spark, f"{tmp_path}/{f}/probs").orderBy("id").collect()] == [
            "0.00000", "0.00000 0.75000 0.25000", "0.00000 0.25000 0.25000"]
        assert [r.line for r in S.read_lines(spark, f"{tmp_path}/{f}/tags").orderBy("id").collect()] == ["BAD", "BAD OK BAD", "BAD BAD BAD"]
