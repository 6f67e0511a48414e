"""Line-aligned text sources (A-01..A-14) and sinks (A-15..A-21).

Line numbers without a driver pass or a single-partition window: every
line carries (file path, split start offset, in-split order); the split
start is data (the scan's ``_metadata.file_block_start``) and the in-split
order is the read order, so the lines of the splits before and the place in the
split give exact 0-based file-order ids.  Content
is parsed with regular expressions, never evaluated.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import interleave, parse_int_list, parse_spans
from tessera.operators.ids import with_row_id
from tessera.session import cut_lineage, ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A-01: ``(id, line)``, id = 0-based line number over the files of
    ``path`` in file order (newline stripped).  Part files are in order of their
    part *number* (beyond 99 999 its digits grow), other files in path order."""
    raw = cut_lineage(spark.read.text(path)
                      .select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("_f"),
                              F.col("_metadata.file_block_start").alias("_b"),
                              F.monotonically_increasing_id().alias("_m")),  # in-split read order
                      compression="zstd")
    # lines stay where they were read: a split is in one partition, so its first
    # number and the lines of the splits before it (one row a split) give the id
    in_order = F.concat(F.regexp_extract("_f", r"^(.*/)[^/]*$", 1),
                        F.lpad(F.regexp_extract("_f", r"/part-(\d+)[^/]*$", 1), 20, "0"), "_f")
    splits = raw.groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_first")).withColumn("_o", in_order)
    before = Window.orderBy("_o", "_b").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("_f", "_b", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_off"))
    return raw.join(F.broadcast(splits), ["_f", "_b"]).select((F.col("_off") + F.col("_m")).alias("id"), "line")


def read_parallel(spark: SparkSession, paths: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """A-02: zip several line-aligned files by line number.  Returns the
    zipped rows and the ids present in some files only (must be empty)."""
    frames = {k: read_lines(spark, p).withColumnRenamed("line", k) for k, p in paths.items()}
    names = list(frames)
    out = frames[names[0]]
    for k in names[1:]:
        out = out.join(frames[k], "id", "full")
    cond = None
    for k in names:
        c = F.col(k).isNull()
        cond = c if cond is None else cond | c
    return out.filter(~cond), out.filter(cond).select("id")


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """A-06: one float per line."""
    return read_lines(spark, path).select("id", F.trim("line").cast("double").alias("score"))


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """A-07: whitespace separated integer tags per line."""
    return read_lines(spark, path).select("id", parse_int_list("line").alias("tags"))


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    """A-08: '[(s, e), ...]' per line (inclusive ends)."""
    return read_lines(spark, path).select("id", parse_spans("line").alias("spans"))


def read_vocab(spark: SparkSession, path: str, nspecial: int = 4) -> DataFrame:
    """A-09: 'symbol count' per line split at the *last* space; ids follow
    the specials.  A malformed line fails the read (bounded check)."""
    lines = read_lines(spark, path)
    parsed = lines.select("id", F.regexp_extract("line", r"^(.*) (\d+)$", 1).alias("symbol"),
                          F.regexp_extract("line", r"^(.*) (\d+)$", 2).alias("c"))
    if parsed.filter(F.col("c") == "").limit(1).count() > 0:
        raise ValueError("malformed vocabulary line: expected '<symbol> <count>'")
    return parsed.select((F.col("id") + nspecial).cast("int").alias("id"), "symbol",
                         F.col("c").cast("long").alias("count"))


def read_vocab_clean(spark: SparkSession, path: str, nspecial: int = 14) -> DataFrame:
    """A-10: skip lines with U+2028, lines without exactly two fields and
    repeated symbols (first occurrence wins); ids re-packed after the
    specials."""
    lines = read_lines(spark, path).filter(~F.col("line").contains("\u2028"))
    parts = lines.select("id", F.split(F.rtrim("line"), " ").alias("p")).filter(F.size("p") == 2)
    first = parts.groupBy(F.col("p")[0].alias("symbol")).agg(
        F.min(F.struct("id", F.col("p")[1].alias("c"))).alias("m"))
    first = first.select("symbol", F.col("m.id").alias("line_id"), F.col("m.c").cast("long").alias("count"))
    r = with_row_id(first, [F.col("line_id")], fine=[F.floor(F.col("line_id") / 65536)],
                    coarse=[F.floor(F.col("line_id") / (1 << 26))], out="rank")
    return r.select((F.col("rank") + nspecial).cast("int").alias("id"), "symbol", "count")


def read_vectors(spark: SparkSession, path: str, dim: int, keep: str = "last") -> DataFrame:
    """A-11: 'word v1 ... vd' lines after a header line; rows of the wrong
    dimension are dropped; repeated words keep the ``last`` (or ``first``)."""
    lines = read_lines(spark, path).filter(F.col("id") > 0)
    parts = lines.select("id", F.split(F.rtrim("line"), " ").alias("p"))
    parts = parts.filter(F.size("p") == dim + 1).select(
        "id", F.col("p")[0].alias("word"), F.transform(F.slice("p", 2, dim), lambda x: x.cast("float")).alias("vec"))
    pick = F.max_by if keep == "last" else F.min_by
    return parts.groupBy("word").agg(pick("vec", "id").alias("vec"))


def _refuse(bad: DataFrame, what: str, expected: str) -> None:
    """Raise if there is a malformed row; looks at one row of each task at most."""
    row = bad.select("id").limit(1).first()
    if row is not None:
        raise ValueError(f"malformed {what} line {row['id']}: expected '{expected}'")


PAIRS = 1 << 20        # lines of which the last for each source word is taken at once


def _last_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(id, line)`` to ``(src, tgt, id)``; of some lines with one source word side by side only the last."""
    def reduced(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        ids, line = (t.column(c).chunk(0) for c in ("id", "line"))
        word = r"[^ \t\n\x0B\f\r]*"
        pair = pc.extract_regex(line, rf"^(?P<src>{word})[ \t\n\x0B\f\r]+(?P<tgt>{word})")
        src, tgt = pair.field("src"), pair.field("tgt")
        odd = np.flatnonzero(pair.is_null().to_numpy(zero_copy_only=False))             # bytes that are no UTF-8
        if len(odd):
            some = [re.match(r"([^ \t\n\x0B\f\r]*)[ \t\n\x0B\f\r]+([^ \t\n\x0B\f\r]*)", x.decode("utf-8", "replace")).groups()
                    for x in line.cast(pa.binary()).take(pa.array(odd)).to_pylist()]
            at = np.arange(len(line))
            at[odd] = len(line) + np.arange(len(odd))
            src, tgt = (pa.concat_arrays([a, pa.array(b, a.type)]).take(pa.array(at)) for a, b in zip((src, tgt), zip(*some)))
        code = src.dictionary_encode().indices.to_numpy()
        order = np.lexsort((ids.to_numpy(), code))
        at = pa.array(order[np.r_[code[order][1:] != code[order][:-1], True]])
        out = pa.table([src.take(at), tgt.take(at), ids.take(at)], names=["src", "tgt", "id"])
        yield from out.to_batches(max_chunksize=10_000)

    held, n = [], 0
    for b in batches:
        held, n = [*held, b], n + b.num_rows
        if n >= PAIRS:
            yield from reduced(held)
            held, n = [], 0
    if n:
        yield from reduced(held)


def read_align(spark: SparkSession, path: str) -> DataFrame:
    """A-12: 'src tgt' pairs; the last line for a source word wins.  A line
    without two fields fails the read."""
    lines = read_lines(spark, path)
    line = F.trim("line")
    _refuse(lines.filter(~line.rlike(r"\s")), "alignment", "<source> <target>")
    last = lines.select("id", line.alias("line")).mapInArrow(_last_pairs, "src string, tgt string, id bigint")
    return last.groupBy("src").agg(F.max_by("tgt", "id").alias("tgt"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A-13: first line = root folder, then 'name<TAB>size' rows; any other
    row fails the read."""
    lines = read_lines(spark, path)
    root = lines.filter(F.col("id") == 0).select(F.col("line").alias("root"))
    rows = lines.filter(F.col("id") > 0).select("id", F.split("line", "\t").alias("p"))
    _refuse(rows.filter((F.size("p") != 2) | ~F.element_at("p", -1).rlike(r"^\s*\d+\s*$")), "manifest", "<name><TAB><size>")
    rows = rows.select(F.col("p")[0].alias("fname"), F.col("p")[1].cast("long").alias("size"))
    root_value = root.first()["root"]  # one line
    return rows.select(F.lit(root_value).alias("root"), "fname", "size")


def read_labels(spark: SparkSession, path: str, regression: bool = False) -> DataFrame:
    """A-14: one label per line, trailing space stripped; regression labels
    must lie in [0, 5]."""
    lab = read_lines(spark, path).select("id", F.rtrim("line").alias("label"))
    if regression:
        lab = lab.withColumn("label", F.col("label").cast("double"))
        if lab.filter((F.col("label") < 0) | (F.col("label") > 5)).limit(1).count() > 0:
            raise ValueError("regression label outside [0, 5]")
    return lab


# ------------------------------------------------------------------ sinks
def write_lines(df: DataFrame, order: str, text: str | Column, path: str) -> None:
    """Ordered text output: a range-partitioned sort makes part files follow
    the global order, so reading the folder back keeps the line order.  A ``text``
    that is a Column is rendered behind the sort, which then samples, shuffles and
    sorts the columns of ``df`` (give no others than needed)."""
    rows = df.select(order, text) if isinstance(text, str) else df
    rows.orderBy(order).select(text).write.mode("overwrite").text(path)


def write_corpus(df: DataFrame, path: str, mode: str = "append") -> None:
    """A-15: Parquet corpus with id, ids, size; appending merges shards."""
    df.select("id", "ids", F.size("ids").alias("size")).write.mode(mode).parquet(path)


def write_vocab(vocab: DataFrame, path: str, nspecial: int = 4) -> None:
    """A-16: 'symbol count' lines in id order, specials omitted."""
    v = vocab.filter(F.col("id") >= nspecial).select("id", F.concat_ws(" ", "symbol", F.col("count").cast("string")).alias("l"))
    write_lines(v, "id", "l", path)


def predictions_lines(df: DataFrame, key: str, value: str, fmt: str = "%s") -> DataFrame:
    """A-17: one prediction per id, the last written duplicate wins
    (``max_by`` on the write sequence), rendered and ordered by id."""
    last = df.groupBy(key).agg(F.max_by(value, "seq").alias(value))
    return last.select(key, F.format_string(fmt, F.col(value)).alias("line"))


def write_predictions(df: DataFrame, key: str, value: str, path: str, fmt: str = "%s") -> None:
    """A-17 sink: one value a line in id order, the last written duplicate wins.
    The sorted parts are committed together, so a retried task leaves nothing."""
    write_lines(predictions_lines(df, key, value, fmt), key, "line", path)


def write_word_predictions(df: DataFrame, key: str, words: str | Column, gaps: str | Column, path: str, threshold: float = 0.5) -> None:
    """A-17 sink, word form: ``<path>/tags`` with OK or BAD and ``<path>/probs`` with
    five decimals, a sentence a line in id order: gap, word, gap, ..., word, gap.
    The last written duplicate wins (``seq``).  ``words`` and ``gaps`` may be Columns
    of the other columns of ``df``; they are made behind the shuffle."""
    # dealt by key ranges, rows are grouped, ordered and rendered where they are
    other = [c for c in df.columns if c not in (key, "seq")]
    last = df.repartitionByRange(key).groupBy(key).agg(F.max_by(F.struct(*other), "seq").alias("r")).select(key, "r.*")
    last = last.select(key, F.col(words).alias("w") if isinstance(words, str) else words.alias("w"),
                       F.col(gaps).alias("g") if isinstance(gaps, str) else gaps.alias("g"))
    last = last.select(key, interleave("g", "w").alias("p"))
    tags = F.transform("p", lambda x: F.when(x > threshold, F.lit("OK")).otherwise(F.lit("BAD")))
    probs = F.transform("p", lambda x: F.format_string("%.5f", x))
    for name, column in (("tags", tags), ("probs", probs)):
        write_lines(last, key, F.array_join(column, " ").alias("line"), f"{path}/{name}")


def write_report(sources: DataFrame, hyps: DataFrame, key: str, path: str, nbest: int = 1, alignment: bool = False) -> None:
    """A-18 sink: for each sentence its S- and T- line (T- only with a target),
    then H-, P- and, with ``alignment``, A- lines of its ``nbest`` best hypotheses
    (``rank`` from 1 on), in the order of ids.  ``sources``: (key, src, tgt); ``hyps``:
    (key, rank, score, hyp, pos_scores[, alignment])."""
    name = F.col(key).cast("string")

    def line(tag: str, *rest: Column) -> Column:
        return F.concat_ws("\t", F.concat(F.lit(f"{tag}-"), name), *rest)

    head = sources.select(F.struct(F.col(key).alias("k"), F.lit(0).alias("h"), F.lit(0).alias("t")).alias("o"), line("S", F.col("src")).alias("l")).unionByName(
        sources.filter(F.col("tgt").isNotNull()).select(F.struct(F.col(key).alias("k"), F.lit(0).alias("h"), F.lit(1).alias("t")).alias("o"), line("T", F.col("tgt")).alias("l")))
    kinds = [line("H", F.format_string("%.4f", "score"), F.col("hyp")), line("P", F.array_join(F.transform("pos_scores", lambda x: F.format_string("%.4f", x)), " "))]
    if alignment:
        kinds.append(line("A", F.array_join(F.col("alignment").cast("array<string>"), " ")))
    best = hyps.filter(F.col("rank") <= nbest)
    lines = best.select(key, "rank", F.posexplode(F.array(*kinds)).alias("t", "l"))
    lines = lines.select(F.struct(F.col(key).alias("k"), F.col("rank").cast("int").alias("h"), F.col("t")).alias("o"), "l")
    write_lines(head.unionByName(lines), "o", "l", path)


def write_refs(df: DataFrame, key: str, text: str, path: str, unk: str = "<unk>", bpe: str | None = "@@ ") -> None:
    """A-21 sink: ``export_refs`` as lines in id order."""
    write_lines(export_refs(df, text, unk, bpe), key, text, path)


def report_lines(df: DataFrame, key: str) -> DataFrame:
    """A-18: S-/T-/H-/P- lines per sentence (tab separated, positional
    scores with 4 decimals)."""
    rows = df.select(key, F.array(
        F.struct(F.lit(0).alias("k"), F.concat_ws("\t", F.concat(F.lit("S-"), F.col(key).cast("string")), "src").alias("l")),
        F.struct(F.lit(1).alias("k"), F.concat_ws("\t", F.concat(F.lit("T-"), F.col(key).cast("string")), "tgt").alias("l")),
        F.struct(F.lit(2).alias("k"), F.concat_ws("\t", F.concat(F.lit("H-"), F.col(key).cast("string")),
                                                  F.format_string("%.4f", "score"), "hyp").alias("l")),
        F.struct(F.lit(3).alias("k"), F.concat_ws("\t", F.concat(F.lit("P-"), F.col(key).cast("string")),
                                                  F.array_join(F.transform("pos_scores", lambda x: F.format_string("%.4f", x)), " ")).alias("l")),
    ).alias("a"))
    return rows.select(key, F.inline("a"))


def metrics_json(df: DataFrame, tag: str) -> DataFrame:
    """A-19: one JSON object per row, keys prefixed with the tag."""
    cols = [F.col(c).alias(f"{tag}_{c}") if c not in ("epoch", "num_updates") else F.col(c) for c in df.columns]
    return df.select(F.to_json(F.struct(*cols)).alias("json"))


def probs_lines(df: DataFrame, key: str, probs: str) -> DataFrame:
    """A-20: 'idx<TAB>p1,p2,...'."""
    return df.select(key, F.concat_ws("\t", F.col(key).cast("string"),
                                      F.array_join(F.col(probs).cast("array<string>"), ",")).alias("line"))


def export_refs(df: DataFrame, text: str, unk: str = "<unk>", bpe: str | None = "@@ ") -> DataFrame:
    """A-21: reference/hypothesis export: '<unk>' escaped as '<<unk>>' so it
    never matches, sub-word markers removed."""
    from tessera.functions.text import remove_bpe
    return df.withColumn(text, remove_bpe(F.replace(F.col(text), F.lit(unk), F.lit(f"<{unk}>")), bpe))


# ------------------------------------------------------------------ A-03..A-05
def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """File listing as a DataFrame (distributed listing; no file content)."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
            .select(F.col("path")))


def infer_language_pair(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """A-05: language pairs named by '<split>.<l1>-<l2>.<ext>' (a file or a
    folder of part files)."""
    pat = rf"/{split}\.([A-Za-z_]+)-([A-Za-z_]+)\.[A-Za-z_]+(/|$)"
    f = list_files(spark, folder).select(F.regexp_extract("path", pat, 1).alias("src"),
                                         F.regexp_extract("path", pat, 2).alias("tgt"))
    return f.filter(F.col("src") != "").distinct()


def read_shards(spark: SparkSession, folder: str, split: str, suffix: str) -> DataFrame:
    """A-03: shard set '<split>', '<split>1', '<split>2', ... probed in order,
    stopping at the first missing index; rows carry their shard number."""
    pat = rf"^(.*/{split}(\d*)\.{suffix})(/|$)"
    found = (list_files(spark, folder)
             .select(F.regexp_extract("path", pat, 1).alias("dir"), F.regexp_extract("path", pat, 2).alias("k"))
             .filter(F.col("dir") != "").distinct()
             .select("dir", F.when(F.col("k") == "", 0).otherwise(F.col("k").cast("int")).alias("shard")))
    listing = found.collect()  # one row per shard name, not per data row
    present = {r["shard"] for r in listing}
    keep = 0
    while keep in present:
        keep += 1
    out = None
    for r in sorted(listing, key=lambda r: r["shard"]):
        if r["shard"] < keep:
            d = read_lines(spark, r["dir"]).withColumn("shard", F.lit(r["shard"]))
            out = d if out is None else out.unionByName(d)
    return out


def epoch_path(paths: str, epoch: int) -> str:
    """A-04: colon-separated data folders used round-robin by epoch."""
    parts = paths.split(":")
    return parts[epoch % len(parts)]
