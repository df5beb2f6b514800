"""Operator 10: repeated runs of lines, by a suffix array over line ids built by prefix doubling.

Each line gets an id; suffixes of the documents' id sequences are ranked by
their first 1, 2, 4, ... lines.  A round pairs a suffix's rank with that of the
suffix as many lines further on, sorts the different pairs by range partitions
and numbers them in order; a suffix whose rank no other has leaves, as nothing
longer repeats there.  Suffixes that share a prefix of some length form an
interval of the suffix array whose longest common prefix is at least that
length; two overlapping ranks name a prefix of any length.

A run of lines repeats if it holds ``min_words`` words or more and the same
lines stand elsewhere.  Every line of a run that also stands earlier (by
doc_id, then place) is deleted, so the first copy of every maximal run stays.
It is enough to compare the shortest runs of ``min_words`` words from each
line on and up to each line: every longer run is made of them, so the intervals
of those lengths are all that decides which lines of maximal runs go.

Lines end at ``\\n`` and are told apart by two independent 64-bit hashes of their
bytes; words are runs of ASCII letters, digits, underscores and characters beyond ASCII.  Null
texts count as empty, and an empty table gives an empty result.  Very long texts
are rows like others; a long line is one id.  Rows equal in doc_id and text count
as one document and get the same result each; a null doc_id comes first, and of
several texts of one doc_id the one with the smaller hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from . import textbytes as tb
from .shared import free_name, small_batches, written

#: Words of a run that repeats, at least: shorter lines go only where a run of them does.
MIN_WORDS = 5


def _lines(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, and start, stop, row and words of each line (an empty text has none)."""
    data, offsets = tb.text_bytes(column)
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return data, none, none, none, none
    filled = np.flatnonzero(offsets[:-1] < offsets[1:])
    newline = np.flatnonzero(data == 10)
    start = np.union1d(offsets[filled], newline + 1)
    # a newline that ends its text is followed by an empty line of that text
    row = np.searchsorted(offsets, start, side="right") - 1
    ends_text = np.isin(newline + 1, offsets[1:][filled])
    extra = newline[ends_text] + 1
    row_extra = np.searchsorted(offsets, newline[ends_text], side="right") - 1
    inside = start < len(data)
    start, row = start[inside], row[inside]
    starts, rows = np.concatenate([start, extra]), np.concatenate([row, row_extra])
    order = np.lexsort((starts, rows))
    starts, rows = starts[order], rows[order]
    next_start = np.append(starts[1:], 0)
    last = np.append(rows[1:] != rows[:-1], True)
    stops = np.where(last, offsets[1:][rows], next_start - 1)
    word_start, _, _ = tb.words(data, offsets)
    words = np.searchsorted(word_start, stops) - np.searchsorted(word_start, starts)
    return data, starts, stops, rows, words


def _shortest_runs(row: np.ndarray, words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First line and number of lines of the shortest runs of ``least`` words from each line on and up to each."""
    n = len(row)
    total = np.concatenate([[0], np.cumsum(words)])
    first = np.searchsorted(row, row, side="left")
    after = np.searchsorted(row, row, side="right")
    lines = np.arange(n)
    stop = np.searchsorted(total, total[:-1] + least, side="left")
    on = stop <= after
    begin = np.searchsorted(total, total[1:] - least, side="right") - 1
    upto = (begin >= first) & (total[1:] - least >= 0)
    runs = np.unique(np.stack([np.concatenate([lines[on], begin[upto]]), np.concatenate([stop[on] - lines[on], lines[upto] + 1 - begin[upto]])]), axis=1)
    return runs[0], runs[1]


def line_table(docs: DataFrame, min_words: int) -> DataFrame:
    """A row a line: document key, doc_id, place, id, and the lengths of the shortest runs that begin there."""
    doc_type = dict(docs.dtypes)["doc_id"]
    names = ["dk", "doc_id", "pos", "id", "id2", "runs"]

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.blocks(batches):
            data, start, stop, row, words = _lines(batch.column(2))
            begin, length = _shortest_runs(row, words, min_words)
            counts = np.bincount(begin, minlength=len(row)) if len(row) else np.zeros(0, dtype=np.int64)
            runs = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(length.astype(np.int32)))
            at = np.arange(len(row)) - np.searchsorted(row, row, side="left")
            ids = [tb.Rolling(data, seed).span(start, stop).view(np.int64) if len(row) else np.zeros(0, dtype=np.int64) for seed in (0, 1)]
            where = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), pa.array(at.astype(np.int32)), *map(pa.array, ids), runs], names=names)

    return docs.select("dk", "doc_id", "text").mapInArrow(lines, f"dk long, doc_id {doc_type}, pos int, id long, id2 long, runs array<int>")


def _ranked(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key another row shares, with the rank of their key among those keys."""
    spark = rows.sparkSession
    keys = rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = written(keys).repartitionByRange(parts, *key).sortWithinPartitions(*key).withColumn("rank", F.monotonically_increasing_id())
    return rows.join(written(keys), key)


def repeated_runs(lines: DataFrame) -> DataFrame:
    """Document key, first line and number of lines of the shortest runs that also stand earlier."""
    place = ["dk", "doc_id", "pos"]
    active = written(_ranked(lines, ["id", "id2"]).select(*place, "rank", "runs").dropDuplicates(["dk", "pos"]))
    found, level = [], 0
    while True:
        size = 1 << level
        need = active.agg(F.max(F.array_max("runs"))).first()[0]
        if need is None:
            break
        # runs of size to 2 * size - 1 lines are named by two ranks
        here = active.select(*place, "rank", F.explode(F.filter("runs", lambda n: (n >= size) & (n < 2 * size))).alias("lines"))
        second = active.select("dk", (F.col("pos")).alias("at"), F.col("rank").alias("rank2"))
        exact = here.where(F.col("lines") == size).withColumn("rank2", F.col("rank"))
        if level:
            wider = here.where(F.col("lines") > size).withColumn("at", F.col("pos") + F.col("lines") - size).join(second, ["dk", "at"]).drop("at")
            exact = exact.unionByName(wider)
        named = written(exact)
        key = ["lines", "rank", "rank2"]
        first = named.groupBy(*key).agg(F.min(F.struct("doc_id", "dk", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        # written, so that the copies of a common run needn't meet in the task that has found its first
        later = named.join(written(first), key).where(F.struct("doc_id", "dk", "pos") != F.col("first"))
        found.append(later.select("dk", "pos", "lines"))
        if need < 2 * size:
            break
        pairs = active.withColumn("at", F.col("pos") + size).join(second, ["dk", "at"]).drop("at")
        active = written(_ranked(pairs.withColumnRenamed("rank", "rank1"), ["rank1", "rank2"]).select(*place, "rank", "runs"))
        level += 1
    if not found:
        return lines.select("dk", "pos", F.lit(1).alias("lines")).limit(0)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, n_lines: str = "_n_lines", n_removed: str = "_n_removed") -> DataFrame:
    """All columns of docs with the text that is left, and the numbers of its lines and of those removed in two more columns."""
    small_batches(docs.sparkSession)
    docs = docs.drop(n_lines, n_removed)
    key, runs_name = free_name(docs, "_key"), free_name(docs, "_runs")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.withColumn(key, F.xxhash64("doc_id", text))
    lines = written(line_table(keyed.select(F.col(key).alias("dk"), "doc_id", text.alias("text")), min_words))
    runs = repeated_runs(lines).groupBy(F.col("dk").alias(key)).agg(F.collect_set(F.struct("pos", "lines")).alias(runs_name))
    out_schema = StructType([*[f if f.name != "text" else StructField("text", StringType()) for f in docs.schema.fields], StructField(n_lines, IntegerType()), StructField(n_removed, IntegerType())])
    names, n_columns, at = out_schema.names, len(docs.columns), docs.columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes, gone = [], [], []
            for x, runs in zip(batch.column(at).to_pylist(), batch.column(len(batch.schema) - 1).to_pylist(), strict=True):
                parts = x.split("\n") if x else []
                if runs:
                    keep = np.ones(len(parts), dtype=bool)
                    for r in runs:
                        keep[r["pos"] : r["pos"] + r["lines"]] = False
                    x = "\n".join([p for p, k in zip(parts, keep, strict=True) if k])
                    gone.append(len(parts) - int(keep.sum()))
                else:
                    gone.append(0)
                texts.append(x)
                sizes.append(len(parts))
            columns = [batch.column(i) for i in range(n_columns)]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int32()), pa.array(gone, pa.int32())], names=names)

    joined = keyed.withColumn("text", F.col("text").cast("string")).join(runs, key, "left").select(*docs.columns, runs_name)
    return joined.mapInArrow(cut, out_schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lines and deleted lines of each document, and the digest of the text that is left."""
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
