"""Operator 13: how far the sources of a language diverge, by dense matrices of term blocks.

Terms are runs of ASCII letters and characters beyond ASCII, of which only A-Z
are lower-cased.  A language keeps the terms that stand in ``min_docs`` of its
rows or more.  Every (lang, source) group and every language gives each kept
term a whole number p = 1 + floor(10^9 (count + 2) / (N + 2 V)), N being its
occurrences of the V kept terms, and two of them differ at a term by
floor((p - q)^2 / (p + q)).

Occurrences are counted per block of texts in Arrow tasks and summed by Spark.
Kept terms are dealt to blocks by their hash, about ``TERMS`` to a block, and
sources to bands of about ``GROUPS``.  A tile is a term block and two bands: it
is filled as a dense int64 matrix of groups by terms, and all pairs of its rows
are compared by broadcasting, a few columns at a time.  A tile gives partial
sums of its pairs and, for each group, the ``top`` terms by which it exceeds its
language; the sums are added up, the short lists merged by heaps.  A tile's
size doesn't grow with the table, and no join has a side that is sent to all
tasks unless Spark finds it small; joins by group are salted by term.

Null text, lang and source count as empty strings.  Texts without terms count
for no term, and their groups take part with counts of 0; with no kept term all
values are 0.  Very long texts are counted whole.  Repeated rows count each.  Ties
go to the item that is smaller in UTF-8.  An empty table and a language of one
source give no pairs.  Other columns are ignored.  Counts may reach 9e15.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .shared import small_batches, written

MIN_DOCS, TOP = 10, 10
#: Kept terms in a block and sources in a band, about.
TERMS, GROUPS = 2048, 128
#: Entries of a pair matrix that are compared at a time.
AT_ONCE = 1 << 20
#: Pieces that a group's terms are dealt to in joins by group.
SALT = 16
#: Bytes of text whose terms are counted together in a task.
BLOCK_BYTES = 8 << 20

_TERM = np.zeros(256, dtype=bool)
_TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _terms(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of a column as a dictionary array, and the row of each."""
    data, offsets = tb.text_bytes(column)
    inside = _TERM[data]
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    # texts lie side by side, so a term also ends where its text ends
    firsts = offsets[1:-1]
    firsts = np.unique(firsts[(firsts > 0) & (firsts < len(data))])
    joined = firsts[inside[firsts] & inside[firsts - 1]]
    start = np.sort(np.concatenate([np.flatnonzero(edge == 1), joined]))
    stop = np.sort(np.concatenate([np.flatnonzero(edge == -1), joined]))
    packed = tb.LOWER[data[inside]]
    ends = np.concatenate([[0], np.cumsum(stop - start)])
    terms = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(packed)])
    return terms.dictionary_encode(), np.searchsorted(offsets, start, side="right") - 1


def _count_block(batch: pa.RecordBatch) -> pa.RecordBatch:
    """lang, source, term, occurrences and rows of each term of a block, and a row without a term for each group."""
    groups = pa.StructArray.from_arrays([batch.column(0), batch.column(1)], names=["lang", "source"]).to_pylist()
    index: dict[tuple[str, str], int] = {}
    of_row = np.array([index.setdefault((g["lang"], g["source"]), len(index)) for g in groups], dtype=np.int64)
    terms, row = _terms(batch.column(2))
    code, many = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(terms.dictionary))
    in_row, times = np.unique(row * many + code, return_counts=True)  # a row and term
    key, at = np.unique(of_row[in_row // many] * many + in_row % many, return_inverse=True)
    n = np.bincount(at.reshape(-1), weights=times, minlength=len(key)).astype(np.int64)
    docs = np.bincount(at.reshape(-1), minlength=len(key)).astype(np.int64)
    names = pa.array([g[0] for g in index], pa.string()), pa.array([g[1] for g in index], pa.string())
    group = np.concatenate([key // many, np.arange(len(index))])
    term = terms.dictionary.cast(pa.string()).take(pa.array(np.concatenate([key % many, np.zeros(len(index), np.int64)]), mask=np.arange(len(group)) >= len(key)))
    none = np.zeros(len(index), np.int64)
    columns = [names[0].take(pa.array(group)), names[1].take(pa.array(group)), term, pa.array(np.concatenate([n, none])), pa.array(np.concatenate([docs, none]))]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, its occurrences n and its rows docs; each group also has a row with a null term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in tb.blocks(batches):
            held.append(batch)
            size += batch.nbytes
            if size >= BLOCK_BYTES:
                yield _count_block(pa.concat_batches(held))
                held, size = [], 0
        if held:
            yield _count_block(pa.concat_batches(held))

    small_batches(docs.sparkSession)
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    blocks = rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return blocks.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / (total + 2 kept)), exactly: long division, three digits at a time."""
    below = total + 2 * kept
    whole, rest = np.divmod(counts + 2, below)
    for _ in range(3):
        rest = rest * 1000
        whole, rest = whole * 1000 + rest // below, rest % below
    return whole + 1


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


_TILE = "lang string, source string, other string, value long, tops array<struct<value: long, item: string>>"


def _tile(table: pa.Table, top: int) -> pa.Table:
    """Partial sums of pairs, and the top terms of each group of a diagonal tile.

    Rows of sort 0 name a group and its N, those of sort 1 a kept term with its language's count, those of sort 2 a
    group's count of a term.
    """
    sort = table["sort"].to_numpy()
    lang, first, second = (table[c][0].as_py() for c in ("lang", "band", "band2"))
    kept, lang_total = table["kept"][0].as_py(), table["lang_total"][0].as_py()
    # sorted, so that a group and a term have one place, and ties go to the smaller item
    heads = table.filter(pa.array(sort == 0)).select(["source", "own_band", "total"]).sort_by("source")
    words = table.filter(pa.array(sort == 1)).select(["term", "n"]).sort_by("term")
    cells = table.filter(pa.array(sort == 2)).select(["source", "term", "n"])
    names, terms = heads["source"].combine_chunks(), words["term"].combine_chunks()
    counts = np.zeros((len(names), len(terms)), dtype=np.int64)
    if len(cells):
        import pyarrow.compute as pc

        counts[pc.index_in(cells["source"].combine_chunks(), names).to_numpy(), pc.index_in(cells["term"].combine_chunks(), terms).to_numpy()] = cells["n"].to_numpy()
    p = shares(counts, heads["total"].to_numpy()[:, None], kept) if len(terms) else counts
    band = heads["own_band"].to_numpy()
    a, b = np.flatnonzero(band == first), np.flatnonzero(band == second)
    sums = np.zeros((len(a), len(b)), dtype=np.int64)
    width = max(1, AT_ONCE // max(1, len(a) * len(b)))
    for at in range(0, len(terms), width):
        sums += _apart(p[a, None, at : at + width], p[None, b, at : at + width]).sum(axis=2)
    i, j = np.nonzero((a[:, None] < b[None, :]) | (first != second))
    out = {"source": names.take(pa.array(a[i])), "other": names.take(pa.array(b[j])), "value": pa.array(sums[i, j])}
    tops: list[tuple[str, list]] = []
    if first == second and len(terms):
        q = shares(words["n"].to_numpy(), np.int64(lang_total), kept)
        for g in a.tolist():
            more = np.flatnonzero((counts[g] > 0) & (p[g] > q))
            value = _apart(p[g, more], q[more])
            best = np.argsort(-value, kind="stable")[:top]
            if len(best):
                tops.append((names[g].as_py(), [{"value": v, "item": terms[t].as_py()} for v, t in zip(value[best].tolist(), more[best].tolist(), strict=True)]))
    kind = pa.list_(pa.struct([("value", pa.int64()), ("item", pa.string())]))
    n, m = len(i), len(tops)
    nothing = pa.nulls(m, pa.string()), pa.nulls(m, pa.int64())
    columns = [
        pa.array([lang] * (n + m), pa.string()),
        pa.concat_arrays([out["source"], pa.array([t[0] for t in tops], pa.string())]),
        pa.concat_arrays([out["other"], nothing[0]]),
        pa.concat_arrays([out["value"], nothing[1]]),
        pa.concat_arrays([pa.nulls(n, kind), pa.array([t[1] for t in tops], kind)]),
    ]
    return pa.Table.from_arrays(columns, names=["lang", "source", "other", "value", "tops"])


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank."""
    counts = written(term_counts(docs))
    # a term's list has an entry a source of its language
    terms = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.collect_list(F.struct("source", "n")).alias("each"))
    kept = written(terms.where(F.col("docs") >= min_docs).select("lang", "term", "lang_n", "each"))
    cells = kept.select("lang", "term", F.explode("each").alias("cell")).select("lang", "term", "cell.source", "cell.n")

    sizes = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    found = counts.where("term IS NULL").select("lang", "source")
    langs = found.groupBy("lang").agg(F.count("*").alias("sources")).join(sizes, "lang", "left").na.fill(0, ["kept", "lang_total"])
    langs = langs.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("kept") / TERMS)).cast("int")).withColumn("bands", F.ceil(F.col("sources") / GROUPS).cast("int"))
    langs = written(langs.drop("sources"))
    groups = found.join(cells.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").na.fill(0, ["total"]).join(langs, "lang")
    groups = written(groups.withColumn("own_band", F.pmod(F.xxhash64("source", F.lit(3)), F.col("bands")).cast("int")))

    salted = lambda rows: rows.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALT)).cast("int"))
    spread = lambda rows: rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    block = F.pmod(F.xxhash64("term", F.lit(5)), F.col("blocks")).cast("int").alias("block")
    meta = ["lang", "kept", "lang_total"]
    text, number = (F.lit(None).cast(t) for t in ("string", "long"))
    # each row goes to the tiles of its term block and of its band with every other band
    bands = F.explode(F.sequence(F.lit(0), F.col("bands") - 1)).alias("with")
    pair = (F.least("own_band", "with").alias("band"), F.greatest("own_band", "with").alias("band2"))
    head = groups.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).select("*", bands)
    head = head.select(*meta, "block", *pair, F.lit(0).alias("sort"), "source", "own_band", "total", text.alias("term"), number.alias("n"))
    word = salted(kept.select("lang", "term", "lang_n")).join(spread(langs), ["lang", "salt"]).select("*", block)
    word = word.select("*", F.explode(F.sequence(F.lit(0), F.col("bands") - 1)).alias("band")).select("*", F.explode(F.expr("sequence(band, bands - 1)")).alias("band2"))
    word = word.select(*meta, "block", "band", "band2", F.lit(1).alias("sort"), text.alias("source"), F.lit(-1).alias("own_band"), number.alias("total"), "term", F.col("lang_n").alias("n"))
    cell = salted(cells).join(spread(groups), ["lang", "source", "salt"]).select("*", block).select("*", bands)
    cell = cell.select(*meta, "block", *pair, F.lit(2).alias("sort"), "source", "own_band", "total", "term", "n")
    tiles = head.unionByName(word).unionByName(cell).groupBy("lang", "block", "band", "band2").applyInArrow(lambda table: _tile(table, top), _TILE)
    tiles = written(tiles)

    sums = tiles.where("other IS NOT NULL").groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    sums = written(sums)
    both = sums.select("lang", "source", F.col("other").alias("item"), "value").unionByName(sums.select("lang", F.col("other").alias("source"), F.col("source").alias("item"), "value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    def merge(table: pa.Table) -> pa.Table:
        """The first of a group's short lists, each of which is in order."""
        lists = [[(-x["value"], x["item"].encode()) for x in own] for own in table["tops"].to_pylist()]
        first = [x for x, _ in zip(heapq.merge(*lists), range(top), strict=False)]
        n = len(first)
        name = [[table[c][0].as_py()] * n for c in ("lang", "source")]
        return pa.table({"lang": pa.array(name[0], pa.string()), "source": pa.array(name[1], pa.string()), "part": pa.array(["term"] * n, pa.string()), "item": pa.array([x[1].decode() for x in first], pa.string()), "value": pa.array([-x[0] for x in first], pa.int64()), "rank": pa.array(np.arange(1, n + 1, dtype=np.int32))})

    merged = tiles.where("tops IS NOT NULL").select("lang", "source", "tops").groupBy("lang", "source")
    return pairs.unionByName(merged.applyInArrow(merge, "lang string, source string, part string, item string, value long, rank int"))


SQL = """
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), t AS (
  SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= 10
), langs AS (
  SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang
), groups AS (
  SELECT DISTINCT lang, source FROM d
), own AS (
  SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), totals AS (
  SELECT lang, source, coalesce(sum(n), 0) AS total FROM groups LEFT JOIN own USING (lang, source) GROUP BY lang, source
), p AS (
  SELECT lang, source, term, coalesce(own.n, 0) AS n,
         1 + 1000000000::HUGEINT * (coalesce(own.n, 0) + 2) // (totals.total + 2 * v)::HUGEINT AS p,
         1 + 1000000000::HUGEINT * (kept.n + 2) // (langs.total + 2 * v)::HUGEINT AS q
  FROM totals JOIN kept USING (lang) JOIN langs USING (lang) LEFT JOIN own USING (lang, source, term)
), pair AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups AS a JOIN groups AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))
