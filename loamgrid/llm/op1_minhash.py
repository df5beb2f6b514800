"""Operator 1: near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text is its shingles of five words, each weighing its count times the mean
inverse document frequency of its words.  Document frequencies are counted over
all texts, in ``DF_BINS`` bins of word hashes, so that their size is fixed.
Improved consistent weighted sampling draws ``BANDS * ROWS`` shingles of each
text; two texts draw the same with a probability equal to their weighted
Jaccard similarity.  Texts that agree on all draws of a band are candidates.

Equal texts are one node.  In each group of candidates every node is compared
with one of them, the group's hub (of the nodes the one in the largest groups),
by the weighted Jaccard similarity of their whole texts; a link needs
``similarity``.  The nodes that these links leave in different classes are then
compared with each other in all groups, by tiles of two blocks of a group's
nodes, so that of the nodes that agree on a band any two are compared or in one
class already.  A tile keeps the links that join classes.  So the texts that are
shuffled grow with the nodes times the blocks of their group, and the pairs
compared with the square of a group only if its texts are candidates and unlike.
Classes are the connected components of the links; ``n_links`` counts a text's
links to hubs and those that tiles keep.

Words are runs of ASCII letters, digits, underscores and characters beyond
ASCII, without regard to the case of A-Z.  A text of one to four words is one
shingle; null and empty texts have none and are like each other only.  An empty
table gives an empty result.  Very long texts are sketched whole, by themselves;
a comparison holds two of them.  The class id is the smallest doc_id of a class
(null if it has none).  Kept is the text with that doc_id, of several the one with
the smallest hash; rows that are equal in doc_id and text are members each, and
all of them are kept or none.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb
from .shared import small_batches, written

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 10, 4
DF_BINS = 1 << 16
#: Quantiles of a variate, each picked by 16 bits of its own, and shingles handled at a time.
_TABLE, _CHUNK = 1 << 16, 1 << 16
#: Nodes and bytes of text of a block, and shingles of a tile handled at a time.
BLOCK_NODES, BLOCK_BYTES, _COLUMNS = 400, 1 << 19, 1 << 11


# ---------------------------------------------------------------- shingles
def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each word."""
    data, offsets = tb.text_bytes(column)
    low = tb.LOWER[data]
    start, stop, row = tb.words(low, offsets)
    return row, tb.Rolling(low).span(start, stop) if len(start) else np.zeros(0, dtype=np.uint64)


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency of each bin of word hashes, over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, texts = np.zeros(DF_BINS + 1, dtype=np.int64), 0
        for batch in tb.blocks(batches):
            row, words = _words(batch.column(0))
            pairs = np.unique(row * DF_BINS + (words & np.uint64(DF_BINS - 1)).astype(np.int64))
            total[:DF_BINS] += np.bincount(pairs % DF_BINS, minlength=DF_BINS)
            total[DF_BINS] += batch.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"at": at, "n": total[at]})

    counts = np.zeros(DF_BINS + 1)
    rows = docs.select(docs["text"].cast("string").alias("text")).mapInArrow(count, "at long, n long")
    for r in rows.groupBy("at").agg(F.sum("n").alias("n")).collect():  # DF_BINS + 1 rows at most
        counts[r["at"]] = r["n"]
    return (np.log((counts[DF_BINS] + 1) / (counts[:DF_BINS] + 1)) + 0.1).astype(np.float32)


def shingles(column: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and weight of the different shingles of each text, by row."""
    row, words = _words(column)
    if not len(row):
        return row, words, np.zeros(0, dtype=np.float32)
    n = len(row)
    weight = idf[(words & np.uint64(DF_BINS - 1)).astype(np.int64)].astype(np.float64)
    size = np.bincount(row)[row]
    first = np.searchsorted(row, row, side="left")
    at = np.arange(n)
    begins = np.flatnonzero(np.where(size >= SHINGLE, at - first <= size - SHINGLE, at == first))
    length = np.minimum(size[begins], SHINGLE)
    hashes, total = np.zeros(len(begins), dtype=np.uint64), np.zeros(len(begins))
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            in_it = k < length
            place = np.minimum(begins + k, n - 1)
            hashes += np.where(in_it, words[place], np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15 + 2 * k * 0x2545F4914F6CDD1D & tb._MASK | 1)
            total += np.where(in_it, weight[place], 0.0)
    hashes, total, row = tb.mix(hashes), total / length, row[begins]
    order = np.lexsort((hashes, row))
    hashes, total, row = hashes[order], total[order], row[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    starts = np.flatnonzero(new)
    times = np.diff(np.append(starts, len(row)))
    return row[starts], hashes[starts], total[starts] * times


# ---------------------------------------------------------------- sampling
_variates: list[tuple] = []


def _gamma_quantiles() -> np.ndarray:
    """The middle of each of ``_TABLE`` equal shares of a gamma distribution of shape 2."""
    share, x = (np.arange(_TABLE) + 0.5) / _TABLE, np.sqrt(np.arange(_TABLE) + 0.5) / 100 + 0.01
    for _ in range(60):  # Newton's method on log(1 - share) = log(1 + x) - x
        x = np.maximum(x + (np.log1p(x) - x - np.log1p(-share)) * (1 + x) / x, x / 4)
    return x


def _tables() -> tuple[list[np.uint64], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """An odd multiplier for each draw, and the quantiles of r, 1/r, beta and log c (r, c: gamma of shape 2)."""
    if not _variates:
        rng = np.random.Generator(np.random.PCG64(20240229))
        multipliers = [np.uint64(int(rng.integers(1, 1 << 62)) * 2 + 1) for _ in range(BANDS * ROWS)]
        gamma = _gamma_quantiles()
        _variates.append((multipliers, *[x.astype(np.float32) for x in (gamma, 1 / gamma, (np.arange(_TABLE) + 0.5) / _TABLE, np.log(gamma))]))
    return _variates[0]


def draw(row: np.ndarray, hashes: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with shingles, and for each of them the hashes of its bands."""
    starts = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, dtype=np.int64)
    owners = row[starts]
    out, low = np.zeros((len(owners), BANDS), dtype=np.uint64), np.uint64(_TABLE - 1)
    ends = np.append(starts[1:], len(row))
    multipliers, r, inverse, beta, log_c = _tables()
    i = 0
    while i < len(owners):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _CHUNK, side="right")))
        a, b = starts[i], ends[j - 1]
        h, log_w, local = hashes[a:b], np.log(weight[a:b]).astype(np.float32), starts[i:j] - a
        lengths = ends[i:j] - starts[i:j]
        with np.errstate(over="ignore"):
            for k, multiplier in enumerate(multipliers):
                # three variates from 48 bits of the shingle's hash for this draw
                own = h * multiplier
                at = (own >> np.uint64(48)).astype(np.int64)
                b_at = beta[((own >> np.uint64(32)) & low).astype(np.int64)]
                t = np.floor(log_w * inverse[at] + b_at)
                value = log_c[((own >> np.uint64(16)) & low).astype(np.int64)] - r[at] * (t - b_at + 1)
                least = np.minimum.reduceat(value, local)
                hit = np.flatnonzero(value == np.repeat(least, lengths))
                own = np.searchsorted(local, hit, side="right") - 1
                # of equal values the shingle with the smallest hash
                order = np.lexsort((h[hit], own))
                hit, own = hit[order], own[order]
                hit = hit[np.append(True, own[1:] != own[:-1])]
                sample = tb.mix(h[hit] + t[hit].astype(np.int64).view(np.uint64) * np.uint64(0xD1342543DE82EF95))
                out[i:j, k // ROWS] = tb.mix(out[i:j, k // ROWS] * np.uint64(31) + sample + np.uint64(k))
        i = j
    return owners, out


def similarity(left: pa.Array, right: pa.Array, idf: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of the texts of two columns, row by row; 0 without shingles."""
    n = len(left)
    (r1, h1, w1), (r2, h2, w2) = shingles(left, idf), shingles(right, idf)
    row, h, w = np.concatenate([r1, r2]), np.concatenate([h1, h2]), np.concatenate([w1, w2])
    order = np.lexsort((h, row))
    row, h, w = row[order], h[order], w[order]
    both = np.flatnonzero((row[1:] == row[:-1]) & (h[1:] == h[:-1])) if len(row) else np.zeros(0, dtype=np.int64)
    common = np.bincount(row[both], weights=np.minimum(w[both], w[both + 1]), minlength=n)
    total = np.bincount(row, weights=w, minlength=n)
    return common / np.maximum(total - common, 1e-300)


# ---------------------------------------------------------------- candidates, links, classes
def sketches(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """doc_id, node (a hash of the text), size (its bytes) and bands (none without shingles) of every row."""
    names = ["doc_id", "node", "size", "bands"]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.blocks(batches):
            owners, bands = draw(*shingles(batch.column(2), idf), batch.num_rows)
            with np.errstate(over="ignore"):
                bands = tb.mix(bands + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            counts = np.zeros(batch.num_rows, dtype=np.int64)
            counts[owners] = BANDS
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(bands.view(np.int64).reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pc.fill_null(pc.binary_length(batch.column(2)), 0).cast(pa.int64()), lists], names=names)

    rows = docs.select("doc_id", text_key(F.col("text")).alias("node"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(sketch, f"doc_id {dict(docs.dtypes)['doc_id']}, node long, size long, bands array<long>")


def _candidates(table: DataFrame) -> DataFrame:
    """key, node, size and hub of the nodes of each group, without the hubs themselves.

    A group is the nodes that agree on a band.  Its hub is the node that is in the largest groups, which for copies of
    a text with changes of their own is the text itself.
    """
    nodes = table.where(F.size("bands") > 0).groupBy("node").agg(F.first("bands").alias("bands"), F.first("size").alias("size"))
    members = written(nodes.select(F.explode("bands").alias("key"), "node", "size"))
    # sums are written, so that the members of a large group needn't meet in the task that has made its sum
    sizes = written(members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    grouped = written(members.join(sizes, "key"))
    weights = grouped.groupBy("node").agg(F.sum("n").alias("weight"))
    best = grouped.select("key", "node").join(weights, "node").groupBy("key").agg(F.max(F.struct("weight", "node")).alias("best"))
    best = written(best)
    return grouped.join(best.select("key", F.col("best.node").alias("hub")), "key").where("node <> hub").select("key", "node", "size", "hub")


def _linked(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, least: float) -> DataFrame:
    """The pairs (node, hub) whose texts are like each other."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.blocks(batches, "text", 2 << 20):
            same = similarity(batch.column(2), batch.column(3), idf) >= least
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(same)), batch.column(1).filter(pa.array(same))], names=["node", "hub"])

    rows = pairs.join(texts, "node").join(texts.select(F.col("node").alias("hub"), F.col("text").alias("hub_text")), "hub")
    return rows.select("node", "hub", "text", "hub_text").mapInArrow(check, "node long, hub long")


def _tiles(members: DataFrame, classes: DataFrame) -> DataFrame:
    """key, i, j, node, class and side of the nodes that are to be compared: those of side 0 with side 1, or all if i = j.

    Nodes outside a group's largest class (minor ones) are compared with all others of the group, the rest (major ones)
    with minor ones only.  Both are dealt into blocks; tile (i, j) holds a block of minor nodes and another one.
    """
    apart = members.select("key", "node", "size").join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    apart = written(apart.select("key", "node", "size", "class"))
    held = apart.groupBy("key", "class").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    groups = held.groupBy("key").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max(F.struct("n", "bytes", "class")).alias("top"))

    def blocks(n: str, size: str) -> str:
        return f"CAST(greatest(1, ceil(({n}) / {BLOCK_NODES}), ceil(({size}) / {BLOCK_BYTES})) AS int)"

    groups = groups.where("parts > 1").selectExpr("key", "top.class AS major", blocks("n - top.n", "bytes - top.bytes") + " AS minors", blocks("top.n", "top.bytes") + " AS majors")
    placed = apart.join(groups, "key").withColumn("block", F.expr("CAST(IF(class <> major, pmod(node, minors), minors + pmod(node, majors)) AS int)"))
    others = F.expr("sequence(0, IF(class <> major, minors + majors, minors) - 1)")
    tiles = placed.select("key", "node", "class", "block", F.explode(others).alias("other"))
    return tiles.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "class", F.expr("IF(block <= other, 0, 1)").alias("side"))


def alike(row: np.ndarray, h: np.ndarray, w: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarities of the texts ``left`` and ``right``, all with all, by the shingles of all texts."""
    n = int(max(left.max(), right.max())) + 1
    total = np.bincount(row, weights=w, minlength=n)
    order = np.lexsort((row, h))
    row, h, w = row[order], h[order], w[order]
    starts = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, dtype=np.int64)
    times = np.diff(np.append(starts, len(h)))
    starts, times = starts[times > 1], times[times > 1]
    common = np.zeros((len(left), len(right)))
    if len(starts):
        # a shingle of one weight in all its texts adds that weight, others add the smaller of two
        bounds = np.stack([starts, starts + times], axis=1).reshape(-1)
        bounds = bounds[:-1] if bounds[-1] == len(w) else bounds
        one, most = np.minimum.reduceat(w, bounds)[::2], np.maximum.reduceat(w, bounds)[::2]
        even = one == most
        flat, lengths, weights = starts[even], times[even], one[even]
        for a in range(0, len(flat), _COLUMNS):
            size = lengths[a : a + _COLUMNS]
            column = np.repeat(np.arange(len(size)), size)
            at = np.repeat(flat[a : a + _COLUMNS], size) + np.arange(len(column)) - np.repeat(np.cumsum(size) - size, size)
            has = np.zeros((n, len(size)))
            has[row[at], column] = 1
            common += (has[left] * weights[a : a + _COLUMNS]) @ has[right].T
        place = np.full((2, n), -1)
        place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
        for a, b in zip(starts[~even], (starts + times)[~even], strict=True):
            x, y = place[:, row[a:b]]
            common[np.ix_(x[x >= 0], y[y >= 0])] += np.minimum.outer(w[a:b][x >= 0], w[a:b][y >= 0])
    return common / np.maximum(total[left][:, None] + total[right] - common, 1e-300)


def _joining(sims: np.ndarray, left: np.ndarray, right: np.ndarray, classes: np.ndarray, exact, least: float) -> list[tuple[int, int]]:
    """Of the pairs that are alike those that join classes, in order; ``exact`` decides where rounding could."""
    parent: dict[int, int] = {}

    def top(c: int) -> int:
        while parent.setdefault(c, c) != c:
            parent[c] = c = parent[parent[c]]
        return c

    found = []
    for x, y in np.argwhere((sims >= least - 1e-9) & (classes[left][:, None] != classes[right])).tolist():
        a, b = int(left[x]), int(right[y])
        p, q = top(int(classes[a])), top(int(classes[b]))
        if p != q and (sims[x, y] >= least + 1e-9 or exact(a, b) >= least):
            parent[p] = q
            found.append((a, b))
    return found


def _rest(tiles: DataFrame, texts: DataFrame, idf: np.ndarray, least: float) -> DataFrame:
    """Links (node, hub) between the nodes of tiles that join their classes."""

    def compare(batch: pa.RecordBatch, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        ends = np.append(starts[1:], batch.num_rows)
        node, classes, side, texts = batch.column(3).to_numpy(), batch.column(4).to_numpy(), batch.column(5).to_numpy(), batch.column(6)
        bytes_ = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
        k = 0
        while k < len(starts):
            stop = max(k + 1, int(np.searchsorted(bytes_[ends], bytes_[starts[k]] + 2 * BLOCK_BYTES, side="right")))
            base = starts[k]
            row, h, w = shingles(texts.slice(base, ends[stop - 1] - base), idf)
            found = []
            for a, b in zip(starts[k:stop], ends[k:stop], strict=True):
                left = np.flatnonzero(side[a:b] == 0)
                right = np.flatnonzero(side[a:b] == 1) if batch.column(1)[a] != batch.column(2)[a] else left
                own = classes[a:b]
                if len(left) and len(right) and (own != own[0]).any():
                    p, q = np.searchsorted(row, [a - base, b - base])
                    sims = alike(row[p:q] - (a - base), h[p:q], w[p:q], left, right)
                    pairs = _joining(sims, left, right, own, lambda x, y, a=a: similarity(texts.slice(a + x, 1), texts.slice(a + y, 1), idf)[0], least)
                    found += [(node[a + x], node[a + y]) for x, y in pairs]
            if found:
                nodes, hubs = np.array(found, dtype=np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(nodes, hubs)), pa.array(np.minimum(nodes, hubs))], names=["node", "hub"])
            k = stop

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch if held is None else pa.concat_batches([held, batch])
            where = np.stack([batch.column(c).to_numpy() for c in range(3)])
            starts = np.flatnonzero(np.append(True, (where[:, 1:] != where[:, :-1]).any(axis=0)))
            if len(starts) > 1:  # the last tile may go on in the next batch
                yield from compare(batch.slice(0, starts[-1]), starts[:-1])
            held = batch.slice(starts[-1])
        if held is not None:
            yield from compare(held, np.zeros(1, dtype=np.int64))
        tb.release()

    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = tiles.join(texts, "node").select("key", "i", "j", "node", "class", "side", "text")
    return rows.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "node").mapInArrow(check, "node long, hub long")


def text_key(text: Column) -> Column:
    """What tells texts apart: a hash of the text, null counting as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def links(docs: DataFrame, table: DataFrame, idf: np.ndarray, least: float = SIMILARITY) -> DataFrame:
    """Verified links (node, hub) between different texts."""
    members = written(_candidates(table))
    stars = written(members.select("node", "hub").distinct())
    nodes = stars.select("node").union(stars.select("hub")).distinct()
    keyed = docs.select(text_key(F.col("text")).alias("node"), F.col("text").cast("string").alias("text"))
    # a merge join at every size: the nodes grow with the texts
    texts = written(keyed.join(nodes.hint("merge"), "node").groupBy("node").agg(F.first("text").alias("text")))
    found = written(_linked(stars, texts, idf, least))
    # nodes that the hubs leave apart, with each other
    again = _rest(written(_tiles(members, components(found))), texts, idf, least)
    return found.select(F.greatest("node", "hub").alias("node"), F.least("node", "hub").alias("hub")).unionByName(again).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and its class (the smallest node that it hangs together with), for the nodes of edges (node, hub)."""
    both = written(edges.select("node", "hub").union(edges.select("hub", "node")))
    label = written(both.groupBy("node").agg(F.least(F.min("hub"), F.first("node")).alias("class")))
    while True:
        near = both.join(label.withColumnRenamed("node", "hub"), "hub").groupBy("node").agg(F.min("class").alias("near"))
        step = label.join(near, "node").select("node", "class", F.least("class", "near").alias("new"))
        jump = label.select(F.col("node").alias("new"), F.col("class").alias("further"))
        step = written(step.join(jump, "new", "left").select("node", "class", F.least("new", "further").alias("new")))
        if step.where("new <> class").isEmpty():
            return label
        label = step.select("node", F.col("new").alias("class"))


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, class_size, kept, n_links (of its text) and text_key (a hash of its text) of every row."""
    small_batches(docs.sparkSession)
    idf = document_frequencies(docs)
    table = written(sketches(docs, idf))
    edges = written(links(docs, table, idf, least))
    degree = edges.select("node").union(edges.select("hub")).groupBy("node").agg(F.count("*").alias("n_links"))
    # written, so that copies of one text needn't meet in the task that has summed its links
    classes = written(components(edges).join(degree, "node"))
    rows = table.select("doc_id", "node").join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    rows = written(rows.select("doc_id", "node", "class", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")))
    # written, so that rows of a large class needn't meet in the task that has summed it; a null doc_id comes last
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("head")
    heads = written(rows.groupBy("class").agg(head, F.count("*").alias("class_size")))
    kept = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("node") == F.col("head.node"))
    return rows.join(heads, "class").select("doc_id", F.col("head.doc_id").alias("class_id"), "class_size", kept.alias("kept"), "n_links", F.col("node").alias("text_key"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text_key")
