"""Operator 4: nearest neighbours by a block matrix join, exact by error bounds.

Candidates and queries are dealt into blocks of a bounded number of bytes; a
pair of blocks is a task's work, done in tiles.  In a tile, unit vectors are
rounded to int8 with a scale of their own; the product of the int8 matrices
gives every cosine with a bound of its error.  Only pairs that by these bounds
can still be among a query's ``k`` best, of the tile and of those before it, are
recomputed from the original vectors in double precision.  Each task merges what
its blocks found for a query in a heap of ``k``; a window over the heaps of all
tasks gives the result, which is that of a full search.

Blocks hold the vectors as they are stored, and not their codes alone: a cluster
of vectors closer than the codes can tell apart would leave all its pairs to be
fetched afterwards, where a tile keeps ``k`` of them a query.

Vectors that are null, empty, zero or hold null or non-finite components, and
rows without a vec_id, take no part; vectors of different lengths never meet,
and an empty table gives an empty result.  A query's own id is no candidate; a
repeated query row counts once, query rows of one vec_id with different vectors
share one list, repeated candidate rows are candidates each.  Ties go to the
smaller vec_id.  Very long vectors make blocks of fewer rows.  Other columns are
ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of vectors in a block, and rows of queries and candidates in a tile.
BLOCK_BYTES = 16 << 20
QUERY_TILE, CANDIDATE_TILE = 1024, 4096
#: Queries that a task holds heaps of before it hands them on.
HEAPS = 1 << 18
OUT = "query_id long, vec_id long, score double"
NAMES = ["query_id", "vec_id", "score"]


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("vec_id").to_numpy().astype(np.int64)
    lists = table.column("embedding").combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return ids, flat.reshape(len(ids), -1)


def _quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, the scale of each row and the sum of each row's absolute values, of unit vectors."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return q, scale, np.abs(q.astype(np.int32)).sum(axis=1)


@dataclass
class Side:
    """Vectors of one side of a tile: ids, vectors of safe size, their norms, codes, scales and sums of codes."""

    ids: np.ndarray
    safe: np.ndarray
    norm: np.ndarray
    codes: np.ndarray
    scale: np.ndarray
    total: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, x: np.ndarray) -> Side:
        # a power of two per row keeps the squares finite and changes no cosine
        safe = x / np.exp2(np.floor(np.log2(np.abs(x).max(axis=1))))[:, None]
        norm = np.sqrt((safe * safe).sum(axis=1))
        return cls(ids, safe, norm, *_quantised(safe / norm[:, None]))

    def tiles(self, rows: int) -> Iterator[Side]:
        for i in range(0, len(self.ids), rows):
            yield Side(*[x[i : i + rows] for x in (self.ids, self.safe, self.norm, self.codes, self.scale, self.total)])


def nearest_in_tile(q: Side, c: Side, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries, ids of candidates and cosines of all pairs of a tile that can be among a query's k best.

    ``least`` holds each query's k-th cosine in the tiles before, or minus infinity.
    """
    dim = q.safe.shape[1]
    exact = np.float32 if dim * 127 * 127 < 1 << 24 else np.float64  # sums of int8 products are whole numbers that this type holds exactly
    products = (q.codes.astype(exact) @ c.codes.astype(exact).T).astype(np.float64)
    estimate = products * q.scale[:, None] * c.scale[None, :]
    bound = (q.total[:, None] + c.total[None, :] + dim / 2) * (q.scale[:, None] * c.scale[None, :] / 2) + 1e-12
    own = q.ids[:, None] == c.ids[None, :]
    estimate[own] = -np.inf
    if len(c.ids) > k:
        least = np.maximum(least, -np.partition(-(estimate - bound), k - 1, axis=1)[:, k - 1])
    at_q, at_c = np.nonzero((estimate + bound >= least[:, None]) & ~own)
    scores = np.empty(len(at_q))
    for i in range(0, len(at_q), 1 << 16):
        a, b = at_q[i : i + (1 << 16)], at_c[i : i + (1 << 16)]
        scores[i : i + (1 << 16)] = (q.safe[a] * c.safe[b]).sum(axis=1) / (q.norm[a] * c.norm[b])
    return at_q, c.ids[at_c], scores


def nearest_in_blocks(queries: Side, candidates: Side, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The k best candidates of a block for each query of another: query ids, candidate ids and cosines."""
    out = []
    for q in queries.tiles(QUERY_TILE):
        least = np.full(len(q.ids), -np.inf)
        at, ids, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        for c in candidates.tiles(CANDIDATE_TILE):
            at, ids, scores = (np.concatenate(x) for x in zip((at, ids, scores), nearest_in_tile(q, c, k, least), strict=True))
            order = np.lexsort((ids, -scores, at))
            at, ids, scores = at[order], ids[order], scores[order]
            place = np.arange(len(at)) - np.searchsorted(at, at, side="left")
            at, ids, scores, place = (x[place < k] for x in (at, ids, scores, place))
            least[at[place == k - 1]] = scores[place == k - 1]
        out.append((q.ids[at], ids, scores))
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, candidate_block: int | None = None, query_block: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest candidates of each query.

    Blocks hold BLOCK_BYTES of vectors each, or the given numbers of rows.
    """
    x = F.col("embedding")
    stored = "float" if dict(vectors.dtypes)["embedding"] == dict(queries.dtypes)["embedding"] == "array<float>" else "double"

    def usable(rows: DataFrame) -> DataFrame:
        rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast(f"array<{stored}>").alias("embedding"))
        finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
        return rows.where(F.col("vec_id").isNotNull() & finite & F.exists(x, lambda v: v != 0)).withColumn("dim", F.size("embedding"))

    def blocks(rows: DataFrame, block: int | None) -> int:
        found = rows.agg(F.count("*").alias("n"), F.sum("dim").alias("size")).first()
        return math.ceil(found["n"] / block) if block else math.ceil((found["size"] or 0) * (4 if stored == "float" else 8) / BLOCK_BYTES)

    candidates, wanted = usable(vectors), usable(queries).dropDuplicates(["vec_id", "embedding"])
    # small tables are dealt to all tasks nevertheless; a block more of candidates copies only the queries once more
    n_c = max(blocks(candidates, candidate_block), int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    n_q = max(blocks(wanted, query_block), 1)
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = candidates.withColumn("cb", deal(n_c)).withColumn("qb", every(n_q))
    wanted = wanted.withColumn("qb", deal(n_q)).withColumn("cb", every(n_c))

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names=NAMES)
        found = nearest_in_blocks(Side.of(*_matrix(right)), Side.of(*_matrix(left)), k)
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=NAMES)

    def handed_on(heaps: dict[int, list[tuple[float, int]]]) -> pa.RecordBatch:
        rows = [(q, -c, s) for q, heap in heaps.items() for s, c in heap]
        return pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(NAMES)}, schema=pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list[tuple[float, int]]] = {}
        for batch in batches:
            for q, c, s in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                heap = heaps.setdefault(q, [])
                if len(heap) < k:
                    heapq.heappush(heap, (s, -c))
                elif (s, -c) > heap[0]:
                    heapq.heapreplace(heap, (s, -c))
            if len(heaps) > HEAPS:
                yield handed_on(heaps)
                heaps = {}
        yield handed_on(heaps)

    # a task's pairs come in this order, so those of a query block follow each other
    key = ["dim", "qb", "cb"]
    found = candidates.groupBy(*key).cogroup(wanted.groupBy(*key)).applyInArrow(pair, OUT)
    best = found.mapInArrow(merged, OUT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every row whose vec_id is divisible by 50, among all rows."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))
