"""Functions of N-dimensional chunks, and the order of traces by chunks.

A chunk is a box of positions along the dimensions, and of samples.  Traces go to their chunk and, where a function looks
further, to the chunks whose ghost zone they lie in, so a task holds one chunk with its ghosts at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .grid import with_position

#: Values of a chunk with its ghosts, at most.
MOST_VALUES = 1 << 25


def _reached(position: str, size: int, ghost: int) -> Column:
    """The chunks that hold a position, itself or in their ghost zones."""
    p = F.col(position)
    own, place = F.floor(p / size), p % size
    near = F.array(own, F.when(place < ghost, own - 1), F.when(place >= size - ghost, own + 1))
    return F.filter(near, lambda c: c.isNotNull() & (c >= 0))


def mapped(traces: DataFrame, dims: list[str], function: Callable[[np.ndarray], np.ndarray], sizes: dict[str, int], ghosts: dict[str, int] | None = None, depth: tuple[int, int] | None = None, samples: str = "samples") -> DataFrame:
    """Traces with their samples through a function of arrays, one axis a dimension and the samples last.

    ``sizes`` are positions a chunk along each dimension, ``ghosts`` how many more the function sees on either side; ``depth``
    is the same for samples.  At the survey's edges arrays end; missing traces and null samples are NaN.  The function gives
    an array of the same shape, of which the chunk itself is taken: the traces that are there, NaN as null.  Dimensions must
    tell traces apart, and those with a null label are left out.
    """
    ghosts = {d: (ghosts or {}).get(d, 0) for d in dims}
    if missing := [d for d in dims if d not in sizes]:
        raise ValueError(f"the chunk has no size along {missing}")
    if wrong := [d for d in dims if not 0 <= ghosts[d] <= sizes[d] or sizes[d] < 1]:
        raise ValueError(f"chunks are at least one wide, and ghosts no wider than chunks: {wrong}")
    size_z, ghost_z = depth or (0, 0)
    if depth and not 0 <= ghost_z <= size_z:
        raise ValueError("ghosts are no wider than chunks")
    box = reduce(lambda a, d: a * (sizes[d] + 2 * ghosts[d]), dims, 1)
    names = [f"_p{i}" for i in range(len(dims))]
    rows = traces
    for d, p in zip(dims, names, strict=True):
        rows = with_position(rows.where(F.col(d).isNotNull()), d, p)
    ends = rows.agg(*[F.max(p) for p in names], F.max(F.size(samples))).first()
    counts, ns = [(n if n is not None else -1) + 1 for n in ends[:-1]], ends[-1] or 0
    if box * (min(ns, size_z + 2 * ghost_z) if depth else ns) > MOST_VALUES:
        raise ValueError("a chunk holds too many values; choose smaller chunks, or chunks of samples with depth")
    for i, (d, p) in enumerate(zip(dims, names, strict=True)):
        rows = rows.withColumn(f"_c{i}", F.explode(_reached(p, sizes[d], ghosts[d])))
    keys = [f"_c{i}" for i in range(len(dims))]
    if depth:
        keys.append("_cz")
        rows = rows.withColumn("_cz", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(samples) - 1) / size_z))).cast("array<long>")))
        start = F.greatest(F.lit(0).cast("long"), F.col("_cz") * size_z - ghost_z).cast("int")
        stop = ((F.col("_cz") + 1) * size_z + ghost_z).cast("int")
        rows = rows.withColumn(samples, F.slice(samples, start + 1, stop - start))

    def apply(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        own = [table[k][0].as_py() for k in keys]
        low = [max(0, c * sizes[d] - ghosts[d]) for c, d in zip(own, dims, strict=False)]
        high = [min(n, (c + 1) * sizes[d] + ghosts[d]) for c, d, n in zip(own, dims, counts, strict=False)]
        at = [table[p].to_numpy() for p in names]
        lists = [v if v is not None else [] for v in table[samples].to_pylist()]
        most = max(map(len, lists), default=0)
        dense = np.full([*[b - a for a, b in zip(low, high, strict=True)], most], np.nan)
        place = [p - a for p, a in zip(at, low, strict=True)]
        values = np.full((len(lists), most), np.nan)
        for i, v in enumerate(lists):
            values[i, : len(v)] = [np.nan if x is None else x for x in v]
        dense[tuple(place)] = values
        found = np.asarray(function(dense), dtype=float)
        if found.shape != dense.shape:
            raise ValueError(f"the function gave an array of shape {found.shape} for one of {dense.shape}")
        core = np.flatnonzero(np.all([p // sizes[d] == c for p, c, d in zip(at, own, dims, strict=False)], axis=0))
        first = min(ghost_z, own[-1] * size_z) if depth else 0
        out = found[tuple(p[core] for p in place)]
        kept = [v[first : (first + size_z if depth else None)][: max(0, len(lists[i]) - first)] for i, v in zip(core.tolist(), out, strict=True)]
        result = pa.array([None if table[samples][i].as_py() is None else [None if np.isnan(x) else x for x in v.tolist()] for i, v in zip(core.tolist(), kept, strict=True)], pa.list_(pa.float64()))
        part = table.take(pa.array(core))
        columns = [result if c == samples else part[c] for c in schema.names]
        return pa.Table.from_arrays(columns, names=schema.names)

    fields = [StructField(f.name, ArrayType(DoubleType()) if f.name == samples else f.dataType) for f in traces.schema.fields]
    schema = StructType([*fields, *[StructField(k, rows.schema[k].dataType) for k in keys[len(dims) :]]])
    out = rows.groupBy(*keys).applyInArrow(apply, schema)
    if not depth:
        return out
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_cz", samples))), lambda x: x[samples])).alias(samples)
    others = [c for c in traces.columns if c not in dims and c != samples]
    return out.groupBy(*dims).agg(joined, *[F.first(c).alias(c) for c in others]).select(*traces.columns)


def morton(places: list[Column], bits: int = 20) -> Column:
    """The bits of whole numbers below 2^bits in turn, so that what is near along all of them is near in order."""
    n = len(places)
    if n * bits > 63:
        bits = 63 // n
    parts = [F.shiftleft(F.shiftright(p.cast("long"), b).bitwiseAND(1), b * n + i) for b in range(bits) for i, p in enumerate(places)]
    return reduce(lambda a, b: a + b, parts)


def by_chunks(traces: DataFrame, dims: list[str], sizes: dict[str, int], files: int | None = None) -> DataFrame:
    """Traces in the order of their chunks, chunks along a Morton curve: a box of labels lies in few files and row groups."""
    rows = traces
    for i, d in enumerate(dims):
        rows = with_position(rows, d, f"_p{i}")
    code = morton([F.floor(F.coalesce(F.col(f"_p{i}"), F.lit(0)) / sizes[d]) for i, d in enumerate(dims)])
    files = files or int(traces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("_code", code).repartitionByRange(files, "_code").sortWithinPartitions("_code", *dims)
    return rows.select(*traces.columns)
