"""Cubic splines with not-a-knot ends, along samples and across traces.

Across traces no line is gathered in one task.  The second derivatives of a spline solve a tridiagonal system in
which what a trace says falls to less than a third from one trace to the next, so a block of ``BLOCK`` labels with ``GHOST``
more on either side gives them to the last digit, wherever the line goes on beyond.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .axes import Uneven
from .grid import numbered

BLOCK, GHOST = 256, 64


def second_derivatives(x: np.ndarray, y: np.ndarray, cut: tuple[bool, bool] = (False, False)) -> np.ndarray:
    """Second derivatives at x (4 or more) of splines through the rows of y; at ends that are cut off they are 0."""
    h = np.diff(x)
    n = len(x)
    m = np.zeros((n, n))
    rhs = np.zeros_like(y)
    inner = np.arange(1, n - 1)
    m[inner, inner - 1], m[inner, inner], m[inner, inner + 1] = h[:-1], 2 * (h[:-1] + h[1:]), h[1:]
    rhs[1:-1] = 6 * (np.diff(y[1:], axis=0) / h[1:, None] - np.diff(y[:-1], axis=0) / h[:-1, None])
    if cut[0]:
        m[0, 0] = 1
    else:
        m[0, :3] = h[1], -(h[0] + h[1]), h[0]
    if cut[1]:
        m[-1, -1] = 1
    else:
        m[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    return np.linalg.solve(m, rhs)


def through(x: np.ndarray, y: np.ndarray, at: np.ndarray, cut: tuple[bool, bool] = (False, False)) -> np.ndarray:
    """The splines through the rows of y at places within x; with fewer than four rows the polynomial through them."""
    if len(x) < 4:
        return np.stack([np.polyval(np.polyfit(x, c, len(x) - 1), at) for c in y.T], axis=1) if len(x) else np.full((len(at), y.shape[1]), np.nan)
    second = second_derivatives(x, y, cut)
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(x) - 2)
    h = (x[k + 1] - x[k])[:, None]
    t = (at - x[k])[:, None] / h
    return y[k] * (1 - t) + y[k + 1] * t - h**2 * t * (1 - t) / 6 * ((2 - t) * second[k] + (1 + t) * second[k + 1])


def even(y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Splines through rows of samples at 0, 1, ..., each at the places of its own row of ``at``; NaN outside."""
    rows, n = y.shape
    if n < 4:
        out = np.stack([through(np.arange(n, dtype=float), one[:, None], z)[:, 0] for one, z in zip(y, at, strict=True)])
    else:
        second = second_derivatives(np.arange(n, dtype=float), y.T).T
        k = np.clip(np.floor(np.nan_to_num(at)).astype(int), 0, n - 2)
        r = np.arange(rows)[:, None]
        t = at - k
        out = y[r, k] * (1 - t) + y[r, k + 1] * t - t * (1 - t) / 6 * ((2 - t) * second[r, k] + (1 + t) * second[r, k + 1])
    return np.where((at >= 0) & (at <= n - 1), out, np.nan)


def along(traces: DataFrame, dim: str, wanted: DataFrame, line: tuple[str, ...], samples: str = "samples") -> DataFrame:
    """The traces of every line (labels of the other dimensions) at the wanted labels of one dimension, by cubic splines.

    Wanted labels beyond the first or last trace of a line have no row.  Missing traces are left out of their line; traces
    with null samples give null samples where these count.  Traces are unique by line and label and of one length.
    """
    labels = traces.select(F.col(dim).cast("double").alias("label")).where("label IS NOT NULL").distinct()
    index = numbered(labels, ["label"], "_place")
    asked = Uneven(labels).between(wanted.select(F.col(dim).cast("double").alias("_at")).distinct(), "_at", "_b").where("_b IS NOT NULL")
    asked = asked.join(index, F.col("_b.a") == F.col("label")).select("_at", F.floor(F.col("_place") / BLOCK).alias("_block"))
    # a block's labels, which are as many as are asked for there
    asked = asked.groupBy("_block").agg(F.array_sort(F.collect_list("_at")).alias("_wanted"))
    placed = traces.select(*line, F.col(dim).cast("double").alias("label"), samples).join(index, "label")
    own = F.floor(F.col("_place") / BLOCK)
    blocks = F.array_compact(F.array(own, F.when(F.col("_place") % BLOCK < GHOST, own - 1), F.when(F.col("_place") % BLOCK >= BLOCK - GHOST, own + 1)))
    ends = placed.drop(samples).groupBy(*line).agg(F.min("_place").alias("_first"), F.max("_place").alias("_last"))
    there = placed.select("*", F.explode(blocks).alias("_block")).join(asked, "_block")
    for i, c in enumerate(line):
        ends = ends.withColumnRenamed(c, f"_l{i}")
    there = there.join(ends, [F.col(c).eqNullSafe(F.col(f"_l{i}")) for i, c in enumerate(line)]).drop(*[f"_l{i}" for i in range(len(line))])
    kinds = dict(traces.dtypes)

    def spline(table: pa.Table) -> pa.Table:
        table = table.sort_by("label").combine_chunks()
        place, x = table["_place"].to_numpy(), table["label"].to_numpy()
        y = np.array([[np.nan] if v is None else [np.nan if s is None else s for s in v] for v in table[samples].to_pylist()], dtype=float)
        at = np.array(table["_wanted"][0].as_py())
        at = at[(at >= x[0]) & (at <= x[-1])]
        cut = place[0] > table["_first"][0].as_py(), place[-1] < table["_last"][0].as_py()
        found = through(x, y, at, cut)
        rows = pa.array([[None if np.isnan(s) else s for s in v] for v in found.tolist()], pa.list_(pa.float64()))
        columns = [pa.array([table[c][0].as_py()] * len(at), table.schema.field(c).type) for c in line]
        return pa.Table.from_arrays([*columns, pa.array(at), rows], names=[*line, dim, samples])

    fields = ", ".join([*[f"`{c}` {kinds[c]}" for c in line], f"`{dim}` double", f"`{samples}` array<double>"])
    return there.groupBy(*line, "_block").applyInArrow(spline, fields)
