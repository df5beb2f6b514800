"""Geometry of surveys: coordinates, affine transforms, corner points, paths and point selection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import axes, splines, stats, surfaces
from .axes import DIGITS, Axis, axis_of
from .traces import at_linear

__all__ = ["Axis", "axis_of"]


@dataclass(frozen=True)
class Affine:
    """x = a i + c j + e and y = b i + d j + f."""

    a: float
    b: float
    c: float
    d: float
    e: float
    f: float

    @classmethod
    def of(cls, row) -> Affine:
        return cls(*[row[k] for k in "abcdef"])

    @property
    def det(self) -> float:
        return self.a * self.d - self.b * self.c

    def forward(self, i: Column, j: Column) -> tuple[Column, Column]:
        return i * self.a + j * self.c + self.e, i * self.b + j * self.d + self.f

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        if not self.det:
            raise ValueError("the transform has no inverse")
        u, v = x - self.e, y - self.f
        return (u * self.d - v * self.c) / self.det, (v * self.a - u * self.b) / self.det

    def matrix(self) -> np.ndarray:
        return np.array([[self.a, self.c, self.e], [self.b, self.d, self.f], [0, 0, 1]])

    def to(self, other: Affine) -> Affine:
        """From this survey's labels to the other's."""
        m = np.linalg.inv(other.matrix()) @ self.matrix()
        return Affine(m[0, 0], m[1, 0], m[0, 1], m[1, 1], m[0, 2], m[1, 2])


def multiplier(scalar: Column, inverse: bool = False) -> Column:
    """What a coordinate scalar multiplies by: 100 is 100, -100 is 1/100, 0 is 1."""
    power = F.signum(scalar.cast("double"))
    return F.pow(F.abs(scalar.cast("double")), -power if inverse else power)


def scaled(rows: DataFrame, scalar: Column, xy: tuple[str, str] = ("cdp_x", "cdp_y"), inverse: bool = False) -> DataFrame:
    """Coordinates times the scalar's multiplier, or back."""
    return rows.withColumns({c: F.col(c) * multiplier(scalar, inverse) for c in xy})


def affine_of(cells: DataFrame, dims: tuple[str, str] = ("iline", "xline"), xy: tuple[str, str] = ("cdp_x", "cdp_y")) -> Affine:
    """The least-squares transform; of the shortest coefficients where the cells lie on one line."""
    row = stats.fit_affine(cells, dims, xy).first()
    if row["a"] is not None:
        return Affine.of(row)
    i, j = map(F.col, dims)
    names = [i, j, F.lit(1.0)]
    sums = [F.sum(p * q) for p in names for q in names] + [F.sum(p * F.col(v)) for v in xy for p in names]
    there = cells.where(F.col(xy[0]).isNotNull() & F.col(xy[1]).isNotNull())
    values = np.array([float(v or 0) for v in there.agg(*[s.alias(f"s{n}") for n, s in enumerate(sums)]).first()])
    inverse = np.linalg.pinv(values[:9].reshape(3, 3))
    (a, c, e), (b, d, f) = inverse @ values[9:12], inverse @ values[12:15]
    return Affine(*[float(v) for v in (a, b, c, d, e, f)])


def orthogonal_affine(points: DataFrame, ij: tuple[str, str], xy: tuple[str, str], order: str) -> DataFrame:
    """The exact transform through three points (an origin, one further along i, one further along j), in one row."""
    p = lambda n, c: F.max(F.when(F.col(order) == n, F.col(c).cast("double")))
    di, dj = p(1, ij[0]) - p(0, ij[0]), p(2, ij[1]) - p(0, ij[1])
    a, b = (F.try_divide(p(1, v) - p(0, v), di) for v in xy)
    c, d = (F.try_divide(p(2, v) - p(0, v), dj) for v in xy)
    nought = lambda v: F.coalesce(v, F.lit(0.0))
    e, f = (p(0, v) - nought(u) * p(0, ij[0]) - nought(w) * p(0, ij[1]) for v, u, w in ((xy[0], a, c), (xy[1], b, d)))
    return points.agg(*[nought(v).alias(k) for k, v in zip("abcdef", (a, b, c, d, e, f), strict=True)])


def coordinates(cells: DataFrame, dims: tuple[str, str] = ("iline", "xline"), xy: tuple[str, str] = ("cdp_x", "cdp_y"), fill: bool = True) -> DataFrame:
    """Labels and mean coordinates over all other dimensions; missing ones from the planes fitted to the others, or left out."""
    rows = cells.groupBy(*dims).agg(*[F.avg(c).alias(c) for c in xy])
    if not fill:
        return rows.where(F.col(xy[0]).isNotNull() & F.col(xy[1]).isNotNull())
    there = rows.where(F.col(xy[0]).isNotNull() & F.col(xy[1]).isNotNull())
    t = Affine.of(stats.fit_affine(there, dims, xy).first())
    x, y = t.forward(*map(F.col, dims))
    return rows.withColumns({xy[0]: F.coalesce(F.col(xy[0]).cast("double"), x), xy[1]: F.coalesce(F.col(xy[1]).cast("double"), y)})


def corner_points(cells: DataFrame, dims: tuple[str, str] = ("iline", "xline"), xy: tuple[str, str] = ("cdp_x", "cdp_y")) -> DataFrame:
    """Labels and coordinates of (first, first), (first, last), (last, last), (last, first) and the first again, by corner."""
    i, j = dims
    ends = cells.agg(F.min(i).alias("i0"), F.max(i).alias("i1"), F.min(j).alias("j0"), F.max(j).alias("j1"))
    ring = [("i0", "j0"), ("i0", "j1"), ("i1", "j1"), ("i1", "j0"), ("i0", "j0")]
    corners = ends.select(F.posexplode(F.array(*[F.struct(F.col(p).alias(i), F.col(q).alias(j)) for p, q in ring])).alias("corner", "at")).select("corner", f"at.{i}", f"at.{j}")
    return F.broadcast(corners).join(cells.select(i, j, *xy), [i, j], "left").select("corner", i, j, *xy)  # five corners


def line_ends(cells: DataFrame, dim: str = "cdp", xy: tuple[str, str] = ("cdp_x", "cdp_y")) -> DataFrame:
    """Labels and coordinates of the first and the last place of a 2-D line."""
    rows = cells.groupBy(dim).agg(*[F.avg(c).alias(c) for c in xy])
    ends = rows.agg(*[F.struct(f(dim).alias(dim), *[g(c, dim).alias(c) for c in xy]).alias(k) for k, f, g in (("a", F.min, F.min_by), ("b", F.max, F.max_by))])
    return ends.select(F.posexplode(F.array("a", "b")).alias("corner", "at")).select("corner", f"at.{dim}", *[f"at.{c}" for c in xy])


def grid_rotation(corners: DataFrame, xy: tuple[str, str] = ("cdp_x", "cdp_y")) -> DataFrame:
    """Sum of (x2 - x1)(y2 + y1) along the first four corners; above 0 they go clockwise."""
    x, y = map(F.col, xy)
    w = Window.partitionBy(F.lit(0)).orderBy("corner")  # four rows
    step = (F.lead(x).over(w) - x) * (F.lead(y).over(w) + y)
    return corners.where("corner < 4").select(step.alias("s")).agg(F.sum("s").alias("rotation"))


def uniform_spacing(path: DataFrame, spacing: float, order: str, columns: list[str], extra_point: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """Points at equal distances along polylines (one for each of ``by``): station, distance and the interpolated columns, of which the first two are x and y."""
    x, y = columns[:2]
    line = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # the vertices of one path
    w = line.orderBy(order)
    step = F.coalesce(F.sqrt(F.pow(F.col(x) - F.lag(x).over(w), 2) + F.pow(F.col(y) - F.lag(y).over(w), 2)), F.lit(0.0))
    along = path.select(*by, order, *columns, step.alias("_step")).withColumn("_at", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    n = F.greatest(F.lit(1), F.max("_at").over(line).cast("double") / F.lit(float(spacing)) + F.lit(int(extra_point))).cast("int")
    ends = {c: F.lead(c).over(w) for c in ["_at", *columns]}
    legs = along.select(*by, "_at", *columns, n.alias("_n"), F.max("_at").over(line).alias("_length"), *[v.alias(f"_next_{c}") for c, v in ends.items()]).where("_next__at > _at OR _next__at IS NULL")
    between = F.when(F.col("_n") > 1, F.col("_length") / (F.col("_n") - 1)).otherwise(0.0)
    # each leg makes the stations that lie in it, so no range join is needed
    places = lambda at: F.ceil(F.round(at / F.when(between > 0, between).otherwise(1.0), DIGITS)).cast("int")
    first = places(F.col("_at"))
    last = F.when(F.col("_next__at").isNull(), F.col("_n") - 1).otherwise(places(F.col("_next__at")) - 1)
    last = F.least(last, F.col("_n") - 1)
    stations = legs.where(first <= last).withColumn("station", F.explode(F.sequence(first, last)))
    d = F.col("station") * between
    t = F.coalesce(F.try_divide(d - F.col("_at"), F.col("_next__at") - F.col("_at")), F.lit(0.0))
    return stations.select(*by, "station", d.alias("distance"), *[(F.col(c) + t * F.coalesce(F.col(f"_next_{c}") - F.col(c), F.lit(0.0))).alias(c) for c in columns])


def select_xy(traces: DataFrame, points: DataFrame, affine: Affine, axes: tuple[axes.AnyAxis, axes.AnyAxis], dims: tuple[str, str] = ("iline", "xline"), method: str = "linear", samples: str = "samples", carry: tuple[str, ...] = ()) -> DataFrame:
    """Traces at points (point, x, y): the nearest, or the bilinear mean of up to four.

    A point outside the grid, or with one of the traces it needs missing, has null samples.  ``carry`` are other
    dimensions, whose labels give a row each.
    """
    i, j = affine.inverse(F.col("x").cast("double"), F.col("y").cast("double"))
    at = points.select("point", "x", "y", i.alias("_i"), j.alias("_j"))
    return select_labels(traces, at, axes, ("_i", "_j"), dims, method, samples, carry).select("point", "x", "y", *carry, samples)


def select_labels(traces: DataFrame, points: DataFrame, axes: tuple[axes.AnyAxis, axes.AnyAxis], at: tuple[str, str], dims: tuple[str, str] = ("iline", "xline"), method: str = "linear", samples: str = "samples", carry: tuple[str, ...] = ()) -> DataFrame:
    """Points (point, and labels in the columns ``at``) with traces: the nearest, or the bilinear mean of up to four."""
    if method not in ("nearest", "linear"):
        raise ValueError("the method must be nearest or linear")
    for axis, column, name in zip(axes, at, ("_p", "_q"), strict=True):
        points = axis.between(points, column, name)
    points = points.withColumn("_in", F.col("_p").isNotNull() & F.col("_q").isNotNull())
    own = [c for c in points.columns if c not in ("_p", "_q", "_in", *carry, samples)]
    cells = traces.select(axes[0].key(F.col(dims[0])).alias("_ki"), axes[1].key(F.col(dims[1])).alias("_kj"), *carry, samples)
    if method == "nearest":
        # ties go to the smaller place
        near = points.withColumns({k: F.when(F.col(p)["t"] <= 0.5, F.col(p)["a"]).otherwise(F.col(p)["b"]) for k, p in (("_ki", "_p"), ("_kj", "_q"))})
        return near.join(cells, ["_ki", "_kj"], "left").select(*own, *carry, samples)
    t, u = F.col("_p")["t"], F.col("_q")["t"]
    corner = lambda i, j, w: F.struct(F.col("_p")[i].alias("_ki"), F.col("_q")[j].alias("_kj"), w.alias("w"))
    corners = F.array(corner("a", "a", (1 - t) * (1 - u)), corner("b", "a", t * (1 - u)), corner("a", "b", (1 - t) * u), corner("b", "b", t * u))
    needed = points.where("_in").select("point", F.explode(F.filter(corners, lambda c: c["w"] > 0)).alias("c")).select("point", "c.*")
    want = needed.groupBy("point").agg(F.count("*").alias("need"))
    # at most four arrays a point; a null sample makes the mean null
    near = needed.join(cells, ["_ki", "_kj"]).groupBy("point", *carry).agg(F.collect_list(F.struct("w", F.col(samples).cast("array<double>").alias("v"))).alias("_near"))
    parts = F.transform("_near", lambda c: F.transform(c["v"], lambda v: v * c["w"]))
    mean = F.reduce(F.slice(parts, 2, 3), F.get(parts, F.lit(0)), lambda total, v: F.zip_with(total, v, lambda a, b: a + b))
    packed = near.join(want, "point").where(F.size("_near") == F.col("need")).select("point", *carry, mean.alias(samples))
    return points.select(*own).join(packed, "point", "left").select(*own, *carry, samples)


def select_irregular(traces: DataFrame, points: DataFrame, axes: tuple[axes.AnyAxis, axes.AnyAxis], dims: tuple[str, str] = ("iline", "xline"), xy: tuple[str, str] = ("cdp_x", "cdp_y"), method: str = "linear", samples: str = "samples", carry: tuple[str, ...] = ()) -> DataFrame:
    """Traces at points (point, x, y) of a survey that no affine transform describes: by the labels that its coordinates give there."""
    at = labels_at(points.select("point", "x", "y"), traces.select(*dims, *xy), dims, xy)
    return select_labels(traces, at, axes, ("_i", "_j"), dims, method, samples, carry).select("point", "x", "y", *carry, samples)


def regridded(traces: DataFrame, cells: DataFrame, affine: Affine, axes: tuple[axes.AnyAxis, axes.AnyAxis], dims: tuple[str, str] = ("iline", "xline"), xy: tuple[str, str] = ("cdp_x", "cdp_y"), method: str = "linear", samples: str = "samples", carry: tuple[str, ...] = ()) -> DataFrame:
    """The traces on another survey: a row for each pair of labels of ``cells``, at the mean of its coordinates.

    Cells without coordinates, outside the grid or next to a missing trace have null samples.  ``affine`` and ``axes``
    are those of the traces; the labels and coordinates of the result are those of the cells.
    """
    places = cells.groupBy(*dims).agg(*[F.avg(c).alias(c) for c in xy])
    points = places.select(F.struct(*dims).alias("point"), F.col(xy[0]).alias("x"), F.col(xy[1]).alias("y"))
    found = select_xy(traces, points, affine, axes, dims, method, samples, carry)
    return found.select("point.*", F.col("x").alias(xy[0]), F.col("y").alias(xy[1]), *carry, samples)


def interpolated_labels(traces: DataFrame, labels: DataFrame, axes: tuple[axes.AnyAxis, axes.AnyAxis], dims: tuple[str, str] = ("iline", "xline"), method: str = "linear", samples: str = "samples", carry: tuple[str, ...] = ()) -> DataFrame:
    """The traces at other labels of two dimensions, which may lie between those that are there: a row for each pair.

    ``cubic`` is a spline along the first dimension, then along the second.
    """
    if method == "cubic":
        wanted = labels.select(*[F.col(d).cast("double").alias(d) for d in dims]).distinct()
        out = traces.select(*dims, *carry, samples)
        for d, other in (dims, dims[::-1]):
            out = splines.along(out, d, wanted.select(d).where(F.col(d).isNotNull()).distinct(), (other, *carry), samples)
        return wanted.join(out, list(dims), "left").select(*dims, *carry, samples)
    cells = labels.select(*dims, *[F.col(d).cast("double").alias(f"_at_{d}") for d in dims])
    at = tuple(f"_at_{d}" for d in dims)
    return regridded(traces, cells, Affine(1.0, 0.0, 0.0, 1.0, 0.0, 0.0), axes, dims, at, method, samples, carry).drop(*at)


def interpolated_line(traces: DataFrame, path: DataFrame, spacing: float, affine: Affine, axes: tuple[axes.AnyAxis, axes.AnyAxis], order: str = "seq", method: str = "linear", **more) -> DataFrame:
    """Traces at equal distances along a polyline of columns seq, x and y."""
    stations = uniform_spacing(path, spacing, order, ["x", "y"]).withColumnRenamed("station", "point")
    return select_xy(traces, stations.select("point", "x", "y"), affine, axes, method=method, **more)


def at_horizon(traces: DataFrame, horizon: DataFrame, dims: tuple[str, str], z: str, ns0: float, dt: float, name: str = "amplitude") -> DataFrame:
    """Each horizon cell with the trace's value at its depth."""
    rows = horizon.join(traces.select(*dims, "samples"), list(dims), "left")
    return rows.withColumn(name, at_linear(F.col("samples"), F.col(z), ns0, dt)).drop("samples")


def well_values(traces: DataFrame, path: DataFrame, affine: Affine, axes: tuple[axes.AnyAxis, axes.AnyAxis], ns0: float, dt: float) -> DataFrame:
    """Trilinear values along a well path (point, x, y, z)."""
    at = select_xy(traces, path.select("point", "x", "y"), affine, axes)
    return at.join(path.select("point", "z"), "point").withColumn("value", at_linear(F.col("samples"), F.col("z"), ns0, dt)).drop("samples")


def surface_from_points(grid: DataFrame, points: DataFrame, value: str, xy: tuple[str, str] = ("cdp_x", "cdp_y"), method: str = "linear", name: str | None = None) -> DataFrame:
    """Grid rows with a column interpolated from scattered points (columns xy and ``value``), by triangles or the nearest point."""
    return surfaces.interpolated(grid, points, {name or value: value}, xy, method)


def labels_at(points: DataFrame, traces: DataFrame, dims: tuple[str, str] = ("iline", "xline"), xy: tuple[str, str] = ("cdp_x", "cdp_y"), names: tuple[str, str] = ("_i", "_j"), method: str = "linear") -> DataFrame:
    """Points (columns x and y) with the labels, which may lie between those of traces, of a survey that no affine transform describes.

    Between traces labels are linear on the Delaunay triangles of their coordinates; outside of all they are null.
    """
    cells = traces.groupBy(*dims).agg(F.avg(xy[0]).alias("x"), F.avg(xy[1]).alias("y"))
    return surfaces.interpolated(points, cells, dict(zip(names, dims, strict=True)), ("x", "y"), method)


def resample_cubic(traces: DataFrame, at: str, ns0: float, dt: float, samples: str = "samples") -> DataFrame:
    """Traces with their samples at the labels of the array column ``at``, by cubic splines."""

    def spline(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = np.empty(len(batch), dtype=object)
            sizes = pd.Series(list(zip([len(y) for y in batch[samples]], [len(z) for z in batch[at]], strict=True)))
            for _, rows in sizes.groupby(sizes).groups.items():  # traces of one length at a time
                y, z = (np.stack([np.asarray(v, dtype=float) for v in batch[c].iloc[rows]]) for c in (samples, at))
                for i, v in zip(rows, splines.even(y, (z - ns0) / dt), strict=True):
                    out[i] = v
            batch[samples] = out
            yield batch

    fields = ", ".join(f"`{f.name}` {'array<double>' if f.name == samples else f.dataType.simpleString()}" for f in traces.schema.fields)
    return traces.mapInPandas(spline, fields)


def plot_bounds(corners: DataFrame, xy: tuple[str, str] = ("cdp_x", "cdp_y")) -> DataFrame:
    """The closed polygon around a survey, as ordered points."""
    return corners.select("corner", *xy).orderBy("corner")
