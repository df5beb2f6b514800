"""A volume: a trace table, its dimensions and its metadata.  It holds plans, never data."""

from __future__ import annotations

import html
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import keys
from .operators import chunks as blocks
from .operators import geometry, grid, traces
from .sources import segy, tables
from .workspace import written


@dataclass(frozen=True)
class Source:
    """Where the traces of a volume come from, and the conditions on their headers so far."""

    path: str
    dims: dict
    extras: dict
    options: dict
    conditions: tuple = ()

    def read(self, spark: SparkSession) -> DataFrame:
        return segy.read_traces(spark, self.path, self.dims, self.extras, where=list(self.conditions), **self.options)


@dataclass(frozen=True)
class Volume:
    """Traces (dimension columns, other columns and ``samples``) on a vertical axis ns0, ns0 + dt, ..."""

    traces: DataFrame
    dims: tuple[str, ...]
    ns0: float = 0.0
    dt: float = 1.0
    vertical: str = "samples"
    attrs: dict = field(default_factory=dict)
    coords: tuple[str, str] = ("cdp_x", "cdp_y")
    #: Set while the traces are as they were read, so that selections go to the headers.
    source: Source | None = None

    # ------------------------------------------------------------ making
    @classmethod
    def open_segy(cls, spark: SparkSession, path: str, dims: dict[str, int], extras: dict[str, int] | None = None, check: bool = True, **options) -> Volume:
        """Traces of SEG-Y files on the dimensions whose header bytes are given.

        A name or byte that is given twice, a sample range the wrong way round and an unknown option are errors.
        """
        if unknown := set(options) - {"endian", "first", "last", "tracesPerPartition", "index"}:
            raise ValueError(f"unknown options {sorted(unknown)}")
        if not dims:
            raise ValueError("a volume needs dimensions")
        if both := set(dims) & set(extras or {}):
            raise ValueError(f"{sorted(both)} are dimensions and extra fields")
        if len(set(dims.values())) < len(dims):
            raise ValueError("two dimensions have the same byte")
        if "last" in options and int(options["last"]) < int(options.get("first", 0)):
            raise ValueError("the last sample comes before the first")
        meta = segy.read_meta(spark, path, **{k: v for k, v in options.items() if k == "endian"})
        m = meta.agg(F.min("ns0").alias("ns0"), F.min("dt").alias("dt"), F.max("dt").alias("dt_high"), F.min("units").alias("units"), F.first("text").alias("text")).first()
        heads = segy.read_headers(spark, path, names=["SourceGroupScalar"], **{k: v for k, v in options.items() if k == "endian"})
        coord_scalar = float(heads.agg(F.median("SourceGroupScalar")).first()[0] or 0)  # over the traces of all files
        if m["dt"] != m["dt_high"]:
            raise ValueError("the files' sample intervals differ")
        source = Source(path, dims, extras or {}, options)
        if check:
            grid.check_unique(segy.read_traces(spark, path, dims, headers_only=True, **{k: v for k, v in options.items() if k == "endian"}), list(dims))
        first = int(options.get("first", 0))
        return cls(source.read(spark), tuple(dims), m["ns0"] + first * m["dt"], m["dt"], attrs={"units": m["units"], "coord_scalar": coord_scalar, "text": m["text"], "bytes": dims | (extras or {})}, source=source)

    @classmethod
    def blank(cls, spark: SparkSession, axes: dict[str, list | tuple], ns: int, ns0: float = 0.0, dt: float = 1.0, domain: str = "TWT", units: str | None = None, value: float | None = None) -> Volume:
        keys.check_vertical(domain, units)
        return cls(grid.blank_grid(spark, axes, ns, value), tuple(axes), ns0, dt, domain.lower(), {"units": units, "ns": ns})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Volume:
        rows, m = tables.read_volume(spark, path)
        return cls(rows, tuple(m["dims"]), m["ns0"], m["dt"], m["vertical"], m["attrs"], tuple(m["coords"]))

    # ------------------------------------------------------------ keeping
    def save(self, path: str, partition: str | None = None, chunks: dict[str, int] | None = None, files: int | None = None, group_bytes: int = 8 << 20) -> None:
        """Keep as Parquet; with ``chunks`` (positions along each dimension) in their order, so that crops along any dimension read few files and row groups."""
        rows = blocks.by_chunks(self.traces, list(chunks), chunks, files) if chunks else self.traces
        tables.write_volume(rows, {"dims": self.dims, "ns0": self.ns0, "dt": self.dt, "vertical": self.vertical, "attrs": self.attrs, "coords": self.coords}, path, partition, group_bytes if chunks else None)

    def to_segy(self, path: str, dims: dict[str, int] | None = None, extras: dict[str, int] | None = None, **more) -> int:
        """Write to one SEG-Y file; without ``dims`` in the bytes that the volume was read from."""
        known, gone = self.attrs.get("bytes", {}), self.attrs.get("squeezed", {})
        back = {d: v for d, v in gone.items() if d not in self.traces.columns and d in (dims or known)}
        if back:  # dimensions of one label that were squeezed out
            return replace(self, traces=self.traces.withColumns({d: F.lit(v) for d, v in back.items()}), dims=(*back, *self.dims), attrs=self.attrs | {"squeezed": {}}).to_segy(path, dims, extras, **more)
        if dims is None and (unknown := [d for d in self.dims if d not in known]):
            raise ValueError(f"no header bytes are known for {unknown}")
        dims = dims or {d: known[d] for d in self.dims}
        if missing := [d for d in self.dims if d not in dims]:
            raise ValueError(f"dimensions {missing} have no header bytes, so traces couldn't be told apart")
        extras = extras if extras is not None else {k: v for k, v in known.items() if k not in dims and k in self.traces.columns}
        if self.attrs.get("coord_scaled"):
            more = {"coord_scalar": self.attrs.get("coord_scalar"), "scaled": tuple(c for c in self.coords if c in self.traces.columns)} | more
        return segy.write_traces(self.traces, path, dims, extras, self.ns0, self.dt, **more)

    # ------------------------------------------------------------ selecting
    def with_traces(self, rows: DataFrame, **changes) -> Volume:
        return replace(self, traces=rows, source=None, **changes)

    def _having(self, *conditions: tuple) -> Volume:
        """Traces whose columns meet conditions (column, comparison, value)."""
        known = self.source and (self.source.dims | self.source.extras)
        if self.source and all(c in known and all(isinstance(x, int) for x in (v if op == "in" else [v])) for c, op, v in conditions):
            source = replace(self.source, conditions=self.source.conditions + conditions)
            return replace(self, traces=source.read(self.traces.sparkSession), source=source)
        tests = {"==": "__eq__", ">=": "__ge__", "<=": "__le__", "in": "isin"}
        rows = self.traces
        for c, op, v in conditions:
            rows = rows.where(getattr(F.col(c), tests[op])(v))
        return self.with_traces(rows)

    def sel(self, method: str | None = None, **labels) -> Volume:
        """Traces by label: a value, a list, or a slice with both ends; ``nearest`` for values.  The vertical dimension too.

        Labels are those of this volume along each dimension, whatever the other dimensions select.
        """
        out = self
        for dim, wanted in labels.items():
            if dim == self.vertical:
                low, high = (wanted.start, wanted.stop) if isinstance(wanted, slice) else (wanted, wanted)
                if method is None and not isinstance(wanted, slice) and abs((wanted - out.ns0) / out.dt - round((wanted - out.ns0) / out.dt)) > 1e-6:
                    raise KeyError(f"{dim} has no label {wanted}")
                first = 0 if low is None else max(0, -int(-(low - out.ns0) // out.dt)) if isinstance(wanted, slice) else round((low - out.ns0) / out.dt)
                last = 2**31 - 2 if high is None else int((high - out.ns0) // out.dt) if isinstance(wanted, slice) else first
                out = out.isel_z(first, last)
                continue
            if isinstance(wanted, slice):
                ends = [(dim, op, int(v) if float(v).is_integer() else v) for op, v in ((">=", wanted.start), ("<=", wanted.stop)) if v is not None]
                out = out._having(*ends)
            elif method == "nearest":
                labels_ = self.traces.select(dim).distinct()
                out = out._having((dim, "in", [grid.nearest_label(labels_, dim, w).first()[0] for w in (wanted if isinstance(wanted, list) else [wanted])]))
            elif method is not None:
                raise ValueError("the method must be nearest or None")
            else:
                asked = wanted if isinstance(wanted, list) else [wanted]
                found = {r[0] for r in self.traces.where(F.col(dim).isin(asked)).select(dim).distinct().collect()}  # no more than were asked for
                if missing := [w for w in asked if w not in found]:
                    raise KeyError(f"{dim} has no labels {missing}")
                out = out._having((dim, "in", wanted) if isinstance(wanted, list) else (dim, "==", wanted))
        return out

    def isel(self, **places) -> Volume:
        """Traces by the place of their labels: a number (negative from the end), a list, a range or a half-open slice.

        Places are those in this volume along each dimension, whatever the other dimensions select.
        """
        out = self
        for dim, wanted in places.items():
            index = grid.numbered(self.traces.select(dim).where(F.col(dim).isNotNull()).distinct(), [dim], "_place")
            n = index.count()
            if isinstance(wanted, slice):
                a, b, step = wanted.indices(n)
                index = index.where((F.col("_place") >= a) & (F.col("_place") < b) & ((F.col("_place") - a) % step == 0)) if step > 0 else index.where((F.col("_place") <= a) & (F.col("_place") > b) & ((F.col("_place") - a) % -step == 0))
            else:
                numbers = list(wanted) if isinstance(wanted, list | range | tuple) else [wanted]
                if any(not -n <= i < n for i in numbers):
                    raise IndexError(f"{dim} has {n} labels")
                index = index.where(F.col("_place").isin([i % n for i in numbers]))
            out = out.with_traces(out.traces.join(index.drop("_place"), dim, "left_semi"))
        return out

    def isel_z(self, first: int, last: int) -> Volume:
        """Samples first to last, both included."""
        return self.with_traces(self.traces.withColumn("samples", traces.crop_z(F.col("samples"), first, last)), ns0=self.ns0 + first * self.dt)

    def crop(self, **bounds: tuple[float, float]) -> Volume:
        """Traces and samples whose labels lie between bounds, both included."""
        return self.sel(**{d: slice(low, high) for d, (low, high) in bounds.items()})

    def where(self, keep: Callable[[Column, Column], Column]) -> Volume:
        """Samples for which ``keep(value, vertical label)`` holds; the others become null."""
        ns0, dt = F.lit(float(self.ns0)), F.lit(float(self.dt))
        return self.with_traces(self.traces.withColumn("samples", traces.masked(F.col("samples"), lambda v, k: keep(v, ns0 + k * dt))))

    def map_traces(self, function: Callable[[pd.Series], pd.Series]) -> Volume:
        """Samples through a function of a pandas series of arrays, in Arrow batches."""
        schema = ", ".join(f"`{f.name}` {'array<double>' if f.name == 'samples' else f.dataType.simpleString()}" for f in self.traces.schema.fields)

        def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                batch["samples"] = function(batch["samples"])
                yield batch

        return self.with_traces(self.traces.mapInPandas(apply, schema))

    def map_chunks(self, function: Callable[[np.ndarray], np.ndarray], sizes: dict[str, int], ghosts: dict[str, int] | None = None, depth: tuple[int, int] | None = None) -> Volume:
        """Samples through a function of N-dimensional chunks, which see ``ghosts`` more on either side."""
        return self.with_traces(blocks.mapped(self.traces, list(self.dims), function, sizes, ghosts, depth))

    # ------------------------------------------------------------ reading off
    def long(self) -> DataFrame:
        return traces.long_view(self.traces, list(self.dims), self.ns0, self.dt)

    def stack(self, *over: str) -> DataFrame:
        """Mean over dimensions, at each sample."""
        return traces.stacked(self.long(), [d for d in self.dims if d not in over])

    def dense(self) -> Volume:
        return self.with_traces(grid.dense(self.traces, list(self.dims)))

    def dead_traces(self, scan: list[int] | None = None, zeros: bool = False) -> DataFrame:
        return self.traces.select(*self.dims, grid.dead(F.col("samples"), zeros, scan).alias("dead"))

    @property
    def kind(self) -> str:
        return keys.dimensionality(list(self.dims))

    def subsampled_labels(self, **times: int) -> dict[str, DataFrame]:
        """Labels of dimensions with midpoints added so many times over, one table a dimension."""
        out = {}
        for dim, n in times.items():
            index = written(self.traces.select(dim).where(F.col(dim).isNotNull()).distinct())
            # midpoints lie between neighbours, so each label needs the next one alone
            pair = F.slice(traces.subsampled(F.array(dim, "_next"), n), 1, 2**n)
            own = F.when(F.col("_next").isNotNull(), pair).otherwise(F.array(dim))
            out[dim] = grid.with_next(index, dim, "_next").select(F.explode(own).alias(dim))
        return out

    # ------------------------------------------------------------ geometry
    def scale_coords(self, scalar: float | None = None) -> Volume:
        if self.attrs.get("coord_scaled"):
            raise UserWarning("the coordinates are scaled already")
        scalar = scalar if scalar is not None else self.attrs.get("coord_scalar") or 1.0
        return self.with_traces(geometry.scaled(self.traces, F.lit(float(scalar)), self.coords), attrs=self.attrs | {"coord_scalar": scalar, "coord_scaled": True})

    def affine(self) -> geometry.Affine:
        return geometry.affine_of(self.traces, self.dims[:2], self.coords)

    def axes(self) -> tuple[geometry.Axis, geometry.Axis]:
        return geometry.axis_of(self.traces, self.dims[0]), geometry.axis_of(self.traces, self.dims[1])

    def fill_coords(self) -> Volume:
        full = geometry.coordinates(self.dense().traces, self.dims[:2], self.coords)
        return self.with_traces(self.traces.drop(*self.coords).join(full, list(self.dims[:2])))

    def corner_points(self) -> DataFrame:
        if "cdp" in self.dims:
            return geometry.line_ends(self.traces, "cdp", self.coords)
        return geometry.corner_points(self.traces, self.dims[:2], self.coords)

    def xysel(self, points: DataFrame, method: str = "nearest") -> DataFrame:
        return geometry.select_xy(self.traces, points, self.affine(), self.axes(), self.dims[:2], method, carry=self.dims[2:])

    def regrid_on(self, other: Volume, method: str = "linear") -> Volume:
        """These traces at the cells of another survey, by its labels."""
        cells = geometry.coordinates(other.traces, other.dims[:2], other.coords).toDF(*self.dims[:2], *self.coords)
        return self.with_traces(geometry.regridded(self.traces, cells, self.affine(), self.axes(), self.dims[:2], self.coords, method, carry=self.dims[2:]))

    def interp_like(self, other: Volume, method: str = "linear") -> Volume:
        """These traces at the labels of another volume, between those that are there, and on its vertical axis; coordinates are left behind."""
        n = other.traces.agg(F.max(F.size("samples"))).first()[0] or 1
        rows = geometry.interpolated_labels(self.traces, other.traces.select(*other.dims[:2]).toDF(*self.dims[:2]), self.axes(), self.dims[:2], method, carry=self.dims[2:])
        at = traces.axis(other.ns0, other.dt, n)
        if method == "nearest":
            on_axis = F.transform(at, lambda z: traces.at_nearest(F.col("samples"), z, self.ns0, self.dt))
        else:
            on_axis = traces.resampled(F.col("samples"), at, self.ns0, self.dt)
        return self.with_traces(rows.withColumn("samples", F.when(F.col("samples").isNotNull(), on_axis)), ns0=other.ns0, dt=other.dt)

    def interp_line(self, path: DataFrame, spacing: float = 10.0, method: str = "linear") -> DataFrame:
        return geometry.interpolated_line(self.traces, path, spacing, self.affine(), self.axes(), dims=self.dims[:2], method=method, carry=self.dims[2:])

    def at_horizon(self, horizon: DataFrame, z: str) -> DataFrame:
        return geometry.at_horizon(self.traces, horizon, self.dims[:2], z, self.ns0, self.dt)

    # ------------------------------------------------------------ attributes and display
    def set_attrs(self, **values) -> Volume:
        return replace(self, attrs=self.attrs | values)

    def rename(self, **names: str) -> Volume:
        dims = tuple(names.get(d, d) for d in self.dims)
        return replace(self, traces=self.traces.withColumnsRenamed(names), source=None, dims=dims, coords=tuple(names.get(c, c) for c in self.coords))

    def assign(self, **columns: Column) -> Volume:
        return self.with_traces(self.traces.withColumns(columns))

    def set_coords(self, x: str, y: str) -> Volume:
        if missing := [c for c in (x, y) if c not in self.traces.columns]:
            raise ValueError(f"columns {missing} are missing")
        return replace(self, coords=(x, y))

    def infer_coords(self, names: tuple[tuple[str, str], ...] = (("cdp_x", "cdp_y"), ("CDP_X", "CDP_Y"), ("SourceX", "SourceY"), ("x", "y"))) -> Volume:
        """The first of the pairs of names that the columns have."""
        for x, y in names:
            if {x, y} <= set(self.traces.columns):
                return self.set_coords(x, y)
        raise ValueError("no pair of coordinate columns is known")

    def set_dims(self, *dims: str, check: bool = True) -> Volume:
        """Other dimensions, which must tell all traces apart."""
        if missing := [d for d in dims if d not in self.traces.columns]:
            raise ValueError(f"columns {missing} are missing")
        if check:
            grid.check_unique(self.traces, list(dims))
        return replace(self, dims=tuple(dims), source=None)

    def squeeze(self) -> Volume:
        """Without the dimensions of one label, which stay as attributes."""
        rows, single = grid.squeezed(self.traces, list(self.dims))
        return self.with_traces(rows, dims=tuple(d for d in self.dims if d not in single), attrs=self.attrs | {"squeezed": single})

    def expand_dims(self, **labels) -> Volume:
        """With more dimensions, of one label each."""
        return self.with_traces(self.traces.withColumns({d: F.lit(v) for d, v in labels.items()}), dims=(*self.dims, *labels))

    def broadcast_like(self, other: Volume) -> Volume:
        """Repeated along the other volume's dimensions that this one doesn't have."""
        rows = grid.broadcast_like(self.traces, list(self.dims), other.traces, list(other.dims))
        return self.with_traces(rows, dims=(*self.dims, *[d for d in other.dims if d not in self.dims]))

    def zeros_like(self) -> Volume:
        """Zeros for every combination of labels, whether a trace is there or not."""
        n = self.traces.agg(F.max(F.size("samples"))).first()[0] or 0
        return self.with_traces(self.dense().traces.withColumn("samples", F.array_repeat(F.lit(0.0), n)))

    def _repr_html_(self) -> str:
        rows = "".join(f"<tr><th>{html.escape(str(k))}</th><td>{html.escape(str(v))}</td></tr>" for k, v in {"dims": self.dims, "columns": self.traces.columns, "axis": (self.vertical, self.ns0, self.dt)}.items())
        return f"<table>{rows}</table>"
