"""SEG-Y files as Spark data sources: ``segy`` (traces, or headers only) to read and write, ``segy_meta`` (a row a file).

``spark.dataSource.register(SegyDataSource)`` makes ``spark.read.format("segy")`` known.  Options of reading:

* ``dims`` and ``extras``: ``name=byte`` pairs with commas between; they become columns;
* ``layout``: a named byte layout instead;
* ``headersOnly``: no samples, of each trace 240 bytes are read; without dims all 91 fields are columns;
* ``first`` and ``last``: sample places to cut traces to, before they leave the reader;
* ``where``: JSON of [column, comparison, value] triples over these columns and tracen (``==``, ``>=``, ``<=``, ``>``,
  ``<``, ``in``), of which all must hold; they are applied to the headers, before samples are read;
* ``index``: a folder that ``write_index`` has made: blocks of traces whose least and greatest header values can't meet
  the conditions aren't read; a file that has changed since is read whole, with a warning;
* ``endian``: big or little; ``tracesPerPartition``.

The reader takes no filters from Spark: Spark 4.1 keeps a Python reader's filters with the table, so a later query
on the same DataFrame without them would lose rows.
"""

from __future__ import annotations

import glob
import json
import os
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

from .. import codec
from ..functions.text import as_lines, byte_map_lines, default_header
from ..keys import FIELD_BYTES, LAYOUTS, MEASUREMENT_UNITS, TRACE_FIELDS, check_bytes, check_names, layout
from ..operators.geometry import multiplier
from ..operators.grid import placed, range_bounds

SUFFIXES = (".sgy", ".segy")


def is_segy(path: object) -> bool:
    """Whether a path looks like a SEG-Y file."""
    try:
        return os.fspath(path).lower().endswith(SUFFIXES)
    except TypeError:
        return False


def files(path: str) -> list[str]:
    """SEG-Y files of a path: a file, a folder or a pattern, several with commas between."""
    out: list[str] = []
    for p in path.split(","):
        p = p.removeprefix("file:")
        p = "/" + p.lstrip("/") if p.startswith("//") else p
        found = sorted(glob.glob(p))
        for f in found:
            out += sorted(os.path.join(f, x) for x in os.listdir(f) if is_segy(x)) if os.path.isdir(f) else [f]
    if not out:
        raise FileNotFoundError(f"no SEG-Y files at {path}")
    return out


def byte_map(text: str | None) -> dict[str, int]:
    pairs = [p.split("=") for p in (text or "").split(",") if p.strip()]
    found = {k.strip(): int(v) for k, v in pairs}
    check_bytes(list(found.values()))
    return found


@dataclass
class Head:
    path: str
    text: str
    binary: dict[str, int]
    extended: list[str]
    first: int
    stride: int
    traces: int


def head(path: str, endian: str) -> Head:
    with open(path, "rb") as f:
        prologue = f.read(codec.PROLOGUE)
        binary = codec.decode_binary(prologue, endian)
        extended = [codec.decode_text(f.read(codec.TEXT)) for _ in range(max(0, binary["ExtendedHeaders"]))]
    return Head(path, codec.decode_text(prologue[: codec.TEXT]), binary, extended, *codec.layout_of(os.path.getsize(path), binary))


def mapped(h: Head) -> np.ndarray:
    """The traces of a file, a row of bytes each, of which only what is looked at is read."""
    return np.memmap(h.path, dtype=np.uint8, mode="r", offset=h.first, shape=(h.traces, h.stride))


def sample_lists(h: Head, data: np.ndarray, rows: np.ndarray, first: int, last: int | None, endian: str) -> pa.ListArray:
    """Samples first to last of the given rows of trace bytes."""
    ns = h.binary["Samples"]
    last, width = min(ns - 1 if last is None else last, ns - 1), (h.stride - codec.HEADER) // ns if ns else 0
    raw = np.ascontiguousarray(data[rows, codec.HEADER + first * width : codec.HEADER + (last + 1) * width])
    samples = codec.decode_samples(raw, h.binary["Format"], endian).reshape(len(rows), -1)
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * samples.shape[1], pa.array(samples.reshape(-1)))


@dataclass
class Traces(InputPartition):
    path: str
    start: int
    stop: int


COMPARISONS = {"==": np.equal, ">": np.greater, ">=": np.greater_equal, "<": np.less, "<=": np.less_equal, "in": np.isin}


class SegyReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.options = schema, options
        self.endian = options.get("endian", "big")
        self.columns = columns_of(options)
        self.filters: list[tuple[str, str, object]] = [tuple(f) for f in json.loads(options.get("where", "[]"))]
        for name, op, _ in self.filters:
            if op not in COMPARISONS or (name not in self.columns and name != "tracen"):
                raise ValueError(f"{name} {op} can't be applied to trace headers")

    def blocks(self, path: str, low: int, high: int) -> list[tuple[int, int]]:
        """The runs of traces that may meet the conditions, by the file's index if it has one."""
        if "index" not in self.options or low >= high:
            return [(low, high)]
        index = read_index(self.options["index"], path)
        if index is None:
            warnings.warn(f"{path} isn't as its index says, and is read whole", UserWarning, stacklevel=2)
            return [(low, high)]
        keep = np.ones(len(index["start"]), dtype=bool)
        for name, op, v in self.filters:
            if name != "tracen":
                least, most = (index[f"{k}_{TRACE_FIELDS[self.columns[name]][0]}"] for k in ("min", "max"))
                values = np.asarray(v)
                keep &= {
                    "==": lambda a, b, v: (a <= v) & (v <= b), "in": lambda a, b, v: ((a[:, None] <= v) & (v <= b[:, None])).any(axis=1),
                    ">": lambda a, b, v: b > v, ">=": lambda a, b, v: b >= v, "<": lambda a, b, v: a < v, "<=": lambda a, b, v: a <= v,
                }[op](least, most, values)
        runs: list[tuple[int, int]] = []
        for start, stop in zip(index["start"][keep].tolist(), index["stop"][keep].tolist(), strict=True):
            start, stop = max(start, low), min(stop, high)
            if start < stop:
                runs = [*runs[:-1], (runs[-1][0], stop)] if runs and runs[-1][1] == start else [*runs, (start, stop)]
        return runs

    def partitions(self) -> list[Traces]:
        size = int(self.options.get("tracespartition", self.options.get("tracesPerPartition", 50_000)))
        out = []
        for path in files(self.options["path"]):
            n = head(path, self.endian).traces
            low = max([0, *(v + (op == ">") for name, op, v in self.filters if name == "tracen" and op in ("==", ">", ">="))])
            high = min([n, *(v + (op != "<") for name, op, v in self.filters if name == "tracen" and op in ("==", "<", "<="))])
            out += [Traces(path, i, min(i + size, b)) for a, b in self.blocks(path, low, high) for i in range(a, b, size)]
        return out or [Traces("", 0, 0)]

    def read(self, partition: Traces) -> Iterator[pa.RecordBatch]:
        if partition.start >= partition.stop:
            return
        h = head(partition.path, self.endian)
        data = mapped(h)
        only = self.options.get("headersonly", self.options.get("headersOnly", "false")).lower() == "true"
        first, last = sample_range(self.options)
        step = max(1, (8 << 20) // h.stride)
        for at in range(partition.start, partition.stop, step):
            to = min(at + step, partition.stop)
            fields = codec.decode_headers(np.asarray(data[at:to, : codec.HEADER]), sorted(set(self.columns.values())), self.endian)
            values = {name: fields[b] for name, b in self.columns.items()}
            values["tracen"] = np.arange(at, to, dtype=np.int64)
            keep = np.ones(to - at, dtype=bool)
            for name, op, v in self.filters:
                keep &= COMPARISONS[op](values[name], v)
            rows = np.flatnonzero(keep)
            if not len(rows):
                continue
            columns = [pa.array([partition.path] * len(rows)), pa.array(values["tracen"][rows])]
            columns += [pa.array(values[name][rows]) for name in self.columns]
            if not only:
                columns.append(sample_lists(h, data, at + rows, first, last, self.endian))
            yield pa.RecordBatch.from_arrays(columns, names=self.schema.names)


def sample_range(options: dict[str, str]) -> tuple[int, int | None]:
    return int(options.get("first", 0)), int(options["last"]) if "last" in options else None


def columns_of(options: dict[str, str]) -> dict[str, int]:
    named = layout(options["layout"]) if options.get("layout") else byte_map(options.get("dims")) | byte_map(options.get("extras"))
    headers_only = options.get("headersonly", options.get("headersOnly", "false")).lower() == "true"
    if not named and headers_only:
        named = dict(FIELD_BYTES)
    return named


class SegyDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "segy"

    def schema(self) -> StructType:
        fields = [StructField("file", StringType()), StructField("tracen", LongType())]
        fields += [StructField(n, IntegerType()) for n in columns_of(dict(self.options))]
        if self.options.get("headersOnly", "false").lower() != "true":
            fields.append(StructField("samples", ArrayType(FloatType())))
        return StructType(fields)

    def reader(self, schema: StructType) -> SegyReader:
        return SegyReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> SegyWriter:
        return SegyWriter(schema, dict(self.options), overwrite)


class MetaReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[Traces]:
        return [Traces(f, 0, 0) for f in files(self.options["path"])]

    def read(self, partition: Traces) -> Iterator[tuple]:
        endian = self.options.get("endian", "big")
        h = head(partition.path, endian)
        b = h.binary
        yield (partition.path, h.traces, b["Samples"], b["Interval"] / 1000.0, b["Format"], MEASUREMENT_UNITS.get(b["MeasurementSystem"]), h.text, h.extended, json.dumps(b))


class SegyMetaSource(DataSource):
    """One row a file: size, sample interval, format, units, text headers and binary header; no trace is read."""

    @classmethod
    def name(cls) -> str:
        return "segy_meta"

    def schema(self) -> StructType:
        kinds = {"file": StringType(), "ntraces": LongType(), "ns": IntegerType(), "dt": DoubleType(), "format": IntegerType(), "units": StringType(), "text": StringType(), "extended": ArrayType(StringType()), "binary": StringType()}
        return StructType([StructField(n, t) for n, t in kinds.items()])

    def reader(self, schema: StructType) -> MetaReader:
        return MetaReader(dict(self.options))


@dataclass
class Written(WriterCommitMessage):
    traces: int


class SegyWriter(DataSourceArrowWriter):
    """Each task writes the bytes of its traces (column tracen) to one file on a file system that all tasks share."""

    def __init__(self, schema: StructType, options: dict[str, str], overwrite: bool):
        self.names, self.options = schema.names, options
        self.path, self.endian = options["path"].removeprefix("file:"), options.get("endian", "big")
        self.kind, self.ns = int(options.get("format", 1)), int(options["ns"])
        self.map = byte_map(options.get("headers"))
        self.total = int(options["ntraces"])
        stride = codec.HEADER + self.ns * codec.SAMPLE_BYTES[self.kind]
        if os.path.exists(self.path) and not overwrite:
            raise ValueError(f"{self.path} is there already")
        interval, system = int(options.get("interval", 1000)), int(options.get("system", 1))
        binary = codec.encode_binary({"JobID": 1, "LineNumber": 1, "ReelNumber": 1, "Traces": self.total % 32768, "AuxTraces": self.total % 32768, "Interval": interval, "Samples": self.ns, "Format": self.kind, "EnsembleFold": 1, "MeasurementSystem": system, "SEGYRevision": 256}, self.endian)
        text = b"".join(as_lines(json.loads(options["text"], object_hook=lambda d: {int(k): v for k, v in d.items()}) if options.get("text") else default_header()))
        with open(self.path, "wb") as f:
            f.write(text.decode("utf-8", "replace").encode("cp500", "replace")[: codec.TEXT].ljust(codec.TEXT, b"\x40"))
            f.write(binary)
            f.truncate(codec.PROLOGUE + self.total * stride)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        width, n = codec.SAMPLE_BYTES[self.kind], 0
        fixed = {115: self.ns, 117: int(self.options.get("interval", 1000)), 109: int(float(self.options.get("ns0", 0))), 71: int(float(self.options.get("scalar", 0))), 37: 1}
        with open(self.path, "r+b") as f:
            for batch in batches:
                size, lists = batch.num_rows, batch.column("samples")
                if not size:
                    continue
                number = batch.column("tracen").to_numpy(zero_copy_only=False).astype(np.int64)
                lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                if (lengths != self.ns).any():
                    at = int(np.flatnonzero(lengths != self.ns)[0])
                    raise ValueError(f"trace {number[at]} has {lengths[at]} samples, not {self.ns}")
                samples = pc.fill_null(lists.flatten().cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
                block = np.zeros((size, codec.HEADER + self.ns * width), dtype=np.uint8)
                fields = fixed | {b: (batch.column(name).cast(pa.int64()), fixed.get(b, 0)) for name, b in self.map.items()}
                for b, v in (fields | {1: number + 1, 5: number + 1}).items():
                    v = pc.fill_null(v[0], v[1]).to_numpy(zero_copy_only=False) if isinstance(v, tuple) else np.broadcast_to(v, size)
                    codec.encode_field(block, b, v, self.endian)
                block[:, codec.HEADER :] = np.frombuffer(codec.encode_samples(samples, self.kind, self.endian), dtype=np.uint8).reshape(size, -1)
                cut = np.flatnonzero(np.append(True, number[1:] != number[:-1] + 1))  # runs of traces side by side
                for i, j in zip(cut.tolist(), [*cut[1:].tolist(), size], strict=True):
                    f.seek(codec.PROLOGUE + int(number[i]) * block.shape[1])
                    f.write(block[i:j].tobytes())
                n += size
        return Written(n)

    def commit(self, messages: list[Written]) -> None:
        if sum(m.traces for m in messages if m) != self.total:
            raise RuntimeError("not all traces were written")

    def abort(self, messages: list[Written]) -> None:
        if os.path.exists(self.path):
            os.remove(self.path)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SegyDataSource)
    spark.dataSource.register(SegyMetaSource)


def read_traces(spark: SparkSession, path: str, dims: dict[str, int] | None = None, extras: dict[str, int] | None = None, headers_only: bool = False, keep: DataFrame | None = None, where: list[tuple] | None = None, **options) -> DataFrame:
    """Traces of SEG-Y files; ``where`` is conditions on headers, ``keep`` a table of trace numbers (tracen), and file where there are several, to load only."""
    register(spark)
    spec = lambda m: ",".join(f"{k}={v}" for k, v in (m or {}).items())
    options = {k: str(v) for k, v in options.items()}

    def reader(only: bool) -> DataFrame:
        named = spark.read.format("segy").option("dims", spec(dims)).option("extras", spec(extras)).option("headersOnly", str(only).lower())
        return named.option("where", json.dumps(where or [])).options(**options).load(path)

    if keep is None:
        return reader(headers_only)
    heads = reader(True).join(keep, [c for c in ("file", "tracen") if c in keep.columns], "left_semi")
    if headers_only:
        return heads
    if not (dims or extras or options.get("layout")):
        heads = heads.select("file", "tracen")
    endian, (first, last) = options.get("endian", "big"), sample_range(options)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The samples of the kept traces only."""
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = pa.Table.from_batches([batch.slice(at, 1000)]).sort_by([("file", "ascending"), ("tracen", "ascending")])
                names = np.array(part.column("file").to_pylist())
                for name in dict.fromkeys(names.tolist()):
                    own, h = part.filter(pa.array(names == name)), head(name, endian)
                    lists = sample_lists(h, mapped(h), own.column("tracen").to_numpy(), first, last, endian)
                    yield from own.append_column("samples", lists).combine_chunks().to_batches()

    return heads.mapInArrow(fetch, StructType([*heads.schema.fields, StructField("samples", ArrayType(FloatType()))]))


def write_samples(traces: DataFrame, path: str, first: int = 0, block: int = 1000, manifest: str | None = None, endian: str = "big") -> int:
    """Write samples (of column samples, from place ``first`` on) into the traces (tracen) of a file that is there; returns how many.

    Traces are dealt to tasks by blocks of their numbers, each task writes its own byte ranges, so a repeated attempt writes
    the same bytes again.  With ``manifest``, a folder that all tasks share, each finished block leaves a mark there, and a
    job that is run again after a failure goes on with the others; a new folder begins anew.
    """
    h = head(path, endian)
    ns, kind = h.binary["Samples"], h.binary["Format"]
    width = codec.SAMPLE_BYTES[kind]
    rows = traces.select(F.col("tracen").cast("long").alias("tracen"), "samples").where("tracen IS NOT NULL").withColumn("block", F.floor(F.col("tracen") / block))
    if manifest:
        os.makedirs(manifest, exist_ok=True)
        done = [(int(n),) for n in os.listdir(manifest) if n.isdigit()]
        rows = rows.join(F.broadcast(traces.sparkSession.createDataFrame(done, "block long")), "block", "left_anti") if done else rows  # a number for each block

    def write(table: pa.Table) -> pa.Table:
        number, lists = table["tracen"].to_numpy(), table["samples"].combine_chunks()
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        if number.min() < 0 or number.max() >= h.traces:
            raise ValueError(f"the file has traces 0 to {h.traces - 1}")
        if lengths.min() < 1 or lengths.min() != lengths.max() or first < 0 or first + lengths.max() > ns:
            raise ValueError(f"samples must be of one length and end at {ns} at most")
        values = pc.fill_null(lists.flatten().cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
        raw = np.frombuffer(codec.encode_samples(values, kind, endian), dtype=np.uint8).reshape(len(number), -1)
        with open(path, "r+b") as f:
            for i in np.argsort(number, kind="stable").tolist():
                f.seek(h.first + int(number[i]) * h.stride + codec.HEADER + first * width)
                f.write(raw[i].tobytes())
            f.flush()
            os.fsync(f.fileno())
        if manifest:
            with open(os.path.join(manifest, str(table["block"][0].as_py())), "wb"):
                pass
        return pa.table({"n": pa.array([len(number)], pa.int64())})

    return rows.groupBy("block").applyInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _stamp(path: str) -> tuple[int, int]:
    """Size and time of the last change of a file."""
    found = os.stat(path)
    return found.st_size, found.st_mtime_ns


def write_index(spark: SparkSession, path: str, index: str, block: int = 1000, **options) -> None:
    """Keep the least and greatest value of every header field for blocks of traces of SEG-Y files, as Parquet."""
    heads = read_headers(spark, path, **options)
    number = F.floor(F.col("tracen") / block)
    ends = [f(n).alias(f"{k}_{n}") for n in FIELD_BYTES for k, f in (("min", F.min), ("max", F.max))]
    zones = heads.groupBy("file", number.alias("block")).agg(F.min("tracen").alias("start"), (F.max("tracen") + 1).alias("stop"), *ends)
    stamps = spark.createDataFrame([(f, *_stamp(f)) for f in files(path)], "file string, size long, changed long")
    zones.drop("block").join(F.broadcast(stamps), "file").repartitionByRange(max(1, len(files(path)) // 100), "file").sortWithinPartitions("file", "start").write.mode("overwrite").parquet(index)


def read_index(index: str, path: str) -> dict[str, np.ndarray] | None:
    """The blocks of a file, in order; None if there are none or the file has changed."""
    table = pq.read_table(index.removeprefix("file:"), filters=[("file", "=", path)])
    if not table.num_rows or (table["size"][0].as_py(), table["changed"][0].as_py()) != _stamp(path):
        return None
    return {n: table[n].to_numpy() for n in table.column_names if n != "file"}


def read_headers(spark: SparkSession, path: str, traces: int | None = None, names: list[str | int] | None = None, **options) -> DataFrame:
    """Trace headers: all 91 fields, or those given by name or first byte, of all traces or the first ``traces``."""
    check_bytes([n for n in names or [] if isinstance(n, int)])
    names = [TRACE_FIELDS[n][0] if isinstance(n, int) else n for n in names or []]
    check_names(names)
    if traces is not None and not isinstance(traces, int):
        raise ValueError("the number of traces must be an integer")
    first = [("tracen", "<", traces)] if traces and traces > 0 else None
    return read_traces(spark, path, {n: FIELD_BYTES[n] for n in names or []}, headers_only=True, where=first, **options)


def read_meta(spark: SparkSession, path: str, **options) -> DataFrame:
    """A row a file: what ``segy_meta`` has, with the smallest delay (ns0) and the median coordinate scalar of all its traces."""
    register(spark)
    meta = spark.read.format("segy_meta").options(**options).load(path)
    heads = read_headers(spark, path, names=["DelayRecordingTime", "SourceGroupScalar"], **options)
    sums = heads.groupBy("file").agg(F.min("DelayRecordingTime").cast("double").alias("ns0"), F.median("SourceGroupScalar").alias("coord_scalar"))
    return meta.join(sums, "file", "left").fillna(0.0, ["ns0", "coord_scalar"])


def write_traces(traces: DataFrame, path: str, dims: dict[str, int], extras: dict[str, int] | None = None, ns0: float = 0.0, dt: float = 1.0, dead=None, coord_scalar: float | None = None, scaled: tuple[str, ...] = (), text: dict[int, str] | list[str] | None = None, overwrite: bool = True, sample_format: int = 1, endian: str = "big", system: int = 1) -> int:
    """Write traces to one SEG-Y file in the order of the dimensions, dead ones left out; returns their number.

    With ``coord_scalar`` the ``scaled`` coordinates are turned back into what headers hold.
    """
    spark = traces.sparkSession
    register(spark)
    fields = dims | (extras or {})
    check_bytes(list(fields.values()))
    if missing := [n for n in fields if n not in traces.columns]:
        raise ValueError(f"columns {missing} are missing")
    rows = traces
    if coord_scalar is not None:
        rows = rows.withColumns({c: F.round(F.col(c) * multiplier(F.lit(float(coord_scalar)), inverse=True)) for c in scaled})
    if dead is not None:
        rows = rows.where(~dead)
    bounds = range_bounds(rows, list(dims), ns=F.size("samples"))
    n, ns = sum(b["_n"] for b in bounds), max([b["ns"] or 0 for b in bounds], default=0)
    rows = placed(rows, list(dims), bounds, "tracen").select("tracen", *[F.col(n).cast("int").alias(n) for n in fields], "samples")
    header = json.dumps(text if text is not None else default_header({i + 6: line for i, line in enumerate(byte_map_lines(fields))}))
    writer = rows.write.format("segy").mode("overwrite" if overwrite else "append")
    options = {"ns": ns, "ntraces": n, "headers": ",".join(f"{k}={v}" for k, v in fields.items()), "interval": int(round(dt * 1000)), "ns0": ns0, "scalar": coord_scalar or 0, "text": header, "format": sample_format, "endian": endian, "system": system}
    writer.options(**{k: str(v) for k, v in options.items()}).save(path)
    return n


__all__ = ["LAYOUTS", "TRACE_FIELDS", "SegyDataSource", "SegyMetaSource", "head", "is_segy", "read_headers", "read_meta", "read_traces", "register", "write_index", "write_samples", "write_traces"]
