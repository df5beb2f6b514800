"""Labels, positions, grids and numbering of traces.

A trace table has a row a trace: its dimension labels, other header columns and
the samples.  Dimension tables (the distinct labels) are small beside it, but
may still be too large for one task, so global positions are computed by value
ranges: rows are dealt into ranges of all order columns and numbered within
them, and each range's offset comes from the sizes of those before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..workspace import written

#: Rows that are numbered as one range.
FEW_ROWS = 100_000
#: Traces whose steps are compared in one task.
RANGE_ROWS = 2_000_000


def labels(traces: DataFrame, dim: str) -> DataFrame:
    """Distinct labels of a dimension, in order."""
    return traces.select(dim).where(F.col(dim).isNotNull()).distinct().orderBy(dim)


def duplicates(traces: DataFrame, dims: list[str]) -> DataFrame:
    """Label tuples that more than one trace has, with the number of traces."""
    return traces.groupBy(*dims).agg(F.count("*").alias("n")).where("n > 1")


def check_unique(traces: DataFrame, dims: list[str]) -> None:
    """Fail unless the dimensions tell every trace apart."""
    if not duplicates(traces, dims).isEmpty():
        raise ValueError(f"{dims} don't tell all traces apart; another dimension is needed")


def ranged(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows in range partitions of the order columns, written, with the number of their range and their place in it (from 0)."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()
    sorted_rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # written, as the ranges are sampled anew each time that they are made
    return written(sorted_rows.withColumns({"_range": F.shiftright(place, 33), "_place": place.bitwiseAND((1 << 33) - 1)}))


def before(sizes: DataFrame, keys: list[str], n: str) -> DataFrame:
    """For each range (a row, of which there are as many as tasks) the sum of ``n`` in the ranges before it."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return sizes.withColumn("_before", F.coalesce(F.sum(n).over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def range_bounds(rows: DataFrame, order: list[str], parts: int | None = None, **sums: Column) -> list[Row]:
    """Ranges of the order columns that hold about as many rows each: least key (``_from``), rows before, and aggregates.

    One pass over the order columns and what the aggregates read; a row for each of ``parts`` ranges, at most, comes back.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.select(F.struct(*order).alias("_key"), *[v.alias(f"_{k}") for k, v in sums.items()])
    if parts == 1:
        whole = keyed.agg(F.min("_key").alias("_from"), F.count("*").alias("_n"), *[F.max(f"_{k}").alias(k) for k in sums]).first()
        return [Row(**whole.asDict(recursive=False), _before=0)] if whole["_n"] else []
    dealt = keyed.repartitionByRange(parts, "_key").groupBy(F.spark_partition_id().alias("_part"))
    found = dealt.agg(F.min("_key").alias("_from"), F.count("*").alias("_n"), *[F.max(f"_{k}").alias(k) for k in sums]).orderBy("_from").collect()
    done, out = 0, []
    for r in found:
        out.append(Row(**r.asDict(recursive=False), _before=done))
        done += r["_n"]
    return out


def ranged_by(rows: DataFrame, key: Column, bounds: list[Row], names: list[str]) -> DataFrame:
    """Rows with the number of the last range that doesn't begin after their key (0: none), and the array of ranges."""
    kind = rows.select(key.alias("_from")).schema["_from"].dataType
    schema = StructType([StructField("_from", kind), *[StructField(n, LongType()) for n in names]])
    one = rows.sparkSession.createDataFrame([(r["_from"], *[r[n] for n in names]) for r in bounds], schema)
    one = one.agg(F.array_sort(F.collect_list(F.struct(*one.columns))).alias("_ranges"))  # a row for each range
    return rows.join(F.broadcast(one)).withColumn("_range", F.size(F.filter("_ranges", lambda r: r["_from"] <= key)))


def placed(rows: DataFrame, order: list[str], bounds: list[Row], name: str) -> DataFrame:
    """Rows with their place in the order: each goes to the last range that doesn't begin after it, and is counted there."""
    if not bounds:
        return rows.withColumn(name, F.lit(None).cast("long"))
    dealt = ranged_by(rows, F.struct(*order), bounds, ["_before"])
    before = F.element_at("_ranges", F.col("_range"))["_before"]
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return dealt.withColumn("_before", before).drop("_ranges").withColumn(name, F.col("_before") + place).drop("_range", "_before")


def numbered(rows: DataFrame, order: list[str], name: str, parts: int | None = None) -> DataFrame:
    """Rows with their place (from 0) in the order of the columns, nulls first; equal rows get places side by side.

    The order columns are dealt into ranges, of which the least keys and the sizes are known to all tasks; the rows then
    go to their ranges, where they are counted.  So a row moves once, and none is lost or doubled whatever its key is.  Up to
    ``FEW_ROWS`` rows are one range, unless ``parts`` says how many.
    """
    return placed(rows, order, _ranges(rows, order, parts), name)


def _ranges(rows: DataFrame, order: list[str], parts: int | None) -> list[Row]:
    """Ranges for ``numbered`` and ``with_next``: one for few rows."""
    bounds = range_bounds(rows, order, parts or 1)
    if not parts and bounds and bounds[0]["_n"] > FEW_ROWS:
        bounds = range_bounds(rows, order)
    return bounds


def with_next(index: DataFrame, dim: str, name: str, parts: int | None = None) -> DataFrame:
    """Distinct labels of a dimension, each with the one after it (the last one with null); ranges are those of ``numbered``."""
    bounds = _ranges(index, [dim], parts)
    if not bounds:
        return index.withColumn(name, F.col(dim))
    dealt = ranged_by(index, F.struct(dim), bounds, [])
    within = F.lead(dim).over(Window.partitionBy("_range").orderBy(dim))
    after = F.try_element_at("_ranges", F.col("_range") + 1)["_from"][dim]  # a range begins with its least label
    return dealt.withColumn(name, F.coalesce(within, after)).drop("_ranges", "_range")


def with_position(traces: DataFrame, dim: str, name: str | None = None) -> DataFrame:
    """Traces with the place (from 0) of their label among all labels of the dimension."""
    name = name or f"{dim}_pos"
    index = numbered(traces.select(dim).where(F.col(dim).isNotNull()).distinct(), [dim], name)
    return traces.join(index, dim, "left")


def dense(traces: DataFrame, dims: list[str]) -> DataFrame:
    """A row for every combination of labels; columns are null where no trace is."""
    cells = traces.select(dims[0]).distinct()
    for d in dims[1:]:
        cells = cells.crossJoin(traces.select(d).distinct())  # the cells of the grid are the product of its axes
    return cells.join(traces, dims, "left")


def missing_cells(traces: DataFrame, dims: list[str]) -> DataFrame:
    """Combinations of labels without a trace."""
    return dense(traces.select(*dims).withColumn("_there", F.lit(1)), dims).where("_there IS NULL").drop("_there")


def filled(cells: DataFrame, ns: int, value: float = 0.0, samples: str = "samples") -> DataFrame:
    """Cells with ``value`` for all samples where there is no trace."""
    return cells.withColumn(samples, F.coalesce(F.col(samples), F.array_repeat(F.lit(value), ns)))


def islands(rows: DataFrame, number: str, partition: list[str] | None = None) -> DataFrame:
    """Runs of consecutive numbers: first, last and count of each, by partition."""
    if not partition:
        # numbers less their places are equal within a run, so no task sees all rows
        places = numbered(rows.select(number).distinct(), [number], "_place")
        times = rows.groupBy(number).agg(F.count("*").alias("_n"))
        runs = places.join(times, number).groupBy((F.col(number) - F.col("_place")).alias("_run")).agg(F.min(number).alias("first"), F.max(number).alias("last"), F.sum("_n").alias("n"))
        return numbered(runs.drop("_run"), ["first"], "block").select("block", "first", "last", "n")
    order = Window.partitionBy(*partition).orderBy(number)
    brk = F.when(F.col(number) - F.lag(number).over(order) > 1, 1).otherwise(0)
    runs = rows.withColumn("_break", brk).withColumn("block", F.sum("_break").over(order))
    return runs.groupBy(*partition, "block").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count("*").alias("n"))


def chunk_heuristic(traces: DataFrame, dims: list[str], number: str, rows: int = RANGE_ROWS) -> dict[str, int]:
    """Preferred chunk of each dimension: 1 where the label stays the same from some trace to the next, else all (-1)."""
    ranges = traces.select(number, *dims).withColumn("_range", F.floor(F.col(number) / rows))
    w = Window.partitionBy("_range").orderBy(number)
    within = ranges.select(*[F.abs(F.col(d) - F.lag(d).over(w)).alias(d) for d in dims])
    # the last trace of a range and the first of the next, a row a range
    ends = ranges.groupBy("_range").agg(*[f(d, number).alias(f"{k}_{d}") for d in dims for k, f in (("a", F.min_by), ("b", F.max_by))])
    all_ranges = Window.partitionBy(F.lit(0)).orderBy("_range")
    across = ends.select(*[F.abs(F.col(f"a_{d}") - F.lag(f"b_{d}").over(all_ranges)).alias(d) for d in dims])
    steps = within.unionByName(across).agg(*[F.min(d).alias(d) for d in dims]).first()
    return {d: 1 if steps[d] == 0 else -1 for d in dims}


# ---------------------------------------------------------------- along a line of traces, and joins of header tables
def _steps(rows: DataFrame, line: list[str], order: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(*line).orderBy(*order)
    return rows.withColumn("_step", F.col(value) - F.lag(value).over(w))


def falls(rows: DataFrame, line: list[str], order: list[str], value: str) -> DataFrame:
    """Whether a label ever falls from one trace of a line to the next."""
    return _steps(rows, line, order, value).groupBy(*line).agg(F.coalesce(F.min("_step") < 0, F.lit(False)).alias("reversed"))


def path_lengths(rows: DataFrame, line: list[str], order: list[str], value: str) -> DataFrame:
    """The way that a value goes up and down along each line."""
    return _steps(rows, line, order, value).groupBy(*line).agg(F.sum(F.abs("_step")).alias("length"))


def forward_filled(rows: DataFrame, line: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Rows with the last value along their line that isn't null."""
    w = Window.partitionBy(*line).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def with_headers(traces: DataFrame, headers: DataFrame, on: list[str]) -> DataFrame:
    """All traces with the header columns of those that have any."""
    return traces.join(headers, on, "left")


def merged(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """The rows of both header tables, side by side where they have the same labels."""
    return left.join(right, on, "full_outer")


def without(traces: DataFrame, gone: DataFrame, on: list[str]) -> DataFrame:
    """Traces whose labels the other table doesn't have."""
    return traces.join(gone, on, "left_anti")


def decimated(traces: DataFrame, number: str, step: int, first: int = 0) -> DataFrame:
    """Every ``step``-th trace by number."""
    return traces.where((F.col(number) - first) % step == 0)


def squeezed(traces: DataFrame, dims: list[str]) -> tuple[DataFrame, dict[str, object]]:
    """Traces without the dimensions of one label, and those labels."""
    row = traces.agg(*[f(d).alias(f"{k}_{d}") for d in dims for k, f in (("a", F.min), ("b", F.max))]).first()
    single = {d: row[f"a_{d}"] for d in dims if row[f"a_{d}"] is not None and row[f"a_{d}"] == row[f"b_{d}"]}
    return traces.drop(*single), single


def broadcast_like(traces: DataFrame, dims: list[str], other: DataFrame, other_dims: list[str]) -> DataFrame:
    """Traces repeated along the other table's dimensions that they don't have, where the shared ones agree."""
    shared, more = [d for d in other_dims if d in dims], [d for d in other_dims if d not in dims]
    labels = other.select(*shared, *more).distinct()
    return traces.join(labels, shared) if shared else traces.crossJoin(labels)  # the product is what is asked for


def dead(samples: Column, zeros: bool = False, scan: list[int] | None = None) -> Column:
    """Whether a trace is dead: all samples (or those of ``scan``) null, or with ``zeros`` all null or 0."""
    looked = F.transform(F.array(*map(F.lit, scan)), lambda k: F.get(samples, k)) if scan is not None else samples
    nothing = F.forall(looked, lambda v: v.isNull())
    return nothing | F.forall(samples, lambda v: v.isNull() | (v == 0)) if zeros else nothing


def live_numbers(traces: DataFrame, dims: list[str], is_dead: Column, name: str = "tracen_out") -> DataFrame:
    """Live traces numbered from 0 in the order of the dimensions; dead traces are left out."""
    return numbered(traces.where(~is_dead), dims, name)


def with_block(traces: DataFrame, position: str, size: int, name: str = "block") -> DataFrame:
    """Traces with the number of the bag of ``size`` positions that they fall into."""
    return traces.withColumn(name, F.floor(F.col(position) / size).cast("long"))


def blank_grid(spark: SparkSession, axes: dict[str, list | tuple[float, float, int]], ns: int, value: float | None = None) -> DataFrame:
    """A trace for every combination of labels; an axis is a list of labels or (first, step, number)."""
    out = None
    for name, axis in axes.items():
        if isinstance(axis, list):
            one = spark.createDataFrame([(v,) for v in axis], [name])
        else:
            first, step, n = axis
            one = spark.range(n).select((F.lit(first) + F.col("id") * F.lit(step)).alias(name))
        out = one if out is None else out.crossJoin(one)
    return out.withColumn("samples", F.array_repeat(F.lit(value).cast("float"), ns))


def cropped(traces: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Traces whose labels lie in the bounds, both ends included."""
    for dim, (low, high) in bounds.items():
        traces = traces.where(F.col(dim).between(low, high))
    return traces


def clamp_crop(crop: list[float], limits: list[float]) -> list[float]:
    """Bounds, in pairs, drawn in to the limits where they go beyond."""
    out = []
    for i in range(0, len(crop), 2):
        (low, high), (least, most) = crop[i : i + 2], limits[i : i + 2]
        if low > high:
            raise ValueError(f"crop bounds {low}, {high} are the wrong way round")
        if least > most:
            raise ValueError(f"limits {least}, {most} are the wrong way round")
        if high < least or low > most:
            raise ValueError(f"crop {low}, {high} lies outside the limits {least}, {most}")
        out += [low if least < low < most else least, high if least < high < most else most]
    return out


def nearest_label(index: DataFrame, dim: str, wanted: float) -> DataFrame:
    """The label nearest to ``wanted``, the smaller of two as near."""
    return index.select(F.min_by(dim, F.struct(F.abs(F.col(dim) - wanted), F.col(dim))).alias(dim))


def surveys(**volumes: DataFrame) -> DataFrame:
    """Volumes one below the other, with their name as a dimension; missing columns are null."""
    out = None
    for name, rows in volumes.items():
        rows = rows.withColumn("survey", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out
