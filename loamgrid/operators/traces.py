"""Operations along the samples of traces, as expressions on the array column: nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def axis(ns0: float, dt: float, n: Column | int) -> Column:
    """Labels of the vertical axis: ns0, ns0 + dt, ..."""
    count = F.lit(n) if isinstance(n, int) else n
    return F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.lit(float(ns0)) + k * F.lit(float(dt)))


def long_view(traces: DataFrame, keep: list[str], ns0: float = 0.0, dt: float = 1.0, samples: str = "samples") -> DataFrame:
    """A row a sample: the kept columns, its place k, its label z and its value v."""
    rows = traces.select(*keep, F.posexplode(samples).alias("k", "v"))
    return rows.select(*keep, "k", (F.lit(float(ns0)) + F.col("k") * F.lit(float(dt))).alias("z"), "v")


def regrid(long: DataFrame, dims: list[str], value: str = "v", extras: list[str] | None = None) -> DataFrame:
    """Traces again from a row a sample; extra columns become their mean."""
    packed = F.transform(F.array_sort(F.collect_list(F.struct("k", value))), lambda x: x[value]).alias("samples")
    return long.groupBy(*dims).agg(packed, *[F.avg(c).alias(c) for c in extras or []])


def total(samples: Column) -> Column:
    """Sum of the samples; null ones are skipped."""
    return F.aggregate(samples, F.lit(0.0), lambda s, v: s + F.coalesce(v.cast("double"), F.lit(0.0)))


def sum_abs(samples: Column) -> Column:
    return F.aggregate(samples, F.lit(0.0), lambda s, v: s + F.coalesce(F.abs(v).cast("double"), F.lit(0.0)))


def rms(samples: Column) -> Column:
    """Root mean square of the samples that are there."""
    n = F.aggregate(samples, F.lit(0), lambda s, v: s + v.isNotNull().cast("int"))
    squares = F.aggregate(samples, F.lit(0.0), lambda s, v: s + F.coalesce(v.cast("double") * v.cast("double"), F.lit(0.0)))
    return F.sqrt(F.try_divide(squares, n))


def crop_z(samples: Column, first: int, last: int) -> Column:
    """Samples first to last, both included; a last one beyond the trace is drawn in."""
    return F.slice(samples, first + 1, last - first + 1)


def at_nearest(samples: Column, z: Column | float, ns0: float, dt: float) -> Column:
    """The sample whose label is nearest to z, the earlier of two as near; null beyond half a step outside."""
    p = (z if isinstance(z, Column) else F.lit(float(z))) - F.lit(float(ns0))
    k = F.ceil(p / F.lit(float(dt)) - 0.5).cast("int")
    return F.when((k >= 0) & (k < F.size(samples)), F.get(samples, k))


def at_linear(samples: Column, z: Column, ns0: float, dt: float) -> Column:
    """The samples' linear interpolation at z; null outside the axis or where z is null."""
    p = (z - F.lit(float(ns0))) / F.lit(float(dt))
    k = F.floor(p).cast("int")
    t = p - k
    low, high = F.get(samples, k).cast("double"), F.get(samples, k + 1).cast("double")
    return F.when((p >= 0) & (p <= F.size(samples) - 1), F.when(t == 0, low).otherwise(low * (1 - t) + high * t))


def window_sum(samples: Column, low: Column, high: Column, ns0: float, dt: float) -> Column:
    """Sum of the samples whose label lies strictly between low and high; 0 if there are none."""
    z = lambda k: F.lit(float(ns0)) + k * F.lit(float(dt))
    return F.coalesce(total(F.transform(samples, lambda v, k: F.when((z(k) > low) & (z(k) < high), v))), F.lit(0.0))


def masked(samples: Column, keep) -> Column:
    """Samples where ``keep(value, place)`` holds, null elsewhere."""
    return F.transform(samples, lambda v, k: F.when(keep(v, k), v))


def linear_gain(samples: Column, ns0: float, dt: float, gain: float) -> Column:
    """Each sample times its label and ``gain``."""
    return F.transform(samples, lambda v, k: v.cast("double") * (F.lit(float(ns0)) + k * F.lit(float(dt))) * F.lit(float(gain)))


def standardised(traces: DataFrame, factor: float = 10.0, samples: str = "samples") -> DataFrame:
    """Samples less the volume's mean, over its standard deviation (of the population), times ``factor``."""
    sums = traces.select(F.explode(samples).alias("v")).agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).first()
    mean, std = F.lit(sums["m"]), F.lit(sums["s"])
    return traces.withColumn(samples, F.transform(samples, lambda v: F.try_divide(v - mean, std) * F.lit(float(factor))))


def stacked(long: DataFrame, dims: list[str]) -> DataFrame:
    """Mean of each sample over all other dimensions; null samples are skipped."""
    return long.groupBy(*dims, "k").agg(F.avg("v").alias("v"))


def running_sum(long: DataFrame, trace: list[str], value: Column, name: str = "cumulative") -> DataFrame:
    """Sum of ``value`` down each trace, up to and including each sample."""
    w = Window.partitionBy(*trace).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return long.withColumn(name, F.sum(value).over(w))


def depth_to_time(long: DataFrame, trace: list[str], velocity: str, step: float = 20.0) -> DataFrame:
    """Two-way time in ms down each trace, from velocities on a depth axis with the given step."""
    return running_sum(long, trace, F.lit(2000.0 * step) / F.col(velocity), "twt")


def halfsampled(values: Column) -> Column:
    """The values with the midpoint between each two neighbours: 2 n - 1 of them."""
    finer = lambda a: F.flatten(F.transform(a, lambda v, k: F.when(k + 1 < F.size(a), F.array(v.cast("double"), (v + F.get(a, k + 1)) / 2)).otherwise(F.array(v.cast("double")))))
    # as a lambda's variable the values are made once, and not for each of them
    return F.get(F.transform(F.array(values), finer), F.lit(0))


def resampled(samples: Column, at: Column, ns0: float, dt: float) -> Column:
    """The trace at other labels, linearly interpolated (time to depth, for one)."""
    return F.transform(at, lambda z: at_linear(samples, z, ns0, dt))


def subsampled(values: Column, times: int = 1) -> Column:
    """The values with midpoints added ``times`` times over."""
    for _ in range(times):
        values = halfsampled(values)
    return values
