"""Statistics of header tables and volumes, and least-squares fits as single aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..keys import FIELD_BYTES
from .grid import before, numbered, ranged


#: Different values whose exact percentiles one task finds.
ONE_TASK = 1_000_000


def exact_percentiles(values: DataFrame, keys: list[str], column: str, shares: list[float], most: int = ONE_TASK) -> DataFrame:
    """Percentiles (linear interpolation) of a column for each key, as an array ``p`` in the order of the shares.

    Values are counted first.  Up to ``most`` different ones of a key are merged in one task.  Otherwise the counted
    values are sorted in ranges, and the places wanted are looked up with the sums of the ranges before.
    """
    there = values.where(F.col(column).isNotNull()).select(*keys, F.col(column).cast("double").alias("_v"))
    at = F.array(*[F.lit(float(x)) for x in shares])
    different = there.groupBy(*keys).agg(F.approx_count_distinct("_v").alias("n")).agg(F.max("n")).first()[0] or 0
    if different <= most:
        return there.groupBy(*keys).agg(F.percentile("_v", at).alias("p"))
    counted = ranged(there.groupBy(*keys, "_v").agg(F.count("*").alias("_n")), [*keys, "_v"])
    sizes = before(counted.groupBy(*keys, "_range").agg(F.sum("_n").alias("_in")), keys, "_in")
    totals = sizes.groupBy(*keys).agg(F.sum("_in").alias("_all"))
    w = Window.partitionBy(*keys, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    upto = counted.withColumn("_upto", F.sum("_n").over(w)).join(F.broadcast(sizes.drop("_in")), [*keys, "_range"])
    upto = upto.join(F.broadcast(totals), keys) if keys else upto.crossJoin(F.broadcast(totals))  # a row for each key
    stop = F.col("_before") + F.col("_upto")
    here = lambda place: F.max(F.when((place < stop) & (place >= stop - F.col("_n")), F.col("_v")))
    place = [F.lit(float(x)) * (F.col("_all") - 1) for x in shares]
    ends = upto.groupBy(*keys).agg(*[here(f(x)).alias(f"{k}{i}") for i, x in enumerate(place) for k, f in (("a", F.floor), ("b", F.ceil))], F.first("_all").alias("_all"))
    between = [F.col(f"a{i}") + (x - F.floor(x)) * (F.col(f"b{i}") - F.col(f"a{i}")) for i, x in enumerate(place)]
    return ends.select(*keys, F.array(*between).alias("p"))


def header_stats(headers: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count, mean, standard deviation, minimum, quartiles and maximum of each numeric column, one row a column."""
    columns = columns or [c for c, t in headers.dtypes if t in ("int", "bigint", "smallint", "double", "float")]
    long = headers.select(*[F.col(c).cast("double") for c in columns]).unpivot([], columns, "field", "x")
    moments = long.groupBy("field").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    quartiles = exact_percentiles(long, ["field"], "x", [0.25, 0.5, 0.75])
    rows = moments.join(F.broadcast(quartiles), "field", "left")  # a row a field
    return rows.select("field", "n", "mean", "std", "min", *[F.get("p", F.lit(i)).alias(q) for i, q in enumerate(("q25", "q50", "q75"))], "max")


def varying_fields(stats: DataFrame) -> list[str]:
    """Fields that aren't the same in all traces; there are as many rows as header fields."""
    return [r["field"] for r in stats.where("std > 0").select("field").orderBy("field").collect()]


def distinct_counts(headers: DataFrame, columns: list[str]) -> DataFrame:
    """Number of different values of each column, in one row."""
    return headers.agg(*[F.countDistinct(c).alias(c) for c in columns])


def guess_geometry(headers: DataFrame, strict: bool = True) -> dict[str, int]:
    """Bytes of dimensions and coordinates, by which fields vary and whether their labels make up all traces.

    If they don't, that is an error, or an empty guess if not ``strict``.
    """
    names = [n for n in ("offset", "SourceX", "SourceY", "CDP_X", "CDP_Y", "INLINE_3D", "CROSSLINE_3D", "CDP") if n in headers.columns]
    row = headers.agg(F.count("*").alias("_n"), *[F.countDistinct(n).alias(n) for n in names]).first()
    varies = {n for n in names if row[n] > 1}
    out: dict[str, int] = {}
    cells = 1
    if "offset" in varies:
        out["offset"], cells = FIELD_BYTES["offset"], row["offset"]
    for x, y in (("SourceX", "SourceY"), ("CDP_X", "CDP_Y")):
        if {x, y} <= varies:
            out |= {"cdp_x": FIELD_BYTES[x], "cdp_y": FIELD_BYTES[y]}
            break
    if {"INLINE_3D", "CROSSLINE_3D"} <= varies:
        out |= {"iline": FIELD_BYTES["INLINE_3D"], "xline": FIELD_BYTES["CROSSLINE_3D"]}
        cells *= row["INLINE_3D"] * row["CROSSLINE_3D"]
    elif "CDP" in varies:
        out["cdp"] = FIELD_BYTES["CDP"]
        cells *= row["CDP"]
    else:
        return out  # flat: traces are told apart by their number only
    if cells != row["_n"]:
        if not strict:
            return {}
        raise ValueError(f"the guessed dimensions have {cells} cells, there are {row['_n']} traces")
    return out


def plane_columns(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Aggregates a, b, c of the least-squares plane z = a x + b y + c; null if x and y are collinear."""
    there = x.isNotNull() & y.isNotNull() & z.isNotNull()
    x, y, z = (F.when(there, v.cast("double")) for v in (x, y, z))
    xx, yy, xy = F.var_pop(x), F.var_pop(y), F.covar_pop(x, y)
    xz, yz = F.covar_pop(x, z), F.covar_pop(y, z)
    det = xx * yy - xy * xy
    a, b = F.try_divide(xz * yy - yz * xy, det), F.try_divide(yz * xx - xz * xy, det)
    return a, b, F.avg(z) - a * F.avg(x) - b * F.avg(y)


def fit_plane(rows: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """Coefficients a, b, c of z = a x + b y + c, in one row."""
    a, b, c = plane_columns(F.col(x), F.col(y), F.col(z))
    return rows.agg(a.alias("a"), b.alias("b"), c.alias("c"))


def fit_affine(cells: DataFrame, dims: tuple[str, str], xy: tuple[str, str], small: float = 1e-10) -> DataFrame:
    """Coefficients of x = a i + c j + e, y = b i + d j + f, in one row; those near 0 are 0."""
    i, j = map(F.col, dims)
    (a, c, e), (b, d, f) = (plane_columns(i, j, F.col(v)) for v in xy)
    zero = lambda v: F.when(F.abs(v) < small, 0.0).otherwise(v)
    row = cells.agg(a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"), e.alias("e"), f.alias("f"))
    return row.select(*[zero(F.col(k)).alias(k) for k in "abcdef"])


def affine_errors(cells: DataFrame, affine: DataFrame, dims: tuple[str, str], xy: tuple[str, str]) -> DataFrame:
    """Mean and maximum of the signed residuals of both coordinates, and the largest absolute one."""
    i, j = map(F.col, dims)
    t = cells.crossJoin(F.broadcast(affine))  # one row
    rx, ry = F.col("a") * i + F.col("c") * j + F.col("e") - F.col(xy[0]), F.col("b") * i + F.col("d") * j + F.col("f") - F.col(xy[1])
    r = t.select(F.explode(F.array(rx, ry)).alias("r"))
    return r.agg(F.avg("r").alias("mean_error"), F.max("r").alias("max_error"), F.max(F.abs("r")).alias("max_abs_error"))


def percentiles(values: DataFrame, column: str, shares: list[float], exact: bool = True) -> DataFrame:
    """Percentiles (linear interpolation) of a column, as rows of share and value; ``exact=False`` sketches them."""
    at = F.array(*[F.lit(float(s)) for s in shares])
    found = exact_percentiles(values, [], column, shares) if exact else values.agg(F.percentile_approx(column, at, 100_000).alias("p"))
    return found.select(F.explode(F.arrays_zip(at.alias("share"), F.col("p").alias("value"))).alias("r")).select("r.share", "r.value")


def sketched(values: DataFrame, keys: list[str], column: str, size: int = 1000) -> DataFrame:
    """A mergeable sketch of a column's values for each key, kept as bytes of bounded size; larger sizes err less."""
    there = values.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")))
    return there.groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(column).cast("double"), size).alias("sketch"))


def sketched_percentiles(sketches: DataFrame, shares: list[float], keys: list[str] | None = None) -> DataFrame:
    """Percentiles of all values that the sketches (any rows of a table of them) have seen, by other keys or altogether.

    A row for each share, with ``n`` values seen.  The rank of a percentile is off by no more than ``rank_error``
    with a confidence of 99 %; the least and the greatest value are exact.
    """
    keys = keys or []
    merged = sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("_s")).withColumn("n", F.kll_sketch_get_n_double("_s")).where("n > 0")
    at = F.array(*[F.lit(float(x)) for x in shares])
    pairs = F.explode(F.arrays_zip(at.alias("share"), F.kll_sketch_get_quantile_double("_s", at).alias("value"))).alias("r")
    return merged.select(*keys, "n", pairs).select(*keys, "n", "r.share", "r.value")


def rank_error(size: int) -> float:
    """By how much, as a share of all values, the rank of a percentile from sketches of a size may be off."""
    return 2.296 / size**0.9723


def running_percentile(per_trace: DataFrame, order: str, value: str) -> DataFrame:
    """The fold p <- (p + q) / 2 from 0 over traces in order, as a weighted sum."""
    rows = numbered(per_trace.where(F.col(value).isNotNull()), [order], "_place")
    n = rows.agg(F.count("*")).first()[0]
    return rows.agg(F.sum(F.col(value) * F.pow(F.lit(2.0), F.col("_place") - n)).alias("value"))


def histogram(values: DataFrame, column: str, bins: int = 25) -> DataFrame:
    """Counts in ``bins`` equal bins between the minimum and the maximum, which belongs to the last."""
    low, high = values.agg(F.min(column), F.max(column)).first()
    width = ((high - low) / bins) or 1.0
    k = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return values.where(F.col(column).isNotNull()).groupBy(k.alias("bin")).agg(F.count("*").alias("n"))
