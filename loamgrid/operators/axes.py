"""Axes of labels, even or not, and the labels that a value lies between."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import written
from .grid import range_bounds, ranged_by

#: Digits that fractional positions and labels are rounded to before they are floored or compared.
DIGITS = 9
#: Values that are merged with the labels of a range in one task, about.
PIECE = 1_000_000


@dataclass(frozen=True)
class Axis:
    """A regular axis: labels first, first + step, ... up to n of them."""

    first: float
    step: float
    n: int

    def place(self, label: Column) -> Column:
        return F.round((label - self.first) / self.step, DIGITS)

    def key(self, label: Column) -> Column:
        """What a label is known by: its place."""
        return F.round((label - self.first) / self.step).cast("long")

    def between(self, rows: DataFrame, value: str, name: str) -> DataFrame:
        """Rows with a struct: keys a and b of the labels around a value, and the share t of the way from a to b; null outside."""
        p = self.place(F.col(value))
        a = F.floor(p)
        found = F.struct(a.alias("a"), (a + 1).alias("b"), (p - a).alias("t"))
        return rows.withColumn(name, F.when((p >= 0) & (p <= self.n - 1), found))


@dataclass(frozen=True)
class Uneven:
    """Any labels, a row each in a column ``label``."""

    labels: DataFrame

    def key(self, label: Column) -> Column:
        return label.cast("double")

    def between(self, rows: DataFrame, value: str, name: str) -> DataFrame:
        """As for a regular axis; keys are the labels themselves.

        Labels and values are dealt into the same ranges and merged in order there; a range of many values is dealt to
        several tasks, each with all labels of the range.
        """
        bounds = range_bounds(self.labels, ["label"])
        if not bounds:
            return rows.withColumn(name, F.lit(None).cast("struct<a: double, b: double, t: double>"))
        at = F.round(F.col(value).cast("double"), DIGITS)
        asked = rows.select(at.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v")).distinct()
        asked = ranged_by(asked, F.struct(F.col("v").alias("label")), bounds, ["_n"]).where("_range > 0").select("_range", "v")
        asked = written(asked)
        pieces = written(asked.groupBy("_range").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces")))
        labels = ranged_by(self.labels, F.struct("label"), bounds, ["_n"])
        after = F.lead("label").over(Window.partitionBy("_range").orderBy("label"))
        after = F.coalesce(after, F.try_element_at("_ranges", F.col("_range") + 1)["_from"]["label"])
        labels = labels.withColumn("_next", after).drop("_ranges").join(pieces, "_range")
        labels = labels.select("_range", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.col("label").alias("v"), F.struct(F.col("label").alias("a"), F.col("_next").alias("b")).alias("ends"))
        piece = F.pmod(F.xxhash64("v"), F.col("pieces")).cast("int").alias("piece")
        values = asked.join(pieces, "_range").select("_range", piece, "v", F.lit(None).cast(labels.schema["ends"].dataType).alias("ends"))
        # a label comes before the values that are equal to it
        order = Window.partitionBy("_range", "piece").orderBy("v", F.col("ends").isNull()).rowsBetween(Window.unboundedPreceding, 0)
        merged = labels.unionByName(values).select("v", F.col("ends").isNull().alias("asked"), F.last("ends", ignorenulls=True).over(order).alias("ends")).where("asked")
        low, high = F.col("ends.a"), F.col("ends.b")
        t = F.when(F.col("v") == low, 0.0).otherwise((F.col("v") - low) / (high - low))
        found = merged.where((F.col("v") == low) | high.isNotNull()).select(F.col("v").alias("_v"), F.struct(low.alias("a"), F.coalesce(high, low).alias("b"), t.alias("t")).alias(name))
        return rows.withColumn("_v", at).join(found, "_v", "left").drop("_v")


AnyAxis = Axis | Uneven


def axis_of(traces: DataFrame, dim: str) -> AnyAxis:
    """The axis of a dimension: regular if its labels are evenly spaced."""
    row = traces.agg(F.min(dim).alias("a"), F.max(dim).alias("b"), F.countDistinct(dim).alias("n")).first()
    if not row["n"]:
        return Axis(0.0, 1.0, 0)
    step = (row["b"] - row["a"]) / (row["n"] - 1) if row["n"] > 1 else 1.0
    odd = traces.where(F.abs((F.col(dim) - row["a"]) / F.lit(step) - F.round((F.col(dim) - row["a"]) / F.lit(step))) > 1e-6)
    if odd.isEmpty():
        return Axis(float(row["a"]), float(step), int(row["n"]))
    return Uneven(written(traces.select(F.col(dim).cast("double").alias("label")).where("label IS NOT NULL").distinct()))
