"""Volumes, grids, paths and header tables made of the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.traces import long_view
from .registry import table

#: Columns of the survey coordinates that the views make up: x = 1000 + 2.5 i - 0.75 j, y = 500 + 0.75 i + 2.5 j.
XY = ("x", "y")
#: Headers that are sent to all tasks at most.
BROADCAST = 1 << 20


def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as traces: the label is the inline, the place among its vectors the crossline."""
    rows = table(spark, sf_dir, "embeddings")
    # the headers alone are numbered
    places = rows.select("vec_id", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).alias("xline"))
    # numbers go to all tasks up to a checked size, so that samples stay where they are
    places = F.broadcast(places) if rows.count() <= BROADCAST else places
    return rows.join(places, "vec_id").select(F.col("vec_id").alias("tracen"), F.col("label").alias("iline"), "xline", F.col("embedding").cast("array<double>").alias("samples"))


VOLUME = """
emb AS (
  SELECT vec_id AS tracen, label AS iline, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) AS INTEGER) AS xline,
         CAST(embedding AS DOUBLE[]) AS samples
  FROM embeddings
),
lng AS (
  SELECT tracen, iline, xline, CAST(k - 1 AS INTEGER) AS k, v
  FROM (SELECT tracen, iline, xline, generate_subscripts(samples, 1) AS k, unnest(samples) AS v FROM emb)
)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_view(volume(spark, sf_dir), ["tracen", "iline", "xline"])


def block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The volume with coordinates."""
    i, j = F.col("iline"), F.col("xline")
    return volume(spark, sf_dir).withColumns({"x": 1000 + 2.5 * i - 0.75 * j, "y": 500 + 0.75 * i + 2.5 * j})


BLOCK = VOLUME + """,
blk AS (SELECT *, 1000 + 2.5e0 * iline - 0.75e0 * xline AS x, 500 + 0.75e0 * iline + 2.5e0 * xline AS y FROM emb)"""


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as cells of a sparse grid with coordinates; every fifth conversation lacks them."""
    i, j = F.col("conv_id"), F.col("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("size"))
    there = i % 5 != 0
    return rows.withColumns({"x": F.when(there, 1000 + 2.5 * i - 0.75 * j), "y": F.when(there, 500 + 0.75 * i + 2.5 * j)})


SURVEY = """
srv AS (
  SELECT conv_id, turn, CAST(length(text) AS INTEGER) AS size,
         CASE WHEN conv_id % 5 <> 0 THEN 1000 + 2.5e0 * conv_id - 0.75e0 * turn END AS x,
         CASE WHEN conv_id % 5 <> 0 THEN 500 + 0.75e0 * conv_id + 2.5e0 * turn END AS y
  FROM conversations
)"""
