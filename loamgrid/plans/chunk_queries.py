"""Functions of traces and chunks, wells, stores and header tables kept and read again."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import geometry, stats, traces
from ..operators.axes import axis_of
from ..sources import segy, tables
from ..volume import Volume
from . import views
from .file_queries import NUMBER, _file, _folder
from .registry import query, r6, table
from .volume_queries import BILINEAR, CORNERS, TRUE_AFFINE

V, B = "WITH" + views.VOLUME, "WITH" + views.BLOCK


def _smooth(a: np.ndarray) -> np.ndarray:
    """Mean over three along every axis of what is there."""
    padded = np.pad(a, 1, constant_values=np.nan)
    parts = [padded]
    for axis in range(a.ndim):
        parts = [np.take(p, range(k, k + a.shape[axis]), axis) for p in parts for k in range(3)]
    return np.nansum(parts, axis=0) / np.maximum(1, np.sum(~np.isnan(parts), axis=0))


@query(V + " SELECT a.tracen, a.k, round(avg(b.v), 6) + 0 AS v FROM lng a JOIN lng b ON b.iline BETWEEN a.iline - 1 AND a.iline + 1 AND b.xline BETWEEN a.xline - 1 AND a.xline + 1 AND b.k BETWEEN a.k - 1 AND a.k + 1 WHERE a.k % 8 = 3 GROUP BY 1, 2")
def smoothed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean over three inlines, crosslines and samples, by chunks with ghosts along all three; every eighth sample is shown."""
    v = Volume(views.volume(spark, sf_dir), ("iline", "xline")).map_chunks(_smooth, {"iline": 4, "xline": 32}, {"iline": 1, "xline": 1}, depth=(24, 1))
    return traces.long_view(v.traces, ["tracen"]).where("k % 8 = 3").select("tracen", "k", r6("v").alias("v"))


@query(V + " SELECT tracen, round(list_sum([x * x * (i - 1) FOR x, i IN samples]), 5) + 0 AS total FROM emb")
def squared_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of whole traces in pandas."""
    v = Volume(views.volume(spark, sf_dir), ("iline", "xline")).map_traces(lambda s: s.map(lambda a: np.asarray(a) ** 2))
    return v.traces.select("tracen", (F.round(traces.total(F.transform("samples", lambda x, k: x * k)), 5) + 0.0).alias("total"))


@query(V + " SELECT tracen, iline, xline, round(list_sum(samples), 6) + 0 AS total FROM emb WHERE iline BETWEEN 2 AND 6 AND xline BETWEEN 5 AND 30")
def volume_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A volume kept in the order of its chunks, read again and cropped along two dimensions."""
    path = f"{_folder(spark)}/chunked"
    Volume(views.volume(spark, sf_dir), ("iline", "xline")).save(path, chunks={"iline": 2, "xline": 8})
    rows = Volume.load(spark, path).crop(iline=(2, 6), xline=(5, 30)).traces
    return rows.select("tracen", "iline", "xline", r6(traces.total(F.col("samples"))).alias("total"))


@query(B + " SELECT iline, xline, round(list_sum(samples), 5) + 0 AS total FROM blk WHERE iline IN (3, 4) AND xline >= 10")
def segy_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crop of a file whose header index tells which blocks of traces to read."""
    path = _file(spark, sf_dir)
    segy.write_index(spark, path, f"{path}.index", block=16)
    v = Volume.open_segy(spark, path, {"iline": 189, "xline": 193}, index=f"{path}.index").crop(iline=(3, 4), xline=(10, 10**6))
    return v.traces.select("iline", "xline", (F.round(traces.total(F.col("samples")), 5) + 0.0).alias("total"))


@query(B + f" SELECT {NUMBER} AS tracen, round(list_sum([CASE WHEN i BETWEEN 11 AND 20 THEN 2 * x ELSE x END FOR x, i IN samples]), 5) + 0 AS total FROM blk")
def segy_samples_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten samples of every trace of a file, doubled and written back into their place."""
    path = _file(spark, sf_dir)
    cut = segy.read_traces(spark, path, first=10, last=19)
    segy.write_samples(cut.withColumn("samples", F.transform("samples", lambda v: v * 2)), path, 10, block=100)
    return segy.read_traces(spark, path).select("tracen", (F.round(traces.total(F.col("samples")), 5) + 0.0).alias("total"))


SHARES = [0.0, 0.1, 0.5, 0.9, 1.0]


@query(V + ", c AS (SELECT v FROM lng WHERE iline BETWEEN 2 AND 5)" + " UNION ALL ".join(f" SELECT CAST({x} AS DOUBLE) AS share, (SELECT count(*) FROM c) AS n, true AS near" for x in SHARES))
def sketched_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of a crop from sketches of each inline, and whether their exact ranks are as near as promised."""
    rows = views.samples(spark, sf_dir)
    found = stats.sketched_percentiles(stats.sketched(rows, ["iline"], "v").where("iline BETWEEN 2 AND 5"), SHARES)
    # the shares are a few rows
    ranks = rows.where("iline BETWEEN 2 AND 5").join(F.broadcast(found), F.lit(True)).groupBy("share", "n").agg(F.avg((F.col("v") < F.col("value")).cast("int")).alias("low"), F.avg((F.col("v") <= F.col("value")).cast("int")).alias("high"))
    off = F.greatest(F.col("low") - F.col("share"), F.col("share") - F.col("high"), F.lit(0.0))
    return ranks.select("share", "n", (off <= 2 * stats.rank_error(1000)).alias("near"))


WELL = """, pt AS (SELECT c_custkey AS point, round((c_custkey % 83) * 0.1e0, 9) AS p, round((c_custkey % 17) * 1.3e0, 9) AS q, (c_custkey % 59) * 4.1e0 AS z FROM customer),
ax AS (SELECT min(iline) AS i0, max(iline) AS i1, min(xline) AS j0, max(xline) AS j1 FROM blk),
ins AS (SELECT point, p, q, p >= 0 AND p <= i1 - i0 AND q >= 0 AND q <= j1 - j0 AS inside FROM pt, ax)"""


@query(B + WELL + BILINEAR + """ SELECT pt.point, round(a.v * (1 - (z / 4 - floor(z / 4))) + b.v * (z / 4 - floor(z / 4)), 6) + 0 AS value
FROM pt LEFT JOIN lin a ON a.point = pt.point AND a.k = floor(z / 4) LEFT JOIN lin b ON b.point = pt.point AND b.k = floor(z / 4) + 1""")  # fmt: skip
def well_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trilinear values at customers as points of wells."""
    rows = views.block(spark, sf_dir)
    n = F.col("c_custkey")
    x, y = TRUE_AFFINE.forward((n % 83) * 0.1, (n % 17) * 1.3 + 1)
    path = table(spark, sf_dir, "customer").select(n.alias("point"), x.alias("x"), y.alias("y"), ((n % 59) * 4.1).alias("z"))
    found = geometry.well_values(rows, path, geometry.affine_of(rows, xy=views.XY), (axis_of(rows, "iline"), axis_of(rows, "xline")), 0.0, 4.0)
    return found.select("point", r6("value").alias("value"))


@query(B + CORNERS + " SELECT r.corner, b.x, b.y FROM ring r LEFT JOIN blk b ON b.iline = r.iline AND b.xline = r.xline")
def plot_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The polygon around the block."""
    return geometry.plot_bounds(geometry.corner_points(views.block(spark, sf_dir), xy=views.XY), views.XY)


@query("SELECT doc_id, lang || ' ' || source || ' ' AS fixed FROM documents")
def text_fix_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NUL characters in text headers become spaces."""
    nul = F.lit("\x00")
    return table(spark, sf_dir, "documents").select("doc_id", text.fix_nulls(F.concat("lang", nul, "source", nul)).alias("fixed"))


@query(V + " SELECT iline, count(*) AS n, min(tracen) AS low, max(tracen) AS high FROM emb WHERE tracen BETWEEN 20 AND 220 GROUP BY 1")
def dims_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trace number as the only dimension, and a crop along it."""
    v = Volume(views.volume(spark, sf_dir), ("iline", "xline")).set_dims("tracen").crop(tracen=(20, 220))
    return v.traces.groupBy("iline").agg(F.count("*").alias("n"), F.min("tracen").alias("low"), F.max("tracen").alias("high"))


@query(B + " SELECT iline AS INLINE_3D, xline AS CROSSLINE_3D, CAST(round(x * 100) AS INTEGER) AS CDP_X FROM blk")
def headers_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header fields of a file written as CSV and read again."""
    path, names = _file(spark, sf_dir), ["INLINE_3D", "CROSSLINE_3D", "CDP_X"]
    tables.write_headers(segy.read_headers(spark, path, names=names).select(*names), f"{path}.csv")
    return spark.read.option("header", True).schema("INLINE_3D int, CROSSLINE_3D int, CDP_X int").csv(f"{path}.csv")
