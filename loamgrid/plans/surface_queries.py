"""Scattered points, uneven axes and splines across traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import geometry, splines, traces
from ..operators.axes import axis_of
from . import views
from .registry import query, r6, table

V, B = "WITH" + views.VOLUME, "WITH" + views.BLOCK

#: Customers as points that are scattered over three times the width and height of the block.
SCATTERED = """, ext AS (SELECT min(x) AS x0, max(x) - min(x) AS w, min(y) AS y0, max(y) - min(y) AS h FROM blk),
sc AS (SELECT c_custkey AS id, x0 - w + 3 * w * (c_custkey * 0.6180339887e0 - floor(c_custkey * 0.6180339887e0)) AS x, y0 - h + 3 * h * (c_acctbal * 0.7548776662e0 - floor(c_acctbal * 0.7548776662e0)) AS y FROM customer, ext)"""


def _scattered(spark: SparkSession, sf_dir: str, block: DataFrame) -> DataFrame:
    ext = block.agg(F.min("x").alias("x0"), (F.max("x") - F.min("x")).alias("w"), F.min("y").alias("y0"), (F.max("y") - F.min("y")).alias("h"))
    part = lambda c, f: F.col(c) * f - F.floor(F.col(c) * f)
    rows = table(spark, sf_dir, "customer").crossJoin(F.broadcast(ext))  # one row
    x, y = F.col("x0") - F.col("w") + 3 * F.col("w") * part("c_custkey", 0.6180339887), F.col("y0") - F.col("h") + 3 * F.col("h") * part("c_acctbal", 0.7548776662)
    return rows.select(F.col("c_custkey").alias("id"), x.alias("x"), y.alias("y"))


@query(B + " SELECT tracen, round(2 * x - y, 5) + 0 AS z FROM blk")
def surface_from_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plane through scattered points at the cells of the block, which their hull holds, by Delaunay triangles."""
    rows = views.block(spark, sf_dir).drop("samples")
    points = _scattered(spark, sf_dir, rows).withColumn("z", 2 * F.col("x") - F.col("y"))
    return geometry.surface_from_points(rows, points, "z", views.XY).select("tracen", (F.round("z", 5) + 0.0).alias("z"))


@query(B + SCATTERED + " SELECT tracen, (SELECT arg_min(id, (s.x - b.x) * (s.x - b.x) + (s.y - b.y) * (s.y - b.y)) FROM sc AS s) AS id FROM blk AS b")
def surface_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer nearest to each cell of the block."""
    rows = views.block(spark, sf_dir).drop("samples")
    found = geometry.surface_from_points(rows, _scattered(spark, sf_dir, rows), "id", views.XY, "nearest")
    return found.select("tracen", F.col("id").cast("long").alias("id"))


@query(B + " SELECT tracen, CAST(iline AS DOUBLE) AS i, CAST(xline AS DOUBLE) AS j FROM blk")
def labels_from_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of every trace by its coordinates, of a survey that is bent so that no affine transform describes it."""
    rows = views.block(spark, sf_dir).drop("samples").withColumn("x", F.col("x") + F.pow(F.col("xline"), 2) * 0.01).withColumn("y", F.col("y") + F.sin(F.col("iline")) * 0.3)
    found = geometry.labels_at(rows.select("tracen", "x", "y"), rows, xy=views.XY)
    return found.select("tracen", r6("_i").alias("i"), r6("_j").alias("j"))


UNEVEN = """, un AS (SELECT tracen, iline * iline + iline AS il, xline * xline AS xl, list_sum(samples) AS total FROM emb),
ai AS (SELECT CAST(l AS DOUBLE) AS a, CAST(lead(l) OVER (ORDER BY l) AS DOUBLE) AS b FROM (SELECT DISTINCT il AS l FROM un)),
aj AS (SELECT CAST(l AS DOUBLE) AS a, CAST(lead(l) OVER (ORDER BY l) AS DOUBLE) AS b FROM (SELECT DISTINCT xl AS l FROM un)),
pt AS (SELECT c_custkey AS point, round((c_custkey % 101) * 0.91e0 - 0.5e0, 9) AS p, round((c_acctbal * 0.7548776662e0 - floor(c_acctbal * 0.7548776662e0)) * m * 1.02e0, 9) AS q FROM customer, (SELECT max(xl) AS m FROM un)),
br AS (SELECT point, p, q, ai.a AS ia, coalesce(ai.b, ai.a) AS ib, aj.a AS ja, coalesce(aj.b, aj.a) AS jb FROM pt ASOF JOIN ai ON pt.p >= ai.a ASOF JOIN aj ON pt.q >= aj.a
       WHERE (ai.b IS NOT NULL OR p = ai.a) AND (aj.b IS NOT NULL OR q = aj.a)),
sh AS (SELECT *, CASE WHEN p = ia THEN 0 ELSE (p - ia) / (ib - ia) END AS t, CASE WHEN q = ja THEN 0 ELSE (q - ja) / (jb - ja) END AS u FROM br)"""


def _uneven(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The volume with uneven labels, and customers as points between them."""
    i, j = F.col("iline"), F.col("xline")
    rows = views.volume(spark, sf_dir).withColumns({"iline": i * i + i, "xline": j * j})
    most = rows.agg(F.max("xline").alias("m"))
    part = F.col("c_acctbal") * 0.7548776662
    points = table(spark, sf_dir, "customer").crossJoin(F.broadcast(most))  # one row
    return rows, points.select(F.col("c_custkey").alias("point"), ((F.col("c_custkey") % 101) * 0.91 - 0.5).alias("i"), ((part - F.floor(part)) * F.col("m") * 1.02).alias("j"))


@query(V + UNEVEN + """, cor AS (SELECT point, CASE di WHEN 1 THEN ib ELSE ia END AS i, CASE dj WHEN 1 THEN jb ELSE ja END AS j, CASE di WHEN 1 THEN t ELSE 1 - t END * CASE dj WHEN 1 THEN u ELSE 1 - u END AS w FROM sh, (SELECT * FROM range(2) a(di), range(2) b(dj))),
nd AS (SELECT *, count(*) OVER (PARTITION BY point) AS need FROM cor WHERE w > 0),
lin AS (SELECT nd.point, sum(total * w) AS total FROM nd JOIN un ON un.il = nd.i AND un.xl = nd.j GROUP BY nd.point HAVING count(*) = max(need))
SELECT pt.point, round(lin.total, 6) + 0 AS total FROM pt LEFT JOIN lin ON lin.point = pt.point""")  # fmt: skip
def uneven_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bilinear mean of traces at points between labels that aren't evenly spaced."""
    rows, points = _uneven(spark, sf_dir)
    at = geometry.select_labels(rows, points, (axis_of(rows, "iline"), axis_of(rows, "xline")), ("i", "j"))
    return at.select("point", r6(F.when(F.col("samples").isNotNull(), traces.total(F.col("samples")))).alias("total"))


@query(V + UNEVEN + " SELECT pt.point, un.tracen FROM pt LEFT JOIN sh ON sh.point = pt.point LEFT JOIN un ON un.il = CASE WHEN t <= 0.5 THEN ia ELSE ib END AND un.xl = CASE WHEN u <= 0.5 THEN ja ELSE jb END")
def uneven_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trace nearest to points between labels that aren't evenly spaced."""
    rows, points = _uneven(spark, sf_dir)
    axes = axis_of(rows, "iline"), axis_of(rows, "xline")
    return geometry.select_labels(rows, points, axes, ("i", "j"), method="nearest", carry=("tracen",)).select("point", "tracen")


CUBIC = """, co AS (SELECT iline, avg(samples[1]) AS a, avg(samples[2]) AS b, avg(samples[3]) AS c, avg(samples[4]) AS d, max(xline) AS last FROM emb GROUP BY 1),
mid AS (SELECT DISTINCT xline + 0.5e0 AS x FROM emb)"""


@query(V + CUBIC + " SELECT iline, x AS xline, round(a + b * (x / 50) + c * pow(x / 50, 2) + d * pow(x / 50, 3), 6) + 0 AS v FROM co JOIN mid ON x < last")
def cubic_across_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splines along crosslines through values that are cubic in them, half-way between them."""
    rows = views.volume(spark, sf_dir)
    terms = rows.groupBy("iline").agg(*[F.avg(F.get("samples", F.lit(k))).alias(n) for k, n in enumerate("abcd")])
    u = F.col("xline") / 50
    made = rows.select("iline", "xline").join(terms, "iline")
    made = made.select("iline", "xline", F.array(F.col("a") + F.col("b") * u + F.col("c") * F.pow(u, 2) + F.col("d") * F.pow(u, 3)).alias("samples"))
    found = splines.along(made, "xline", rows.select((F.col("xline") + 0.5).alias("xline")).distinct(), ("iline",))
    return found.select("iline", "xline", r6(F.get("samples", 0)).alias("v"))
