"""Volumes: operations along and across traces, geometry and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import geometry, grid, stats, traces
from . import views
from .registry import query, r6, table

V, B, S = "WITH" + views.VOLUME, "WITH" + views.BLOCK, "WITH" + views.SURVEY
TRUE_AFFINE = geometry.Affine(2.5, 0.75, -0.75, 2.5, 1000.0, 500.0)


@query(V + " SELECT tracen, iline, xline, k, v FROM lng")
def long_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.samples(spark, sf_dir).select("tracen", "iline", "xline", "k", "v")


@query(V + " SELECT tracen, CAST(count(*) AS INTEGER) AS n, round(sum(v * (k + 1)), 6) + 0 AS checksum FROM lng GROUP BY 1")
def regrid_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a sample and back: the places of samples enter the checksum."""
    back = traces.regrid(views.samples(spark, sf_dir), ["tracen"])
    weighed = F.transform("samples", lambda v, k: v * (k + 1))
    return back.select("tracen", F.size("samples").alias("n"), r6(traces.total(weighed)).alias("checksum"))


@query(V + " SELECT tracen, CAST(len(samples[11:21]) AS INTEGER) AS n, round(list_sum(samples[11:21]), 6) + 0 AS total FROM emb")
def crop_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = traces.crop_z(F.col("samples"), 10, 20)
    return views.volume(spark, sf_dir).select("tracen", F.size(cut).alias("n"), r6(traces.total(cut)).alias("total"))


@query(V + " SELECT tracen, samples[27] AS v FROM emb")
def sel_nearest_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample nearest to 105.1 ms on an axis from 0 in steps of 4."""
    return views.volume(spark, sf_dir).select("tracen", traces.at_nearest(F.col("samples"), 105.1, 0.0, 4.0).alias("v"))


@query(V + " SELECT tracen, samples[len(samples)] AS v FROM emb")
def isel_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.volume(spark, sf_dir).select("tracen", F.try_element_at("samples", F.lit(-1)).alias("v"))


@query(V + " SELECT iline, k, round(avg(CASE WHEN k > xline * 0.6 + 3 THEN v END), 6) + 0 AS v FROM lng GROUP BY 1, 2")
def mask_mute_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over crosslines after a mute that widens with them; muted samples don't count."""
    muted = views.volume(spark, sf_dir).withColumn("samples", traces.masked(F.col("samples"), lambda v, k: k > F.col("xline") * 0.6 + 3))
    stack = traces.stacked(traces.long_view(muted, ["iline"]), ["iline"])
    return stack.select("iline", "k", r6("v").alias("v"))


DEAD = "(CASE WHEN tracen % 3 = 0 THEN [CAST(0 AS DOUBLE) FOR x IN samples] ELSE samples END)"


@query(V + f" SELECT iline, xline, list_sum([abs(x) FOR x IN {DEAD}]) = 0 AS dead FROM emb")
def dead_trace_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third trace is made dead first."""
    rows = views.volume(spark, sf_dir).withColumn("samples", F.when(F.col("tracen") % 3 == 0, F.transform("samples", lambda v: F.lit(0.0))).otherwise(F.col("samples")))
    return rows.select("iline", "xline", grid.dead(F.col("samples"), zeros=True).alias("dead"))


@query(V + " SELECT iline, xline, tracen % 4 = 0 AS dead FROM emb")
def dead_trace_map_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dead by samples 0, 20 and 40 only."""
    rows = views.volume(spark, sf_dir).withColumn("samples", traces.masked(F.col("samples"), lambda v, k: (F.col("tracen") % 4 != 0) | (k == 5)))
    return rows.select("iline", "xline", grid.dead(F.col("samples"), scan=[0, 20, 40]).alias("dead"))


@query(V + " SELECT tracen, round(list_sum([abs(x) FOR x IN samples]), 6) + 0 AS total FROM emb")
def trace_sum_abs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.volume(spark, sf_dir).select("tracen", r6(traces.sum_abs(F.col("samples"))).alias("total"))


@query(V + " SELECT tracen, round(sqrt(list_sum([x * x FOR x IN samples]) / len(samples)), 6) + 0 AS rms FROM emb")
def trace_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.volume(spark, sf_dir).select("tracen", r6(traces.rms(F.col("samples"))).alias("rms"))


@query(V + " SELECT round(avg(v), 6) + 0 AS mean, round(stddev_pop(v), 6) + 0 AS std, max(v) AS top, min(v) AS low FROM lng")
def volume_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.samples(spark, sf_dir).agg(r6(F.avg("v")).alias("mean"), r6(F.stddev_pop("v")).alias("std"), F.max("v").alias("top"), F.min("v").alias("low"))


@query(V + " SELECT iline, k, round(avg(v), 6) + 0 AS v FROM lng GROUP BY 1, 2")
def axis_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    stack = traces.stacked(views.samples(spark, sf_dir), ["iline"])
    return stack.select("iline", "k", r6("v").alias("v"))


SHARES = [0.0, 0.001, 0.1, 0.5, 0.9, 0.999, 1.0]


@query(V + " " + " UNION ALL ".join(f"SELECT CAST({s} AS DOUBLE) AS share, round(quantile_cont(v, {s}), 6) + 0 AS value FROM lng" for s in SHARES))
def volume_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.percentiles(views.samples(spark, sf_dir), "v", SHARES)
    return found.select("share", r6("value").alias("value"))


@query(V + ", q AS (SELECT tracen, quantile_cont(v, 0.9) AS q FROM lng GROUP BY 1) SELECT round(sum(q * pow(2, -back)), 6) + 0 AS value FROM (SELECT q, row_number() OVER (ORDER BY tracen DESC) AS back FROM q)")
def running_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_trace = views.samples(spark, sf_dir).groupBy("tracen").agg(F.percentile("v", F.lit(0.9)).alias("q"))
    return stats.running_percentile(per_trace, "tracen", "q").select(r6("value").alias("value"))


@query(V + ", s AS (SELECT avg(v) AS m, stddev_pop(v) AS d FROM lng) SELECT tracen, k, round((v - m) / d * 10, 6) + 0 AS v FROM lng, s")
def standardise_x10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = traces.standardised(views.volume(spark, sf_dir))
    return traces.long_view(rows, ["tracen"]).select("tracen", "k", r6("v").alias("v"))


@query(V + " SELECT tracen, k, round(v * (100 + 4 * k) * 0.5, 6) + 0 AS v FROM lng")
def linear_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.volume(spark, sf_dir).withColumn("samples", traces.linear_gain(F.col("samples"), 100.0, 4.0, 0.5))
    return traces.long_view(rows, ["tracen"]).select("tracen", "k", r6("v").alias("v"))


@query(V + " SELECT tracen, k, round(sum(2000.0 * 20 / (abs(v) + 0.1)) OVER (PARTITION BY tracen ORDER BY k), 3) + 0 AS twt FROM lng")
def cumsum_depth_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.samples(spark, sf_dir).withColumn("speed", F.abs("v") + 0.1)
    return traces.depth_to_time(rows, ["tracen"], "speed").select("tracen", "k", (F.round("twt", 3) + 0.0).alias("twt"))


@query(V + " SELECT tracen, CAST(j AS INTEGER) AS k, round(samples[j * 2 + 1] * 0.5 + samples[j * 2 + 2] * 0.5, 6) + 0 AS v FROM emb, range(31) t(j)")
def resample_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces at every other midpoint of their samples."""
    at = F.transform(F.sequence(F.lit(0), F.lit(30)), lambda j: (j * 2 + 0.5) * 4.0)
    rows = views.volume(spark, sf_dir).withColumn("samples", traces.resampled(F.col("samples"), at, 0.0, 4.0))
    return traces.long_view(rows, ["tracen"]).select("tracen", "k", r6("v").alias("v"))


@query(V + " SELECT iline, xline, k, round(avg(v), 6) + 0 AS v FROM (SELECT iline, xline, k, v FROM lng WHERE tracen % 2 = 0 UNION ALL SELECT iline, xline, k, 2 * v FROM lng WHERE tracen % 3 = 0) GROUP BY ALL")
def concat_surveys_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two surveys that overlap, and the mean where they do."""
    rows = views.samples(spark, sf_dir)
    both = grid.surveys(first=rows.where("tracen % 2 = 0"), second=rows.where("tracen % 3 = 0").withColumn("v", F.col("v") * 2))
    return traces.stacked(both, ["iline", "xline"]).select("iline", "xline", "k", r6("v").alias("v"))


@query(V + " SELECT tracen, round(abs(sin(list_sum(samples))) + cos(samples[1]), 6) + 0 AS v FROM emb")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("samples")
    return views.volume(spark, sf_dir).select("tracen", r6(F.abs(F.sin(traces.total(x))) + F.cos(F.get(x, 0))).alias("v"))


@query(V + " SELECT tracen, k, 100 + 4.0e0 * k AS z FROM lng")
def sample_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of every trace's samples."""
    return views.volume(spark, sf_dir).select("tracen", F.posexplode(traces.axis(100.0, 4.0, F.size("samples"))).alias("k", "z"))


# ---------------------------------------------------------------- geometry
PLANE = """, m AS (SELECT avg(i) AS mi, avg(j) AS mj, avg(z) AS mz, var_pop(i) AS ii, var_pop(j) AS jj, covar_pop(i, j) AS ij, covar_pop(i, z) AS iz, covar_pop(j, z) AS jz FROM pts),
fit AS (SELECT (iz * jj - jz * ij) / (ii * jj - ij * ij) AS a, (jz * ii - iz * ij) / (ii * jj - ij * ij) AS b, mz, mi, mj FROM m)"""


@query(S + ", pts AS (SELECT CAST(conv_id AS DOUBLE) AS i, CAST(turn AS DOUBLE) AS j, CAST(size AS DOUBLE) AS z FROM srv)" + PLANE + " SELECT round(a, 6) + 0 AS a, round(b, 6) + 0 AS b, round(mz - a * mi - b * mj, 6) + 0 AS c FROM fit")
def plane_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.fit_plane(views.survey(spark, sf_dir), "conv_id", "turn", "size")
    return found.select(*[r6(k).alias(k) for k in "abc"])


AFFINE = """, p AS (SELECT CAST(conv_id AS DOUBLE) AS i, CAST(turn AS DOUBLE) AS j, x + size % 7 AS x, y - size % 5 AS y FROM srv WHERE x IS NOT NULL),
m AS (SELECT avg(i) AS mi, avg(j) AS mj, avg(x) AS mx, avg(y) AS my, var_pop(i) AS ii, var_pop(j) AS jj, covar_pop(i, j) AS ij,
             covar_pop(i, x) AS ix, covar_pop(j, x) AS jx, covar_pop(i, y) AS iy, covar_pop(j, y) AS jy FROM p),
t AS (SELECT (ix * jj - jx * ij) / d AS a, (iy * jj - jy * ij) / d AS b, (jx * ii - ix * ij) / d AS c, (jy * ii - iy * ij) / d AS d, mi, mj, mx, my
      FROM (SELECT *, ii * jj - ij * ij AS d FROM m)),
aff AS (SELECT a, b, c, d, mx - a * mi - c * mj AS e, my - b * mi - d * mj AS f FROM t)"""


def _noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.survey(spark, sf_dir).where("x IS NOT NULL").withColumns({"x": F.col("x") + F.col("size") % 7, "y": F.col("y") - F.col("size") % 5})


@query(S + AFFINE + " SELECT round(a, 6) + 0 AS a, round(b, 6) + 0 AS b, round(c, 6) + 0 AS c, round(d, 6) + 0 AS d, round(e, 6) + 0 AS e, round(f, 6) + 0 AS f FROM aff")
def affine_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.fit_affine(_noisy(spark, sf_dir), ("conv_id", "turn"), views.XY)
    return found.select(*[r6(k).alias(k) for k in "abcdef"])


@query(S + AFFINE + ", r AS (SELECT a * i + c * j + e - x AS r FROM p, aff UNION ALL SELECT b * i + d * j + f - y FROM p, aff) SELECT round(avg(r), 6) + 0 AS mean_error, round(max(r), 6) + 0 AS max_error, round(max(abs(r)), 6) + 0 AS max_abs_error FROM r")
def affine_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, dims = _noisy(spark, sf_dir), ("conv_id", "turn")
    found = stats.affine_errors(rows, stats.fit_affine(rows, dims, views.XY), dims, views.XY)
    return found.select(*[r6(c).alias(c) for c in found.columns])


@query(S + " SELECT conv_id, turn, round(1000 + 2.5e0 * conv_id - 0.75e0 * turn, 5) + 0 AS x, round(500 + 0.75e0 * conv_id + 2.5e0 * turn, 5) + 0 AS y FROM srv")
def fill_missing_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing coordinates come from the planes through the others, which are exact here."""
    rows = geometry.coordinates(views.survey(spark, sf_dir), ("conv_id", "turn"), views.XY)
    return rows.select("conv_id", "turn", *[(F.round(c, 5) + 0.0).alias(c) for c in views.XY])


@query(S + " SELECT conv_id, turn FROM srv WHERE x IS NOT NULL AND y IS NOT NULL")
def coords_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.coordinates(views.survey(spark, sf_dir), ("conv_id", "turn"), views.XY, fill=False).select("conv_id", "turn")


SCALARS = "CASE conv_id % 5 WHEN 0 THEN -100 WHEN 1 THEN -10 WHEN 2 THEN 0 WHEN 3 THEN 1 ELSE 10 END"


@query(f"SELECT conv_id, turn, round(conv_id * CASE WHEN s = 0 THEN 1 ELSE pow(abs(s), sign(s)) END, 6) + 0 AS x, round(turn * CASE WHEN s = 0 THEN 1 ELSE pow(abs(s), sign(s)) END, 6) + 0 AS y FROM (SELECT conv_id, turn, {SCALARS} AS s FROM conversations)")
def scale_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("conv_id").cast("double").alias("x"), F.col("turn").cast("double").alias("y"))
    return geometry.scaled(rows, F.expr(SCALARS), views.XY).select("conv_id", "turn", r6("x").alias("x"), r6("y").alias("y"))


@query("SELECT 2.5e0 AS a, 0.75e0 AS b, -0.75e0 AS c, 2.5e0 AS d, 1000.0e0 AS e, 500.0e0 AS f")
def orthogonal_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From three corners of the block of traces."""
    rows = views.block(spark, sf_dir).where("(iline = 0 AND xline = 1) OR (iline = 3 AND xline = 1) OR (iline = 0 AND xline = 9)")
    rows = rows.withColumn("n", F.when(F.col("iline") == 3, 1).when(F.col("xline") == 9, 2).otherwise(0))
    found = geometry.orthogonal_affine(rows, ("iline", "xline"), views.XY, "n")
    return found.select(*[r6(k).alias(k) for k in "abcdef"])


CORNERS = """, ends AS (SELECT min(iline) AS i0, max(iline) AS i1, min(xline) AS j0, max(xline) AS j1 FROM blk),
ring AS (SELECT 0 AS corner, i0 AS iline, j0 AS xline FROM ends UNION ALL SELECT 1, i0, j1 FROM ends UNION ALL SELECT 2, i1, j1 FROM ends UNION ALL SELECT 3, i1, j0 FROM ends UNION ALL SELECT 4, i0, j0 FROM ends)"""


@query(B + CORNERS + " SELECT r.corner, r.iline, r.xline, b.x, b.y FROM ring r LEFT JOIN blk b ON b.iline = r.iline AND b.xline = r.xline")
def corner_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.corner_points(views.block(spark, sf_dir), xy=views.XY)


@query(B + CORNERS + " SELECT round(sum((x2 - x) * (y2 + y)), 6) + 0 AS rotation FROM (SELECT corner, x, y, lead(x) OVER (ORDER BY corner) AS x2, lead(y) OVER (ORDER BY corner) AS y2 FROM (SELECT r.corner, b.x, b.y FROM ring r LEFT JOIN blk b ON b.iline = r.iline AND b.xline = r.xline WHERE corner < 4))")
def grid_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = geometry.grid_rotation(geometry.corner_points(views.block(spark, sf_dir), xy=views.XY), views.XY)
    return found.select(r6("rotation").alias("rotation"))


@query(B + " SELECT tracen, round((2.5 * (x - 1000) + 0.75 * (y - 500)) / 6.8125, 6) + 0 AS i, round((-0.75 * (x - 1000) + 2.5 * (y - 500)) / 6.8125, 6) + 0 AS j FROM blk")
def affine_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.block(spark, sf_dir)
    i, j = geometry.affine_of(rows, xy=views.XY).inverse(F.col("x"), F.col("y"))
    return rows.select("tracen", r6(i).alias("i"), r6(j).alias("j"))


PATH = """pts AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS seq, value AS y FROM events),
st AS (SELECT user_id, seq, seq * 10.0e0 AS x, y, coalesce(sqrt(pow(10.0e0, 2) + pow(y - lag(y) OVER (PARTITION BY user_id ORDER BY seq), 2)), 0) AS d FROM pts),
al AS (SELECT user_id, seq, x, y, sum(d) OVER (PARTITION BY user_id ORDER BY seq) AS l FROM st),
lg AS (SELECT user_id, x, y, l, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(l) OVER w AS l2 FROM al WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
nn AS (SELECT user_id, max(l) AS total, CAST(trunc(max(l) / 25) AS INTEGER) + 1 AS n, arg_min(x, seq) AS x0, arg_min(y, seq) AS y0 FROM al GROUP BY 1),
s AS (SELECT user_id, CAST(g AS INTEGER) AS station, CASE WHEN n > 1 THEN total * g / (n - 1) ELSE 0 END AS st_at, total, x0, y0 FROM (SELECT *, unnest(range(n)) AS g FROM nn))"""


@query("WITH " + PATH + """ SELECT s.user_id, station, round(st_at, 3) + 0 AS distance, round(coalesce(max(x + (x2 - x) * (st_at - l) / (l2 - l)), max(x0)), 3) + 0 AS x, round(coalesce(max(y + (y2 - y) * (st_at - l) / (l2 - l)), max(y0)), 3) + 0 AS y
FROM s LEFT JOIN lg ON lg.user_id = s.user_id AND l2 > l AND st_at >= l - 1e-7 AND (st_at < l2 OR (l2 >= total - 1e-9 AND st_at >= total - 1e-9 AND l < total)) GROUP BY 1, 2, 3""")
def path_uniform_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations every 25 units along the events of each user as a polyline."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    path = table(spark, sf_dir, "events").select("user_id", F.row_number().over(order).alias("seq"), F.col("value").alias("y")).withColumn("x", F.col("seq") * 10.0)
    found = geometry.uniform_spacing(path, 25.0, "seq", ["x", "y"], by=("user_id",))
    return found.select("user_id", "station", *[(F.round(c, 3) + 0.0).alias(c) for c in ("distance", "x", "y")])


def _points(spark: SparkSession) -> DataFrame:
    """Points at fractional places of the block, some outside."""
    i, j = F.col("id") * 0.37 - 0.4, F.col("id") * 0.83 + 0.6
    x, y = TRUE_AFFINE.forward(i, j)
    return spark.range(40).select(F.col("id").cast("int").alias("point"), x.alias("x"), y.alias("y"))


POINTS = """, pt AS (SELECT CAST(g AS INTEGER) AS point, round(g * 0.37e0 - 0.4e0, 9) AS p, round(g * 0.83e0 + 0.6e0 - 1, 9) AS q FROM range(40) t(g)),
ax AS (SELECT min(iline) AS i0, max(iline) AS i1, min(xline) AS j0, max(xline) AS j1 FROM blk),
ins AS (SELECT point, p, q, p >= 0 AND p <= i1 - i0 AND q >= 0 AND q <= j1 - j0 AS inside FROM pt, ax)"""


def _axes(rows: DataFrame) -> tuple[geometry.Axis, geometry.Axis]:
    return geometry.axis_of(rows, "iline"), geometry.axis_of(rows, "xline")


@query(B + POINTS + " SELECT i.point, b.tracen, round(list_sum(b.samples), 6) + 0 AS total FROM ins i LEFT JOIN blk b ON i.inside AND b.iline = ceil(p - 0.5) AND b.xline = ceil(q - 0.5) + 1")
def xysel_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.block(spark, sf_dir)
    at = geometry.select_xy(rows, _points(spark), geometry.affine_of(rows, xy=views.XY), _axes(rows), method="nearest", carry=("tracen",))
    return at.select("point", "tracen", r6(F.when(F.col("samples").isNotNull(), traces.total(F.col("samples")))).alias("total"))


BILINEAR = """, cor AS (
  SELECT point, floor(p) + di AS i, floor(q) + dj + 1 AS j, CASE WHEN di = 1 THEN p - floor(p) ELSE 1 - p + floor(p) END * CASE WHEN dj = 1 THEN q - floor(q) ELSE 1 - q + floor(q) END AS w
  FROM ins, (SELECT * FROM range(2) a(di), range(2) b(dj)) WHERE inside),
nd AS (SELECT *, count(*) OVER (PARTITION BY point) AS need FROM cor WHERE w > 0),
lin AS (SELECT nd.point, k, sum(l.v * w) AS v FROM nd JOIN lng l ON l.iline = nd.i AND l.xline = nd.j GROUP BY nd.point, k HAVING count(*) = max(need))"""


@query(B + POINTS + BILINEAR + " SELECT i.point, l.k, round(l.v, 6) + 0 AS v FROM ins i LEFT JOIN lin l ON l.point = i.point")
def xysel_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.block(spark, sf_dir)
    at = geometry.select_xy(rows, _points(spark), geometry.affine_of(rows, xy=views.XY), _axes(rows))
    return at.select("point", F.posexplode_outer("samples").alias("k", "v")).select("point", "k", r6("v").alias("v"))


CELLS = POINTS.replace("CAST(g AS INTEGER) AS point, round(g * 0.37e0 - 0.4e0, 9) AS p, round(g * 0.83e0 + 0.6e0 - 1, 9) AS q FROM range(40) t(g)", "tracen AS point, {p} AS p, {q} - 1 AS q FROM blk")
TOTALS = " SELECT b.iline, b.xline, round(sum(l.v), 6) + 0 AS total FROM blk b LEFT JOIN lin l ON l.point = b.tracen GROUP BY 1, 2"


@query(B + CELLS.format(p="iline + 0.25e0", q="(xline * 0.5e0 + 0.75e0)") + BILINEAR + TOTALS)
def survey_regrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The volume at the cells of a survey of its labels that lies a quarter inline on and has crosslines half as wide."""
    rows = views.block(spark, sf_dir)
    x, y = TRUE_AFFINE.forward(F.col("iline") + 0.25, F.col("xline") * 0.5 + 0.75)
    other = rows.select("iline", "xline", x.alias("x"), y.alias("y"))
    found = geometry.regridded(rows, other, geometry.affine_of(rows, xy=views.XY), _axes(rows), xy=views.XY)
    return found.select("iline", "xline", r6(F.when(F.col("samples").isNotNull(), traces.total(F.col("samples")))).alias("total"))


@query(B + CELLS.format(p="CAST(iline AS DOUBLE)", q="(xline + 0.5e0)") + BILINEAR + TOTALS.replace("b.xline,", "b.xline + 0.5e0 AS xline,"))
def interp_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The volume at the midpoints between its crosslines."""
    rows = views.volume(spark, sf_dir)
    found = geometry.interpolated_labels(rows, rows.select("iline", (F.col("xline") + 0.5).alias("xline")), _axes(rows))
    return found.select("iline", "xline", r6(F.when(F.col("samples").isNotNull(), traces.total(F.col("samples")))).alias("total"))


@query(B + POINTS.replace("g * 0.37e0 - 0.4e0", "g * 0.2e0").replace("g * 0.83e0 + 0.6e0 - 1", "g * 0.5e0").replace("range(40)", "range(41)") + BILINEAR + " SELECT i.point, l.k, round(l.v, 6) + 0 AS v FROM ins i LEFT JOIN lin l ON l.point = i.point")
def interp_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces at 41 places along a straight line across the block."""
    rows = views.block(spark, sf_dir)
    ends = [(float(n), *(1000 + 2.5 * i - 0.75 * j, 500 + 0.75 * i + 2.5 * j)) for n, (i, j) in enumerate([(0, 1), (8, 21)])]
    path = spark.createDataFrame(ends, "seq double, x double, y double")
    length = sum((a - b) ** 2 for a, b in zip(ends[0][1:], ends[1][1:], strict=True)) ** 0.5
    line = geometry.interpolated_line(rows, path, length / 40.5, geometry.affine_of(rows, xy=views.XY), _axes(rows))
    return line.select("point", F.posexplode_outer("samples").alias("k", "v")).select("point", "k", r6("v").alias("v"))


@query(B + " SELECT iline, xline, round(s[k + 1] * (1 - t) + CASE WHEN t > 0 THEN s[k + 2] * t ELSE 0 END, 6) + 0 AS amplitude FROM (SELECT iline, xline, samples AS s, CAST(floor(p) AS INTEGER) AS k, p - floor(p) AS t FROM (SELECT *, round((10.0e0 + iline * 7 + xline * 0.3e0) / 4.0e0, 9) AS p FROM blk))")
def horizon_amplitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values at a horizon that dips across the block."""
    rows = views.block(spark, sf_dir)
    depth = F.round((10.0 + F.col("iline") * 7 + F.col("xline") * 0.3) / 4.0, 9) * 4.0
    horizon = rows.select("iline", "xline", depth.alias("z"))
    return geometry.at_horizon(rows, horizon, ("iline", "xline"), "z", 0.0, 4.0).select("iline", "xline", r6("amplitude").alias("amplitude"))


@query(V + " SELECT tracen, round(coalesce(sum(CASE WHEN k * 4.0 > iline * 10 AND k * 4.0 < iline * 10 + 100 THEN v END), 0), 6) + 0 AS total FROM lng GROUP BY 1")
def horizon_window_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = F.col("iline") * 10.0
    return views.volume(spark, sf_dir).select("tracen", r6(traces.window_sum(F.col("samples"), top, top + 100, 0.0, 4.0)).alias("total"))


@query(B + " SELECT tracen, round(x + 100, 6) + 0 AS x, round(y - 50, 6) + 0 AS y FROM blk")
def survey_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of one survey in another whose labels are moved: 100 further and 50 back."""
    rows = views.block(spark, sf_dir)
    other = geometry.Affine(1.0, 0.0, 0.0, 1.0, -100.0, 50.0)
    i, j = geometry.affine_of(rows, xy=views.XY).to(other).forward(F.col("iline"), F.col("xline"))
    return rows.select("tracen", r6(i).alias("x"), r6(j).alias("y"))


@query()
def resample_cubic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces at other labels by cubic splines; no SQL has them, tests compare with polynomials."""
    at = F.transform(F.sequence(F.lit(0), F.lit(30)), lambda j: (j * 2 + 0.5) * 4.0)
    rows = geometry.resample_cubic(views.volume(spark, sf_dir).withColumn("at", at), "at", 0.0, 4.0)
    return traces.long_view(rows, ["tracen"]).select("tracen", "k", r6("v").alias("v"))
