"""Scattered points to grids against one triangulation and plain distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgrid.operators import geometry, surfaces


def ordered(points):
    return np.array(sorted(set(map(tuple, points.tolist()))))


@pytest.mark.parametrize("kind", ["random", "grid", "line", "clusters", "circle"])
def test_triangles_are_delaunay(kind):
    rng = np.random.default_rng(3)
    made = {
        "random": rng.random((150, 2)),
        "grid": np.array([(i, j) for i in range(9) for j in range(7)], dtype=float),
        "line": np.array([(i, 2 * i) for i in range(9)] + [(3.0, 9.0)], dtype=float),
        "clusters": np.concatenate([rng.normal(c, 0.01, (40, 2)) for c in (0, 5, 9)]),
        "circle": np.column_stack([np.cos(np.arange(24) / 24 * 2 * np.pi), np.sin(np.arange(24) / 24 * 2 * np.pi)]),
    }
    points = ordered(made[kind])
    corners = surfaces.delaunay(points)
    a, b, c = (points[corners[:, k]] for k in range(3))
    area = ((b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])) / 2
    assert (area > -1e-12).all()
    # they cover the hull once
    hull = 0.0
    order = points.tolist()
    for chain in (order, order[::-1]):
        line = []
        for p in chain:
            while len(line) > 1 and (line[-1][0] - line[-2][0]) * (p[1] - line[-2][1]) - (line[-1][1] - line[-2][1]) * (p[0] - line[-2][0]) <= 0:
                line.pop()
            line.append(p)
        hull += sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(line, line[1:], strict=False)) / 2
    assert np.isclose(area.sum(), hull)
    for t in corners[area > 1e-9]:
        (ax, ay), (bx, by), (cx, cy) = points[t]
        d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
        ux = ((ax**2 + ay**2) * (by - cy) + (bx**2 + by**2) * (cy - ay) + (cx**2 + cy**2) * (ay - by)) / d
        uy = ((ax**2 + ay**2) * (cx - bx) + (bx**2 + by**2) * (ax - cx) + (cx**2 + cy**2) * (bx - ax)) / d
        r = np.hypot(ax - ux, ay - uy)
        assert (np.hypot(*(points - (ux, uy)).T) > r * (1 - 1e-6)).all()


def frame(spark, rows, names="x double, y double, z double"):
    return spark.createDataFrame([tuple(map(float, r)) for r in rows], names)


@pytest.mark.parametrize("n,most", [(50_000, surfaces.MOST_POINTS), (3000, 60)])
def test_tiles_equal_one_triangulation(spark, n, most):
    rng = np.random.default_rng(n)
    uniform = rng.random((n - n // 3, 2)) * (1000, 700)
    points = ordered(np.concatenate([uniform, rng.normal((300, 200), 3, (n // 3, 2))]))
    values = np.sin(points[:, 0] / 50) + points[:, 1]
    places = np.concatenate([rng.random((3000, 2)) * (1100, 800) - 50, rng.normal((300, 200), 3, (1000, 2))])
    want = surfaces.planes(points, values[:, None], surfaces.delaunay(points), places)[:, 0]
    got = surfaces.interpolated(frame(spark, np.column_stack([places, np.arange(len(places))]), "x double, y double, id double"), frame(spark, np.column_stack([points, values])), {"z": "z"}, ("x", "y"), most=most)
    found = {int(r["id"]): r["z"] for r in got.collect()}
    assert len(found) == len(places)
    found = np.array([np.nan if found[i] is None else found[i] for i in range(len(places))])
    assert (np.isnan(found) == np.isnan(want)).all() and np.isnan(want).any() and (~np.isnan(want)).sum() > 2500
    assert np.allclose(found[~np.isnan(want)], want[~np.isnan(want)], atol=1e-9)


@pytest.mark.parametrize("most", [surfaces.MOST_POINTS, 30])
def test_nearest_points(spark, most):
    rng = np.random.default_rng(8)
    points = ordered(np.concatenate([rng.random((400, 2)) * 100, rng.normal((20, 20), 0.01, (400, 2)), [(500.0, 500.0)]]))
    places = np.concatenate([rng.random((300, 2)) * 140 - 20, [(1e6, -1e6), (300.0, 300.0)], points[:5], [(20.0, 20.0)]])
    got = surfaces.interpolated(frame(spark, np.column_stack([places, np.arange(len(places))]), "x double, y double, id double"), frame(spark, np.column_stack([points, np.arange(len(points))])), {"z": "z"}, ("x", "y"), "nearest", most)
    found = {int(r["id"]): int(r["z"]) for r in got.collect()}
    for i, p in enumerate(places):
        d = ((points - p) ** 2).sum(axis=1)
        assert d[found[i]] <= d.min() * (1 + 1e-12)


def test_ties_nulls_and_empty_tables(spark):
    points = spark.createDataFrame([(0.0, 0.0, 1.0), (0.0, 0.0, 3.0), (2.0, 0.0, 5.0), (0.0, 2.0, None), (None, 1.0, 7.0), (0.0, 2.0, 9.0), (2.0, 2.0, float("nan"))], "x double, y double, z double")
    places = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.0, 0.0), (3, None, 0.0), (4, 9.0, 9.0), (1, 0.5, 0.5)], "id int, x double, y double")
    linear = sorted((r["id"], r["z"]) for r in surfaces.interpolated(places, points, {"z": "z"}, ("x", "y")).collect())
    assert linear == [(1, pytest.approx(2 + 0.75 + 1.75)), (1, pytest.approx(4.5)), (2, pytest.approx(3.5)), (3, None), (4, None)]
    near = sorted((r["id"], r["z"]) for r in surfaces.interpolated(places, points, {"z": "z"}, ("x", "y"), "nearest").collect())
    assert near == [(1, 2.0), (1, 2.0), (2, 2.0), (3, None), (4, 9.0)]
    for method in ("linear", "nearest"):
        assert surfaces.interpolated(places, points.limit(0), {"z": "z"}, ("x", "y"), method).where("z IS NOT NULL").count() == 0
        assert surfaces.interpolated(places.limit(0), points, {"z": "z"}, ("x", "y"), method).count() == 0
    with pytest.raises(ValueError):
        surfaces.interpolated(places, points, {"z": "z"}, ("x", "y"), "cubic")


def test_labels_of_a_curved_survey(spark):
    # no affine transform describes it
    rows = spark.range(30 * 20).select((F.col("id") % 30 + 100).cast("int").alias("iline"), F.expr("CAST(id DIV 30 + 5 AS INT)").alias("xline"))
    x, y = F.col("iline") * 10.0 + F.pow(F.col("xline"), 2) * 0.4, F.col("xline") * 12.0 + F.sin(F.col("iline") / 4.0) * 15
    traces = rows.withColumns({"cdp_x": x, "cdp_y": y})
    at_traces = geometry.labels_at(traces.select("iline", "xline", F.col("cdp_x").alias("x"), F.col("cdp_y").alias("y")), traces)
    assert at_traces.where("abs(_i - iline) > 1e-6 OR abs(_j - xline) > 1e-6 OR _i IS NULL").count() == 0
    i, j = F.col("iline") + 0.3, F.col("xline") + 0.3
    between = rows.where("iline < 128 AND xline < 23").select("iline", "xline", (i * 10 + F.pow(j, 2) * 0.4).alias("x"), (j * 12 + F.sin(i / 4) * 15).alias("y"))
    off = geometry.labels_at(between, traces).agg(F.max(F.abs(F.col("_i") - i)), F.max(F.abs(F.col("_j") - j)), F.count("_i")).first()
    assert off[0] < 0.1 and off[1] < 0.1 and off[2] == between.count()
