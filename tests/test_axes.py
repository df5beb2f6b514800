"""Uneven axes and splines across traces."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgrid.operators import axes, geometry, splines


@pytest.mark.parametrize("piece", [axes.PIECE, 5])
def test_values_between_uneven_labels(spark, monkeypatch, piece):
    monkeypatch.setattr(axes, "PIECE", piece)
    rng = np.random.default_rng(4)
    labels = np.unique(np.round(rng.random(60) * 100, 3))
    values = np.concatenate([rng.random(80) * 120 - 10, labels[:7], [labels[-1], 33.0, 33.0]])
    axis = axes.axis_of(spark.createDataFrame([(float(v),) for v in [*labels, labels[0]]], "x double"), "x")
    assert isinstance(axis, axes.Uneven)
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)] + [(-1, None)], "id int, v double")
    got = {r["id"]: r["p"] for r in axis.between(rows, "v", "p").collect()}
    assert len(got) == len(values) + 1 and got[-1] is None
    for i, v in enumerate(np.round(values, 9)):
        k = np.searchsorted(labels, v, side="right") - 1
        if v < labels[0] or v > labels[-1]:
            assert got[i] is None
        else:
            assert got[i]["a"] == labels[k] and (v == labels[k] or got[i]["b"] == labels[k + 1])
            assert got[i]["t"] == pytest.approx(0 if v == labels[k] else (v - labels[k]) / (labels[k + 1] - labels[k]))


def test_even_and_empty_axes(spark):
    rows = spark.createDataFrame([(2.0,), (4.0,), (8.0,), (6.0,)], "x double")
    axis = axes.axis_of(rows, "x")
    assert axis == axes.Axis(2.0, 2.0, 4)
    got = [r["p"] for r in axis.between(spark.createDataFrame([(3.0,), (8.0,), (8.1,), (None,)], "v double"), "v", "p").collect()]
    assert tuple(got[0]) == (0, 1, 0.5) and got[1]["a"] == 3 and got[1]["t"] == 0 and got[2:] == [None, None]
    assert axes.axis_of(rows.limit(0), "x").between(rows, "x", "p").where("p IS NOT NULL").count() == 0
    assert axes.Uneven(rows.limit(0).toDF("label")).between(rows, "x", "p").where("p IS NOT NULL").count() == 0


def test_points_between_uneven_labels(spark):
    f = lambda i, j: 3 * i - 2 * j + 0.25 * i * j  # noqa: E731  bilinear, so exact
    ilines, xlines = [1, 2, 4, 8, 16], [10, 11, 15, 30]
    rows = spark.createDataFrame([(i, j, float(i * 100), float(j * 50), [f(i, j), 1.0]) for i in ilines for j in xlines], "iline int, xline int, cdp_x double, cdp_y double, samples array<double>")
    points = spark.createDataFrame([(0, 300.0, 600.0), (1, 100.0, 500.0), (2, 1600.0, 1500.0), (3, 50.0, 600.0), (4, 1200.0, 1499.0)], "point int, x double, y double")
    both = axes.axis_of(rows, "iline"), axes.axis_of(rows, "xline")
    got = {r["point"]: r["samples"] for r in geometry.select_xy(rows, points, geometry.affine_of(rows), both).collect()}
    assert got[3] is None
    for p, (i, j) in {0: (3, 12), 1: (1, 10), 2: (16, 30), 4: (12, 29.98)}.items():
        assert got[p] == pytest.approx([f(i, j), 1.0])
    near = {r["point"]: r["samples"] for r in geometry.select_xy(rows, points, geometry.affine_of(rows), both, method="nearest").collect()}
    assert near[0] == [f(2, 11), 1.0] and near[4] == [f(8, 30), 1.0]
    odd = {r["point"]: r["samples"] for r in geometry.select_irregular(rows, points, both).collect()}
    assert odd[0] == pytest.approx([f(3, 12), 1.0]) and odd[3] is None


@pytest.mark.parametrize("block,ghost", [(splines.BLOCK, splines.GHOST), (40, 30)])
def test_splines_across_traces_in_blocks(spark, monkeypatch, block, ghost):
    monkeypatch.setattr(splines, "BLOCK", block)
    monkeypatch.setattr(splines, "GHOST", ghost)
    rng = np.random.default_rng(2)
    labels = np.cumsum(rng.integers(1, 4, 150)).astype(float)
    lines = {1: labels, 2: labels[30:90], None: labels[:3], 4: labels[::2]}
    rows, want = [], {}
    wanted = np.concatenate([labels[:5], (labels[1:] + labels[:-1]) / 2])
    for line, x in lines.items():
        y = rng.random((len(x), 3))
        rows += [(line, float(a), b.tolist(), "extra") for a, b in zip(x, y, strict=True)]
        for at in wanted:
            if x[0] <= at <= x[-1]:
                want[line, at] = splines.through(x, y, np.array([at]))[0]
    frame = spark.createDataFrame(rows, "line int, x double, samples array<double>, _at string").repartition(5)
    got = {(r["line"], r["x"]): r["samples"] for r in splines.along(frame, "x", spark.createDataFrame([(float(v),) for v in [*wanted, -5.0]], "x double"), ("line",)).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-10) for k in want)


def test_cubic_along_two_dimensions_holds_cubics(spark):
    f = lambda i, j: i**3 - 2 * i * j**2 + j**3 / 4 + 1
    rows = spark.createDataFrame([(i, j, [float(f(i, j)), 2.0]) for i in range(1, 8) for j in (0, 1, 3, 4, 6, 9)], "iline int, xline int, samples array<double>")
    labels = spark.createDataFrame([(1.5, 0.5), (6.25, 7.0), (7.0, 9.0), (8.0, 1.0)], "iline double, xline double")
    both = axes.axis_of(rows, "iline"), axes.axis_of(rows, "xline")
    got = {(r["iline"], r["xline"]): r["samples"] for r in geometry.interpolated_labels(rows, labels, both, method="cubic").collect()}
    assert got[8.0, 1.0] is None and all(got[k] == pytest.approx([f(*k), 2.0]) for k in got if k[0] < 8) and len(got) == 4


def test_cubic_resampling_of_unlike_traces(spark):
    rows = spark.createDataFrame([(1, [0.0, 1.0, 8.0, 27.0, 64.0], [1.5, 3.25, 9.0]), (2, [1.0, 2.0], [0.5, 0.5, 0.5]), (3, [0.0, 1.0, 8.0, 27.0, 64.0], [0.5, 4.0, -1.0])], "id int, samples array<double>, at array<double>")
    got = {r["id"]: r["samples"] for r in geometry.resample_cubic(rows, "at", 0.0, 1.0).collect()}
    assert got[1][:2] == pytest.approx([1.5**3, 3.25**3]) and got[2] == pytest.approx([1.5] * 3) and got[3][:2] == pytest.approx([0.125, 64.0]) and got[1][2] is got[3][2] is None
