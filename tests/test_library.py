"""Codec, SEG-Y files, grids, geometry, text headers, volumes, command line and streams."""

import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamgrid import cli, codec, keys
from loamgrid.functions import text
from loamgrid.operators import geometry, grid, splines, stats, traces
from loamgrid.sources import segy, tables
from loamgrid.streaming import headers as streams
from loamgrid.volume import Volume

DIMS, EXTRAS = {"iline": 189, "xline": 193}, {"cdp_x": 181, "cdp_y": 185}


def survey(spark, ni=10, nj=10, ns=10):
    rows = grid.blank_grid(spark, {"iline": (1, 1, ni), "xline": (11, 1, nj)}, ns, 0.0)
    i, j = F.col("iline").cast("int"), F.col("xline").cast("int")
    value = F.transform(F.sequence(F.lit(0), F.lit(ns - 1)), lambda k: (i * 100 + j + k * 0.5).cast("float"))
    return rows.select(i.alias("iline"), j.alias("xline"), (i * 1000).alias("cdp_x"), (j * 1000).alias("cdp_y"), value.alias("samples"))


# ---------------------------------------------------------------- codec
def test_ibm_word():
    assert codec.ibm_to_float(np.array([0xC276A000], dtype=np.uint32))[0] == -118.625


@given(st.lists(st.floats(-1e30, 1e30), min_size=1, max_size=20))
def test_ibm_round_trip(values):
    back = codec.ibm_to_float(codec.float_to_ibm(np.array(values)))
    assert np.allclose(back, values, rtol=1e-6, atol=1e-70)


def test_keys():
    assert len(keys.TRACE_FIELDS) == 91 and keys.layout("petrel_3d")["xline"] == 21
    for bad in (2, 182, 400):
        with pytest.raises(ValueError):
            keys.check_bytes([bad])
    with pytest.raises(ValueError):
        keys.layout("nothing")
    with pytest.raises(ValueError):
        keys.check_vertical("TIME", None)
    with pytest.raises(ValueError):
        keys.vertical_dimension(["twt", "depth"])
    assert keys.dimensionality(["iline", "xline", "offset"]) == "3dgath" and keys.dimensionality(["cdp"]) == "2d"


# ---------------------------------------------------------------- SEG-Y
@pytest.mark.parametrize("kind,endian", [(1, "big"), (5, "little"), (5, "big"), (2, "big")])
def test_segy_round_trip(spark, tmp_path, kind, endian):
    rows = survey(spark)
    path = str(tmp_path / "a.sgy")
    assert segy.write_traces(rows, path, DIMS, EXTRAS, ns0=100, dt=2.0, sample_format=kind, endian=endian) == 100
    back = segy.read_traces(spark, path, DIMS, EXTRAS, endian=endian)
    got = {(r["iline"], r["xline"], r["cdp_x"]): r["samples"] for r in back.collect()}
    want = {(r["iline"], r["xline"], r["cdp_x"]): r["samples"] for r in rows.collect()}
    assert set(got) == set(want)
    for k in want:
        assert np.allclose(got[k], np.trunc(want[k]) if kind == 2 else want[k])
    meta = segy.read_meta(spark, path, endian=endian).first()
    assert (meta["ntraces"], meta["ns"], meta["dt"], meta["ns0"], meta["format"]) == (100, 10, 2.0, 100.0, kind)


SLICINGS = [{}, {"iline": (3, 3)}, {"xline": (12, 14)}, {"iline": (1, 1), "xline": (11, 11)}, {"iline": (2, 8), "xline": (13, 20)}]


@pytest.mark.parametrize("bounds", SLICINGS)
@pytest.mark.parametrize("dead", [False, True])
def test_slices_and_dead_traces_round_trip(spark, tmp_path, bounds, dead):
    rows = grid.cropped(survey(spark), bounds)
    gone = (F.col("iline") + F.col("xline")) % 3 == 0 if dead else F.lit(False)
    path = str(tmp_path / "b.sgy")
    n = segy.write_traces(rows, path, DIMS, dead=gone)
    live = rows.where(~gone)
    assert n == live.count()
    back = segy.read_traces(spark, path, DIMS).orderBy("tracen").collect()
    want = live.orderBy("iline", "xline").collect()
    assert [(r["iline"], r["xline"]) for r in back] == [(r["iline"], r["xline"]) for r in want]
    assert all(np.allclose(a["samples"], b["samples"]) for a, b in zip(back, want, strict=True))


def test_pushdown_and_options(spark, tmp_path):
    path = str(tmp_path / "c.sgy")
    segy.write_traces(survey(spark), path, DIMS, EXTRAS)
    where = [("iline", "==", 5), ("xline", ">=", 12), ("xline", "<=", 14)]
    found = segy.read_traces(spark, path, DIMS, where=where, tracesPerPartition=17)
    assert found.count() == 3
    assert segy.read_traces(spark, path, DIMS, where=[("iline", "in", [2, 4])]).count() == 20
    assert segy.read_traces(spark, path, DIMS, where=[("tracen", "<", 7), ("tracen", ">", 2)], tracesPerPartition=3).count() == 4
    every = segy.read_traces(spark, path, DIMS)
    assert [every.where("iline = 5").count(), every.count(), every.where("tracen < 7").count(), every.count()] == [10, 100, 7, 100]
    with pytest.raises(Exception, match="can't be applied"):
        segy.read_traces(spark, path, DIMS, where=[("nothing", "==", 1)]).count()
    cut = segy.read_traces(spark, path, DIMS, first=2, last=4).where("iline = 1 AND xline = 11").first()["samples"]
    assert cut == [112.0, 112.5, 113.0]
    heads = segy.read_headers(spark, path, 50)
    assert len(heads.columns) == 93 and heads.count() == 50
    keep = heads.where("INLINE_3D > 3").select("file", "tracen")
    assert segy.read_traces(spark, path, DIMS, keep=keep).count() == 20
    assert segy.is_segy("a.SGY") and not segy.is_segy("a.nc") and not segy.is_segy(5)


def test_many_files(spark, tmp_path):
    for i in (1, 2, 3):
        segy.write_traces(survey(spark).where(F.col("iline") == i), str(tmp_path / f"line{i}.sgy"), DIMS)
    assert segy.read_traces(spark, str(tmp_path), DIMS).select("iline", "xline").distinct().count() == 30
    with pytest.raises(ValueError):
        segy.write_traces(survey(spark), str(tmp_path / "x.sgy"), {"iline": 2})


def test_broken_file(tmp_path):
    path = tmp_path / "short.sgy"
    path.write_bytes(b" " * 3200 + codec.encode_binary({"Samples": 10, "Format": 1}, "big") + b"123")
    with pytest.raises(ValueError):
        segy.head(str(path), "big")


# ---------------------------------------------------------------- headers and grids
def test_geometry_guess(spark, tmp_path):
    path = str(tmp_path / "g.sgy")
    segy.write_traces(survey(spark), path, DIMS, EXTRAS)
    heads = segy.read_headers(spark, path)
    assert stats.guess_geometry(heads) == DIMS | EXTRAS
    with pytest.raises(ValueError):
        stats.guess_geometry(heads.where("tracen <> 5"))
    varying = stats.varying_fields(stats.header_stats(heads.drop("tracen")))
    assert {"INLINE_3D", "CROSSLINE_3D", "CDP_X", "CDP_Y"} <= set(varying)


@pytest.mark.parametrize("parts", [1, 7])
def test_numbering_by_ranges(spark, parts):
    rows = survey(spark).select("iline", "xline")
    got = grid.numbered(rows, ["xline", "iline"], "n", parts).orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(100))
    assert [(r["xline"], r["iline"]) for r in got] == sorted((r["xline"], r["iline"]) for r in got)
    assert grid.numbered(rows.limit(0), ["iline"], "n", parts).count() == 0


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_numbering_keeps_repeated_and_null_keys(spark, parts):
    rng = np.random.default_rng(7)
    keys = [(None, None), (None, "x"), (2, None), (2, "a"), (2, "a"), (2, "a"), (1, "b")] + [(int(k), "c") for k in rng.integers(0, 9, 60)]
    rows = spark.createDataFrame([(*k, i) for i, k in enumerate(keys)], "a int, b string, id int")
    got = grid.numbered(rows.repartition(5), ["a", "b"], "n", parts).orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(len(keys))) and {r["id"] for r in got} == set(range(len(keys)))
    order = [(r["a"] is not None, r["a"] or 0, r["b"] is not None, r["b"] or "") for r in got]
    assert order == sorted(order) and [got[0]["a"], got[0]["b"], got[1]["b"]] == [None, None, "x"]


def test_the_sink_numbers_without_a_single_task(spark, tmp_path):
    rows = survey(spark)
    bounds = grid.range_bounds(rows, ["iline", "xline"], ns=F.size("samples"))
    assert sum(b["_n"] for b in bounds) == 100 and len(bounds) > 1 and max(b["ns"] for b in bounds) == len(rows.first()["samples"])
    plan = grid.placed(rows, ["iline", "xline"], bounds, "n")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_range" in plan
    assert all("samples" not in x for x in plan.split("\n") if "SinglePartition" in x)


def test_percentiles_by_ranges(spark):
    rng = np.random.default_rng(2)
    rows = [(k, float(v)) for k, n in (("a", 400), ("b", 7), ("c", 1)) for v in rng.integers(0, 300, n) / 4] + [("b", None)]
    frame, shares = spark.createDataFrame(rows, "k string, v double"), [0.0, 0.1, 0.5, 0.77, 1.0]
    want = {k: np.percentile([v for x, v in rows if x == k and v is not None], [s * 100 for s in shares]) for k in "abc"}
    for most in (1_000_000, 3):
        got = {r["k"]: r["p"] for r in stats.exact_percentiles(frame, ["k"], "v", shares, most).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    whole = stats.exact_percentiles(frame, [], "v", shares, 3).first()["p"]
    assert np.allclose(whole, np.percentile([v for _, v in rows if v is not None], [s * 100 for s in shares]))


def test_runs_and_chunks_across_ranges(spark):
    numbers = [1, 2, 3, 7, 8, 20, 21, 22, 23, 40]
    rows = spark.createDataFrame([(n,) for n in numbers], "n long")
    got = [tuple(r) for r in grid.islands(rows, "n").orderBy("block").collect()]
    assert got == [(0, 1, 3, 3), (1, 7, 8, 2), (2, 20, 23, 4), (3, 40, 40, 1)]
    # the label stays only from trace 3 to trace 4, which lie in different ranges of 4
    traces = spark.createDataFrame([(i, x, i) for i, x in enumerate([1, 2, 3, 4, 4, 5, 6, 7])], "t long, a int, b long")
    assert grid.chunk_heuristic(traces, ["a", "b"], "t", 4) == {"a": 1, "b": -1}


def test_dimensions_of_one_label(spark):
    rows = survey(spark).where("iline = 3").select("iline", "xline")
    cut, single = grid.squeezed(rows, ["iline", "xline"])
    assert cut.columns == ["xline"] and single == {"iline": 3}
    wide = grid.broadcast_like(cut.withColumn("v", F.lit(1)), ["xline"], survey(spark).select("iline", "xline"), ["iline", "xline"])
    assert wide.count() == 100


def test_coordinates_over_other_dimensions(spark):
    rows = spark.createDataFrame([(i, j, o, 10.0 * i + o, None if o == 3 else 5.0 * j) for i in range(3) for j in range(3) for o in (1, 2, 3)], "iline int, xline int, offset int, x double, y double")
    got = geometry.coordinates(rows, xy=("x", "y"))
    assert got.count() == 9 and {(r["iline"], r["x"], r["y"]) for r in got.collect()} == {(i, 10.0 * i + 2, 5.0 * j) for i in range(3) for j in range(3)}


def test_ends_of_a_line(spark):
    rows = spark.createDataFrame([(c, c * 2.0, 100.0 - c) for c in range(4, 30)], "cdp int, cdp_x double, cdp_y double")
    assert [tuple(r) for r in geometry.line_ends(rows).orderBy("corner").collect()] == [(0, 4, 8.0, 96.0), (1, 29, 58.0, 71.0)]


def test_clamped_crops():
    assert grid.clamp_crop([5, 10, 25, 35], [0, 20, 0, 28]) == [5, 10, 25, 28]
    assert grid.clamp_crop([0, 1000], [0, 2000]) == [0, 1000]
    for crop, limits in (([10, 5], [0, 20]), ([5, 10], [20, 0]), ([30, 40], [0, 20]), ([-5, -1], [0, 20])):
        with pytest.raises(ValueError):
            grid.clamp_crop(crop, limits)


def test_sparse_grid(spark):
    rows = survey(spark).where("(iline + xline) % 2 = 0")
    assert grid.dense(rows, ["iline", "xline"]).count() == 100
    assert grid.missing_cells(rows, ["iline", "xline"]).count() == 50
    grid.check_unique(rows, ["iline", "xline"])
    with pytest.raises(ValueError):
        grid.check_unique(rows, ["iline"])


@given(st.lists(st.floats(-100, 100), min_size=1, max_size=6))
@settings(max_examples=15, deadline=None)
def test_halfsample(spark, values):
    got = spark.range(1).select(traces.halfsampled(F.array(*map(F.lit, values))).alias("v")).first()["v"]
    assert len(got) == 2 * len(values) - 1
    assert np.allclose(got[::2], values) and np.allclose(got[1::2], (np.array(values[1:]) + values[:-1]) / 2)


# ---------------------------------------------------------------- geometry
@pytest.mark.parametrize("coefficients", [(2.5, 0.75, -0.75, 2.5, 1000.0, 500.0), (0.0, 12.5, 25.0, 0.0, -40.0, 7.0), (-3.0, 1.0, 2.0, 4.0, 0.0, 0.0)])
def test_affine_is_found_and_inverted(spark, coefficients):
    t = geometry.Affine(*coefficients)
    x, y = t.forward(F.col("iline"), F.col("xline"))
    rows = survey(spark, 6, 7).withColumns({"cdp_x": x, "cdp_y": y})
    found = geometry.affine_of(rows)
    assert np.allclose(found.matrix(), t.matrix(), atol=1e-6)
    i, j = found.inverse(F.col("cdp_x"), F.col("cdp_y"))
    worst = rows.select(F.max(F.abs(i - F.col("iline")) + F.abs(j - F.col("xline")))).first()[0]
    assert worst < 1e-6


def test_affine_of_one_line(spark):
    rows = survey(spark).where("iline = 3")
    t = geometry.affine_of(rows)
    x, y = t.forward(F.col("iline"), F.col("xline"))
    assert rows.select(F.max(F.abs(x - F.col("cdp_x")) + F.abs(y - F.col("cdp_y")))).first()[0] < 1e-5


def test_coordinate_scalars(spark):
    rows = spark.createDataFrame([(s, 10.0) for s in (100, 0, -1, -100)], "s int, x double")
    got = {r["s"]: (r["m"], r["b"]) for r in rows.select("s", geometry.multiplier(F.col("s")).alias("m"), geometry.multiplier(F.col("s"), inverse=True).alias("b")).collect()}
    assert got == {100: (100.0, 0.01), 0: (1.0, 1.0), -1: (1.0, 1.0), -100: (0.01, 100.0)}


@pytest.mark.parametrize("path,spacing", [([[0, 0], [0, 100]], 10), ([[0, 0], [10, 100]], 10), ([[0, 0], [0, 100], [100, 100]], 20)])
def test_uniform_spacing(spark, path, spacing):
    rows = spark.createDataFrame([(n, float(x), float(y)) for n, (x, y) in enumerate(path)], "seq int, x double, y double")
    got = geometry.uniform_spacing(rows, spacing, "seq", ["x", "y"]).orderBy("station").collect()
    assert len(got) == 11
    along = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(np.array(path, dtype=float), axis=0).T))])
    at = np.linspace(0, along[-1], 11)
    assert np.allclose([r["x"] for r in got], np.interp(at, along, [p[0] for p in path]))
    assert np.allclose([r["y"] for r in got], np.interp(at, along, [p[1] for p in path]))


def test_points_between_traces(spark):
    rows = survey(spark)
    points = spark.createDataFrame([(0, 5500.0, 13500.0), (1, 1000.0, 11000.0), (2, 0.0, 0.0), (3, 10000.0, 20000.0), (4, 5500.0, 11000.0)], "point int, x double, y double")
    axes = geometry.axis_of(rows, "iline"), geometry.axis_of(rows, "xline")
    linear = {r["point"]: r["samples"] for r in geometry.select_xy(rows, points, geometry.affine_of(rows), axes).collect()}
    assert linear[0][0] == 563.5 and linear[1][0] == 111.0 and linear[2] is None and linear[3][1] == 1020.5 and linear[4][0] == 561.0
    near = {r["point"]: r["samples"] for r in geometry.select_xy(rows, points, geometry.affine_of(rows), axes, method="nearest").collect()}
    assert near[0][0] == 513.0 and near[2] is None
    holes = rows.where("NOT (iline = 5 AND xline = 13)")
    assert {r["point"]: r["samples"] for r in geometry.select_xy(holes, points, geometry.affine_of(rows), axes).collect()}[0] is None
    with pytest.raises(ValueError):
        geometry.select_xy(rows, points, geometry.affine_of(rows), axes, method="cubic")


def test_surface(spark):
    rows = survey(spark).drop("samples")
    scattered = [(x * 1700.0 - 900, y * 2300.0 + 9000, 50.0) for x in range(8) for y in range(7)]
    flat = geometry.surface_from_points(rows, spark.createDataFrame(scattered, "cdp_x double, cdp_y double, h double"), "h")
    assert flat.agg(F.min("h"), F.max("h"), F.count("h")).first() == (pytest.approx(50), pytest.approx(50), 100)
    plane = spark.createDataFrame([(x, y, 2 * x - 3 * y) for x, y, _ in scattered], "cdp_x double, cdp_y double, h double")
    got = geometry.surface_from_points(rows, plane, "h").select(F.max(F.abs(F.col("h") - 2 * F.col("cdp_x") + 3 * F.col("cdp_y")))).first()[0]
    assert got < 1e-6
    outside = geometry.surface_from_points(rows, spark.createDataFrame(scattered[:3] + scattered[-1:], "cdp_x double, cdp_y double, h double"), "h")
    assert outside.where("h IS NULL").count() > 0
    near = geometry.surface_from_points(rows, plane, "h", method="nearest")
    assert near.where("h IS NULL").count() == 0
    with pytest.raises(ValueError):
        geometry.surface_from_points(rows, plane, "nothing")


@given(st.lists(st.integers(-5, 5), min_size=4, max_size=4), st.integers(4, 12))
def test_cubic_splines_hold_cubics(coefficients, n):
    y = np.polyval(coefficients, np.arange(n))
    at = np.linspace(0, n - 1, 17)
    assert np.allclose(splines.even(y[None], at[None])[0], np.polyval(coefficients, at), atol=1e-6 * (1 + np.abs(y).max()))
    assert np.isnan(splines.even(y[None], np.array([[-0.1, n - 0.9]]))).all()


def test_corners_of_a_sparse_survey(spark):
    got = geometry.corner_points(survey(spark).where("NOT (iline = 10 AND xline = 20)")).orderBy("corner").collect()
    assert [(r["iline"], r["xline"]) for r in got] == [(1, 11), (1, 20), (10, 20), (10, 11), (1, 11)]
    assert got[2]["cdp_x"] is None and got[3]["cdp_x"] == 10000


# ---------------------------------------------------------------- text
def test_text_lines():
    lines = text.as_lines({1: "first", 40: "last"})
    assert len(lines) == 40 and all(len(x) == 80 for x in lines)
    assert lines[0].startswith(b"C 1 first") and lines[39].startswith(b"C40 last")
    assert text.as_lines("C 1 here\nthere")[0].startswith(b"C 1 here")
    with pytest.warns(UserWarning):
        text.as_lines(["x" * 85])
    with pytest.warns(UserWarning):
        text.as_lines(b"x" * 4000)
    with pytest.raises(ValueError):
        text.as_lines(5)


def test_text_columns(spark):
    row = spark.createDataFrame([("abé\U0001f600", "C 1 x", "plain", 1536)], "a string, b string, c string, n long")
    got = row.select(text.fix_bad_chars(F.col("a")), text.has_counter(F.col("b")), text.has_counter(F.col("c")), text.human_bytes(F.col("n"))).first()
    assert tuple(got) == ("ab##", True, False, "1.5 KB")


def test_text_header_in_a_file(spark, tmp_path):
    path = str(tmp_path / "t.sgy")
    segy.write_traces(survey(spark), path, DIMS, text={3: "hello"})
    assert segy.head(path, "big").text.split("\n")[2].rstrip() == "C 3 hello"
    with open(path, "r+b") as f:
        f.write(b"ASCII".ljust(3200))
    assert segy.head(path, "big").text.startswith("ASCII")


# ---------------------------------------------------------------- volumes, command line, streams
def test_volume(spark, tmp_path):
    path = str(tmp_path / "v.sgy")
    segy.write_traces(survey(spark), path, DIMS, EXTRAS, dt=2.0, coord_scalar=-100.0)
    v = Volume.open_segy(spark, path, DIMS, EXTRAS)
    assert v.kind == "3d" and v.dt == 2.0
    assert v.sel(iline=5, xline=slice(12, 14)).traces.count() == 3
    assert v.sel(method="nearest", iline=5.4).traces.select("iline").distinct().first()[0] == 5
    assert {r["iline"] for r in v.isel(iline=[0, -1]).traces.select("iline").distinct().collect()} == {1, 10}
    assert v.isel(xline=slice(2, 4)).traces.count() == 20
    part = v.crop(iline=(1, 2), samples=(4.0, 9.0))
    assert part.ns0 == 4.0 and part.traces.select(F.max(F.size("samples"))).first()[0] == 3
    assert v.where(lambda a, z: z > 4).long().where("v IS NOT NULL").count() == 700
    assert v.stack("xline").count() == 100
    assert v.map_traces(lambda s: s.map(lambda a: [float(x) * 2 for x in a])).traces.where("iline = 1 AND xline = 11").first()["samples"][0] == 222.0
    s = v.scale_coords()
    assert s.traces.agg(F.max("cdp_x")).first()[0] == 100.0
    with pytest.raises(UserWarning):
        s.scale_coords()
    out = str(tmp_path / "w.sgy")
    assert s.to_segy(out) == 100
    assert segy.read_traces(spark, out, DIMS, EXTRAS).agg(F.max("cdp_x")).first()[0] == 10000
    v.save(str(tmp_path / "vol"), "iline")
    again = Volume.load(spark, str(tmp_path / "vol"))
    assert again.dims == ("iline", "xline") and again.traces.count() == 100 and again.dt == 2.0
    path_ = spark.createDataFrame([(0, 1000.0, 11000.0), (1, 10000.0, 20000.0)], "seq int, x double, y double")
    assert v.interp_line(path_, 1000.0).where("samples IS NOT NULL").count() == 13
    sparse = v.with_traces(v.traces.withColumns({c: F.when(F.col("iline") != 4, F.col(c)) for c in v.coords}))
    assert sparse.fill_coords().traces.where("abs(cdp_x - iline * 1000) > 1e-6").count() == 0
    horizon = v.traces.select("iline", "xline", F.lit(3.0).alias("z"))
    assert v.at_horizon(horizon, "z").where("iline = 1 AND xline = 11").first()["amplitude"] == 111.75
    finer = v.subsampled_labels(iline=1, xline=3)
    assert finer["iline"].count() == 19 and finer["xline"].count() == 73
    assert v.zeros_like().dead_traces(zeros=True).where("dead").count() == 100


def test_dimensions_are_selected_apart(spark):
    """Inline 2 alone has crossline 9, so a selection without it has no trace there."""
    rows = spark.createDataFrame([(i, x, [0.0]) for i in (1, 2, 3) for x in (4, 5, 9) if i == 2 or x < 9], "iline int, xline int, samples array<double>")
    v = Volume(rows, ("iline", "xline"))
    found = lambda v: sorted((r["iline"], r["xline"]) for r in v.traces.collect())
    assert found(v.isel(iline=[0, 2], xline=-1)) == [] and found(v.isel(iline=slice(0, 3, 2), xline=slice(1, 3))) == [(1, 5), (3, 5)]
    assert found(v.isel(xline=-1, iline=1)) == found(v.isel(iline=1, xline=2)) == [(2, 9)]
    assert found(v.sel(iline=1, xline=9)) == found(v.sel(iline=[1, 3], xline=[9])) == [] and found(v.sel(method="nearest", iline=1, xline=8)) == []
    holes = v.with_traces(rows.unionByName(spark.createDataFrame([(None, None, [0.0])], rows.schema)))
    assert found(holes.isel(iline=0, xline=-2)) == [(1, 5)]


def test_midpoints_of_a_long_axis(spark, monkeypatch):
    """Labels in many ranges, none of which gathers the axis, and values that no round makes more than once."""
    labels = [3 * i + i % 2 for i in range(501)]
    v = Volume(spark.createDataFrame([(i, [0.0]) for i in [*labels, None, 0]], "cdp int, samples array<double>"), ("cdp",))
    for few in (100_000, 50):
        monkeypatch.setattr(grid, "FEW_ROWS", few)
        finer = v.subsampled_labels(cdp=2)["cdp"]
        assert sorted(r["cdp"] for r in finer.collect()) == np.interp(np.arange(2001) / 4, np.arange(501), labels).tolist()
        assert "collect_set" not in finer._jdf.queryExecution().optimizedPlan().toString()
    assert v.with_traces(v.traces.where("cdp = 3000")).subsampled_labels(cdp=1)["cdp"].count() == 0
    assert [r["cdp"] for r in v.with_traces(v.traces.where("cdp = 0")).subsampled_labels(cdp=3)["cdp"].collect()] == [0.0]
    assert str(traces.subsampled(F.col("labels"), 4)).count("labels") == 1
    assert spark.range(1).select(traces.subsampled(F.array(F.lit(0), F.lit(8)), 3).alias("v")).first()["v"] == [float(i) for i in range(9)]


def test_volumes_on_other_grids(spark):
    rows = survey(spark)
    v = Volume(rows, ("iline", "xline"), 0.0, 2.0)
    x, y = geometry.affine_of(rows).forward(F.col("a") + 0.5, F.col("b") + 0.25)
    cells = spark.createDataFrame([(1, 11), (9, 19), (10, 11), (4, 30), (2, 12)] * 2, "a int, b int").withColumns({"x": x, "y": y})
    cells = cells.withColumns({c: F.when(F.col("a") != 2, F.col(c)) for c in "xy"})
    on = v.regrid_on(Volume(cells.where("a <> 2"), ("a", "b"), coords=("x", "y")))
    got = {(r["iline"], r["xline"]): r["samples"] for r in on.traces.collect()}
    assert len(got) == 4 and got[10, 11] is None and got[4, 30] is None
    first = {(r["iline"], r["xline"]): r["samples"][0] for r in rows.collect()}
    want = lambda i, j: 0.5 * (0.75 * first[i, j] + 0.25 * first[i, j + 1]) + 0.5 * (0.75 * first[i + 1, j] + 0.25 * first[i + 1, j + 1])
    assert got[1, 11][0] == pytest.approx(want(1, 11)) and got[9, 19][0] == pytest.approx(want(9, 19))
    # cells without coordinates and repeated ones
    axes = v.axes()
    renamed = rows.withColumnsRenamed({"iline": "a", "xline": "b"})
    plain = {(r["a"], r["b"]): r["samples"] for r in geometry.regridded(renamed, cells, v.affine(), axes, ("a", "b"), ("x", "y")).collect()}
    assert plain[2, 12] is None and plain[1, 11][0] == pytest.approx(want(1, 11))
    other = Volume(spark.createDataFrame([(1.5, 11.0, [0.0] * 3), (10.0, 20.0, [0.0] * 2), (0.0, 11.0, [0.0])], "i double, x double, samples array<double>"), ("i", "x"), 1.0, 3.0)
    like = v.interp_like(other)
    found = {(r["iline"], r["xline"]): r["samples"] for r in like.traces.collect()}
    assert like.ns0 == 1.0 and like.dt == 3.0 and found[0.0, 11.0] is None
    there = [r["samples"] for r in rows.where("iline IN (1, 2) AND xline = 11").collect()]
    assert found[1.5, 11.0] == pytest.approx([np.interp(z / 2, range(len(there[0])), np.mean(there, axis=0)) for z in (1.0, 4.0, 7.0)])
    assert v.interp_like(other, "nearest").traces.count() == 3


def test_command_line(spark, tmp_path, capsys):
    path, out = str(tmp_path / "in.sgy"), str(tmp_path / "out.sgy")
    segy.write_traces(survey(spark), path, DIMS, EXTRAS)
    assert cli.main(["-f", path, "sgy", "-d", "iline", "189", "-d", "xline", "193", "crop", "-c", "iline", "3", "5", "sgy", "-o", out], spark) == 0
    assert segy.read_traces(spark, out, DIMS).count() == 30
    assert cli.main(["-f", path, "ebcidc"], spark) == 0 and "C 1" in capsys.readouterr().out
    assert cli.main(["-f", path, "scan", "-m", "10"], spark) == 0 and "INLINE_3D" in capsys.readouterr().out
    assert cli.main(["-f", path, "scrape", "-o", str(tmp_path / "s")], spark) == 0 and os.path.exists(tmp_path / "s.head.csv") and os.path.exists(tmp_path / "s.txt")
    assert cli.main(["scan"], spark) == 0
    with pytest.raises(SystemExit):
        cli.main(["-f", path, "nonsense"], spark)


def test_points_file(spark, tmp_path):
    (tmp_path / "well.txt").write_text("# a comment\n 1.0  2.0\t3.5\n\n4 5 6\n")
    assert [tuple(r) for r in tables.read_points(spark, str(tmp_path / "well.txt"), ["x", "y", "z"]).collect()] == [(1.0, 2.0, 3.5), (4.0, 5.0, 6.0)]
    assert tables.file_type("a.SEGY") == "segy" and tables.file_type("b.volume") == "volume" and tables.file_type("c.txt") is None


def test_streams(spark, tmp_path):
    rows = survey(spark).withColumn("ts", F.timestamp_seconds(F.col("iline") * 3600)).withColumn("samples", F.when(F.col("xline") == 11, F.transform("samples", lambda v: F.lit(0.0).cast("float"))).otherwise(F.col("samples")))
    rows.write.parquet(str(tmp_path / "in"))
    stream = streams.arriving_traces(spark, str(tmp_path / "in"), rows.schema, 1)
    q = streams.running_stats(stream, ["iline", "xline"]).writeStream.outputMode("complete").format("memory").queryName("running").start()
    q2 = streams.dead_counts(stream, "ts", late="10 days").writeStream.outputMode("update").format("memory").queryName("dead").start()
    for x in (q, q2):
        x.processAllAvailable()
        x.stop()
    assert {tuple(r) for r in spark.table("running").collect()} == {("iline", 100, 5.5, 1.0, 10.0), ("xline", 100, 15.5, 11.0, 20.0)}
    ends = spark.table("dead").groupBy("window").agg(F.max("dead").alias("dead"), F.max("live").alias("live")).collect()
    assert len(ends) == 10 and all((r["dead"], r["live"]) == (1, 9) for r in ends)
