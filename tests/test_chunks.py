"""Functions of chunks, the chunked store and the header index."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgrid.operators import chunks, stats
from loamgrid.sources import segy
from loamgrid.volume import Volume

from .test_library import DIMS, EXTRAS, survey


def smooth(a):
    """Mean over three along every axis of what is there."""
    padded = np.pad(a, 1, constant_values=np.nan)
    parts = [padded]
    for axis in range(a.ndim):
        parts = [np.take(p, range(k, k + a.shape[axis]), axis) for p in parts for k in range(3)]
    with np.errstate(invalid="ignore"):
        return np.nansum(parts, axis=0) / np.sum(~np.isnan(parts), axis=0)


@pytest.mark.parametrize("sizes,depth", [({"a": 3, "b": 4}, None), ({"a": 100, "b": 100}, None), ({"a": 2, "b": 1}, (4, 1)), ({"a": 7, "b": 7}, (3, 3))])
def test_functions_of_chunks(spark, sizes, depth):
    rng = np.random.default_rng(1)
    labels = [2, 3, 5, 8, 9, 12, 20], ["p", "q", "r", "s", "t", "u"]
    whole = rng.random((7, 6, 10))
    whole[rng.random((7, 6)) < 0.2] = np.nan
    whole[0, 0, 3] = np.nan
    rows = [(a, b, [None if np.isnan(v) else float(v) for v in whole[i, j]], f"{a}{b}") for i, a in enumerate(labels[0]) for j, b in enumerate(labels[1]) if not np.isnan(whole[i, j]).all()]
    # every label is there once at least
    assert len({r[0] for r in rows}) == 7 and len({r[1] for r in rows}) == 6
    frame = spark.createDataFrame(rows, "a int, b string, samples array<double>, name string")
    got = {(r["a"], r["b"]): r for r in chunks.mapped(frame, ["a", "b"], smooth, sizes, {"a": 1, "b": 1}, depth).collect()}
    want = smooth(whole)
    assert len(got) == len(rows)
    for i, a in enumerate(labels[0]):
        for j, b in enumerate(labels[1]):
            if (a, b) in got:
                assert got[a, b]["name"] == f"{a}{b}" and np.allclose(got[a, b]["samples"], want[i, j])


def test_chunks_are_checked(spark):
    frame = survey(spark)
    for wrong in ({"iline": 3}, {"iline": 0, "xline": 3}, {"iline": 10**5, "xline": 10**5}):
        with pytest.raises(ValueError):
            chunks.mapped(frame, ["iline", "xline"], smooth, wrong)
    with pytest.raises(ValueError):
        chunks.mapped(frame, ["iline", "xline"], smooth, {"iline": 2, "xline": 2}, {"iline": 3})
    assert chunks.mapped(frame.limit(0), ["iline", "xline"], smooth, {"iline": 2, "xline": 2}).count() == 0
    volume = Volume(frame, ("iline", "xline")).map_chunks(lambda a: a * 2, {"iline": 4, "xline": 4})
    assert volume.traces.join(frame.withColumnRenamed("samples", "s"), ["iline", "xline"]).where("samples[3] <> 2 * s[3]").count() == 0


def test_crops_of_a_chunked_store_read_few_files(spark, tmp_path):
    rows = survey(spark, 32, 32, 4)
    Volume(rows, ("iline", "xline")).save(str(tmp_path / "v"), chunks={"iline": 4, "xline": 4}, files=16)
    back = Volume.load(spark, str(tmp_path / "v"))
    assert back.traces.count() == 1024
    for crop in ("iline <= 8", "xline <= 18", "iline > 24", "iline <= 16 AND xline <= 26"):
        own = back.traces.where(crop)
        names = own.select(F.input_file_name().alias("f")).distinct().count()
        assert 0 < names <= 8, crop
        assert "PushedFilters: [" in own._jdf.queryExecution().executedPlan().toString()
    assert {r["n"] for r in back.traces.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()} == {64}


def test_header_index_skips_blocks(spark, tmp_path):
    path, index = str(tmp_path / "a.sgy"), str(tmp_path / "index")
    segy.write_traces(survey(spark, 20, 20), path, DIMS, EXTRAS)
    segy.write_index(spark, path, index, block=20)
    options = {"path": path, "index": index, "dims": "iline=189,xline=193", "where": '[["iline", ">=", 5], ["iline", "<=", 7]]'}
    schema = segy.SegyDataSource(options).schema()
    parts = segy.SegyReader(schema, options).partitions()
    assert [(p.start, p.stop) for p in parts] == [(80, 140)]
    both = segy.SegyReader(schema, options | {"where": '[["iline", "in", [2, 9]], ["xline", "==", 12]]'}).partitions()
    assert [(p.start, p.stop) for p in both] == [(20, 40), (160, 180)]
    assert segy.SegyReader(schema, options | {"where": '[["iline", ">", 20]]'}).partitions()[0].stop == 0
    crop = Volume.open_segy(spark, path, DIMS, EXTRAS, index=index).crop(iline=(5, 7), xline=(12, 13))
    assert sorted((r["iline"], r["xline"]) for r in crop.traces.collect()) == [(i, j) for i in (5, 6, 7) for j in (12, 13)]
    # a file that has changed is read whole
    os.utime(path, ns=(1, 1))
    with pytest.warns(UserWarning, match="read whole"):
        assert sum(p.stop - p.start for p in segy.SegyReader(schema, options).partitions()) == 400


def test_arguments_and_squeezed_dimensions(spark, tmp_path):
    path = str(tmp_path / "a.sgy")
    rows = survey(spark, 1, 4)
    segy.write_traces(rows, path, DIMS, EXTRAS)
    for dims, extras, more in (({}, {}, {}), (DIMS, {"iline": 5}, {}), ({"a": 189, "b": 189}, {}, {}), (DIMS, {}, {"first": 5, "last": 2}), (DIMS, {}, {"colour": 1})):
        with pytest.raises(ValueError):
            Volume.open_segy(spark, path, dims, extras, **more)
    volume = Volume.open_segy(spark, path, DIMS, EXTRAS)
    flat = volume.squeeze()
    assert flat.dims == ("xline",)
    assert flat.to_segy(str(tmp_path / "b.sgy")) == 4
    assert {r["iline"] for r in Volume.open_segy(spark, str(tmp_path / "b.sgy"), DIMS).traces.collect()} == {1}
    with pytest.raises(ValueError):
        volume.rename(xline="other").to_segy(str(tmp_path / "c.sgy"))
    with pytest.raises(KeyError):
        volume.sel(iline=999)
    with pytest.raises(KeyError):
        volume.sel(samples=0.4)
    assert volume.sel(xline=[11, 13]).traces.count() == 2
    holes = volume.with_traces(volume.traces.where("xline <> 12").unionByName(volume.traces.where("xline = 12").withColumn("iline", F.lit(2))))
    assert holes.zeros_like().traces.count() == 8 and holes.zeros_like().traces.where("forall(samples, v -> v = 0)").count() == 8


def test_samples_are_written_into_a_file_and_a_failed_job_goes_on(spark, tmp_path):
    path, manifest = str(tmp_path / "a.sgy"), str(tmp_path / "done")
    rows = survey(spark, 10, 10, 8)
    segy.write_traces(rows, path, DIMS, EXTRAS, sample_format=5)
    before = {r["tracen"]: r["samples"] for r in segy.read_traces(spark, path).collect()}
    new = spark.range(100).select(F.col("id").alias("tracen"), F.array(*[(F.col("id") + k).cast("float") for k in range(3)]).alias("samples"))
    broken = new.withColumn("samples", F.when(F.col("tracen") == 55, F.slice("samples", 1, 2)).otherwise(F.col("samples")))
    with pytest.raises(Exception, match="one length"):
        segy.write_samples(broken, path, 2, 10, manifest)
    assert not os.path.exists(os.path.join(manifest, "5"))
    done = {int(n) for n in os.listdir(manifest)}
    left = segy.write_samples(new, path, 2, 10, manifest)
    assert left == 100 - 10 * len(done) and {int(n) for n in os.listdir(manifest)} == set(range(10))
    assert segy.write_samples(new, path, 2, 10, manifest) == 0
    for r in segy.read_traces(spark, path, DIMS).collect():
        t = r["tracen"]
        assert r["samples"] == before[t][:2] + [t, t + 1, t + 2] + before[t][5:]
    for wrong in (new.withColumn("tracen", F.col("tracen") + 1), new.withColumn("samples", F.array_repeat(F.lit(0.0), 7))):
        with pytest.raises(Exception, match="the file has|one length"):
            segy.write_samples(wrong, path, 2)


def test_sketches_merge(spark):
    rng = np.random.default_rng(9)
    values = rng.normal(size=40_000)
    frame = spark.createDataFrame([(i % 7, float(v)) for i, v in enumerate(values)] + [(1, None), (2, float("nan")), (99, None)], "k int, v double").repartition(6)
    sketches = stats.sketched(frame, ["k"], "v")
    assert sketches.count() == 7
    own = np.sort(values[np.arange(40_000) % 7 < 4])
    got = {r["share"]: r for r in stats.sketched_percentiles(sketches.where("k < 4"), [0.0, 0.25, 0.5, 0.99, 1.0]).collect()}
    assert got[0.0]["value"] == own[0] and got[1.0]["value"] == own[-1] and {r["n"] for r in got.values()} == {len(own)}
    assert all(abs(np.searchsorted(own, r["value"]) / len(own) - share) <= 2 * stats.rank_error(1000) for share, r in got.items())
    assert stats.sketched_percentiles(sketches, [0.5], ["k"]).count() == 7
    assert stats.sketched_percentiles(sketches.limit(0), [0.5]).count() == 0
