"""SEG-Y files written from the driver's tables and read again, volumes on them, and checks of names."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import keys
from ..functions import text
from ..operators import geometry, grid, stats, traces
from ..sources import segy, tables
from ..volume import Volume
from ..workspace import shared_folder
from . import views
from .registry import query, r6, table

B = "WITH" + views.BLOCK
DIMS, EXTRAS = {"iline": 189, "xline": 193}, {"x": 181, "y": 185}
NS0, DT, SCALAR = 100.0, 4.0, -100.0
NUMBER = "CAST(row_number() OVER (ORDER BY iline, xline) - 1 AS BIGINT)"


def _folder(spark: SparkSession) -> str:
    folder = shared_folder(spark).removeprefix("file:")
    os.makedirs(folder)
    return folder


def _file(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None, **more) -> str:
    """The volume in a file: IEEE floats, coordinates in hundredths, an axis from 100 ms in steps of 4."""
    path = f"{_folder(spark)}/volume.sgy"
    options = {"ns0": NS0, "dt": DT, "sample_format": 5, "coord_scalar": SCALAR, "scaled": ("x", "y")} | more
    segy.write_traces(views.block(spark, sf_dir) if rows is None else rows, path, DIMS, EXTRAS, **options)
    return path


@query(B + f" SELECT {NUMBER} AS tracen, iline, xline, round(list_sum(samples), 5) + 0 AS total FROM blk WHERE tracen % 5 <> 0")
def segy_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live traces written in the order of the dimensions and read again."""
    rows = segy.read_traces(spark, _file(spark, sf_dir, dead=F.col("tracen") % 5 == 0), DIMS)
    return rows.select("tracen", "iline", "xline", (F.round(traces.total(F.col("samples")), 5) + 0.0).alias("total"))


@query(B + " SELECT iline, xline, CAST(len(samples[6:21]) AS INTEGER) AS n, round(list_sum(samples[6:21]), 5) + 0 AS total FROM blk WHERE iline IN (1, 4, 7) AND xline >= 3 AND xline < 20")
def segy_block_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions on headers and a range of samples, applied by the reader."""
    rows = segy.read_traces(spark, _file(spark, sf_dir), DIMS, where=[("iline", "in", [1, 4, 7]), ("xline", ">=", 3), ("xline", "<", 20)], first=5, last=20)
    return rows.select("iline", "xline", F.size("samples").alias("n"), (F.round(traces.total(F.col("samples")), 5) + 0.0).alias("total"))


HEADERS = ["TRACE_SEQUENCE_FILE", "INLINE_3D", "CROSSLINE_3D", "CDP_X", "CDP_Y", "offset", "TRACE_SAMPLE_COUNT", "TRACE_SAMPLE_INTERVAL", "DelayRecordingTime", "SourceGroupScalar"]


@query(B + f" SELECT {NUMBER} AS tracen, CAST({NUMBER} + 1 AS INTEGER) AS TRACE_SEQUENCE_FILE, iline AS INLINE_3D, xline AS CROSSLINE_3D, CAST(round(x * 100) AS INTEGER) AS CDP_X, CAST(round(y * 100) AS INTEGER) AS CDP_Y, "
       '1 AS "offset", 64 AS TRACE_SAMPLE_COUNT, 4000 AS TRACE_SAMPLE_INTERVAL, 100 AS DelayRecordingTime, -100 AS SourceGroupScalar FROM blk')  # fmt: skip
def segy_trace_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header fields by name and by byte."""
    names = [181 if n == "CDP_X" else n for n in HEADERS]
    return segy.read_headers(spark, _file(spark, sf_dir), names=names).select("tracen", *HEADERS)


#: Fields that the writer fills, by the lowest and the highest of their values in SQL.
FILLED = {"TRACE_SEQUENCE_LINE": ("1", "count(*)"), "TRACE_SEQUENCE_FILE": ("1", "count(*)"), "offset": ("1", "1"), "INLINE_3D": ("min(iline)", "max(iline)"), "CROSSLINE_3D": ("min(xline)", "max(xline)"), "CDP_X": ("min(round(x * 100))", "max(round(x * 100))"), "CDP_Y": ("min(round(y * 100))", "max(round(y * 100))"), "TRACE_SAMPLE_COUNT": ("64", "64"), "TRACE_SAMPLE_INTERVAL": ("4000", "4000"), "DelayRecordingTime": ("100", "100"), "SourceGroupScalar": ("-100", "-100")}


@query(B + " " + " UNION ALL ".join(f"SELECT {b} AS byte, '{n}' AS field, count(*) AS n, CAST({FILLED.get(n, '00')[0]} AS DOUBLE) AS low, CAST({FILLED.get(n, '00')[1]} AS DOUBLE) AS high FROM blk" for b, (n, _) in keys.TRACE_FIELDS.items()))
def segy_all_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 91 fields of the trace headers, with their lowest and highest values, as the command line's scan lists them."""
    found = stats.header_stats(segy.read_headers(spark, _file(spark, sf_dir)).drop("tracen"))
    byte = F.create_map(*[F.lit(v) for n, b in keys.FIELD_BYTES.items() for v in (n, b)])[F.col("field")]
    return found.select(byte.alias("byte"), "field", "n", F.col("min").alias("low"), F.col("max").alias("high"))


@query(B + " SELECT count(*) AS n, min(iline) AS low, max(iline) AS high FROM (SELECT iline FROM blk ORDER BY iline, xline LIMIT 120)")
def segy_first_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partial scan: the first 120 traces of the file."""
    heads = segy.read_headers(spark, _file(spark, sf_dir), traces=120, names=["INLINE_3D"])
    return heads.agg(F.count("*").alias("n"), F.min("INLINE_3D").alias("low"), F.max("INLINE_3D").alias("high"))


@query("SELECT count(*) AS ntraces, 64 AS ns, 4.0e0 AS dt, 100.0e0 AS ns0, 5 AS format, 'm' AS units, -100.0e0 AS coord_scalar, 4000 AS interval, CAST(count(*) % 32768 AS INTEGER) AS traces, 256 AS revision FROM embeddings")
def segy_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, axis, units and binary header of a file."""
    meta = segy.read_meta(spark, _file(spark, sf_dir))
    more = [F.get_json_object("binary", f"$.{k}").cast("int").alias(n) for k, n in (("Interval", "interval"), ("Traces", "traces"), ("SEGYRevision", "revision"))]
    return meta.select("ntraces", "ns", "dt", "ns0", "format", "units", "coord_scalar", *more)


@query("SELECT CAST(r.i AS INTEGER) AS line, rtrim('C' || lpad(CAST(r.i AS VARCHAR), 2, ' ') || ' ' || coalesce(t.name, '')) AS text FROM range(1, 41) r(i) LEFT JOIN (SELECT n_nationkey + 1 AS k, n_name AS name FROM nation) t ON t.k = r.i")
def segy_text_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text header of a file, in EBCDIC: a line for each nation."""
    names = {r["n_nationkey"] + 1: r["n_name"] for r in table(spark, sf_dir, "nation").collect() if r["n_nationkey"] < 40}  # 40 lines at most
    lines = segy.read_meta(spark, _file(spark, sf_dir, text=names)).select(F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return lines.select((F.col("line") + 1).alias("line"), F.rtrim("text").alias("text"))


@query(B + " SELECT iline % 3 AS file, CAST(row_number() OVER (PARTITION BY iline % 3 ORDER BY iline, xline) - 1 AS BIGINT) AS tracen, iline, xline, samples[1] AS v FROM blk")
def segy_many_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three files, read as one."""
    folder = _folder(spark)
    for k in range(3):
        segy.write_traces(views.block(spark, sf_dir).where(F.col("iline") % 3 == k), f"{folder}/part{k}.sgy", DIMS, sample_format=5)
    rows = segy.read_traces(spark, folder, DIMS)
    return rows.select(F.regexp_extract("file", r"part(\d)", 1).cast("int").alias("file"), "tracen", "iline", "xline", F.get("samples", F.lit(0)).cast("double").alias("v"))


@query(B + " SELECT iline, xline, x, y FROM blk")
def segy_scaled_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates through the headers' integers and their scalar."""
    v = Volume.open_segy(spark, _file(spark, sf_dir), DIMS, EXTRAS).infer_coords().scale_coords()
    return v.traces.select("iline", "xline", "x", "y")


@query(B + " SELECT iline, xline, round(list_sum([round(v * 1024) / 1024 * (1 + i % 3) FOR v, i IN samples]), 6) + 0 AS total FROM blk")
def segy_ibm_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of 1/1024 steps, which IBM floats hold exactly."""
    rows = views.block(spark, sf_dir).withColumn("samples", F.transform("samples", lambda v: F.floor(F.abs(v) * 1024 + 0.5) * F.signum(v) / 1024))
    back = segy.read_traces(spark, _file(spark, sf_dir, rows, sample_format=1), DIMS)
    return back.select("iline", "xline", r6(traces.total(F.transform("samples", lambda v, i: v.cast("double") * (1 + (i + 1) % 3)))).alias("total"))


@query(B + " SELECT iline, xline, CAST(list_sum([trunc(v * 1000) FOR v IN samples]) AS BIGINT) AS total, CAST(trunc(samples[7] * 1000) AS INTEGER) AS seventh FROM blk")
def segy_small_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples as little-endian 16-bit integers."""
    rows = views.block(spark, sf_dir).withColumn("samples", F.transform("samples", lambda v: (v * 1000).cast("int").cast("double")))
    back = segy.read_traces(spark, _file(spark, sf_dir, rows, sample_format=3, endian="little"), DIMS, endian="little")
    return back.select("iline", "xline", traces.total(F.col("samples")).cast("long").alias("total"), F.get("samples", F.lit(6)).cast("int").alias("seventh"))


@query(B + " SELECT iline, xline, CAST(round(x * 100) AS INTEGER) AS cdp_x FROM blk WHERE xline = 5")
def segy_named_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file by a well-known layout of bytes."""
    segy.register(spark)
    rows = spark.read.format("segy").option("layout", "standard_3d").option("headersOnly", "true").load(_file(spark, sf_dir))
    return rows.where("xline = 5").select("iline", "xline", "cdp_x")


@query(B + " SELECT iline, xline, round(list_sum(samples), 5) + 0 AS total FROM blk WHERE (iline + xline) % 7 = 0")
def segy_kept_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces that a filtered header table names, of which alone the samples are read."""
    path = _file(spark, sf_dir)
    heads = segy.read_headers(spark, path, names=["INLINE_3D", "CROSSLINE_3D"]).where("(INLINE_3D + CROSSLINE_3D) % 7 = 0")
    rows = segy.read_traces(spark, path, DIMS, keep=heads.select("tracen"))
    return rows.select("iline", "xline", (F.round(traces.total(F.col("samples")), 5) + 0.0).alias("total"))


@query(B + " SELECT iline, xline, CAST(k AS INTEGER) AS k, 100 + 4.0e0 * (k + 3) AS z, samples[k + 4] AS v FROM blk, range(5) t(k) WHERE iline BETWEEN 2 AND 5 AND xline BETWEEN 3 AND 12")
def volume_crop_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crop of a file along all three axes."""
    v = Volume.open_segy(spark, _file(spark, sf_dir), DIMS).crop(iline=(2, 5), xline=(3, 12), samples=(112.0, 128.0))
    return v.long().select("iline", "xline", "k", "z", F.col("v").cast("double").alias("v"))


@query(B + " SELECT iline, xline FROM blk WHERE xline = 7 AND iline IN (0, 3, 9)")
def volume_sel_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by the nearest and by a list."""
    v = Volume.open_segy(spark, _file(spark, sf_dir), DIMS).sel(method="nearest", xline=7.4).sel(iline=[0, 3, 9])
    return v.traces.select("iline", "xline")


@query(B + ", p AS (SELECT iline, dense_rank() OVER (ORDER BY iline) - 1 AS q FROM (SELECT DISTINCT iline FROM blk)) SELECT blk.iline, xline FROM blk JOIN p ON p.iline = blk.iline WHERE (q % 2 = 1 AND q < 8) AND xline = (SELECT max(xline) FROM blk)")
def volume_isel_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by their places: a slice with a step, and the last one."""
    v = Volume.open_segy(spark, _file(spark, sf_dir), DIMS).isel(iline=slice(1, 8, 2), xline=-1)
    return v.traces.select("iline", "xline")


@query("WITH" + views.VOLUME + ", e AS (SELECT min(iline) AS i0, max(iline) - min(iline) + 1 AS ni, min(xline) AS j0, max(xline) - min(xline) + 1 AS nj FROM emb) SELECT i0 + i AS iline, j0 + 2 * j AS xline, 2.0e0 + 2 * o AS \"offset\", 7 AS n, true AS empty FROM (SELECT *, unnest(range(ni)) AS i FROM e) JOIN (SELECT unnest(range(nj)) AS j FROM e) ON true, range(3) t(o)")
def blank_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A regular pre-stack grid without values, as many inlines and crosslines as the volume has."""
    e = views.volume(spark, sf_dir).agg(*[f(c).alias(f"{k}_{c}") for c in ("iline", "xline") for k, f in (("a", F.min), ("b", F.max))]).first()
    v = Volume.blank(spark, {"iline": (e["a_iline"], 1, e["b_iline"] - e["a_iline"] + 1), "xline": (e["a_xline"], 2, e["b_xline"] - e["a_xline"] + 1), "offset": [2.0, 4.0, 6.0]}, 7)
    return v.traces.select(F.col("iline").cast("long").alias("iline"), F.col("xline").cast("long").alias("xline"), F.col("offset").cast("double").alias("offset"), F.size("samples").alias("n"), grid.dead(F.col("samples")).alias("empty"))


@query("SELECT CAST(row_number() OVER () AS BIGINT) AS cdp, 11 AS n, 0.0e0 AS total FROM customer")
def blank_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A regular 2-D line of zeros with a place for each customer."""
    v = Volume.blank(spark, {"cdp": (1, 1, table(spark, sf_dir, "customer").count())}, 11, value=0.0, domain="DEPTH", units="m")
    return v.traces.select(F.col("cdp").cast("long").alias("cdp"), F.size("samples").alias("n"), traces.total(F.col("samples")).alias("total"))


@query("WITH" + views.VOLUME + " SELECT iline, xline, 64 AS n, 0.0e0 AS total FROM (SELECT DISTINCT iline FROM emb), (SELECT DISTINCT xline FROM emb)")
def volume_zeros_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Volume(views.volume(spark, sf_dir), ("iline", "xline")).zeros_like()
    return v.traces.select("iline", "xline", F.size("samples").alias("n"), traces.total(F.col("samples")).alias("total"))


@query("WITH" + views.VOLUME + " SELECT iline AS inline, xline, samples[2] AS v, 'twt' AS vertical, 8.0e0 AS ns0 FROM emb")
def volume_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A volume written as a table with its metadata, read again and renamed."""
    path = f"{_folder(spark)}/volume"
    Volume(views.volume(spark, sf_dir), ("iline", "xline"), 8.0, 4.0, "twt", {"units": "ms"}).save(path, partition="iline")
    v = Volume.load(spark, path).rename(iline="inline")
    return v.traces.select("inline", "xline", F.get("samples", F.lit(1)).alias("v"), F.lit(v.vertical).alias("vertical"), F.lit(v.ns0).alias("ns0"))


@query("WITH" + views.SURVEY + " SELECT conv_id, turn, x, y FROM srv WHERE x IS NOT NULL")
def points_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A horizon as text with comments and columns of uneven width, read again."""
    rows = views.survey(spark, sf_dir).where("x IS NOT NULL")
    line = F.concat(F.lit("  "), F.col("conv_id").cast("string"), F.lit("\t"), F.col("turn").cast("string"), F.lit("   "), F.col("x").cast("string"), F.lit(" "), F.col("y").cast("string"))
    path = f"{_folder(spark)}/horizon"
    rows.select(F.explode(F.array(F.lit("# a horizon"), line)).alias("value")).write.text(path)
    points = tables.read_points(spark, path, ["conv_id", "turn", "x", "y"])
    return points.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "x", "y")


@query("SELECT vec_id AS cdp FROM embeddings WHERE vec_id BETWEEN 20 AND 90")
def crop_cdp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crop of a 2-D line by its places."""
    line = Volume(views.volume(spark, sf_dir).withColumnRenamed("tracen", "cdp"), ("cdp",))
    return line.crop(cdp=(20, 90)).traces.select("cdp")


@query("WITH" + views.VOLUME + ", l AS (SELECT DISTINCT xline FROM emb), h AS (SELECT xline AS v, lead(xline) OVER (ORDER BY xline) AS n FROM l) SELECT v * 1.0e0 AS xline FROM h UNION ALL SELECT v + (n - v) * f FROM h, (VALUES (0.25e0), (0.5e0), (0.75e0)) t(f) WHERE n IS NOT NULL")
def subsampled_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crosslines with midpoints added twice."""
    return Volume(views.volume(spark, sf_dir), ("iline", "xline")).subsampled_labels(xline=2)["xline"].select(F.col("xline").cast("double").alias("xline"))


@query("""SELECT c_custkey, CASE WHEN cdp AND NOT (iline OR xline) THEN '2d' WHEN (iline OR xline) AND NOT cdp THEN '3d' END || CASE WHEN gath THEN 'gath' ELSE '' END AS kind
FROM (SELECT c_custkey, c_custkey % 2 = 0 AS cdp, c_custkey % 3 = 0 AS iline, c_custkey % 5 < 2 AS xline, c_custkey % 7 < 3 AS gath FROM customer)""")  # fmt: skip
def dimension_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2-D or 3-D, stacked or not, by the names of dimensions, of which each customer has some."""
    n = F.col("c_custkey")
    names = F.array_compact(F.array(*[F.when(has, d) for d, has in (("cdp", n % 2 == 0), ("iline", n % 3 == 0), ("xline", n % 5 < 2), ("offset", n % 7 < 3))]))
    return table(spark, sf_dir, "customer").select("c_custkey", keys.kind_of(names).alias("kind"))


@query("SELECT p_partkey, p_partkey % 300 IN (" + ", ".join(map(str, keys.TRACE_FIELDS)) + ") AS valid FROM part")
def field_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of trace headers at which a field begins."""
    return table(spark, sf_dir, "part").select("p_partkey", keys.is_field_byte(F.col("p_partkey") % 300).alias("valid"))


@query(r"SELECT doc_id, lang, rpad(left(lang || ' ' || source || ' ' || repeat('ab', 50), 80), 80, ' ') AS cut FROM documents")
def text_cut_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a file's text header, cut to 80 bytes each."""
    lines = table(spark, sf_dir, "documents").select("doc_id", "lang", F.concat_ws(" ", "lang", "source", F.repeat(F.lit("ab"), 50)).alias("x"))
    return lines.select("doc_id", "lang", text.cut_bytes(F.col("x")).cast("string").alias("cut"))


@query("SELECT n_nationkey AS k, left(n_name || repeat(' long', 30), 75) AS v FROM nation WHERE n_nationkey BETWEEN 1 AND 40")
def text_clean_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of header lines without lines that a header doesn't have, cut to 75 characters."""
    entry = F.create_map("n_nationkey", F.concat("n_name", F.repeat(F.lit(" long"), 30)))
    return table(spark, sf_dir, "nation").select(F.explode(text.clean_map(entry)).alias("k", "v"))


@query("WITH" + views.VOLUME + " SELECT iline, xline, k, round(s, 6) + 0 AS v FROM (SELECT xline, k, avg(v) AS s FROM lng WHERE iline = 4 GROUP BY 1, 2) JOIN (SELECT DISTINCT iline, xline FROM emb) USING (xline)")
def squeeze_and_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One inline without its dimension, repeated along all inlines."""
    v = Volume(views.volume(spark, sf_dir).drop("tracen"), ("iline", "xline"))
    one = v.sel(iline=4).squeeze()
    return one.broadcast_like(v).long().select("iline", "xline", "k", r6("v").alias("v"))


@query("WITH" + views.SURVEY + ", c AS (SELECT turn, avg(x) AS x, avg(y) AS y FROM srv GROUP BY 1) SELECT turn, round(x, 6) + 0 AS x, round(y, 6) + 0 AS y FROM c WHERE x IS NOT NULL")
def folded_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates of turns, folded over all conversations."""
    rows = geometry.coordinates(views.survey(spark, sf_dir), ("turn",), views.XY, fill=False)
    return rows.select("turn", r6("x").alias("x"), r6("y").alias("y"))


@query(B + " SELECT 0 AS corner, tracen AS cdp, x, y FROM blk WHERE tracen = (SELECT min(tracen) FROM blk) UNION ALL SELECT 1, tracen, x, y FROM blk WHERE tracen = (SELECT max(tracen) FROM blk)")
def line_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ends of a 2-D line."""
    return Volume(views.block(spark, sf_dir).withColumnRenamed("tracen", "cdp"), ("cdp",), coords=views.XY).corner_points()


@query("SELECT url, url LIKE '%.sgy' OR url LIKE '%.SEGY' AS segy, CASE WHEN url LIKE '%.sgy' OR url LIKE '%.SEGY' THEN 'segy' WHEN url LIKE '%.parquet' THEN 'volume' END AS kind FROM (SELECT 'f' || page_id || (CASE page_id % 4 WHEN 0 THEN '.sgy' WHEN 1 THEN '.SEGY' WHEN 2 THEN '.parquet' ELSE '.txt' END) AS url FROM pages)")
def file_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of files by the endings of their names."""

    def judge(batches):
        for batch in batches:
            yield batch.assign(segy=[segy.is_segy(u) for u in batch["url"]], kind=[tables.file_type(u) for u in batch["url"]])

    ending = F.element_at(F.array(*map(F.lit, (".sgy", ".SEGY", ".parquet", ".txt"))), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select(F.concat(F.lit("f"), F.col("page_id").cast("string"), ending).alias("url")).mapInPandas(judge, "url string, segy boolean, kind string")
