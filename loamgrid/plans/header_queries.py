"""Header tables: statistics, labels, positions, grids, numbering, joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grid, stats
from . import views
from .registry import query, r6, table

LINE_COLUMNS = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "SELECT field, count(v) AS n, round(avg(v), 6) + 0 AS mean, round(stddev_samp(v), 6) + 0 AS std, min(v) AS min, "
    "round(quantile_cont(v, 0.25), 6) + 0 AS q25, round(quantile_cont(v, 0.5), 6) + 0 AS q50, round(quantile_cont(v, 0.75), 6) + 0 AS q75, max(v) AS max FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS field, CAST({c} AS DOUBLE) AS v FROM lineitem" for c in LINE_COLUMNS)
    + ") GROUP BY field HAVING stddev_samp(v) > 0"
)
def header_scan_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the header columns that vary."""
    s = stats.header_stats(table(spark, sf_dir, "lineitem"), LINE_COLUMNS).where("std > 0")
    return s.select("field", "n", r6("mean").alias("mean"), r6("std").alias("std"), "min", r6("q25").alias("q25"), r6("q50").alias("q50"), r6("q75").alias("q75"), "max")


@query("SELECT p_partkey, p_size FROM part WHERE p_partkey < 1000")
def header_scan_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first traces only, by their number."""
    return table(spark, sf_dir, "part").where("p_partkey < 1000").select("p_partkey", "p_size")


@query("SELECT DISTINCT l_linenumber FROM lineitem")
def header_distinct_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.labels(table(spark, sf_dir, "lineitem"), "l_linenumber")


@query("SELECT count(*) AS n_duplicates FROM (SELECT conv_id, turn FROM conversations GROUP BY ALL HAVING count(*) > 1)")
def dims_unique_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.duplicates(table(spark, sf_dir, "conversations"), ["conv_id", "turn"]).agg(F.count("*").alias("n_duplicates"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dims_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT count(DISTINCT p_brand) AS p_brand, count(DISTINCT p_type) AS p_type, count(DISTINCT p_size) AS p_size FROM part")
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.distinct_counts(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size"])


@query(
    "SELECT kind, CASE WHEN complete THEN 37 END AS \"offset\", CASE WHEN complete THEN 21 END AS cdp, complete FROM ("
    "SELECT 'sizes' AS kind, count(DISTINCT p_size) * count(DISTINCT p_partkey) = count(*) AS complete FROM part UNION ALL "
    "SELECT 'repeated', count(DISTINCT o) * count(DISTINCT c) = count(*) FROM (SELECT o, p_partkey AS c FROM part, (VALUES (1), (2), (3)) t(o)))"
)
def geometry_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which bytes are dimensions, with part keys as CDPs: part sizes as offsets don't make up all traces, three offsets each do."""
    part = table(spark, sf_dir, "part").select(F.col("p_size").alias("offset"), F.col("p_partkey").alias("CDP"))
    three = part.select("CDP", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("offset"))
    found = {kind: stats.guess_geometry(rows, strict=False) for kind, rows in (("sizes", part), ("repeated", three))}
    return spark.createDataFrame([(k, g.get("offset"), g.get("cdp"), bool(g)) for k, g in found.items()], "kind string, offset int, cdp int, complete boolean")


@query("SELECT min(s_acctbal) AS delay, round(median(s_acctbal), 6) + 0 AS scalar FROM supplier")
def delay_min_scalar_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").agg(F.min("s_acctbal").alias("delay"), r6(F.median("s_acctbal")).alias("scalar"))


@query("SELECT conv_id, turn, CAST(dense_rank() OVER (ORDER BY conv_id) - 1 AS BIGINT) AS i, CAST(dense_rank() OVER (ORDER BY turn) - 1 AS BIGINT) AS j FROM conversations")
def position_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return grid.with_position(grid.with_position(rows, "conv_id", "i"), "turn", "j").select("conv_id", "turn", "i", "j")


@query("WITH" + views.SURVEY + " SELECT c.conv_id, t.turn, s.size FROM (SELECT DISTINCT conv_id FROM srv) c CROSS JOIN (SELECT DISTINCT turn FROM srv) t LEFT JOIN srv s ON s.conv_id = c.conv_id AND s.turn = t.turn")
def densify_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.dense(views.survey(spark, sf_dir).select("conv_id", "turn", "size"), ["conv_id", "turn"])


@query("SELECT c.conv_id, t.turn FROM (SELECT DISTINCT conv_id FROM conversations) c CROSS JOIN (SELECT DISTINCT turn FROM conversations) t EXCEPT SELECT conv_id, turn FROM conversations")
def missing_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.missing_cells(table(spark, sf_dir, "conversations"), ["conv_id", "turn"])


@query("WITH" + views.VOLUME + ", d AS (SELECT i.iline, x.xline FROM (SELECT DISTINCT iline FROM emb) i CROSS JOIN (SELECT DISTINCT xline FROM emb) x) SELECT d.iline, d.xline, round(coalesce(list_sum(e.samples), 0), 6) + 0 AS total FROM d LEFT JOIN emb e ON e.iline = d.iline AND e.xline = d.xline")
def densify_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole grid, with zeros where there is no trace."""
    from ..operators import traces

    cells = grid.filled(grid.dense(views.volume(spark, sf_dir), ["iline", "xline"]), 64)
    return cells.select("iline", "xline", r6(traces.total(F.col("samples"))).alias("total"))


@query("WITH" + views.VOLUME + " SELECT tracen, CAST(row_number() OVER (ORDER BY iline, xline) - 1 AS BIGINT) AS a, CAST(row_number() OVER (ORDER BY xline, iline) - 1 AS BIGINT) AS b FROM emb")
def stack_axes_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of traces with either dimension running fastest."""
    rows = grid.numbered(views.volume(spark, sf_dir).drop("samples"), ["iline", "xline"], "a")
    return grid.numbered(rows, ["xline", "iline"], "b").select("tracen", "a", "b")


@query("WITH" + views.VOLUME + " SELECT iline, xline, CAST(row_number() OVER (ORDER BY iline, xline) - 1 AS BIGINT) AS tracen_out FROM emb WHERE tracen % 2 = 0")
def trace_numbering_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.live_numbers(views.volume(spark, sf_dir), ["iline", "xline"], F.col("tracen") % 2 == 1).select("iline", "xline", "tracen_out")


@query("WITH a AS (SELECT label, vec_id, CASE WHEN vec_id - lag(vec_id) OVER (PARTITION BY label ORDER BY vec_id) > 1 THEN 1 ELSE 0 END AS b FROM embeddings), c AS (SELECT label, vec_id, CAST(sum(b) OVER (PARTITION BY label ORDER BY vec_id) AS BIGINT) AS block FROM a) SELECT label, block, min(vec_id) AS first, max(vec_id) AS last, count(*) AS n FROM c GROUP BY ALL")
def contiguous_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.islands(table(spark, sf_dir, "embeddings"), "vec_id", ["label"])


@query("WITH a AS (SELECT abs(label - lag(label) OVER (ORDER BY vec_id)) AS i, abs(vec_id - lag(vec_id) OVER (ORDER BY vec_id)) AS j FROM embeddings) SELECT CASE WHEN min(i) = 0 THEN 1 ELSE -1 END AS label, CASE WHEN min(j) = 0 THEN 1 ELSE -1 END AS vec_id FROM a")
def chunk_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grid.chunk_heuristic(table(spark, sf_dir, "embeddings"), ["label", "vec_id"], "vec_id")
    return spark.createDataFrame([(found["label"], found["vec_id"])], "label int, vec_id int")


@query("WITH a AS (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events) SELECT user_id, coalesce(min(d) < 0, false) AS reversed FROM a GROUP BY 1")
def fast_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a label ever falls from one trace to the next."""
    return grid.falls(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value")


@query("WITH" + views.VOLUME + " SELECT tracen, iline, xline, CAST(floor((xline - 1) / 10.0) AS BIGINT) AS block FROM emb")
def inline_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.volume(spark, sf_dir).drop("samples").withColumn("p", F.col("xline") - 1)
    return grid.with_block(rows, "p", 10).drop("p")


@query("WITH" + views.VOLUME + " SELECT tracen FROM emb WHERE iline BETWEEN 2 AND 5 AND xline BETWEEN 3 AND 12")
def crop_ix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.cropped(views.volume(spark, sf_dir), {"iline": (2, 5), "xline": (3, 12)}).select("tracen")


@query("WITH" + views.BLOCK + " SELECT tracen FROM blk WHERE x BETWEEN 1000 AND 1015 AND y BETWEEN 510 AND 540")
def crop_xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.cropped(views.block(spark, sf_dir), {"x": (1000, 1015), "y": (510, 540)}).select("tracen")


@query("WITH l AS (SELECT min(conv_id) AS a, max(conv_id) AS b FROM conversations) SELECT greatest(a, CASE WHEN 10 > a AND 10 < b THEN 10 ELSE a END) AS low, least(b, CASE WHEN 1000000 > a AND 1000000 < b THEN 1000000 ELSE b END) AS high FROM l")
def crop_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = list(table(spark, sf_dir, "conversations").agg(F.min("conv_id"), F.max("conv_id")).first())
    return spark.createDataFrame([tuple(grid.clamp_crop([10, 1_000_000], limits))], "low long, high long")


@query("WITH" + views.VOLUME + " SELECT tracen FROM emb WHERE iline IN (1, 4, 7) AND xline BETWEEN 2 AND 9")
def sel_label_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.volume(spark, sf_dir).where(F.col("iline").isin(1, 4, 7) & F.col("xline").between(2, 9)).select("tracen")


@query("WITH" + views.VOLUME + " SELECT tracen FROM emb WHERE xline = (SELECT xline FROM (SELECT DISTINCT xline FROM emb) ORDER BY abs(xline - 11.5), xline LIMIT 1)")
def sel_nearest_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.volume(spark, sf_dir)
    return rows.join(F.broadcast(grid.nearest_label(rows.select("xline").distinct(), "xline", 11.5)), "xline", "left_semi").select("tracen")


@query("WITH" + views.VOLUME + ", p AS (SELECT xline, row_number() OVER (ORDER BY xline) - 1 AS q, count(*) OVER () AS n FROM (SELECT DISTINCT xline FROM emb)) SELECT e.tracen FROM emb e JOIN p ON p.xline = e.xline WHERE q % 3 = 0 OR q = n - 1")
def isel_strided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third crossline by place, and the last one."""
    rows = grid.with_position(views.volume(spark, sf_dir).drop("samples"), "xline", "q")
    last = rows.agg(F.max("q")).first()[0]
    return rows.where((F.col("q") % 3 == 0) | (F.col("q") == last)).select("tracen")


@query("SELECT vec_id FROM embeddings WHERE vec_id % 7 = 0")
def decimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.decimated(table(spark, sf_dir, "embeddings"), "vec_id", 7).select("vec_id")


@query("SELECT o.o_orderkey, o.o_custkey, c.c_nationkey FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey AND c.c_acctbal > 0")
def header_join_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return grid.with_headers(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), live, ["o_custkey"]).select("o_orderkey", "o_custkey", "c_nationkey")


@query("SELECT coalesce(p_partkey, s_suppkey + 1950) AS k, p_size, s_nationkey FROM part FULL JOIN supplier ON p_partkey = s_suppkey + 1950")
def outer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_size")
    right = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1950).alias("k"), "s_nationkey")
    return grid.merged(left, right, ["k"])


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def semi_join_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces that a filtered header table names."""
    keep = table(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(keep, "o_custkey", "left_semi").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
def anti_join_dead(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey"))
    return grid.without(table(spark, sf_dir, "customer"), gone, ["c_custkey"]).select("c_custkey")


@query("SELECT CAST(least(floor((p_retailprice - a) / ((b - a) / 25)), 24) AS INTEGER) AS bin, count(*) AS n FROM part, (SELECT min(p_retailprice) AS a, max(p_retailprice) AS b FROM part) GROUP BY 1")
def header_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(table(spark, sf_dir, "part"), "p_retailprice", 25)


@query("SELECT user_id, ts, event_id, last_value(CASE WHEN event_id % 3 = 0 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM events")
def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = grid.forward_filled(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.when(F.col("event_id") % 3 == 0, F.col("value")), "v")
    return filled.select("user_id", "ts", "event_id", "v")


@query("WITH s AS (SELECT p_brand, p_size, lead(p_size) OVER (PARTITION BY p_brand ORDER BY p_size) AS n FROM (SELECT DISTINCT p_brand, p_size FROM part)) SELECT p_brand, CAST(p_size AS DOUBLE) AS v FROM s UNION ALL SELECT p_brand, (p_size + n) / 2.0 FROM s WHERE n IS NOT NULL")
def halfsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of each brand with the midpoints between neighbours."""
    from ..operators import traces

    axes = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_size")).alias("labels"))
    return axes.select("p_brand", F.explode(traces.halfsampled(F.col("labels"))).alias("v"))


@query("SELECT user_id, round(sum(abs(d)), 6) + 0 AS length FROM (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events) GROUP BY 1")
def path_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.path_lengths(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value").select("user_id", r6("length").alias("length"))
