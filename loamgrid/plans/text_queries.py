"""Text headers, attributes and byte decoding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import codec
from ..functions import text
from . import views
from .registry import query, r6, table

BAD = r"regexp_replace(text, '[^\x00-\x7F]', '#', 'g')"


@query(f"SELECT doc_id, {BAD} AS fixed, regexp_matches(text, '^[\\x00-\\x7F]*$') AS ascii FROM documents")
def text_fix_bad_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.fix_bad_chars(x).alias("fixed"), text.is_ascii(x).alias("ascii"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
p AS (SELECT doc_id, line, line_no, unnest(range(CAST(greatest(ceil(length(line) / 80.0), 1) AS BIGINT))) AS c FROM l)
SELECT doc_id, CAST(line_no - 1 AS INTEGER) AS line_no, CAST(c AS INTEGER) AS piece, rpad(substr(line, c * 80 + 1, 80), 80, ' ') AS text FROM p
""")
def text_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents in pieces of 80 characters."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.select("doc_id", "line_no", F.posexplode(text.hard_wrapped(F.col("line"))).alias("piece", "text"))


@query(r"""
WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM conversations)
SELECT conv_id, turn, CAST(n - 1 AS INTEGER) AS line_no, rpad(CASE WHEN regexp_matches(b, '^C[\s|\d]\d') THEN b ELSE 'C' || lpad(CAST(n AS VARCHAR), 2, ' ') || ' ' || b END, 80, ' ') AS line
FROM (SELECT conv_id, turn, n, regexp_replace(x, '\s+$', '') AS b FROM l)
""")
def text_line_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each turn, each with its number before it."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("line_no", "x"))
    return rows.select("conv_id", "turn", "line_no", text.counted(F.col("x"), F.col("line_no") + 1).alias("line"))


@query(r"""
SELECT p_partkey, regexp_extract(l, '^(C[\s|\d]\d)?(.*)$', 1) AS mark, regexp_extract(l, '^(C[\s|\d]\d)?(.*)$', 2) AS rest
FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'C' || lpad(CAST(p_size AS VARCHAR), 2, ' ') || ' ' || p_name ELSE p_name END AS l FROM part)
""")
def text_line_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("C"), F.lpad(F.col("p_size").cast("string"), 2, " "), F.lit(" "), "p_name")).otherwise(F.col("p_name"))
    mark, rest = text.split_counter(line)
    return table(spark, sf_dir, "part").select("p_partkey", mark.alias("mark"), rest.alias("rest"))


@query("SELECT CAST(i AS INTEGER) AS line_no, rpad(coalesce(t.name, ''), 80, ' ') AS text FROM range(1, 41) r(i) LEFT JOIN (SELECT n_nationkey + 1 AS k, n_name AS name FROM nation) t ON t.k = r.i")
def text_map_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 lines of which the map of nations fills some."""
    entries = F.map_from_entries(F.collect_list(F.struct((F.col("n_nationkey") + 1).alias("k"), F.col("n_name"))))
    lines = table(spark, sf_dir, "nation").agg(entries.alias("m")).select(F.posexplode(text.lines_of_map(F.col("m"))).alias("line_no", "text"))
    return lines.select((F.col("line_no") + 1).alias("line_no"), "text")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def attrs_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1")
def attrs_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes merged with others, and read back."""
    merged = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("kind"), F.col("event_type")))
    rows = table(spark, sf_dir, "events").select(F.to_json(merged).alias("attrs"))
    rows = rows.select(F.get_json_object("attrs", "$.kind").alias("event_type"), F.get_json_object("attrs", "$.k").cast("long").alias("k"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


@query("SELECT p_partkey, CAST(p_partkey % 65536 - CASE WHEN p_partkey % 65536 >= 32768 THEN 65536 ELSE 0 END AS INTEGER) AS short, CAST(p_partkey AS INTEGER) AS whole FROM part")
def byte_decode_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers from trace headers of 240 bytes: two bytes with a sign at 29, four at 189, as the reader decodes headers."""
    @F.pandas_udf("short int, whole int")
    def decoded(raw: pd.Series) -> pd.DataFrame:
        data = np.frombuffer(b"".join(raw), dtype=np.uint8).reshape(-1, codec.HEADER)
        fields = codec.decode_headers(data, [29, 189], "big")
        return pd.DataFrame({"short": fields[29], "whole": fields[189]})

    word = F.lpad(F.hex("p_partkey"), 8, "0")
    header = F.unhex(F.concat(F.repeat(F.lit("00"), 28), F.substring(word, 5, 4), F.repeat(F.lit("00"), 158), word, F.repeat(F.lit("00"), 48)))
    return table(spark, sf_dir, "part").select("p_partkey", decoded(header).alias("f")).select("p_partkey", "f.short", "f.whole")


@query("SELECT p_partkey, round((CASE WHEN w >= 2147483648 THEN -1 ELSE 1 END) * ((w % 16777216) / 16777216.0e0) * pow(16.0e0, (w // 16777216) % 128 - 64), 6) + 0 AS v FROM (SELECT p_partkey, (p_partkey * 2654435) % 1048576 + 1090519040 + (p_partkey % 2) * 2147483648 AS w FROM part)")
def ibm_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IBM floats from their words, as the reader decodes samples."""
    @F.pandas_udf("double")
    def decoded(w: pd.Series) -> pd.Series:
        return pd.Series(codec.ibm_to_float(w.to_numpy().astype(np.uint32)))

    w = (F.col("p_partkey") * 2654435) % 1048576 + 1090519040 + (F.col("p_partkey") % 2) * F.lit(2147483648)
    return table(spark, sf_dir, "part").select("p_partkey", r6(decoded(w)).alias("v"))


@query("WITH" + views.VOLUME + """, b AS (SELECT iline, CAST(count(*) * 4 AS DOUBLE) AS n FROM lng GROUP BY 1)
SELECT iline, CASE WHEN n < 1024 THEN regexp_replace(printf('%.2f', n), '\\.?0+$', '') || ' B' WHEN n < 1048576 THEN regexp_replace(printf('%.2f', n / 1024), '\\.?0+$', '') || ' KB'
  ELSE regexp_replace(printf('%.2f', n / 1048576), '\\.?0+$', '') || ' MB' END AS size FROM b""".replace("\\\\", "\\"))
def humanbytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.volume(spark, sf_dir).groupBy("iline").agg(F.sum(F.size("samples") * 4).alias("n"))
    return rows.select("iline", text.human_bytes(F.col("n")).alias("size"))


@query("SELECT s_suppkey, CASE s_nationkey % 3 WHEN 1 THEN 'm' WHEN 2 THEN 'ft' END AS units FROM supplier")
def measurement_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..keys import MEASUREMENT_UNITS

    code = F.col("s_nationkey") % 3
    units = None
    for k, v in MEASUREMENT_UNITS.items():
        units = F.when(code == k, v) if units is None else units.when(code == k, v)
    return table(spark, sf_dir, "supplier").select("s_suppkey", units.alias("units"))
