"""Operator 12: license scans by diagonal voting of word k-grams.

Words are runs of digits, a-z (after lower-casing A-Z) and characters beyond
ASCII.  Every rolling word k-gram of every document is joined by its hash, and
then its words, to the places of the templates' k-grams.  A hit votes for a
diagonal: its place in the document minus that in the template.  Votes are
aggregated by document, template and diagonal; neighbouring diagonals, no more
than ``SHIFT`` apart, are merged to one span, as words put in or left out of a
license move what follows.  A span is verified by the template's words that it
holds, which are at least ``COVER`` of the template, and by its own words, at
least ``DENSE`` of which belong to the template.

Templates are of two kinds.  The phrases of ``BASE`` count where they stand
whole: a diagonal with all votes is a place.  ``TEXTS``, notices and sentences
that grant a license, add labels by verified spans.  Templates of less than
``GRAM`` words vote with pairs of words.  Their number of places is a matter of
the parameter, and up to ``BROADCAST`` of them are sent to all tasks.

Only DataFrame and SQL functions run on executors.  Documents aren't shuffled:
what is, once, are hits and a row a document.

Null texts count as empty: no words, no places, empty labels and a score of 0;
an empty table gives an empty result.  Long texts are scanned whole, in memory
that grows with the longest text of a task.  Equal rows, also of one or no doc_id,
give a row each; other columns are ignored.  Of templates with one label any
number may be found; a score is the largest share of a template that stands
in one span (1 where a phrase stands).
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GRAM, PAIR = 4, 2
#: Words by which neighbouring diagonals may differ, and shares of a template and of a span's words that a span needs.
SHIFT, COVER, DENSE = 8, 0.6, 0.5
#: Places of templates that are broadcast; more are joined by a shuffle.
BROADCAST = 1 << 17
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OTHERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Phrases and labels, and the words by which licenses are granted.
BASE = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]
TEXTS = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "spdx license identifier mit"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "spdx license identifier apache 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "spdx license identifier gpl 3 0 or later"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]


class Place(NamedTuple):
    """A k-gram of a template, and what is known of the template."""

    gram: str
    template: int
    label: str
    base: bool
    at: int
    k: int
    size: int


def places(base: list[tuple[str, str]], texts: list[tuple[str, str]]) -> list[Place]:
    """Every k-gram of every template, by place."""
    found = []
    for template, (label, text) in enumerate([*base, *texts]):
        words = re.findall(WORD, text.translate(str.maketrans(_UPPER, _LOWER)))
        if len(words) < PAIR:
            raise ValueError(f"a template needs two words or more: {text!r}")
        k = GRAM if len(words) >= GRAM else PAIR
        found += [Place(" ".join(words[i : i + k]), template, label, template < len(base), i, k, len(words)) for i in range(len(words) - k + 1)]
    return found


def hits(docs: DataFrame, templates: list[Place]) -> DataFrame:
    """A row for each k-gram of a document that a template holds, and at least one row (maybe without a template) a document."""
    # lower() changes characters beyond ASCII too, of which only the Kelvin sign becomes an ASCII letter
    text = F.lower(F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("\u212a"), F.lit("\u212b")))
    spaced = F.trim(F.regexp_replace(text, OTHERS, " "))
    # at each word the GRAM words from it on, or as many as there are
    grams = F.regexp_extract_all(spaced, F.lit(rf"(?=([^ ]+(?: [^ ]+){{0,{GRAM - 1}}}))[^ ]+ ?"), F.lit(1))
    words = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), grams.alias("grams"))
    rows = words.select("doc_id", "row", F.size("grams").alias("n_words"), F.posexplode_outer("grams").alias("at", "gram"))
    rows = rows.withColumn(f"gram{PAIR}", F.substring_index("gram", " ", PAIR)).withColumnRenamed("gram", f"gram{GRAM}")
    for k in (PAIR, GRAM):
        own = docs.sparkSession.createDataFrame([p for p in templates if p.k == k], "gram string, template int, label string, base boolean, tpos int, k int, size int")
        # the places of a hash, so that a k-gram stays one row until it has been found
        own = own.groupBy(F.xxhash64("gram").alias(f"hash{k}")).agg(F.collect_list(F.struct(*own.columns)).alias(f"places{k}"))
        rows = rows.withColumn(f"hash{k}", F.xxhash64(f"gram{k}")).join(F.broadcast(own) if len(templates) <= BROADCAST else own, f"hash{k}", "left")
    met = F.col(f"places{PAIR}").isNotNull() | F.col(f"places{GRAM}").isNotNull()
    found = rows.where(met | F.coalesce(F.col("at") == 0, F.lit(True)))

    def same(k: int) -> Column:
        """The places whose words, not their hash alone, are those of the k-gram."""
        return F.coalesce(F.filter(f"places{k}", lambda p: p["gram"] == F.col(f"gram{k}")), F.array())

    found = found.select("doc_id", "row", "n_words", "at", F.explode_outer(F.concat(same(PAIR), same(GRAM))).alias("p"))
    return found.select("doc_id", "row", "n_words", *[f"p.{c}" for c in ("template", "label", "base", "k", "size", "tpos")], "at")


def spans(found: DataFrame) -> DataFrame:
    """Merged spans of each document and template: places of whole templates, covered share of the template, first and last word."""
    # all that follows is by row, so hits move once
    own = ["row", "doc_id", "n_words", "template", "label", "base", "k", "size"]
    votes = found.repartition("row").withColumn("diagonal", F.col("at") - F.col("tpos")).groupBy(*own, "diagonal").agg(F.collect_list("tpos").alias("hit"))
    before = F.lag("diagonal").over(Window.partitionBy("row", "template").orderBy("diagonal"))
    votes = votes.withColumn("first_of_span", F.coalesce(F.col("diagonal") - before > SHIFT, F.lit(True)).cast("int"))
    upto = Window.partitionBy("row", "template").orderBy("diagonal").rowsBetween(Window.unboundedPreceding, 0)
    votes = votes.withColumn("span", F.sum("first_of_span").over(upto))
    whole = F.size("hit") == F.col("size") - F.col("k") + 1
    held = F.flatten(F.collect_list(F.transform("hit", lambda t: F.struct(t.alias("t"), (t + F.col("diagonal")).alias("d")))))
    merged = votes.groupBy(*own, "span").agg(
        F.count_if(whole).alias("whole"), F.min(F.when(whole, F.col("diagonal"))).alias("first_whole"), F.max(F.when(whole, F.col("diagonal"))).alias("last_whole"), held.alias("held")
    )

    def covered(part: str) -> Column:
        """Different words that the hits cover."""
        return F.size(F.array_distinct(F.flatten(F.transform("held", lambda h: F.sequence(h[part], h[part] + F.col("k") - 1)))))

    first, last = F.array_min(F.transform("held", lambda h: h["d"])), F.array_max(F.transform("held", lambda h: h["d"])) + F.col("k") - 1
    merged = merged.withColumn("first", first).withColumn("last", last).withColumn("share", covered("t") / F.col("size"))
    return merged.withColumn("sound", (F.col("share") >= COVER) & (covered("d") >= DENSE * (F.col("last") - F.col("first") + 1)) & (~F.col("base") | (F.col("whole") > 0))).drop("held")


def scan(docs: DataFrame, base: list[tuple[str, str]] | None = None, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and the verified spans of each document."""
    found = spans(hits(docs, places(BASE if base is None else base, TEXTS if texts is None else texts)))
    joined = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")
    counted = F.when(F.col("base"), F.col("whole"))
    report = F.struct("label", "first", "last", "share")
    return found.groupBy("row", "doc_id", "n_words").agg(
        F.coalesce(F.sum(counted), F.lit(0)).cast("long").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("first_whole"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("last_whole"))).cast("long").alias("last_word"),
        joined(F.col("base") & (F.col("whole") > 0)).alias("base_labels"),
        joined(F.col("sound")).alias("labels"),
        F.coalesce(F.max(F.when(~F.col("base") | (F.col("whole") > 0), F.col("share"))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("sound"), report))).alias("spans"),
    ).withColumn("n_words", F.col("n_words").cast("long")).drop("row")


def sql(base: list[tuple[str, str]], texts: list[tuple[str, str]]) -> str:
    """The same in DuckDB."""
    rows = ", ".join(f"('{p.gram}', {p.template}, '{p.label}', {p.base}, {p.at}, {p.k}, {p.size})" for p in places(base, texts))
    return f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') AS w FROM documents
), p(gram, template, label, base, tpos, k, size) AS (
  VALUES {rows}
), g AS (
  SELECT r, i AS pos, unnest([{PAIR}, {GRAM}]) AS k, w FROM (SELECT r, w, unnest(range(len(w))) AS i FROM d)
), h AS (
  SELECT r, template, label, base, p.k, size, tpos, pos, pos - tpos AS diagonal
  FROM (SELECT r, pos, k, array_to_string(w[pos + 1 : pos + k], ' ') AS gram FROM g) AS g JOIN p ON g.gram = p.gram AND g.k = p.k
), v AS (
  SELECT r, template, label, base, k, size, diagonal, count(*) = size - k + 1 AS whole FROM h GROUP BY r, template, label, base, k, size, diagonal
), b AS (
  SELECT *, coalesce(diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) > {SHIFT}, true)::INT AS opens FROM v
), s AS (
  SELECT *, sum(opens) OVER (PARTITION BY r, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS span FROM b
), c AS (
  SELECT s.r AS r, s.template AS template, s.label, s.base, s.k, s.size, s.span, min(pos) AS first, max(pos) + s.k - 1 AS last,
         list_distinct(flatten(list(range(tpos, tpos + s.k)))).len() / s.size AS share, list_distinct(flatten(list(range(pos, pos + s.k)))).len() AS dense
  FROM s JOIN h USING (r, template, diagonal) GROUP BY s.r, s.template, s.label, s.base, s.k, s.size, s.span
), m AS (
  SELECT c.*, n.whole, n.first_whole, n.last_whole FROM c JOIN (
    SELECT r, template, span, count_if(whole) AS whole, min(CASE WHEN whole THEN diagonal END) AS first_whole, max(CASE WHEN whole THEN diagonal END) AS last_whole FROM s GROUP BY ALL
  ) AS n USING (r, template, span)
)
SELECT doc_id, len(w) AS n_words, coalesce(sum(whole) FILTER (base), 0)::BIGINT AS n_base, min(first_whole) FILTER (base) AS first_word, max(last_whole) FILTER (base) AS last_word,
       coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (base AND whole > 0)), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (share >= {COVER} AND dense >= {DENSE} * (last - first + 1) AND (NOT base OR whole > 0))), ','), '') AS labels,
       coalesce(max(share) FILTER (NOT base OR whole > 0), 0)::DOUBLE AS score
FROM d LEFT JOIN m USING (r) GROUP BY r, doc_id, w
"""


SQL = sql(BASE, TEXTS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
