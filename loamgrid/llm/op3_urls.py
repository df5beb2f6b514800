"""Operator 3: URL filters with segmented host names and naive Bayes.

A host's labels are split into words by a unigram Viterbi search: the counts of
words in the tables' own pages and URLs say how likely a word is, and
characters that belong to no word cost more than any word.  Only the counts of
substrings of labels are joined to them, so no vocabulary reaches the driver.
A multinomial naive Bayes model over host words, hyphens of hosts and path words is
learnt from the URLs themselves by expectation maximisation.  Seed words only start it: a
URL with one of them is unwanted in the first round, and a seed word has
``SEED_PRIOR`` unwanted occurrences beforehand.  Each round counts all words by
how likely their URLs are unwanted and judges the URLs anew, so that words that
come with seeds are learnt and a seed amid good words can be outweighed.  URLs
are judged by word list, and the rows of a word list are held out from the counts
that judge it.  Explicit rules come first; the longest that fits wins.

Null URLs and URLs without ``://`` have an empty host and path and are judged by
the model's prior; a tie (log odds of 0) is allowed.  Very long URLs are words
like others, of which a label's words have ``LONGEST_WORD`` characters at most.
An empty table gives an empty result.  Repeated rows give a row each; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written

#: Words that mark a URL as unwanted when learning starts.
SEEDS = (
    "adult", "bet", "betting", "bitcoin", "bonus", "casino", "cheap", "cialis", "crack", "dating", "escort", "forex", "gambling",
    "hack", "jackpot", "keygen", "loan", "loans", "lottery", "malware", "nude", "payday", "pharmacy", "phishing", "pills", "poker",
    "porn", "replica", "roulette", "scam", "sex", "slots", "spam", "torrent", "viagra", "warez", "win", "xxx",
)
#: A host's sign that is a token of its own.
SIGN = "-"
#: Rounds of learning, and occurrences in unwanted URLs that a seed word has beforehand.
ROUNDS, SEED_PRIOR = 3, 2.0
#: Occurrences that every word has beforehand among unwanted and among other URLs.
SMOOTH = 0.1
#: Rows that a seed word counts for in the unigram model.
SEED_COUNT = 100
#: Longest word that a label is split into, and the cost in nats of a character of no word.
LONGEST_WORD, NO_WORD = 24, 18.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(rules: list[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """Rule and verdict of the longest of the rules (verdict, host/path) that fits; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        at = text.index("/")
        name, start = text[:at], text[at:]
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def split_label(label: str, counts: dict[str, int], total: int) -> list[str]:
    """The likeliest words of a label, each word's cost being minus the log of its share; what lies between words is one."""
    best, back = [0.0], [0]
    for end in range(1, len(label) + 1):
        cost, start = best[end - 1] + NO_WORD, end - 1
        for i in range(max(0, end - LONGEST_WORD), end):
            n = counts.get(label[i:end])
            if n and best[i] + math.log(total / n) < cost:
                cost, start = best[i] + math.log(total / n), i
        best.append(cost)
        back.append(start)
    found: list[str] = []
    end, unknown = len(label), False
    while end:
        word = label[back[end] : end]
        if word in counts or not unknown:
            found.append(word)
        else:  # characters of no word beside each other are one unknown word
            found[-1] = word + found[-1]
        unknown, end = word not in counts, back[end]
    return found[::-1]


def _tokens(text: Column) -> Column:
    """Runs of two letters or more."""
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), r"[^a-z]+"), lambda x: F.length(x) > 1)


def segment(labels: DataFrame, word_counts: DataFrame) -> DataFrame:
    """label and its words; labels is distinct labels, word_counts is (word, n)."""
    total = word_counts.agg(F.coalesce(F.sum("n"), F.lit(1))).first()[0]
    places = F.expr(f"flatten(transform(sequence(1, length(label)), i -> transform(sequence(2, {LONGEST_WORD}), k -> substring(label, i, k))))")
    parts = labels.select("label", F.explode(F.array_distinct(places)).alias("word"))
    known = parts.join(word_counts, "word").groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("counts"))

    def viterbi(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"label": batch["label"], "words": [split_label(a, dict(b or {}), total) for a, b in zip(batch["label"], batch["counts"], strict=True)]})

    return labels.join(known, "label", "left").mapInPandas(viterbi, "label string, words array<string>")


def learnt(lists: DataFrame, seeds: tuple[str, ...] = SEEDS, rounds: int = ROUNDS) -> DataFrame:
    """words and log_odds (of being unwanted) of each word list; lists is different word lists and their rows n."""
    r, n = F.col("r"), F.col("n")
    lists = written(lists.withColumn("r", F.exists("words", lambda w: w.isin(*seeds)).cast("double")))
    # once a list and word, with its occurrences; the empty list has none
    terms = written(lists.select("words", F.explode("words").alias("word")).groupBy("words", "word").agg(F.count("*").alias("k")))
    for left in range(rounds, 0, -1):
        rows, bad = lists.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(n * r), F.lit(0.0))).first()
        counts = lists.select("n", "r", F.explode("words").alias("word")).groupBy("word").agg(F.sum(n * r).alias("bad"), F.sum(n * (1 - r)).alias("good"))
        counts = written(counts.withColumn("prior", F.when(F.col("word").isin(*seeds), SMOOTH + SEED_PRIOR).otherwise(SMOOTH)))
        bad_t, bad_prior, good_t, v = counts.agg(*[F.coalesce(F.sum(c), F.lit(0.0)) for c in ("bad", "prior", "good")], F.count("*")).first()
        size, k = F.size("words"), F.col("k")
        own_bad, own_good = n * r, n * (1 - r)
        weight = F.log((F.greatest(F.col("bad") - own_bad * k, F.lit(0.0)) + F.col("prior")) / (F.greatest(bad_t - own_bad * size, F.lit(0.0)) + bad_prior))
        weight = weight - F.log((F.greatest(F.col("good") - own_good * k, F.lit(0.0)) + SMOOTH) / (F.greatest(good_t - own_good * size, F.lit(0.0)) + v * SMOOTH))
        # r is a list's, so the terms get it by their list
        evidence = terms.join(lists, "words").join(counts, "word").groupBy("words").agg(F.sum(k * weight).alias("evidence"))
        prior = F.log((F.greatest(bad - own_bad, F.lit(0.0)) + 1) / (F.greatest(rows - bad - own_good, F.lit(0.0)) + 1))
        judged = written(lists.join(evidence, "words", "left").select("words", "n", (prior + F.coalesce("evidence", F.lit(0.0))).alias("log_odds")))
        if left == 1:
            return judged.select("words", "log_odds")
        lists = written(judged.select("words", "n", (1 / (1 + F.exp(-F.least(F.greatest("log_odds", F.lit(-30.0)), F.lit(30.0))))).alias("r")))


def url_filter(pages: DataFrame, rules: list[tuple[str, str]], text: str | None = "html", seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """page_id, host, path, rule, verdict, words and log_odds of every row of pages (page_id, url and the column named ``text``)."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    urls = rows.groupBy("host", "path").agg(F.count("*").alias("n"))

    labels = urls.select(F.explode(F.filter(F.split("host", r"[^a-z]+"), lambda x: x != "")).alias("label")).distinct()
    spoken = urls.select(F.explode(_tokens(F.col("path"))).alias("word"))
    if text:
        spoken = spoken.unionByName(pages.select(F.explode(_tokens(F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), r"<[^>]*>", " "))).alias("word")))
    counts = spoken.where(F.length("word") <= LONGEST_WORD).groupBy("word").agg(F.count("*").alias("n"))
    seeded = spark.createDataFrame([(w, SEED_COUNT) for w in seeds], "word string, n long")
    counts = written(counts.unionByName(seeded).groupBy("word").agg(F.sum("n").alias("n")))
    split = segment(labels, counts)

    hosts = urls.select("host").distinct()
    host_words = hosts.select("host", F.posexplode(F.split("host", r"[^a-z]+")).alias("at", "label")).join(split, "label")
    host_words = host_words.groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda x: x["words"])).alias("host_words"))
    signs = F.array_repeat(F.lit(SIGN), F.length("host") - F.length(F.replace("host", F.lit(SIGN), F.lit(""))))
    seen = urls.join(host_words, "host", "left").select("host", "path", "n", F.concat(F.coalesce("host_words", F.array().cast("array<string>")), signs, _tokens(F.col("path"))).alias("words"))
    seen = written(seen)
    odds = learnt(seen.groupBy("words").agg(F.sum("n").alias("n")), seeds)
    judged = seen.select("host", "path", "words").join(odds, "words").select("host", "path", "words", "log_odds")

    rule, verdict = rule_for(rules, F.col("host"), F.col("path"))
    model = F.when(F.col("log_odds") > 0, "block").otherwise("allow")
    return rows.join(judged, ["host", "path"]).select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, model).alias("verdict"), "words", F.round("log_odds", 6).alias("log_odds"))


RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)
