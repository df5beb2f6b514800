"""The corpus pipeline on small tables, each stage against a plain version of it."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from loamgrid.llm import op1_minhash, op2_toxicity, op5_mixing, op6_bpe, op10_lines

from .test_text_operators import without_runs

SF = "/root/testdata/sf0.01"


def plain_lines(rows):
    """Documents without repeated runs; those that lose all lines go."""
    left = without_runs(rows, op10_lines.MIN_WORDS)
    return {d: x for d, (n, gone, x) in left.items() if gone < n or n == 0}


def plain_near(rows, idf):
    """The smallest id of every class, all pairs compared."""
    ids, texts = [d for d, _ in rows], pa.array([t for _, t in rows])
    parent = {d: d for d in ids}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for k, d in enumerate(ids):
        n = len(ids) - k - 1
        alike = op1_minhash.similarity(pa.array([texts[k].as_py()] * n, pa.string()), texts[k + 1 :], idf) >= op1_minhash.SIMILARITY if n else []
        for j, yes in enumerate(alike, k + 1):
            if yes or texts[j] == texts[k]:
                a, b = sorted((root(d), root(ids[j])))
                parent[b] = a
    return {d for d in ids if root(d) == d}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 3000 AND doc_id < 450")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)

    model = op2_toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    scores = model.score(pa.array([t for _, t in rows]), op2_toxicity.Restorer(model.letters))
    first = corpus_pipeline.written(stages["toxicity"](spark, docs, SF))
    assert first.columns == columns
    assert {r["doc_id"] for r in first.collect()} == {d for (d, _), s in zip(rows, scores, strict=True) if s < op2_toxicity.THRESHOLD}

    rows = [(r["doc_id"], r["text"]) for r in first.select("doc_id", "text").collect()]
    second = corpus_pipeline.written(stages["line_dedup"](spark, first, SF))
    assert second.columns == columns
    assert {r["doc_id"]: r["text"] for r in second.collect()} == plain_lines(rows)
    assert second.where("n_chars <> length(text)").count() == 0

    rows = sorted((r["doc_id"], r["text"]) for r in second.select("doc_id", "text").collect())
    third = corpus_pipeline.written(stages["near_duplicates"](spark, second, SF))
    assert third.columns == columns
    assert {r["doc_id"] for r in third.collect()} == plain_near(rows, op1_minhash.document_frequencies(second))

    fourth = corpus_pipeline.written(stages["mixing"](spark, third, SF))
    assert fourth.columns == columns
    rates = {r["doc_id"]: r["copies"] for r in op5_mixing.mix(third, op5_mixing.labelled_domains(third, spark.read.parquet(f"{SF}/labels.parquet"))).collect()}
    assert Counter(r["doc_id"] for r in fourth.collect()) == {d: n for d, n in rates.items() if n} and min(rates.values()) == 0 and max(rates.values()) > 1

    tokenizer = op6_bpe.codec(op6_bpe.VOCABULARY).tokenizer
    want = Counter()
    for r in fourth.collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        want[r["doc_id"], len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter(map(tuple, stages["bpe"](spark, fourth, SF).collect())) == want


def test_run_is_its_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 500


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF))
    assert docs.count() == 0


def test_near_duplicates_with_repeated_and_null_ids(spark):
    a, b, c, d = ("%s is a text of its own about %s and nothing else" % (x, x * 3) for x in ("alpha", "beta", "gamma", "delta"))
    rows = [(3, a, "u"), (7, b, "u"), (7, a, "u"), (9, c, "u"), (None, a, "u"), (None, d, "u"), (5, None, "u"), (6, "", "u"), (9, c, "u"), (4, "another text altogether", "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text_key string")
    got = Counter(map(tuple, corpus_pipeline.near_duplicates(spark, docs, SF).collect()))
    assert got == Counter([(3, a, "u"), (7, b, "u"), (9, c, "u"), (None, d, "u"), (5, None, "u"), (4, "another text altogether", "v")])


def test_stages_on_odd_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "s", 0), (1, "word " * 60_000, "en", "s", 300_000), (1, "word " * 60_000, "en", "s", 300_000)], docs.schema)
    docs = docs.unionByName(odd).withColumns({"_copies": F.lit("x"), "_score": F.lit(1.0), "node": F.lit(2)})
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.written(stage(spark, docs, SF))
        assert out.count() > 0 and (name == "bpe" or out.columns == docs.columns)
        docs = out
