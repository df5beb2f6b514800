"""Operator 5: mixing documents to target weights with soft membership of domains.

A softmax classifier, fitted on a labelled table (doc_id, domain), predicts how
far each document belongs to each domain.  Projected-gradient least squares
then finds a nonnegative rate for every document, so that the expected tokens
of the domains - the sum over documents of rate, tokens and posterior - match
the targets.  A step is the gradient, scaled by the inverse of the domains' Gram
matrix over the documents whose rate isn't held at 0 (so that it is exact as long
as no more rates get there), and halved when it comes no nearer.  A round is one
aggregation over the table of posteriors, of which the driver sees the domains'
totals.  A document's rate follows from its posterior and the rounds' steps;
every ``WRITTEN`` rounds the rates are written.  Rounds end when the targets are
met or come no nearer (nonnegative rates can't meet all targets), or after
``ROUNDS``; ``miss`` says how far off the worst domain is, as a share of all tokens.

Tokens are words: runs of ASCII letters, digits, underscores and characters
beyond ASCII.  Null and empty texts have none; their rate changes no total.
``copies`` rounds the rate up or down by a hash of doc_id, so that it is the
rate on average.  Of equal posteriors the first domain by name is the likeliest.
Very long texts are rows like others.  Repeated rows have a rate each; other
columns are ignored.  An empty table gives an empty result, and without a
labelled row every document belongs to one domain.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb
from .shared import small_batches, written

#: Labelled rows that the classifier is fitted on, about.
SAMPLE_ROWS = 6_000
#: Bins of byte pairs that the classifier sees.
BINS = 1024
#: Targets without given weights: shares to this power; of the tokens of thinned domains this share.
TEMPERING, THINNED = 0.7, 0.25
#: Rounds at most, rounds between writing rates, and the miss (of all tokens) that counts as none.
ROUNDS, WRITTEN, TOLERANCE = 40, 8, 1e-6
#: The domain of documents that are labelled with quality 0.
LOW_QUALITY = "low quality"


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words, and square roots of the shares of hashed byte pairs, of each text."""
    data, offsets = tb.text_bytes(column)
    n = len(column)
    start, _, row = tb.words(data, offsets)
    tokens = np.bincount(row, minlength=n)
    sizes = np.diff(offsets)
    rows = np.repeat(np.arange(n), sizes)
    low = tb.LOWER[data].astype(np.uint32)
    x = np.zeros((n, BINS), dtype=np.float32)
    if len(low) > 1:
        pair = ((low[:-1] * np.uint32(2654435761) + low[1:] * np.uint32(40503 * 65537)) >> np.uint32(22)).astype(np.int64)
        same = rows[:-1] == rows[1:]
        x = np.bincount(rows[:-1][same] * BINS + pair[same], minlength=n * BINS).reshape(n, BINS).astype(np.float32)
    return tokens, np.sqrt(x / np.maximum(sizes - 1, 1)[:, None].astype(np.float32))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tb.blocks(batches):
        for i in range(0, batch.num_rows, 2048):
            yield batch.slice(i, 2048)


def fit_softmax(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 250, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, weights and intercepts of a softmax regression, by accelerated gradient descent."""
    centre = x.mean(axis=0)
    z = (x - centre).astype(np.float64)
    goal = np.eye(classes)[y]
    step = 2.0 / (np.linalg.norm(z, 2) ** 2 / len(z) + ridge)
    w, b = np.zeros((z.shape[1], classes)), np.log(goal.mean(axis=0) + 1e-6)
    v, c = w.copy(), b.copy()
    for t in range(rounds):
        p = z @ v + c
        p = np.exp(p - p.max(axis=1, keepdims=True))
        p = (p / p.sum(axis=1, keepdims=True) - goal) / len(z)
        new_w, new_b = v - step * (z.T @ p + ridge * v), c - p.sum(axis=0)
        v, c = new_w + t / (t + 3) * (new_w - w), new_b + t / (t + 3) * (new_b - b)
        w, b = new_w, new_b
    return centre, w, b


def posteriors(docs: DataFrame, labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[DataFrame, list[str]]:
    """doc_id, tokens and p (a posterior for each domain) of every row, and the domains."""
    small_batches(docs.sparkSession)
    labelled = labelled.where(F.col("domain").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    domains = [r["domain"] for r in labelled.groupBy("domain").agg(F.count("*").alias("n")).orderBy("domain").collect()]
    model = None
    if len(domains) > 1:
        n = labelled.count()
        spread = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(1_000_000))
        sample = labelled.where(spread < int(1_000_000 * min(1.0, sample_rows / n)))  # about sample_rows rows, so they may be broadcast
        rows = docs.select("doc_id", docs["text"].cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("domain", "text")

        def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _pieces(batches):
                _, x = _vectors(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in x], pa.binary())], names=["domain", "x"])

        found = rows.mapInArrow(vectors, "domain string, x binary").toPandas()
        if found["domain"].nunique() > 1:
            x = np.stack([np.frombuffer(v, dtype=np.float32) for v in found["x"]])
            y = found["domain"].map({d: i for i, d in enumerate(domains)}).to_numpy()
            model = fit_softmax(x, y, len(domains))
    domains = domains or ["all"]
    k = len(domains)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            tokens, x = _vectors(batch.column(1))
            if model is None:
                p = np.full((batch.num_rows, k), 1 / k)
            else:
                centre, w, b = model
                p = (x - centre) @ w + b
                p = np.exp(p - p.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens), pa.array(list(p), pa.list_(pa.float64()))], names=["doc_id", "tokens", "p"])

    rows = docs.select("doc_id", docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(predict, f"doc_id {dict(docs.dtypes)['doc_id']}, tokens long, p array<double>"), domains


def rate(x: Column, p: Column, steps: list[np.ndarray]) -> Column:
    """A document's rate after the rounds' steps from the rate x, by its posterior."""
    for g in steps:
        x = F.greatest(F.lit(0.0), x - sum((p[i] * float(v) for i, v in enumerate(g)), F.lit(0.0)))
    return x


def default_targets(totals: np.ndarray, thinned: list[int], tempering: float = TEMPERING) -> np.ndarray:
    """As many tokens as there are: thinned domains keep ``THINNED`` of theirs, the others share the rest by tempered shares."""
    targets = np.where(np.isin(np.arange(len(totals)), thinned), totals * THINNED, 0.0)
    share = np.where(np.isin(np.arange(len(totals)), thinned), 0.0, np.maximum(totals, 0.0)) ** tempering
    share[totals <= 0] = 0.0
    if not share.any():
        return totals.copy()
    return targets + share / share.sum() * (totals.sum() - targets.sum())


def solve(table: DataFrame, k: int, targets: np.ndarray | None, thinned: list[int] | None = None) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The table with the rate of each row, the targets and the totals reached; table has tokens and p."""
    n, p, upper = F.col("tokens"), [F.col("p")[i] for i in range(k)], np.triu_indices(k)
    table = table.withColumn("x", F.lit(1.0))

    def sums(x: Column) -> tuple[np.ndarray, np.ndarray]:
        """The domains' totals at the rates x, and their Gram matrix over the rows whose rate isn't 0."""
        columns = [x * n * p[i] for i in range(k)] + [F.when(x > 0, n * p[i] * p[j]) for i, j in zip(*upper, strict=True)]
        found = np.array([float(v or 0) for v in table.agg(*[F.sum(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()])
        gram = np.zeros((k, k))
        gram[upper] = found[k:]
        return found[:k], np.triu(gram) + np.triu(gram, 1).T + np.eye(k) * (1e-9 * np.trace(gram) or 1.0)

    steps: list[np.ndarray] = []
    totals, gram = sums(F.col("x"))
    if targets is None:
        targets = default_targets(totals, thinned or [])
    weight, whole, size = np.linalg.inv(gram), max(targets.sum(), 1e-300), 1.0
    for _ in range(ROUNDS):
        missing = totals - targets
        if np.abs(missing).max() <= TOLERANCE * whole or size < 1 / 32:
            break
        tried = [*steps, size * np.linalg.solve(gram, missing)]
        new, new_gram = sums(rate(F.col("x"), F.col("p"), tried))
        left = (new - targets) @ weight @ (new - targets)
        if left > (missing @ weight @ missing) * (1 - 1e-3 * size):
            size /= 2
            continue
        steps, totals, gram, size = tried, new, new_gram, min(1.0, 2 * size)
        if len(steps) == WRITTEN:  # so that plans stay short
            table, steps = written(table.withColumn("x", rate(F.col("x"), F.col("p"), steps))), []
    return table.withColumn("x", rate(F.col("x"), F.col("p"), steps)), targets, totals


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | None = None, total_tokens: float | None = None, thinned: tuple[str, ...] = (LOW_QUALITY,)) -> DataFrame:
    """doc_id, domain (the likeliest), n_tokens, rate, copies and miss (the same in all rows) of every row.

    ``weights`` are the target shares of the domains (others get none) of ``total_tokens``, by default as many as
    there are.  Without weights the ``thinned`` domains keep ``THINNED`` of their tokens, and the rest goes to the other
    domains by their shares to the power of ``TEMPERING``: large ones shrink and small ones grow.
    """
    rows, domains = posteriors(docs, labelled)
    table = written(rows)
    targets = None
    if weights is not None:
        total = total_tokens if total_tokens is not None else float(table.agg(F.sum("tokens")).first()[0] or 0)
        targets = np.array([weights.get(d, 0.0) for d in domains]) * total / math.fsum(weights.values())
    table, targets, totals = solve(table, len(domains), targets, [i for i, d in enumerate(domains) if d in thinned])
    miss = float(np.abs(totals - targets).max() / max(targets.sum(), 1.0))
    best = F.array_position(F.col("p"), F.array_max("p")).cast("int")
    u = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) / 1_000_000
    out = table.select("doc_id", F.element_at(F.array(*map(F.lit, domains)), best).alias("domain"), F.col("tokens").alias("n_tokens"), F.round("x", 6).alias("rate"))
    copies = (F.floor("rate") + (u < F.col("rate") - F.floor("rate")).cast("int")).cast("int")
    return out.withColumn("copies", copies).withColumn("miss", F.lit(round(miss, 9)))


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and domain of labelled documents: their language, or ``LOW_QUALITY``."""
    domain = F.when(F.col("quality") == 0, LOW_QUALITY).when(F.col("quality") == 1, F.col("lang"))
    return docs.select("doc_id", "lang").join(labels.select("doc_id", "quality"), "doc_id").select("doc_id", domain.alias("domain"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return mix(docs, labelled_domains(docs, labels))
