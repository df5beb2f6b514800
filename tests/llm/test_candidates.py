"""Near-duplicates in groups of texts that are unlike their hub, against all pairs that share a band."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from loamgrid.llm import op1_minhash

from .helpers import documents


def family(rng, pairs, words=200, changed=3, single=2):
    """Pairs of like texts round one template; texts of different pairs are less alike."""
    template = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    rows = []
    for _ in range(pairs):
        own = list(template)
        for at in rng.sample(range(words), changed):
            own[at] = rng.choice(template)
        for _ in range(2):
            text = list(own)
            for at in rng.sample(range(words), single):
                text[at] = rng.choice(template)
            rows.append((len(rows), " ".join(text)))
    rng.shuffle(rows)
    return rows


def all_pairs(rows, idf):
    """Class of each text by comparing all pairs that share a band."""
    texts = pa.array([t for _, t in rows])
    _, bands = op1_minhash.draw(*op1_minhash.shingles(texts, idf), len(rows))
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows) - 1):
        others = i + 1 + np.flatnonzero((bands[i + 1 :] == bands[i]).any(axis=1))
        if len(others):
            sims = op1_minhash.similarity(texts.take(pa.array([i] * len(others))), texts.take(pa.array(others)), idf)
            for j in others[sims >= op1_minhash.SIMILARITY]:
                parent[top(int(j))] = top(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(d, least.get(top(i), d))
    return {d: least[top(i)] for i, (d, _) in enumerate(rows)}


@pytest.mark.parametrize("block", [400, 7])
def test_texts_unlike_their_hub_are_compared(spark, monkeypatch, block):
    rows = family(random.Random(5), 150)
    docs = documents(spark, rows)
    want = all_pairs(rows, op1_minhash.document_frequencies(docs))
    assert len(set(want.values())) < len(rows) * 0.7
    monkeypatch.setattr(op1_minhash, "BLOCK_NODES", block, raising=False)
    got = op1_minhash.near_duplicates(docs).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == want
    assert all(r["n_links"] > 0 for r in got if r["class_size"] > 1)


def test_tiles_have_the_similarity_of_pairs():
    rng = random.Random(6)
    texts = pa.array([" ".join(rng.choice("ab") for _ in range(rng.randint(1, 40))) for _ in range(30)] + ["c d e f g h", ""])
    idf = np.random.default_rng(1).random(op1_minhash.DF_BINS).astype(np.float32) + 0.1
    left, right = np.arange(12), np.arange(10, 32)
    got = op1_minhash.alike(*op1_minhash.shingles(texts, idf), left, right)
    for i, x in enumerate(left):
        pairs = texts.take(pa.array([x] * len(right))), texts.take(pa.array(right))
        assert got[i] == pytest.approx(op1_minhash.similarity(*pairs, idf))


def test_classes_do_not_depend_on_partitions(spark):
    docs = documents(spark, family(random.Random(8), 100))
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in ("1", "23"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got.append({r["doc_id"]: (r["class_id"], r["n_links"]) for r in op1_minhash.near_duplicates(docs).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1]


def test_variates_follow_a_gamma_distribution():
    x = op1_minhash._gamma_quantiles()
    assert (np.diff(x) > 0).all() and np.allclose(1 - (1 + x) * np.exp(-x), (np.arange(len(x)) + 0.5) / len(x), atol=1e-9)


def test_recall_over_the_whole_table(spark):
    """Classes against weighted Jaccard similarities of all pairs, computed with sets of words and plain counts."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: [w.decode() for w in re.findall(rb"[0-9A-Za-z_\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (r["text"] or "").encode()))] if (r["text"] or "").isascii() else None for r in docs.collect()}
    words = {r["doc_id"]: [w for w in re.findall(r"[0-9A-Za-z_\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in r["text"] or ""))] for r in docs.collect()}
    assert all(words[d] == t for d, t in texts.items() if t is not None)
    df = Counter(w for own in words.values() for w in set(own))
    idf = {w: math.log((len(words) + 1) / (n + 1)) + 0.1 for w, n in df.items()}
    weights, where = {}, {}
    for d, own in words.items():
        runs = Counter(tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))) if own else Counter()
        weights[d] = {s: n * sum(idf[w] for w in s) / len(s) for s, n in runs.items()}
        for s in runs:
            where.setdefault(s, []).append(d)
    total, common = {d: sum(w.values()) for d, w in weights.items()}, Counter()
    for s, ids in where.items():
        for a, b in itertools.combinations(sorted(ids), 2):
            common[a, b] += min(weights[a][s], weights[b][s])
    sims = {p: c / (total[p[0]] + total[p[1]] - c) for p, c in common.items()}
    got = {r["doc_id"]: r["class_id"] for r in op1_minhash.near_duplicates(docs).collect()}
    alike = [p for p, s in sims.items() if s >= 0.8]
    assert len(alike) > 50 and sum(got[a] == got[b] for a, b in alike) >= 0.99 * len(alike)
    # a document shares its class with one that it is like
    partners = Counter(x for p, s in sims.items() if s >= 0.79 for x in p)
    sizes = Counter(c for d, c in got.items() if words[d])
    assert all(partners[d] for d, c in got.items() if words[d] and sizes[c] > 1)
