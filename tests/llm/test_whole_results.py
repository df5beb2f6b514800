"""Results of the toxicity and mixing queries on their tables against plain versions."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loamgrid.llm import op2_toxicity as op2
from loamgrid.llm import op5_mixing as op5
from loamgrid.llm.registry import queries

SF = "/root/testdata/sf0.01"
WORD = re.compile(rb"[a-z0-9_\x80-\xff]+")


def lowered(text):
    return (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))


def entries(word):
    return [("word", word), *[(n, word[:n]) for n in op2.BEGINNINGS if len(word) >= n]]


def plain_words(text, letters):
    """Words as they are, and restored ones."""
    raw = (text or "").encode()
    data, offsets = op2.tb.text_bytes(pa.array([text or ""]))
    found = WORD.findall(lowered(text))
    for a, b, _ in op2.obfuscated(data, offsets):
        word = op2.restore(raw[a:b].decode("utf-8", "replace"), letters)
        if len(word) > 2:
            found += WORD.findall(word.encode())
    return found


def fragments(text, letters, lexicon):
    raw, out = lowered(text), []
    words = list(WORD.finditer(raw))
    for k in (2, 3):
        for i in range(len(words) - k + 1):
            part = words[i : i + k]
            if all(len(w.group()) <= op2.FRAGMENT and w.group().isalpha() for w in part) and all(b.start() == a.end() + 1 and raw[a.end()] == 32 for a, b in zip(part, part[1:], strict=False)):
                joined = b"".join(w.group() for w in part)
                if len(joined) >= op2.BEGINNINGS[0] and ("word", joined) in lexicon and op2.restore(raw[part[0].start() : part[-1].end()].decode(), letters).encode() == joined:
                    out.append(joined)
    return out


def measure(text, words, letters, lexicon):
    words = words + fragments(text, letters, lexicon)
    weight = {w: max([lexicon.get(e, 0.0) for e in entries(w)], default=0.0) for w in set(words)}
    hits = [w for w in words if weight[w] > 0]
    one = set(hits)
    total, size = sum(weight[w] for w in one), math.log1p(len(words))
    return [total, max([weight[w] for w in one], default=0.0), math.sqrt(len(one)), total / (1 + size), math.sqrt(len(hits) / max(1, len(words))), size * bool(one)]


def lexicon_of(sets, toxic):
    n_b, n_c = sum(toxic), len(toxic) - sum(toxic)
    b, c = Counter(), Counter()
    for s, t in zip(sets, toxic, strict=True):
        (b if t else c).update(s)
    out = {}
    for e, x in b.items():
        y = c[e]
        term = lambda n, of: n * math.log(n / of) if n else 0.0
        g = term(x, n_b) + term(n_b - x, n_b) + term(y, n_c) + term(n_c - y, n_c) - term(x + y, n_b + n_c) - term(n_b + n_c - x - y, n_b + n_c)
        odds = math.log((x + 0.5) / (n_b - x + 0.5)) - math.log((y + 0.5) / (n_c - y + 0.5))
        if x >= op2.LEAST_TEXTS and math.sqrt(2 * max(0, g)) >= op2.LEAST_Z and odds > 1:
            out[e] = odds
    return out


def logistic(x, y):
    """Ridge logistic regression on standardised columns, by plain Newton steps."""
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    beta, ridge = np.zeros(z.shape[1]), np.diag([1.0] * x.shape[1] + [1e-6])
    for _ in range(200):
        p = 1 / (1 + np.exp(-z @ beta))
        beta = beta + 0.5 * np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (y - p) - ridge @ beta)
    return lambda v: 1 / (1 + np.exp(-(((v - centre) / scale) @ beta[:-1] + beta[-1])))


def test_toxicity_scores(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    fold = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(2)).alias("fold")
    rows = {r["doc_id"]: r for r in docs.select("doc_id", "text", fold, (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("out")).collect()}
    counts = np.full((27, 27, 27), 0.1)
    for r in rows.values():
        c = [0, 0, *[ord(x) - 96 if "a" <= x <= "z" else 0 for x in lowered(r["text"]).decode("latin-1")], 0, 0]
        np.add.at(counts, (c[:-2], c[1:-1], c[2:]), 1)
    letters = np.log(counts / counts.sum(axis=2, keepdims=True)).tolist()
    words = {d: plain_words(r["text"], letters) for d, r in rows.items()}
    learn = [(r["doc_id"], r["toxic"]) for r in labels.collect() if r["doc_id"] in rows and not rows[r["doc_id"]]["out"]]
    sets = {d: {e for w in words[d] for e in entries(w)} for d, _ in learn}
    half = [lexicon_of([sets[d] for d, _ in learn if rows[d]["fold"] == f], [t for d, t in learn if rows[d]["fold"] == f]) for f in (1, 0)]
    x = np.array([measure(rows[d]["text"], words[d], letters, half[rows[d]["fold"]]) for d, _ in learn])
    score, lexicon = logistic(x, np.array([t for _, t in learn], dtype=float)), lexicon_of([sets[d] for d, _ in learn], [t for _, t in learn])
    got = {r["doc_id"]: r for r in queries()["op2_toxicity"](spark, SF).collect()}
    assert got.keys() == rows.keys() and len(lexicon) > 5
    for d, r in rows.items():
        want = score(np.array(measure(r["text"], words[d], letters, lexicon)))
        assert abs(got[d]["score"] - want) < 1e-6 and got[d]["held_out"] == r["out"] and got[d]["predicted"] == int(got[d]["score"] >= 0.3)


def test_mixing_rates(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.orderBy("doc_id").collect()]
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    x = np.zeros((len(rows), op5.BINS))
    for i, (_, text, _) in enumerate(rows):
        raw = lowered(text)
        for a, b in zip(raw, raw[1:], strict=False):
            x[i, ((a * 2654435761 + b * 40503 * 65537) % 2**32) >> 22] += 1
        x[i] = np.sqrt(x[i] / max(1, len(raw) - 1))
    domain = [None if quality.get(d) is None else "low quality" if quality[d] == 0 else lang for d, _, lang in rows]
    names = sorted({d for d in domain if d})
    known = [i for i, d in enumerate(domain) if d]
    centre, w, b = op5.fit_softmax(x[known].astype(np.float32), np.array([names.index(domain[i]) for i in known]), len(names))
    p = np.exp((x - centre) @ w + b)
    p /= p.sum(axis=1, keepdims=True)
    tokens = np.array([len(re.findall(rb"[A-Za-z0-9_\x80-\xff]+", (t or "").encode())) for _, t, _ in rows], dtype=float)
    got = {r["doc_id"]: r for r in queries()["op5_mixing"](spark, SF).collect()}
    assert [got[d]["n_tokens"] for d, _, _ in rows] == tokens.tolist()
    assert np.mean([got[d]["domain"] == names[k] for (d, _, _), k in zip(rows, p.argmax(axis=1), strict=True)]) > 0.999
    # the rates that are reported meet the targets by the plain posteriors, and are those of least squares
    rates = np.array([got[d]["rate"] for d, _, _ in rows])
    totals = tokens @ p
    targets = np.where(np.array(names) == "low quality", totals * op5.THINNED, 0.0)
    share = np.where(np.array(names) == "low quality", 0.0, totals**op5.TEMPERING)
    targets += share / share.sum() * (totals.sum() - targets.sum())
    assert (rates >= 0).all() and np.abs((rates * tokens) @ p - targets).max() < 2e-3 * targets.sum()
    assert {r["miss"] for r in got.values()} == {next(iter(got.values()))["miss"]}
    assert all(abs(r["copies"] - r["rate"]) < 1 for r in got.values())


def test_softmax_comes_near_its_optimum():
    rng = np.random.default_rng(5)
    y = rng.integers(0, 3, 300)
    x = rng.normal(size=(300, 6)) + np.eye(3)[y] @ rng.normal(size=(3, 6))
    centre, w, b = op5.fit_softmax(x, y, 3, rounds=4000)
    p = np.exp((x - centre) @ w + b)
    p /= p.sum(axis=1, keepdims=True)
    slope = (x - centre).T @ (p - np.eye(3)[y]) / len(x) + 1e-4 * w
    assert np.abs(slope).max() < 1e-4
