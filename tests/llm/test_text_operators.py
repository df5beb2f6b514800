"""Near-duplicates, toxicity, line runs, BPE, token counts and mixing on small tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loamgrid.llm import op1_minhash, op2_toxicity, op5_mixing, op6_bpe, op9_counts, op10_lines

from .helpers import EDGE, documents

SF = "/root/testdata/sf0.01"


# ---------------------------------------------------------------- near-duplicates
def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(n))


def weighted_jaccard(a, b, idf):
    bags = []
    for t in (a, b):
        w = re.findall(r"[a-z0-9_\u0080-\U0010ffff]+", t.translate({c: c + 32 for c in range(65, 91)}))
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))))
    keys = set(bags[0]) | set(bags[1])
    low = sum(min(bags[0][k], bags[1][k]) for k in keys)
    return low / sum(max(bags[0][k], bags[1][k]) for k in keys)


def test_similarity_is_weighted_jaccard():
    rng = random.Random(1)
    a = words(rng, 60)
    b = a.replace(a.split()[10], "zzz")
    flat = np.ones(op1_minhash.DF_BINS, dtype=np.float32)
    got = op1_minhash.similarity(pa.array([a, a, "", None]), pa.array([b, a, "", "x"]), flat)
    assert got == pytest.approx([weighted_jaccard(a, b, flat), 1.0, 0.0, 0.0])


def test_sampling_agrees_as_often_as_texts_are_alike():
    rng = random.Random(2)
    flat = np.ones(op1_minhash.DF_BINS, dtype=np.float32)
    agree, alike = 0, []
    for _ in range(120):
        a = words(rng, 120).split()
        b = a[:100] + words(rng, 20).split()
        both = pa.array([" ".join(a), " ".join(b)])
        _, bands = op1_minhash.draw(*op1_minhash.shingles(both, flat), 2)
        agree += int((bands[0] == bands[1]).sum())
        alike.append(float(op1_minhash.similarity(both[:1], both[1:], flat)[0]))
    expected = np.mean(np.array(alike) ** op1_minhash.ROWS)
    assert agree / (120 * op1_minhash.BANDS) == pytest.approx(expected, abs=0.08)


def test_near_duplicates(spark):
    rng = random.Random(3)
    rows, group = [], {}
    for g in range(12):
        text = words(rng, 150)
        for k in range(5):
            parts = text.split()
            if k:
                parts[rng.randrange(150)] = f"changed{k}"
            group[len(rows) + 100] = g
            rows.append((len(rows) + 100, " ".join(parts)))
    rows += EDGE
    got = {(r["doc_id"], r["class_id"]): r for r in op1_minhash.near_duplicates(documents(spark, rows, more=True)).collect()}
    for d, c in got:
        if d in group:
            assert c == min(x for x, g in group.items() if g == group[d])
    assert sum(r["kept"] for (d, _), r in got.items() if d in group) == 12
    classes = {d: c for d, c in got}
    assert classes[1] == classes[2] == 1 and classes[6] == 5 and classes[None] == 4
    assert op1_minhash.near_duplicates(documents(spark, rows).limit(0)).count() == 0


def test_classes_are_connected_components(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(20)] + [(50, 40), (60, 50)], "node long, hub long")
    got = {r["node"]: r["class"] for r in op1_minhash.components(edges).collect()}
    assert got == {i: 0 for i in range(21)} | {40: 40, 50: 40, 60: 40}


# ---------------------------------------------------------------- toxicity
def test_restoring_obfuscated_words(spark):
    model = op2_toxicity.character_model(spark.read.parquet(f"{SF}/documents.parquet"))
    restored = [op2_toxicity.restore(w, model.tolist()) for w in ("m0r0n", "i d i o t", "stuuuupid", "p@thetic", "tr4sh", "mooron", "a m o r o n")]
    assert restored == ["moron", "idiot", "stupid", "pathetic", "trash", "moron", "a moron"]


def test_scores_do_not_depend_on_partitions(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    assert np.array_equal(op2_toxicity.character_model(docs), op2_toxicity.character_model(docs.repartition(7)))
    scores = [{r["doc_id"]: r["_score"] for r in op2_toxicity.toxicity(d, op2_toxicity.fit(d, labels)).collect()} for d in (docs, docs.repartition(7))]
    assert scores[0].keys() == scores[1].keys() and max(abs(scores[0][k] - scores[1][k]) for k in scores[0]) < 1e-9


def test_counts_of_the_character_model(spark):
    texts = ["ab", "", None, "b", "A-b"]
    want = np.full((27, 27, 27), 0.1)
    for t in texts:
        letters = [0, 0, *[ord(c) - 96 if c.isalpha() else 0 for c in (t or "").lower()], 0, 0]
        for a, b, c in zip(letters, letters[1:], letters[2:], strict=False):
            want[a, b, c] += 1
    got = op2_toxicity.character_model(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    assert np.allclose(got, np.log(want / want.sum(axis=2, keepdims=True)))


def test_words_in_fragments(spark):
    model = op2_toxicity.Restorer(op2_toxicity.character_model(spark.read.parquet(f"{SF}/documents.parquet")))
    known = pa.array(["moron stupid"])
    _, hashes = op2_toxicity._features(*op2_toxicity.tb.text_bytes(known))
    lexicon = op2_toxicity.Lexicon(hashes[0], np.ones(2))
    text = pa.array(["you mo ron, be st up id", "no mor onion", None, "mo  ron", "mo ron"])
    assert op2_toxicity.joined_fragments(*op2_toxicity.tb.text_bytes(text), model, lexicon).to_pylist() == ["moron stupid", "", "", "", "moron"]


def test_long_tokens_are_read_whole(spark):
    model = op2_toxicity.character_model(spark.read.parquet(f"{SF}/documents.parquet")).tolist()
    for token in ("ab1d3" * 200, "thin9s" * 300, "s p 4 c e d  " * 100):
        assert len(op2_toxicity.restore(token, model)) > len(token) / 3
    assert op2_toxicity.restore("x" * 255 + "m0r0n", model).endswith("moron")


def test_parts_that_may_be_obfuscated():
    text = "plain words, (here) stay! but m0r0n mor0 a$$ mooron i d i o t and 2024 don't"
    data, offsets = op2_toxicity.tb.text_bytes(pa.array([text]))
    found = {text[a:b] for a, b, _ in op2_toxicity.obfuscated(data, offsets)}
    assert {"m0r0n", "mor0", "a$$", "mooron", "i d i o t"} <= found and not found & {"plain", "words,", "stay!", "2024", "but"}


def test_long_parts_are_decoded_in_pieces():
    restorer = op2_toxicity.Restorer(np.zeros((27, 27, 27)))
    assert restorer(*op2_toxicity.tb.text_bytes(pa.array(["a1" * 20_000])))[0].as_py()


def brute_restore(token, model):
    """All ways to read a token."""
    best = (float("inf"), "")

    def go(i, a, b, cost, word):
        nonlocal best
        if i == len(token):
            best = min(best, (cost - model[a][b][0], word))
            return
        c = token[i].lower()
        letters = [(c, 0.0)] if "a" <= c <= "z" else []
        letters += [(x, op2_toxicity.SIGN) for x in op2_toxicity.LOOKS_LIKE.get(c, "")]
        letters += [("`", op2_toxicity.WORD_END)] * (c == " ")
        for x, extra in letters:
            n = ord(x) - 96
            go(i + 1, b, n, cost + extra - model[a][b][n], word + x)
            if n and n == b:
                go(i + 1, a, b, cost + extra + op2_toxicity.REPEATED, word)
        if not "a" <= c <= "z":
            go(i + 1, a, b, cost + (op2_toxicity.NOISE if c.isalnum() else op2_toxicity.SEPARATOR), word)

    go(0, 0, 0, 0.0, "")
    return best[1]


def test_viterbi_finds_the_best_reading(spark):
    model = op2_toxicity.character_model(spark.read.parquet(f"{SF}/documents.parquet")).tolist()
    rng = random.Random(4)
    for _ in range(60):
        token = "".join(rng.choice("aeenst1034$.- ") for _ in range(rng.randint(1, 7)))
        assert op2_toxicity.restore(token, model) == brute_restore(token, model).replace("`", " ")


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = op2_toxicity.fit(docs, labels)
    scored = op2_toxicity.toxicity(docs, model).join(labels, "doc_id").where("crc32(cast(doc_id AS string)) % 4 = 2").select("_predicted", "toxic").collect()
    hit = sum(r["_predicted"] and r["toxic"] for r in scored)
    assert hit >= 0.6 * sum(r["toxic"] for r in scored) and hit >= 0.9 * sum(r["_predicted"] for r in scored)
    extra = [(900, "you are a moron and an idiot"), (901, "y0u are a m0r0n and an 1diot, w.o.r.t.h.l.e.s.s and pathetic")]
    edge = {r["doc_id"]: r for r in op2_toxicity.toxicity(documents(spark, EDGE + extra, more=True), model).collect()}
    assert edge[1]["_score"] == edge[2]["_score"] == edge[3]["_score"]
    assert edge[900]["_score"] > edge[2]["_score"] and edge[901]["_score"] > edge[2]["_score"]
    assert op2_toxicity.fit(docs, labels.limit(0)).score(pa.array(["x"]), op2_toxicity.Restorer(model.letters)).tolist() == [0.0]


# ---------------------------------------------------------------- line runs
def without_runs(rows, least):
    seen, out = {}, {}
    for d, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = t.split("\n") if t else []
        gone = [False] * len(lines)
        for i in range(len(lines)):
            n = 0
            for j in range(i, len(lines)):
                n += len(re.findall(r"[A-Za-z0-9_\u0080-\U0010ffff]+", lines[j]))
                if n >= least and seen.setdefault((j - i, "\n".join(lines[i : j + 1])), (d, i)) != (d, i):
                    gone[i : j + 1] = [True] * (j + 1 - i)
        out[d] = (len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("seed,least", [(1, 4), (2, 1), (3, 9)])
def test_line_runs(spark, seed, least):
    rng = random.Random(seed)
    rows = [(i, "\n".join(rng.choice(["a b", "c", "", "d e f", "g é"]) for _ in range(rng.randint(0, 9)))) for i in range(60)]
    rows += [(60, ""), (1, rows[1][1]), (None, rows[2][1]), (61, "a b\n" * 30)]
    want = without_runs(rows, least)
    got = op10_lines.line_dedup(documents(spark, rows + [(62, None)], more=True), least).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        if r["doc_id"] != 62:
            assert (r["_n_lines"], r["_n_removed"], r["text"]) == want[r["doc_id"]]
    assert op10_lines.line_dedup(documents(spark, rows).limit(0)).count() == 0


# ---------------------------------------------------------------- BPE
def digest(x):
    return hashlib.sha256(x).hexdigest()


def test_bpe(spark):
    code = op6_bpe.codec(op6_bpe.VOCABULARY)
    rows = EDGE + [(10, "It's 1,234 <|endoftext|> ok"), (11, "x" * 500), (12, "ÄÖÜ e\u0301 İ \u00a0 tab\there")]
    got = Counter(map(tuple, op6_bpe.bpe(documents(spark, rows, more=True), segment_chars=200).collect()))
    want = Counter()
    for d, t in rows:
        ids = code.tokenizer.encode(t or "", add_special_tokens=False).ids
        text = code.tokenizer.decode(ids, skip_special_tokens=False)
        want[d, len(ids), digest(np.array(ids, dtype="<u4").tobytes()), digest(text.encode())] += 1
    assert got == want
    assert op6_bpe.bpe(documents(spark, rows).limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abehint 's1.é\n"), max_size=300), st.integers(15, 60))
def test_joined_segments_are_the_whole(text, size):
    code = op6_bpe.codec(op6_bpe.VOCABULARY)
    parts = [text[i : i + size] for i in range(0, len(text), size)] or [""]
    joined = op6_bpe.join_all(code, parts, [code.tokens_by_word(p) for p in parts])
    assert joined[:, 0].tolist() == code.tokenizer.encode(text, add_special_tokens=False).ids


# ---------------------------------------------------------------- token counts
def greedy(word, begin, go_on):
    at = n = 0
    while at < len(word):
        for end in range(len(word), at, -1):
            if word[at:end] in (go_on if at else begin):
                break
        else:
            return -1
        at, n = end, n + 1
    return n


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=4), max_size=8), st.sets(st.text("abc", min_size=1, max_size=4), max_size=8), st.text("abcd", max_size=9))
def test_automaton_is_greedy(begin, go_on, word):
    assert op9_counts.Automaton(begin, go_on).length(word) == greedy(word, begin, go_on)


def test_token_counts(spark):
    begin, go_on = map(set, op9_counts.pieces())
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40).union(spark.createDataFrame([(d, t, None, None, None) for d, t in EDGE], "doc_id long, text string, lang string, source string, n_chars long"))
    got = Counter(map(tuple, op9_counts.token_counts(docs).collect()))
    want = Counter()
    for r in docs.collect():
        found = [greedy(w, begin, go_on) for w in re.findall(r"[A-Za-z0-9_\u0080-\U0010ffff]+|[^\sA-Za-z0-9_\u0080-\U0010ffff]", r["text"] or "")]
        want[r["doc_id"], sum(map(abs, found)), len(found), sum(n < 0 for n in found)] += 1
    assert got == want
    assert op9_counts.token_counts(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- mixing
def plain_rates(n, p, targets, rounds=20_000):
    """Nonnegative least squares by many short projected gradient steps."""
    weight, x = np.linalg.inv((p * n[:, None]).T @ p), np.ones(len(n))
    for _ in range(rounds):
        x = np.maximum(0, x - 0.5 * p @ weight @ ((x * n) @ p - targets))
    return x, weight


@pytest.mark.parametrize("share", [[1, 1, 1], [5, 2, 1], [0.2, 0.2, 3], [0, 1, 1], [0, 0, 1]])
def test_rates_are_those_of_plain_least_squares(spark, share):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.5, 0.5, 0.5], 300)
    n = rng.integers(0, 50, 300)
    table = spark.createDataFrame([(i, int(a), [float(v) for v in b]) for i, (a, b) in enumerate(zip(n, p, strict=True))], "i int, tokens long, p array<double>")
    targets = np.array(share) / sum(share) * n.sum()
    rows, _, totals = op5_mixing.solve(table, 3, targets)
    x = np.array([r["x"] for r in rows.orderBy("i").collect()])
    assert (x >= 0).all() and (x * n) @ p == pytest.approx(totals)
    want, weight = plain_rates(n, p, targets)

    def left(rates):
        miss = (rates * n) @ p - targets
        return miss @ weight @ miss / n.sum()

    assert left(x) <= left(want) + 0.02 * left(np.ones(300)) and (left(want) > 1e-9 or left(x) < 1e-3)
    if min(share) > 0:  # targets that can be met
        assert np.abs(totals - targets).max() < 2e-6 * targets.sum()
    if share in ([0, 1, 1], [0, 0, 1]):  # rates are held at 0
        assert (x == 0).any()


def test_targets_thin_and_grow():
    totals = np.array([800.0, 100.0, 100.0, 50.0, 0.0])
    targets = op5_mixing.default_targets(totals, [2])
    assert targets.sum() == pytest.approx(totals.sum()) and targets[2] == 25.0 and targets[4] == 0.0
    assert targets[0] < totals[0] and targets[1] > totals[1] and targets[3] > totals[3]
    assert targets[0] / targets[1] == pytest.approx(8**op5_mixing.TEMPERING)
    assert op5_mixing.default_targets(np.array([3.0]), [0]).tolist() == [3.0]


def test_mixing(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    labelled = op5_mixing.labelled_domains(docs, labels)
    out = op5_mixing.mix(docs, labelled)
    row = out.selectExpr("min(rate) AS low", "max(rate) AS high", "count(*) AS n", "max(miss) AS miss").first()
    assert 0 <= row["low"] < 0.6 and row["high"] > 1.2 and row["n"] == docs.count() and row["miss"] < 1e-5
    # expected tokens of the domains, from the posteriors themselves
    p, domains = op5_mixing.posteriors(docs, labelled)
    p = {r["doc_id"]: np.array(r["p"]) for r in p.collect()}
    rows = out.collect()
    totals = sum(p[r["doc_id"]] * r["n_tokens"] for r in rows)
    reached = sum(p[r["doc_id"]] * r["n_tokens"] * r["rate"] for r in rows)
    assert reached == pytest.approx(op5_mixing.default_targets(totals, [domains.index(op5_mixing.LOW_QUALITY)]), rel=1e-3)
    assert all(np.isclose(x.sum(), 1) and r["domain"] == domains[int(x.argmax())] for r in rows for x in [p[r["doc_id"]]])
    assert all(int(r["rate"]) <= r["copies"] <= int(r["rate"]) + 1 for r in rows)
    true = {r["doc_id"]: r["domain"] for r in labelled.where("domain IS NOT NULL").collect()}
    found = {r["doc_id"]: r["domain"] for r in rows}
    assert sum(found[d] == x for d, x in true.items()) / len(true) > 0.8
    weights = {"en": 1.0, "de": 1.0, "fr": 1.0, "es": 1.0}
    shares = {r["domain"]: r["t"] for r in op5_mixing.mix(docs, labelled, weights).groupBy("domain").agg({"rate": "avg", "n_tokens": "sum"}).toDF("domain", "r", "t").collect()}
    assert set(shares) >= set(weights)
    edge = op5_mixing.mix(documents(spark, EDGE, more=True), labelled.limit(0))
    assert edge.count() == len(EDGE) and {r["domain"] for r in edge.collect()} == {"all"}
    assert op5_mixing.mix(documents(spark, EDGE).limit(0), labelled).count() == 0
