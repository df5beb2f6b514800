"""Cross-tokenizer alignment against whole texts, encoded and grouped by plain loops."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from loamgrid.llm import op11_alignment as op11
from loamgrid.llm.registry import queries

from .helpers import EDGE, documents


def plain(rows):
    pair = op11.pair_of(op11.VOCABULARY_A, op11.VOCABULARY_B)
    of = op11._byte_level()
    bytes_a = lambda i: bytes(of[c] for c in pair.first.id_to_token(i))
    made, counts = [], Counter()
    for d, text in rows:
        text = text or ""
        ids = pair.first.encode(" " + text, add_special_tokens=False).ids, pair.second.encode(text)
        tokens = [bytes_a(i) for i in ids[0]], [bytes([int(p[3:5], 16)]) if pair.second.is_byte(i) else p.replace("▁", " ").encode() for i in ids[1] for p in [pair.second.id_to_piece(i)]]
        if not text or any(b"".join(t) != (" " + text).encode() for t in tokens):
            made.append((d, 0, 0, 0, [], ""))
            continue
        ends = [np.cumsum([len(x) for x in t]).tolist() for t in tokens]
        shared = set(ends[0]) & set(ends[1])
        groups, own = [], [[], []]
        links, i, j = [], 0, 0
        while i < len(ids[0]):
            links.append((ids[0][i], ids[1][j]))
            at = ends[0][i], ends[1][j]
            if at[0] <= at[1]:
                own[0].append(ids[0][i])
                i += 1
            if at[1] <= at[0]:
                own[1].append(ids[1][j])
                j += 1
            if at[0] == at[1]:
                groups.append("|".join(",".join(map(str, x)) for x in own))
                own = [[], []]
        assert len(groups) == len(shared)
        counts.update(links)
        made.append((d, len(ids[0]), len(ids[1]), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return Counter((d, a, b, g, len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), sha) for d, a, b, g, x, sha in made)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def rows_of(frame):
    return Counter(tuple(r[c] for c in COLUMNS) for r in frame.collect())


ODD = ["a  b", " x", "x ", "\n\n", "  ", "ﬁ x", "▁ x a", "a ▁b", "<s> b <unk> <|endoftext|>", "tab\tx  \t y", "é è ç × ÷ ·", "don't can't I'll", "ab  cd", "ab　 cd", "é x e ́", "日本語 テキスト", "😀 x 👩‍👩‍👧 y", "x\u0000 y", "a\r\nb c", "1 2 3.5 x9 9x", "ſ Å ŉ", "ÀÉ ÿñ a\u0085 b"]


@pytest.mark.parametrize("block_bytes", [100, 8 << 20])
def test_against_plain_loops(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(op11, "BLOCK_BYTES", block_bytes)
    rng = random.Random(6)
    rows = EDGE + [(50 + i, x) for i, x in enumerate(ODD)]
    parts = [p for x in ODD for p in x.split(" ")] + ["the", "Überraschung", "reconnaissance", "\n", "", " ", "zzzzqqq"]
    rows += [(200 + i, rng.choice(["", " "]) + rng.choice([" ", "  ", "\n", ""]).join(rng.choice(parts) for _ in range(rng.randint(1, 25)))) for i in range(150)]
    assert rows_of(op11.alignment(documents(spark, rows, more=True))[0]) == plain(rows)


def test_the_query_on_its_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(queries()["op11_tokenizer_alignment"](spark, sf)) == plain(rows)


def test_pairs_and_empty_table(spark):
    out, pairs = op11.alignment(documents(spark, []))
    assert out.count() == 0 and pairs.count() == 0
    _, pairs = op11.alignment(documents(spark, [(1, "the cat"), (2, "the cat")]))
    assert {r["count"] for r in pairs.collect()} == {2} and all(r["best"] for r in pairs.collect())


def test_union_find_finds_components():
    rng = np.random.default_rng(1)
    for n, m in ((1, 0), (50, 30), (400, 350), (3000, 2999)):
        left, right = (rng.integers(0, n, m) for _ in range(2)) if n < 3000 else (np.arange(m), np.arange(m) + 1)  # or a path
        parent = list(range(n))

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for x, y in zip(left.tolist(), right.tolist(), strict=True):
            a, b = sorted((root(x), root(y)))
            parent[b] = a
        assert op11.union_find(n, left, right).tolist() == [root(x) for x in range(n)]
