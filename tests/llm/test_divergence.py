"""Source divergence against exact arithmetic in plain Python, and its SQL."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from loamgrid.llm import op13_divergence as op13
from loamgrid.llm.registry import oracle_sql, queries

from ..oracle import compare, connection

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, min_docs, top):
    n, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = TERM.findall((text or "").translate(LOWER))
        n[lang, source].update(found)
        df[lang].update(set(found))
    out = Counter()
    for lang, sources in groups.items():
        kept = [t for t, k in df[lang].items() if k >= min_docs]
        v = len(kept)

        def share(counts, kept=kept, v=v):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * v) for t in kept}

        own = {s: share(n[lang, s]) for s in sources}
        whole = share(sum((n[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = {o: sum((own[s][t] - own[o][t]) ** 2 // (own[s][t] + own[o][t]) for t in kept) for o in sources if o != s}
            terms = {t: (own[s][t] - whole[t]) ** 2 // (own[s][t] + whole[t]) for t in kept if n[lang, s][t] and own[s][t] > whole[t]}
            for part, values, most in (("pair", pairs, None), ("term", terms, top)):
                for i, (item, value) in enumerate(sorted(values.items(), key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out[lang, s, part, item, value, i] += 1
    return out


def found(rows):
    return Counter((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in rows.collect())


@pytest.mark.parametrize("terms,groups,at_once", [(2048, 128, 1 << 20), (3, 2, 5)])
def test_against_plain_arithmetic(spark, monkeypatch, terms, groups, at_once):
    for name, value in (("TERMS", terms), ("GROUPS", groups), ("AT_ONCE", at_once), ("BLOCK_BYTES", 200)):
        monkeypatch.setattr(op13, name, value)
    rng = random.Random(3)
    words = ["a", "B", "é", "É", "zz", "𐐀", "ab", "Ab", "￮"] + [f"w{c}" for c in "abcdefgh"]
    rows = [(" ,7".join(rng.choice(words) for _ in range(rng.randint(0, 12))), rng.choice(["x", "x", "y", None]), rng.choice(["s1", "s2", "s3", "s4", "s5", None, ""])) for _ in range(150)]
    rows += [(None, "x", "silent"), ("", None, "s1"), ("rare words only", "z", "one"), ("nothing", "z", "two"), ("a " * 40_000, "x", "s1")] + [("a b", "lone", "one")] * 12
    docs = spark.createDataFrame([(*r, "n", "t") for r in rows], "text string, lang string, source string, term string, salt string")
    assert found(op13.divergence(docs, min_docs=3)) == plain(rows, 3, 10)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "text string, lang string, source string")
    assert op13.divergence(docs).count() == 0
    assert found(op13.divergence(spark.createDataFrame([(None, None, None), ("1 2", None, "a")], docs.schema))) == plain([(None, None, None), ("1 2", None, "a")], 10, 10)


def test_shares_of_large_counts():
    rng = random.Random(5)
    for _ in range(200):
        total = rng.randint(1, 8 * 10**15)
        count, kept = rng.randint(0, total), rng.randint(1, 10**9)
        assert op13.shares(np.array([count]), np.array([total]), kept)[0] == 1 + 10**9 * (count + 2) // (total + 2 * kept)


def test_sql(spark):
    sf, name = "/root/testdata/sf0.01", "op13_source_divergence"
    more, less = compare(queries()[name](spark, sf), connection(sf), oracle_sql()[name])
    assert not more and not less
