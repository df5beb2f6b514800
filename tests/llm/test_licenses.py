"""License scans against plain Python, and their SQL."""

import random
import re
from collections import Counter, defaultdict

import pytest

from loamgrid.llm import op12_licenses as op12
from loamgrid.llm.registry import oracle_sql, queries

from ..oracle import compare, connection
from .helpers import EDGE, documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PHRASES = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}


def plain(rows):
    out = Counter()
    for d, text in rows:
        words = re.findall(op12.WORD, (text or "").translate(LOWER))
        at = {label: [i for i in range(len(words)) if words[i : i + len(p)] == p] for label, p in PHRASES.items()}
        every = sorted(sum(at.values(), []))
        labels, score = {k for k, v in at.items() if v}, float(bool(every))
        base = ",".join(sorted(labels))
        for label, template in op12.TEXTS:
            own = template.split()
            k = op12.GRAM
            diagonals = defaultdict(list)
            for j in range(len(own) - k + 1):
                for i in range(len(words) - k + 1):
                    if words[i : i + k] == own[j : j + k]:
                        diagonals[i - j].append(j)
            spans, last = [], None
            for diagonal in sorted(diagonals):
                if last is None or diagonal - last > op12.SHIFT:
                    spans.append([])
                spans[-1] += [(j, j + diagonal) for j in diagonals[diagonal]]
                last = diagonal
            for span in spans:
                mine, there = ({x + i for x in part for i in range(k)} for part in zip(*span, strict=True))
                share = len(mine) / len(own)
                score = max(score, share)
                if share >= op12.COVER and len(there) >= op12.DENSE * (max(there) - min(there) + 1):
                    labels.add(label)
        out[d, len(words), len(every), every[0] if every else None, every[-1] if every else None, base, ",".join(sorted(labels)), score] += 1
    return out


COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def rows_of(frame):
    return Counter(tuple(r[c] for c in COLUMNS) for r in frame.collect())


def test_against_plain_python(spark):
    rng = random.Random(4)
    rows = list(EDGE)
    for i in range(120):
        words = []
        for _ in range(rng.randint(0, 5)):
            _, template = rng.choice(op12.TEXTS + op12.BASE)
            own = template.split()
            for _ in range(rng.randint(0, 4)):  # words put in, left out or changed
                j = rng.randrange(len(own))
                own[j : j + rng.randint(0, 1)] = rng.choice([[], ["odd"], ["Very", "odd"]])
            words += [*own, *(rng.choice(["the", "license", "general", "Public", "MIT", "é", "x9"]) for _ in range(rng.randint(0, 6)))]
        rows.append((100 + i, rng.choice([" ", "\n", " - "]).join(words)))
    got = op12.scan(documents(spark, rows, more=True))
    assert rows_of(got) == plain(rows)
    assert got.where("size(spans) > 0").count() > 50


def test_a_notice_with_changes_is_one_span(spark):
    label, text = op12.TEXTS[3]
    words = text.split()
    changed = [*words[:8], "gladly", *words[8:14], *words[15:]]
    got = op12.scan(documents(spark, [(1, "x y " + " ".join(changed)), (2, " ".join(words[:6]))]))
    one, two = sorted(got.collect(), key=lambda r: r["doc_id"])
    assert one["labels"] == label and one["base_labels"] == "" and [(s["first"], s["last"]) for s in one["spans"]] == [(2, 1 + len(changed))]
    assert two["labels"] == "" and 0 < two["score"] < op12.COVER


def test_repeated_words_and_empty_table(spark):
    rows = [(1, "mit license " * 300), (2, "general public general public license license"), (2, "general public general public license license")]
    assert rows_of(op12.scan(documents(spark, rows))) == plain(rows)
    assert op12.scan(documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        op12.places([("x", "one")], [])


def test_no_python_on_executors_and_no_texts_in_shuffles(spark):
    plan = queries()["op12_license_scan"](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|MapInArrow", plan)
    moved = re.findall(r"Exchange hashpartitioning\(([^\n]*)", plan)
    # hits, by document; and the templates
    assert {x.split("#")[0] for x in moved} <= {"row", "hash2", "hash4", "_groupingexpression"} and not any("gram" in x for x in moved)


def test_sql(spark):
    sf, name = "/root/testdata/sf0.01", "op12_license_scan"
    more, less = compare(queries()[name](spark, sf), connection(sf), oracle_sql()[name])
    assert not more and not less
