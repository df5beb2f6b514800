"""Exact dedup and suffix-array dedup against plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from loamgrid.llm import op7_exact, op8_suffixes
from loamgrid.llm.registry import oracle_sql, queries

from ..oracle import compare, connection
from .helpers import EDGE, documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def exact(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[(t or "").translate(LOWER)].append(d)
    out = []
    for x, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(d, keep, len(ids), keep is None or d == keep, hashlib.sha256(x.encode()).hexdigest()) for d in ids]
    return Counter((*r[:3], bool(r[3]), r[4]) for r in out)


@pytest.mark.parametrize("bucket_bytes", [150, 2000, None])
def test_exact_dedup(spark, bucket_bytes):
    rng = random.Random(1)
    rows = EDGE + [(100 + i, "".join(rng.choice("aAbB") for _ in range(rng.randint(0, 3)))) for i in range(80)]
    got = Counter(map(tuple, op7_exact.exact_dedup(documents(spark, rows, more=True), bucket_bytes).collect()))
    assert got == exact(rows)


def test_colliding_keys_are_told_apart_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(op7_exact.F, "xxhash64", lambda *c: op7_exact.F.lit(5).cast("long"))
    rows = [(i, x) for i, x in enumerate(["a", "A", "b", "a b", "B", "a", None, ""])]
    for bucket_bytes in (64, 10_000):
        assert Counter(map(tuple, op7_exact.exact_dedup(documents(spark, rows), bucket_bytes).collect())) == exact(rows)


def test_directory_splits_only_full_buckets(spark):
    chains = spark.range(200).selectExpr("xxhash64(id) AS key", "1L AS load")
    entries, depth, buckets = op7_exact.directory(chains, 20)
    rows = {r["cell"]: r["bucket"] for r in entries.collect()}
    assert sorted(rows) == list(range(1 << depth)) and set(rows.values()) == set(range(buckets))
    sizes = Counter(rows[(r["key"] & (1 << 64) - 1) >> (64 - depth)] for r in chains.collect())
    assert sum(sizes.values()) == 200 and max(sizes.values()) <= 20 and 8 < buckets < 1 << depth
    assert [rows[c] for c in sorted(rows)] == sorted(rows.values())  # a bucket's entries lie side by side


def test_query_has_many_buckets_and_owners(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    op7_exact.exact_dedup(docs, folder=str(tmp_path))
    index = spark.read.parquet(str(tmp_path / "index"))
    assert index.select("bucket").distinct().count() > 8 and spark.read.parquet(str(tmp_path / "directory")).count() >= 16
    owners = index.withColumn("file", op7_exact.F.input_file_name()).groupBy("bucket", "piece").agg(op7_exact.F.count_distinct("file").alias("n"))
    assert owners.where("n > 1").count() == 0


def test_exact_dedup_sql(spark):
    sf = "/root/testdata/sf0.01"
    name = "op7_exact_dedup"
    more, less = compare(queries()[name](spark, sf), connection(sf), oracle_sql()[name])
    assert not more and not less


def repeats(rows, length):
    texts = [(d, (t or "").encode()) for d, t in rows]
    times = Counter(b[i : i + length] for _, b in texts for i in range(len(b) - length + 1))
    out = Counter()
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if times[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()] += 1
    return out


@pytest.mark.parametrize("length,buckets", [(8, 60), (20, 25), (20, 3), (20, 1)])
def test_suffix_dedup(spark, length, buckets, monkeypatch):
    monkeypatch.setattr(op8_suffixes, "STRINGS", 200 if buckets == 3 else 1 << 20)
    rng = random.Random(length)
    parts = ["".join(rng.choice("abcdé") for _ in range(rng.randint(0, 60))) for _ in range(6)] + ["ab" * 30, ""]
    rows = [(i, "".join(rng.choice(parts)[rng.randint(0, 20) :] for _ in range(rng.randint(0, 5)))) for i in range(90)]
    rows += [r for r in EDGE if r[1] is None or len(r[1]) < 2000]
    got = Counter(map(tuple, op8_suffixes.cut_repeats(documents(spark, rows, more=True), length, buckets).collect()))
    assert got == repeats(rows, length)


def test_empty_tables(spark):
    none = documents(spark, EDGE).limit(0)
    assert op7_exact.exact_dedup(none).count() == 0
    assert op8_suffixes.cut_repeats(none).count() == 0


def test_suffix_dedup_keeps_other_bytes(spark):
    passage = "".join(random.Random(3).choice("abcdefghij ") for _ in range(450))
    rows = [(1, "one " + passage + " end"), (2, "two" + passage), (3, "nothing of it")]
    left = {r["doc_id"]: bytes(r["kept"]) for r in op8_suffixes.cut_repeats(documents(spark, rows), keep_text=True).collect()}
    assert left == {1: b"one  end", 2: b"two", 3: b"nothing of it"}


def test_multikey_quicksort():
    rng = np.random.default_rng(4)
    for letters, width in ((2, 21), (200, 9), (1, 40)):
        data = rng.integers(0, letters, 3000).astype(np.uint8)
        starts = rng.permutation(len(data) - width)[:1500]
        raw = data.tobytes()
        order = op8_suffixes.multikey_quicksort(data, starts, width)
        got = [raw[s : s + width] for s in starts[order].tolist()]
        assert sorted(order.tolist()) == list(range(1500)) and got == sorted(got)


def test_strings_with_colliding_hashes_are_compared(monkeypatch):
    data = np.frombuffer(b"abcdefgh" * 3 + b"abcdXfgh" * 2, dtype=np.uint8)
    start = np.arange(len(data) - 7)
    want = op8_suffixes.repeated_strings(data, start, 8).tolist()
    raw = data.tobytes()
    times = Counter(raw[s : s + 8] for s in start)
    assert want == [times[raw[s : s + 8]] > 1 for s in start]
    monkeypatch.setattr(op8_suffixes.tb.Rolling, "span", lambda self, a, b: np.zeros(len(a), dtype=np.uint64))
    assert op8_suffixes.repeated_strings(data, start, 8).tolist() == want


def test_hot_windows_have_strings_compared_across_buckets(spark):
    """One passage in most rows: its windows are splitters more than once."""
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(60))
    rows = [(i, "".join(rng.choice("klmnop") for _ in range(rng.randint(0, 15))) + passage + "".join(rng.choice("qrstu") for _ in range(rng.randint(0, 15)))) for i in range(150)]
    docs = documents(spark, rows)
    text = docs.selectExpr("xxhash64(doc_id, text) AS dk", "doc_id", "text")
    _, hot = op8_suffixes.splitters(text, op8_suffixes.candidate_stretches(text, 20), 20, 40)
    assert hot
    assert Counter(map(tuple, op8_suffixes.cut_repeats(docs, 20, 40).collect())) == repeats(rows, 20)


def test_suffix_dedup_of_the_whole_table(spark):
    """The query at its own length against the count of every string of that length."""
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r[0]: tuple(r) for r in queries()["op8_suffix_dedup"](spark, sf).collect()}
    data = np.frombuffer("".join(t or "" for _, t in rows).encode(), dtype=np.uint8)
    raw, at, strings = data.tobytes(), 0, Counter()
    sizes = [len((t or "").encode()) for _, t in rows]
    for n in sizes:
        strings.update(hashlib.blake2b(raw[s : s + 400], digest_size=8).digest() for s in range(at, at + n - 399))
        at += n
    at = 0
    for (d, _), n in zip(rows, sizes, strict=True):
        gone = np.zeros(n + 1, dtype=np.int64)
        for s in range(n - 399):
            if strings[hashlib.blake2b(raw[at + s : at + s + 400], digest_size=8).digest()] > 1:
                gone[s] += 1
                gone[s + 400] -= 1
        mask = np.cumsum(gone)[:n] > 0
        left = data[at : at + n][~mask].tobytes()
        assert got[d] == (d, n, int(mask.sum()), int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum()), hashlib.sha256(left).hexdigest())
        at += n
