"""Operator 8: removal of byte strings that occur more than once, by a sparse suffix array.

Every byte is removed that a ``length``-byte string covers which also starts
anywhere else.  Sorting the suffixes at all bytes would move many times the
input, so only those at anchors are sorted: each string's anchor is the place
in it where a window of half its length has the smallest hash, which is the
same place in every copy of the string.  Strings with an anchor in common start
at neighbouring bytes; such a stretch of starts is one row.

1. Suffixes at anchors whose leading window is nowhere else leave, by the
   window's hash: a task keeps those that it has seen twice itself and sends one
   row for each other hash, so a common window costs one row a task.
2. Splitters are taken from a sample of the suffixes that are left: their leading
   windows' real bytes, in order.  Suffixes, with the bytes of their stretch, are
   dealt to buckets by these splitters.  A stretch that a task has met before is
   a repeat already and isn't sent again.
3. Each bucket sorts its suffixes by multikey quicksort on their bytes.
   Neighbours with the same leading window form an interval of the suffix array;
   the strings of an interval are matched by their hashes, and the matched runs
   are compared byte by byte.
4. A window that fills buckets of its own (it is a splitter more than once) would
   have its interval cut by bucket borders.  The strings of such intervals are
   compared across buckets instead: each task sends one row for each different
   string, by two independent 64-bit hashes of its bytes, and a string that two
   rows name occurs more than once.

Null texts count as empty; texts shorter than ``length`` lose nothing, and an
empty table gives an empty result.  Very long texts are rows like others: a
task holds one text and its hashes (about 20 bytes a byte) at a time.  Repeated
rows are copies of each other like any rows.  Ties can't occur, as every copy of
a repeated string goes.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb
from .shared import small_batches, written

LENGTH = 400
#: Suffixes sampled for each bucket.
SAMPLED = 32
#: Bytes of text, members of a row and strings handled at a time.
BLOCK, MEMBERS, STRINGS = 2 << 20, 4096, 1 << 20
#: Suffixes that a bucket's quicksort leaves to a plain sort of their bytes.
FEW = 48

_MEMBER = np.dtype([("dk", "<i8"), ("start", "<i4"), ("n", "<u2"), ("at", "<u2")])
_KEPT = np.dtype([("start", "<i4"), ("n", "<u2"), ("at", "<u2")])


def stretches(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first start, number of starts, anchor and hash of the anchor's window of each stretch of strings with an anchor in common."""
    window = length // 2
    none = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return none, none, none, none, none
    hashes = tb.Rolling(data).windows(window)
    anchor = tb.sliding_min_argmin(hashes, length - window + 1)
    ends = np.repeat(offsets[1:], np.diff(offsets))[: len(anchor)]
    inside = np.arange(len(anchor)) + length <= ends
    new = inside.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1] | (ends[1:] != ends[:-1])
    first = np.flatnonzero(new)
    counts = np.diff(np.append(np.cumsum(inside)[first] - 1, inside.sum()))
    at = anchor[first]
    return np.searchsorted(offsets, first, side="right") - 1, first, counts, at, hashes[at].view(np.int64)


def _gathered(key: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Different keys in order, and the members of each."""
    order = np.argsort(key, kind="stable")
    key, members = key[order], members[order]
    cut = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
    raw, size = members.tobytes(), members.dtype.itemsize
    stops = np.append(cut[1:], len(key))[: len(cut)] * size
    return key[cut], [raw[a:b] for a, b in zip((cut * size).tolist(), stops.tolist(), strict=True)]


def _flat(column: pa.Array | pa.ChunkedArray, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All records of a column of packed records, and the row of each."""
    data, offsets = tb.text_bytes(column)
    return np.frombuffer(data.tobytes(), dtype=kind), np.repeat(np.arange(len(offsets) - 1), np.diff(offsets) // kind.itemsize)


def _places(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), then those of starts[1] and so on."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def _by_document(members: np.ndarray) -> pa.RecordBatch:
    kept = np.zeros(len(members), dtype=_KEPT)
    for name in _KEPT.names:
        kept[name] = members[name]
    dk, packed = _gathered(members["dk"].copy(), kept)
    return pa.RecordBatch.from_arrays([pa.array(dk), pa.array(packed, pa.binary())], names=["dk", "kept"])


# ---------------------------------------------------------------- suffixes whose leading window repeats
def candidate_stretches(docs: DataFrame, length: int) -> DataFrame:
    """Document key and packed stretches whose anchor's window also starts elsewhere."""
    spark = docs.sparkSession

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, members = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=_MEMBER)]
        for batch in tb.blocks(batches, most=BLOCK):
            data, offsets = tb.text_bytes(batch.column(1))
            row, first, counts, at, key = stretches(data, offsets, length)
            own = np.zeros(len(row), dtype=_MEMBER)
            own["dk"], own["start"], own["n"], own["at"] = batch.column(0).to_numpy()[row], first - offsets[row], counts, at - first
            keys.append(key)
            members.append(own)
        key, packed = _gathered(np.concatenate(keys), np.concatenate(members))
        most = MEMBERS * _MEMBER.itemsize
        for i in range(0, len(key), 50_000):
            # a row of several members never leaves one behind for another row
            rows = [(k, p[a : a + most] if a + 2 * most <= len(p) else p[a:]) for k, p in zip(key[i : i + 50_000].tolist(), packed[i : i + 50_000], strict=True) for a in range(0, max(1, len(p) // most) * most, most)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([p for _, p in rows], pa.binary())], names=["key", "members"])

    def seen_twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _by_document(_flat(batch.column(0), _MEMBER)[0])

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, held = None, None  # the last key, and its member as long as no other row has that key
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            members, row = _flat(batch.column(1), _MEMBER)
            same = np.append(False, key[1:] == key[:-1])
            same[0] = key[0] == last_key
            twice = same.copy()
            twice[:-1] |= same[1:]
            found = [members[twice[row]]]
            if same[0] and held is not None:
                found.append(held)
            last_key = int(key[-1])
            held = None if twice[-1] or not len(row) or row[-1] != len(key) - 1 else members[-1:]
            yield _by_document(np.concatenate(found))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    anchors = written(docs.select("dk", "text").mapInArrow(cut, "key long, members binary"))
    many = F.length("members") > _MEMBER.itemsize
    here = anchors.where(many).select("members").mapInArrow(seen_twice, "dk long, kept binary")
    apart = anchors.select("key", F.when(~many, F.col("members")).alias("members")).repartition(parts, "key").sortWithinPartitions("key")
    return here.unionByName(apart.mapInArrow(neighbours, "dk long, kept binary"))


def splitters(docs: DataFrame, kept: DataFrame, length: int, buckets: int) -> tuple[list[bytes], frozenset[bytes]]:
    """At most ``buckets - 1`` leading windows that part the suffixes evenly, and those that are splitters more than once."""
    window = length // 2

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.blocks(batches, most=BLOCK):
            data, offsets = tb.text_bytes(batch.column(0))
            flat, row = _flat(batch.column(1), _KEPT)
            raw, at = data.tobytes(), offsets[row] + flat["start"] + flat["at"]
            yield pa.RecordBatch.from_arrays([pa.array([raw[a : a + window] for a in at.tolist()], pa.binary())], names=["lead"])

    n = kept.agg(F.coalesce(F.sum(F.length("kept")), F.lit(0))).first()[0] // _KEPT.itemsize
    if not n or buckets < 2:
        return [], frozenset()
    share = min(1.0, SAMPLED * buckets / n)
    # about SAMPLED stretches a bucket, so they may be broadcast
    sample = kept.where(F.pmod(F.xxhash64("dk", "kept"), F.lit(1_000_000)) < max(1, int(1_000_000 * share)))
    found = docs.join(F.broadcast(sample), "dk").select("text", "kept").mapInArrow(leads, "lead binary").toArrow()
    ordered = sorted(found.column("lead").to_pylist())
    cuts = [ordered[i * len(ordered) // buckets] for i in range(1, buckets)] if len(ordered) >= buckets else ordered
    times = Counter(cuts)
    return sorted(times), frozenset(x for x, k in times.items() if k > 1 and len(ordered) >= buckets)


# ---------------------------------------------------------------- sorting and comparing in a bucket
def _word(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The next ``size`` (8 at most) bytes from each place, as numbers in the order of the bytes."""
    out = np.zeros(len(at), dtype=np.uint64)
    for j in range(size):
        out |= data[at + j].astype(np.uint64) << np.uint64(56 - 8 * j)
    return out


def multikey_quicksort(data: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """The order of data[start : start + width], by three-way partitions on eight bytes at a time."""
    order, raw = np.arange(len(starts)), data.tobytes()
    stack = [(0, len(starts), 0)]
    while stack:
        low, high, depth = stack.pop()
        if high - low < 2 or depth >= width:
            continue
        part = order[low:high]
        if high - low <= FEW:
            rest = [raw[s + depth : s + width] for s in starts[part].tolist()]
            order[low:high] = part[sorted(range(len(rest)), key=rest.__getitem__)]
            continue
        word = _word(data, starts[part] + depth, min(8, width - depth))
        pivot = np.partition(word[[0, len(word) // 2, -1]], 1)[1]
        less, more = word < pivot, word > pivot
        a, b = low + int(less.sum()), high - int(more.sum())
        order[low:high] = np.concatenate([part[less], part[~less & ~more], part[more]])
        stack += [(low, a, depth), (a, b, depth + 8), (b, high, depth)]
    return order


def same_bytes(data: np.ndarray, left: np.ndarray, right: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether data[left : left + size] and data[right : right + size] are equal, pair by pair."""
    out = np.ones(len(left), dtype=bool)
    ends, i = np.cumsum(sizes), 0
    while i < len(left):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + STRINGS, side="right")))
        size = sizes[i:j]
        equal = data[_places(left[i:j], size)] == data[_places(right[i:j], size)]
        out[i:j] = np.logical_and.reduceat(equal, np.cumsum(size) - size)
        i = j
    return out


def intervals(data: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and the number of the interval of equal leading windows that each is in; those alone are left out."""
    order = multikey_quicksort(data, starts, width)
    if len(order) < 2:
        return order[:0], order[:0]
    near = same_bytes(data, starts[order[:-1]], starts[order[1:]], np.full(len(order) - 1, width))
    group = np.cumsum(np.append(True, ~near))
    shared = np.append(near, False) | np.append(False, near)
    return order[shared], group[shared]


def repeated_strings(data: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Which of the strings data[start : start + length] are there twice."""
    _, first, at, times = np.unique(tb.Rolling(data).span(start, start + length), return_index=True, return_inverse=True, return_counts=True)
    model = first[at]
    # strings side by side whose models are side by side are one run
    on = np.append(False, (start[1:] == start[:-1] + 1) & (start[model[1:]] == start[model[:-1]] + 1) & (model[1:] != np.arange(1, len(start))) & (model[:-1] != np.arange(len(start) - 1)))
    other = model != np.arange(len(start))
    begin = np.flatnonzero(other & ~on)
    sizes = np.add.reduceat(other.astype(np.int64), begin) - 1 + length if len(begin) else begin
    if not same_bytes(data, start[begin], start[model[begin]], sizes).all():  # hashes that collide: by the bytes themselves
        raw = data.tobytes()
        strings = [raw[s : s + length] for s in start.tolist()]
        counted = Counter(strings)
        return np.array([counted[x] > 1 for x in strings], dtype=bool)
    return times[at] > 1


def _runs(row: np.ndarray, place: np.ndarray, marked: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and stop of the bytes that marked strings at neighbouring places cover."""
    row, place = row[marked], place[marked]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(row))[: len(begin)] - 1
    return row[begin], place[begin], place[last] + length


def repeated(docs: DataFrame, kept: DataFrame, length: int, cuts: list[bytes], hot: frozenset[bytes]) -> DataFrame:
    """Document key and packed (start, stop) of byte ranges whose strings occur more than once."""
    spark, window = docs.sparkSession, length // 2
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(cuts) + 1)
    schema = "bucket int, dk long, start int, n int, at int, twice boolean, body binary, h1 long, h2 long, ranges binary"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]

    def batch_of(size: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(size, k) for c, k in zip(names, kinds, strict=True)], names=names)

    def marks(dk: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        ranges = np.stack([start, stop], axis=1).astype("<i4")
        return _gathered(dk, ranges.view("<i8").reshape(-1))

    def marked(dk: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
        dk, packed = marks(dk, start, stop)
        return batch_of(len(dk), bucket=(dk % parts).astype(np.int32), dk=dk, ranges=packed)

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple[int, int, int] | None] = {}  # digests of the stretches met, with the first of each as long as it is the only one
        strings: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            """One row for each different string; all its copies here are marked if it is here twice."""
            h1, h2, dk, start, twice = (np.concatenate(x) for x in zip(*strings, strict=True))
            strings.clear()
            order = np.lexsort((h2, h1))
            h1, h2, dk, start, twice = h1[order], h2[order], dk[order], start[order], twice[order]
            new = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))
            group = np.cumsum(new) - 1
            many = (np.bincount(group) > 1) | (np.bincount(group, weights=twice) > 0)
            gone = many[group]
            if gone.any():
                yield marked(dk[gone], start[gone], start[gone] + length)
            one = np.flatnonzero(new)
            yield batch_of(len(one), bucket=((h1[one] >> 1) % parts).astype(np.int32), dk=dk[one], start=start[one], twice=many, h1=h1[one], h2=h2[one])

        for batch in tb.blocks(batches, most=BLOCK):
            data, offsets = tb.text_bytes(batch.column(2))
            lists = batch.column(3)
            flat, of_list = _flat(lists.flatten(), _KEPT)
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))[of_list]
            if not len(row):
                continue
            dk, n, at = batch.column(0).to_numpy()[row], flat["n"].astype(np.int64), flat["at"].astype(np.int64)
            start = flat["start"].astype(np.int64)
            first, raw = offsets[row] + start, data.tobytes()
            gone: list[tuple[int, int, int]] = []
            rows: list[tuple] = []
            single: list[int] = []
            for i, (d, s, k, a, f) in enumerate(zip(dk.tolist(), start.tolist(), n.tolist(), at.tolist(), first.tolist(), strict=True)):
                body = raw[f : f + k - 1 + length]
                digest = hashlib.blake2b(body + a.to_bytes(2, "little"), digest_size=16).digest()
                if digest in seen:
                    gone.append((d, s, s + k - 1 + length))
                    if (before := seen[digest]) is not None:
                        gone.append(before)
                        seen[digest] = None
                    continue
                seen[digest] = d, s, s + k - 1 + length
                lead = body[a : a + window]
                if lead in hot:
                    single.append(i)
                else:
                    rows.append((bisect_right(cuts, lead), d, s, k, a, body))
            for i in range(0, len(rows), 5000):
                bucket, d, s, k, a, body = zip(*rows[i : i + 5000], strict=True)
                yield batch_of(len(bucket), bucket=bucket, dk=d, start=s, n=k, at=a, body=body)
            if gone:
                yield marked(*np.array(gone, dtype=np.int64).T)
            if single:
                one = np.array(single)
                place, of = _places(first[one], n[one]), np.repeat(one, n[one])
                hashes = [tb.Rolling(data, seed).span(place, place + length).view(np.int64) for seed in (0, 1)]
                strings.append((*hashes, dk[of], place - offsets[row[of]], np.zeros(len(of), dtype=bool)))
                if sum(len(x[0]) for x in strings) >= STRINGS:
                    yield from flush()
        if strings:
            yield from flush()
        tb.release()

    def pieces(of_group: np.ndarray, n: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """First and last row of whole intervals, and the offsets from the anchor back, that make about STRINGS strings."""
        cut = np.append(np.flatnonzero(np.append(True, of_group[1:] != of_group[:-1])), len(n)) if len(n) else np.zeros(1, dtype=np.int64)
        total = np.concatenate([[0], np.cumsum(n)])
        i = 0
        while i < len(cut) - 1:
            j = max(i + 1, int(np.searchsorted(total[cut], total[cut[i]] + STRINGS, side="right")) - 1)
            a, b = int(cut[i]), int(cut[j])
            step = max(1, STRINGS // (b - a)) if total[b] - total[a] > STRINGS else length
            for low in range(0, int(at[a:b].max()) + 1, step):
                yield a, b, low, low + step
            i = j

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, digests = [], []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            done = table.filter(pc.is_valid(table.column("ranges")))
            if done.num_rows:
                yield pa.RecordBatch.from_arrays([done.column("dk").combine_chunks(), done.column("ranges").combine_chunks()], names=["dk", "ranges"])
            held.append(table.filter(pc.is_valid(table.column("body"))).select(["dk", "start", "n", "at", "body"]))
            named = table.filter(pc.is_valid(table.column("h1")))
            digests.append(tuple(named.column(c).to_numpy() for c in ("h1", "h2", "dk", "start", "twice")))
        if not held:
            return
        # strings of intervals that bucket borders cut
        h1, h2, dk, start, twice = (np.concatenate(x) for x in zip(*digests, strict=True))
        order = np.lexsort((h2, h1))
        same = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
        more = order[(np.append(same, False) | np.append(False, same)) & ~twice[order].astype(bool)] if len(order) else order
        if len(more):
            found, packed = marks(dk[more], start[more].astype(np.int64), start[more].astype(np.int64) + length)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(packed, pa.binary())], names=["dk", "ranges"])
        # suffixes of this bucket
        table = pa.concat_tables(held).combine_chunks()
        held.clear()
        if table.num_rows:
            data, offsets = tb.text_bytes(table.column("body"))
            at, n, dk, start = (table.column(c).to_numpy().astype(np.int64) for c in ("at", "n", "dk", "start"))
            order, group = intervals(data, offsets[:-1] + at, window)
            for a, b, low, high in pieces(group, n[order], at[order]):
                rows = order[a:b]
                # the strings whose anchor lies low to high - 1 bytes in
                begin, end = np.maximum(0, at[rows] - high + 1), np.minimum(n[rows], at[rows] - low + 1)
                counts = np.maximum(0, end - begin)
                own, place = np.repeat(rows, counts), _places(begin, counts)
                sizes = offsets[rows + 1] - offsets[rows]
                local = np.cumsum(sizes) - sizes
                near = data[_places(offsets[rows], sizes)]
                mark = repeated_strings(near, np.repeat(local, counts) + place, length) if len(own) else np.zeros(0, dtype=bool)
                of, first, stop = _runs(own, place, mark, length)
                found, packed = marks(dk[of], start[of] + first, start[of] + stop)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(packed, pa.binary())], names=["dk", "ranges"])
        tb.release()

    lists = kept.groupBy("dk").agg(F.collect_list("kept").alias("kept"))
    # with doc_id, so that the shuffle of the texts is that of the last join
    rows = docs.join(lists, "dk").select("dk", "doc_id", "text", "kept").mapInArrow(bodies, schema)
    return rows.repartitionById(parts, "bucket").mapInArrow(compare, "dk long, ranges binary")


def cut_repeats(docs: DataFrame, length: int = LENGTH, buckets: int | None = None, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row; with ``keep_text`` also the bytes that are left.

    Suffixes are dealt to ``buckets`` buckets, by default as many as there are shuffle partitions.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.xxhash64("doc_id", text).alias("dk"), "doc_id", text.alias("text"))
    kept = written(candidate_stretches(docs, length))
    cuts, hot = splitters(docs, kept, length, buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # not written between, so that the texts are shuffled once for both joins
    ranges = repeated(docs, kept, length, cuts, hot).groupBy("dk").agg(F.collect_list("ranges").alias("ranges"))
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    names = [x.split()[0] for x in schema.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.blocks(batches):
            data, offsets = tb.text_bytes(batch.column(2))
            rows = []
            for i, packed in enumerate(batch.column(3).to_pylist()):
                own = data[offsets[i] : offsets[i + 1]]
                gone = np.zeros(len(own) + 1, dtype=np.int64)
                if packed:
                    pairs = np.frombuffer(b"".join(packed), dtype="<i4").reshape(-1, 2)
                    np.add.at(gone, pairs[:, 0], 1)
                    np.add.at(gone, pairs[:, 1], -1)
                mask = np.cumsum(gone)[:-1] > 0
                left = own[~mask].tobytes()
                rows.append((len(own), int(mask.sum()), int((mask[1:] & ~mask[:-1]).sum() + (len(mask) and mask[0])), hashlib.sha256(left).hexdigest(), left))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), *arrays[: len(names) - 1]], names=names)

    return docs.join(ranges, "dk", "left").select("dk", "doc_id", "text", "ranges").mapInArrow(cut, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
