"""Operator 11: minimal aligned groups of two tokenizers, and how often their tokens are linked.

A text is encoded by tokenizer A (byte-level BPE, of a space and the text) and
tokenizer B (sentencepiece, which adds the space).  Tokens whose byte ranges
overlap are linked.  In the bipartite graph of links, union-find gives the
connected components; these are the minimal groups of tokens that cover the same
bytes.  Links are found again wherever they are needed by expanding a component's
members, as their bytes are known from their ids.

Both tokenizers part tokens at a space between a character that isn't blank
and a letter, so a text is cut there into words, and equal words of a block of
texts are encoded and grouped once.  A task writes for each block a row a text, a
row a different pair of linked ids with its number of links there, and one row
that packs which words each text holds and which pairs each word.  Spark sums the
pairs over all blocks and joins the sums to each block's pairs; these meet the
texts of their block again in a task of that block's size, which adds them up by
word and by text.  A pair is one row a block at most, so pairs of any frequency are
spread over as many rows as there are blocks, and no table is sent to all tasks.

Null and empty texts, and texts that either tokenizer doesn't give back byte by
byte, have no tokens: zeros and an empty digest.  Very long texts are blocks of
their own; a very long word is encoded whole.  Repeated rows, and equal or null
doc_ids, give a row each and count each.  An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .shared import shared_folder, small_batches, written

VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text whose different words and pairs are put together in a task, and bytes of words that are encoded at a time.
BLOCK_BYTES, ENCODED_BYTES = 8 << 20, 1 << 18
#: Words, and bytes of a word, that a Python worker remembers.
CACHE_WORDS, CACHE_BYTES = 150_000, 64

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


class Side:
    """The bytes of a tokenizer's tokens, one after another."""

    def __init__(self, tokens: list[bytes]):
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of tokens."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.bytes[np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


def _byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level token stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Word(NamedTuple):
    """A word's groups as text, its numbers of A tokens, B tokens and groups, and the pairs of ids of its links (8 bytes each)."""

    key: str
    n_a: int
    n_b: int
    n_groups: int
    pairs: bytes


class Pair:
    """Two tokenizers."""

    def __init__(self, a: str, b: str):
        import public_tokenizers
        import sentencepiece
        from tokenizers import Tokenizer

        path = lambda name: name if "/" in name else public_tokenizers.path(name)
        self.first = Tokenizer.from_file(path(a))
        self.first.encode_special_tokens = True
        self.first.no_truncation()
        self.first.no_padding()
        self.second = sentencepiece.SentencePieceProcessor(model_file=path(b))
        of = _byte_level()
        names = [self.first.id_to_token(i) or "" for i in range(self.first.get_vocab_size(with_added_tokens=True))]
        self.a = Side([bytes(of.get(c, 63) for c in name) for name in names])
        pieces = [(i, self.second.id_to_piece(i)) for i in range(self.second.get_piece_size())]
        self.b = Side([bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces])
        self.known: dict[str, Word | None] = {}

    def encode(self, words: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of words, each of which begins with a space."""
        first = [e.ids for e in self.first.encode_batch_fast(words, add_special_tokens=False)]
        return first, self.second.encode([w[1:] for w in words], num_threads=1)

    def words(self, words: list[str]) -> list[Word | None]:
        """What is to be known of each word; None where bytes differ."""
        out = [self.known.get(w, 0) for w in words]
        new = [i for i, x in enumerate(out) if x == 0]
        at = 0
        while at < len(new):  # in bounded parts
            stop, size = at, 0
            while stop < len(new) and (size < ENCODED_BYTES or stop == at):
                size += len(words[new[stop]])
                stop += 1
            part = [words[i] for i in new[at:stop]]
            for i, w, x in zip(new[at:stop], part, self._new(part), strict=True):
                out[i] = x
                if len(self.known) < CACHE_WORDS and len(w) <= CACHE_BYTES:
                    self.known[w] = x
            at = stop
        return out

    def _whole(self, side: Side, ids: np.ndarray, n: np.ndarray, raw: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Which words are spelt by their tokens; n tokens and ``sizes`` bytes a word."""
        word = np.repeat(np.arange(len(n)), n)
        good = np.bincount(word, weights=side.sizes[ids], minlength=len(n)) == sizes
        mine = raw[np.repeat(good, sizes)]
        wrong = side.spell(ids[good[word]]) != mine
        if wrong.any():
            good[np.repeat(np.flatnonzero(good), sizes[good])[wrong]] = False
        return good

    def _new(self, words: list[str]) -> list[Word | None]:
        lists = self.encode(words)
        coded = [w.encode() for w in words]
        sizes, raw = np.array([len(x) for x in coded], dtype=np.int64), np.frombuffer(b"".join(coded), dtype=np.uint8)
        n = [np.array([len(x) for x in side], dtype=np.int64) for side in lists]
        ids = [np.fromiter((t for x in side for t in x), dtype=np.int64, count=int(k.sum())) for side, k in zip(lists, n, strict=True)]
        good = self._whole(self.a, ids[0], n[0], raw, sizes) & self._whole(self.b, ids[1], n[1], raw, sizes)
        out: list[Word | None] = [None] * len(words)
        if not good.any():
            return out
        ids = [x[np.repeat(good, k)] for x, k in zip(ids, n, strict=True)]
        n = [k[good] for k in n]
        sizes = [side.sizes[x] for side, x in zip((self.a, self.b), ids, strict=True)]
        groups = group(*sizes)
        text, ends = group_text(ids, groups)
        # a word's groups end with its last A token
        last = groups[0][np.cumsum(n[0]) - 1]
        n_groups = np.diff(np.concatenate([[-1], last])).tolist()
        stop = ends[last]
        key = [text[i:j] for i, j in zip([0, *(stop[:-1] + 1).tolist()], stop.tolist(), strict=True)]
        # a component's members give its links
        a, b = overlaps(*sizes)
        pairs = (ids[0][a] << 32 | ids[1][b]).tobytes()
        edge = [0, *(8 * np.cumsum(np.bincount(np.repeat(np.arange(len(n[0])), n[0])[a], minlength=len(n[0])))).tolist()]
        for k, i in enumerate(np.flatnonzero(good).tolist()):
            out[i] = Word(key[k], int(n[0][k]), int(n[1][k]), n_groups[k], pairs[edge[k] : edge[k + 1]])
        return out


def union_find(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest node of the component of each of n nodes: roots of linked nodes are hooked to the smaller, then paths are halved."""
    parent = np.arange(n)
    while len(left):
        low, high = np.minimum(parent[left], parent[right]), np.maximum(parent[left], parent[right])
        open_ = low != high
        left, right, low, high = left[open_], right[open_], low[open_], high[open_]
        np.minimum.at(parent, high, low)
        while True:
            above = parent[parent]
            if np.array_equal(above, parent):
                break
            parent = above
    return parent


def overlaps(sizes_a: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A and B token of each link of two tilings of the same bytes: a link begins where either of its tokens begins."""
    start_a, start_b = np.cumsum(sizes_a) - sizes_a, np.cumsum(sizes_b) - sizes_b
    at = np.union1d(start_a, start_b)
    return np.searchsorted(start_a, at, side="right") - 1, np.searchsorted(start_b, at, side="right") - 1


def group(sizes_a: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each A and of each B token, from 0 in order: the components of the graph of links."""
    a, b = overlaps(sizes_a, sizes_b)
    n = len(sizes_a)
    root = union_find(n + len(sizes_b), a, n + b)
    # every component has an A token, its smallest node
    number = np.cumsum(root[:n] == np.arange(n)) - 1
    return number[root[:n]], number[root[n:]]


def group_text(ids: list[np.ndarray], groups: tuple[np.ndarray, np.ndarray]) -> tuple[str, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3;``, and where each group's semicolon is."""
    many = int(groups[0][-1]) + 1
    size_a, size_b = (np.bincount(g, minlength=many) for g in groups)
    order = np.empty(len(ids[0]) + len(ids[1]), dtype=np.int64)
    end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
    place_a = np.arange(len(ids[0])) + (end_b - size_b)[groups[0]]
    place_b = np.arange(len(ids[1])) + end_a[groups[1]]
    order[place_a], order[place_b] = ids[0], ids[1]
    mark = np.full(len(order), ord(","), dtype=np.uint8)
    mark[place_a[end_a - 1]], mark[place_b[end_b - 1]] = ord("|"), ord(";")
    width = len(str(int(order.max())))
    columns = np.stack([order // 10 ** (width - 1 - i) % 10 for i in range(width)], axis=1).astype(np.uint8) + 48
    # without leading zeros
    shown = np.stack([order >= 10 ** (width - 1 - i) for i in range(width - 1)] + [np.ones(len(order), bool)], axis=1)
    cells, shown = np.column_stack([columns, mark]), np.column_stack([shown, np.ones(len(order), bool)])
    ends = np.cumsum(shown.sum(axis=1)) - 1
    return cells[shown].tobytes().decode(), ends[place_b[end_b - 1]]


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where words begin: at every text, and at spaces between a character that isn't blank and a letter."""
    if not len(data):
        return np.zeros(0, dtype=np.int64)
    begins = np.zeros(len(data), dtype=bool)
    letter = np.zeros(len(data) + 2, dtype=bool)
    letter[: len(data)] = _LETTER[data]
    accented = np.flatnonzero(data[:-1] == 0xC3)
    letter[accented] = ~np.isin(data[accented + 1], (0x97, 0xB7))
    begins[1:] = (data[1:] == 32) & ~_BLANK[data[:-1]] & letter[2 : len(data) + 1]
    begins[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(begins)


_pairs: dict[tuple[str, str], Pair] = {}


def pair_of(a: str, b: str) -> Pair:
    """The tokenizers, once in each worker."""
    if (a, b) not in _pairs:
        _pairs[a, b] = Pair(a, b)
    return _pairs[a, b]


_DOC = ["n_a", "n_b", "n_groups", "n_links"]


def _packed(*parts: np.ndarray) -> bytes:
    """Whole numbers below 2^31, compressed."""
    sizes = np.array([len(p) for p in parts], dtype=np.int32)
    raw = np.concatenate([sizes, *[p.astype(np.int32) for p in parts]])
    # byte by byte, so that the high ones, which are mostly 0, lie together
    planes = np.ascontiguousarray(raw.view(np.uint8).reshape(-1, 4).T)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(planes.tobytes(), asbytes=True)


def _unpacked(blob: bytes, parts: int) -> list[np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(pa.Codec("zstd").decompress(blob[8:], decompressed_size=4 * n, asbytes=True), dtype=np.uint8)
    raw = np.ascontiguousarray(raw.reshape(4, n).T).view(np.int32).reshape(-1)
    return np.split(raw[parts:], np.cumsum(raw[:parts])[:-1])


def _block(batch: pa.RecordBatch, number: int, pair: Pair) -> Iterator[pa.RecordBatch]:
    """A row for each text, one for what the texts and words of the block hold, and one for each different pair."""
    column = batch.column(1)
    column = column.fill_null("") if column.null_count else column
    filled = pc.greater(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    data, offsets = tb.text_bytes(pc.if_else(pa.array(filled), pc.binary_join_element_wise(" ", column, ""), ""))
    start = cuts(data, offsets)
    ends = np.append(start, len(data)).astype(np.int64)
    row = np.searchsorted(offsets, start, side="right") - 1
    words = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    code, n = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), batch.num_rows
    found = pair.words(words.dictionary.to_pylist())
    good = filled.copy()
    good[row[np.array([x is None for x in found], dtype=bool)[code]]] = False
    counts = np.array([x[1:4] if x else (0, 0, 0) for x in found], dtype=np.int64).reshape(len(found), 3)
    sums = [np.where(good, np.bincount(row, weights=counts[code, i], minlength=n), 0).astype(np.int64) for i in range(3)]
    keys = [x[0] if x else "" for x in found]
    edge, code_list = np.searchsorted(row, np.arange(n + 1)).tolist(), code.tolist()
    digest = [hashlib.sha256(";".join([keys[c] for c in code_list[edge[i] : edge[i + 1]]]).encode()).hexdigest() if good[i] else "" for i in range(n)]

    # the different words of each text, as steps from one to the next
    many = max(1, len(found))
    kept = good[row]
    at, times = np.unique(row[kept] * many + code[kept], return_counts=True)
    text, word = at // many, at % many
    steps = np.where(np.append(True, text[1:] != text[:-1]), word, np.diff(word, prepend=0)) if len(at) else word
    uses = np.bincount(word, weights=times, minlength=many)[: len(found)].astype(np.int64)
    # and the different pairs of each word that any text holds
    held = [x.pairs if x and u else b"" for x, u in zip(found, uses.tolist(), strict=True)]
    n_pairs = np.array([len(x) // 8 for x in held], dtype=np.int64)
    own, place = np.unique(np.frombuffer(b"".join(held), dtype=np.int64), return_inverse=True)
    place = place.reshape(-1)
    total = np.zeros(len(own), dtype=np.int64)
    np.add.at(total, place, np.repeat(uses, n_pairs))
    blob = _packed(np.bincount(text, minlength=n), steps, times, n_pairs, place)

    def rows(size: int, **columns: pa.Array) -> pa.RecordBatch:
        kinds = {"block": pa.int64(), "at": pa.int32(), "doc_id": batch.schema.field(0).type, **dict.fromkeys(_DOC, pa.int64()), "groups_sha256": pa.string(), "blob": pa.binary(), "a": pa.int32(), "b": pa.int32(), "n": pa.int64()}
        columns["block"] = pa.array(np.full(size, number))
        return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(size, t)) for c, t in kinds.items()], names=list(kinds))

    numbers = dict(zip(_DOC, map(pa.array, [*sums, sums[0] + sums[1] - sums[2]]), strict=True))
    yield rows(n, at=pa.array(np.arange(n, dtype=np.int32)), doc_id=batch.column(0), groups_sha256=pa.array(digest, pa.string()), **numbers)
    yield rows(1, blob=pa.array([blob], pa.binary()))
    for i in range(0, len(own), 20_000):
        part = own[i : i + 20_000]
        yield rows(len(part), at=pa.array(np.arange(i, i + len(part), dtype=np.int32)), a=pa.array((part >> 32).astype(np.int32)), b=pa.array((part & 0xFFFFFFFF).astype(np.int32)), n=pa.array(total[i : i + 20_000]))


def aligned(docs: DataFrame, a: str = VOCABULARY_A, b: str = VOCABULARY_B) -> DataFrame:
    """Blocks of texts: rows with doc_id and what a text has by itself (at: its place), one row with a blob, and rows with a pair."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, number = pair_of(a, b), TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in tb.blocks(batches):
            held.append(batch)
            size += batch.nbytes
            if size >= BLOCK_BYTES:
                yield from _block(pa.concat_batches(held), number, pair)
                held, size, number = [], 0, number + 1
                tb.release()
        if held:
            yield from _block(pa.concat_batches(held), number, pair)

    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", docs["text"].cast("string").alias("text"))
    counts = ", ".join(f"{c} long" for c in _DOC)
    return rows.mapInArrow(align, f"block long, at int, doc_id {dict(docs.dtypes)['doc_id']}, {counts}, groups_sha256 string, blob binary, a int, b int, n long")


_SUMS = ["n_best", "count_sum"]


def _valued(rows: pa.Table, values: pa.Table) -> pa.Table:
    """The texts of a block, with the sums over their links of what their block's pairs are worth."""
    texts = rows.filter(pc.is_valid(rows["at"]))
    per_text, steps, times, n_pairs, place = _unpacked(rows.filter(pc.is_valid(rows["blob"]))["blob"][0].as_py(), 5)
    worth = np.zeros((2, values.num_rows), dtype=np.int64)
    for i, c in enumerate(("best", "count")):
        worth[i, values["at"].to_numpy()] = values[c].to_numpy()
    of_text = np.repeat(np.arange(len(per_text)), per_text)
    # steps add up within a text
    upto = np.cumsum(steps.astype(np.int64))
    first = np.cumsum(per_text) - per_text
    before = np.concatenate([[0], upto])[first]
    word = upto - before[of_text]
    pair_end = np.concatenate([[0], np.cumsum(n_pairs)])
    found = {}
    for i, c in enumerate(_SUMS):
        total = np.concatenate([[0], np.cumsum(worth[i][place])])
        by_word = total[pair_end[1:]] - total[pair_end[:-1]]
        total = np.concatenate([[0], np.cumsum(by_word[word] * times)])
        found[c] = total[first + per_text] - total[first]
    at = texts["at"].to_numpy()
    columns = [texts["doc_id"], *[texts[c] for c in _DOC], *[pa.array(found[c][at]) for c in _SUMS], texts["groups_sha256"]]
    return pa.Table.from_arrays(columns, names=["doc_id", *_DOC, *_SUMS, "groups_sha256"])


def alignment(docs: DataFrame, a: str = VOCABULARY_A, b: str = VOCABULARY_B) -> tuple[DataFrame, DataFrame]:
    """A row a document, and a row a pair of linked ids: a, b, count and whether no other A id has more links with b."""
    folder = shared_folder(docs.sparkSession)
    blocks = written(aligned(docs, a, b), folder)
    there = docs.sparkSession.read.schema(blocks.schema).parquet(folder).where("a IS NOT NULL").select("block", "at", "a", "b", "n")
    pairs = there.groupBy("a", "b").agg(F.sum("n").alias("count"))
    # a B id has as many pairs as A has ids, at most
    pairs = written(pairs.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b"))))
    values = there.drop("n").join(pairs, ["a", "b"]).select("block", "at", "count", F.col("best").cast("long").alias("best"))
    texts = blocks.where("a IS NULL").drop("a", "b", "n")
    sums = ", ".join(f"{c} long" for c in [*_DOC, *_SUMS])
    out = texts.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(_valued, f"doc_id {dict(docs.dtypes)['doc_id']}, {sums}, groups_sha256 string")
    return out, pairs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0]
