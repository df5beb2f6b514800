"""Operator 9: word-piece token counts by a linear longest-match automaton.

A trie holds the vocabulary: pieces that begin a word below one root, pieces
that continue a word below another.  Each node has a failure link and the
number of pieces that following it pops, so a word's length in greedy
longest-match pieces comes from one pass over its characters, without building
the pieces.  A word with a part that no piece matches is one unknown token.

Words are maximal runs of ASCII letters, digits, underscores and characters
beyond ASCII; every other character but white space is a word of its own.
Words are told apart by a 64-bit hash, and each worker counts a word once.
Null and empty texts have no tokens.  Very long texts and words are counted
whole.  An empty table gives an empty result.  Repeated rows give a row each;
other columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import textbytes as tb
from .shared import small_batches

VOCABULARY = "piece_bpe_32k.model"
#: Different words that a Python worker remembers.
CACHE_WORDS = 2_000_000


class Automaton:
    """Longest-match lengths over pieces that begin words and pieces that continue them."""

    def __init__(self, begin: Iterable[str], go_on: Iterable[str]):
        self.next: list[dict[str, int]] = [{}, {}]  # the two roots
        whole = [False, False]
        for root, pieces in ((0, begin), (1, go_on)):
            for piece in pieces:
                at = root
                for c in piece:
                    to = self.next[at].get(c)
                    if to is None:
                        to = self.next[at][c] = len(self.next)
                        self.next.append({})
                        whole.append(False)
                    at = to
                whole[at] = at > 1
        #: Where a node goes when it has no edge for a character (-1: no piece matches), and the pieces popped on the way.
        self.link, self.popped = [-1] * len(self.next), [0] * len(self.next)
        queue = deque([0, 1])
        while queue:
            u = queue.popleft()
            for c, v in self.next[u].items():
                if whole[v]:
                    self.link[v], self.popped[v] = 1, 1
                else:
                    z, n = self.link[u], self.popped[u]
                    while z >= 0 and c not in self.next[z]:
                        n += self.popped[z]
                        z = self.link[z]
                    if z >= 0:
                        self.link[v], self.popped[v] = self.next[z][c], n
                queue.append(v)

    def length(self, word: str) -> int:
        """Pieces of a word; -1 if some part of it matches none."""
        edges, link, popped = self.next, self.link, self.popped
        u = n = 0
        if not word:
            return 0
        for c in word:
            while (to := edges[u].get(c)) is None:
                n += popped[u]
                u = link[u]
                if u < 0:
                    return -1
            u = to
        while u > 1:
            n += popped[u]
            u = link[u]
        return n if u == 1 else -1


def pieces(vocabulary: str = VOCABULARY) -> tuple[list[str], list[str]]:
    """Pieces that begin words and pieces that continue them, from a public sentencepiece model."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))
    own = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return [p[1:] for p in own if p[0] == "▁" and len(p) > 1], [p for p in own if p[0] != "▁"]


_automata: dict[str, tuple[Automaton, dict[str, np.ndarray]]] = {}


def automaton(vocabulary: str) -> tuple[Automaton, dict[str, np.ndarray]]:
    """The automaton and the words counted so far, once in each worker."""
    if vocabulary not in _automata:
        _automata[vocabulary] = Automaton(*pieces(vocabulary)), {"hash": np.zeros(0, np.uint64), "n": np.zeros(0, np.int64)}
    return _automata[vocabulary]


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


def count_block(column: pa.Array, machine: Automaton, seen: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, words and unknown words of each text."""
    data, offsets = tb.text_bytes(column)
    start, stop, row = tb.words(data, offsets)
    single = np.flatnonzero(~(tb._WORD[data] | _BLANK[data]))
    start, stop = np.concatenate([start, single]), np.concatenate([stop, single + 1])
    row = np.concatenate([row, np.searchsorted(offsets, single, side="right") - 1])
    hashes, first, which = np.unique(tb.Rolling(data).span(start, stop), return_index=True, return_inverse=True)
    at = np.searchsorted(seen["hash"], hashes)
    known = np.zeros(len(hashes), dtype=bool)
    inside = at < len(seen["hash"])
    known[inside] = seen["hash"][at[inside]] == hashes[inside]
    lengths = np.zeros(len(hashes), dtype=np.int64)
    lengths[known] = seen["n"][at[known]]
    raw = data.tobytes()
    new = np.flatnonzero(~known)
    lengths[new] = [machine.length(raw[start[i] : stop[i]].decode("utf-8", "replace")) for i in first[new].tolist()]
    if len(new):
        if len(seen["hash"]) + len(new) > CACHE_WORDS:
            seen["hash"], seen["n"] = hashes, lengths
        else:
            both, n = np.concatenate([seen["hash"], hashes[new]]), np.concatenate([seen["n"], lengths[new]])
            order = np.argsort(both, kind="stable")
            seen["hash"], seen["n"] = both[order], n[order]
    per_word, n = lengths[which.reshape(-1)], len(column)
    return tuple(np.bincount(row, weights=x, minlength=n).astype(np.int64) for x in (np.abs(per_word), np.ones(len(row)), per_word < 0))


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, n_words and n_unknown of each text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, seen = automaton(vocabulary)
        for batch in tb.blocks(batches):
            columns = [pa.array(x) for x in count_block(batch.column(1), machine, seen)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_tokens", "n_words", "n_unknown"])

    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(count, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, n_words long, n_unknown long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
