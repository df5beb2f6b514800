"""Operator 6: BPE encoding and decoding by tree concatenation.

Texts up to ``segment_chars`` characters are encoded whole.  A longer text is
cut into segments that are encoded in parallel, as rows of their own; a text's
segments are then joined pairwise, as in a tree.  At each join a window around
the cut is encoded afresh and grown until it agrees with the tokens of both
sides; its tokens replace those around the cut.  Two encodings that share a
token (same place, same id) may be spliced there: a sequence is the BPE
encoding exactly if every pair of neighbours is, and each pair comes from one
of the encodings.

Null texts count as empty; empty texts give no tokens.  Repeated rows and
repeated or null ``doc_id`` give a row each.  An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_batches
from .textbytes import blocks

VOCABULARY = "word_bpe_49k.json"
SEGMENT_CHARS = 32_768
#: Words that a Python worker keeps the tokens of.
CACHE_WORDS = 300_000
#: Neighbouring tokens that must agree before a window is spliced in.
AGREE = 3
#: Marks that often end a word; each is one token.
ENDS = (".", ",", "|", ";", ":", "!", "?")

OUT = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the public tokenizer file is, on whichever machine this runs."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Codec:
    """A tokenizer with the tokens of the words it has met."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path(vocabulary) if "/" not in vocabulary else vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        #: All tokens with a space after each, one after another, and where they begin and how long they are.
        self.names = np.frombuffer("".join(f"{x} " for x in names).encode(), dtype=np.uint8)
        self.name_sizes = np.array([len(x.encode()) + 1 for x in names], dtype=np.int32)
        self.name_starts = (np.cumsum(self.name_sizes) - self.name_sizes).astype(np.int32)
        #: Whether a token ends a word, and the characters that it stands for if they are ASCII.
        self.ends = np.array([x.endswith("</w>") for x in names])
        self.sizes = np.array([len(x.removesuffix("</w>")) for x in names])
        self.ids: dict[str, bytes] = {}

    def encode_letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters: each gives tokens of which only the last ends a word, so many are encoded in one text."""
        out: list[bytes] = []
        for i in range(0, len(words), 4096):
            part = words[i : i + 4096]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, dtype="<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(part):
                raw, at = ids.tobytes(), 0
                for stop in (4 * stops).tolist():
                    out.append(raw[at:stop])
                    at = stop
            else:  # lower case has turned some letter into more than letters
                out += self.encode_others(part)
        return out

    def encode_others(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]

    def learn(self, words: set[str]) -> None:
        """Encode words that aren't known yet.

        Case is folded and punctuation parted from letters by the tokenizer itself, so a word of letters with one
        mark after it is put together from the two.
        """
        known = self.ids
        new = list(words.difference(known))
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
            new = list(words)
        made = [(w, w[:-1].lower() if w[-1] in ENDS else w.lower()) for w in new if w.isascii() and (w[:-1] if w[-1:] in ENDS else w).isalpha()]
        of_letters = {core for _, core in made if core not in known}
        put_together = {w for w, _ in made}
        others = {w for w in new if w not in put_together}
        letters = [w for w in others if w.isalpha()]
        others = [w for w in others if not w.isalpha()] + [e for e in ENDS if e not in known]
        letters += of_letters
        known.update(zip(letters, self.encode_letters(letters), strict=True))
        known.update(zip(others, self.encode_others(others), strict=True))
        for w, core in made:
            known[w] = known[core] if len(w) == len(core) else known[core] + known[w[-1]]

    def encode_texts(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids (little-endian, 4 bytes each) and decoded text of each text.

        Spaces and newlines always part tokens and are dropped, so words between them are encoded once.
        """
        split = [x.replace("\n", " ").split(" ") for x in texts]
        self.learn(set().union(*split))
        coded = [b"".join(map(self.ids.__getitem__, x)) for x in split]
        ids = np.frombuffer(b"".join(coded), dtype="<u4")
        decoded = self.spaced(ids)
        after = np.concatenate([[0], np.cumsum(self.name_sizes[ids], dtype=np.int64)])
        at = after[np.cumsum([0, *[len(x) // 4 for x in coded]])].tolist()
        # each text but for its last space
        return [(x, decoded[i : max(i, j - 1)]) for x, i, j in zip(coded, at, at[1:], strict=False)]

    def tokens_by_word(self, text: str) -> np.ndarray:
        """The same as tokens(), from the tokens of the text's words."""
        split = text.replace("\n", " ").split(" ")
        self.learn(set(split))
        ids = np.frombuffer(b"".join([self.ids[w] for w in split]), dtype="<u4").astype(np.int64)
        lengths = np.array([len(w) + 1 for w in split])
        counts = np.array([len(self.ids[w]) // 4 for w in split])
        starts, firsts = np.cumsum(lengths) - lengths, np.cumsum(counts) - counts
        before = np.concatenate([[0], np.cumsum(self.sizes[ids])])
        begin = before[:-1] + np.repeat(starts - before[firsts], counts)
        rows = np.column_stack([ids, begin, begin + self.sizes[ids]])
        other = [i for i, w in enumerate(split) if not w.isascii()]
        for i, e in zip(other, self.tokenizer.encode_batch([split[i] for i in other], add_special_tokens=False), strict=True):
            if counts[i]:
                rows[firsts[i] : firsts[i] + counts[i], 1:] = np.array(e.offsets) + starts[i]
        return rows

    def spaced(self, ids: np.ndarray) -> bytes:
        """The tokens' characters with a space after each token, gathered in slices of bounded memory."""
        out = []
        for i in range(0, len(ids), 1 << 18):
            part = ids[i : i + (1 << 18)]
            sizes = self.name_sizes[part]
            stops = np.cumsum(sizes, dtype=np.int32)
            out.append(self.names[np.repeat(self.name_starts[part] - (stops - sizes), sizes) + np.arange(stops[-1], dtype=np.int32)].tobytes())
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.spaced(ids)[:-1]

    def tokens(self, text: str) -> np.ndarray:
        """Rows of id, first character and end of each token."""
        e = self.tokenizer.encode(text, add_special_tokens=False)
        if not e.ids:
            return np.zeros((0, 3), dtype=np.int64)
        return np.column_stack([np.array(e.ids, dtype=np.int64), np.array(e.offsets, dtype=np.int64)])


_codecs: dict[str, Codec] = {}


def codec(vocabulary: str) -> Codec:
    if vocabulary not in _codecs:
        _codecs[vocabulary] = Codec(vocabulary)
    return _codecs[vocabulary]


def _agreement(side: np.ndarray, window: np.ndarray, least: int, last: bool) -> tuple[int, int] | None:
    """Places in side and window where ``least`` tokens in a row are equal: the first such run in the window, or the last."""
    known = {tuple(t): i for i, t in enumerate(side.tolist())}
    rows = [known.get(tuple(t), -9) for t in window.tolist()]
    found = None
    for i in range(len(rows) - least + 1):
        if rows[i] >= 0 and all(rows[i + k] == rows[i] + k for k in range(1, least)):
            found = rows[i], i
            if not last:
                break
    return found


def join(code: Codec, text: str, cut: int, left: np.ndarray, right: np.ndarray, window: int = 64) -> np.ndarray:
    """Tokens of ``text`` from those of text[:cut] and text[cut:], both with places in ``text``."""
    while True:
        a, b = max(0, cut - window), min(len(text), cut + window)
        if a == 0 and b == len(text):
            return code.tokens(text)
        near = code.tokens(text[a:b])
        near[:, 1:] += a
        from_a, to_b = int(np.searchsorted(left[:, 1], a)), int(np.searchsorted(right[:, 1], b))  # only tokens in the window are compared
        low = (0, 0) if a == 0 else _agreement(left[from_a:], near, AGREE, last=False)
        high = (0, 0) if b == len(text) else _agreement(right[:to_b], near, AGREE, last=True)
        if low is not None and high is not None:
            head, first = (left[:0], 0) if a == 0 else (left[: from_a + low[0] + 1], low[1] + 1)
            tail, last = (right[:0], len(near)) if b == len(text) else (right[high[0] + AGREE :], high[1] + AGREE)
            if first <= last:
                return np.concatenate([head, near[first:last], tail])
        window *= 2


def join_all(code: Codec, texts: list[str], parts: list[np.ndarray]) -> np.ndarray:
    """Tokens of the concatenated texts from the tokens of each, joined pairwise until one is left."""
    while len(parts) > 1:
        next_texts, next_parts = [], []
        for i in range(0, len(parts) - 1, 2):
            cut = len(texts[i])
            right = parts[i + 1].copy()
            right[:, 1:] += cut
            next_texts.append(texts[i] + texts[i + 1])
            next_parts.append(join(code, next_texts[-1], cut, parts[i], right))
        if len(parts) % 2:
            next_texts.append(texts[-1])
            next_parts.append(parts[-1])
        texts, parts = next_texts, next_parts
    return parts[0]


def _digests(ids: bytes, decoded: bytes) -> tuple[int, str, str]:
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()


def bpe(docs: DataFrame, vocabulary: str = VOCABULARY, segment_chars: int = SEGMENT_CHARS, keep_tokens: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each text; with ``keep_tokens`` also ids and decoded."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    doc_type = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {doc_type}, {OUT}" + ", ids binary, decoded string" * keep_tokens
    names = [x.split()[0] for x in schema.split(", ")]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(vocabulary)
        for batch in blocks(batches, most=2 << 20):
            coded = code.encode_texts(batch.column(1).to_pylist())
            n, ids, decoded = map(list, zip(*[_digests(*x) for x in coded], strict=True))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            if keep_tokens:
                columns += [pa.array([x[0] for x in coded], pa.binary()), pa.array([x[1] for x in coded], pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(vocabulary)
        for batch in batches:
            tokens = [code.tokens_by_word(x).astype("<i4").tobytes() for x in batch.column("part").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tokens, pa.binary())], names=[*batch.schema.names, "tokens"])

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        code = codec(vocabulary)
        copies = int((group["part_no"] == 0).sum())
        group = group.drop_duplicates("part_no").sort_values("part_no")
        arrays = [np.frombuffer(x, dtype="<i4").reshape(-1, 3).astype(np.int64) for x in group["tokens"]]
        ids = join_all(code, list(group["part"]), arrays)[:, 0]
        decoded = code.decode(ids)
        row = (group["doc_id"].iloc[0], *_digests(raw := ids.astype("<u4").tobytes(), decoded))
        row += (raw, decoded.decode()) if keep_tokens else ()
        return pd.DataFrame([row] * copies, columns=names)

    short = rows.where(F.length("text") <= segment_chars).mapInArrow(whole, schema)
    cut = F.expr(f"transform(sequence(0, cast((length(text) - 1) div {segment_chars} as int)), i -> substring(text, i * {segment_chars} + 1, {segment_chars}))")
    long = rows.where(F.length("text") > segment_chars).select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(cut).alias("part_no", "part"))
    # few bytes of text are much work, so the segments aren't merged into fewer tasks
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    long = long.repartition(tasks, F.xxhash64("doc_id", "text_hash", "part_no"))
    long = long.mapInArrow(parts, f"doc_id {doc_type}, text_hash long, part_no int, part string, tokens binary")
    return short.unionByName(long.groupBy("doc_id", "text_hash").applyInPandas(joined, schema))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe(spark.read.parquet(f"{sf_dir}/documents.parquet"))
