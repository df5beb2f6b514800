"""Operator 2: toxicity of texts, after a noisy-channel restoration of obfuscated words.

A character model (trigrams of letters and word ends) is counted over all
documents.  Tokens that may be obfuscated - letters mixed with digits or
symbols, letters set apart one by one, letters repeated - become lattices: a
sign can stand for the letters it looks like, a separator or a repeated letter
for nothing.  A Viterbi search finds the likeliest letters under the model and
the channel's costs; these words are scored with those that the text holds as
they are.  Two or three short words beside each other that make a word of the lexicon
are searched too, and count if the search joins them.

A lexicon of words and word beginnings is learnt from labelled rows, by the log
odds of finding them in toxic texts, and a logistic regression turns what a
text's words amount to into a probability.  Each half of the labelled rows is
measured with the lexicon of the other half when the regression is fitted.
Labels are learnt only from rows whose crc32 of doc_id, modulo 4, is not 2, and
from about ``sample_rows`` of them, picked by a hash of doc_id.  Only the text
of a row enters its score.

Null and empty texts get the score of a text without any word of the lexicon, and
an empty table gives an empty result.  Very long texts and tokens are scored whole.
Scores that tie with the threshold count as toxic.
Without labels of both kinds every score is the share of toxic labels (0 if
there are none).  Repeated rows give a row each; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import textbytes as tb
from .shared import small_batches

#: Labelled rows that the classifier is fitted on, about.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.3
#: Bytes of the word beginnings that the lexicon may hold.
BEGINNINGS = (4, 5, 6, 7, 9)
#: Least toxic texts with a lexicon entry, and least root of its likelihood ratio.
LEAST_TEXTS, LEAST_Z = 4, 4.5

# What a sign can stand for; fixed values.
LOOKS_LIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "#": "h"}
#: Costs of the channel in nats: a sign for a letter, a separator or a repeated letter for nothing, any other sign for nothing.
SIGN, SEPARATOR, REPEATED, NOISE = 1.0, 0.7, 0.5, 5.0
#: Letters of a word that may be part of another.
FRAGMENT = 4
#: Cost of a space for a word's end in a run of letters set apart.
WORD_END = 1.5
#: Tokens, and bytes of a token, that a worker remembers.
CACHE_TOKENS, CACHE_BYTES = 200_000, 256

_CLASS = np.zeros(256, dtype=np.int64)  # letters 1 to 26, everything else 0
_CLASS[97:123] = _CLASS[65:91] = np.arange(1, 27)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LETTER = _CLASS > 0
_SIGN = np.zeros(256, dtype=bool)
_SIGN[[ord(c) for c in LOOKS_LIKE]] = True
_LAST_SIGN = _SIGN.copy()  # signs that seldom end a plain word
_LAST_SIGN[[ord(c) for c in "!(<|+"]] = False


# ---------------------------------------------------------------- character model
def character_model(docs: DataFrame) -> np.ndarray:
    """Log probabilities of a letter or word end after two others, counted over all texts; 27 x 27 x 27."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(27**3, dtype=np.int64)
        for batch in tb.blocks(batches):
            data, offsets = tb.text_bytes(batch.column(0))
            # two word ends between texts, so that what a text counts for doesn't depend on its neighbours
            c = np.zeros(len(data) + 2 * len(offsets), dtype=np.int64)
            c[np.arange(len(data)) + 2 * np.repeat(np.arange(1, len(offsets)), np.diff(offsets))] = _CLASS[data]
            total += np.bincount(c[:-2] * 729 + c[1:-1] * 27 + c[2:], minlength=27**3)
        yield pa.RecordBatch.from_pydict({"at": np.flatnonzero(total), "n": total[total > 0]})

    rows = docs.select(docs["text"].cast("string").alias("text")).mapInArrow(count, "at long, n long")
    counts = np.full(27**3, 0.1)
    for r in rows.groupBy("at").agg(F.sum("n").alias("n")).collect():
        counts[r["at"]] += r["n"]
    counts = counts.reshape(27, 27, 27)
    return np.log(counts / counts.sum(axis=2, keepdims=True))


def restore(token: str, model: list) -> str:
    """The likeliest letters that a token stands for.

    Where only one state is left, all that came before is decided and leaves the search, so its memory is bounded by the
    longest stretch that can be read in several ways.
    """
    states: dict[tuple[int, int], tuple] = {(0, 0): (0.0, None)}
    decided: list[str] = []

    def spelt(path: tuple | None) -> list[str]:
        letters = []
        while path:
            letters.append(chr(96 + path[0]) if path[0] else " ")
            path = path[1]
        return letters[::-1]

    for c in token.lower():
        options = []
        if "a" <= c <= "z":
            options.append((ord(c) - 96, 0.0))
        for letter in LOOKS_LIKE.get(c, ""):
            options.append((ord(letter) - 96, SIGN))
        if c.isspace():
            options.append((0, WORD_END))
        skip = None if "a" <= c <= "z" else (NOISE if c.isalnum() else SEPARATOR)
        after: dict[tuple[int, int], tuple] = {}
        for (a, b), (cost, path) in states.items():
            for letter, extra in options:
                total = cost + extra - model[a][b][letter]
                if (b, letter) not in after or total < after[b, letter][0]:
                    after[b, letter] = total, (letter, path)
                if letter and letter == b and (total := cost + extra + REPEATED) < after.get((a, b), (math.inf,))[0]:
                    after[a, b] = total, path
            if skip is not None and cost + skip < after.get((a, b), (math.inf,))[0]:
                after[a, b] = cost + skip, path
        states = after
        if len(states) == 1:
            ((state, (cost, path)),) = states.items()
            decided += spelt(path)
            states = {state: (cost, None)}
    _, path = min(((cost - model[a][b][0], path) for (a, b), (cost, path) in states.items()), key=lambda x: x[0])
    return "".join(decided + spelt(path))


def obfuscated(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """Start, stop and row of parts that may be obfuscated words."""
    if not len(data):
        return []
    solid = ~_BLANK[data]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[firsts] |= solid[firsts]
    ends[firsts[1:] - 1] |= solid[firsts[1:] - 1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    letter = _LETTER[data]
    part = letter | _SIGN[data]
    # an inner byte that is no letter, between two that can be letters
    letters = np.concatenate([[0], np.cumsum(letter)])
    plain = np.concatenate([[0], np.cumsum(letter | (data >= 128))])
    lasts = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    before, behind = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
    before[1:], behind[:-1] = part[:-1], part[1:]
    before[firsts] = behind[lasts] = False  # texts don't see each other
    middle = (~letter & (data < 128) & before & behind) | (_LAST_SIGN[data] & before)
    inner = np.concatenate([[0], np.cumsum(middle)])
    double = np.zeros(len(data), dtype=bool)
    low = tb.LOWER[data]
    double[1:] = letter[1:] & (low[1:] == low[:-1])
    double[firsts] = False
    doubles = np.concatenate([[0], np.cumsum(double)])
    n_letters = letters[stop] - letters[start]
    odd = (n_letters > 0) & ((inner[stop] - inner[start] > 0) | (doubles[stop] - doubles[start] > 0) | (_SIGN[data[start]] & (stop - start > 2)))
    odd &= (stop - start) > 2
    found = list(zip(start[odd].tolist(), stop[odd].tolist(), row[odd].tolist(), strict=True))
    # runs of three or more single letters or signs
    single = (stop - start == 1) & part[start]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        while a < b:
            last = a + int(np.searchsorted(row[a:b], row[a], side="right"))
            if last - a > 2:
                found.append((int(start[a]), int(stop[last - 1]), int(row[a])))
            a = last
    return found


class Restorer:
    """Restores the obfuscated words of whole columns, each token once."""

    def __init__(self, model: np.ndarray):
        self.model, self.known = model.tolist(), {}

    def read(self, token: bytes) -> str:
        word = self.known.get(token)
        if word is None:
            word = restore(token.decode("utf-8", "replace"), self.model)
            if len(token) <= CACHE_BYTES:
                if len(self.known) >= CACHE_TOKENS:
                    self.known.clear()
                self.known[token] = word
        return word

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Per row, the restored words with spaces between them."""
        raw, rows = data.tobytes(), [[] for _ in range(len(offsets) - 1)]
        for a, b, row in obfuscated(data, offsets):
            word = self.read(raw[a:b])
            if len(word) > 2:
                rows[row].append(word)
        return pa.array([" ".join(x) for x in rows], pa.string())


# ---------------------------------------------------------------- words and word beginnings
def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of each word, and a hash a word for the word and each of its beginnings (0: it is shorter)."""
    low = tb.LOWER[data]
    start, stop, row = tb.words(low, offsets)
    rolling = tb.Rolling(low)
    columns = [rolling.span(start, stop)]
    for i, n in enumerate(BEGINNINGS):
        enough = stop - start >= n
        column = np.zeros(len(start), dtype=np.uint64)
        column[enough] = rolling.span(start[enough], start[enough] + n) ^ np.uint64(i + 1)
        columns.append(column)
    return row, np.stack(columns)


def joined_fragments(data: np.ndarray, offsets: np.ndarray, restorer: Restorer, lexicon: Lexicon) -> pa.Array:
    """Per row, the words of the lexicon that two or three short words make, one space apart, where the search joins them."""
    low = tb.LOWER[data]
    start, stop, row = tb.words(low, offsets)
    size = stop - start
    ends = np.cumsum(size)
    inside = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)
    rolling, raw = tb.Rolling(low[inside]), data.tobytes()
    letters = np.concatenate([[0], np.cumsum(_LETTER[low[inside]])])
    short = (size <= FRAGMENT) & (letters[ends] - letters[ends - size] == size)
    found: list[list[str]] = [[] for _ in range(len(offsets) - 1)]
    for k in (2, 3):
        n = len(start) - k + 1
        if n < 1:
            break
        fits = short[:n] & (row[:n] == row[k - 1 :])
        for j in range(1, k):
            fits &= short[j : n + j] & (start[j : n + j] == stop[j - 1 : n + j - 1] + 1) & (data[np.minimum(stop[j - 1 : n + j - 1], len(data) - 1)] == 32)
        at = np.flatnonzero(fits & (ends[k - 1 :] - ends[:n] + size[:n] >= BEGINNINGS[0]))
        at = at[lexicon(rolling.span(ends[at] - size[at], ends[at + k - 1])[None, :])[0] > 0]
        for i in at.tolist():
            token = raw[start[i] : stop[i + k - 1]]
            word = restorer.read(token)
            if word.encode() == token.lower().replace(b" ", b""):
                found[row[i]].append(word)
    return pa.array([" ".join(x) for x in found], pa.string())


def features(column: pa.Array, restorer: Restorer, lexicon: Lexicon | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row and hashes of the words of a column as they are, of those restored, and of those of the lexicon in fragments."""
    data, offsets = tb.text_bytes(column)
    parts = [_features(data, offsets), _features(*tb.text_bytes(restorer(data, offsets)))]
    if lexicon is not None and len(data):
        parts.append(_features(*tb.text_bytes(joined_fragments(data, offsets, restorer, lexicon))))
    return np.concatenate([row for row, _ in parts]), np.concatenate([hashes for _, hashes in parts], axis=1)


class Lexicon:
    """Weights by hash."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.weights = hashes[order], weights[order]
        self.maybe = np.zeros(1 << 18, dtype=bool)
        self.maybe[self.hashes & np.uint64((1 << 18) - 1)] = True

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(hashes.shape)
        if len(self.hashes):
            at = np.nonzero(self.maybe[hashes & np.uint64((1 << 18) - 1)])
            found = hashes[at]
            place = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
            out[at] = np.where(self.hashes[place] == found, self.weights[place], 0.0)
        return out


def measures(row: np.ndarray, hashes: np.ndarray, n: int, lexicon: Lexicon) -> np.ndarray:
    """What the words of each text amount to; n rows of 6."""
    weight = lexicon(hashes).max(axis=0) if len(row) else np.zeros(0)
    count = np.bincount(row, minlength=n)
    hit = np.flatnonzero(weight > 0)
    with np.errstate(over="ignore"):
        _, first = np.unique(tb.mix(hashes[0][hit] + row[hit].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    one = hit[first]
    total = np.bincount(row[one], weights=weight[one], minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, row[one], weight[one])
    different = np.bincount(row[one], minlength=n)
    size = np.log1p(count)
    return np.column_stack([total, most, np.sqrt(different), total / (1 + size), np.sqrt(np.bincount(row[hit], minlength=n) / np.maximum(count, 1)), size * (different > 0)])


# ---------------------------------------------------------------- learning
def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, scale and coefficients (the intercept last) by Newton's method."""
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    beta = np.zeros(z.shape[1])
    beta[-1] = math.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return centre, scale, beta


class Model:
    """All that scoring needs; its size is bounded by the labelled sample."""

    def __init__(self, letters: np.ndarray, lexicon: Lexicon | None, centre=None, scale=None, beta=None, prior: float = 0.0):
        self.letters, self.lexicon, self.centre, self.scale, self.beta, self.prior = letters, lexicon, centre, scale, beta, prior

    def score(self, column: pa.Array, restorer: Restorer) -> np.ndarray:
        n = len(column)
        if self.lexicon is None:
            return np.full(n, self.prior)
        x = measures(*features(column, restorer, self.lexicon), n, self.lexicon)
        z = ((x - self.centre) / self.scale) @ self.beta[:-1] + self.beta[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from labels (doc_id, toxic) of documents (doc_id, text)."""
    small_batches(docs.sparkSession)
    letters = character_model(docs)
    learn = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    learn = learn.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n, bad = learn.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < bad < n:
        return Model(letters, None, prior=float(n > 0 and bad / n))
    spread = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(1_000_000))
    learn = learn.where(spread < int(1_000_000 * min(1.0, sample_rows / n)))  # about sample_rows rows, so they may be broadcast
    fold = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(2)).cast("int").alias("fold")
    sample = docs.select("doc_id", docs["text"].cast("string").alias("text")).join(F.broadcast(learn), "doc_id").select("text", "toxic", fold)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(letters)
        for batch in tb.blocks(batches):
            row, hashes = features(batch.column(0), restorer)
            group = batch.column(1).to_numpy() * 2 + batch.column(2).to_numpy()
            flat, rows = hashes.reshape(-1), np.tile(row, len(hashes))
            flat, rows = flat[flat != 0], rows[flat != 0]
            order = np.lexsort((rows, flat))
            flat, rows = flat[order], rows[order]
            new = np.ones(len(flat), dtype=bool)
            new[1:] = (flat[1:] != flat[:-1]) | (rows[1:] != rows[:-1])
            flat, kind = flat[new], group[rows[new]]
            values, at = np.unique(flat, return_inverse=True)
            sums = [np.bincount(at, weights=kind == k, minlength=len(values)).astype(np.int64) for k in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), *map(pa.array, sums)], names=["h", "c0", "c1", "b0", "b1"])

    counts = sample.mapInArrow(count, "h long, c0 long, c1 long, b0 long, b1 long").groupBy("h").agg(*[F.sum(c).alias(c) for c in ("c0", "c1", "b0", "b1")])
    found = counts.where(f"b0 + b1 >= {LEAST_TEXTS}").toPandas()
    sizes = {(r["toxic"], r["fold"]): r["n"] for r in sample.groupBy("toxic", "fold").agg(F.count("*").alias("n")).collect()}

    def lexicon(folds: tuple[int, ...]) -> Lexicon:
        b, c = (sum(found[f"{k}{f}"].to_numpy(np.float64) for f in folds) for k in "bc")
        n_b, n_c = (sum(sizes.get((t, f), 0) for f in folds) for t in (1, 0))
        odds = np.log((b + 0.5) / (n_b - b + 0.5)) - np.log((c + 0.5) / (n_c - c + 0.5))

        def term(n: np.ndarray, of: float) -> np.ndarray:
            return np.where(n > 0, n * np.log(np.maximum(n, 1e-9) / max(of, 1e-9)), 0.0)

        # the root of the likelihood ratio of texts with the entry among the toxic and the others
        g = term(b, n_b) + term(n_b - b, n_b) + term(c, n_c) + term(n_c - c, n_c) - term(b + c, n_b + n_c) - term(n_b + n_c - b - c, n_b + n_c)
        good = (b >= LEAST_TEXTS) & (np.sqrt(2 * np.maximum(g, 0)) >= LEAST_Z) & (odds > 1)
        return Lexicon(found["h"].to_numpy(np.int64).view(np.uint64)[good], odds[good])

    halves = [lexicon((1,)), lexicon((0,))]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(letters)
        for batch in tb.blocks(batches):
            x = np.stack([measures(*features(batch.column(0), restorer, half), batch.num_rows, half) for half in halves])
            x = x[batch.column(2).to_numpy(), np.arange(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["toxic", "x"])

    measured = sample.mapInArrow(measure, "toxic int, x array<double>").toPandas()
    if measured["toxic"].nunique() < 2:
        return Model(letters, None, prior=bad / n)
    centre, scale, beta = fit_logistic(np.stack(measured["x"].to_numpy()), measured["toxic"].to_numpy(np.float64))
    return Model(letters, lexicon((0, 1)), centre, scale, beta)


def toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD, score_name: str = "_score", predicted_name: str = "_predicted") -> DataFrame:
    """All columns of docs, with the score and the prediction in two more (which replace columns of their names)."""
    small_batches(docs.sparkSession)
    docs = docs.drop(score_name, predicted_name)
    schema = StructType([*docs.schema.fields, StructField(score_name, DoubleType())])
    at = docs.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model.letters)
        for batch in tb.blocks(batches):
            column = batch.column(at).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(column, restorer))], names=[*batch.schema.names, score_name])

    return docs.mapInArrow(score, schema).withColumn(predicted_name, (F.col(score_name) >= threshold).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity(docs.select("doc_id", "text"), fit(docs, labels))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("_score").alias("score"), F.col("_predicted").alias("predicted"))
