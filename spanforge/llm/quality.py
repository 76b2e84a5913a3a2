"""Operator 7: quality classifier.

Random-indexing word vectors (each word has a sparse random index vector; its
word vector is the sum of the index vectors of its neighbours, wherever it
occurs) are pooled over each document and go through a two-layer numpy network
whose probabilities are calibrated by a temperature.

Word counts and neighbours cover every text: each task sums what it reads, and
Spark adds the tasks' sums, which are whole numbers, so that reruns agree. Only
the network is fitted on a bounded sample of labelled rows. Every document is
scored, over its whole text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from struct import Struct

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import fold, fresh, in_small_batches, labelled_sample
from spanforge.storage import materialize

FOLDS, HELD = 4, 2
TOKEN = re.compile(r"\w+|[^\w\s]+")
DIM, NONZERO, REACH, HIDDEN = 64, 4, 2, 32
#: Words that have a vector of their own: so many, or more as the square root of all words grows, by frequency. Rarer ones share that of their shape.
WORDS, WORDS_BY_ROOT = 8000, 2
SHAPES = ("<x>", "<Xx>", "<XX>", "<xX>", "<9>", "<#>", "<again>")
#: Words of the whole corpus that count as read before each text, so that short texts are judged carefully.
PRIOR_WORDS = 8
#: What the network's fit takes at most: labelled rows and their characters.
MAX_ROWS, MAX_CHARS = 2000, 10_000_000
#: Distinct pieces of text that a task counts before it passes the counts on, and tokens that it handles at once.
HELD_WORDS, CHUNK = 200_000, 200_000
#: Pieces of text between white space that a task remembers the words of: so many, of so many characters at most.
REMEMBERED, LONGEST = 200_000, 64
PACK = Struct("=q").pack
#: Sums of neighbours are whole numbers of this unit.
UNIT = 1 << 16


def shape(word: str) -> int:
    """Which of ``SHAPES`` a word without a vector has: lower case, capitalised, capitals, mixed, with digits, marks."""
    if word.isalpha() and word.islower():  # most words
        return 0
    if not word[0].isalnum() and word[0] != "_":
        return 5
    if any(map(str.isdigit, word)):
        return 4
    return 0 if word.islower() else 2 if word.isupper() and len(word) > 1 else 1 if word[0].isupper() and not any(map(str.isupper, word[1:])) else 3


class Pieces(dict):
    """What white space parts -> the keys of its words, packed.

    The key of a word is its number, or, of a word without one, a hash of 59
    bits, so that its repeats are told, followed by its shape. Hashes are those
    of this process, as keys don't leave it.
    """

    def __init__(self, numbers: dict[str, int]):
        super().__init__()
        self.numbers = numbers

    def key(self, word: str) -> bytes:
        i = self.numbers.get(word)
        return PACK(i if i is not None else 1 << 62 | (hash(word) & (1 << 59) - 1) << 3 | shape(word))

    def __missing__(self, piece: str) -> bytes:
        keys = self.key(piece) if piece.isalnum() else b"".join(map(self.key, TOKEN.findall(piece)))
        if len(self) < REMEMBERED and len(piece) <= LONGEST:
            self[piece] = keys
        return keys

    def __reduce__(self):
        return Pieces, (self.numbers,)


class Vocabulary:
    """Numbers of words, the shapes last."""

    def __init__(self, counts: list[tuple[str, int]], total: int):
        self.ids = {w: i for i, (w, _) in enumerate(counts)}
        self.pieces = Pieces(self.ids)
        self.size = len(counts) + len(SHAPES)
        rest = max(1, total - sum(n for _, n in counts)) / len(SHAPES)
        n = np.array([n for _, n in counts] + [rest] * len(SHAPES), np.float64)
        self.share = n / n.sum()
        # an index vector weighs less the more often its word occurs, or frequent words would be in all sums
        self.weight = np.sqrt(n.mean() / n)

    def of(self, text: str | None) -> np.ndarray:
        """The numbers of a text's words; a word that repeats the one before it is ``<again>``."""
        keys = np.frombuffer(b"".join(map(self.pieces.__getitem__, (text or "").split())), np.int64)
        first = len(self.ids)
        ids = np.where(keys < first, keys, first + (keys & 7))
        ids[1:][keys[1:] == keys[:-1]] = self.size - 1
        return ids

    def index(self) -> tuple[np.ndarray, np.ndarray]:
        """Where the index vector of each word is not 0, and its values there, in whole units."""
        at, value = np.zeros((self.size, NONZERO), np.int64), np.zeros((self.size, NONZERO))
        for w, i in [*self.ids.items(), *((s, len(self.ids) + k) for k, s in enumerate(SHAPES))]:
            h = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 7)
            for j in range(NONZERO):
                at[i, j] = (h >> (12 * j)) % DIM
                value[i, j] = 1.0 if h >> (60 + j) & 1 else -1.0
        return at, np.round(value * self.weight[:, None] * UNIT)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()  # of what white space parts, each to be taken apart once

        def flush() -> pd.DataFrame:
            words: dict[str, int] = {}
            for piece, n in seen.items():
                for w in (piece,) if piece.isalnum() else TOKEN.findall(piece):
                    words[w] = words.get(w, 0) + n
            seen.clear()
            return pd.DataFrame(words.items(), columns=["word", "n"])

        for b in batches:
            for t in b["text"]:
                seen.update((t or "").split())
                if len(seen) > HELD_WORDS:
                    yield flush()
        yield flush()

    found = in_small_batches(docs).select("text").mapInPandas(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def neighbours(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(word, v0, v1, ...): the summed index vectors of each word's neighbours over all texts, in whole units."""
    told = docs.sparkSession.sparkContext.broadcast((vocabulary, *vocabulary.index()))
    names = [f"v{k}" for k in range(DIM)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, at, value = told.value
        total = np.zeros(words.size * DIM)
        chunk = max(CHUNK, 16 * words.size)  # a sum over all words is made for each

        def add(parts: list[np.ndarray]) -> None:
            ids = np.concatenate(parts)
            for d in range(1, REACH + 1):
                for i in range(0, len(ids) - d, 4 * chunk):  # a very long text in pieces
                    a, b = ids[:-d][i : i + 4 * chunk], ids[d:][i : i + 4 * chunk]
                    both = (a >= 0) & (b >= 0)
                    a, b = a[both], b[both]
                    # equal pairs are added at once; sums of whole numbers don't depend on the order
                    pairs, n = np.unique(np.minimum(a, b) * words.size + np.maximum(a, b), return_counts=True)
                    a, b = np.divmod(pairs, words.size)
                    for x, y in ((a, b), (b, a)):
                        for j in range(NONZERO):
                            np.add(total, np.bincount(x * DIM + at[y, j], value[y, j] * n, len(total)), out=total)

        parts, held = [], 0
        gap = np.full(REACH, -1, np.int64)  # texts have no neighbours across their ends
        for batch in batches:
            for t in batch["text"]:
                parts += [words.of(t), gap]
                held += len(parts[-2])
                if held >= chunk:
                    add(parts)
                    parts, held = [], 0
        if parts:
            add(parts)
        table = total.reshape(-1, DIM)
        some = np.flatnonzero(table.any(axis=1))
        out = pd.DataFrame(table[some].astype(np.int64), columns=names)
        out.insert(0, "word", some)
        yield out

    found = in_small_batches(docs).select("text").mapInPandas(run, ", ".join(["word long", *(f"{n} long" for n in names)]))
    return found.groupBy("word").agg(*[F.sum(n).alias(n) for n in names])


class Vectors:
    """Word vectors by random indexing, and a document's pooled vector: mean and spread of its words' vectors."""

    def __init__(self, vocabulary: Vocabulary, table: np.ndarray):
        self.words = vocabulary
        self.table = (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-6)).astype(np.float32)
        self.prior = PRIOR_WORDS * (vocabulary.share @ self.table), PRIOR_WORDS * (vocabulary.share @ self.table**2)

    def pooled(self, text: str | None) -> np.ndarray:
        ids = self.words.of(text)
        n = np.bincount(ids, minlength=self.words.size)
        some = np.flatnonzero(n)
        often, own, every = n[some].astype(np.float32), self.table[some], len(ids) + PRIOR_WORDS
        mean, square = ((often @ x + p) / every for x, p in zip((own, own * own), self.prior, strict=True))
        return np.concatenate([mean, np.sqrt(np.maximum(square - mean * mean, 0.0))]).astype(np.float32)


def learn_vectors(docs: DataFrame) -> Vectors:
    """The vectors of the most frequent words of all texts: ``WORDS``, or ``WORDS_BY_ROOT`` times the root of how many words there are.

    As many counts and sums reach the driver, whatever the number of different
    words: at a million million words, two million.
    """
    counts = materialize(word_counts(docs), "quality-words")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    first = counts.orderBy(F.desc("n"), "word").limit(max(WORDS, WORDS_BY_ROOT * math.isqrt(total))).collect()
    vocabulary = Vocabulary([(r["word"], r["n"]) for r in first], total)
    table = np.zeros((vocabulary.size, DIM))
    for r in neighbours(docs, vocabulary).collect():
        table[r["word"]] = r[1:]
    return Vectors(vocabulary, table)


class Network:
    """Two layers, trained with Adam on cross-entropy; its logits are divided by a fitted temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 11, steps: int = 400):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        tuning = np.arange(len(x)) % 5 == 0
        fit = ~tuning if tuning.sum() >= 20 else np.ones(len(x), bool)
        p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        for step in range(1, steps + 1):
            a = np.tanh(x[fit] @ p[0] + p[1])
            e = (1 / (1 + np.exp(-(a @ p[2] + p[3]))) - y[fit]) / max(1, fit.sum())
            back = np.outer(e, p[2]) * (1 - a * a)
            grads = [x[fit].T @ back + 1e-4 * p[0], back.sum(axis=0), a.T @ e + 1e-4 * p[2], np.array([e.sum()])]
            for k, g in enumerate(grads):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 0.02 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.p = p
        z, t = self._logits(x[tuning] if tuning.sum() >= 20 else x), y[tuning] if tuning.sum() >= 20 else y
        loss = lambda c: np.mean(np.logaddexp(0, z / c) - t * z / c)
        self.temperature = min(np.geomspace(0.25, 8, 51), key=loss)

    def _logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self._logits(np.clip((x - self.mean) / self.scale, -6, 6)) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Vectors, Network] | None:
    """The model, or None where no labelled rows with both classes are outside the held-out fold."""
    sample = labelled_sample(docs, labels, "quality", FOLDS, HELD, MAX_ROWS, MAX_CHARS)
    if len({y for _, y in sample}) < 2:
        return None
    vectors = learn_vectors(docs)
    return vectors, Network(np.stack([vectors.pooled(t) for t, _ in sample]), np.array([float(y) for _, y in sample]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """All columns of ``docs`` and held_out, score, predicted: how likely each text is of quality 1.

    Only text is scored; labels, lang, source and doc_id are no inputs. Rows with
    crc32(doc_id) mod 4 = 2 teach nothing.

    Defined cases: a null text counts as empty, and an empty one gets the score
    of a document without words. Rows that repeat get equal scores. A null id is
    not held out and teaches nothing. Without usable labels every score is 0.5.
    Columns named like a result are replaced by it. An empty table gives no rows.
    """
    return scored(docs, fit(docs, labels), threshold)


def keep(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``docs`` without those predicted to be of low quality; all of them where no model can be fitted.

    Defined cases are those of ``classify``, but all columns keep their values,
    whatever their names.
    """
    model = fit(docs, labels)
    if model is None:
        return docs
    (name,) = fresh(docs, "score")
    return in_small_batches(docs).withColumn(name, _scores(docs, model)("text")).filter(F.col(name) >= threshold).drop(name)


def _scores(docs: DataFrame, fitted: tuple[Vectors, Network] | None):
    """The scores of a column of texts by a fitted model, or 0.5 by none."""
    model = docs.sparkSession.sparkContext.broadcast(fitted)  # a vector for each word of the vocabulary

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fitted = model.value
        for texts in batches:
            if fitted is None or not len(texts):
                yield pd.Series(np.full(len(texts), 0.5))
            else:
                # one by one, as the rounding of a product of matrices depends on the row
                yield pd.Series([float(fitted[1].score(fitted[0].pooled(t)[None])[0]) for t in texts])

    return scores


def scored(docs: DataFrame, fitted: tuple[Vectors, Network] | None, threshold: float = 0.7) -> DataFrame:
    """``docs`` with the results of a fitted model, or of none."""
    out = in_small_batches(docs).drop("held_out", "score", "predicted")
    out = out.withColumn("held_out", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD, F.lit(False)))
    out = out.withColumn("score", _scores(docs, fitted)("text"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
