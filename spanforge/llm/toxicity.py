"""Operator 2: toxicity by weak supervision.

Many voters (word lists and patterns) vote on every document. A generative label
model, fitted by EM on the counts of vote patterns over all documents, estimates
each voter's accuracy in each class and, along a tree over the voters, their
correlations. Its posteriors label a bounded sample of documents, on which a
linear classifier over words is trained; that classifier scores every text.

Voters are lists of insults and patterns in four languages, which know no labels,
and lists of words that a bounded sample of labelled rows of the training folds
ties to toxic documents, whole or by their first letters.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import fold, in_small_batches, labelled_sample

FOLDS, HELD = 3, 1
WORD = re.compile(r"[^\W\d_]+")
#: Short lists of insults by language, whatever the labels say. Each list is a voter.
INSULTS = {
    "en": ("idiot", "moron", "stupid", "dumb", "trash", "scum", "loser", "pathetic", "worthless", "disgusting", "clown", "fool", "jerk", "freak"),
    "de": ("idiot", "dumm", "blöd", "trottel", "depp", "abschaum", "versager", "erbärmlich", "wertlos", "widerlich", "dreck", "arsch", "schwein", "mistkerl"),
    "fr": ("idiot", "idiote", "crétin", "stupide", "imbécile", "ordure", "minable", "pathétique", "dégoûtant", "connard", "salaud", "débile", "abruti", "raté"),
    "es": ("idiota", "imbécil", "estúpido", "estúpida", "tonto", "basura", "escoria", "perdedor", "patético", "inútil", "asqueroso", "payaso", "cabrón", "miserable"),
}
#: Insults aimed at somebody, dismissals and hatred, in the same languages, and shouting. Each is a voter.
PATTERNS = (
    re.compile(r"\b(?:you|your|he|she|they|everyone)\b[^.!?\n]{0,40}\b(?:idiot|moron|loser|trash|scum|clown|fool)s?\b"),
    re.compile(r"\b(?:shut up|go away|get lost|hate (?:you|them|him|her))\b"),
    re.compile(r"\b(?:du|ihr|sie|alle)\b[^.!?\n]{0,40}\b(?:idioten?|trottel|versager|abschaum)\b|\b(?:halt die klappe|verschwinde|hau ab|ich hasse)\b"),
    re.compile(r"\b(?:tu|vous|ils|elles|il|elle)\b[^.!?\n]{0,40}\b(?:idiote?s?|crétins?|ordures?|minables?)\b|\b(?:ferme[- ]la|tais-toi|dégage|je (?:te|vous|les) déteste)\b"),
    re.compile(r"\b(?:tú|eres|usted|ellos|ellas|son)\b[^.!?\n]{0,40}\b(?:idiotas?|imbéciles?|escoria|basura)\b|\b(?:cállate|lárgate|vete de aquí|(?:te|los|las) odio)\b"),
    re.compile(r"[!?]{3,}"),
)
LISTS = 8
#: Lengths of the beginnings of words.
STEMS = (4, 5, 6, 7, 8)
VOTERS = len(INSULTS) + LISTS + len(PATTERNS)
#: How much the labelled rows weigh in the label model, as a share of all documents.
KNOWN_SHARE = 0.1
#: What the fit takes at most: labelled rows and characters, and words of the classifier.
MAX_ROWS, MAX_CHARS, MAX_WORDS = 6000, 24_000_000, 600


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text))


def forms(words: set[str]) -> set[str]:
    """The words, what they begin with, as insults are inflected, and what two, or three or more, of them begin with."""
    starts = Counter(w[:k] for w in words for k in STEMS if len(w) > k)
    many = {f"{s}{'*' * k}" for s, n in starts.items() if len(s) > STEMS[0] for k in (2, 3) if n >= k}
    return words | {f"{s}*" for s in starts} | many


class Matcher:
    """Which of given forms a set of words has; most words are passed over by their first letters."""

    def __init__(self, known: Iterable[str]):
        known = set(known)
        self.words = {f for f in known if not f.endswith("*")}
        self.stems = known - self.words
        self.first = {f.rstrip("*")[: STEMS[0]] for f in known}

    def found(self, words: set[str]) -> set[str]:
        near = {w for w in words if w[: STEMS[0]] in self.first}
        return (near & self.words) | (forms(near) & self.stems if self.stems else set())


def learned_lists(sample: list[tuple[set[str], int]], least: int = 5) -> dict[str, int]:
    """Forms of which nearly all documents in the sample are toxic, each with the number of one of ``LISTS`` voters."""
    toxic = Counter(f for words, y in sample if y for f in forms(words))
    some = Matcher(f for f, n in toxic.items() if n >= least)
    clean = Counter(f for words, y in sample if not y for f in some.found(words))
    tied = [f for f, n in toxic.items() if n >= least and n >= 8 * clean[f]]
    # words of copied toxic documents come along; they have less support than the insults themselves
    best: list[str] = []
    for f in sorted(tied, key=lambda f: (10 * clean[f] - toxic[f], len(f), f)):
        # what one in the list implies adds nothing; the same beginning in fewer words does
        if not any(f.startswith(g.rstrip("*")) and (f.count("*") >= g.count("*") or "*" not in f) for g in best if g.endswith("*")):
            best.append(f)
        if len(best) == 10 * LISTS:
            break
    return {f: i % LISTS for i, f in enumerate(best)}


class Voters:
    def __init__(self, lists: dict[str, int]):
        self.lists, self.matcher = lists, Matcher(lists)

    def vote(self, text: str) -> int:
        """The voters that call the lower-case text toxic, as bits."""
        words = words_of(text)
        bits = 0
        for i, insults in enumerate(INSULTS.values()):
            bits |= (not words.isdisjoint(insults)) << i
        for f in self.matcher.found(words):
            bits |= 1 << (len(INSULTS) + self.lists[f])
        for i, p in enumerate(PATTERNS):
            bits |= bool(p.search(text)) << (len(INSULTS) + LISTS + i)
        return bits


class LabelModel:
    """p(class) p(votes | class), the votes along a tree of pairwise dependencies, fitted by EM.

    The tree links the voters with the most mutual information given the class,
    so that voters which fire together aren't counted as independent evidence.
    Voters abstain where they don't fire, and then say nothing, unless all do.
    """

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, prior: float, known: tuple[np.ndarray, np.ndarray] | None = None, rounds: int = 40):
        """patterns, counts: the vote patterns of all documents. known: patterns and labels of labelled rows.

        The known rows are a prior, which keeps the classes in place: they weigh ``KNOWN_SHARE`` of all others.
        """
        bits, labels = known if known is not None else (np.zeros(0, int), np.zeros(0, int))
        every = np.unique(np.concatenate([patterns, bits]))
        self.votes = (every[:, None] >> np.arange(VOTERS) & 1).astype(np.int8)
        n = np.zeros(len(every))
        np.add.at(n, np.searchsorted(every, patterns), counts)
        fixed = np.zeros((2, len(every)))
        np.add.at(fixed, (labels, np.searchsorted(every, bits)), KNOWN_SHARE * n.sum() / max(1, len(bits)))
        post = np.clip(self.votes @ np.array([2.0] * len(INSULTS) + [1.0] * LISTS + [1.0] * (len(PATTERNS) - 1) + [0.1]) / 2.0, 0.02, 0.98)
        self.tree: list[tuple[int, int]] = []
        for step in range(rounds):
            w = np.stack([n * (1 - post), n * post]) + fixed
            if step % 10 == 0:
                self.tree = self._tree(w)
            self._maximise(w)
            # the class rate is tied to the labelled one, which keeps the classes from swapping
            rate = np.clip((w[1].sum() + 200 * prior) / (w.sum() + 200), 1e-3, 0.5)
            self.prior = np.log([1 - rate, rate])
            post = self.posterior(self.votes)

    def _pair(self, w: np.ndarray, i: int, j: int) -> np.ndarray:
        """Class, vote of i, vote of j: joint counts, smoothed towards independence within the class."""
        t = np.zeros((2, 2, 2))
        for c in range(2):
            np.add.at(t[c], (self.votes[:, i], self.votes[:, j]), w[c])
        total = w.sum(axis=1)
        fire = [(w @ self.votes[:, k] + 0.5) / (total + 1) for k in (i, j)]
        pi, pj = (np.stack([1 - f, f], axis=1) for f in fire)
        if i == j:
            return t + np.stack([np.diag(p) for p in pi])
        return t + 2 * pi[:, :, None] * pj[:, None, :]

    def _tree(self, w: np.ndarray) -> list[tuple[int, int]]:
        """(voter, the voter it depends on or -1), by Prim's algorithm on conditional mutual information."""
        gain = np.zeros((VOTERS, VOTERS))
        for i in range(VOTERS):
            for j in range(i):
                t = self._pair(w, i, j)
                p = t / t.sum()
                pc, pi, pj = p.sum((1, 2), keepdims=True), p.sum(2, keepdims=True), p.sum(1, keepdims=True)
                gain[i, j] = gain[j, i] = (p * np.log(p * pc / (pi * pj))).sum()
        tree, rest = [(0, -1)], set(range(1, VOTERS))
        while rest:
            j, i = max(((j, i) for j in rest for i, _ in tree), key=lambda e: (gain[e], -e[0]))
            tree.append((j, i))
            rest.remove(j)
        return tree

    def _maximise(self, w: np.ndarray) -> None:
        self.table = {}
        for i, j in self.tree:
            t = self._pair(w, i, j if j >= 0 else i)
            if j < 0:
                t = np.stack([t[:, 0, 0], t[:, 1, 1]], axis=1)[:, :, None].repeat(2, axis=2)
            self.table[i] = np.log(t / t.sum(axis=1, keepdims=True))
        self.accuracy = {i: np.exp(t).mean(axis=2) for i, t in self.table.items()}

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        z = np.tile(self.prior, (len(votes), 1))
        silent = votes.sum(axis=1) == 0
        for i, j in self.tree:
            for c in range(2):
                z[:, c] += np.where(silent | (votes[:, i] > 0), self.table[i][c, votes[:, i], votes[:, j] if j >= 0 else 0], 0.0)
        return 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -50, 50)))

    def of(self, bits: int) -> float:
        return float(self.posterior((np.array([[bits]]) >> np.arange(VOTERS) & 1).astype(np.int8))[0])


class Linear:
    """Logistic regression over the presence of forms, trained on soft labels.

    The ``MAX_WORDS`` forms most tied to toxic texts, by chi-square on the soft
    labels, are its inputs; Newton steps with a ridge fit it.
    """

    def __init__(self, sets: list[set[str]], target: np.ndarray, ridge: float = 2.0, steps: int = 25):
        rows, share = len(sets), float(target.mean())
        t: dict[str, float] = defaultdict(float)
        for s, y in zip(sets, target, strict=True):
            if y >= 0.5:
                for f in forms(s):
                    t[f] += y
        some = Matcher(f for f, k in t.items() if k >= 3)
        n = Counter(f for s in sets for f in some.found(s))

        def gain(f: str) -> float:
            off = t[f] - n[f] * share
            return off * off / (n[f] * share * (1 - share) + 1e-9) * (1 - n[f] / (rows + 1))

        # forms of ordinary text are left out, so that a short text isn't judged by what it lacks
        best = sorted((f for f, k in n.items() if t[f] > 2 * share * k), key=lambda f: (-gain(f), f))[:MAX_WORDS]
        self.ids, self.matcher = {f: i for i, f in enumerate(best)}, Matcher(best)
        x = np.zeros((rows, len(best) + 1))
        x[:, -1] = 1.0
        for i, s in enumerate(sets):
            x[i, [self.ids[f] for f in self.matcher.found(s)]] = 1.0
        self.w = np.zeros(x.shape[1])
        self.w[-1] = math.log((share + 1e-6) / (1 - share + 1e-6))
        # a form with little support must not separate the sample by chance
        penalty = np.array([ridge / t[f] for f in best] + [1e-6])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ self.w, -30, 30)))
            h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
            step = np.linalg.solve(h, x.T @ (target - p) - penalty * self.w)
            self.w += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-4:
                break

    def score(self, words: set[str]) -> float:
        z = float(self.w[-1]) + sum(self.w[self.ids[f]] for f in self.matcher.found(words))
        return 1 / (1 + math.exp(-min(40.0, max(-40.0, z))))


def fit(docs: DataFrame, labels: DataFrame) -> Linear | None:
    """The classifier, or None where the training folds have no labelled rows of both classes."""
    sample = [(t.lower(), y) for t, y in labelled_sample(docs, labels, "toxic", FOLDS, HELD, MAX_ROWS, MAX_CHARS)]
    if len({y for _, y in sample}) < 2:
        return None
    sets = [words_of(t) for t, _ in sample]
    voters = Voters(learned_lists([(s, y) for s, (_, y) in zip(sets, sample, strict=True)]))

    @F.pandas_udf("int")
    def votes(texts: pd.Series) -> pd.Series:
        return pd.Series([voters.vote(x.lower() if x else "") for x in texts], dtype="int32")

    # a row for each pattern of votes that occurs reaches the driver: few, as most voters are silent on a text
    cast = in_small_batches(docs).select(votes("text").alias("bits")).groupBy("bits").count().collect()
    own, y = np.array([voters.vote(t) for t, _ in sample]), np.array([int(y > 0) for _, y in sample])
    model = LabelModel(np.array([r["bits"] for r in cast]), np.array([r["count"] for r in cast]), float(y.mean()), (own, y))
    target = np.array([model.of(b) for b in own])
    return Linear(sets, target)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """All columns of ``docs`` and held_out, score, predicted: how likely each text is toxic.

    Only text is scored; labels, lang, source and doc_id are no inputs. Rows with
    crc32(doc_id) mod 3 = 1 teach no labels.

    Defined cases: a null text counts as empty; an empty text gets the score of a
    document without known words. Rows that repeat get equal scores. A null id
    is not held out and teaches nothing. Without usable labels every score is 0.
    Columns named like a result are replaced by it. An empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))  # at most MAX_WORDS weights

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fitted = model.value
        for texts in batches:
            yield pd.Series([fitted.score(words_of(t.lower() if t else "")) if fitted else 0.0 for t in texts], dtype="float64")

    out = in_small_batches(docs).drop("held_out", "score", "predicted")
    out = out.withColumn("held_out", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD, F.lit(False)))
    out = out.withColumn("score", scores("text"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
