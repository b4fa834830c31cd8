"""Toxicity by cumulative-link ordinal regression over sparse text features.

A document is as toxic as its strongest passage: two neighbouring stretches of HALF words, whichever pair has the highest
score, so that a long text around it hides nothing. Features count a stretch's distinct words by word and by leading letters
(inflected forms share them). Severity has four grades: 0 for documents labelled clean, and 1 to 3 for labelled toxic ones, cut
at the terciles of the share of telling words in that passage. P(grade <= k) = sigmoid(t_k - w.x) with one weight vector for
all thresholds t_0 < t_1 < t_2. The model is fitted on a bounded sample of labelled rows: passages are chosen by the log odds
of their words, then again by the weights fitted on these. Fitting and scoring use the same function of a text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, materialize

_WORD = re.compile(r"[^\W\d_]+")
#: Labelled rows of each label that a model is fitted on, about; they are chosen by a hash of the id.
SAMPLE = 6000
#: The labelled toxic documents that a feature must be in. All such features are fitted; the labelled sample bounds their number.
SEEN = 3
#: Words in a stretch.
HALF = 32
PREFIXES = (3, 4, 5, 6)
GRADES = 3
#: Distinct words whose weights a task remembers at most.
CACHE = 300_000


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def stretches(ws: list[str]) -> list[set[str]]:
    """The distinct words of each HALF words."""
    return [set(ws[k : k + HALF]) for k in range(0, len(ws), HALF)]


def strongest(parts: list[set[str]], weight) -> tuple[float, int]:
    """(score, first stretch) of the strongest passage by the weights of words; sums are exact, so in any order the same."""
    sums = [math.fsum(map(weight, x)) for x in parts]
    pairs = [math.fsum(x) for x in zip(sums, sums[1:])] or sums or [0.0]
    at = max(range(len(pairs)), key=pairs.__getitem__)
    return pairs[at], at


def features(word: str) -> list[str]:
    """The word itself, and its leading letters if it is longer."""
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


@dataclass
class Model:
    index: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def word_weight(self, word: str) -> float:
        return float(sum(self.weights[self.index[f]] for f in features(word) if f in self.index))

    def grades(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None] - scores[:, None], -60, 60)))


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grade: np.ndarray, weight: np.ndarray, n_features: int, steps: int = 300, l2: float = 1e-3):
    """(weights, ordered thresholds) by Adam on the weighted log likelihood of a cumulative-link model."""
    n, k = len(grade), GRADES
    w, t = np.zeros(n_features), np.concatenate([[1.0], np.zeros(k - 1)])  # the first threshold, logs of the gaps above
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, t)]
    share = weight / weight.sum()
    for step in range(1, steps + 1):
        s = np.bincount(rows, w[cols] * values, n)
        cuts = np.concatenate([t[:1], t[0] + np.cumsum(np.exp(t[1:]))])
        below = 1 / (1 + np.exp(np.clip(s[:, None] - cuts[None], -40, 40)))  # P(grade <= k)
        padded = np.concatenate([np.zeros((n, 1)), below, np.ones((n, 1))], 1)
        slope = np.concatenate([np.zeros((n, 1)), below * (1 - below), np.zeros((n, 1))], 1)
        high, low = np.arange(n), grade
        p = np.maximum(padded[high, low + 1] - padded[high, low], 1e-12)
        up, down = slope[high, low + 1] / p * share, slope[high, low] / p * share
        g_s = up - down  # of minus the log likelihood
        g_cut = np.array([np.sum(down[grade == j + 1]) - np.sum(up[grade == j]) for j in range(k)])
        g_t = np.concatenate([[g_cut.sum()], [np.exp(t[j]) * g_cut[j:].sum() for j in range(1, k)]])
        g_w = np.bincount(cols, g_s[rows] * values, n_features) + l2 * w
        for x, g, m in ((w, g_w, state[0]), (t, g_t, state[1])):
            m[0][:] = 0.9 * m[0] + 0.1 * g
            m[1][:] = 0.999 * m[1] + 0.001 * g * g
            x -= 0.1 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-9)
    return w, np.concatenate([t[:1], t[0] + np.cumsum(np.exp(t[1:]))])


def sample_labels(labels: DataFrame, column: str, size: int) -> DataFrame:
    """(doc_id, y): about ``size`` labelled rows of each of 0 and 1, by a hash of the id."""
    labelled = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col(column).cast("int").alias("y"))
    n = {r.y: r.n for r in labelled.groupBy("y").agg(F.count("*").alias("n")).collect()}
    cut = lambda y: int(min(1.0, size / max(1, n.get(y, 0))) * 2**62)
    h = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("label")), 2)
    return labelled.where(h < F.when(F.col("y") == 1, F.lit(cut(1))).otherwise(F.lit(cut(0))))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from the labelled rows of both labels; None if either is missing."""
    chosen = sample_labels(labels, "toxic", sample)

    def read(batches):
        for batch in batches:
            found = [words(t.as_py()) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["y"], pa.array(found, pa.list_(pa.string()))], names=["y", "words"])

    # the sample has a documented bound of about 2 x sample rows of two numbers
    known = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id").select("y", "text").mapInArrow(read, "y int, words array<string>")
    known = materialize(known, "toxicity-sample")
    n = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if set(n) != {0, 1}:
        return None

    def count(batches):
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for y, ws in zip(batch["y"].to_pylist(), batch["words"].to_pylist()):
                seen[y].update({f for w in set(ws) for f in features(w)})
        names = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([seen[y][f] for f in names], pa.int64()) for y in (0, 1))], names=["f", "n0", "n1"])

    rated = known.mapInArrow(count, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(F.col("n1") >= SEEN)
    odds = F.log((F.col("n1") + 0.5) / (n[1] + 1)) - F.log((F.col("n0") + 0.5) / (n[0] + 1))
    best = rated.withColumn("odds", odds).orderBy("f").collect()
    if not best:
        return None
    index = {r.f: i for i, r in enumerate(best)}
    telling = frozenset(r.f for r in best if r.odds > 2)
    model = Model(index, np.array([r.odds for r in best]), np.zeros(GRADES))
    for steps in (100, 300):
        model = Model(index, *fit_ordinal(*_design(known, model, telling), len(index), steps))
    return model


def _design(known: DataFrame, model: "Model", telling: frozenset) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, columns, counts; grade, weight of each row) of the strongest passages of the labelled texts."""
    index = model.index

    def run(batches):
        weight = Remembered(model).__getitem__
        for batch in batches:
            found, evidence = [], []
            for ws in batch["words"].to_pylist():
                parts = stretches(ws)
                at = strongest(parts, weight)[1]
                inside = [w for part in parts[at : at + 2] for w in sorted(part)]
                c = Counter(index[f] for w in inside for f in features(w) if f in index)
                found.append([x for pair in sorted(c.items()) for x in pair])
                evidence.append(sum(any(f in telling for f in features(w)) for w in inside) / max(1, len(inside)))
            yield pa.RecordBatch.from_arrays([batch["y"], pa.array(evidence, pa.float64()), pa.array(found, pa.list_(pa.int32()))], names=["y", "evidence", "found"])

    table = known.mapInArrow(run, "y int, evidence double, found array<int>").toArrow()  # at most about 2 x sample rows
    y, evidence = table["y"].to_numpy(), table["evidence"].to_numpy()
    flat = table["found"].combine_chunks()
    sizes, pairs = np.diff(flat.offsets.to_numpy()) // 2, flat.flatten().to_numpy().reshape(-1, 2)
    cuts = np.quantile(evidence[y == 1], [1 / 3, 2 / 3])
    grade = np.where(y == 1, 1 + (evidence > cuts[0]).astype(int) + (evidence > cuts[1]), 0)
    return np.repeat(np.arange(len(y)), sizes), pairs[:, 0], pairs[:, 1].astype(float), grade, np.ones(len(y))


class Remembered(dict):
    """Weights of words, computed once; beyond CACHE words all are forgotten."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE:
            self.clear()
        self[word] = weight = self.model.word_weight(word)
        return weight


def scorer(model: Model | None):
    """A function over texts: (severity, p_toxic, grade) of each as arrays."""
    weight = Remembered(model).__getitem__

    def run(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s = np.zeros(len(texts))
        for k, text in enumerate(texts if model is not None else ()):
            s[k] = strongest(stretches(words(text)), weight)[0]
        above = np.zeros((len(s), GRADES)) if model is None else model.grades(s)
        p = -np.diff(np.concatenate([np.ones((len(s), 1)), above, np.zeros((len(s), 1))], 1), axis=1)
        return above.sum(1), above[:, 0], p.argmax(1).astype(np.int32)

    return run


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, severity, p_toxic, grade, toxic): expected severity (0 to 3), P(severity > 0), the likeliest grade, p >= 0.5."""

    def run(batches):
        of = scorer(model)
        for batch in batches:
            severity, p, grades = of(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(severity), pa.array(p), pa.array(grades), pa.array(p >= 0.5)], names=["doc_id", "severity", "p_toxic", "grade", "toxic"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, severity double, p_toxic double, grade int, toxic boolean")


def grade(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Return doc_id, severity, p_toxic, grade, toxic for every row of ``docs``, learned from ``labels`` (doc_id, toxic).

    Labels other than 0 and 1 are ignored; without both, nothing is toxic. A null or empty text has no words and scores as
    such. Repeated rows score alike; other columns are ignored; an empty table gives none.
    """
    return score(docs, train(docs, labels, sample))


def reject(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without those graded toxic."""
    model = train(docs, labels, sample)

    def run(batches):
        of = scorer(model)
        for batch in batches:
            yield batch.filter(pa.array(of(batch["row"].field("text").to_pylist())[1] < 0.5))

    whole = docs.select(F.struct(*columns(docs)).alias("row"))  # whatever the columns' names
    return whole.mapInArrow(run, whole.schema).select("row.*")
