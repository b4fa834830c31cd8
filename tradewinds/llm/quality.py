"""Quality by a generalised additive model with pairwise interactions.

Every feature is a number that a text alone gives (never its labels, language, source or id). Features are binned; shallow
trees are boosted in turn, one feature after the other, and summed into one lookup table per feature. Then the pairs of
features that explain most of what is left get tables of their own, boosted likewise by trees of one cut in each feature. A
score adds up the table entries of a text's bins.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a model is fitted on at most, about; they are chosen by a hash of the id.
SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS = 48, 12, 8
ROUNDS, PAIR_ROUNDS, RATE = 120, 60, 0.1
_L2, _LEAST = 1.0, 5.0

_SENTENCE = re.compile(r"[.!?…]+(?=\s|$)")
_RUN = re.compile(r"([^\w\s])\1+")
_LETTERS = re.compile(r"[^\W\d_]+")
NAMES = (
    "log_words word_length log_chars upper digits symbols symbol_runs pipes distinct_words top_word repeated_next distinct_pairs "
    "sentence_words short_words long_words line_words repeated_lines letters capitalised distinct_letters".split()
)


def describe(text: str | None) -> list[float]:
    """The features of one whole text, in the order of NAMES."""
    text = text or ""
    words, n = text.split(), len(text)
    if not words:
        return [0.0] * len(NAMES)
    m = len(words)
    lowered = [w.lower() for w in words]
    seen = Counter(lowered)
    pairs = set(zip(lowered, lowered[1:]))
    found = _LETTERS.findall(text)
    letters = sum(map(len, found))
    lines = [x for x in text.split("\n") if x.strip()]
    upper = sum(w.isupper() and len(w) > 1 for w in found)
    digits = sum(map(text.count, "0123456789"))
    spaces = n - sum(map(len, words))
    lengths = [len(w) for w in words]
    return [
        np.log1p(m), letters / max(1, len(found)), np.log1p(n), upper / max(1, len(found)), digits / n, max(0, n - letters - digits - spaces) / n,
        len(_RUN.findall(text)) / m, text.count("|") / m, len(seen) / m, max(seen.values()) / m, sum(a == b for a, b in zip(lowered, lowered[1:])) / m,
        len(pairs) / max(1, m - 1), m / (1 + len(_SENTENCE.findall(text))), sum(x <= 3 for x in lengths) / m, sum(x > 12 for x in lengths) / m,
        m / len(lines), 1 - len(set(lines)) / len(lines), letters / n, sum(w[:1].isupper() for w in words) / m, len(set(text)) / np.sqrt(n),
    ]


def described(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and x, the features of each text."""
    kinds = ", ".join(f"{c} {t}" for c, t in docs.select(*keep).dtypes)

    def run(batches):
        for batch in batches:
            x = pa.array([describe(t.as_py()) for t in batch["text"]], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), x], names=[*keep, "x"])

    return docs.select(*keep, "text").mapInArrow(run, f"{kinds}, x array<double>")


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Inner bin edges: quantiles of the values, each once."""
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """(gain, cut) of the best split of a histogram into bins up to ``cut`` and those after it."""
    a, b, c, d = np.cumsum(g)[:-1], np.cumsum(h)[:-1], g.sum(), h.sum()
    gain = a * a / (b + _L2) + (c - a) ** 2 / (d - b + _L2) - c * c / (d + _L2)
    gain = np.where((b >= _LEAST * 0.05) & (d - b >= _LEAST * 0.05), gain, -1.0)
    if not len(gain):
        return -1.0, 0
    k = int(gain.argmax())
    return float(gain[k]), k


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of at most three leaves over the bins of one feature, as a step per bin."""
    parts = [(0, len(g))]
    for _ in range(2):
        cuts = [(*_best_cut(g[a:b], h[a:b]), a, b) for a, b in parts]
        gain, k, a, b = max(cuts)
        if gain <= 0:
            break
        parts.remove((a, b))
        parts += [(a, a + k + 1), (a + k + 1, b)]
    step = np.zeros(len(g))
    for a, b in parts:
        step[a:b] = -g[a:b].sum() / (h[a:b].sum() + _L2)
    return step


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, step per cell) of the best tree with one cut in each of two features."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    total_g, total_h = cg[-1, -1], ch[-1, -1]
    a, b = cg[:-1, :-1], ch[:-1, :-1]
    right_g, right_h = cg[:-1, -1:] - a, ch[:-1, -1:] - b
    below_g, below_h = cg[-1:, :-1] - a, ch[-1:, :-1] - b
    far_g, far_h = total_g - a - right_g - below_g, total_h - b - right_h - below_h
    if not a.size:
        return -1.0, np.zeros_like(g)
    gain = sum(x * x / (y + _L2) for x, y in ((a, b), (right_g, right_h), (below_g, below_h), (far_g, far_h))) - total_g**2 / (total_h + _L2)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    step = np.empty_like(g)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for cols in (slice(0, j + 1), slice(j + 1, None)):
            step[rows, cols] = -g[rows, cols].sum() / (h[rows, cols].sum() + _L2)
    return float(gain[i, j]), step


@dataclass
class Model:
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]
    base: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        """Sums of table entries for the rows of ``x``."""
        out = np.full(len(x), self.base)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables)):
            out += table[np.searchsorted(edges, x[:, f], "left")]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            out += table[np.searchsorted(self.pair_edges[i], x[:, i], "left"), np.searchsorted(self.pair_edges[j], x[:, j], "left")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -60, 60)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS, pairs: int = PAIRS) -> Model:
    """Boost the tables of every feature in turn, then those of the pairs with most to gain."""
    n, f = x.shape
    edges, coarse = [_edges(x[:, k], BINS) for k in range(f)], [_edges(x[:, k], PAIR_BINS) for k in range(f)]
    at = [np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)]
    cell = [np.searchsorted(e, x[:, k], "left") for k, e in enumerate(coarse)]
    base = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    tables, out = [np.zeros(len(e) + 1) for e in edges], np.full(n, base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(out, -60, 60)))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for k in range(f):
            g, h = slopes()
            step = RATE * _tree(np.bincount(at[k], g, len(tables[k])), np.bincount(at[k], h, len(tables[k])))
            tables[k] += step
            out += step[at[k]]

    def grid(i: int, j: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        flat = cell[i] * shape[1] + cell[j]
        return *(np.bincount(flat, v, shape[0] * shape[1]).reshape(shape) for v in (g, h)), flat

    g, h = slopes()
    rated = sorted(((-_pair_tree(*grid(i, j, g, h)[:2])[0], i, j) for i in range(f) for j in range(i)))
    chosen = [(i, j) for _, i, j in rated[:pairs]]
    pair_tables = [np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for i, j in chosen]
    for _ in range(pair_rounds):
        for (i, j), table in zip(chosen, pair_tables):
            cg, ch, flat = grid(i, j, *slopes())
            step = RATE * _pair_tree(cg, ch)[1]
            table += step
            out += step.ravel()[flat]
    return Model(edges, tables, coarse, chosen, pair_tables, base)


def held_out(id_col: Column) -> Column:
    """Whether the id is never learned from: crc32 of its text leaves 1 when divided by 3 (a null id: no)."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from labelled rows that are not held out; None unless both labels occur."""
    labelled = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("y"))
    labelled = labelled.where(~held_out(F.col("doc_id")))
    share = min(1.0, sample / max(1, labelled.count()))
    chosen = labelled.where(F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("quality")), 2) < F.lit(int(share * 2**62)))
    # about ``sample`` rows of two numbers
    known = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id")
    table = described(known, ["doc_id", "y"]).toArrow()  # about ``sample`` rows of numbers
    y = table["y"].to_numpy()
    if len(np.unique(y)) < 2:
        return None
    x = table["x"].combine_chunks().flatten().to_numpy().reshape(len(y), -1)
    order = np.lexsort((*x.T[::-1], y, table["doc_id"].to_numpy()))
    return fit(x[order], y[order].astype(np.float64))


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Return doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted for every row of ``docs``.

    Labels other than 0 and 1 are ignored; without both, every score is 0.5. A null or empty text has features of zero and is
    scored like any other; repeated rows score alike; other columns are ignored; an empty table gives none.
    """
    model = train(docs, labels, sample)

    def run(batches):
        for batch in batches:
            x = np.array([describe(t.as_py()) for t in batch["text"]], np.float64).reshape(len(batch["text"]), len(NAMES))
            p = np.full(len(x), 0.5) if model is None else model.score(x)
            columns = [batch["doc_id"], batch["held_out"], pa.array(p), pa.array((p >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
